"""Hand-made inputs with known answers."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapegrid.config import SessionConfig
from tapegrid.functions import clock, market as mk
from tapegrid.functions.pricing import cdf, implied
from tapegrid.operators import board as bd, chain as ch, evaluate as ev, features as fe, fusion as fu, grid as gr, ladder as ld, physics as ph, splits as sp

NY = SessionConfig()
D = dt.date(2024, 6, 3)


def state(spark, gex, minutes, strikes, spot, z=0.0, oi=100.0):
    rows = [("X", D, 390 - int(minutes), float(k), float(g), oi, oi, spot, float(minutes), 0.0, 2.5, z) for k, g in zip(strikes, gex)]
    df = spark.createDataFrame(rows, "symbol string, session_date date, bar int, strike double, gex double, call_oi double, put_oi double, spot double, "
                               "minutes_to_close double, rv_1m double, implied_move double, net_prem_z double")
    return ph.profile(ph.attractor_masses(ph.implied_move(ph.ladder_state(df))))


def pin_ladder(minutes, spark, z=0.0, flat=False):
    ks = list(range(635, 656))
    gex = [0.0] * 21 if flat else [1e6 * math.exp(-0.5 * ((k - 646) / 1.5) ** 2) * (2.2 if k == 646 else 1.0) for k in ks]
    return state(spark, gex, minutes, ks, 645.37, z, 0.0 if flat else 100.0)


def predictions(p, value=0.0):
    h = ph.horizon_rows(p)
    v = F.lit(value).cast("double")
    return h.withColumns({"lgb": v, "cat": v, "q10": v, "q50": v, "q90": v})


def fused(spark, p, value):
    d = fu.expert_prices(predictions(p, value))
    t = ph.targets(p, d.select(*ld.SNAP, "horizon", F.col("consensus").alias("start")))
    d = d.join(t.select(*ld.SNAP, "horizon", F.col("physics_target").alias("x_physics"), "pin_strike", "pin_strength", "snap_applied"), [*ld.SNAP, "horizon"])
    return {r["horizon"]: r for r in fu.fuse(fu.gate(d)).collect()}


def test_pin_near_the_close(spark):
    r = fused(spark, pin_ladder(22, spark), 0.0)["eod"]
    assert r["pin_strike"] == 646.0 and not r["snap_applied"] and r["w_physics"] > 0.8


def test_high_flow_silences_the_deep_expert(spark):
    r = fused(spark, pin_ladder(240, spark, z=3.6), 0.0)["30m"]
    assert r["w_tft"] == 0.0 and r["high_vol_fallback"]


def test_all_experts_missing_leaves_physics(spark):
    for r in fused(spark, pin_ladder(120, spark), None).values():
        assert math.isfinite(r["target"]) and abs(r["w_physics"] - 1.0) < 1e-6


def test_zero_ladder_stays_finite(spark):
    p = pin_ladder(120, spark, flat=True).drop("implied_move").withColumn("rv_1m", F.lit(0.0))
    p = ph.implied_move(p)
    for r in fused(spark, p, 0.1).values():
        assert math.isfinite(r["target"]) and math.isfinite(r["confidence"])


def test_seismic_scale(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.0, 3.0, 4.0, -1.0)], "r double")
    got = [r[0] for r in df.select(mk.magnitude(F.col("r"), F.lit(1.0))).collect()]
    assert got == [2.9, 5.0, 7.5, 8.8, 9.4, 0.0]


def test_decay_weights(spark):
    days = sp.session_dates(spark.createDataFrame([(D + dt.timedelta(days=i),) for i in range(5) for _ in range(3)], "session_date date"))
    w = lambda h: [r["weight"] for r in sp.decay_weight(days, h).orderBy("session_date").collect()]
    assert w(1) == [1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0] and w(2)[0] == 0.25 and w(0) == [1.0] * 5


def board(spark, rows):
    return spark.createDataFrame(rows, "trial long, status string, score double, scoring_version string")


def test_seed_bar(spark):
    bar = lambda rows, champ=True: bd.seed_bar(board(spark, rows), champ).first()["bar"]
    inf = float("inf")
    assert bar([]) == inf
    assert bar([(1, "failed", 0.3, "eod_pre11")]) == inf
    assert bar([(1, "ok", float("nan"), "eod_pre11"), (2, "ok", inf, "eod_pre11")]) == inf
    assert bar([(1, "ok", 0.52, "eod_pre11"), (2, "ok", 0.4, "old"), (3, "ok", 0.6, "eod_pre11")]) == 0.52
    assert bar([(1, "ok", 0.52, "eod_pre11")], champ=False) == inf


def test_eod_mask_counts(spark):
    rows = []
    for s in range(3):
        for m in range(390):
            ts = dt.datetime(2024, 6, 3 + s, 13, 30) + dt.timedelta(minutes=m)     # 09:30 New York in UTC
            rows.append((ts, "eod", 0.5, 0.4, None, 0.6))
    df = spark.createDataFrame(rows, "ts timestamp, horizon string, y double, lgb double, cat double, q50 double")
    r = ev.horizon_scores(ev.scored_rows(df, "America/New_York"), ["eod"]).first()
    assert (r["scored"], r["dropped"]) == (270, 900) and r["mae"] == pytest.approx(0.0, abs=1e-9)
    few = ev.horizon_scores(ev.scored_rows(df.limit(20), "America/New_York"), ["eod"]).first()
    assert few["mae"] is None


def ticks(spark, days, price=lambda d, m: 100.0 + d + m / 390.0):
    rows = []
    for i, day in enumerate(days):
        for m in range(0, 391):
            local = pd.Timestamp(day).tz_localize("America/New_York") + pd.Timedelta(minutes=570 + m)
            rows.append((len(rows), "X", local.tz_convert("UTC").tz_localize(None).to_pydatetime(), float(price(i, m)), 10.0))
    return spark.createDataFrame(rows, "seq long, symbol string, ts timestamp, spot double, volume double")


@pytest.mark.parametrize("day", ["2024-03-08", "2024-03-11", "2024-11-01", "2024-11-04"])
def test_dst_sessions(spark, day):
    g = gr.with_bar_timestamp(gr.session_grid(ticks(spark, [day]), NY), NY).toPandas().sort_values("bar")
    assert len(g) == 391 and g["minutes_to_close"].iloc[0] == 390 and g["minutes_to_close"].iloc[-1] == 0
    assert (g["age_min"] == 0).all()
    first = pd.Timestamp(g["ts"].iloc[0]).tz_localize("UTC").tz_convert("America/New_York")
    assert (first.hour, first.minute) == (9, 30)


def test_naive_times_at_clock_changes(spark):
    text = ["2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-06-03 09:30:00", "2024-06-03T09:30:00-04:00", "junk"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(F.date_format(clock.parse_timestamp(F.col("t"), "America/New_York"), "HH:mm")).collect()]
    assert got == [None, None, "13:30", "13:30", None]


def test_prior_return_is_yesterdays(spark):
    days = ["2024-06-03", "2024-06-04", "2024-06-05", "2024-06-06"]
    close = [101.0, 103.0, 102.0, 110.0]
    g = gr.session_grid(ticks(spark, days, lambda d, m: close[d]), NY)
    h = fe.prior_session(g).groupBy("session_date").agg(F.max("hist_prior_ret").alias("r"), F.max("hist_prior_close").alias("c")).orderBy("session_date").collect()
    assert [x["c"] for x in h] == [None, 101.0, 103.0, 102.0]
    assert h[3]["r"] == pytest.approx(math.log(102 / 103)) and h[1]["r"] is None


def test_minute_grid_features_are_bar_local(spark):
    g = fe.price_context(gr.session_grid(ticks(spark, ["2024-06-03"]), NY), NY).toPandas().sort_values("bar")
    assert g["ret_1m"].isna().sum() == 1 and g["rv_1m"].isna().sum() == 5
    lp = np.log(g["spot"].to_numpy())
    assert g["rv_1m"].iloc[40] == pytest.approx(max(pd.Series(np.diff(lp)).iloc[10:40].std(), 1e-4))


def test_implied_vol_round_trip():
    rng = np.random.default_rng(2)
    s, k = rng.uniform(90, 110, 200), rng.uniform(90, 110, 200)
    t, vol, call = rng.uniform(0.01, 0.3, 200), rng.uniform(0.1, 1.5, 200), rng.random(200) > 0.5
    dev = vol * np.sqrt(t)
    up = np.log(s / k) / dev + dev / 2
    p = s * cdf(up) - k * cdf(up - dev)
    p = np.where(call, p, p - s + k)
    intrinsic = np.maximum(np.where(call, s - k, k - s), 0)
    got = implied(p, s, k, t, call)
    good = p > intrinsic + 0.02
    assert max(abs(float(c) - 0.5 * (1 + math.erf(x / math.sqrt(2)))) for x in (-9.0, -7.5, -3.0, -0.1, 0.0, 0.4, 2.0, 8.0) for c in [cdf(np.array(x))]) < 1e-14
    assert good.sum() > 100
    np.testing.assert_allclose(got[good], vol[good], atol=1e-4)
    assert np.isnan(implied([1.0], [110.0], [100.0], [0.1], [True])[0])       # below intrinsic
    assert np.isnan(implied([99.9], [100.0], [100.0], [0.001], [True])[0])    # ceiling


def test_max_pain_equals_the_pair_sum(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for bar in range(30):
        ks = np.sort(rng.choice(np.arange(80, 120), 12, replace=False)).astype(float)
        c, p = rng.integers(0, 50, 12).astype(float), rng.integers(0, 50, 12).astype(float)
        pain = [sum(c * np.maximum(x - ks, 0) + p * np.maximum(ks - x, 0)) for x in ks]
        want[bar] = ks[int(np.argmin(pain))]
        rows += [("X", D, bar, float(k), 1.0, float(a), float(b), 100.0) for k, a, b in zip(ks, c, p)]
    df = spark.createDataFrame(rows, "symbol string, session_date date, bar int, strike double, gex double, call_oi double, put_oi double, spot double")
    got = {r["bar"]: r["mp"] for r in ld.with_profile(df).groupBy(*ld.SNAP).agg(ld.max_pain().alias("mp")).collect()}
    assert got == want


def test_atm_vol_change_over_five_rows(spark):
    g = gr.session_grid(ticks(spark, ["2024-06-03"]), NY).select(*ld.SNAP, "spot")
    rows = g.select(*ld.SNAP, F.lit(100.0).alias("strike"), (F.col("bar") * 0.01).alias("iv_call"), (F.col("bar") * 0.03).alias("iv_put"),
                    F.lit(1.0).alias("call_prem"), F.lit(1.0).alias("put_prem"))
    r = ld.atm_block(g, rows).filter("bar = 50").first()
    assert r["iv_atm_chg_5"] == pytest.approx(0.1) and r["iv_skew_atm"] == pytest.approx(1.0)


def test_history_builder_compat_labels(spark):
    raw = spark.createDataFrame([(1, "X", dt.datetime(2024, 6, 3, 13, 32, 30), 100.0, "C", 5.0, 10.0),
                                 (2, "X", dt.datetime(2024, 6, 3, 13, 32, 40), 100.0, "P", 4.0, 7.0)],
                                "seq long, symbol string, ts timestamp, strike double, type string, c double, v double")
    assert {r["bar"] for r in ch.contract_bars(raw, NY).collect()} == {3}
    assert {r["bar"] for r in ch.contract_bars(raw, NY, "start").collect()} == {2}
    causal, compat = ch.build_session(raw, NY)[2], ch.build_session(raw, NY, compat=True)[2]
    assert causal.filter("spot is null").count() == 3 and compat.filter("spot is null").count() == 0
    assert ch.build_session(raw, NY)[0].select("bar").distinct().collect()[0][0] == 5


def test_session_feed_switch_is_caught_when_it_looks_ahead(spark):
    """The per-session switch may look ahead, the causal scope may not: the causality check tells them apart."""
    from tapegrid.operators.quality import causality_violations
    rows = [(i, "X", dt.datetime(2024, 6, 3, 13, 31) + dt.timedelta(minutes=i), 100.0, 1.0, 1.0, *([2.0] * 4 if i > 20 else [None] * 4)) for i in range(60)]
    lad = spark.createDataFrame(rows, "seq long, symbol string, ts timestamp, strike double, call_prem double, put_prem double, call_ask_prem double, "
                                "call_bid_prem double, put_ask_prem double, put_bid_prem double")
    cut = lad.filter("seq < 30")
    flag = lambda df, scope: fe.feed_switch(fe.strike_premium(df, NY), scope).select(*ld.SNAP, "flow_side_weighted").distinct()
    bad = lambda s: causality_violations(flag(lad, s).filter("bar <= 30"), flag(cut, s), [*ld.SNAP], ["flow_side_weighted"]).count()
    assert bad("session") > 0 and bad("causal") == 0


def test_thin_ladder_is_replaced(spark):
    p = spark.createDataFrame([("X", D, 5, 100.0, 5.0, 1.0, 1.0, 0.0, 100.7)], "symbol string, session_date date, bar int, strike double, gex double, "
                              "call_oi double, put_oi double, volume double, spot double")
    assert [r["strike"] for r in ph.thin_fallback(p).orderBy("strike").collect()] == [99.0, 100.0, 101.0]


def test_gate_weights_find_the_right_expert(spark):
    from tapegrid.operators.forecast import gate_gram, gate_weights
    rng = np.random.default_rng(6)
    n = 300
    s = np.full(n, 100.0)
    y = rng.normal(size=n)
    pdf = pd.DataFrame({"horizon": "30m", "spot": s, "realized": s + y, "x_lgb": s + rng.normal(size=n), "x_cat": s + y + 0.05 * rng.normal(size=n),
                        "x_tft": s - y, "x_physics": s + rng.normal(size=n)})
    r = gate_weights(gate_gram(spark.createDataFrame(pdf))).first()
    assert r["l_cat"] > 0.9 and r["l_tft"] == 0.0 and abs(r["l_lgb"] + r["l_cat"] + r["l_tft"] + r["l_physics"] - 1) < 1e-9
    assert gate_weights(gate_gram(spark.createDataFrame(pdf.head(10)))).count() == 0


def test_stream_drops_late_rows(spark, tmp_path):
    from tapegrid.streaming import ticks as st
    feed = str(tmp_path / "feed")
    one = lambda s, t, p: spark.createDataFrame([(s, "X", t, p)], "seq long, symbol string, ts timestamp, spot double")
    # a row is late against the watermark known one batch earlier, hence the row in between
    for i, (t, p) in enumerate([(dt.datetime(2024, 6, 3, 14, 0, 30), 10.0), (dt.datetime(2024, 6, 3, 15, 0), 11.0), (dt.datetime(2024, 6, 3, 15, 1), 12.0),
                                (dt.datetime(2024, 6, 3, 14, 0, 40), 99.0)]):
        one(i, t, p).coalesce(1).write.mode("append").parquet(feed)
    s = st.read_parquet_stream(spark, feed, files_per_trigger=1)
    got = st.run_available(st.bar_price_stream(s, NY, "1 minute"), "late").collect()
    assert [(r["spot"], r["n"]) for r in got if r["ts"] == dt.datetime(2024, 6, 3, 14, 1)] == [(10.0, 1)]


def test_scaler_takes_nan_and_infinities_as_missing(spark):
    from tapegrid.operators import scaling as sc
    vals = [float("nan"), float("inf"), float("-inf"), None, *[float(i) for i in range(20)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k int, x double")
    p = sc.fit_scaler(df, ["x"])
    row = p.first()
    assert row["fill"] == 9.5 and row["has_null"] and not row["is_binary"]
    got = {r["k"]: r for r in sc.transform(df, p, ["x"], ["k"]).collect()}
    assert all(got[i]["x"] == (9.5 - row["center"]) / row["scale"] and got[i]["x__isna"] == 1.0 for i in range(4)) and got[5]["x__isna"] == 0.0


def test_unscored_boards_come_last(spark):
    from tapegrid.operators import evaluate as ev
    none = spark.createDataFrame([], "horizon string, mae double, acc double")
    assert ev.board_score(none).first()["score"] == float("inf") and ev.weighted_score(none).first()["score"] == float("inf")


def test_frames_with_missing_rows_are_reported(spark):
    from tapegrid.operators.quality import causality_violations
    a, b = (spark.createDataFrame([(k, 1.0) for k in ks], "k int, x double") for ks in ((1, 2), (2, 3)))
    assert sorted((r["k"], r["column_name"], r["full_value"]) for r in causality_violations(a, b, ["k"], ["x"]).collect()) == [(1, "_row", 1.0), (3, "_row", 0.0)]


def test_unlisted_domain_values_are_errors(spark):
    from tapegrid.operators.quantiles import exact_quantiles
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "h string, v double")
    with pytest.raises(Exception, match="outside its domain"):
        exact_quantiles(d, ["h"], "v", [0.5], ["m"], domain=["a"]).collect()
