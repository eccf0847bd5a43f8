"""Operators with a large-data path, forced onto it on small data and checked against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapegrid.operators import board as bd
from tapegrid.operators.asof import asof_backward
from tapegrid.operators.quantiles import exact_quantiles
from tapegrid.operators.running import counts_before, running, running_percentile

PROBS = [0.0, 0.005, 0.05, 0.25, 0.5, 0.75, 0.95, 0.995, 1.0]
NAMES = [f"q{i}" for i in range(len(PROBS))]


def sample(n, seed, ties):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n) * 50 + rng.exponential(200, size=n)
    if ties:
        v[: n // 3] = 7.0          # a third of all rows share one value
    return np.round(v, 2)


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("n", [1, 2, 37, 4000])
def test_exact_quantiles_bracket_path(spark, n, ties):
    v = sample(n, n, ties)
    df = spark.createDataFrame(pd.DataFrame({"v": v})).repartition(5)
    got = exact_quantiles(df, [], "v", PROBS, NAMES, accuracy=200).first()
    np.testing.assert_allclose([got[c] for c in NAMES], np.quantile(v, PROBS), rtol=1e-12, atol=1e-9)


def test_exact_quantiles_keys_and_domain(spark):
    pdf = pd.DataFrame({"k": ["a"] * 3000 + ["b"] * 900 + ["c"] * 1, "v": np.r_[sample(3000, 1, True), sample(900, 2, False), [3.0]]})
    pdf.loc[5, "v"] = None
    df = spark.createDataFrame(pdf).repartition(4)
    for domain in (None, ["a", "b", "c", "never"]):
        got = {r["k"]: [r[c] for c in NAMES] for r in exact_quantiles(df, ["k"], "v", PROBS, NAMES, domain, accuracy=100).collect()}
        assert set(got) == {"a", "b", "c"}
        for k, g in pdf.groupby("k"):
            np.testing.assert_allclose(got[k], np.quantile(g["v"].dropna(), PROBS), rtol=1e-12, atol=1e-9)


def test_scaler_equals_quantiles_of_the_filled_columns(spark):
    """Columns with no, few, many and only NULLs, through brackets and without."""
    from tapegrid.operators import scaling as sc
    n = 3000
    pdf = pd.DataFrame({f"x{k}": np.where(np.random.default_rng(k).random(n) < share, np.nan, sample(n, k, k % 2 == 1))
                        for k, share in enumerate([0.0, 0.0, 0.02, 0.3, 0.88, 0.93, 0.97, 0.999, 1.0])})
    pdf["two"] = np.where(np.arange(n) % 5 == 0, np.nan, np.arange(n) % 2)
    cols = list(pdf.columns)
    df = spark.createDataFrame(pdf).repartition(6)
    for accuracy in (150, 20_000):
        got = {r["column_name"]: r for r in sc.fit_scaler(df, cols, accuracy).collect()}
        assert sorted(got) == sorted(cols)
        for c in cols:
            x = pdf[c].dropna()
            fill = float(x.median()) if len(x) else 0.0
            low, mid, high = np.quantile(pdf[c].fillna(fill), [0.05, 0.5, 0.95])
            want = [fill, mid, high - low if high > low else 1.0]
            np.testing.assert_allclose([got[c][k] for k in ("fill", "center", "scale")], want, rtol=1e-10, atol=1e-9, err_msg=c)
            assert (got[c]["has_null"], got[c]["is_binary"]) == (len(x) < n, x.nunique() <= 2), c


@pytest.mark.parametrize("ties,parts", [(False, 8), (True, 8), (False, 16)])
def test_running_percentile_blocks(spark, ties, parts):
    n = 1500
    pdf = pd.DataFrame({"node": ["hot"] * n + ["cold"] * 40, "trial": list(range(n)) + list(range(40)),
                        "v": np.r_[sample(n, 3, ties), sample(40, 4, ties)]})
    pdf.loc[pdf.index % 11 == 0, "v"] = None
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(4)
    got = running_percentile(df, ["node"], "trial", "v", 0.6, "p", block=64, parts=parts).toPandas()
    for node, g in pdf.groupby("node"):
        seen, want = [], {}
        for t, v in zip(g["trial"], g["v"]):
            want[t] = np.quantile(seen, 0.6) if seen else None
            if np.isfinite(v):
                seen.append(v)
        sub = got[got["node"] == node].set_index("trial")["p"]
        for t, w in want.items():
            x = sub[t]
            assert (w is None and (x is None or np.isnan(x))) or abs(x - w) < 1e-9, (node, t, x, w)


def test_running_min_max_sum_over_blocks(spark):
    pdf = pd.DataFrame({"k": ["a"] * 500, "o": range(500), "v": sample(500, 5, False)})
    df = spark.createDataFrame(pdf).repartition(3)
    out = running(df, ["k"], "o", {"lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "s": ("sum", F.col("v"))}, block=32).toPandas().sort_values("o")
    s = pdf["v"]
    np.testing.assert_allclose(out["lo"].to_numpy()[1:], s.cummin().to_numpy()[:-1])
    np.testing.assert_allclose(out["hi"].to_numpy()[1:], s.cummax().to_numpy()[:-1])
    np.testing.assert_allclose(out["s"].to_numpy()[1:], s.cumsum().to_numpy()[:-1])
    assert np.isnan(out["lo"].to_numpy()[0])


@pytest.mark.parametrize("steady", [False, True])
@pytest.mark.parametrize("advance,block", [("any", 2), ("any", 40), ("promotion", 3), ("promotion", 40), ("any", 65536), ("promotion", 65536)])
def test_promotions_equal_the_sequential_rule(spark, advance, block, steady):
    """Random scores, and one node whose scores improve all the time (every trial a record, many runs)."""
    if steady and block < 40:
        return
    rng = random.Random(11)
    size, noise = (300, 0.002) if steady else (2000, 1.0)
    fall = lambda t: 3.0 - t / 150 if steady else 1.0 / (1 + t / 400)
    rows = [("n", t, "ok" if rng.random() > 0.1 else "failed", fall(t) + noise * rng.random(), fall(t) + noise * rng.random(),
             "eod_pre11" if rng.random() > 0.1 else "old") for t in range(size)]
    df = spark.createDataFrame(rows, "node string, trial long, status string, score double, test_score double, scoring_version string").repartition(4)
    got = {(r["trial"], r["promoted"]) for r in bd.promotions(df, ["node"], 0.01, advance, block=block).collect()}
    bar = champ = float("inf")
    want = set()
    for _, t, status, s, x, ver in rows:
        if status != "ok" or ver != "eod_pre11":
            continue
        tested = s < bar - 0.01
        won = tested and x < champ - 0.01
        if won:
            champ = x
        if won or (tested and advance == "any"):
            bar = s
        if won or (tested and advance == "any"):
            want.add((t, won))
    assert got == want and len(want) > 3


def test_asof_equals_merge_asof_on_a_hot_key(spark):
    rng = np.random.default_rng(8)
    t0 = pd.Timestamp("2024-03-01")
    stamp = lambda n: t0 + pd.to_timedelta(np.sort(rng.integers(0, 5 * 3600, n)), unit="s")
    left = pd.DataFrame({"symbol": ["H"] * 300 + ["C"] * 20, "ts": list(stamp(300)) + list(stamp(20)), "id": range(320)})
    right = pd.DataFrame({"symbol": ["H"] * 200 + ["C"] * 5, "ts": list(stamp(200)) + list(stamp(5)), "px": rng.random(205), "seq": range(205)})
    got = asof_backward(spark.createDataFrame(left), spark.createDataFrame(right), ["symbol"], ["px"], bucket_minutes=30).toPandas().set_index("id")["px"]
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values(["ts", "seq"])[["symbol", "ts", "px"]], on="ts", by="symbol").set_index("id")["px"]
    for i in range(320):
        assert (np.isnan(got[i]) and np.isnan(want[i])) or got[i] == want[i]


def test_no_row_is_lost_on_the_grid(spark):
    """Every in-session tick is inside exactly one bar count."""
    from tapegrid.operators import grid as gr
    from tapegrid.plans import fixtures as fx
    t = fx.ticks(spark, "/root/testdata/sf0.001")
    n = gr.regular_hours(t, fx.FIXTURE).count()
    assert gr.ticks_to_bars(t, fx.FIXTURE).agg(F.sum("n_ticks")).first()[0] == n


def test_counts_of_full_blocks(spark):
    """Blocks of the largest size in which every row passes: no packed count runs into the next."""
    df = spark.range(70_000).select(F.lit("k").alias("k"), F.col("id").alias("o"))
    tests = [F.lit(True), F.col("o") % 3 == 0, F.lit(False), F.col("o") >= 40_000, F.lit(True), F.lit(None).cast("boolean")]
    out = counts_before(df, ["k"], "o", tests, "c", 32767, 6)
    o = F.col("o")
    want = F.array(o, F.floor((o + 2) / 3).cast("bigint"), F.lit(0).cast("bigint"), F.greatest(o - 40_000, F.lit(0)), o, F.lit(0).cast("bigint"))
    assert out.count() == 70_000 and out.filter(F.col("c") != want).count() == 0


@pytest.mark.parametrize("drift", ["up", "jump"])
def test_running_percentile_of_drifting_values_in_bounded_tasks(spark, drift):
    """Ranges that are asked for only early, only late or never; the partitions grow with the rows, not with the session's setting."""
    n, least = 3000, 8
    v = {"up": np.arange(n) / 2, "jump": np.where(np.arange(n) % 700 < 350, 1e4, -1e4)}[drift] + sample(n, 9, False)
    v[5::13] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"node": "hot", "trial": np.arange(n), "v": v})).withColumn("v", F.nanvl("v", F.lit(None))).repartition(3)
    out = running_percentile(df, ["node"], "trial", "v", 0.6, "p", block=64, least=least, rows_per_task=200).withColumn("at", F.spark_partition_id())
    got = out.toPandas().set_index("trial")
    assert got["at"].nunique() > 20 and got["at"].value_counts().max() < 300
    for t in range(n):
        seen = v[:t][np.isfinite(v[:t])]
        want = np.quantile(seen, 0.6) if t >= least and len(seen) else np.nan
        np.testing.assert_allclose(got["p"][t], want, rtol=1e-12, atol=1e-9, err_msg=str(t))


def test_prune_bar_in_bounded_tasks(spark):
    """Screens that are NULL, NaN or infinite count for the warm-up only; one node owns most trials."""
    rng = np.random.default_rng(4)
    rows = [("hot" if t % 10 else "cold", t, float(x)) for t, x in enumerate(np.round(rng.random(1500), 3))]
    rows = [(k, t, None if t % 7 == 0 else float("nan") if t % 11 == 0 else float("inf") if t % 13 == 0 else x) for k, t, x in rows]
    rows += [("few", t, 0.5) for t in range(9)]
    df = spark.createDataFrame(rows, "node string, trial long, screen_score double").repartition(3)
    out = bd.prune_bar(df, ["node"], rows_per_task=300).withColumn("at", F.spark_partition_id())
    got = {(r["node"], r["trial"]): (r["prune_bar"], r["prune"]) for r in out.collect()}
    assert len(got) == len(rows) and out.select("at").distinct().count() > 4
    seen, before = {}, {}
    for k, t, x in sorted(rows, key=lambda r: r[1]):
        past = seen.setdefault(k, [])
        bar = np.quantile(past, 0.6) if before.get(k, 0) >= 8 and past else None
        finite = x is not None and np.isfinite(x)
        assert (got[k, t][0] is None) == (bar is None) and (bar is None or abs(got[k, t][0] - bar) < 1e-12), (k, t)
        assert got[k, t][1] == bool(finite and bar is not None and x > got[k, t][0]), (k, t)
        before[k] = before.get(k, 0) + 1
        if finite:
            past.append(x)
