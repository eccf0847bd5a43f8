"""Queries over assembled features, quality checks, forecasting and the set-based backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

import tapegrid.catalog.io  # noqa: F401
from tapegrid.catalog.features import CFG, grid, price_grid
from tapegrid.catalog.labels import PROFILED, feats, lagged_frame, mags, profiled
from tapegrid.catalog.registry import query
from tapegrid.catalog.sqlbase import define, q
from tapegrid.config import FAMILIES
from tapegrid.functions import clock
from tapegrid.functions.market import family
from tapegrid.operators import evaluate as ev, features as fe, forecast as fo, grid as gr, ladder as ld, physics as ph, quality as qa, sequences as sq, splits as sp, targets as tg
from tapegrid.operators.windows import SESSION
from tapegrid.plans import assembly as asm, fixtures as fx
from tapegrid.plans.session import materialise

KEY = "symbol:s session_date:d bar:i "
KEYS = [*SESSION, "bar"]


def features(spark, d):
    return asm.build_features(fx.ticks(spark, d), fx.ladder(spark, d), fx.prints(spark, d), CFG, store=materialise)


@query("fea08_availability", KEY + "has_gex_snapshot:0 has_flow_prints:0",
       q("select symbol, session_date, bar, cast(gex_net_total is not null as int) as has_gex_snapshot, 1 as has_flow_prints from carried"))
def _(spark, d):
    g = grid(spark, d)
    m = ld.grid_metrics(g, ld.snapshot_metrics(ld.with_spot(ld.strike_rows(fx.ladder(spark, d), CFG), g)), CFG)
    b = fe.block_sweep(g.select(*KEYS), fe.bar_flow(fx.prints(spark, d), CFG))
    return fe.availability_flags(m.join(b, KEYS))


define("asm", """select p.symbol, p.session_date, p.bar, p.ret_1m, p.rv_1m, p.dist_to_twap, h.hist_gap_pct, g.gex_net_total, g.gex_dist_to_zero, m.net_prem_cum_session,
    m.otm_skew_level, f.inst_block_weight, f.block_signed_bias, coalesce(c.vol_avg_30, 0) as vol_avg_30,
    coalesce(g.gex_net_total - lag(g.gex_net_total, 10) over (partition by p.symbol, p.session_date order by p.bar), 0) as gex_net_total_d10m
    from price p left join hist h on p.symbol = h.symbol and p.session_date = h.session_date
    left join carried g on p.symbol = g.symbol and p.session_date = g.session_date and p.bar = g.bar
    left join prem3 m on p.symbol = m.symbol and p.session_date = m.session_date and p.bar = m.bar
    left join flow3 f on p.symbol = f.symbol and p.session_date = f.session_date and p.bar = f.bar
    left join candle c on p.symbol = c.symbol and p.session_date = c.session_date and p.bar = c.bar""")


@query("fea09_assembly", KEY + "ret_1m:8 rv_1m:8 dist_to_twap:8 hist_gap_pct:8 gex_net_total:5 gex_dist_to_zero:5 net_prem_cum_session:4 otm_skew_level:6 "
       "inst_block_weight:6 block_signed_bias:6 vol_avg_30:6 gex_net_total_d10m:5", q("select * from asm"))
def _(spark, d):
    return features(spark, d)


CUTS = ((0.25, 45), (0.5, 180), (1.0, 330))
_AT = "(values " + ", ".join(f"({i}, {share}, {bar})" for i, (share, bar) in enumerate(CUTS)) + ") as v(cut, share, last_bar)"
define("cuts", f"""select v.cut, session_date as last_day, last_bar from (select session_date, row_number() over (order by session_date) - 1 as r, count(*) over () as n
    from (select distinct session_date from rth)) join {_AT} on r = floor((n - 1) * share)""")
_UPTO = "(x.session_date < c.last_day or (x.session_date = c.last_day and x.bar <= c.last_bar))"
define("cutrows", f"select c.cut, x.symbol, x.session_date, x.bar from grid x join cuts c on {_UPTO} where x.spot is not null")


def cut_features(spark, d, ladder, scope: str):
    """Features of the whole feeds and of the feeds at every cut in one run: a copy's symbol carries its cut. Returns (frame, cuts)."""
    bars = materialise(gr.ticks_to_bars(fx.ticks(spark, d), CFG).select(*KEYS), "bars")
    cuts = materialise(qa.cut_table(sp.session_dates(bars), CUTS), "cuts")
    day, bar = clock.local_date(F.col("ts"), CFG.tz), clock.ceil_bar(F.col("ts"), CFG)

    def copies(feed):
        return qa.at_cuts(feed, cuts, day, bar).withColumn("symbol", F.concat_ws("|", "cut", "symbol")).drop("cut")

    f = asm.build_features(copies(fx.ticks(spark, d)), copies(ladder), copies(fx.prints(spark, d)), CFG, premium_scope=scope, store=materialise)
    at, f = F.split("symbol", r"\|", 2), f.filter("spot is not null")  # a bar before the first trade has no row yet when it happens
    return materialise(f.withColumns({"cut": at[0].cast("int"), "symbol": at[1]}), "atcuts"), cuts


@query("chk01_causality", "cut:i n_rows:i missing:i n_columns:i violations:i",
       q("select cut, count(*) as n_rows, 0 as missing, 173 as n_columns, 0 as violations from cutrows group by 1"))
def _(spark, d):
    """Features of the whole feeds against features of feeds cut at three bars of three sessions: up to a cut no row may differ or be
    missing, lag columns included."""
    frame, cuts = cut_features(spark, d, fx.ladder(spark, d), "causal")
    cols = [c for c in asm.feature_columns(frame) if c != "cut"]
    row = F.col("column_name") == "_row"
    return qa.causality_report(frame, cuts, KEYS, cols).groupBy("cut").agg(
        F.max("n_rows").alias("n_rows"), F.sum(F.when(row, F.col("violations"))).alias("missing"), F.count(F.when(~row, 1)).alias("n_columns"),
        F.sum(F.when(~row, F.col("violations"))).alias("violations"))


# the call-ask side is only quoted from 11:00 on, so a look-ahead over the session changes its mind about the morning
_LATE = 11 * 3600
define("laterows", f"""select p.symbol, p.session_date, p.bar, p.ok and p.us >= {_LATE}000000 as ok, coalesce(p.call_prem, 0) - coalesce(p.put_prem, 0) as raw,
    case when p.us >= {_LATE}000000 then coalesce(p.call_ask_prem, 0) else 0 end - coalesce(p.call_bid_prem, 0) - coalesce(p.put_ask_prem, 0) + coalesce(p.put_bid_prem, 0) as sided
    from (select *, cast(ceil(us / 300000000.0) * 5 - 570 as int) as bar,
          call_ask_prem is not null and call_bid_prem is not null and put_ask_prem is not null and put_bid_prem is not null as ok from ladder) p
    join grid g on p.symbol = g.symbol and p.session_date = g.session_date and p.bar = g.bar""")
define("lateflag", f"""select c.cut, x.symbol, x.session_date, case when count(*) filter (x.ok) * 1.0 / count(*) > 0.5 then 1.0 else 0.0 end as flag
    from laterows x join (select * from cuts union all select {qa.WHOLE}, date '9999-12-31', 0) c on {_UPTO} group by 1, 2, 3""")
define("latebars", """select symbol, session_date, bar, sum(raw) as raw, sum(sided) as sided from laterows group by 1, 2, 3""")
define("latenet", f"""select r.cut, r.symbol, r.session_date, r.bar, b.raw is not null as has, a.flag as fa, f.flag as fb,
    coalesce(case when a.flag > 0 then b.sided else b.raw end, 0) as na, coalesce(case when f.flag > 0 then b.sided else b.raw end, 0) as nb
    from cutrows r left join latebars b on r.symbol = b.symbol and r.session_date = b.session_date and r.bar = b.bar
    left join lateflag a on a.cut = {qa.WHOLE} and r.symbol = a.symbol and r.session_date = a.session_date
    left join lateflag f on f.cut = r.cut and r.symbol = f.symbol and r.session_date = f.session_date""")
_SEEN = "count(*) filter (has) over (partition by cut, symbol, session_date order by bar) > 0"


@query("chk01_lookahead", "cut:i column_name:s n_rows:i violations:i",
       q(f"""select cut, 'net_prem_1m' as column_name, count(*) as n_rows, count(*) filter (abs(na - nb) > 1e-6 + 1e-5 * abs(nb)) as violations from latenet group by 1
            union all select cut, 'flow_side_weighted', count(*), count(*) filter (seen and fa <> fb) from (select *, {_SEEN} as seen from latenet) group by 1
            union all select cut, 'ret_1m', count(*), 0 from latenet group by 1 union all select cut, '_row', count(*), 0 from latenet group by 1"""))
def _(spark, d):
    """The same check on premium decided over the whole session, which looks ahead: the violations are counted."""
    early = F.date_format("ts", "HH:mm:ss") < "11:00:00"
    ladder = fx.ladder(spark, d).withColumn("call_ask_prem", F.when(~early, F.col("call_ask_prem")))
    frame, cuts = cut_features(spark, d, ladder, "session")
    return qa.causality_report(frame, cuts, KEYS, ["ret_1m", "net_prem_1m", "flow_side_weighted"])


@query("jn23_frame_compare", KEY + "column_name:s full_value:5 cut_value:5",
       q("""select symbol, session_date, bar, 'spot' as column_name, spot as full_value, spot + 1 as cut_value from grid where spot is not null and bar >= 300"""))
def _(spark, d):
    g = grid(spark, d).select(*KEYS, "spot", "dow")
    other = g.withColumn("spot", F.when(F.col("bar") >= 300, F.col("spot") + 1).otherwise(F.col("spot")))
    return qa.causality_violations(g, other, KEYS, ["spot", "dow"])


AUDIT = ["ret_1m", "hist_gap_pct", "pos_in_session_range", "session_range", "flag", "dead"]
_FAM = "case " + " ".join(f"when regexp_matches(c, '(?i){p}') then '{n}'" for n, p in FAMILIES) + " else 'Other' end"


BOOK = ["gex", "vanna", "charm", "call_oi", "put_oi", "call_prem", "put_ask_prem", "call_vol", "put_vol"]


@query("up11_family", "column_name:s family:s nulls:i high:4",
       q(f"""select *, {_FAM} as family from (select *, column_name as c from ({profiled(PROFILED, "lagged")} union all {profiled(BOOK, "ladder")}))"""))
def _(spark, d):
    both = sq.column_profile(lagged_frame(spark, d), PROFILED).unionByName(sq.column_profile(fx.ladder(spark, d), BOOK))
    return both.withColumn("family", family(F.col("column_name")))


define("fa", "select *, spot_hi - spot_lo as session_range, 1.0 as dead from feat join "
       "(select symbol as s, session_date as d, bar as b, session_range as spot_hi, 0 as spot_lo from price) on s = symbol and d = session_date and b = bar")
define("fsplit", """select f.*, c.split from feat f join (select session_date, case when r < greatest(1, floor(0.7 * n)) then 'train'
    when r >= greatest(1, floor(0.7 * n)) + 1 and r < greatest(1, floor(0.7 * n)) + 1 + greatest(1, floor(0.15 * n)) then 'val'
    when r >= greatest(1, floor(0.7 * n)) + 2 + greatest(1, floor(0.15 * n)) then 'test' else 'embargo' end as split from
    (select session_date, row_number() over (order by session_date) - 1 as r, count(*) over () as n from (select distinct session_date from feat))) c
    on f.session_date = c.session_date""")


@query("agg27_family_audit", "family:s n_columns:i null_frac:7 n_dead:i status:s",
       q("""select family, count(*) as n_columns, avg(nf) as null_frac, count(*) filter (dead) as n_dead, case when count(*) filter (dead) = count(*) then 'dead'
            when count(*) filter (dead) > 0 then 'partly dead' when avg(nf) > 0.5 then 'sparse' else 'ok' end as status from
            (select c, nf, coalesce(sd = 0, true) as dead, """ + _FAM + """ as family from (""" + " union all ".join(
           f"select '{c}' as c, avg(({c} is null)::int) as nf, stddev_samp({c}) as sd from fa" for c in AUDIT) + ")) group by 1"))
def _(spark, d):
    return qa.family_audit(feats(spark, d).withColumn("dead", F.lit(1.0)), AUDIT)


@query("chk02_gate_report", "check_name:s status:s value:6",
       q("""select 'session floor' as check_name, case when count(distinct session_date) < 7 then 'FAIL' when count(distinct session_date) < 60 then 'WARN' else 'PASS' end as status,
            count(distinct session_date) * 1.0 as value from feat
            union all select 'smallest split', case when min(n) < 30 then 'FAIL' else 'PASS' end, min(n) from (select count(*) as n from fsplit where split <> 'embargo' group by split)
            union all select 'feature count', 'WARN', 3 union all select 'null share', 'PASS', avg(x) from
            (select ((ret_1m is null)::int + (ret_5m is null)::int + (hist_gap_pct is null)::int) / 3.0 as x from feat)"""))
def _(spark, d):
    f = feats(spark, d)
    f = sp.with_split(f, sp.chrono_split(sp.session_dates(f)))
    return qa.gate_report(f, "split", ["ret_1m", "ret_5m", "hist_gap_pct"])


@query("agg11_distinct_counts", "column_name:s n_distinct:i",
       q("""select 'horizon' as column_name, count(distinct horizon) as n_distinct from trades union all select 'day', count(distinct day) from trades
            union all select 'contracts', count(distinct contracts) from trades"""))
def _(spark, d):
    t = fx.trades(spark, d).select(*[F.col(c).cast("string").alias(c) for c in ("horizon", "day", "contracts")])
    # distinct pairs combine map-side, so a frequent value never gathers
    long = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in t.columns])).alias("s")).select("s.*")
    return long.distinct().groupBy("column_name").agg(F.count("v").alias("n_distinct"))


# ---------------------------------------------------------------- magnitude
define("mtrain", """select m.*, p.rv_1m from mags m left join price p on m.symbol = p.symbol and m.session_date = p.session_date and m.bar = p.bar""")
define("deciles", """select *, case when rv_1m is null then 0 else """ + " + ".join(f"(round(rv_1m, 12) > (select round(quantile_cont(rv_1m, {i / 10}), 12) from mtrain where session_date < date '2024-01-25'))::int" for i in range(1, 10)) + """ end as dec from mtrain""")
define("mtable", """select coalesce(u.bucket, d.bucket) as bucket, coalesce(u.dec, d.dec) as rv_decile, mu, md from
    (select bucket, dec, quantile_cont(mag_up, 0.75) as mu from deciles where mag_up is not null and session_date < date '2024-01-25' group by 1, 2) u full join
    (select bucket, dec, quantile_cont(mag_dn, 0.75) as md from deciles where mag_dn is not null and session_date < date '2024-01-25' group by 1, 2) d
    on u.bucket = d.bucket and u.dec = d.dec""")


def mag_rows(spark, d):
    m = mags(spark, d).select(*KEYS, "spot", "bucket", "base", "mag_up", "mag_dn")
    rows = materialise(m.join(price_grid(spark, d).select(*KEYS, "rv_1m"), KEYS, "left"), "mag")
    return fo.volatility_decile(rows, fit_on=_train(rows))


def _train(m):
    return m.filter(F.col("session_date") < F.lit("2024-01-25").cast("date"))


@query("ml03_magnitude_table", "bucket:i rv_decile:i mu:5 md:5", q("select * from mtable"))
def _(spark, d):
    return fo.magnitude_table(_train(mag_rows(spark, d)))


@query("ml07_predict_magnitude", KEY + "pred_up:1 pred_dn:1 net:1 raw_up:6 raw_dn:6 tag:s",
       q("""select *, round_even(round(mu, 9), 1) as pred_up, round_even(round(md, 9), 1) as pred_dn, round_even(round(mu - md, 9), 1) as net, -log2(1 - least(mu, 9.99) / 10) * base as raw_up,
            -log2(1 - least(md, 9.99) / 10) * base as raw_dn,
            case when greatest(mu, md) >= 7.5 then 'move' when greatest(mu, md) >= 6 then 'elevated' else 'normal' end as tag
            from (select x.symbol, x.session_date, x.bar, x.base, t.mu, t.md from deciles x join mtable t on x.bucket = t.bucket and x.dec = t.rv_decile
                  where x.session_date >= date '2024-01-25' and t.mu is not null and t.md is not null)"""))
def _(spark, d):
    m = mag_rows(spark, d)
    test = m.filter(F.col("session_date") >= F.lit("2024-01-25").cast("date"))
    return fo.predict_magnitude(test, fo.magnitude_table(_train(m))).filter("mu is not null and md is not null")


@query("ml03_magnitude_metrics", "n_test:i mae_up:6 naive_mae_up:6 big_up_n:i recall_up:6 precision_up:6 mae_dn:6 net_dir_acc:6 net_dir_n:i",
       q("""select count(*) as n_test, avg(abs(mu - mag_up)) as mae_up, avg(abs(5 - mag_up)) as naive_mae_up, count(*) filter (mag_up >= 7) as big_up_n,
            avg((mu >= 6)::int) filter (mag_up >= 7) as recall_up, avg((mag_up >= 7)::int) filter (mu >= 6) as precision_up, avg(abs(md - mag_dn)) as mae_dn,
            avg((sign(mu - md) = sign(mag_up - mag_dn))::int) filter (abs(mag_up - mag_dn) >= 2) as net_dir_acc, count(*) filter (abs(mag_up - mag_dn) >= 2) as net_dir_n
            from deciles x join mtable t on x.bucket = t.bucket and x.dec = t.rv_decile
            where x.session_date >= date '2024-01-25' and mu is not null and md is not null and mag_up is not null and mag_dn is not null"""))
def _(spark, d):
    m = mag_rows(spark, d)
    test = m.filter(F.col("session_date") >= F.lit("2024-01-25").cast("date"))
    return fo.magnitude_metrics(fo.predict_magnitude(test, fo.magnitude_table(_train(m))))


# ---------------------------------------------------------------- learned experts
X = ["ret_1m", "ret_5m", "rv_1m", "pos_in_session_range", "dist_to_twap"]


def learning_rows(spark, d):
    f = tg.horizon_targets(price_grid(spark, d), CFG).filter("spot is not null")
    f = f.select(*KEYS, *X, F.col("y_retn_30m").alias("label"))
    days = sp.session_dates(f)
    w = sp.decay_weight(days, 20.0).select("session_date", "weight")
    return materialise(fo.assemble(f.join(F.broadcast(w), "session_date").filter("label is not null"), X), "learn"), days


@query("ml01_boosted_trees", KEY + "prediction:6")
def _(spark, d):
    rows, days = learning_rows(spark, d)
    model, _best = fo.fit_on_folds(rows, sp.rolling_folds(days), "label", "weight", rounds=6, depth=3, least=1)
    return model.transform(rows)


HS = [h for h, _ in asm.FC.horizons]
define("tsplit", """select session_date, case when r < a then 'train' when r >= a + 1 and r < a + 1 + b then 'val' when r >= a + 2 + b then 'test' else 'embargo' end as split
    from (select *, greatest(1, floor(0.7 * n)) as a, greatest(1, floor(0.15 * n)) as b from (select session_date, row_number() over (order by session_date) - 1 as r,
    count(*) over () as n from (select distinct session_date from targets where spot is not null)))""")
define("tlong", " union all ".join(f"""select t.symbol, t.session_date, t.bar, s.split, '{h}' as horizon, "y_retn_{h}" as label from targets t join tsplit s
    on t.session_date = s.session_date where t.spot is not null""" for h in HS))
define("tdays", """select session_date, r, n, pow(0.5, (n - 1 - r) / 20.0) as weight from (select session_date, row_number() over (order by session_date) - 1 as r,
    count(*) over () as n from (select session_date from tsplit where split = 'train'))""")
define("tparam", """select horizon, lo, hi, median(greatest(lo, least(hi, label))) as off from tlong join (select horizon as h, quantile_cont(label, 0.005) as lo,
    quantile_cont(label, 0.995) as hi from tlong where split = 'train' and label is not null group by 1) on h = horizon
    where split = 'train' and label is not null group by 1, 2, 3""")


def tree_rows(spark, d):
    """Features, split and label per horizon; training days with decay and folds inside them; label parameters of the training rows."""
    f = tg.horizon_targets(price_grid(spark, d), CFG).filter("spot is not null")
    f = sp.with_split(f.select(*KEYS, *X, *[f"y_retn_{h}" for h in HS]), sp.chrono_split(sp.session_dates(f)))
    f = materialise(fo.assemble(fo.horizon_labels(f, HS), X), "trees")
    days = materialise(sp.session_dates(f.filter("split = 'train'")), "days")
    weight = F.broadcast(sp.decay_weight(days, 20.0).select("session_date", "weight"))
    params = materialise(fo.label_params(f.filter("split = 'train'"), HS), "winsor")
    return fo.centred(f, params, HS).join(weight, "session_date", "left"), days, params


@query("ml01_label_folds", "horizon:s fold:i role:s n:i weight:5 lo:6 hi:6 label_offset:6 target_sum:4",
       q("""select horizon, fold, role, count(*) as n, sum(weight) as weight, lo, hi, off as label_offset, sum(y) as target_sum from (select l.horizon, k as fold, case when r < vs - 1 then 'train' when r >= vs and r < vs + v then 'val' end as role,
            weight, lo, hi, off, greatest(lo, least(hi, label)) - off as y from
            (select *, n - (3 - k) * v as vs from (select *, greatest(1, floor(n / 5)) as v from tdays), (select unnest(range(3)) as k)) c
            join tlong l on l.session_date = c.session_date join tparam p on p.horizon = l.horizon where l.label is not null and vs - 1 >= 3)
            where role is not null group by horizon, fold, role, lo, hi, off"""))
def _(spark, d):
    """What each fold of each horizon learns from: rows, decay weights, clip bounds, offset and targets."""
    rows, days, params = tree_rows(spark, d)
    got = rows.filter("split = 'train' and label is not null").join(F.broadcast(sp.rolling_folds(days)), "session_date")
    g = got.groupBy("horizon", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.sum("target").alias("target_sum"))
    return g.join(params.withColumnRenamed("offset", "label_offset"), "horizon")


@query("ml01_tree_families", KEY + "horizon:s lgb:5 cat:5 tree_mean:5")
def _(spark, d):
    """Both families on all horizons, fitted on training sessions and read on test sessions. Few rounds: a fit is a chain of small jobs."""
    rows, days, _params = tree_rows(spark, d)
    rows = materialise(rows, "treerows")
    models, _history = fo.fit_families(rows.filter("split = 'train'"), sp.rolling_folds(days, folds=1), HS, rounds=3, least=1)
    return fo.predict_families(models, rows.filter("split = 'test'"))


@query("ml06_test_once", "phase:s trials:i n_rows:i",
       q("""select 'val' as phase, 2 as trials, count(*) as n_rows from tlong where horizon = '30m' and label is not null and split = 'val'
            union all select 'test', 1, count(*) from tlong where horizon = '30m' and label is not null and split = 'test'"""))
def _(spark, d):
    rows, days = learning_rows(spark, d)
    s = sp.with_split(rows, sp.chrono_split(days))
    board = fo.select_then_test(s, "label", [{"rounds": 2, "depth": 2}, {"rounds": 2, "depth": 3}], "weight")
    return board.groupBy("phase").agg(F.count(F.lit(1)).alias("trials"), F.max("n_rows").alias("n_rows"))


@query("ml02_robust_linear", KEY + "prediction:5")
def _(spark, d):
    rows, _days = learning_rows(spark, d)
    return fo.fit_robust(rows, "label", "weight").transform(rows)


@query("ml05_importance", "feature:s share:5")
def _(spark, d):
    rows, _days = learning_rows(spark, d)
    model = fo.fit_trees(rows, "label", "weight", rounds=5, depth=3)
    return ev.importance_share(fo.importance_table(spark, model, X, "gbt"))


@query("ml06_compare_configs", "trial:i depth:0 score:5")
def _(spark, d):
    rows, days = learning_rows(spark, d)
    s = sp.with_split(rows, sp.chrono_split(days))
    board = fo.compare_configs(s.filter("split = 'train'"), s.filter("split = 'val'"), "label",
                               [{"rounds": 3, "depth": 2}, {"rounds": 3, "depth": 3}])
    return spark.createDataFrame([(b["trial"], b["depth"], b["score"]) for b in board], "trial bigint, depth double, score double")


@query("jn14_targets_on_features", KEY + "ret_1m:8 mag_up:1",
       q("""select p.symbol, p.session_date, p.bar, p.ret_1m, m.mag_up from price p left join mags m on p.symbol = m.symbol and p.session_date = m.session_date and p.bar = m.bar"""))
def _(spark, d):
    return price_grid(spark, d).join(mags(spark, d).select(*KEYS, "mag_up"), KEYS, "left")


@query("jn15_sequence_predictions", KEY + "ret_1m:8 n_rows:i",
       q("select *, case when row_number() over (partition by symbol, session_date order by bar) >= 12 then 12 end as n_rows from price"))
def _(spark, d):
    from tapegrid.operators.sequences import windows
    p = price_grid(spark, d)
    seq = windows(p, ["ret_1m"], 12).select(*KEYS, F.size("x_seq").alias("n_rows"))
    return p.join(seq, KEYS, "left")


@query("backtest_signals", KEY + "horizon:s target:2 realized:4 direction:i pred_dir:i real_dir:i confidence:5")
def _(spark, d):
    g = price_grid(spark, d)
    h = ph.horizon_rows(g.select(*KEYS, "ret_1m", "ret_5m"))
    preds = h.select(*KEYS, "horizon", F.col("ret_1m").alias("lgb"), F.col("ret_5m").alias("cat"), F.lit(-0.5).alias("q10"),
                     F.lit(0.0).alias("q50"), F.lit(0.5).alias("q90"))
    return asm.backtest_signals(fx.ticks(spark, d), fx.ladder(spark, d), preds, CFG, cadence_rows=1, lookback=12, store=materialise)


@query("training_table", KEY + "split:s ret_1m:5 gex_net_total:5 y_retn_30m:5")
def _(spark, d):
    f = asm.build_features(fx.ticks(spark, d), fx.ladder(spark, d), fx.prints(spark, d), CFG, lags=False, store=materialise)
    keep = f.select(*KEYS, "spot", "rv_1m", "ret_1m", "ret_5m", "gex_net_total", "gex_hhi", "inst_block_weight", "dow")
    return asm.training_table(keep, CFG, store=materialise)[0]


