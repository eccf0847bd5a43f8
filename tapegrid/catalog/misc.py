"""Single-operator queries: windows, top-k, set operations, scalar functions, extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

import tapegrid.catalog.models  # noqa: F401
from tapegrid.catalog.features import CFG, grid, price_grid
from tapegrid.catalog.ladder import spotted, state
from tapegrid.catalog.registry import query
from tapegrid.catalog.sqlbase import SW, q, roll as rs, zscore
from tapegrid.config import LONG_HORIZONS
from tapegrid.functions import clock, market as mk
from tapegrid.operators import evaluate as ev, features as fe, grid as gr, physics as ph, targets as tg, windows as wi
from tapegrid.operators.windows import SESSION, by_bar, by_day, so_far
from tapegrid.plans import assembly as asm, fixtures as fx

KEY = "symbol:s session_date:d bar:i "
KEYS = [*SESSION, "bar"]


@query("win01_lag_diff", KEY + "d1:4 d5:4 d10:4 prev:4", q(f"""select *, spot - lag(spot, 1) over {SW} as d1, spot - lag(spot, 5) over {SW} as d5,
       spot - lag(spot, 10) over {SW} as d10, lag(spot) over {SW} as prev from grid"""))
def _(spark, d):
    return grid(spark, d).withColumns({**{f"d{k}": wi.diff("spot", k) for k in (1, 5, 10)}, "prev": F.lag("spot").over(by_bar())})


@query("win02_rolling_stats", KEY + "s5:4 m15:6 sd30:6 med9:4", q(f"""select *, {rs('spot', 5, 'sum')} as s5, {rs('spot', 15, 'avg', 5)} as m15,
       {rs('spot', 30, 'stddev_samp', 5)} as sd30, {rs('spot', 9, 'median', 3)} as med9 from grid"""))
def _(spark, d):
    return grid(spark, d).withColumns({"s5": wi.roll("spot", 5, "sum"), "m15": wi.roll("spot", 15, "mean", min_rows=5),
                                       "sd30": wi.roll("spot", 30, "std", min_rows=5), "med9": wi.roll("spot", 9, "median", min_rows=3)})


@query("win03_rolling_z", KEY + "z:5", q(f"select *, {zscore('spot')} as z from grid"))
def _(spark, d):
    return grid(spark, d).withColumn("z", wi.rolling_z("spot", 60, 20))


@query("win04_second_difference", KEY + "acc:4", q(f"select *, spot - 2 * lag(spot, 1) over {SW} + lag(spot, 2) over {SW} as acc from grid"))
def _(spark, d):
    return grid(spark, d).withColumn("acc", wi.second_diff("spot"))


@query("win06_running_range", KEY + "hi:4 lo:4 rng:4", q(f"select *, max(spot) over {SW} as hi, min(spot) over {SW} as lo, max(spot) over {SW} - min(spot) over {SW} as rng from grid"))
def _(spark, d):
    run = so_far(by_bar())
    return grid(spark, d).withColumns({"hi": F.max("spot").over(run), "lo": F.min("spot").over(run)}).withColumn("rng", F.col("hi") - F.col("lo"))


@query("win07_expanding_mean", KEY + "ratio:6", q(f"select *, volume / nullif(avg(volume) over {SW}, 0) as ratio from bars"))
def _(spark, d):
    b = gr.ticks_to_bars(fx.ticks(spark, d), CFG)
    m = F.avg("volume").over(so_far(by_bar()))
    return b.withColumn("ratio", F.when(m != 0, F.col("volume") / m))


@query("win08_partition_ends", KEY + "first_spot:4 last_spot:4", q("""select *, first_value(spot ignore nulls) over w as first_spot, last_value(spot ignore nulls) over w as last_spot from grid
       window w as (partition by symbol, session_date order by bar rows between unbounded preceding and unbounded following)"""))
def _(spark, d):
    return grid(spark, d).withColumns({"first_spot": wi.first_value("spot"), "last_spot": wi.last_value("spot")})


@query("win11_lead_targets", KEY + " ".join(f"y_{h}:4" for h, _ in LONG_HORIZONS),
       q("select *, " + ", ".join(f"lead(spot, {m // 5}) over {SW} as y_{h}" if m else
         f"last_value(spot) over (partition by symbol, session_date order by bar rows between unbounded preceding and unbounded following) as y_{h}" for h, m in LONG_HORIZONS) + " from grid"))
def _(spark, d):
    t = tg.horizon_targets(price_grid(spark, d), CFG, LONG_HORIZONS)
    return t.withColumnsRenamed({f"y_price_{h}": f"y_{h}" for h, _ in LONG_HORIZONS})


@query("win13_prior_volume", "symbol:s session_date:d prior:0", q("""select symbol, session_date, lag(v) over (partition by symbol order by session_date) as prior from
       (select symbol, session_date, sum(volume) as v from bars group by 1, 2)"""))
def _(spark, d):
    t = gr.ticks_to_bars(fx.ticks(spark, d), CFG).groupBy(*SESSION).agg(F.sum("volume").alias("v"))
    return t.withColumn("prior", F.lag("v").over(by_day()))


@query("win18_sliding_rows", KEY + "n:i first_v:4 last_v:4", q(f"""select *, 20 as n, lag(coalesce(spot, 0), 19) over {SW} as first_v, coalesce(spot, 0) as last_v from grid
       qualify row_number() over {SW} >= 20"""))
def _(spark, d):
    from tapegrid.operators.sequences import windows
    x = F.col("x_seq")
    return windows(grid(spark, d), ["spot"], 20).select(*KEYS, F.size(x).alias("n"), F.round(x[0][0].cast("double"), 2).alias("first_v"),
                                                       F.round(x[19][0].cast("double"), 2).alias("last_v"))


@query("agg10_keep_last", "symbol:s strike:1 seq:i premium:4", q("select symbol, strike, max(seq) as seq, arg_max(premium, seq) as premium from prints group by 1, 2"))
def _(spark, d):
    return gr.keep_last(fx.prints(spark, d).select("symbol", "strike", "seq", "premium"), ["symbol", "strike"])


@query("jn03_grid_flow", KEY + "blk:4 all_prem:4", q("""select g.symbol, g.session_date, g.bar, coalesce(blk, 0) as blk, coalesce(all_prem, 0) as all_prem from grid g
       left join flow f on g.symbol = f.symbol and g.session_date = f.session_date and g.bar = f.bar"""))
def _(spark, d):
    return gr.onto_grid(grid(spark, d), fe.bar_flow(fx.prints(spark, d), CFG), fe.FLOW_COLS)


@query("jn04_daily_dimension", KEY + "pct:6", q("""select g.symbol, g.session_date, g.bar, g.spot / h.hist_prior_close - 1 as pct from grid g
       left join hist h on g.symbol = h.symbol and g.session_date = h.session_date"""))
def _(spark, d):
    g = grid(spark, d)
    h = fe.prior_session_table(fe.daily_table(g))
    return g.join(h, list(SESSION), "left").withColumn("pct", F.col("spot") / F.col("hist_prior_close") - 1)


@query("tk01_ordered_rows", "pos:i symbol:s session_date:d seq:i strike:1",
       q("select row_number() over (partition by symbol, session_date order by ts, strike, seq) as pos, symbol, session_date, seq, strike from ladder"))
def _(spark, d):
    """Position in (ts, strike, seq) order of each session: counts per minute give the offset, a rank inside the minute the rest."""
    from pyspark.sql import Window
    lad = fx.ladder(spark, d).withColumn("m", clock.minute_of_day(F.col("ts"), CFG.tz))
    per = lad.groupBy(*SESSION, "m").agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy(*SESSION).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select(*SESSION, "m", F.coalesce(F.sum("c").over(run), F.lit(0)).alias("off"))
    local = F.row_number().over(Window.partitionBy(*SESSION, "m").orderBy("ts", "strike", "seq"))
    return lad.withColumn("r", local).join(offs, [*SESSION, "m"]).withColumn("pos", F.col("r") + F.col("off"))


@query("tk03_top_clusters", KEY + "rank:i abs_gex_sum:4 peak_strike:1", q("""select *, row_number() over (partition by symbol, session_date, bar order by abs_gex_sum desc, cluster_id) as rank
       from clus qualify rank <= 5"""))
def _(spark, d):
    return ph.clusters(state(spark, d), ph.PhysicsConfig(merge_points=5.0))


@query("tk06_tail_rows", "symbol:s session_date:d bar:i spot:4", q("select * from grid qualify row_number() over (partition by symbol, session_date order by bar desc) <= 3"))
def _(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy(*SESSION).orderBy(F.desc("bar"))
    return grid(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 3")


@query("set01_row_union", "kind:s n:i premium:3 gex:3", q("""select 'print' as kind, count(*) as n, sum(premium) as premium, null as gex from prints
       union all select 'ladder', count(*), null, sum(gex) from ladder"""))
def _(spark, d):
    p = fx.prints(spark, d).select(F.lit("print").alias("kind"), "seq", "premium")
    u = p.unionByName(fx.ladder(spark, d).select(F.lit("ladder").alias("kind"), "seq", "gex"), allowMissingColumns=True)
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("premium").alias("premium"), F.sum("gex").alias("gex"))


@query("set02_aligned_blocks", KEY + "ret_1m:8 inst_block_weight:6", q("""select p.symbol, p.session_date, p.bar, p.ret_1m, f.inst_block_weight from price p
       join flow3 f on p.symbol = f.symbol and p.session_date = f.session_date and p.bar = f.bar"""))
def _(spark, d):
    g = grid(spark, d)
    return fe.block_sweep(fe.price_context(g, CFG), fe.bar_flow(fx.prints(spark, d), CFG))


@query("set03_time_union", "symbol:s bar:i", q("select symbol, bar from rth union select symbol, bar from grid"))
def _(spark, d):
    t = fx.ticks(spark, d)
    return gr.ticks_to_bars(t, CFG).select("symbol", "bar").union(gr.session_grid(t, CFG).select("symbol", "bar")).distinct()


@query("fn_seismic_scale", "trial:i m:1 back:6", q("""select trial, case when screen_score is not null then round_even(least(10, 10 * (1 - pow(2, -greatest(screen_score / 0.2, 0)))), 1) end as m,
       -log2(1 - least(round_even(least(10, 10 * (1 - pow(2, -greatest(screen_score / 0.2, 0)))), 1), 9.99) / 10) * 0.2 as back from board"""))
def _(spark, d):
    b = fx.board(spark, d).withColumn("m", mk.magnitude(F.col("screen_score"), F.lit(0.2)))
    return b.withColumn("back", mk.magnitude_to_move(F.col("m"), F.lit(0.2)))


@query("fn_time_ramp", KEY + "ramp:8", q("select *, 1 / (1 + exp(greatest(-60, least(60, (390 - bar - 30) / 8.0)))) as ramp from grid"))
def _(spark, d):
    return grid(spark, d).withColumn("ramp", mk.time_ramp(F.col("minutes_to_close"), 30.0, 8.0))


@query("fn_grid_rounding", "seq:i half:1 cent:2", q("select seq, round_even(c / 0.5, 0) * 0.5 as half, round_even(c / 0.01, 0) * 0.01 as cent from optbars where type = 'C'"))
def _(spark, d):
    return fx.option_bars(spark, d).filter("type = 'C'").select("seq", mk.to_grid(F.col("c"), 0.5).alias("half"), mk.to_grid(F.col("c"), 0.01).alias("cent"))


@query("fn_business_days", "month:s n:i", q("""select strftime(x, '%Y-%m') as month, count(*) as n from (select unnest(generate_series(lo, hi, interval 1 day)) as x from
       (select min(session_date)::timestamp as lo, max(session_date)::timestamp as hi from daily)) where isodow(x) <= 5 group by 1"""))
def _(spark, d):
    r = fx.daily(spark, d).agg(F.min("session_date").alias("lo"), F.max("session_date").alias("hi"))
    days = r.select(F.explode(clock.weekdays_between(F.col("lo"), F.col("hi"))).alias("x"))
    return days.groupBy(F.date_format("x", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("udf02_extra_block", KEY + "spot_sq:4", q("select *, spot * spot as spot_sq from grid"))
def _(spark, d):
    fe.register_block("square", lambda df: df.withColumn("spot_sq", F.col("spot") * F.col("spot")))
    try:
        return fe.apply_blocks(grid(spark, d))
    finally:
        fe._BLOCKS.pop("square")


@query("udf03_custom_horizons", KEY + "y_retn_20m:6", q(f"select *, (ln(lead(spot, 4) over {SW}) - ln(spot)) / nullif(rv_1m * sqrt(20.0), 0) as y_retn_20m from price"))
def _(spark, d):
    return tg.horizon_targets(price_grid(spark, d), CFG, (("20m", 20),))


@query("udf04_custom_metric", "horizon:s bias:6", q("select horizon, avg(p - y) as bias from scored group by 1"))
def _(spark, d):
    ev.register_metric("bias", lambda: F.avg(F.col("p") - F.col("y")))
    return ev.scored_rows(fx.preds(spark, d), CFG.tz).groupBy("horizon").agg(ev.METRICS["bias"]().alias("bias"))


@query("udf07_grouped_pandas", "symbol:s session_date:d swing:4", q("select symbol, session_date, max(spot) - min(spot) as swing from grid group by 1, 2"))
def _(spark, d):
    """Escape hatch for custom session code: one group is one session of bars."""
    def swing(key, pdf):
        import pandas as pd
        return pd.DataFrame([[key[0], key[1], float(pdf["spot"].max() - pdf["spot"].min())]], columns=["symbol", "session_date", "swing"])

    return grid(spark, d).select(*KEYS, "spot").groupBy(*SESSION).applyInPandas(swing, "symbol string, session_date date, swing double")


@query("up04_minimal_projection", KEY + "spot:4", q("select symbol, session_date, bar, max(spot) as spot from lspot group by 1, 2, 3"))
def _(spark, d):
    return spotted(spark, d).select(*KEYS, "spot").distinct()


@query("agg_ladder_switch_causal", KEY + "flow_side_weighted:0", q("""select symbol, session_date, bar, case when sum(k) over w * 1.0 / sum(n) over w > 0.5 then 1 else 0 end as flow_side_weighted from
       (select symbol, session_date, bar, count(*) as n, sum(ok::int) as k from premrows where bar between 0 and 390 group by 1, 2, 3) window w as (partition by symbol, session_date order by bar)"""))
def _(spark, d):
    return fe.feed_switch(fe.strike_premium(fx.ladder(spark, d), CFG), "causal").select(*KEYS, "flow_side_weighted").distinct()


@query("feature_table_lags", KEY + "gex_band_net_d5m:5 otm_skew_level_d10m:6 ret_25m:8",
       q(f"""select p.symbol, p.session_date, p.bar, coalesce(g.gex_band_net - lag(g.gex_band_net, 5) over w, 0) as gex_band_net_d5m,
            coalesce(m.otm_skew_level - lag(m.otm_skew_level, 10) over w, 0) as otm_skew_level_d10m, coalesce(ln(p.spot) - lag(ln(p.spot), 25) over w, 0) as ret_25m
            from price p left join carried g on p.symbol = g.symbol and p.session_date = g.session_date and p.bar = g.bar
            left join prem3 m on p.symbol = m.symbol and p.session_date = m.session_date and p.bar = m.bar
            window w as (partition by p.symbol, p.session_date order by p.bar)"""))
def _(spark, d):
    return asm.build_features(fx.ticks(spark, d), fx.ladder(spark, d), None, CFG, candles=False)


