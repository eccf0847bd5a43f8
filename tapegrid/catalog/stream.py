"""Streaming queries: drained with availableNow, compared with the batch meaning of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

import tapegrid.catalog.io as io_catalog
from tapegrid.catalog.features import CFG
from tapegrid.catalog.registry import query
from tapegrid.catalog.sqlbase import define, q
from tapegrid.plans import fixtures as fx
from tapegrid.plans.session import scratch
from tapegrid.sources import payloads as pl
from tapegrid.streaming import ticks as st


def _feed(spark, rows, parts=5):
    """Rows as a feed: files in time order, ``parts`` micro-batches, then a heartbeat two days later that closes every window and session."""
    path = scratch(spark, "feed")
    lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
    span = (hi - lo) / parts if lo else None
    for k in range(parts):
        own = rows if lo is None or parts == 1 else rows.filter((F.col("ts") >= lo + k * span if k else F.lit(True)) & (F.col("ts") < lo + (k + 1) * span if k < parts - 1 else F.lit(True)))
        own.repartition(2).write.mode("append").parquet(path)
    if lo is not None:
        beat = spark.range(1).select(*[(F.lit(hi) + F.expr("interval 2 days") if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes])
        beat.write.mode("append").parquet(path)
    return st.read_parquet_stream(spark, path, 2)


def _bars(spark, d):
    """Closed bars of the whole feed."""
    return st.run_available(st.bar_price_stream(_feed(spark, fx.ticks(spark, d), 1), CFG), "bars").filter("symbol is not null")


def _derive(spark, sf_dir, view):
    """A fixture view as a stream: the same column expressions over a file stream of the table."""
    static = view(spark, sf_dir)
    path = scratch(spark, "feed")
    static.write.parquet(path)
    return st.read_parquet_stream(spark, path)


define("sflow", """select symbol, time_bucket(interval 5 minute, ts - interval 1 microsecond) + interval 5 minute as ts, sum(blk) as blk, sum(dark) as dark,
    sum(swp) as swp, sum(premium) as all_prem, sum(sblk) as sblk from
    (select *, case when trade_type in ('block', 'dark_pool') then premium else 0 end as blk, case when trade_type = 'dark_pool' then premium else 0 end as dark,
     case when trade_type = 'sweep' then premium else 0 end as swp, case when trade_type in ('block', 'dark_pool') then premium else 0 end
     * case when side in ('ask', 'buy') then 1 when side in ('bid', 'sell') then -1 else 0 end
     * case upper(left(option_type, 1)) when 'C' then 1 when 'P' then -1 else 0 end as sblk from prints) group by 1, 2""")


@query("str08_stream_flow", "symbol:s ts:t blk:4 dark:4 swp:4 all_prem:4 sblk:4", q("select * from sflow"))
def _(spark, d):
    return st.run_available(st.bar_flow_stream(_feed(spark, fx.prints(spark, d), 3), CFG), "flow")


@query("str04_latest_ladder", "symbol:s strike:1 ts:t gex:4 call_oi:0",
       q("""select * from (select symbol, strike, hr as ts, last(gex order by ts, seq) filter (gex is not null) as gex, last(call_oi order by ts, seq) as call_oi
            from (select *, time_bucket(interval 60 minute, ts - interval 1 microsecond) + interval 60 minute as hr from ladder) group by 1, 2, 3)
            qualify count(*) over (partition by symbol, ts) >= 3"""))
def _(spark, d):
    lad = fx.ladder(spark, d).select("symbol", "strike", "ts", "seq", "gex", "call_oi")
    return st.run_available(st.ladder_stream(_feed(spark, lad), 60), "ladder")


@query("str01_stream_messages", "seq:i kind:s strike:1 premium:4 side:s trade_type:s spot:4",
       f"select * from ({io_catalog.TICKS})")
def _(spark, d):
    return st.run_available(pl.normalise_messages(_derive(spark, d, io_catalog.messages)), "messages")


@query("str02_valid_ticks", "kind:s n:i",
       f"select kind, count(*) as n from ({io_catalog.TICKS}) where (kind = 'spot' and spot > 0) or kind = 'chain' or (kind = 'flow' and premium >= 0) group by 1")
def _(spark, d):
    s = st.valid_ticks(pl.normalise_messages(_derive(spark, d, io_catalog.messages)))
    return st.run_available(s, "valid").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("flt08_tick_filter", "kind:s n:i",
       f"select kind, count(*) as n from ({io_catalog.TICKS}) where (kind = 'spot' and spot > 0) or kind = 'chain' or (kind = 'flow' and premium >= 0) group by 1")
def _(spark, d):
    return st.valid_ticks(pl.normalise_messages(io_catalog.messages(spark, d))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


define("sbars", """select *, cast(ts - interval 1 microsecond as date) as session_date from
    (select symbol, time_bucket(interval 5 minute, ts - interval 1 microsecond) + interval 5 minute as ts, arg_max(spot, ticks.ts) as spot from ticks group by 1, 2)""")


@query("str10_session_state", "symbol:s session_date:d ts:t spot:4 running_high:4 running_low:4 total:3 n_bars:i",
       q("""select *, max(spot) over w as running_high, min(spot) over w as running_low, sum(spot) over w as total, count(*) over w as n_bars from sbars
            window w as (partition by symbol, session_date order by ts)"""))
def _(spark, d):
    s = st.run_available(st.session_state_stream(_feed(spark, _bars(spark, d)), CFG), "state")
    return s.withColumn("total", F.col("twap") * F.col("n_bars"))


@query("str03_session_rollover", "symbol:s session_date:d bars:i hi:4 left_over:i",
       q("select symbol, session_date, count(*) as bars, max(spot) as hi, 0 as left_over from sbars group by 1, 2"))
def _(spark, d):
    s, counts = st.drained(st.session_state_stream(_feed(spark, _bars(spark, d), 3), CFG), "state")
    return s.groupBy("symbol", "session_date").agg(F.max("n_bars").alias("bars"), F.max("running_high").alias("hi")).withColumn("left_over", F.lit(counts["state_rows"]))


@query("str06_stale", "symbol:s session_date:d ts:t n_bars:i",
       q("""select g.symbol, g.session_date, g.ts + interval 30 minute as ts, count(b.ts) as n_bars from
            (select symbol, cast(ts - interval 1 microsecond as date) as session_date, ts, lead(ts) over (partition by symbol, cast(ts - interval 1 microsecond as date) order by ts) as nxt from ticks) g
            join sbars b on b.symbol = g.symbol and b.session_date = g.session_date and b.ts < time_bucket(interval 5 minute, g.ts - interval 1 microsecond) + interval 10 minute
            where coalesce(nxt, g.session_date + interval 1 day) - g.ts > interval 30 minute group by 1, 2, 3"""))
def _(spark, d):
    s = st.run_available(st.session_state_stream(_feed(spark, _bars(spark, d)), CFG, "30 minutes"), "state")
    return s.filter("stale")


@query("str05_decision_cycle", "symbol:s session_date:d bar:i rows:i spot:4 high:4 low:4",
       q("""select * from (select symbol, session_date, bar, sum(n_ticks) over w as rows, spot, max(high) over w as high, min(low) over w as low from bars
            window w as (partition by symbol, session_date order by bar)) where rows >= 30"""))
def _(spark, d):
    buffer = st.SessionBuffer(spark, CFG, label="cycle")

    def handler(df, i):
        buffer.put(st.live_decisions(buffer.take(df.filter("symbol is not null"), i), CFG), i)

    st.decision_cycle(_feed(spark, fx.ticks(spark, d)), handler, scratch(spark, "cycle-ckpt"), every=None).awaitTermination()
    return buffer.result("symbol string, session_date date, bar int, rows long, spot double, high double, low double", ("symbol", "session_date", "bar"))


@query("str07_feed_delay", "seq:i ts_feed:t", q("select seq, ts - interval 15 minute as ts_feed from ticks"))
def _(spark, d):
    return st.run_available(st.feed_time(_derive(spark, d, fx.ticks)).select("seq", "ts_feed"), "delayed")


@query("udf05_batch_handler", "kind:s n:i", q("select 'tick' as kind, count(*) as n from ticks"))
def _(spark, d):
    out = scratch(spark, "handler")
    st.decision_cycle(_derive(spark, d, fx.ticks), lambda df, i: df.agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(out),
                      scratch(spark, "handler-ckpt"), every=None).awaitTermination()
    got = spark.read.schema("n bigint").parquet(out)
    return got.agg(F.sum("n").alias("n")).withColumn("kind", F.lit("tick"))
