"""Queries over sources and sinks: rows go out to scratch files or JSON text and come back parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

import tapegrid.catalog.scores  # noqa: F401  (defines SQL blocks used here)
from tapegrid.catalog.features import CFG
from tapegrid.catalog.registry import query
from tapegrid.catalog.sqlbase import define, q
from tapegrid.config import SessionConfig
from tapegrid.functions import clock
from tapegrid.operators import grid as gr, quality as qa
from tapegrid.plans import fixtures as fx
from tapegrid.plans.session import scratch
from tapegrid.sources import files as fs, payloads as pl, sinks as sk

NY = SessionConfig(tz="America/New_York", bar_minutes=5, snap_minutes=60)


def _csv(df, spark, label):
    path = scratch(spark, label)
    df.write.option("header", True).csv(path)
    return path


def _corrected(ticks):
    """Every row twice, the first time with a wrong, higher price, in the order of seq: of rows with one ts the last of the file is the one to keep."""
    twice = ticks.withColumn("late", F.explode(F.array(F.lit(0), F.lit(1))))
    return twice.withColumn("spot", F.when(F.col("late") == 1, F.col("spot")).otherwise(F.col("spot") + 7)).orderBy("seq", "late", "spot", "volume")


define("corrected", """select ts, seq, late, spot + wrong as spot, volume from ticks, (values (0, 7.0), (1, 0.0)) as twice(late, wrong)
    where us between 34200000000 and 57600000000 and isodow(ts) <= 5 and spot + wrong > 0""")
define("last_of_file", """select ts, spot, volume from
    (select *, row_number() over (partition by ts order by seq desc, late desc, spot desc, volume desc) as place from corrected) where place = 1""")


@query("src01_ohlcv_csv", "ts:t spot:4 open:4 high:4 low:4 volume:0",
       q("""select ts, spot, spot - 1 as open, spot + 2 as high, null as low, volume from last_of_file"""))
def _(spark, d):
    t = _corrected(fx.ticks(spark, d)).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"), F.col("spot").alias("Close"),
                                              (F.col("spot") - 1).alias("O"), (F.col("spot") + 2).alias("High"), F.col("volume").alias("Vol"))
    return fs.read_ohlcv(spark, _csv(t, spark, "ohlcv"), CFG)


@query("src02_price_csv", "ts:t spot:4", q("select ts, spot from last_of_file"))
def _(spark, d):
    t = _corrected(fx.ticks(spark, d)).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("bar_datetime_local"), F.col("spot").alias("last_price_usd"))
    return fs.read_prices(spark, _csv(t, spark, "prices"), CFG)


@query("src03_timestamps", "seq:i instant:t",
       q("""select seq, case when seq % 3 = 2 then null when seq % 3 = 1 then ts - interval 2 hour else
            (ts::timestamp at time zone 'America/New_York') at time zone 'UTC' end as instant from ticks"""))
def _(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    t = fx.ticks(spark, d).select("seq", F.when(F.col("seq") % 3 == 0, stamp).when(F.col("seq") % 3 == 1, F.concat(stamp, F.lit("+02:00")))
                                  .otherwise("not a time").alias("text"))
    return t.select("seq", clock.parse_timestamp(F.col("text"), NY.tz).alias("instant"))


def _history(spark, d):
    """Partitioned ladder, prints and price folders; odd days carry no price folder."""
    root = scratch(spark, "history")
    lad = fx.ladder(spark, d).withColumn("spot", F.col("strike") + 0.5)
    sk.write_sessions(lad.select("symbol", "session_date", "ts", "seq", "strike", "gex", "call_oi", "put_oi", "spot"), f"{root}/ladder")
    sk.write_sessions(gr.with_session(fx.prints(spark, d), CFG), f"{root}/prints")
    t = gr.with_session(fx.ticks(spark, d), CFG).filter(F.dayofmonth("session_date") % 2 == 0)
    sk.write_sessions(t, f"{root}/spot")
    return root


@query("src04_history_prices", "session_date:d n:i total:2",
       q("""select session_date, count(*) as n, sum(s) as total from
            (select session_date, spot as s from ticks where day(session_date) % 2 = 0
             union all select session_date, arg_max(strike + 0.5, strike) as s from ladder where day(session_date) % 2 = 1 group by symbol, session_date, ts)
            where session_date between date '2024-01-05' and date '2024-01-20' group by 1"""))
def _(spark, d):
    spot, _, _ = fs.read_history(spark, _history(spark, d), "2024-01-05", "2024-01-20")
    return spot.groupBy("session_date").agg(F.count(F.lit(1)).alias("n"), F.sum("spot").alias("total"))


@query("src04_history_ladder", "session_date:d n:i oi:0 padded:i source:s",
       q("""select session_date, count(*) as n, sum(call_oi) as oi, count(*) as padded, 'unknown' as source from ladder
            where session_date >= (select min(s) from (select distinct session_date as s from ladder order by s desc limit 7)) group by 1"""))
def _(spark, d):
    _, lad, _ = fs.read_history(spark, _history(spark, d), max_sessions=7)
    return lad.groupBy("session_date").agg(F.count(F.lit(1)).alias("n"), F.sum("call_oi").alias("oi"),
                                           F.count(F.when(F.col("vanna").isNull(), 1)).alias("padded"), F.max("gex_source").alias("source"))


@query("src05_recent_with_today", "session_date:d n:i",
       q("""select session_date, count(*) as n from (select * from ladder where session_date <= date '2024-01-20'
            union all select * from ladder where session_date > date '2024-01-20') group by 1"""))
def _(spark, d):
    lad = fx.ladder(spark, d)
    cut = F.lit("2024-01-20").cast("date")
    live = lad.filter(F.col("session_date") >= cut).drop("vanna")        # the cut day is folded already
    return fs.with_today(lad.filter(F.col("session_date") <= cut), live).groupBy("session_date").agg(F.count(F.lit(1)).alias("n"))


@query("src06_ladder_files", "ts:t strike:1 gex:4 call_oi:0",
       q("""select date_trunc('day', ts) + interval 10 hour as ts, strike, sum(gex) as gex, sum(call_oi) as call_oi from ladder group by 1, 2"""))
def _(spark, d):
    root = scratch(spark, "ladders")
    day = (fx.ladder(spark, d).groupBy("session_date", "strike").agg(F.sum("gex").alias("GEX"), F.sum("call_oi").alias("Call_OI"))
           .withColumn("f", F.concat(F.lit("ladder_"), F.date_format("session_date", "yyyyMMdd"), F.lit("_1000"))))
    # one folder per snapshot, named like the snapshot file
    day.drop("session_date").repartition("f").write.partitionBy("f").option("header", True).csv(root)
    return fs.read_ladder_dir(spark, root, tz="UTC")


def _bars_payload(spark, d):
    t = fx.ticks(spark, d)
    r = F.struct(F.unix_millis("ts").alias("t"), F.col("spot").alias("o"), (F.col("spot") + 1).alias("h"), (F.col("spot") - 1).alias("l"),
                 F.col("spot").alias("c"), F.col("volume").alias("v"), F.col("spot").alias("vw"), F.col("seq").alias("n"))
    # pages of at most 500 rows by row number
    pages = t.groupBy("symbol", F.floor(F.col("seq") / 500).alias("page")).agg(F.collect_list(r).alias("results"))
    return pages.select(F.to_json(F.struct(F.col("symbol").alias("ticker"), "results")).alias("payload"))


@query("src07_aggregate_bars", "ticker:s ts:t o:4 h:4 l:4 c:4 v:0 n:i",
       q("""select symbol as ticker, make_timestamp(epoch_us(ts) // 1000 * 1000) as ts, spot as o, spot + 1 as h, spot - 1 as l, spot as c, volume as v, seq as n from ticks"""))
def _(spark, d):
    return pl.aggregate_bars(_bars_payload(spark, d))


@query("src08_contracts", "ticker:s strike:2 type:s expiry:d",
       """select concat('O:', cast(p_partkey as varchar)) as ticker, p_retailprice as strike, case when p_size % 2 = 0 then 'C' else 'P' end as type,
          date '2024-01-01' + cast(p_size as int) as expiry from part""")
def _(spark, d):
    p = fx.table(spark, d, "part").selectExpr(
        "to_json(struct(array(struct(concat('O:', p_partkey) as ticker, p_retailprice as strike_price, case when p_size % 2 = 0 then 'call' else 'put' end"
        " as contract_type, date_add(date'2024-01-01', p_size) as expiration_date)) as results)) as payload")
    return pl.contract_list(p.unionAll(p))      # every page arrives twice (expired and live listings)


@query("src08_nearest_expiry", "session_date:d n:i expiry:d",
       q("""select s.session_date, count(*) as n, max(e) as expiry from (select distinct cast(ts as date) as session_date from events) s
            join (select date '2024-01-01' + 3 * cast(p_size as int) as e from part) c
            on c.e = (select min(date '2024-01-01' + 3 * cast(p_size as int)) from part where date '2024-01-01' + 3 * cast(p_size as int) >= s.session_date)
            group by 1"""))
def _(spark, d):
    c = fx.table(spark, d, "part").selectExpr("p_partkey as ticker", "date_add(date'2024-01-01', 3 * p_size) as expiry")
    days = gr.with_session(fx.ticks(spark, d), CFG).select("session_date").distinct()
    return pl.nearest_expiry(c, days).groupBy("session_date").agg(F.count(F.lit(1)).alias("n"), F.max("expiry").alias("expiry"))


@query("src09_chain_snapshot", "symbol:s ts:t strike:1 call_oi:0 put_oi:0 call_gamma:7 put_bid:4 spot:4 gex:7 ts_feed:t",
       q("""select symbol, hr as ts, strike, max(call_oi) as call_oi, max(put_oi) as put_oi, max(call_oi) / 1e5 as call_gamma, max(put_oi) / 10 as put_bid,
            150.0 as spot, (max(call_oi) / 1e5 * max(call_oi) - max(put_oi) / 2e5 * max(put_oi)) * 150.0 * 150.0 as gex, hr - interval 15 minute as ts_feed
            from (select *, date_trunc('hour', ts) as hr from ladder) group by 1, 2, 3"""))
def _(spark, d):
    lad = fx.ladder(spark, d).withColumn("hr", F.date_trunc("hour", "ts")).groupBy("symbol", "hr", "strike").agg(
        F.max("call_oi").alias("co"), F.max("put_oi").alias("po"))
    res = lad.selectExpr("symbol", "hr", "stack(2, 'call', co, 1e5D, 'put', po, 2e5D) as (ct, oi, k)", "strike").selectExpr(
        "symbol", "hr as ts", "struct(struct(strike as strike_price, ct as contract_type) as details, struct(0.5D as delta, oi / k as gamma) as greeks,"
        " struct(oi as volume, 1.5D as vwap) as day, oi as open_interest, struct(150.0D as price) as underlying_asset,"
        " struct(oi / 10 as bid) as last_quote) as r")
    pages = res.groupBy("symbol", "ts").agg(F.collect_list("r").alias("results"))
    return pl.chain_snapshot(pages.select("symbol", "ts", F.to_json(F.struct("results")).alias("payload")))


def messages(spark, d):
    """Push messages derived from events; the channel follows the event type."""
    ev = fx.table(spark, d, "events").selectExpr("event_id as seq", "cast(ts as timestamp) as ts", "event_type", "value", "user_id")
    ms, iso = F.unix_millis("ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    strike = (100 + 5 * (F.col("seq") % 21)).cast("double")
    trade = F.to_json(F.struct(iso.alias("executed_at"), F.col("value").alias("premium"), F.lit("call").alias("option_type"), strike.alias("strike"),
                               F.when(F.col("seq") % 2 == 0, F.array(F.lit("Ask_Side"), F.lit("SWEEP"))).otherwise(F.array(F.lit("bid_side"), F.lit("dark"))).alias("tags"),
                               F.col("user_id").alias("volume"), (100 + F.col("value")).alias("underlying_price")))
    row = F.struct(ms.alias("timestamp"), strike.alias("strike"), F.col("value").alias("gex"), F.col("user_id").alias("call_open_interest"))
    gex = F.to_json(F.array(row, row))
    price = F.to_json(F.struct(ms.alias("time"), (100 + F.col("value")).alias("close")))
    e = F.col("event_type")
    return ev.select("seq", F.when(e.isin("click", "purchase"), "option_trades:SPY").when(e == "error", "gex:SPY").when(e == "view", "price:SPY")
                     .otherwise("news").alias("channel"),
                     F.when(e.isin("click", "purchase"), trade).when(e == "error", gex).otherwise(price).alias("payload"))


TICKS = """select event_id as seq, 'flow' as kind, ts, null as spot, 100.0 + 5 * (event_id % 21) as strike, value as premium, 'C' as option_type,
    case when event_id % 2 = 0 then 'ask' else 'bid' end as side, case when event_id % 2 = 0 then 'sweep' else 'dark_pool' end as trade_type,
    cast(user_id as double) as size, null as gex, null as call_oi from events where event_type in ('click', 'purchase')
    union all select event_id, 'spot', ts, 100 + value, null, null, null, null, null, null, null, null from events where event_type in ('click', 'purchase', 'view')
    union all select event_id, 'chain', ts, null, 100.0 + 5 * (event_id % 21), null, null, null, null, null, value, user_id from events cross join (values (1), (2)) as two(k) where event_type = 'error'
    union all select event_id, 'unknown', null, null, null, null, null, null, null, null, null, null from events where event_type = 'signup'"""


@query("src10_push_messages", "seq:i kind:s ts:t spot:4 strike:1 premium:4 option_type:s side:s trade_type:s size:0 gex:4 call_oi:0",
       f"select * replace (make_timestamp(epoch_us(ts) // 1000 * 1000) as ts) from ({TICKS})")
def _(spark, d):
    return pl.normalise_messages(messages(spark, d))


@query("src11_merged_stream", "kind:s seq:i ts:t spot:4 strike:1 premium:4",
       q("""select 'spot' as kind, seq, ts, spot, null as strike, null as premium from ticks
            union all select 'chain', seq, ts, null, strike, null from ladder
            union all select 'flow', seq, ts, null, strike, premium from prints"""))
def _(spark, d):
    return pl.merged_stream(fx.ticks(spark, d), fx.ladder(spark, d), fx.prints(spark, d))


@query("src13_merged_boards", "node:s trials:i best:6",
       q("select replace(node, ' ', '') as node, count(*) as trials, min(score) as best from board group by 1"))
def _(spark, d):
    root = scratch(spark, "boards")
    b = fx.board(spark, d).withColumn("f", F.concat(F.lit("board_"), F.translate("node", " ", ""))).drop("node")
    b.write.partitionBy("f").option("header", True).csv(root)
    got = fs.read_boards(spark, root + "/*")
    return got.groupBy("node").agg(F.count(F.lit(1)).alias("trials"), F.min("score").alias("best"))


@query("src15_two_source_merge", "session_date:d close:2 gap:2 source:s",
       q("""select coalesce(a.session_date, b.session_date) as session_date, coalesce(a.close, b.close) as close, abs(a.close - b.close) as gap,
            case when a.close is not null then 'primary' else 'secondary' end as source from daily a full join daily_alt b on a.session_date = b.session_date"""))
def _(spark, d):
    return qa.source_agreement(fx.daily(spark, d), fx.daily_alt(spark, d), ["session_date"], "close")


@query("src15_agreement", "overlap:i rows:i median_gap:4 p99_gap:4 max_gap:2",
       q("""select count(gap) as overlap, count(*) as rows, median(gap) as median_gap, quantile_cont(gap, 0.99) as p99_gap, max(gap) as max_gap from
            (select abs(a.close - b.close) as gap from daily a full join daily_alt b on a.session_date = b.session_date)"""))
def _(spark, d):
    return qa.agreement_report(qa.source_agreement(fx.daily(spark, d), fx.daily_alt(spark, d), ["session_date"], "close"))


@query("jn09_outer_sources", "session_date:d a:2 b:2",
       q("select coalesce(a.session_date, b.session_date) as session_date, a.close as a, b.close as b from daily a full join daily_alt b on a.session_date = b.session_date"))
def _(spark, d):
    a = fx.daily(spark, d).select("session_date", F.col("close").alias("a"))
    return a.join(fx.daily_alt(spark, d).select("session_date", F.col("close").alias("b")), "session_date", "full_outer")


@query("snk01_session_overwrite", "session_date:d n:i total:2",
       q("""select session_date, count(*) as n, sum(case when session_date = date '2024-01-15' then -value else value end) as total
            from (select *, cast(ts as date) as session_date from events) group by 1"""))
def _(spark, d):
    path = scratch(spark, "sessions")
    p = gr.with_session(fx.prints(spark, d), CFG)
    sk.write_sessions(p, path)
    sk.write_sessions(p.filter("session_date = date'2024-01-15'").withColumn("premium", -F.col("premium")), path)
    return spark.read.parquet(path).groupBy("session_date").agg(F.count(F.lit(1)).alias("n"), F.sum("premium").alias("total"))


@query("snk02_csv_cache", "side:s n:i premium:2",
       q("select case side when 'buy' then 'ask' when 'sell' then 'bid' else side end as side, count(*) as n, sum(premium) as premium from prints group by 1"))
def _(spark, d):
    path = scratch(spark, "cache")
    sk.write_csv_cache(gr.with_session(fx.prints(spark, d), CFG).select("session_date", "seq", "side", "premium"), path)
    got = sk.read_csv_cache(spark, path, "seq bigint, side string, premium double, session_date date")
    return got.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("premium").alias("premium"))


@query("snk03_pending_sessions", "session_date:d",
       q("""select distinct session_date from ticks where session_date not in (select session_date from daily_done)""".replace(
           "(select session_date from daily_done)", "(select distinct cast(ts as date) from events where day(ts) <= 20 and day(ts) <> 13)")))
def _(spark, d):
    t = gr.with_session(fx.ticks(spark, d), CFG)
    ladder_done = t.filter(F.dayofmonth("session_date") <= 20)
    prints_done = t.filter(F.dayofmonth("session_date") != 13)
    return sk.pending_sessions(t.select("session_date").distinct(), [ladder_done, prints_done])


@query("snk04_append_log", "horizon:s n:i y:3", q("select horizon, 2 * count(*) as n, 2 * sum(y) as y from preds group by 1"))
def _(spark, d):
    path = scratch(spark, "log")
    p = fx.preds(spark, d).select("seq", "horizon", "y")
    sk.append_log(p, path)
    sk.append_log(p, path)
    return spark.read.option("header", True).schema("seq bigint, horizon string, y double").csv(path).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))


@query("snk05_json_log", "day:d trades:i pnl:3", q("select day, trades, pnl from dpnl"))
def _(spark, d):
    from tapegrid.operators.evaluate import daily_pnl
    path = scratch(spark, "jsonlog")
    sk.append_log(daily_pnl(fx.trades(spark, d)).select("day", "trades", "pnl"), path, "json")
    return spark.read.schema("day date, trades bigint, pnl double").json(path)


@query("snk07_board_table", "node:s trials:i", q("select node, count(*) as trials from board group by 1"))
def _(spark, d):
    path = scratch(spark, "board")
    b = fx.board(spark, d)
    b.filter("trial % 2 = 0").write.mode("append").parquet(path)
    b.filter("trial % 2 = 1").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("node").agg(F.count(F.lit(1)).alias("trials"))


@query("agg26_coverage", "symbol:s rows:i sessions:i rows_per_session:4 non_null:4 first_ts:t last_ts:t",
       q("""select symbol, count(*) as rows, count(distinct session_date) as sessions, count(*) * 1.0 / count(distinct session_date) as rows_per_session,
            1.0 as non_null, min(ts) as first_ts, max(ts) as last_ts from rth group by 1"""))
def _(spark, d):
    return qa.coverage(gr.with_session(gr.regular_hours(fx.ticks(spark, d), CFG), CFG))


@query("up05_rename", "contract:s px:4 size:i",
       q("select type as contract, sum(c) as px, count(*) as size from optbars group by 1"))
def _(spark, d):
    b = fs.rename_columns(fx.option_bars(spark, d), {"c": "price", "type": "contract", "absent": "x"})
    return b.groupBy("contract").agg(F.sum("price").alias("px"), F.count(F.lit(1)).alias("size"))


@query("up01_coerce", "seq:i a:4 b:4 absent:2",
       """select event_id as seq, case when event_id % 5 = 0 then null else value end as a, case when event_id % 7 = 0 then null else value end as b,
          null as absent from events""")
def _(spark, d):
    ev = fx.table(spark, d, "events").selectExpr(
        "event_id as seq", "cast(ts as timestamp) as ts", "case when event_id % 5 = 0 then 'n/a' else cast(value as string) end as a",
        "case when event_id % 7 = 0 then double('infinity') else value end as b")
    return gr.coerce_frame(ev, ("ts", "a"), ("absent",))


