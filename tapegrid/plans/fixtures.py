"""Market-shaped views over the driver tables (see FIXTURES.md, part B).

The views rename and derive columns; they never drop rows. ``FIXTURE`` is their
session: wall-clock UTC, 09:30-16:00, five-minute bars, hourly ladder snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapegrid.config import SessionConfig

FIXTURE = SessionConfig(tz="UTC", bar_minutes=5, snap_minutes=60)

_SYM = "concat('S', cast(user_id % 2 as string)) as symbol"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as seq", _SYM, "cast(ts as timestamp) as ts", "100.0 + value as spot",
        "cast(event_id % 400 as double) as volume")


def prints(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as seq", _SYM, "cast(ts as timestamp) as ts", "value as premium",
        "case when user_id % 4 < 2 then 'call' else 'P' end as option_type",
        "cast(100 + 5 * (event_id % 21) as double) as strike",
        "case event_type when 'click' then 'ask' when 'purchase' then 'buy' when 'error' then 'bid'"
        " when 'signup' then 'sell' else 'mid' end as side",
        "case event_type when 'purchase' then 'block' when 'signup' then 'dark_pool'"
        " when 'click' then 'sweep' else 'regular' end as trade_type",
        "cast((event_id * 37) % 700 as double) as size")


def ladder(spark, sf_dir) -> DataFrame:
    even = "case when user_id % 2 = 0 then {} end as {}"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as seq", _SYM, "cast(ts as timestamp) as ts", "cast(ts as date) as session_date",
        "cast(100 + 5 * (event_id % 21) as double) as strike",
        "case when event_id % 29 = 0 then null else value * case when event_type in"
        " ('click','purchase','view') then 1.0 else -1.0 end end as gex",
        "case when event_id % 17 = 0 then null else value - 50.0 end as vanna",
        "case when event_id % 19 = 0 then null else (50.0 - value) * 0.1 end as charm",
        "cast(event_id % 1000 as double) as call_oi", "cast((event_id * 7) % 1000 as double) as put_oi",
        "value * 100.0 as call_prem", "cast(event_id % 100 as double) * 50.0 as put_prem",
        even.format("value * 60.0", "call_ask_prem"), even.format("value * 40.0", "call_bid_prem"),
        even.format("cast(event_id % 100 as double) * 20.0", "put_ask_prem"),
        even.format("cast(event_id % 100 as double) * 30.0", "put_bid_prem"),
        "cast(event_id % 50 as double) as call_vol", "cast((event_id * 3) % 50 as double) as put_vol")


def option_bars(spark, sf_dir) -> DataFrame:
    """Calls and puts from the same event: two rows per event through one explode, one scan."""
    ev = table(spark, sf_dir, "events").selectExpr(
        "event_id as seq", _SYM, "cast(ts as timestamp) as ts", "cast(ts as date) as session_date",
        "cast(100 + 5 * (event_id % 21) as double) as strike", "event_id", "value",
        "explode(array('C', 'P')) as type")
    return ev.selectExpr(
        "seq", "symbol", "ts", "session_date", "strike", "type",
        "case when type = 'C' then greatest(50.0 - 5 * (event_id % 21), 0.0) + value / 10.0"
        " else greatest(5 * (event_id % 21) - 50.0, 0.0) + value / 12.0 end as c",
        "cast(case when type = 'C' then event_id % 400 else (event_id * 3) % 400 end as double) as v")


def daily(spark, sf_dir) -> DataFrame:
    return (table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("session_date"))
            .agg(F.min_by("o_totalprice", "o_orderkey").alias("open"),
                 F.max_by("o_totalprice", "o_orderkey").alias("close"),
                 F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low")))


def daily_alt(spark, sf_dir) -> DataFrame:
    return (table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("session_date"))
            .agg(F.max("l_extendedprice").alias("close")))


def trades(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_returnflag as horizon", "l_linestatus as reason",
        "cast(l_shipdate as date) as day", "cast(l_quantity as int) as contracts", "l_quantity * 1.4 as costs",
        "l_extendedprice * (l_discount - 0.05) as pnl_net", "l_discount >= 0.05 as hit_target")


def preds(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as seq", "cast(ts as timestamp) as ts", "cast(ts as date) as session_date",
        "case event_id % 3 when 0 then '5m' when 1 then '20m' else 'eod' end as horizon",
        "(value - 50.0) / 50.0 as y", "(cast((event_id * 13) % 101 as double) - 50.0) / 50.0 as lgb",
        "case when event_id % 7 = 0 then null else (cast((event_id * 29) % 97 as double) - 48.0) / 48.0 end as cat",
        "cast(-0.8 as double) as q10", "cast(0.05 as double) as q50", "cast(0.9 as double) as q90")


def board(spark, sf_dir) -> DataFrame:
    """Every order is one trial of the board."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as trial", "o_orderpriority as node",
        "case o_orderstatus when 'O' then 'ok' when 'F' then 'pruned' else 'failed' end as status",
        "case when o_orderstatus = 'O' then o_totalprice / 1000000.0 end as score",
        "o_totalprice / 1000000.0 as screen_score", "cast(o_custkey % 600 as double) as seconds",
        "case when o_custkey % 10 = 0 then 'full_session' else 'eod_pre11' end as scoring_version")
