"""File sources: price CSVs with header discovery, partitioned history, ladder folders, boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapegrid.config import SessionConfig
from tapegrid.functions import clock
from tapegrid.functions.nulls import try_double
from tapegrid.operators.grid import keep_last

# Accepted header spellings, compared in lower case.
ALIASES = {
    "ts": ("ts", "timestamp", "time", "datetime", "date"),
    "close": ("close", "c", "price", "spot", "last"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "volume": ("volume", "vol", "v"),
}

# Columns of the stored ladder and print tables; absent ones are added as NULL.
LADDER_DOUBLES = ("strike", "gex", "vanna", "charm", "call_oi", "put_oi", "call_prem", "put_prem", "call_ask_prem",
                  "call_bid_prem", "put_ask_prem", "put_bid_prem", "call_vol", "put_vol", "volume", "call_iv", "put_iv",
                  "call_gamma", "put_gamma", "call_delta", "put_delta", "call_close", "put_close", "call_cumvol",
                  "put_cumvol", "call_signed_v", "put_signed_v", "call_cum_signed", "put_cum_signed", "gex_signed", "spot")
PRINT_DOUBLES = ("premium", "strike", "size", "underlying_price", "n_trades", "price", "vwap", "iv", "delta", "gamma")


def resolve_header(columns: list[str], substring: bool = False) -> dict[str, str]:
    """Role -> column by alias; with ``substring`` a column containing an alias of 3+ letters is a last resort."""
    lower = {c.strip().lower(): c for c in columns}
    found = {}
    for role, names in ALIASES.items():
        hit = next((lower[n] for n in names if n in lower), None)
        if hit is None and substring:
            hit = next((c for low, c in lower.items() for n in names if len(n) >= 3 and n in low), None)
        if hit is not None:
            found[role] = hit
    return found


def file_position() -> Column:
    """Place of a row in its files: path, start of the block, and the row's number within the task, which rises along a block. Only
    right directly on a scan, before anything moves rows."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_ohlcv(spark: SparkSession, path: str, cfg: SessionConfig, symbol: str = "SPY") -> DataFrame:
    """Price bars with candle columns; missing candle columns are NULL. Regular hours, last row per ts."""
    raw = spark.read.csv(path, header=True)
    h = resolve_header(raw.columns)
    if "ts" not in h or "close" not in h:
        raise ValueError(f"no timestamp or close column in {raw.columns}")
    num = lambda r: try_double(raw[h[r]]) if r in h else F.lit(None).cast("double")
    d = raw.select(F.lit(symbol).alias("symbol"), clock.parse_timestamp(raw[h["ts"]], cfg.tz).alias("ts"), num("close").alias("spot"),
                   num("open").alias("open"), num("high").alias("high"), num("low").alias("low"), num("volume").alias("volume"), file_position().alias("_place"))
    return finalise(d, cfg)


def read_prices(spark: SparkSession, path: str, cfg: SessionConfig, ts_col: str | None = None, px_col: str | None = None,
                symbol: str = "SPY") -> DataFrame:
    """Timestamp and price only, columns named or discovered (substring match allowed)."""
    raw = spark.read.csv(path, header=True)
    h = resolve_header(raw.columns, substring=True)
    ts, px = ts_col or h.get("ts"), px_col or h.get("close")
    if ts is None or px is None:
        raise ValueError(f"no timestamp or price column in {raw.columns}")
    d = raw.select(F.lit(symbol).alias("symbol"), clock.parse_timestamp(raw[ts], cfg.tz).alias("ts"), try_double(raw[px]).alias("spot"), file_position().alias("_place"))
    return finalise(d, cfg)


def finalise(df: DataFrame, cfg: SessionConfig) -> DataFrame:
    """Regular hours, positive price, one row per (symbol, ts): the last by sequence number, else by place in the files (``_place``)."""
    d = df.filter(F.col("ts").isNotNull() & clock.in_session(F.col("ts"), cfg) & (F.col("spot") > 0))
    order = next((c for c in ("seq", "_place") if c in d.columns), "spot")
    return keep_last(d, ["symbol", "ts"], [order]).drop("_place")


def stored_schema(keys: str, doubles: tuple[str, ...], texts: tuple[str, ...] = ()) -> str:
    """DDL of a stored table. Reading with it fills absent columns with NULL and opens no extra footers."""
    return ", ".join([keys, *(f"{c} double" for c in doubles), *(f"{c} string" for c in texts)])


LADDER_SCHEMA = stored_schema("symbol string, session_date date, ts timestamp, seq bigint", LADDER_DOUBLES, ("gex_source",))
PRINT_SCHEMA = stored_schema("symbol string, session_date date, ts timestamp, seq bigint", PRINT_DOUBLES, ("option_type", "side", "trade_type"))
SPOT_SCHEMA = "symbol string, session_date date, ts timestamp, spot double"


def pad(df: DataFrame, doubles: tuple[str, ...], texts: tuple[str, ...] = ()) -> DataFrame:
    """Add absent columns: NULL numbers, text 'unknown' for the gamma source."""
    have = set(df.columns)
    new = {c: F.lit(None).cast("double") for c in doubles if c not in have}
    new.update({c: F.lit("unknown" if c == "gex_source" else None).cast("string") for c in texts if c not in have})
    return df.withColumns(new) if new else df


def read_history(spark: SparkSession, root: str, start: str | None = None, end: str | None = None,
                 max_sessions: int | None = None):
    """(prices, ladder, prints) of a ``session_date=`` layout, pruned to whole partitions before reading.

    The session list comes from partition directories alone. Sessions without a price file take the
    last ladder price per symbol and timestamp: highest strike, then seq. Price files keep all their rows.
    """
    ladder = spark.read.schema(LADDER_SCHEMA).parquet(f"{root}/ladder").withColumn("gex_source", F.coalesce("gex_source", F.lit("unknown")))
    day = F.col("session_date")
    keep: Column = F.lit(True)
    if start:
        keep = keep & (day >= F.lit(start).cast("date"))
    if end:
        keep = keep & (day <= F.lit(end).cast("date"))
    if max_sessions:
        newest = ladder.filter(keep).select("session_date").distinct().orderBy(F.desc("session_date")).limit(max_sessions)
        first = newest.agg(F.min("session_date")).first()[0]      # one date
        if first is not None:
            keep = keep & (day >= F.lit(first))
    lad = ladder.filter(keep)
    prints = spark.read.schema(PRINT_SCHEMA).parquet(f"{root}/prints").filter(keep)
    spot = spark.read.schema(SPOT_SCHEMA).parquet(f"{root}/spot").filter(keep)
    have = spot.select("symbol", "session_date").distinct()
    fallback = (lad.filter(F.col("spot").isNotNull()).join(have, ["symbol", "session_date"], "left_anti")
                .groupBy("symbol", "session_date", "ts").agg(F.max_by("spot", F.struct("strike", "seq", "spot")).alias("spot")))
    return spot.unionByName(fallback), lad, prints


def with_today(history: DataFrame, today: DataFrame) -> DataFrame:
    """History plus today's live snapshots, unless today is folded into history already."""
    done = history.select("session_date").distinct()
    return history.unionByName(today.join(done, "session_date", "left_anti"), allowMissingColumns=True)


def read_ladder_dir(spark: SparkSession, path: str, pattern: str = r"(\d{8}_\d{4})", fmt: str = "yyyyMMdd_HHmm",
                    tz: str = "America/New_York") -> DataFrame:
    """Folder of ladder CSVs, one snapshot per file or folder, the timestamp in its name (the last match in the path). Of rows of one
    snapshot and strike the last by place in the files stays."""
    d = spark.read.option("recursiveFileLookup", "true").csv(path, header=True)
    stamp = F.try_to_timestamp(F.try_element_at(F.regexp_extract_all(F.col("_metadata.file_path"), F.lit(pattern), F.lit(1)), F.lit(-1)), F.lit(fmt))
    d = d.select(*[try_double(c).alias(c.lower()) for c in d.columns], F.to_utc_timestamp(stamp, tz).alias("ts"), file_position().alias("_place"))
    return keep_last(d.filter(F.col("ts").isNotNull() & F.col("strike").isNotNull()), ["ts", "strike"], ["_place"]).drop("_place")


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    """Leaderboard CSVs of several nodes, the node taken from the file or folder name."""
    d = spark.read.csv(path, header=True)
    node = F.regexp_extract(F.col("_metadata.file_path"), r"board_([A-Za-z0-9\-]+)", 1)
    num = {"score", "screen_score", "test_score", "seconds"}
    return d.select(node.alias("node"), *[
        try_double(c).alias(c) if c in num else (F.col(c).try_cast("bigint").alias(c) if c == "trial" else F.col(c)) for c in d.columns if c != "node"])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Vendor names -> contract names; names that are absent are ignored."""
    return df.withColumnsRenamed(mapping)
