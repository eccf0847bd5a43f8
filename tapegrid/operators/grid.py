"""From raw rows to the dense per-session grid.

``ticks -> bars`` is a hash aggregation with a map-side combine: a hot symbol
shrinks to one row per bar inside each task before anything is shuffled. The
as-of semantics survive, because the last print at or before a bar is the last
print of the newest non-empty bar at or before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapegrid.config import SessionConfig
from tapegrid.functions import clock
from tapegrid.functions.nulls import finite, try_double
from tapegrid.operators.windows import SESSION, by_bar


def coerce_frame(df: DataFrame, required: tuple[str, ...], optional: tuple[str, ...] = (),
                 text: tuple[str, ...] = ("symbol", "option_type", "side", "trade_type", "gex_source"),
                 keep: tuple[str, ...] = ("ts", "seq", "session_date")) -> DataFrame:
    """Column contract: required present, optional added as NULL, numerics finite, NULL ts dropped."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    extra = {c: F.lit(None).cast("double") for c in optional if c not in df.columns}
    df = df.withColumns(extra) if extra else df
    cols = [F.col(c) if c in text or c in keep else try_double(c).alias(c) for c in df.columns]
    return df.select(cols).dropna(subset=["ts"])


def with_session(df: DataFrame, cfg: SessionConfig) -> DataFrame:
    return df.withColumn("session_date", clock.local_date(F.col("ts"), cfg.tz))


def regular_hours(df: DataFrame, cfg: SessionConfig, closed: str = "both", price: str | None = "spot") -> DataFrame:
    """Regular session, weekdays, positive price."""
    keep = clock.in_session(F.col("ts"), cfg, closed)
    return df.filter(keep & (F.col(price) > 0) if price else keep)


def keep_last(df: DataFrame, keys: list[str], order: list[str] = ("seq",)) -> DataFrame:
    """One row per key, the one that sorts last. Aggregates, so duplicates combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def ticks_to_bars(ticks: DataFrame, cfg: SessionConfig) -> DataFrame:
    """(symbol, session_date, bar) with the last, first, high, low price and volume of each non-empty bar."""
    t = (regular_hours(ticks, cfg)
         .withColumn("session_date", clock.local_date(F.col("ts"), cfg.tz))
         .withColumn("bar", clock.ceil_bar(F.col("ts"), cfg))
         .withColumn("_at", clock.order_key(F.col("ts"), F.col("seq"))))
    at = F.col("_at")
    aggs = [F.max_by("spot", at).alias("spot"), F.min_by("spot", at).alias("open"),
            F.max("spot").alias("high"), F.min("spot").alias("low"), F.count(F.lit(1)).alias("n_ticks")]
    if "volume" in t.columns:
        aggs.append(F.sum("volume").alias("volume"))
    return t.groupBy(*SESSION, "bar").agg(*aggs)


def fill_grid(bars: DataFrame, cfg: SessionConfig, value: str = "spot") -> DataFrame:
    """Dense grid by stretching each bar to the next one: one window, no join with a spine.

    Bars before the first print keep a NULL value.
    """
    step = cfg.bar_minutes
    w = by_bar()
    spans = bars.select(
        *SESSION, F.col("bar").alias("src_bar"), F.col(value).alias("_v"),
        F.when(F.lag("bar").over(w).isNull(), 0).otherwise(F.col("bar")).alias("_from"),
        (F.coalesce(F.lead("bar").over(w), F.lit(cfg.length + step)) - step).alias("_to"))
    spans = spans.select(*SESSION, "src_bar", "_v", F.explode(F.sequence("_from", "_to", F.lit(step))).alias("bar"))
    seen = F.col("bar") >= F.col("src_bar")
    return spans.select(*SESSION, "bar", F.when(seen, F.col("_v")).alias(value),
                        F.when(seen, F.col("bar") - F.col("src_bar")).alias("age_min"))


def with_clock(grid: DataFrame, cfg: SessionConfig) -> DataFrame:
    frac = F.col("bar") / float(cfg.length)
    turn = F.lit(6.283185307179586) * frac
    return grid.select(
        "*", F.col("bar").cast("double").alias("minutes_since_open"),
        (F.lit(float(cfg.length)) - F.col("bar")).alias("minutes_to_close"), frac.alias("session_frac"),
        F.sin(turn).alias("session_sin"), F.cos(turn).alias("session_cos"),
        F.weekday("session_date").cast("double").alias("dow"))


def session_grid(ticks: DataFrame, cfg: SessionConfig) -> DataFrame:
    """Regular session grid with clock columns and the as-of price."""
    return with_clock(fill_grid(ticks_to_bars(ticks, cfg), cfg), cfg)


def with_bar_timestamp(grid: DataFrame, cfg: SessionConfig) -> DataFrame:
    return grid.withColumn("ts", clock.bar_timestamp(F.col("session_date"), F.col("bar"), cfg))


def onto_grid(grid: DataFrame, feed: DataFrame, zero: tuple[str, ...] = ()) -> DataFrame:
    """Grid left join per-bar feed; columns in ``zero`` read 0 where nothing happened."""
    out = grid.join(feed, [*SESSION, "bar"], "left")
    return out.fillna(0.0, subset=list(zero)) if zero else out


def last_sessions(df: DataFrame, n: int, sessions: DataFrame | None = None) -> DataFrame:
    """Rows of the newest ``n`` session dates.

    The ranked set is the distinct dates, a table bounded by the calendar.
    """
    from pyspark.sql import Window
    days = (sessions or df).select("session_date").distinct()
    ranked = days.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("session_date"))))
    return df.join(ranked.filter(F.col("_r") <= n).select("session_date"), "session_date", "left_semi")


def finite_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in cols})
