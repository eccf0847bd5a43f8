"""Sliding windows of past rows for sequence models, plus static and known-future inputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from tapegrid.config import SEQUENCE_EXCLUDE, FeatureConfig, SessionConfig
from tapegrid.functions import clock
from tapegrid.operators.windows import by_bar, last_rows

FC = FeatureConfig()
STATIC = ("dow", "hist_prior_ret", "hist_prior_range_pct", "hist_gap_pct")


def sequence_columns(cols: list[str], exclude: str | None = SEQUENCE_EXCLUDE) -> list[str]:
    """Plan-time column pruning: lag columns are redundant inside a window of past rows."""
    return [c for c in cols if not (exclude and re.search(exclude, c))]


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, n, nulls, low, high) of numeric columns: one pass over the rows, then one row a column."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{i}") for i, c in enumerate(cols)
                                                 for k, f in (("c", F.count), ("l", lambda x: F.min(F.col(x).cast("double"))), ("h", lambda x: F.max(F.col(x).cast("double"))))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n"), (F.col("n") - F.col(f"c_{i}")).alias("nulls"), F.col(f"l_{i}").alias("low"), F.col(f"h_{i}").alias("high"))
                     for i, c in enumerate(cols)])
    return one.select(F.inline(rows))


def usable(profile: DataFrame, exclude: str | None = SEQUENCE_EXCLUDE, most_null: float = 0.5) -> DataFrame:
    """A profile with ``kept``: the name is not excluded, at most ``most_null`` of the values are missing, and they are not all the same."""
    named = ~F.col("column_name").rlike(exclude) if exclude else F.lit(True)
    return profile.withColumn("kept", named & F.coalesce((F.col("nulls") <= most_null * F.col("n")) & (F.col("low") < F.col("high")), F.lit(False)))


def choose_columns(df: DataFrame, cols: list[str], exclude: str | None = SEQUENCE_EXCLUDE, most_null: float = 0.5) -> list[str]:
    """Columns that the frame's own profile keeps, in their order: the projection is then pruned at plan time. The driver sees one row a column."""
    held = {r.column_name for r in usable(column_profile(df, cols), exclude, most_null).filter("kept").collect()}
    return [c for c in cols if c in held]


def windows(df: DataFrame, cols: list[str], lookback: int) -> DataFrame:
    """``x_seq``: the last ``lookback`` rows as array<array<float>>, full windows of one session only."""
    row = F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in cols])
    d = df.withColumn("x_seq", F.collect_list(row).over(last_rows(by_bar(), lookback)))
    return d.filter(F.size("x_seq") == lookback)


def known_future(df: DataFrame, cfg: SessionConfig, horizons=FC.horizons) -> DataFrame:
    """``x_known``: per horizon the minutes left then, session fraction, sine and cosine."""
    left = F.lit(float(cfg.length)) - F.col("bar")

    def at(m):
        ahead = F.lit(0.0) if m is None else F.greatest(left - float(m), F.lit(0.0))
        frac = 1.0 - ahead / 390.0
        turn = F.lit(6.283185307179586) * frac
        return F.array(ahead, frac, F.sin(turn), F.cos(turn))

    return df.withColumn("x_known", F.array(*[at(m) for _, m in horizons]))


def static_inputs(df: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    base = [F.coalesce(F.col(c), zero) for c in STATIC]
    d = F.col("session_date")
    flags = [clock.third_friday(d).cast("double"), clock.quad_witching(d).cast("double")]
    return df.withColumn("x_static", F.array(*base, *flags))
