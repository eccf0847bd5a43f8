"""Leakage-safe chronological splits.

Everything is decided on the table of distinct session dates, which the calendar
bounds (about 250 rows per year), so its global window is cheap and its joins may
broadcast: ``session_dates`` is the only table hinted here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def session_dates(df: DataFrame) -> DataFrame:
    """Distinct dates with 0-based rank and total count."""
    days = df.select("session_date").distinct()
    w = Window.orderBy("session_date")
    return days.select("session_date", (F.row_number().over(w) - 1).alias("ordinal"),
                       F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_days"))


def chrono_split(days: DataFrame, train: float = 0.70, val: float = 0.15, embargo: int = 1) -> DataFrame:
    """train / val / test / embargo label per date. An empty test block takes the last day; under 3 days all train."""
    n, r = F.col("n_days"), F.col("ordinal")
    tr = F.greatest(F.lit(1), F.floor(n * train))
    va = F.greatest(F.lit(1), F.floor(n * val))
    start_val, start_test = tr + embargo, tr + embargo + va + embargo
    short = start_test >= n
    label = (F.when(n < 3, "train").when(short & (r == n - 1), "test").when(r < tr, "train")
             .when((r >= start_val) & (r < start_val + va), "val").when(r >= start_test, "test").otherwise("embargo"))
    # in the short case the last day may fall inside the train block as well; test wins for it
    return days.select("session_date", label.alias("split"))


def with_split(df: DataFrame, split: DataFrame) -> DataFrame:
    return df.join(F.broadcast(split), "session_date", "left")


def rolling_folds(days: DataFrame, folds: int = 3, embargo: int = 1, min_train: int = 3) -> DataFrame:
    """(fold, role, session_date) of expanding-window validation; empty when history is too short."""
    n, r = F.col("n_days"), F.col("ordinal")
    v = F.greatest(F.lit(1), F.floor(n / (folds + 2)))
    d = days.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(folds)])))
    vs = n - (folds - F.col("fold")) * v
    te = vs - embargo
    role = F.when(r < te, "train").when((r >= vs) & (r < vs + v), "val")
    return d.filter(te >= min_train).select("fold", role.alias("role"), "session_date").filter("role is not null")


def holdout(days: DataFrame, frac: float = 0.2, embargo: int = 1) -> DataFrame:
    """Last ``frac`` of sessions as val after an embargo; empty when it leaves no train session."""
    n, r = F.col("n_days"), F.col("ordinal")
    nv = F.greatest(F.lit(1), F.bround(n * frac).cast("bigint"))
    role = F.when(r < n - nv - embargo, "train").when(r >= n - nv, "val")
    return days.filter(n - nv - embargo >= 1).select("session_date", role.alias("role")).filter("role is not null")


def newest_share(days: DataFrame, frac: float, least: int = 3) -> DataFrame:
    """The newest max(least, frac) sessions: screens and test days."""
    keep = F.greatest(F.lit(least), F.floor(F.col("n_days") * frac))
    return days.filter(F.col("ordinal") >= F.col("n_days") - keep).select("session_date")


def row_split(df: DataFrame, order: list[str], val: float = 0.2, embargo_rows: int = 30) -> DataFrame:
    """Fallback for thin history: first rows train, last rows val, a row embargo between.

    Global row numbers come from per-(session, bar) counts carried over the time axis plus a local
    row number, so no task sees all rows.
    """
    group = ["session_date", "bar"]
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy(*group)
    offs = sizes.select(*group, (F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_off"),
                        F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    d = df.join(offs, group).withColumn(
        "_r", F.col("_off") + F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    cut = F.col("_n") - F.greatest(F.lit(1), F.floor(F.col("_n") * val))
    role = (F.when(F.col("_r") < F.greatest(F.lit(1), cut - embargo_rows), "train")
            .when(F.col("_r") >= cut, "val").otherwise("embargo"))
    return d.withColumn("role", role).drop("_r", "_off", "_n")


def decay_weight(days: DataFrame, halflife: float) -> DataFrame:
    """0.5 ** (age in sessions / halflife); a halflife of 0 switches decay off."""
    age = F.col("n_days") - 1 - F.col("ordinal")
    w: Column = F.lit(1.0) if not halflife or halflife <= 0 else F.pow(F.lit(0.5), age / float(halflife))
    return days.select("session_date", "ordinal", age.alias("age"), w.alias("weight"))
