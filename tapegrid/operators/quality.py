"""Coverage, family audit, causality check and data-quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapegrid.functions.market import family
from tapegrid.operators.quantiles import attach_row
from tapegrid.operators.windows import SESSION


def coverage(df: DataFrame, value: str = "spot") -> DataFrame:
    """Rows, sessions, rows per session, non-NULL share and time range per symbol.

    Sessions are counted in two steps so that no task sees all rows of a symbol.
    """
    per = df.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("k"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return per.groupBy("symbol").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("sessions"), (F.sum("n") / F.count(F.lit(1))).alias("rows_per_session"),
        (F.sum("k") / F.sum("n")).alias("non_null"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"))


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, null_frac, std) of every column from one aggregation row."""
    one = df.agg(*[F.struct(F.avg(F.col(c).isNull().cast("double")).alias("null_frac"), F.stddev_samp(c).alias("std")).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.null_frac"), F.col(f"{c}.std"))
                                          for c in cols])).alias("s")).select("s.*")


def family_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns, mean null share, dead columns and status per feature family."""
    p = column_profile(df, cols).withColumn("family", family(F.col("column_name")))
    dead = F.coalesce(F.col("std") == 0, F.lit(True))
    g = p.groupBy("family").agg(F.count(F.lit(1)).alias("n_columns"), F.avg("null_frac").alias("null_frac"),
                                F.sum(dead.cast("bigint")).alias("n_dead"))
    n, k = F.col("n_columns"), F.col("n_dead")
    return g.withColumn("status", F.when(k == n, "dead").when(k > 0, "partly dead").when(F.col("null_frac") > 0.5, "sparse").otherwise("ok"))


def _close(x: Column, y: Column, atol: float, rtol: float) -> Column:
    return x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False))


def causality_violations(full: DataFrame, cut: DataFrame, keys: list[str], cols: list[str],
                         atol: float = 1e-6, rtol: float = 1e-5) -> DataFrame:
    """Keys and columns whose value changes when the future is cut off, and keys that only one frame has
    (column ``_row``, 1 where the row is). No row means causal."""
    a = full.select(*keys, F.struct(*cols).alias("_a"))
    b = cut.select(*keys, F.struct(*cols).alias("_b"))
    d = b.join(a, keys, "full_outer")
    here = [F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0) for c in ("_a", "_b")]
    checks = [F.struct(F.lit("_row").alias("column_name"), here[0].alias("full_value"), here[1].alias("cut_value"), (here[0] == here[1]).alias("same"))]
    for c in cols:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        same = _close(x, y, atol, rtol)
        both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
        checks.append(F.struct(F.lit(c).alias("column_name"), x.cast("double").alias("full_value"), y.cast("double").alias("cut_value"), (same | ~both).alias("same")))
    return d.select(*keys, F.explode(F.filter(F.array(*checks), lambda s: ~s["same"])).alias("v")).select(
        *keys, "v.column_name", "v.full_value", "v.cut_value")


WHOLE = -1


def cut_table(days: DataFrame, cuts: tuple[tuple[float, int], ...]) -> DataFrame:
    """One row holding (cut, session_date, bar) per pair of ``cuts``: the session at that share of the calendar, and a bar of it.

    ``days``: splits.session_dates.
    """
    at = F.array(*[F.struct(F.lit(i).alias("cut"), F.floor((F.col("n_days") - 1) * share).alias("r"), F.lit(bar).alias("bar"))
                   for i, (share, bar) in enumerate(cuts)])
    d = days.withColumn("_c", F.explode(at)).filter(F.col("_c.r") == F.col("ordinal"))
    return d.agg(F.collect_list(F.struct("_c.cut", "session_date", "_c.bar")).alias("_cuts"))


def _before(c: Column, date: Column, bar: Column) -> Column:
    return (date < c["session_date"]) | ((date == c["session_date"]) & (bar <= c["bar"]))


def at_cuts(rows: DataFrame, cuts: DataFrame, date: Column, bar: Column, whole: bool = True) -> DataFrame:
    """A copy of each row for every cut it lies before (column ``cut``) and, with ``whole``, one under WHOLE."""
    no = F.transform(F.filter("_cuts", lambda c: _before(c, date, bar)), lambda c: c["cut"])
    return attach_row(rows, cuts).withColumn("cut", F.explode(F.concat(F.array(F.lit(WHOLE)), no) if whole else no)).drop("_cuts")


def causality_report(frame: DataFrame, cuts: DataFrame, keys: list[str], cols: list[str], atol: float = 1e-6, rtol: float = 1e-5) -> DataFrame:
    """(cut, column_name, n_rows, violations): rows up to each cut whose value differs from the frame of whole feeds.

    ``frame`` holds features of all copies made by ``at_cuts`` (column ``cut``). Column ``_row`` counts keys that only one side
    has. One join on (cut, keys) and one map-side combined aggregation serve all cuts and columns.
    """
    date, bar = F.col("session_date"), F.col("bar")
    packed = [*keys, F.struct(*cols).alias("_a")]
    full = at_cuts(frame.filter(F.col("cut") == WHOLE).select(*packed), cuts, date, bar, whole=False)
    short = attach_row(frame.filter(F.col("cut") != WHOLE), cuts).filter(
        F.exists("_cuts", lambda c: (c["cut"] == F.col("cut")) & _before(c, date, bar))).select("cut", *keys, F.struct(*cols).alias("_b"))
    d = full.join(short, ["cut", *keys], "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    bad = [F.sum((both & ~_close(F.col(f"_a.{c}"), F.col(f"_b.{c}"), atol, rtol)).cast("bigint")).alias(f"_v{i}") for i, c in enumerate(cols)]
    g = d.groupBy("cut").agg(F.count(F.lit(1)).alias("n_rows"), F.sum((~both).cast("bigint")).alias("_m"), *bad)
    named = [F.struct(F.lit("_row").alias("column_name"), F.col("_m").alias("violations"))]
    named += [F.struct(F.lit(c).alias("column_name"), F.col(f"_v{i}").alias("violations")) for i, c in enumerate(cols)]
    return g.select("cut", "n_rows", F.explode(F.array(*named)).alias("v")).select("cut", "v.column_name", "n_rows", "v.violations")


def gate_report(df: DataFrame, split: str, cols: list[str], min_sessions: int = 7, thin_sessions: int = 60,
                min_rows: int = 30, min_features: int = 80) -> DataFrame:
    """PASS / WARN / FAIL rows for session floor, split sizes, feature count and null share."""
    # distinct dates and split sizes come from one pre-aggregate per (date, split)
    per = df.groupBy("session_date", split).agg(F.count(F.lit(1)).alias("n"),
                                                F.sum(sum((F.col(c).isNull().cast("bigint") for c in cols), F.lit(0))).alias("nulls"))
    size = lambda s: F.coalesce(F.sum(F.when(F.col(split) == s, F.col("n"))), F.lit(0))
    one = per.agg(F.countDistinct("session_date").alias("sessions"), F.least(size("train"), size("val"), size("test")).alias("smallest"),
                  (F.sum("nulls") / (F.sum("n") * len(cols))).alias("null_frac"))
    s, m = F.col("sessions"), F.col("smallest")
    checks = [
        F.struct(F.lit("session floor").alias("check_name"), F.when(s < min_sessions, "FAIL").when(s < thin_sessions, "WARN").otherwise("PASS").alias("status"),
                 s.cast("double").alias("value")),
        F.struct(F.lit("smallest split").alias("check_name"), F.when(m < min_rows, "FAIL").otherwise("PASS").alias("status"), m.cast("double").alias("value")),
        F.struct(F.lit("feature count").alias("check_name"), F.lit("WARN" if len(cols) < min_features else "PASS").alias("status"), F.lit(float(len(cols))).alias("value")),
        F.struct(F.lit("null share").alias("check_name"), F.when(F.col("null_frac") > 0.5, "WARN").otherwise("PASS").alias("status"), F.col("null_frac").alias("value")),
    ]
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def source_agreement(primary: DataFrame, secondary: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer merge of two price sources: the first wins, the second fills gaps; ``gap`` where both exist."""
    a = primary.select(*keys, F.col(value).alias("_a"))
    b = secondary.select(*keys, F.col(value).alias("_b"))
    return a.join(b, keys, "full_outer").select(
        *keys, F.coalesce("_a", "_b").alias(value), F.abs(F.col("_a") - F.col("_b")).alias("gap"),
        F.when(F.col("_a").isNotNull(), "primary").otherwise("secondary").alias("source"))


def agreement_report(merged: DataFrame) -> DataFrame:
    from tapegrid.operators.quantiles import exact_quantiles
    q = exact_quantiles(merged, [], "gap", [0.5, 0.99], ["median_gap", "p99_gap"])
    return merged.agg(F.max("gap").alias("max_gap"), F.count("gap").alias("overlap"), F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(q))


