"""Train-only scaling parameters as a table, applied as plain column expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tapegrid.functions.nulls import clip, finite
from tapegrid.operators.quantiles import as_one_row, attach_domain, attach_row, exact_quantiles, ranked_value

PARAMS = ("fill", "center", "scale", "has_null", "is_binary")


def null_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, n_rows, null_frac, n_distinct) for all columns; nulls in one pass, distincts in one expand."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s")
    ).select("s.column_name", "s.v")
    # (column, value) pairs combine map-side before the shuffle
    pairs = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("c"))
    return pairs.groupBy("column_name").agg(
        F.sum("c").alias("n_rows"), (F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0)) / F.sum("c")).alias("null_frac"),
        F.count("v").alias("n_distinct"))


def fit_scaler(train: DataFrame, cols: list[str], accuracy: int = 20_000, store=lambda df: df) -> DataFrame:
    """One parameter row per column: fill value, centre, scale, null indicator, binary flag.

    Quantiles are those of the column filled with its median; a zero range scales by one; a column with no
    value at all fills with zero; a column with at most two distinct values is left unscaled. NaN and infinities count as NULL.

    The filled column is never built: its NULLs stand together in the middle of the ordered values, so a rank of it is the median or
    a rank of the values alone, shifted by the NULL count past the middle. One scan counts, one brackets all wanted ranks by
    sketches (a value range a column and rank), one orders the few values inside brackets and counts those between.
    The driver sees one row a scan, with a few numbers a column. Pass ``store`` (for example plans.session.materialise) to
    keep the train rows instead of recomputing the features for each scan.
    """
    train = store(train.select(*[finite(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)]))
    seen = train.agg(F.count(F.lit(1)).alias("rows"), *[
        F.struct(F.min(f"c{i}").alias("lo"), F.max(f"c{i}").alias("hi"), F.count(f"c{i}").alias("n")).alias(f"c{i}") for i in range(len(cols))]).first()
    ranks = [_filled_ranks(seen[f"c{i}"]["n"], seen["rows"]) for i in range(len(cols))]
    probs = [_bracket_probs(wanted, seen[f"c{i}"]["n"], accuracy) for i, wanted in enumerate(ranks)]
    between = [F.sum(((F.col(f"c{i}") > seen[f"c{i}"]["lo"]) & (F.col(f"c{i}") < seen[f"c{i}"]["hi"])).cast("bigint")).alias(f"n{i}") for i in range(len(cols))]
    sketch = train.agg(*between, *[F.percentile_approx(f"c{i}", [min(1.0, max(0.0, p)) for p in ps], accuracy).alias(f"q{i}")
                                   for i, ps in enumerate(probs) if ps]).first()
    entries = []
    for i, ps in enumerate(probs):
        v, inside, gap = F.col(f"c{i}"), F.lit(not ps), F.lit(0)
        for k in range(0, len(ps), 2):
            low = seen[f"c{i}"]["lo"] if ps[k] <= 0 else sketch[f"q{i}"][k]
            high = seen[f"c{i}"]["hi"] if ps[k + 1] >= 1 else sketch[f"q{i}"][k + 1]
            inside, gap = inside | ((v >= low) & (v <= high)), gap + (v > high).cast("int")
        entries.append(F.struct(F.lit(i).alias("_i"), v.alias("_v"), F.when(inside, v).alias("_in"), gap.alias("_gap")))
    counts = (train.select(F.explode(F.array(*entries)).alias("_s")).select("_s.*").filter("_v IS NOT NULL")
              .groupBy("_i", "_in", "_gap").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_rep")))
    cum = counts.withColumn("_cum", F.sum("_c").over(Window.partitionBy("_i").orderBy("_rep").rowsBetween(Window.unboundedPreceding, 0)))
    params = train.sparkSession.createDataFrame(
        [(i, c, seen[f"c{i}"]["n"] < seen["rows"], not sketch[f"n{i}"], *[x for w in ranks[i] for x in w]) for i, c in enumerate(cols)],
        "_i int, column_name string, has_null boolean, is_binary boolean, " + ", ".join(f"l{k} bigint, h{k} bigint, f{k} double" for k in range(3)))
    picked = cum.join(params, "_i", "right").groupBy("_i", "column_name", "has_null", "is_binary", "f0", "f1", "f2").agg(*[
        ranked_value(F.col("_cum") > F.col(f"{e}{k}")).alias(f"{e}v{k}") for k in range(3) for e in "lh"])
    fill = F.coalesce(F.col("lv0") + F.col("f0") * (F.col("hv0") - F.col("lv0")), F.lit(0.0))
    d = picked.withColumn("fill", fill)
    low, high = (F.coalesce(f"lv{k}", "fill") + F.col(f"f{k}") * (F.coalesce(f"hv{k}", "fill") - F.coalesce(f"lv{k}", "fill")) for k in (1, 2))
    # copies of the median in the middle leave the median where it is
    return d.select("column_name", "fill", F.col("fill").alias("center"), F.when(high - low > 0, high - low).otherwise(1.0).alias("scale"),
                    "has_null", "is_binary")


def _filled_ranks(n: int, rows: int) -> list[tuple[int | None, int | None, float]]:
    """(lower rank, upper rank, weight of the upper) among the ``n`` values for their median and for the filled column's
    5 % and 95 %; a rank that falls on a filled row is None."""
    out: list[tuple[int | None, int | None, float]] = []
    if not n:
        return [(None, None, 0.0)] * 3
    middle = (n + 1) // 2     # values before the filled rows
    for p, size in ((0.5, n), (0.05, rows), (0.95, rows)):
        pos = p * (size - 1)
        low, high = math.floor(pos), math.ceil(pos)
        out.append((*(r if r < middle or size == n else None if r < middle + rows - n else r - (rows - n) for r in (low, high)), pos - low))
    return out


def _bracket_probs(wanted: list[tuple[int | None, int | None, float]], n: int, accuracy: int) -> list[float]:
    """Ends of a bracket for each wanted pair of ranks, padded by three times the sketch's error; none where all values are few."""
    if n <= 2 * accuracy:
        return []
    pad, out = 3.0 / accuracy, []
    for low, high, _ in wanted:
        present = [r / (n - 1) for r in (low, high) if r is not None]
        if present:
            out += [present[0] - pad, present[-1] + pad]
    return out


def transform(df: DataFrame, params: DataFrame, cols: list[str], keys: list[str], bound: float = 8.0,
              indicators: bool = True) -> DataFrame:
    """Fill, centre, scale and clip with fitted parameters; the column set never changes."""
    d = attach_row(df, as_one_row(params, "column_name", cols, list(PARAMS)))
    out = []
    for i, c in enumerate(cols):
        p = F.col("_p")[i]
        x = F.coalesce(finite(F.col(c).cast("double")), p["fill"])
        out.append(F.when(p["is_binary"], x).otherwise(clip((x - p["center"]) / p["scale"], -bound, bound)).alias(c))
    if indicators:
        out += [F.when(F.col("_p")[i]["has_null"], finite(F.col(c).cast("double")).isNull().cast("double")).alias(f"{c}__isna")
                for i, c in enumerate(cols)]
    return d.select(*keys, *out)


def winsorise(df: DataFrame, key: str, domain: list, value: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(key, lo, hi, offset): clip bounds and the median after clipping."""
    b = exact_quantiles(df, [key], value, [low, high], ["lo", "hi"], domain)
    clipped = clip_to(df, b, key, domain, value)
    off = exact_quantiles(clipped, [key], "clipped", [0.5], ["offset"], domain)
    return b.join(off, key)


def clip_to(df: DataFrame, bounds: DataFrame, key: str, domain: list, value: str) -> DataFrame:
    d = attach_domain(df, bounds, key, domain, ["lo", "hi"])
    x = F.col(value)
    return d.withColumn("clipped", F.when(x.isNotNull(), F.greatest("lo", F.least("hi", x)))).drop("lo", "hi")


def mad_params(df: DataFrame, key: str, domain: list, value: str) -> DataFrame:
    """(key, center, scale): median and 1.4826 * MAD; a MAD below 1e-6 scales by one."""
    c = exact_quantiles(df, [key], value, [0.5], ["center"], domain)
    dev = attach_domain(df, c, key, domain, ["center"]).withColumn("_d", F.abs(F.col(value) - F.col("center")))
    m = exact_quantiles(dev, [key], "_d", [0.5], ["_mad"], domain)
    s = F.col("_mad") * 1.4826
    return c.join(m, key).select(key, "center", F.when(s > 1e-6, s).otherwise(1.0).alias("scale"))
