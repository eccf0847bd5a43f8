"""Exact quantiles of groups too large for one task.

Spark's ``percentile`` merges a histogram of every distinct value of a group in one
reducer. Here a sketch first brackets each wanted rank, rows below a bracket are
only counted (map-side), and just the few rows inside a bracket are ordered.
Results equal linear interpolation on the full data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str],
                    domain: list | None = None, accuracy: int = 20_000, store=lambda d: d) -> DataFrame:
    """keys + one column per prob. Non-NULL values only; linear interpolation.

    ``domain`` lists every value a single key column can take (horizons, column names: fixed by
    configuration). The brackets of a domain travel as one row of that many entries, so the data
    is never shuffled by so coarse a key. A value outside the domain is an error; rows without a key are left out.

    The sketch is off by at most n / accuracy ranks and brackets are padded by three times that.
    Below 2 * accuracy rows the pad could miss a neighbouring rank, so everything (a bounded number
    of values) is inside. One task orders about 6 * n / accuracy values per prob.

    ``store`` (for example plans.session.materialise) keeps the bracket table of a keyed call, so that
    the optimizer knows its real size: small enough it is broadcast and the rows stay where they are.
    """
    pad = 3.0 / accuracy
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    by = keys
    if domain is not None:
        base = base.select(domain_slot(keys[0], domain).alias("_k"), "_v").filter(F.col("_k").isNotNull())
        by = ["_k"]
    sketch = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", [max(0.0, p - pad) for p in probs] + [min(1.0, p + pad) for p in probs], accuracy).alias("_at"))
    few = F.col("_n") <= 2 * accuracy
    bounds = []
    for i, p in enumerate(probs):
        bounds.append(F.when(few | F.lit(p <= pad), F.col("_min")).otherwise(F.col("_at")[i]).alias(f"lo{i}"))
        bounds.append(F.when(few | F.lit(p >= 1.0 - pad), F.col("_max")).otherwise(F.col("_at")[len(probs) + i]).alias(f"hi{i}"))
    brackets = sketch.select(*by, F.struct("_n", *bounds).alias("_q"))
    if domain is not None:
        found = F.map_from_entries(F.collect_list(F.struct("_k", "_q")))
        slots = F.transform(F.sequence(F.lit(0), F.lit(len(domain) - 1)), lambda i: F.try_element_at(F.col("_all"), i))
        one = brackets.agg(found.alias("_all")).select(slots.alias("_slots"))
        near = base.crossJoin(F.broadcast(one)).select("_k", "_v", F.col("_slots")[F.col("_k")].alias("_q"))
    elif by:
        # left to the optimizer: broadcast only below its size threshold, skewed keys are split by AQE
        near = base.join(store(brackets), by)
    else:
        near = base.crossJoin(F.broadcast(brackets))
    v, qc = F.col("_v"), lambda f: F.col(f"_q.{f}")
    inside, passed = F.lit(False), F.lit(0)
    for i in range(len(probs)):
        inside = inside | ((v >= qc(f"lo{i}")) & (v <= qc(f"hi{i}")))
        passed = passed + (v > qc(f"hi{i}")).cast("int")
    # values outside every bracket collapse to one count per gap; their smallest value keeps them in order
    counts = (near.select(*by, "_v", qc("_n").alias("_n"), F.when(inside, v).alias("_in"), passed.alias("_gap"))
              .groupBy(*by, "_n", "_in", "_gap").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_rep")))
    w = Window.partitionBy(*by).orderBy("_rep").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("_cum", F.sum("_c").over(w))
    out = []
    for p, name in zip(probs, names):
        pos = F.lit(p) * (F.col("_n") - 1)
        low, high = (ranked_value(F.col("_cum") > f(pos)) for f in (F.floor, F.ceil))
        out.append((low + F.max(pos - F.floor(pos)) * (F.coalesce(high, low) - low)).alias(name))
    wide = cum.groupBy(*by).agg(*out)
    if domain is None:
        return wide
    return wide.select(F.array(*[F.lit(k) for k in domain])[F.col("_k")].alias(keys[0]), *names)


def ranked_value(reached: Column) -> Column:
    """First value that reaches a rank; an error if it stands for values outside the brackets."""
    first = F.min(F.when(reached, F.struct("_rep", F.col("_in").isNull().alias("_out"))))
    return F.when(first["_out"], F.raise_error(F.lit("a bracket missed its rank: raise accuracy")).cast("double")).otherwise(first["_rep"])


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Cross join with a table that is one row by construction (a keyless aggregate)."""
    return df.crossJoin(F.broadcast(one))


def as_one_row(params: DataFrame, key: str, domain: list, values: list[str], name: str = "_p") -> DataFrame:
    """Parameter table keyed by a configured domain -> one row holding an array in domain order."""
    found = F.map_from_entries(F.collect_list(F.struct(F.col(key), F.struct(*values))))
    return params.agg(found.alias("_m")).select(
        F.array(*[F.try_element_at(F.col("_m"), F.lit(k)) for k in domain]).alias(name))


def domain_slot(key: str, domain: list) -> Column:
    pos = F.create_map(*[F.lit(x) for i, k in enumerate(domain) for x in (k, i)])
    unlisted = F.raise_error(F.concat(F.lit(f"{key} has a value outside its domain: "), F.col(key).cast("string"))).cast("int")
    return F.when(F.col(key).isNotNull(), F.coalesce(F.try_element_at(pos, F.col(key)), unlisted))


def attach_domain(df: DataFrame, params: DataFrame, key: str, domain: list, values: list[str]) -> DataFrame:
    """Add parameter columns by a configured key without shuffling ``df``."""
    one = as_one_row(params, key, domain, values)
    d = attach_row(df, one).withColumn("_e", F.col("_p")[domain_slot(key, domain)])
    return d.withColumns({v: F.col(f"_e.{v}") for v in values}).drop("_p", "_e")
