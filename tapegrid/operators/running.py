"""Running values over a long ordered sequence without one task seeing all of it.

The order column is cut into blocks. Block totals are small and carry across blocks
in one window; inside a block an ordinary window adds the local part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapegrid.plans.session import materialise

_MERGE = {
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "sum": (F.sum, lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(
        F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))),
}


def running(df: DataFrame, by: list[str], order: str, spec: dict[str, tuple[str, Column]],
            block: int = 4096, inclusive: bool = False) -> DataFrame:
    """Add ``name`` = min / max / sum of the given expression over all earlier rows of the key.

    ``order`` must be an integer column, unique within ``by``. NULL inputs are skipped.
    """
    d = df.withColumns({f"_x_{n}": e for n, (_, e) in spec.items()}).withColumn(
        "_blk", F.floor(F.col(order) / block).cast("bigint"))
    totals = d.groupBy(*by, "_blk").agg(*[_MERGE[k][0](f"_x_{n}").alias(f"_t_{n}") for n, (k, _) in spec.items()])
    prev = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "_blk", *[
        _MERGE[k][0](f"_t_{n}").over(prev).alias(f"_c_{n}") for n, (k, _) in spec.items()])
    inside = (Window.partitionBy(*by, "_blk").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    # the window first: its order serves the join, so a task sorts its rows once
    out = d.withColumns({f"_l_{n}": _MERGE[k][0](f"_x_{n}").over(inside) for n, (k, _) in spec.items()}).join(carried, [*by, "_blk"], "left")
    out = out.withColumns({n: _MERGE[k][1](F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in spec.items()})
    return out.select(*df.columns, *spec)


_BITS, _FIELDS = 15, 4      # counts of a block, packed four to a long


def counts_before(rows: DataFrame, by: list[str], order: str, tests: list[Column], name: str, block: int, tasks: int) -> DataFrame:
    """Add ``name``: for every test, how many earlier rows of the key pass it (an array). As ``running``, for many counts over many rows:
    counts inside a block share longs, and only the finished rows meet the counts of the blocks before. At most 32,767 rows of a
    block may pass a test. ``tasks`` is the number of partitions the rows are spread over.
    """
    place = [(j // _FIELDS, _BITS * (j % _FIELDS)) for j in range(len(tests))]
    longs = range(place[-1][0] + 1)
    word = lambda w: sum((F.when(t, F.lit(1 << at)).otherwise(F.lit(0)).cast("bigint") for t, (v, at) in zip(tests, place) if v == w),
                         F.lit(0).cast("bigint"))
    count = lambda prefix, j: F.shiftright(F.col(f"{prefix}{place[j][0]}"), place[j][1]).bitwiseAND((1 << _BITS) - 1)
    d = rows.withColumn("_blk", F.floor(F.col(order) / block).cast("bigint"))
    totals = d.groupBy(*by, "_blk").agg(*[F.sum(word(w)).alias(f"_t{w}") for w in longs])
    prev = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "_blk", F.array(*[F.coalesce(F.sum(count("_t", j)).over(prev), F.lit(0)) for j in range(len(tests))]).alias("_before"))
    inside = Window.partitionBy(*by, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.repartition(tasks, *by, "_blk").withColumns({f"_w{w}": word(w) for w in longs})
    local = local.withColumns({f"_l{w}": F.coalesce(F.sum(f"_w{w}").over(inside), F.lit(0)) for w in longs})
    out = local.join(carried, [*by, "_blk"], "left")
    return out.select(*rows.columns, F.array(*[F.get("_before", F.lit(j)) + count("_l", j) for j in range(len(tests))]).alias(name))


def dense_order(df: DataFrame, by: list[str], cols: list[str], name: str, store=materialise) -> DataFrame:
    """Add ``name``: the row's place (from 0) within its key in the order of the columns, which must not repeat within a key.

    One range sort over all keys numbers the rows of each partition; only one count per key and partition is added up. ``store``
    must write the table: the numbers depend on how the rows were spread.
    """
    d = store(df.repartitionByRange(*by, *cols).sortWithinPartitions(*by, *cols).withColumn("_m", F.monotonically_increasing_id()))
    d = d.withColumn("_pid", F.shiftright("_m", 33))
    firsts = d.groupBy(*by, "_pid").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    prev = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = firsts.select(*by, "_pid", (F.coalesce(F.sum("_n").over(prev), F.lit(0)) - F.col("_first")).alias("_shift"))
    return d.join(starts, [*by, "_pid"]).withColumn(name, F.col("_m") + F.col("_shift")).drop("_m", "_pid", "_shift")


def running_percentile(df: DataFrame, by: list[str], order: str, value: str, prob: float, name: str, block: int = 4096, parts: int = 16,
                       least: int = 0, rows_per_task: int = 500_000, store=materialise) -> DataFrame:
    """Exact percentile of ``value`` over all earlier rows of the key (linear interpolation); NULL where there is no value or fewer
    than ``least`` earlier rows.

    All rows search at the same time. The distinct values of a key are numbered; each row asks for the one or two
    values at its wanted rank, and every round narrows all questions to one of ``parts`` ranges of numbers: running counts
    over the values of the current range, taken block by block (``counts_before``), say which. A round reads at most two
    questions a row and one entry a value, also for a node that owns all rows, and log(values) / log(parts) rounds end the
    search. Entries that no question of their range comes after are left out of a round. Rounds are spread over tasks of about
    ``rows_per_task`` rows. ``order`` is an integer, unique within ``by``; keys are not NULL. ``block`` is at most 32,767. ``store``
    keeps each round's questions.
    """
    if block >= 1 << _BITS:
        raise ValueError(f"block {block} is not below {1 << _BITS}")
    d = df.select(*by, F.col(order).cast("bigint").alias("_o"), F.col(value).cast("double").alias("_v"))
    values = store(dense_order(d.filter("_v IS NOT NULL").select(*by, "_v").distinct(), by, ["_v"], "_r", store))
    top = values.agg(F.max("_r")).first()[0]
    if top is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    rounds = 1
    while parts ** rounds <= top:
        rounds += 1
    ranked = store(d.join(values, [*by, "_v"], "left").select(*by, "_o", "_r"))
    n, cores = ranked.count(), df.sparkSession.sparkContext.defaultParallelism
    tasks = lambda rows: max(cores, -(-rows // rows_per_task))

    def below(level: int) -> list[Column]:
        """Whether an entry lies in the first 1, 2, ... parts of its range."""
        child = F.expr(f"(_r div {parts ** (rounds - 1 - level)}) % {parts}")
        return [child <= j for j in range(parts)]

    def narrowed(asked: DataFrame) -> DataFrame:
        j = F.size(F.filter("_upto", lambda c: c <= F.col("_k")))
        return asked.select(*by, "_o", "_slot", "_f", (F.col("_node") * parts + j).alias("_node"),
                            (F.col("_k") - F.when(j > 0, F.get("_upto", j - 1)).otherwise(0)).alias("_k"))

    first = counts_before(ranked, by, "_o", [*below(0), F.lit(True)], "_upto", block, tasks(n)).filter(F.get("_upto", F.lit(parts)) >= least)
    first = first.withColumn("_upto", F.slice("_upto", 1, parts)).withColumn("_pos", F.lit(prob) * (F.get("_upto", F.lit(parts - 1)) - 1)).filter("_pos >= 0")
    low, part = F.floor("_pos").cast("bigint"), F.col("_pos") - F.floor("_pos")
    ask = lambda slot, k: F.struct(F.lit(slot).alias("_slot"), k.alias("_k"))
    wanted = F.when(part > 0, F.array(ask(0, low), ask(1, low + 1))).otherwise(F.array(ask(0, low)))
    asked = store(narrowed(first.select(*by, "_o", "_upto", part.alias("_f"), F.lit(0).cast("bigint").alias("_node"), F.explode(wanted).alias("_a"))
                           .select("*", "_a.*")))
    entries = ranked.filter("_r IS NOT NULL")
    for level in range(1, rounds):
        last = store(asked.groupBy(*by, "_node").agg(F.max("_o").alias("_last")))
        have = entries.withColumn("_node", F.expr(f"_r div {parts ** (rounds - level)}")).join(last, [*by, "_node"]).filter("_o < _last")
        # a row's questions come before its own value
        both = have.select(*by, "_node", (F.col("_o") * 4 + 3).alias("_t"), "_r").unionByName(
            asked.withColumn("_t", F.col("_o") * 4 + F.col("_slot")), allowMissingColumns=True)
        asked = store(narrowed(counts_before(both, [*by, "_node"], "_t", below(level), "_upto", 4 * block, tasks(3 * n)).filter("_slot IS NOT NULL")))
    got = asked.withColumnRenamed("_node", "_r").join(values, [*by, "_r"]).withColumnRenamed("_o", order)
    at = lambda slot: F.max(F.when(F.col("_slot") == slot, F.col("_v")))
    found = got.repartition(tasks(2 * n), *by, order).groupBy(*by, order).agg((at(0) + F.max("_f") * (F.coalesce(at(1), at(0)) - at(0))).alias(name))
    return df.repartition(tasks(2 * n), *by, order).join(found, [*by, order], "left")
