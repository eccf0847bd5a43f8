"""As-of backward join on arbitrary timestamps, safe for hot keys.

Union-and-carry over a whole key would put every row of a hot key into one task.
Here time is cut into buckets: inside a bucket rows are interleaved and carried,
and the last right row of each earlier bucket arrives through a per-bucket
summary. A task never holds more than one (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], values: list[str],
                  seq: str = "seq", ts: str = "ts", bucket_minutes: int = 5) -> DataFrame:
    """Each left row with ``values`` of the newest right row at or before its ``ts`` (NULL if none).

    Ties on ``ts`` resolve to the highest right ``seq``.
    """
    width = bucket_minutes * 60_000_000
    bucket = F.floor(F.unix_micros(ts) / width).cast("bigint")
    payload = F.struct(*[F.col(v) for v in values])
    left_cols = left.columns
    r = right.select(*by, F.col(ts).alias("_ts"), F.col(seq).alias("_seq"), payload.alias("_v"),
                     bucket.alias("_b"))
    lft = left.withColumn("_b", bucket)

    closing = r.groupBy(*by, "_b").agg(F.max_by("_v", F.struct("_ts", "_seq")).alias("_v"))
    touched = lft.select(*by, "_b").distinct()
    marks = closing.unionByName(touched, allowMissingColumns=True).groupBy(*by, "_b").agg(
        F.first("_v", ignorenulls=True).alias("_v"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*by, "_b", F.last("_v", ignorenulls=True).over(earlier).alias("_carry"))

    rows = (lft.select(*by, "_b", F.col(ts).alias("_ts"), F.lit(None).cast("bigint").alias("_seq"),
                       F.lit(1).alias("_side"), F.struct(*left_cols).alias("_left"))
            .unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True))
    inside = (Window.partitionBy(*by, "_b").orderBy("_ts", "_side", "_seq")
              .rowsBetween(Window.unboundedPreceding, 0))
    hit = (rows.withColumn("_near", F.last("_v", ignorenulls=True).over(inside))
           .filter(F.col("_side") == 1)
           .join(carried, [*by, "_b"], "left")
           .withColumn("_got", F.coalesce("_near", "_carry")))
    return hit.select(*[F.col(f"_left.{c}").alias(c) for c in left_cols],
                      *[F.col(f"_got.{v}").alias(v) for v in values])


def snapshot_asof(grid: DataFrame, ladder: DataFrame, keys=("symbol", "session_date"), where=None) -> DataFrame:
    """Ladder rows of the newest snapshot at or before each grid bar, same session.

    ``grid`` must hold every bar a snapshot may be labelled with; ``where`` picks the bars to answer for before ladder rows are copied.

    Grid bars and snapshot labels are bar-level, so the carry runs on one session of bars.
    """
    snaps = ladder.select(*keys, "bar").distinct().withColumn("asof_bar", F.col("bar"))
    w = Window.partitionBy(*keys).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    at = (grid.join(snaps, [*keys, "bar"], "left")
          .withColumn("asof_bar", F.last("asof_bar", ignorenulls=True).over(w)))
    at = at if where is None else at.filter(where)
    return at.join(ladder.withColumnRenamed("bar", "asof_bar"), [*keys, "asof_bar"], "inner")
