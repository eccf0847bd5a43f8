"""Structured Streaming: ticks in, bars, ladders and running session state out.

State is bounded by watermarks. Windowed results equal the batch operators on the
same rows; late rows beyond the watermark are dropped by Spark and show up in the
query progress.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tapegrid.config import SessionConfig
from tapegrid.functions import clock
from tapegrid.functions.market import side_sign, type_sign
from tapegrid.operators import grid as gr
from tapegrid.plans.session import scratch


def read_parquet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def valid_ticks(ticks: DataFrame, name: str = "tick_quality") -> DataFrame:
    """Heartbeats out; spot > 0, chain strike present, flow premium >= 0; good and dropped rows are observed."""
    kind = F.col("kind")
    beat = kind == "heartbeat"
    good = F.coalesce(F.when(kind == "spot", F.col("spot") > 0).when(kind == "chain", F.col("strike").isNotNull())
                      .when(kind == "flow", F.coalesce("premium", F.lit(0.0)) >= 0), F.lit(False))
    d = ticks.withColumn("_good", good)
    d = d.observe(name, F.count(F.when(F.col("_good"), 1)).alias("kept"), F.count(F.when(~F.col("_good") & ~beat, 1)).alias("dropped"))
    return d.filter("_good").drop("_good")


def feed_time(df: DataFrame, delay_minutes: int = 15) -> DataFrame:
    """Event time of a delayed feed."""
    return df.withColumn("ts_feed", F.col("ts") - F.expr(f"interval {delay_minutes} minutes"))


def bar_flow_stream(prints: DataFrame, cfg: SessionConfig, lateness: str = "10 minutes") -> DataFrame:
    """Live form of the per-bar flow sums. A bar ends at its label, so 10:00:00 exactly belongs to 10:00."""
    kind = F.lower("trade_type")
    prem = F.coalesce("premium", F.lit(0.0))
    blk = F.when(kind.isin("block", "dark_pool"), prem).otherwise(0.0)
    # windows are [start, end); shifting by one microsecond makes them (start, end]
    d = prints.withColumn("_e", F.col("ts") - F.expr("interval 1 microsecond")).withWatermark("_e", lateness)
    g = d.groupBy("symbol", F.window("_e", f"{cfg.bar_minutes} minutes")).agg(
        F.sum(blk).alias("blk"), F.sum(F.when(kind == "dark_pool", prem).otherwise(0.0)).alias("dark"),
        F.sum(F.when(kind == "sweep", prem).otherwise(0.0)).alias("swp"), F.sum(prem).alias("all_prem"),
        F.sum(blk * side_sign(F.col("side")) * type_sign(F.col("option_type"))).alias("sblk"))
    return g.select("symbol", F.col("window.end").alias("ts"), "blk", "dark", "swp", "all_prem", "sblk")


def ladder_stream(chain: DataFrame, minutes: int = 1, lateness: str = "10 minutes", strikes: int = 3) -> DataFrame:
    """The ladder each bar closes with: of every strike the last known value of every column within the bar, once the bar is over.

    A bar that holds fewer than ``strikes`` strikes gives no ladder: the one before it stays the latest. Rows later than the watermark are
    dropped by Spark and counted in the query's progress (``drained``).
    """
    d = chain.withColumn("_e", F.col("ts") - F.expr("interval 1 microsecond")).withWatermark("_e", lateness)
    rest = [c for c in chain.columns if c not in ("symbol", "strike", "ts", "seq")]
    at = F.struct("ts", "seq")
    # an order of NULL never wins, so each column takes its own last row with a value
    g = d.groupBy("symbol", "strike", F.window("_e", f"{minutes} minutes").alias("w")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest])
    bar = g.groupBy("symbol", F.window("w", f"{minutes} minutes").alias("w")).agg(F.collect_list(F.struct("strike", *rest)).alias("rungs"))
    return bar.filter(F.size("rungs") >= strikes).select("symbol", F.col("w.end").alias("ts"), F.explode("rungs").alias("r")).select("symbol", "ts", "r.*")


def bar_price_stream(ticks: DataFrame, cfg: SessionConfig, lateness: str = "10 minutes") -> DataFrame:
    """Last, high and low price, first and last time per bar; the input of the per-session state."""
    d = ticks.withColumn("_e", F.col("ts") - F.expr("interval 1 microsecond")).withWatermark("_e", lateness)
    at = F.struct("ts", "seq")
    g = d.groupBy("symbol", F.window("_e", f"{cfg.bar_minutes} minutes")).agg(
        F.max_by("spot", at).alias("spot"), F.max("spot").alias("high"), F.min("spot").alias("low"), F.count(F.lit(1)).alias("n"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.select("symbol", F.col("window.end").alias("ts"), "spot", "high", "low", "n", "first_ts", "last_ts")


STATE = "symbol string, session_date date, at long, spot double, running_high double, running_low double, twap double, n_bars long, stale boolean"


def span_us(span: str) -> int:
    """Microseconds of a span such as '90 seconds'."""
    amount, unit = span.split()
    return int(float(amount) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")] * 1_000_000)


def session_state_stream(bars: DataFrame, cfg: SessionConfig, stale_after: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Running high, low and time-weighted price per (symbol, session), kept in the state store until the session's day ends.

    ``bars`` are rows of ``bar_price_stream``, in any batches. Rows wait in the state until the watermark has passed them and are then
    taken in time order, so the result does not depend on how the feed was cut. A silence longer than ``stale_after`` gives one ``stale`` row,
    at the moment it has lasted that long, with the last values: when the next row shows it, when the watermark does, or at the end of the
    session. All timers are event times: the one at the end of the day removes the state, and a drained stream ends. Rows without
    a symbol (heartbeats) only move the watermark.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout
    d = bars.withColumn("session_date", clock.local_date(F.col("ts") - F.expr("interval 1 microsecond"), cfg.tz)).withWatermark("ts", lateness)
    us = lambda c: F.unix_micros(F.col(c))
    offset = clock.local_micros(F.col("ts"), cfg.tz) - us("ts")
    d = d.select("symbol", "session_date", "ts", us("ts").alias("at"), us("first_ts").alias("first"), us("last_ts").alias("last"), "spot",
                 ((F.unix_date("session_date") + 1) * F.lit(clock.DAY_US) - offset).alias("closes"))
    wait, bar = span_us(stale_after) if stale_after else None, cfg.bar_minutes * 60_000_000
    names = [x.split()[0] for x in STATE.split(", ")]

    def step(key, batches, state):
        import json

        import pandas as pd
        if key[0] is None:
            return
        own = json.loads(state.get[0]) if state.exists else {"hi": None, "lo": None, "sum": 0.0, "n": 0, "last": None, "spot": None, "silent": False, "rows": [], "closes": 0}
        for rows in batches:
            if len(rows):
                own["closes"] = int(rows["closes"].iloc[0])
                own["rows"] += [[int(a), int(b), int(c), float(p)] for a, b, c, p in zip(rows["at"], rows["first"], rows["last"], rows["spot"])]
        passed = state.getCurrentWatermarkMs() * 1000
        out = []

        def stale():
            own["silent"] = True
            out.append([*key, own["last"] + wait, own["spot"], own["hi"], own["lo"], own["sum"] / own["n"], own["n"], True])

        own["rows"].sort()
        ready = [r for r in own["rows"] if r[0] <= passed]
        own["rows"] = own["rows"][len(ready):]
        for at, first, last, spot in ready:
            if wait and own["n"] and not own["silent"] and first - own["last"] > wait:
                stale()
            own.update(hi=spot if own["hi"] is None else max(own["hi"], spot), lo=spot if own["lo"] is None else min(own["lo"], spot), sum=own["sum"] + spot, n=own["n"] + 1,
                       last=last, spot=spot, silent=False)
            out.append([*key, at, spot, own["hi"], own["lo"], own["sum"] / own["n"], own["n"], False])
        over = passed >= own["closes"]  # every row of the day has been seen
        # a bar still to come may have begun one bar before its label
        due = own["last"] + wait + bar if wait and own["n"] and not own["silent"] else None
        if due is not None and (own["closes"] - own["last"] > wait if over else passed >= due and not own["rows"]):
            stale()
            due = None
        if over:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(own),))
            after = min([own["closes"], *(r[0] for r in own["rows"][:1]), *([due] if due else [])])
            state.setTimeoutTimestamp(max(after // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    out = d.groupBy("symbol", "session_date").applyInPandasWithState(step, STATE, "value string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "ts")


def drained(stream: DataFrame, label: str, mode: str = "append") -> tuple[DataFrame, dict]:
    """Drain a file stream into parquet below the shared scratch folder and read the result back, with counts of the run: micro-batches, rows
    that stateful operators dropped as late (after their partial aggregation, where there is one), and state rows at the end."""
    spark = stream.sparkSession
    out, ckpt = scratch(spark, label), scratch(spark, label + "-ckpt")
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    steps = list(q.recentProgress)
    counts = {"batches": len(steps), "late": sum(o.numRowsDroppedByWatermark for p in steps for o in p.stateOperators),
              "state_rows": sum(o.numRowsTotal for o in steps[-1].stateOperators) if steps else 0}
    return spark.read.schema(stream.schema).parquet(out), counts


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Rows of a drained stream."""
    return drained(stream, label, mode)[0]


def decision_cycle(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str,
                   every: str | None = "1 minute", keep=lambda df: df):
    """Run ``on_batch`` on every micro-batch; ``every=None`` drains what is available."""
    w = stream.writeStream.foreachBatch(lambda df, i: on_batch(keep(df), i)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


class SessionBuffer:
    """Sessions of a live feed, kept across micro-batches as Parquet in the shared folder.

    Every batch writes its rows to a folder of its own (a replayed batch overwrites it) and is then given the whole of the sessions it
    touched. Rows older than the newest row of earlier batches by more than ``lateness`` are not taken and are counted. ``out`` collects what
    the cycle returns; of one key the last batch's row stands, so a session fed in many batches ends with the rows of one fed at once.
    """

    def __init__(self, spark: SparkSession, cfg: SessionConfig, lateness: str = "10 minutes", label: str = "sessions"):
        self.spark, self.cfg, self.lateness, self.path = spark, cfg, lateness, scratch(spark, label)

    def _read(self, part: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}")

    def take(self, rows: DataFrame, batch: int) -> DataFrame:
        """Adds a batch; all rows so far of the sessions it touched, with the column ``batch``."""
        dated = rows.withColumn("session_date", clock.local_date(F.col("ts"), self.cfg.tz))
        newest = None
        if batch:
            marks = self._read("marks", "newest timestamp, rows long, late long, batch int")
            newest = marks.filter(F.col("batch") < batch).agg(F.max("newest")).first()[0]
        fresh = F.lit(True) if newest is None else F.col("ts") >= F.lit(newest) - F.expr(f"interval {self.lateness}")
        dated.filter(fresh).write.mode("overwrite").partitionBy("session_date").parquet(f"{self.path}/rows/batch={batch}")
        dated.agg(F.max(F.when(fresh, F.col("ts"))).alias("newest"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum((~fresh).cast("long")), F.lit(0)).alias("late")).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch}")
        kept = self._read("rows", StructType([*dated.schema.fields, StructField("batch", IntegerType())])).filter(F.col("batch") <= batch)
        days = kept.filter(F.col("batch") == batch).select("session_date").distinct()
        return kept.join(F.broadcast(days), "session_date", "left_semi")  # calendar dates

    def put(self, result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(f"{self.path}/out/batch={batch}")

    def late(self) -> DataFrame:
        """(batch, rows, late) of every batch."""
        return self._read("marks", "newest timestamp, rows long, late long, batch int").select("batch", "rows", "late")

    def result(self, schema, keys: tuple[str, ...]) -> DataFrame:
        """Of every key the row of the last batch that gave one."""
        out = self._read("out", f"{schema}, batch int")
        rest = [c for c in out.columns if c not in (*keys, "batch")]
        return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def live_decisions(buffered: DataFrame, cfg: SessionConfig, least: int = 30) -> DataFrame:
    """Per bar of the buffered sessions, once ``least`` rows of the session have come (warm-up): rows so far, last price, running high and low."""
    t = gr.regular_hours(buffered, cfg).withColumn("bar", clock.ceil_bar(F.col("ts"), cfg))
    bars = t.groupBy("symbol", "session_date", "bar").agg(F.count(F.lit(1)).alias("n"), F.max_by("spot", F.struct("ts", "seq")).alias("spot"),
                                                          F.max("spot").alias("high"), F.min("spot").alias("low"))
    w = Window.partitionBy("symbol", "session_date").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    return bars.select("symbol", "session_date", "bar", F.sum("n").over(w).alias("rows"), "spot", F.max("high").over(w).alias("high"), F.min("low").over(w).alias("low")).filter(F.col("rows") >= least)
