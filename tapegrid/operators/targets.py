"""Forward labels. Nothing reaches across the close: missing look-aheads stay NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapegrid.config import FeatureConfig, SessionConfig
from tapegrid.functions.market import magnitude
from tapegrid.functions.nulls import safe_div
from tapegrid.operators.quantiles import exact_quantiles
from tapegrid.operators.windows import SESSION, by_bar, last_value

FC = FeatureConfig()
BUCKET_MINUTES = 15
BASE_SESSIONS = 20
BASE_FLOOR = 0.05


def horizon_targets(grid: DataFrame, cfg: SessionConfig, horizons=FC.horizons) -> DataFrame:
    """Price, log return, price change and volatility-normalised return per horizon. Needs ``spot`` and ``rv_1m``."""
    w = by_bar()
    p = F.col("spot")
    mtc = F.lit(float(cfg.length)) - F.col("bar")
    d = grid.withColumns({f"y_price_{h}": last_value("spot", w) if m is None else F.lead("spot", cfg.rows(m)).over(w)
                          for h, m in horizons})
    out = {}
    for h, m in horizons:
        fut = F.col(f"y_price_{h}")
        ret = F.log(F.when(fut > 0, fut)) - F.log(F.when(p > 0, p))
        minutes = F.greatest(mtc, F.lit(1.0)) if m is None else F.lit(float(m))
        out[f"y_ret_{h}"] = ret
        out[f"y_dprice_{h}"] = fut - p
        out[f"y_retn_{h}"] = safe_div(ret, F.col("rv_1m") * F.sqrt(minutes), None)
    return d.withColumns({**out, "y_eod_minutes_ahead": mtc})


def excursions(bars: DataFrame, cfg: SessionConfig, minutes: int = 30) -> DataFrame:
    """Largest rise and fall over the next ``minutes``; NULL when too few bars are left."""
    n = cfg.rows(minutes)
    need = max(5, n // 3)
    ahead = by_bar().rowsBetween(1, n)
    p, zero = F.col("spot"), F.lit(0.0)
    enough = F.count("spot").over(ahead) >= need
    return bars.filter(p.isNotNull()).withColumns({
        "up": F.when(enough, F.greatest(F.max(p).over(ahead) - p, zero)),
        "dn": F.when(enough, F.greatest(p - F.min(p).over(ahead), zero)),
        "bucket": F.floor(F.col("bar") / BUCKET_MINUTES).cast("int")})


def bucket_medians(exc: DataFrame) -> DataFrame:
    """Median excursion per (session, time bucket); a bucket holds at most 15 minutes of bars."""
    half = F.lit(0.5)
    return exc.groupBy(*SESSION, "bucket").agg(
        ((F.percentile("up", half) + F.percentile("dn", half)) / 2.0).alias("exc"))


def tod_baseline(medians: DataFrame, sessions: int = BASE_SESSIONS, least: int = 5) -> DataFrame:
    """Median over the previous sessions of the same bucket, carried forward.

    The frame counts sessions, so every bucket gets a row for every session first.
    """
    seen = medians.groupBy("symbol").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    days = medians.select(*SESSION).distinct().join(seen, "symbol")
    dense = days.select(*SESSION, F.explode(F.sequence("a", "b")).alias("bucket"))
    w = Window.partitionBy("symbol", "bucket").orderBy("session_date")
    past = w.rowsBetween(-sessions, -1)
    d = dense.join(medians, [*SESSION, "bucket"], "left")
    raw = F.when(F.count("exc").over(past) >= least, F.percentile("exc", F.lit(0.5)).over(past))
    d = d.withColumn("_raw", raw)
    base = F.last("_raw", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.select(*SESSION, "bucket", base.alias("base"))


def magnitude_targets(exc: DataFrame, fallback: float = 0.5, store=lambda d: d) -> DataFrame:
    """Excursions on the 0-10 scale relative to the time-of-day baseline; ``store`` keeps the rows read twice."""
    exc = store(exc)
    d = store(exc.join(tod_baseline(bucket_medians(exc)), [*SESSION, "bucket"], "left"))
    med = exact_quantiles(d, ["symbol"], "base", [0.5], ["_med"], store=store)
    d = d.join(med, "symbol", "left")
    d = d.withColumn("base", F.greatest(F.coalesce("base", "_med", F.lit(fallback)), F.lit(BASE_FLOOR))).drop("_med")
    return d.withColumns({"mag_up": magnitude(F.col("up"), F.col("base")), "mag_dn": magnitude(F.col("dn"), F.col("base"))})


def baseline_now(mags: DataFrame, asof: str) -> DataFrame:
    """Latest baseline per (symbol, bucket) from sessions before ``asof`` (a date)."""
    past = mags.filter(F.col("session_date") < F.lit(asof).cast("date"))
    return past.groupBy("symbol", "bucket").agg(F.max_by("base", F.struct("session_date", "bar")).alias("base"))


def big_move(grid: DataFrame, rows: int = 20, ratio: float = 2.0) -> DataFrame:
    """Label: forward range over ``rows`` bars exceeds ``ratio`` times the backward range."""
    w = by_bar()
    ahead, back = w.rowsBetween(1, rows), w.rowsBetween(-(rows - 1), 0)
    p = F.col("spot")
    full = (F.count(p).over(ahead) >= rows) & (F.count(p).over(back) >= rows)
    fwd, prior = F.max(p).over(ahead) - F.min(p).over(ahead), F.max(p).over(back) - F.min(p).over(back)
    return grid.withColumn("big_move", F.when(full, (fwd > ratio * prior).cast("int")))
