"""Option-ladder analytics over (snapshot, strike) rows.

A snapshot is (symbol, session_date, bar). Raw ladder rows first collapse to the
last non-NULL value per strike (map-side combine), after which a snapshot holds only
its listed strikes. The strike-ordered window and the final aggregation share the
snapshot key, so all metrics cost one shuffle of the collapsed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapegrid.config import EPS, FeatureConfig, SessionConfig
from tapegrid.functions import clock
from tapegrid.functions.nulls import clip, safe_div
from tapegrid.operators.windows import SESSION, by_bar, carry, diff

SNAP = (*SESSION, "bar")
FC = FeatureConfig()
LEVELS = ("gex", "vanna", "charm", "call_oi", "put_oi")

GEX_COLUMNS = (
    "gex_net_total", "gex_abs_total", "gex_zero_level", "gex_dist_to_zero", "gex_dist_to_zero_pct", "gex_above_zero",
    "gex_top3_concentration", "gex_hhi", "gex_band_net", "gex_band_abs", "gex_band_share", "gex_pos_centroid",
    "gex_pos_centroid_dist", "gex_abs_centroid_dist", "gex_max_node_strike", "gex_max_node_value", "gex_max_node_dist",
    "gex_wall_above", "gex_wall_above_dist", "gex_wall_below", "gex_wall_below_dist", "gex_neg_pocket_above",
    "gex_neg_pocket_below", "vanna_net_total", "vanna_band_net", "charm_net_total", "charm_band_net",
    "max_pain", "max_pain_dist")


def last_value_by(value: str) -> Column:
    """Last non-NULL value by ``_at``; a NULL value never wins because its ordering is NULL."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at")))


def strike_rows(ladder: DataFrame, cfg: SessionConfig, columns: tuple[str, ...] = LEVELS) -> DataFrame:
    """Last non-NULL value per (snapshot, strike); the snapshot is labelled at its end."""
    return (ladder.withColumns({"session_date": clock.local_date(F.col("ts"), cfg.tz),
                                "bar": clock.ceil_bar(F.col("ts"), cfg, cfg.snap_minutes),
                                "_at": clock.order_key(F.col("ts"), F.col("seq"))})
            .filter(F.col("bar").between(0, cfg.length) & F.col("strike").isNotNull())
            .groupBy(*SNAP, "strike").agg(*[last_value_by(c).alias(c) for c in columns]))


def with_spot(rows: DataFrame, grid: DataFrame) -> DataFrame:
    return rows.join(grid.select(*SNAP, "spot").filter(F.col("spot").isNotNull()), list(SNAP))


def thick_snapshots(rows: DataFrame, least: int = 3) -> DataFrame:
    """Only snapshots with at least ``least`` distinct strikes."""
    n = F.count("strike").over(Window.partitionBy(*SNAP))
    return rows.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def _strike_window():
    return Window.partitionBy(*SNAP).orderBy("strike")


def crossing_level(k0, y0, k1, y1) -> Column:
    """Strike where the line through two neighbours of opposite sign is zero, else NULL."""
    gap = F.when(F.abs(y1 - y0) < EPS, F.lit(EPS)).otherwise(y1 - y0)
    return F.when(F.signum(y0) * F.signum(y1) < 0, k0 - y0 * (k1 - k0) / gap)


def with_profile(rows: DataFrame) -> DataFrame:
    """Per-strike helpers: zero-filled levels, crossings with the next strike, option pain at the strike.

    Pain uses running sums over strikes instead of all strike pairs.
    """
    w = _strike_window()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = F.col("strike")
    d = rows.withColumns({"g": F.coalesce("gex", F.lit(0.0)), "_c": F.coalesce("call_oi", F.lit(0.0)),
                          "_p": F.coalesce("put_oi", F.lit(0.0))})
    d = d.withColumns({"_k1": F.lead("strike").over(w), "_g1": F.lead("g").over(w), "_cum": F.sum("g").over(run),
                       "_cc": F.sum("_c").over(run), "_cck": F.sum(F.col("_c") * k).over(run),
                       "_pp": F.sum("_p").over(run), "_ppk": F.sum(F.col("_p") * k).over(run),
                       "_tp": F.sum("_p").over(everything), "_tpk": F.sum(F.col("_p") * k).over(everything)})
    d = d.withColumn("_cum1", F.col("_cum") + F.col("_g1"))
    return d.withColumns({
        "cross_strike": crossing_level(k, F.col("g"), F.col("_k1"), F.col("_g1")),
        "cross_cum": crossing_level(k, F.col("_cum"), F.col("_k1"), F.col("_cum1")),
        "pain": k * F.col("_cc") - F.col("_cck") + F.col("_tpk") - F.col("_ppk") - k * (F.col("_tp") - F.col("_pp")),
    }).drop("_k1", "_g1", "_cum", "_cum1", "_cc", "_cck", "_pp", "_ppk", "_tp", "_tpk", "_c", "_p")


def _nearest(level: str) -> Column:
    lvl = F.col(level)
    return F.min_by(lvl, F.when(lvl.isNotNull(), F.struct(F.abs(lvl - F.col("spot")), F.col("strike"))))


def zero_level() -> Column:
    """Sign change of the per-strike profile nearest to spot, else of the cumulative profile."""
    return F.coalesce(_nearest("cross_strike"), _nearest("cross_cum"))


def max_pain() -> Column:
    enough = F.count("call_oi") + F.count("put_oi") >= 2
    return F.when(enough, F.min_by("strike", F.struct("pain", "strike")))


def strike_of_max(value: Column, where: Column | None = None) -> Column:
    """Arg-max strike, ties to the lowest strike."""
    key = F.struct(value, -F.col("strike"))
    return F.max_by("strike", key if where is None else F.when(where, key))


def snapshot_metrics(rows: DataFrame, fc: FeatureConfig = FC) -> DataFrame:
    """One row per snapshot with every ladder metric. Input: strike rows with ``spot``."""
    k, s, g = F.col("strike"), F.col("spot"), F.col("g")
    a = F.abs(g)
    band, above, below, pos = F.abs(k - s) <= fc.spot_band, k > s, k < s, g > 0
    tot = lambda x, m: F.coalesce(F.sum(F.when(m, x)), F.lit(0.0))
    biggest = F.slice(F.sort_array(F.collect_list(a), asc=False), 1, fc.top_k)
    d = with_profile(rows).groupBy(*SNAP).agg(
        F.max("spot").alias("spot"), F.count("gex").alias("_has"), F.count("strike").alias("n_strikes"),
        F.sum("g").alias("gex_net_total"), F.sum(a).alias("gex_abs_total"), zero_level().alias("gex_zero_level"),
        F.aggregate(biggest, F.lit(0.0), lambda x, y: x + y).alias("_top"), F.sum(g * g).alias("_sq"),
        tot(g, band).alias("gex_band_net"), tot(a, band).alias("gex_band_abs"),
        tot(g, pos).alias("_pos"), tot(k * g, pos).alias("_posk"), F.sum(k * a).alias("_ka"),
        strike_of_max(a).alias("gex_max_node_strike"), F.max_by(g, F.struct(a, -k)).alias("gex_max_node_value"),
        F.coalesce(F.max(F.when(above & pos, g)), F.lit(0.0)).alias("gex_wall_above"),
        F.coalesce(F.max(F.when(below & pos, g)), F.lit(0.0)).alias("gex_wall_below"),
        strike_of_max(g, above).alias("_ka_up"), strike_of_max(g, below).alias("_ka_dn"),
        F.coalesce(F.min(F.when(above, g)), F.lit(0.0)).alias("gex_neg_pocket_above"),
        F.coalesce(F.min(F.when(below, g)), F.lit(0.0)).alias("gex_neg_pocket_below"),
        F.sum("vanna").alias("vanna_net_total"), F.sum(F.when(band, F.col("vanna"))).alias("vanna_band_net"),
        F.sum("charm").alias("charm_net_total"), F.sum(F.when(band, F.col("charm"))).alias("charm_band_net"),
        max_pain().alias("max_pain"))
    t, z = F.col("gex_abs_total"), F.col("gex_zero_level")
    d = d.withColumns({
        "gex_dist_to_zero": s - z, "gex_dist_to_zero_pct": safe_div(s - z, s, None),
        "gex_above_zero": F.when(z.isNotNull(), (s > z).cast("double")),
        "gex_top3_concentration": safe_div(F.col("_top"), t), "gex_hhi": safe_div(F.col("_sq"), t * t),
        "gex_band_share": safe_div(F.col("gex_band_abs"), t),
        "gex_pos_centroid": safe_div(F.col("_posk"), F.col("_pos"), None),
        "gex_abs_centroid_dist": safe_div(F.col("_ka"), t, None) - s,
        "gex_max_node_dist": F.col("gex_max_node_strike") - s,
        "gex_wall_above_dist": F.col("_ka_up") - s, "gex_wall_below_dist": s - F.col("_ka_dn"),
        "max_pain_dist": F.col("max_pain") - s})
    d = d.withColumn("gex_pos_centroid_dist", F.col("gex_pos_centroid") - s)
    readable = F.col("_has") > 0
    return d.select(*SNAP, "spot", "n_strikes", *[F.when(readable, F.col(c)).alias(c) for c in GEX_COLUMNS])


def grid_metrics(grid: DataFrame, snaps: DataFrame, cfg: SessionConfig, fc: FeatureConfig = FC) -> DataFrame:
    """Snapshot metrics carried forward within the session, with age and decay changes."""
    w = by_bar()
    d = grid.join(snaps.select(*SNAP, F.col("bar").alias("_snap"), *GEX_COLUMNS), list(SNAP), "left")
    d = d.withColumns({**{c: carry(c, w) for c in GEX_COLUMNS},
                       "gex_snapshot_age_min": F.col("bar") - carry("_snap", w)}).drop("_snap")
    d = d.withColumns({**{f"gex_band_decay_{n}m": diff("gex_band_net", n) for n in fc.decay_rows},
                       **{f"gex_dist_zero_chg_{n}m": diff("gex_dist_to_zero", n) for n in fc.decay_rows},
                       "charm_drift_to_close": F.col("charm_band_net") * (cfg.length - F.col("bar")) / 390.0})
    return d.withColumns({f"gex_band_decay_pct_{n}m": clip(safe_div(F.col(f"gex_band_decay_{n}m"), F.abs("gex_band_abs")),
                                                          -fc.ratio_clip, fc.ratio_clip) for n in fc.decay_rows})


def atm_block(grid: DataFrame, rows: DataFrame, session_bounded: bool = True) -> DataFrame:
    """Nearest-strike implied vols, skew, straddle share of spot and 5-row vol change.

    ``session_bounded=False`` lets the change reach into the previous session, as in files built that way.
    """
    at = rows.join(grid.select(*SNAP, "spot").filter(F.col("spot").isNotNull()), list(SNAP))
    near = F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))
    pick = at.groupBy(*SNAP).agg(F.min_by(F.struct("iv_call", "iv_put", "call_prem", "put_prem"), near).alias("r"))
    d = grid.join(pick, list(SNAP), "left")
    iv = lambda c: F.col(f"r.{c}")
    d = d.withColumns({"iv_call_atm": iv("iv_call"), "iv_put_atm": iv("iv_put"),
                       "iv_skew_atm": iv("iv_put") - iv("iv_call"),
                       "straddle_pct": (iv("call_prem") + iv("put_prem")) / F.col("spot") * 100.0})
    from tapegrid.functions.nulls import mean_of
    w = by_bar() if session_bounded else Window.partitionBy("symbol").orderBy("session_date", "bar")
    d = d.withColumn("_iv", mean_of("iv_call_atm", "iv_put_atm"))
    return d.withColumn("iv_atm_chg_5", F.col("_iv") - F.lag("_iv", 5).over(w)).drop("_iv", "r")
