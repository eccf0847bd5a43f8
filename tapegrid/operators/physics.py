"""Ladder "physics": attractor masses, clusters, gravity, mean-shift targets, end-of-day pin.

Input rows are (snapshot, strike) with zero-filled levels and the snapshot's ``spot``,
``minutes_to_close`` and ``rv_1m``. A snapshot is one listed ladder, so windows and
arrays per snapshot stay small; snapshots spread over the cluster by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapegrid.config import EPS, FeatureConfig, PhysicsConfig
from tapegrid.functions.market import time_ramp, to_grid
from tapegrid.functions.nulls import safe_div
from tapegrid.operators.ladder import SNAP, max_pain, strike_of_max, with_profile, zero_level

PC = PhysicsConfig()
FC = FeatureConfig()


def _snap():
    return Window.partitionBy(*SNAP)


def ladder_state(rows: DataFrame) -> DataFrame:
    """Zero-filled levels; volume from call and put volume, else from ``volume``."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
    if "call_vol" in rows.columns or "put_vol" in rows.columns:
        vol = z("call_vol") + z("put_vol")
    else:
        vol = z("volume")
    return rows.filter(F.col("strike").isNotNull()).withColumns(
        {"volume": vol, "gex": z("gex"), "call_oi": z("call_oi"), "put_oi": z("put_oi")})


def thin_fallback(rows: DataFrame, least: int = 3) -> DataFrame:
    """Replace snapshots with fewer than ``least`` strikes by a flat zero ladder around floor(spot)."""
    counted = rows.withColumn("_n", F.count("strike").over(_snap()))
    thick = counted.filter(F.col("_n") >= least).drop("_n")
    thin = counted.filter(F.col("_n") < least)
    rest = [c for c in rows.columns if c not in (*SNAP, "strike", "gex", "call_oi", "put_oi", "volume")]
    one = thin.groupBy(*SNAP).agg(*[F.max(c).alias(c) for c in rest])
    flat = one.withColumn("_o", F.explode(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0)))).withColumns(
        {"strike": F.floor("spot").cast("double") + F.col("_o"),
         **{c: F.lit(0.0) for c in ("gex", "call_oi", "put_oi", "volume") if c in rows.columns}}).drop("_o")
    return thick.unionByName(flat.select(thick.columns))


def implied_move(df: DataFrame) -> DataFrame:
    """Implied move and per-minute volatility default from one another; 1 % of spot without either."""
    root = F.sqrt(F.greatest(F.col("minutes_to_close"), F.lit(1.0)))
    given = F.col("implied_move") if "implied_move" in df.columns else F.lit(None).cast("double")
    rv = F.when(F.col("rv_1m") > 0, F.col("rv_1m"))
    im = F.coalesce(F.when(given > 0, given), F.col("spot") * rv * root, 0.01 * F.col("spot"))
    d = df.withColumn("implied_move", im)
    return d.withColumn("rv_1m", F.coalesce(rv, F.col("implied_move") / (F.col("spot") * root)))


def attractor_masses(rows: DataFrame, pc: PhysicsConfig = PC) -> DataFrame:
    """``mass`` per strike: weighted shares of |gex|, open interest and volume, summing to one."""
    w = _snap()
    a, oi = F.abs("gex"), F.col("call_oi") + F.col("put_oi")
    m = pc.w_gex * safe_div(a, F.sum(a).over(w)) + pc.w_oi * safe_div(oi, F.sum(oi).over(w))
    if "volume" in rows.columns:
        v = F.coalesce("volume", F.lit(0.0))
        m = m + pc.w_vol * safe_div(v, F.sum(v).over(w))
    d = rows.withColumn("_m", m).withColumn("_t", F.sum("_m").over(w))
    return d.withColumn("mass", F.when(F.col("_t") > EPS, F.col("_m") / F.col("_t"))
                        .otherwise(1.0 / F.count("strike").over(w))).drop("_m", "_t")


def cluster_ids(rows: DataFrame, pc: PhysicsConfig = PC) -> DataFrame:
    """A cluster starts after a strike gap or after a local valley of |gex|."""
    w = _snap().orderBy("strike")
    a = F.abs("gex")
    inf = F.lit(float("inf"))
    prev, nxt = F.coalesce(F.lag(a).over(w), inf), F.coalesce(F.lead(a).over(w), inf)
    d = rows.withColumn("_valley", (a < prev) & (a <= nxt) & (a < pc.valley_ratio * F.least(prev, nxt)))
    gap = F.coalesce(F.col("strike") - F.lag("strike").over(w) > pc.merge_points, F.lit(False))
    start = gap | F.coalesce(F.lag("_valley").over(w), F.lit(False))
    d = d.withColumn("_start", start.cast("int"))
    return d.withColumn("cluster_id", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(
        "_valley", "_start")


def clusters(rows: DataFrame, pc: PhysicsConfig = PC) -> DataFrame:
    """Strongest clusters per snapshot with mass, sums, centre, peak strike and distance."""
    m = F.col("mass") + EPS
    c = cluster_ids(rows, pc).groupBy(*SNAP, "cluster_id").agg(
        F.sum("mass").alias("mass"), F.sum("gex").alias("gex_sum"), F.sum(F.abs("gex")).alias("abs_gex_sum"),
        (F.sum(F.col("strike") * m) / F.sum(m)).alias("center"),
        F.max_by("strike", F.struct(F.abs("gex"), F.col("strike"))).alias("peak_strike"),
        F.count(F.lit(1)).alias("n_strikes"), F.max("spot").alias("spot"))
    c = c.withColumns({"sign": F.signum("gex_sum").cast("int"), "dist": F.col("center") - F.col("spot")})
    rank = F.row_number().over(_snap().orderBy(F.desc("abs_gex_sum"), "cluster_id"))
    return c.withColumn("rank", rank).filter(F.col("rank") <= pc.top_clusters).drop("spot")


def profile(rows: DataFrame, pc: PhysicsConfig = PC) -> DataFrame:
    """Regime, flip level, max pain, walls with their mass and the ladder as one array per snapshot."""
    k, s, g = F.col("strike"), F.col("spot"), F.col("gex")
    band = F.abs(k - s) <= pc.band_points
    wall = lambda side: F.max_by(F.struct("strike", "gex", "mass"), F.when(side & (g > 0), F.struct(g, -k)))
    carried = [c for c in ("minutes_to_close", "rv_1m", "implied_move", "net_prem_z") if c in rows.columns]
    d = with_profile(rows).groupBy(*SNAP).agg(
        F.max("spot").alias("spot"), *[F.max(c).alias(c) for c in carried],
        zero_level().alias("zero_gamma_level"), max_pain().alias("max_pain"), F.sum("gex").alias("gex_net_total"),
        F.coalesce(F.sum(F.when(band, g)), F.lit(0.0)).alias("gex_band_net"),
        F.coalesce(F.sum(F.when(band, F.col("mass"))), F.lit(0.0)).alias("band_mass_share"),
        wall(k > s).alias("_up"), wall(k < s).alias("_dn"), strike_of_max(F.abs(g)).alias("peak_gex_strike"),
        F.array_sort(F.collect_list(F.struct("strike", "gex", "mass"))).alias("ladder"))
    neg = F.coalesce(s < F.col("zero_gamma_level"), F.lit(False))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return d.withColumns({
        "regime": F.when(neg, "negative_gamma").otherwise("positive_gamma"),
        "dist_to_zero_gamma": s - F.col("zero_gamma_level"), "dist_to_max_pain": F.col("max_pain") - s,
        "wall_above": F.col("_up.strike"), "wall_above_gex": z("_up.gex"), "wall_above_mass": z("_up.mass"),
        "wall_below": F.col("_dn.strike"), "wall_below_gex": z("_dn.gex"), "wall_below_mass": z("_dn.mass"),
    }).drop("_up", "_dn")


def horizon_rows(df: DataFrame, horizons=FC.horizons) -> DataFrame:
    """One row per configured horizon: an explode over a constant array, not a join."""
    dims = F.array(*[F.struct(F.lit(i).alias("horizon_no"), F.lit(h).alias("horizon"),
                              F.lit(None if m is None else float(m)).cast("double").alias("horizon_min"))
                     for i, (h, m) in enumerate(horizons)])
    return df.withColumn("_h", F.explode(dims)).select("*", "_h.*").drop("_h")


def horizon_scales(df: DataFrame, pc: PhysicsConfig = PC) -> DataFrame:
    """Width and mass scale of the attraction per horizon."""
    mtc = F.greatest(F.col("minutes_to_close"), F.lit(1.0))
    share = F.least(F.coalesce("horizon_min", mtc), mtc) / mtc
    neg = F.col("regime") == "negative_gamma"
    width = F.greatest(pc.sigma_im * F.col("implied_move") * F.least(F.sqrt(share), F.lit(1.0)), F.lit(pc.sigma_floor))
    frac = F.when(F.col("horizon_min").isNull(), 1.0).otherwise(F.pow(share, F.lit(pc.mass_decay)))
    return df.withColumns({"sigma": width * F.when(neg, pc.neg_sigma).otherwise(1.0),
                           "mass_scale": F.when(neg, pc.neg_damping).otherwise(1.0) * frac})


def _sum_over(ladder: Column, term) -> Column:
    return F.aggregate(ladder, F.lit(0.0), lambda acc, e: acc + term(e))


def gravity(df: DataFrame) -> DataFrame:
    """Pull of the ladder at the starting price."""
    x, s, ms = F.col("start"), F.col("sigma"), F.col("mass_scale")

    def pull(e):
        d = e["strike"] - x
        return e["mass"] * ms * F.exp(-0.5 * (d / s) * (d / s)) * d

    return df.withColumn("gravity", _sum_over(F.col("ladder"), pull) / (s * s))


def mean_shift(df: DataFrame, pc: PhysicsConfig = PC) -> DataFrame:
    """Fixed number of mean-shift steps from ``start``; a converged row stays where it is."""
    x0, s, ms, ladder = F.col("start"), F.col("sigma"), F.col("mass_scale"), F.col("ladder")

    def step(state):
        x = state["x"]
        init = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))

        def add(acc, e):
            u = (e["strike"] - x) / s
            w = e["mass"] * ms * F.exp(-0.5 * u * u)
            return F.struct((acc["n"] + w * e["strike"]).alias("n"), (acc["d"] + w).alias("d"))

        u0 = (x0 - x) / (2.0 * s)
        w0 = F.lit(pc.anchor_mass) * F.exp(-0.5 * u0 * u0)
        moved = F.aggregate(ladder, init, add, lambda t: (t["n"] + w0 * x0) / (t["d"] + w0 + EPS))
        nxt = F.when(state["done"], x).otherwise(moved)
        return F.struct(nxt.alias("x"), (state["done"] | (F.abs(nxt - x) < pc.shift_tol)).alias("done"))

    begin = F.struct(x0.alias("x"), F.lit(False).alias("done"))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(pc.shift_iters)), begin, lambda st, _i: step(st), lambda st: st["x"])
    return df.withColumn("physics_target", run)


def eod_pin(df: DataFrame, pc: PhysicsConfig = PC) -> DataFrame:
    """Heaviest positive wall near the end-of-day target, with its pin strength.

    Input: profile rows with ``eod_target`` (the un-snapped end-of-day physics target).
    """
    xe, im = F.col("eod_target"), F.col("implied_move")
    radius = F.greatest(pc.snap_radius_im * im, F.lit(pc.snap_grid))
    near = F.filter("ladder", lambda e: (e["gex"] > 0) & (F.abs(e["strike"] - xe) <= radius))
    # heaviest first, ties to the lowest strike
    best = F.element_at(F.array_sort(F.transform(near, lambda e: F.struct((-e["mass"]).alias("m"), e["strike"].alias("k")))), 1)
    d = df.withColumns({"snap_radius": radius, "_near": near})
    d = d.withColumn("_b", F.when(F.size("_near") > 0, best)).drop("_near")
    mass, k = -F.col("_b.m"), F.col("_b.k")
    share = mass / (F.col("band_mass_share") + EPS)
    hit = share >= pc.snap_min_share
    ramp = time_ramp(F.col("minutes_to_close"), pc.snap_full_minutes, max(pc.snap_ramp_minutes, 1e-3))
    prox = 1.0 - F.least(F.abs(k - xe) / radius, F.lit(1.0))
    strength = (F.least(F.lit(1.0), share / (2.0 * pc.snap_min_share)) * (0.35 + 0.65 * ramp) * (0.5 + 0.5 * prox)
                * F.when(F.col("regime") == "negative_gamma", pc.neg_damping).otherwise(1.0))
    d = d.withColumns({"time_ramp": ramp, "pin_strike": F.when(hit, to_grid(k, pc.snap_grid)),
                       "pin_mass": F.when(hit, mass).otherwise(0.0),
                       "pin_strength": F.coalesce(F.when(hit, strength), F.lit(0.0))}).drop("_b")
    snap = F.lit(pc.snap_enabled) & F.col("pin_strike").isNotNull()
    return d.withColumns({
        "snap_applied": snap, "eod_unsnapped": xe, "pin_mass": F.coalesce("pin_mass", F.lit(0.0)),
        "eod_target": F.when(snap, (1.0 - F.col("pin_strength")) * xe + F.col("pin_strength") * F.col("pin_strike")).otherwise(xe)})


def targets(state: DataFrame, consensus: DataFrame | None = None, pc: PhysicsConfig = PC, horizons=FC.horizons) -> DataFrame:
    """Physics target and gravity per (snapshot, horizon) plus the pin fields.

    ``consensus`` (snapshot keys, horizon, start) gives the starting prices; absent or NULL ones start at spot.
    """
    d = horizon_scales(horizon_rows(state, horizons), pc)
    if consensus is not None:
        d = d.join(consensus.select(*SNAP, "horizon", F.col("start").alias("_s")), [*SNAP, "horizon"], "left")
        d = d.withColumn("start", F.coalesce("_s", "spot")).drop("_s")
    else:
        d = d.withColumn("start", F.col("spot"))
    d = mean_shift(gravity(d), pc)
    eod = F.max(F.when(F.col("horizon_min").isNull(), F.col("physics_target"))).over(_snap())
    d = eod_pin(d.withColumn("eod_target", eod), pc)
    return d.withColumn("physics_target", F.when(F.col("horizon_min").isNull(), F.col("eod_target"))
                        .otherwise(F.col("physics_target")))
