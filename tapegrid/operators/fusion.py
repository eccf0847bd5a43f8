"""Expert fusion: one row per (bar, horizon), everything a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapegrid.config import EPS, EXPERTS, GateConfig, RiskConfig
from tapegrid.functions.market import time_ramp, to_grid
from tapegrid.functions.nulls import clip, mean_of
from tapegrid.operators.quantiles import attach_domain

GC = GateConfig()
W = tuple(f"w_{e}" for e in EXPERTS)
X = tuple(f"x_{e}" for e in EXPERTS)


def _minutes() -> Column:
    return F.coalesce("horizon_min", F.greatest(F.col("minutes_to_close"), F.lit(1.0)))


def to_price(value: Column, kind: str) -> Column:
    """Model output -> price by target kind."""
    s = F.col("spot")
    if kind == "price":
        return value
    if kind == "dprice":
        return s + value
    r = value if kind == "ret" else value * F.col("rv_1m") * F.sqrt(_minutes())
    return s * F.exp(clip(r, -0.2, 0.2))


def expert_prices(df: DataFrame, kind: str = "retn") -> DataFrame:
    """lgb, cat, q10, q50, q90 -> x_lgb, x_cat, x_tft (mid of the band when q50 is missing) and the band."""
    d = df.withColumns({"x_lgb": to_price(F.col("lgb"), kind), "x_cat": to_price(F.col("cat"), kind),
                        "tft_lo": to_price(F.col("q10"), kind), "tft_hi": to_price(F.col("q90"), kind)})
    d = d.withColumn("x_tft", F.coalesce(to_price(F.col("q50"), kind), 0.5 * (F.col("tft_lo") + F.col("tft_hi"))))
    return d.withColumn("consensus", F.coalesce(mean_of("x_lgb", "x_cat", "x_tft"), F.col("spot")))


def prior_weights(df: DataFrame, gc: GateConfig = GC, priors=None) -> DataFrame:
    """Horizon priors; end-of-day shifts mass to the physics expert as the close nears and the pin strengthens."""
    table = priors or gc.priors
    out = {}
    for j, w in enumerate(W):
        c = None
        for h, *p in table:
            v = p[j] / sum(p)
            c = F.when(F.col("horizon") == h, v) if c is None else c.when(F.col("horizon") == h, v)
        out[w] = c
    d = df.withColumns(out)
    ramp = time_ramp(F.col("minutes_to_close"), gc.ramp_center, gc.ramp_steepness)
    w3 = F.col(W[3])
    phys = F.least(F.lit(1.0), w3 + (gc.eod_physics_max - w3) * ramp + gc.pin_boost * F.coalesce("pin_strength", F.lit(0.0)) * ramp)
    others = F.col(W[0]) + F.col(W[1]) + F.col(W[2]) + EPS
    eod = F.col("horizon") == "eod"
    return d.withColumns({**{w: F.when(eod, F.col(w) / others * (1.0 - phys)).otherwise(F.col(w)) for w in W[:3]},
                          W[3]: F.when(eod, phys).otherwise(w3)})


def learned_weights(df: DataFrame, learned: DataFrame, horizons: list[str], gc: GateConfig = GC) -> DataFrame:
    """Shrink toward learned weights (horizon, n, l_lgb, l_cat, l_tft, l_physics) by n / (n + n0)."""
    names = [f"l_{e}" for e in EXPERTS]
    d = attach_domain(df, learned, "horizon", horizons, ["n", *names])
    a = F.coalesce(F.col("n") / (F.col("n") + gc.shrink_rows), F.lit(0.0))
    mixed = {w: (1.0 - a) * F.col(w) + a * F.coalesce(F.col(n), F.lit(0.0)) for w, n in zip(W, names)}
    return d.withColumns({"alpha_learned": a, **mixed}).drop("n", *names)


def regime_adjust(df: DataFrame, gc: GateConfig = GC) -> DataFrame:
    """Extreme premium flow: deep expert off, physics cut, the freed mass goes to the trees."""
    hot = F.coalesce(F.abs(F.col("net_prem_z")) >= gc.high_z, F.lit(False))
    floor = F.when(F.col("horizon") == "eod", gc.high_eod_floor).otherwise(0.0)
    w = [F.col(c) for c in W]
    phys = F.greatest(w[3] * gc.high_physics, floor)
    freed = (w[2] - gc.high_deep) + (w[3] - phys)
    trees = w[0] + w[1]
    new = [w[0] + freed * (w[0] / (trees + EPS)), w[1] + freed * (w[1] / (trees + EPS)), F.lit(gc.high_deep), phys]
    total = new[0] + new[1] + new[2] + new[3] + EPS
    d = df.withColumn("high_vol_fallback", hot)
    return d.withColumns({c: F.when(hot, n / total).otherwise(F.col(c)) for c, n in zip(W, new)})


def available_weights(df: DataFrame) -> DataFrame:
    """Weights over the experts that produced a value; equal when their weight is zero."""
    on = [F.col(x).isNotNull() for x in X]
    raw = [F.when(o, F.col(w)).otherwise(0.0) for o, w in zip(on, W)]
    total = raw[0] + raw[1] + raw[2] + raw[3]
    n = on[0].cast("int") + on[1].cast("int") + on[2].cast("int") + on[3].cast("int")
    return df.withColumns({w: F.when(total <= EPS, o.cast("double") / (n + EPS)).otherwise(r / (total + EPS))
                           for w, o, r in zip(W, on, raw)})


def fuse(df: DataFrame, gc: GateConfig = GC, snap: bool = False) -> DataFrame:
    """Target, confidence, direction and band of each (bar, horizon). Needs x_*, w_*, spot, implied_move, rv_1m."""
    xs, ws = [F.col(x) for x in X], [F.col(w) for w in W]
    s, im = F.col("spot"), F.col("implied_move")
    z = F.lit(0.0)
    total = sum((F.coalesce(x * w, z) for x, w in zip(xs, ws)), z)
    any_on = F.coalesce(*xs).isNotNull()
    d = df.withColumn("raw_target", F.when(any_on, total).otherwise(s))
    t = F.col("raw_target")
    if snap:
        k = F.col("pin_strength") * ws[3]
        near = (F.col("horizon") == "eod") & F.col("snap_applied") & (F.abs(t - F.col("pin_strike")) <= F.col("snap_radius"))
        d = d.withColumn("fused", F.when(near, (1.0 - k) * t + k * F.col("pin_strike")).otherwise(t))
    else:
        d = d.withColumn("fused", t)
    f = F.col("fused")
    spread = F.greatest(*xs) - F.least(*xs)
    agree = F.exp(-spread / (gc.disagreement_im * im + EPS))
    band = F.col("tft_hi") - F.col("tft_lo")
    band_pen = F.coalesce(F.exp(-band / (2.0 * im + EPS)), F.lit(0.8))
    square = sum((w * w for w in ws), z)
    half = F.coalesce(0.5 * band, 1.2816 * s * F.col("rv_1m") * F.sqrt(_minutes()))
    delta = f - s
    # the results leave through a generator: filters on them stay above it instead of being
    # rewritten, with every weight expression inlined, below the projections
    res = F.struct(
        to_grid(f, gc.report_grid).alias("target"), delta.alias("delta"),
        F.when(F.abs(delta) > gc.deadband_im * im, F.signum(delta)).otherwise(0.0).cast("int").alias("direction"),
        clip(0.5 * F.coalesce(agree, F.lit(1.0)) + 0.25 * square + 0.25 * band_pen, 0.0, 1.0).alias("confidence"),
        (f - half).alias("band_lo"), (f + half).alias("band_hi"))
    return d.select("*", F.inline(F.array(res))).drop("raw_target", "fused")


def gate(df: DataFrame, gc: GateConfig = GC, learned: DataFrame | None = None, horizons: list[str] | None = None) -> DataFrame:
    d = prior_weights(df, gc)
    if learned is not None:
        d = learned_weights(d, learned, horizons or [h for h, *_ in gc.priors], gc)
    return available_weights(regime_adjust(d, gc))


def entries(fused: DataFrame, rc: RiskConfig = RiskConfig()) -> DataFrame:
    """Signals strong enough to enter, with stop, take profit and expiry minute."""
    s, im, mtc, side = F.col("spot"), F.col("implied_move"), F.col("minutes_to_close"), F.col("direction")
    last = F.coalesce(F.create_map(*[F.lit(x) for kv in rc.no_entry_minutes for x in kv])[F.col("horizon")], F.lit(5.0))
    d = fused.filter((side != 0) & (F.col("confidence") >= rc.min_confidence)
                     & (F.abs("delta") >= rc.min_delta_im * im) & (mtc > last))
    adverse = F.when(side > 0, s - F.col("band_lo")).otherwise(F.col("band_hi") - s)
    adverse = F.greatest(rc.min_stop_im * im, F.least(rc.max_stop_im * im, adverse))
    hold = F.coalesce(F.least(F.col("horizon_min"), mtc), mtc)
    return d.withColumns({"stop": s - side * adverse, "take": s + F.col("delta"), "contracts": F.lit(rc.contracts),
                          "expiry_bar": F.least(F.col("bar") + hold, F.col("bar") + mtc - rc.flat_minutes)})
