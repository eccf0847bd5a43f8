"""Causal feature blocks on the session grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapegrid.config import FeatureConfig, SessionConfig
from tapegrid.functions import clock
from tapegrid.functions.market import side_sign, type_sign
from tapegrid.functions.nulls import clip, safe_div
from tapegrid.operators.grid import onto_grid
from tapegrid.operators.windows import (SESSION, by_bar, by_day, diff, roll, rolling_z,
                                        second_diff, so_far, whole)

FC = FeatureConfig()


def _log_price() -> Column:
    return F.when(F.col("spot") > 0, F.log("spot"))


# ---------------------------------------------------------------- price
def price_context(grid: DataFrame, cfg: SessionConfig, fc: FeatureConfig = FC) -> DataFrame:
    """Log returns, realised volatility, position in the session range, distance to the running average."""
    w = by_bar()
    run = so_far(w)
    p = F.col("spot")
    d = grid.withColumn("_lp", _log_price())
    d = d.withColumns({
        **{f"ret_{k}m": diff("_lp", k) for k in (1, 5, 15, 30)},
        "ret_from_open": F.col("_lp") - F.first("_lp", ignorenulls=True).over(run),
        "_hi": F.max(p).over(run), "_lo": F.min(p).over(run),
        "_twap": F.sum(p).over(run) / (F.col("bar") / cfg.bar_minutes + 1.0)})
    return d.withColumns({
        "rv_1m": clip(roll("ret_1m", fc.rv_rows, "std", w, fc.rv_min), lo=fc.rv_floor),
        "session_range": F.col("_hi") - F.col("_lo"),
        "pos_in_session_range": clip(safe_div(p - F.col("_lo"), F.col("_hi") - F.col("_lo"), 0.5), 0.0, 1.0),
        "dist_to_session_high": F.col("_hi") - p, "dist_to_session_low": p - F.col("_lo"),
        "dist_to_twap": p - F.col("_twap")}).drop("_lp", "_hi", "_lo", "_twap")


def daily_table(grid: DataFrame) -> DataFrame:
    """First, last, high and low price of each session (order-safe)."""
    seen = F.when(F.col("spot").isNotNull(), F.col("bar"))
    return grid.groupBy(*SESSION).agg(
        F.min_by("spot", seen).alias("open"), F.max_by("spot", seen).alias("close"),
        F.max("spot").alias("high"), F.min("spot").alias("low"))


def prior_session_table(daily: DataFrame) -> DataFrame:
    """Values of earlier sessions only; the prior return is yesterday's close-to-close."""
    w = by_day()
    d = daily.withColumn("hist_prior_close", F.lag("close").over(w))
    d = d.withColumns({"_ret": F.log(F.col("close") / F.col("hist_prior_close")),
                       "_rng": (F.col("high") - F.col("low")) / F.col("close")})
    return d.select(*SESSION, "hist_prior_close", F.lag("_ret").over(w).alias("hist_prior_ret"),
                    F.lag("_rng").over(w).alias("hist_prior_range_pct"),
                    F.log(F.col("open") / F.col("hist_prior_close")).alias("hist_gap_pct"))


def prior_session(grid: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """Join the lagged daily table on (symbol, session): same key as every window, one small side shuffled."""
    hist = prior_session_table(daily if daily is not None else daily_table(grid))
    return (grid.join(hist, list(SESSION), "left")
            .withColumn("dist_to_prior_close", F.col("spot") - F.col("hist_prior_close")))


# ---------------------------------------------------------------- option premium
PREMIUM_COLS = ("call_prem_1m", "put_prem_1m", "otm_call_prem_1m", "otm_put_prem_1m", "net_prem_1m")


def strike_premium(ladder: DataFrame, cfg: SessionConfig) -> DataFrame:
    """Premium per (bar, strike), both raw and side-weighted. Raw rows combine map-side here."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    sided = [F.col(c).isNotNull() for c in ("call_ask_prem", "call_bid_prem", "put_ask_prem", "put_bid_prem")]
    ok = sided[0] & sided[1] & sided[2] & sided[3]
    return (ladder.withColumns({"session_date": clock.local_date(F.col("ts"), cfg.tz),
                                "bar": clock.ceil_bar(F.col("ts"), cfg)})
            .filter(F.col("bar").between(0, cfg.length))
            .groupBy(*SESSION, "bar", "strike").agg(
                F.count(F.lit(1)).alias("_n"), F.sum(ok.cast("int")).alias("_ok"),
                F.sum(z("call_ask_prem") - z("call_bid_prem")).alias("_sc"),
                F.sum(z("put_ask_prem") - z("put_bid_prem")).alias("_sp"),
                F.sum(z("call_prem")).alias("_rc"), F.sum(z("put_prem")).alias("_rp")))


def feed_switch(rows: DataFrame, scope: str = "causal") -> DataFrame:
    """Add flow_side_weighted = 1 when more than half of the rows carry all four side premiums.

    scope 'causal' decides on the session so far; 'session' and 'feed' look ahead, over the session and over everything.
    """
    share = lambda n, k: F.when(k / n > 0.5, 1.0).otherwise(0.0)
    if scope == "feed":
        one = rows.agg(share(F.sum("_n"), F.sum("_ok")).alias("flow_side_weighted"))
        return rows.crossJoin(F.broadcast(one))
    if scope == "causal":
        bars = rows.groupBy(*SESSION, "bar").agg(F.sum("_n").alias("n"), F.sum("_ok").alias("k"))
        run = so_far(by_bar())
        flag = bars.select(*SESSION, "bar", share(F.sum("n").over(run), F.sum("k").over(run)).alias("flow_side_weighted"))
        return rows.join(flag, [*SESSION, "bar"])
    # rows are (bar, strike) sums here: one session of them per partition
    w = Window.partitionBy(*SESSION)
    return rows.withColumn("flow_side_weighted", share(F.sum("_n").over(w), F.sum("_ok").over(w)))


def bar_premium(ladder: DataFrame, grid: DataFrame, cfg: SessionConfig, scope: str = "causal") -> DataFrame:
    """Per-bar call, put, out-of-the-money and net premium."""
    at = strike_premium(ladder, cfg).join(grid.select(*SESSION, "bar", "spot"), [*SESSION, "bar"])
    at = feed_switch(at, scope)
    on = F.col("flow_side_weighted") > 0
    at = at.withColumns({"sc": F.when(on, F.col("_sc")).otherwise(F.col("_rc")),
                         "sp": F.when(on, F.col("_sp")).otherwise(F.col("_rp"))})
    return at.groupBy(*SESSION, "bar").agg(
        F.sum("sc").alias("call_prem_1m"), F.sum("sp").alias("put_prem_1m"),
        F.sum(F.when(F.col("strike") > F.col("spot"), F.col("sc")).otherwise(0.0)).alias("otm_call_prem_1m"),
        F.sum(F.when(F.col("strike") < F.col("spot"), F.col("sp")).otherwise(0.0)).alias("otm_put_prem_1m"),
        F.sum(F.col("sc") - F.col("sp")).alias("net_prem_1m"),
        F.max("flow_side_weighted").alias("flow_side_weighted"))


def premium_block(grid: DataFrame, premium: DataFrame, fc: FeatureConfig = FC) -> DataFrame:
    """Net premium sums, z-scores, velocities, call/put ratio and out-of-the-money acceleration."""
    w = by_bar()
    d = onto_grid(grid, premium, PREMIUM_COLS)
    d = d.withColumns({
        "flow_side_weighted": F.coalesce(F.last("flow_side_weighted", ignorenulls=True).over(so_far(w)), F.lit(0.0)),
        **{f"net_prem_{n}m": roll("net_prem_1m", n, "sum") for n in fc.flow_rows},
        "net_prem_cum_session": F.sum("net_prem_1m").over(so_far(w)),
        "call_put_prem_ratio_15m": clip(safe_div(roll("call_prem_1m", 15, "sum"), F.abs(roll("put_prem_1m", 15, "sum"))),
                                        -fc.ratio_clip, fc.ratio_clip),
        "_oc": roll("otm_call_prem_1m", fc.otm_rows, "sum"), "_op": roll("otm_put_prem_1m", fc.otm_rows, "sum")})
    d = d.withColumns({
        **{f"net_prem_z_{n}m": rolling_z(f"net_prem_{n}m", fc.z_rows, fc.z_min, fc.z_clip) for n in fc.flow_rows},
        **{f"net_prem_vel_{n}m": diff(f"net_prem_{n}m", 1) for n in fc.flow_rows},
        "otm_call_accel": second_diff("_oc"), "otm_put_accel": second_diff("_op")})
    ac, ap = F.col("otm_call_accel"), F.col("otm_put_accel")
    one = lambda c: F.coalesce(F.abs(c), F.lit(0.0)) + 1.0
    return d.withColumns({
        **{f"net_prem_vel_z_{n}m": rolling_z(f"net_prem_vel_{n}m", fc.z_rows, fc.z_min, fc.z_clip)
           for n in fc.flow_rows},
        "otm_skew_momentum": clip(safe_div(ac - ap, F.abs(ac) + F.abs(ap)), -1.0, 1.0),
        "otm_skew_log_ratio": F.log(one(ac) / one(ap)) * F.signum(F.coalesce(ac - ap, F.lit(0.0))),
        "otm_skew_level": clip(safe_div(F.col("_oc") - F.col("_op"), F.abs("_oc") + F.abs("_op")), -1.0, 1.0),
    }).drop("_oc", "_op")


# ---------------------------------------------------------------- trade prints
FLOW_COLS = ("blk", "dark", "swp", "all_prem", "sblk")


def bar_flow(prints: DataFrame, cfg: SessionConfig) -> DataFrame:
    """Per-bar block, dark-pool, sweep, total and signed-block premium in one conditional aggregation."""
    kind = F.lower("trade_type")
    prem = F.coalesce("premium", F.lit(0.0))
    blk = F.when(kind.isin("block", "dark_pool"), prem).otherwise(0.0)
    return (prints.withColumns({"session_date": clock.local_date(F.col("ts"), cfg.tz),
                                "bar": clock.ceil_bar(F.col("ts"), cfg)})
            .filter(F.col("bar").between(0, cfg.length))
            .groupBy(*SESSION, "bar").agg(
                F.sum(blk).alias("blk"), F.sum(F.when(kind == "dark_pool", prem).otherwise(0.0)).alias("dark"),
                F.sum(F.when(kind == "sweep", prem).otherwise(0.0)).alias("swp"), F.sum(prem).alias("all_prem"),
                F.sum(blk * side_sign(F.col("side")) * type_sign(F.col("option_type"))).alias("sblk")))


def block_sweep(grid: DataFrame, flow: DataFrame, fc: FeatureConfig = FC) -> DataFrame:
    """Institutional block weight, dark-pool share, block-versus-sweep z-score and signed bias."""
    n = fc.block_rows
    d = onto_grid(grid, flow, FLOW_COLS)
    d = d.withColumns({f"_{c}": roll(c, n, "sum") for c in FLOW_COLS})
    blk, swp = F.col("_blk"), F.col("_swp")
    d = d.withColumn("_gap", blk - swp)
    return d.withColumns({
        "block_notional_15m": blk, "sweep_notional_15m": swp,
        "inst_block_weight": clip(safe_div(blk, blk + swp), 0.0, 1.0),
        "dark_pool_share": clip(safe_div(F.col("_dark"), F.col("_all_prem")), 0.0, 1.0),
        "block_vs_sweep_z": rolling_z("_gap", fc.z_rows, fc.z_min, fc.z_clip),
        "block_signed_bias": clip(safe_div(F.col("_sblk"), blk), -1.0, 1.0),
    }).drop("_gap", *[f"_{c}" for c in FLOW_COLS], *FLOW_COLS)


# ---------------------------------------------------------------- candles, volume, lags
CANDLE_COLS = ("bar_range_bp", "bar_body_frac", "upper_wick_frac", "lower_wick_frac", "vol_avg_30", "vol_z_30",
               "vol_ratio_session", "vol_cum_frac")


def candle_block(bars: DataFrame) -> DataFrame:
    """Candle shape and volume on the raw bars (gaps matter), before they reach the grid."""
    w = by_bar()
    run = so_far(w)
    rng = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    v = F.col("volume")
    total = bars.groupBy(*SESSION).agg(F.sum("volume").alias("_tot"))
    prior = total.select(*SESSION, F.lag("_tot").over(by_day()).alias("_prior"))
    top, bottom = F.greatest("open", "spot"), F.least("open", "spot")
    q = lambda a, b: F.when(b != 0, a / b)
    d = bars.join(prior, list(SESSION), "left")
    return d.select(
        *SESSION, "bar",
        (rng / F.col("spot") * 1e4).alias("bar_range_bp"),
        clip((F.col("spot") - F.col("open")) / rng, -1.0, 1.0).alias("bar_body_frac"),
        clip((F.col("high") - top) / rng, 0.0, 1.0).alias("upper_wick_frac"),
        clip((bottom - F.col("low")) / rng, 0.0, 1.0).alias("lower_wick_frac"),
        roll(v, 30, "mean", w, 5).alias("vol_avg_30"),
        q(v - roll(v, 30, "mean", w, 5), roll(v, 30, "std", w, 5)).alias("vol_z_30"),
        q(v, F.avg(v).over(run)).alias("vol_ratio_session"),
        q(F.sum(v).over(run), F.col("_prior")).alias("vol_cum_frac"))


def lag_block(feats: DataFrame, fc: FeatureConfig = FC) -> DataFrame:
    """Lagged returns and changes of the book state, all lags in one select (one sort, one window node)."""
    w = by_bar()
    have = set(feats.columns)
    lp = _log_price()
    d = feats.withColumn("_lp", lp)
    new: dict[str, Column] = {f"ret_{k}m": F.col("_lp") - F.lag("_lp", k).over(w)
                              for k in fc.lag_return_rows if f"ret_{k}m" not in have}
    for c in fc.lag_state_columns:
        if c in have:
            new.update({f"{c}_d{k}m": F.col(c) - F.lag(c, k).over(w) for k in fc.lag_state_rows})
    return d.withColumns(new).drop("_lp").fillna(0.0, subset=list(new))


# ---------------------------------------------------------------- extension point
_BLOCKS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_block(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Add a feature block applied to the assembled frame by ``apply_blocks``."""
    _BLOCKS[name] = fn


def apply_blocks(df: DataFrame) -> DataFrame:
    for fn in _BLOCKS.values():
        df = df.transform(fn)
    return df


def availability_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"has_gex_snapshot": F.col("gex_net_total").isNotNull().cast("double"),
                           "has_flow_prints": F.col("inst_block_weight").isNotNull().cast("double")})


