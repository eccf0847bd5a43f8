"""End-to-end plans: the assembled feature frame, the training table, the set-based backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapegrid.config import FeatureConfig, SessionConfig
from tapegrid.functions.nulls import finite
from tapegrid.operators import (asof, evaluate as ev, features as fe, fusion as fu, grid as gr, ladder as ld, physics as ph,
                                scaling as sc, splits as sp, targets as tg)
from tapegrid.operators.windows import SESSION

FC = FeatureConfig()
KEYS = [*SESSION, "bar"]
CLOCK = ("minutes_since_open", "minutes_to_close", "session_frac", "session_sin", "session_cos", "dow")


def build_features(ticks: DataFrame, ladder: DataFrame | None, prints: DataFrame | None, cfg: SessionConfig, fc: FeatureConfig = FC,
                   candles: bool = True, lags: bool = True, premium_scope: str = "causal", store=lambda d: d) -> DataFrame:
    """Every causal feature block on one grid, one row per (symbol, session_date, bar).

    Base features keep NULL, extra blocks (candles, lags) read 0 where nothing is known. All blocks are
    bar-level tables keyed like the grid; the raw feeds are only ever aggregated. ``store`` (for example
    plans.session.materialise) keeps the reduced tables, so each raw feed is aggregated once however
    many blocks read it.
    """
    bars = store(gr.ticks_to_bars(ticks, cfg))
    grid = gr.with_clock(gr.fill_grid(bars, cfg), cfg)
    d = fe.prior_session(fe.price_context(grid, cfg, fc))
    spine = grid.select(*KEYS, "spot")
    if ladder is not None:
        rows = ld.with_spot(store(ld.strike_rows(ladder, cfg)), spine)
        gex = ld.grid_metrics(spine.drop("spot"), ld.snapshot_metrics(rows, fc), cfg, fc)
        prem = fe.premium_block(spine, fe.bar_premium(ladder, spine, cfg, premium_scope), fc).drop("spot")
        d = d.join(gex, KEYS, "left").join(prem, KEYS, "left")
    if prints is not None:
        d = d.join(fe.block_sweep(spine, fe.bar_flow(prints, cfg), fc).drop("spot"), KEYS, "left")
    if candles and "volume" in bars.columns:
        d = gr.onto_grid(d, fe.candle_block(bars), fe.CANDLE_COLS)
    if ladder is not None and prints is not None:
        d = fe.availability_flags(d)
    d = fe.apply_blocks(d)
    return fe.lag_block(d, fc) if lags else d


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs: every numeric column that is not a key, price or target."""
    skip = {*KEYS, "spot", "age_min", "split", "ts"}
    return [c for c, t in df.dtypes if c not in skip and not c.startswith("y_") and t in ("double", "float", "int", "bigint")]


def training_table(features: DataFrame, cfg: SessionConfig, store=lambda d: d):
    """Targets, chronological split and train-only scaling. Returns (table, scaler parameters, columns).

    ``store`` keeps the features once (plans.session.materialise): they are read by the fit and the transform.
    """
    cols = feature_columns(features)
    d = tg.horizon_targets(features, cfg)
    d = store(sp.with_split(d, sp.chrono_split(sp.session_dates(d))))
    params = store(sc.fit_scaler(d.filter("split = 'train'"), cols, store=store))
    ys = [c for c in d.columns if c.startswith("y_")]
    return sc.transform(d, params, cols, [*KEYS, "split", "spot", *ys]), params, cols


def backtest_signals(ticks: DataFrame, ladder: DataFrame, predictions: DataFrame, cfg: SessionConfig, cadence_rows: int = 1,
                     kind: str = "retn", learned: DataFrame | None = None, lookback: int = 60, premium_scope: str = "causal",
                     store=lambda d: d) -> DataFrame:
    """Set-based replay: as-of ladder per bar x predictions -> physics -> fusion -> realised direction.

    ``predictions``: (symbol, session_date, bar, horizon, lgb, cat, q10, q50, q90). ``cadence_rows`` keeps
    every n-th bar as a decision point, as the live cycle does. A session's first ``lookback`` - 1 bars only warm up, and a
    session of fewer than ``lookback`` + 5 bars decides nothing. The flow z-score is that of the five-minute premium velocity (0 where
    unknown). Masses belong to a snapshot and are computed once for it; a bar whose newest snapshot has under three strikes decides nothing.
    """
    if cfg.length // cfg.bar_minutes + 1 < lookback + 5:
        raise ValueError(f"a session has fewer than lookback + 5 = {lookback + 5} bars")
    grid = store(fe.price_context(gr.session_grid(ticks, cfg), cfg))
    spine = grid.select(*KEYS, "spot")
    flow = fe.premium_block(spine, fe.bar_premium(ladder, spine, cfg, premium_scope), FC).select(
        *KEYS, F.coalesce(finite(F.col("net_prem_vel_z_5m")), F.lit(0.0)).alias("net_prem_z"))
    g = grid.filter("spot is not null")
    t = tg.horizon_targets(g, cfg)
    decides = F.col("spot").isNotNull() & (F.col("bar") >= (lookback - 1) * cfg.bar_minutes) & (F.col("bar") % (cadence_rows * cfg.bar_minutes) == 0)
    points = grid.join(flow, KEYS).select(*KEYS, "spot", "rv_1m", "minutes_to_close", "net_prem_z")
    cols = (*ld.LEVELS, "call_vol", "put_vol")
    snaps = ph.attractor_masses(ph.ladder_state(ld.strike_rows(ladder, cfg, cols)))
    snaps = store(snaps.withColumn("_n", F.count("strike").over(Window.partitionBy(*KEYS))))
    at = asof.snapshot_asof(points, snaps, where=decides).filter("_n >= 3").drop("_n")
    state = store(ph.profile(ph.implied_move(at)))
    d = ph.horizon_rows(state).drop("horizon_no").join(predictions, [*KEYS, "horizon"], "left")
    d = fu.expert_prices(d, kind)
    phys = ph.targets(state, d.select(*KEYS, "horizon", F.col("consensus").alias("start")))
    d = d.join(phys.select(*KEYS, "horizon", F.col("physics_target").alias("x_physics"), "gravity", "pin_strike",
                           F.when(F.col("horizon") == "eod", F.col("pin_strength")).otherwise(0.0).alias("pin_strength")), [*KEYS, "horizon"])
    out = fu.fuse(fu.gate(d, learned=learned))
    real = t.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y_price_{h}").alias("realized"))
                                                for h, _ in FC.horizons])).alias("r"), F.col("y_price_eod").alias("eod_close"))
    real = real.select(*KEYS, "r.horizon", "r.realized", "eod_close")
    return ev.signal_table(out.join(real, [*KEYS, "horizon"], "left"))
