"""Session, feature, physics and gate parameters.

Fixed values: the numbers below define the results (window lengths, thresholds,
priors) and must stay as they are for results to be comparable.
"""

from __future__ import annotations

from dataclasses import dataclass

EPS = 1e-9


@dataclass(frozen=True)
class SessionConfig:
    """Clock of one trading session. Minutes are local minutes of the day."""

    tz: str = "America/New_York"
    open_minute: int = 570
    close_minute: int = 960
    bar_minutes: int = 1
    snap_minutes: int = 5

    @property
    def length(self) -> int:
        return self.close_minute - self.open_minute

    def rows(self, minutes: int) -> int:
        """Number of grid rows that span ``minutes``."""
        return max(1, minutes // self.bar_minutes)


@dataclass(frozen=True)
class FeatureConfig:
    spot_band: float = 3.0
    top_k: int = 3
    decay_rows: tuple[int, ...] = (5, 15)
    flow_rows: tuple[int, ...] = (5, 15)
    z_rows: int = 60
    z_min: int = 20
    otm_rows: int = 5
    block_rows: int = 15
    rv_rows: int = 30
    rv_min: int = 5
    rv_floor: float = 1e-4
    ratio_clip: float = 50.0
    z_clip: float = 8.0
    horizons: tuple[tuple[str, int | None], ...] = (
        ("5m", 5), ("15m", 15), ("30m", 30), ("1h", 60), ("eod", None))
    lag_return_rows: tuple[int, ...] = (1, 5, 10, 15, 20, 25, 30, 40, 50)
    lag_state_rows: tuple[int, ...] = (5, 10, 15, 20, 30, 50)
    lag_state_columns: tuple[str, ...] = (
        "gex_net_total", "gex_abs_total", "gex_band_net", "gex_dist_to_zero",
        "gex_wall_above_dist", "gex_wall_below_dist", "gex_pos_centroid_dist",
        "net_prem_cum_session", "otm_skew_level", "iv_call_atm", "iv_put_atm",
        "iv_skew_atm", "straddle_pct", "vanna_band_net", "charm_band_net", "rv_1m")


# The trainer's wider horizon set, with its own gate priors (lgb, cat, deep, physics).
LONG_HORIZONS = (("5m", 5), ("10m", 10), ("20m", 20), ("40m", 40), ("60m", 60), ("eod", None))
EXPERTS = ("lgb", "cat", "tft", "physics")


@dataclass(frozen=True)
class PhysicsConfig:
    top_clusters: int = 5
    merge_points: float = 1.0
    valley_ratio: float = 0.6
    w_gex: float = 0.60
    w_oi: float = 0.25
    w_vol: float = 0.15
    band_points: float = 3.0
    sigma_floor: float = 0.35
    sigma_im: float = 0.60
    anchor_mass: float = 0.35
    shift_iters: int = 40
    shift_tol: float = 1e-4
    snap_enabled: bool = False
    snap_grid: float = 0.5
    snap_radius_im: float = 0.35
    snap_min_share: float = 0.22
    snap_full_minutes: float = 30.0
    snap_ramp_minutes: float = 10.0
    neg_damping: float = 0.55
    neg_sigma: float = 1.6
    mass_decay: float = 0.55


@dataclass(frozen=True)
class GateConfig:
    # horizon, then the prior weight of each expert in EXPERTS order
    priors: tuple[tuple[str, float, float, float, float], ...] = (
        ("5m", 0.40, 0.35, 0.15, 0.10), ("15m", 0.38, 0.32, 0.20, 0.10),
        ("30m", 0.20, 0.15, 0.50, 0.15), ("1h", 0.15, 0.12, 0.53, 0.20),
        ("eod", 0.15, 0.10, 0.30, 0.45))
    eod_physics_max: float = 0.85
    ramp_center: float = 30.0
    ramp_steepness: float = 8.0
    pin_boost: float = 0.5
    high_z: float = 3.0
    high_deep: float = 0.0
    high_physics: float = 0.5
    high_eod_floor: float = 0.30
    ridge_alpha: float = 5.0
    shrink_rows: float = 60.0
    min_rows: int = 30
    disagreement_im: float = 0.35
    deadband_im: float = 0.05
    report_grid: float = 0.01


@dataclass(frozen=True)
class RiskConfig:
    min_confidence: float = 0.55
    min_delta_im: float = 0.08
    contracts: int = 2
    no_entry_minutes: tuple[tuple[str, float], ...] = (
        ("5m", 6.0), ("15m", 16.0), ("30m", 31.0), ("1h", 61.0), ("eod", 12.0))
    flat_minutes: float = 2.0
    min_stop_im: float = 0.12
    max_stop_im: float = 1.50


@dataclass(frozen=True)
class CostConfig:
    premium_mult: float = 0.40
    min_premium: float = 0.05
    spread_pct: float = 0.04
    min_spread: float = 0.02
    slip_per_side: float = 0.01
    commission: float = 0.65
    fees: float = 0.05
    atm_delta: float = 0.50
    multiplier: float = 100.0


# Weight of each horizon in the board score; unknown horizons count 0.05.
SCORE_WEIGHTS = {"5m": 0.30, "10m": 0.30, "15m": 0.25, "30m": 0.25,
                 "1h": 0.08, "60m": 0.08, "eod": 0.02}
DEFAULT_SCORE_WEIGHT = 0.05

# Feature families, first matching pattern wins.
FAMILIES = (
    ("Lags / deltas (trees only)", r"_d\d+m$|^ret_(10|20|25|40|50)m$"),
    ("GEX / gamma book", r"gex|gamma"),
    ("Greeks (vanna/charm)", r"vanna|charm"),
    ("Implied vol", r"\biv_|_iv\b|implied|skew"),
    ("Premium / flow $", r"prem"),
    ("Open interest", r"_oi\b|open_int"),
    ("Option volume", r"call_vol|put_vol|opt_vol"),
    ("Tape flow prints", r"flow|aggress|sweep"),
    ("Pin / max-pain", r"pin|max_pain|magnet"),
    ("Candle / volume / VWAP", r"open|high|low|close|volume|vwap|trades|candle|body|wick|range"),
    ("Momentum / trend", r"rsi|macd|ema|sma|mom|slope|trend|ret_|retn"),
    ("Volatility / realised", r"rv_|realis|realiz|atr|sigma|vol_"),
    ("Session clock", r"minutes|session|time_|sin_|cos_|opex|witch"),
)

# Columns of the lag block, kept out of sequence windows.
SEQUENCE_EXCLUDE = r"_d\d+m$|^ret_(10|20|25|40|50)m$"
