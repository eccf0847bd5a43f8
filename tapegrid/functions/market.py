"""Column expressions of the market domain: side and type spelling, scales, greeks."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tapegrid.config import FAMILIES
from tapegrid.functions.nulls import clip

INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)

# Two conventions for option time: trading minutes with a rate, calendar minutes without.
TRADING_YEAR, TRADING_RATE = 252.0 * 390.0, 0.045
CALENDAR_YEAR, CALENDAR_RATE = 365.0 * 24.0 * 60.0, 0.0


def side_sign(side: Column) -> Column:
    s = F.lower(side)
    return F.when(s.isin("ask", "buy"), 1.0).when(s.isin("bid", "sell"), -1.0).otherwise(0.0)


def side_label(side: Column) -> Column:
    """buy/sell spelling of old files -> ask/bid."""
    s = F.lower(side)
    return F.when(s == "buy", "ask").when(s == "sell", "bid").otherwise(s)


def type_letter(option_type: Column) -> Column:
    return F.upper(F.substring(option_type, 1, 1))


def type_sign(option_type: Column) -> Column:
    t = type_letter(option_type)
    return F.when(t == "C", 1.0).when(t == "P", -1.0).otherwise(0.0)


def tick_side(close: Column, prev: Column, two_way: bool = False) -> Column:
    """Tick rule. The two-way variant has no 'mid': not below the previous close is ask."""
    if two_way:
        return F.when(F.coalesce(close - prev, F.lit(0.0)) >= 0, "ask").otherwise("bid")
    return F.when(close > prev, "ask").when(close < prev, "bid").otherwise("mid")


def signed_volume(side: Column, v: Column) -> Column:
    return F.when(side == "ask", v).when(side == "bid", -v).otherwise(0.0)


def size_class(size: Column) -> Column:
    return F.when(size >= 500, "block").otherwise("regular")


def contract_ticker(symbol: Column, expiry: Column, kind: Column, strike: Column) -> Column:
    """OCC-style ticker with the strike in thousandths, eight digits."""
    return F.concat(F.lit("O:"), symbol, F.date_format(expiry, "yyMMdd"), kind,
                    F.lpad(F.bround(strike * 1000).cast("bigint").cast("string"), 8, "0"))


def family(name: Column) -> Column:
    out = None
    for label, pattern in FAMILIES:
        hit = name.rlike("(?i)" + pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("Other")


def magnitude(excursion: Column, baseline: Column) -> Column:
    """0-10 scale: doubling the ratio to the baseline halves the distance to 10."""
    ratio = excursion / F.greatest(baseline, F.lit(1e-6))
    m = 10.0 * (1.0 - F.pow(F.lit(2.0), -F.greatest(ratio, F.lit(0.0))))
    return F.when(excursion.isNotNull() & baseline.isNotNull(), F.bround(clip(m, 0.0, 10.0), 1))


def magnitude_to_move(mag: Column, baseline: Column) -> Column:
    return -F.log2(1.0 - clip(mag, 0.0, 9.99) / 10.0) * baseline


def time_ramp(minutes: Column, center: float, width: float) -> Column:
    """Falling logistic in minutes to close, exponent clipped to +-60."""
    return 1.0 / (1.0 + F.exp(clip((minutes - center) / width, -60.0, 60.0)))


def to_grid(x: Column, step: float) -> Column:
    """Nearest multiple of ``step``, halves to even."""
    return F.bround(x / F.lit(step)) * F.lit(step)


def year_fraction(minutes: Column, floor_minutes: float, year: float) -> Column:
    return F.greatest(minutes, F.lit(float(floor_minutes))) / year


def _d1(s, k, t, vol, rate):
    return (F.log(s / k) + (F.lit(rate) + 0.5 * vol * vol) * t) / (vol * F.sqrt(t))


def _phi(x: Column) -> Column:
    return F.exp(-0.5 * x * x) * INV_SQRT_2PI


def _valid(s, k, t, vol) -> Column:
    return (s > 0) & (k > 0) & (t > 0) & (vol > 0)


def bs_gamma(s: Column, k: Column, t: Column, vol: Column, rate: float = 0.0) -> Column:
    g = _phi(_d1(s, k, t, vol, rate)) / (s * vol * F.sqrt(t))
    return F.when(_valid(s, k, t, vol), g)


def bs_vanna(s: Column, k: Column, t: Column, vol: Column, rate: float = 0.0) -> Column:
    d1 = _d1(s, k, t, vol, rate)
    return F.when(_valid(s, k, t, vol), -_phi(d1) * (d1 - vol * F.sqrt(t)) / vol)


def bs_charm(s: Column, k: Column, t: Column, vol: Column, rate: float = 0.0) -> Column:
    d1 = _d1(s, k, t, vol, rate)
    root = vol * F.sqrt(t)
    return F.when(_valid(s, k, t, vol),
                  -_phi(d1) * (2.0 * rate * t - (d1 - root) * root) / (2.0 * t * root))
