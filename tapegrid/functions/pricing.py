"""Normal distribution, option delta and implied volatility.

The distribution function is Hart's rational approximation (relative error about 1e-15), once as a column
expression and once on NumPy arrays. Implied volatility has no closed form: an Arrow UDF solves for the total
deviation ``vol * sqrt(t)`` of the out-of-the-money side, scaled by the geometric mean of forward and strike.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import DoubleType

#: Coefficients of Hart's approximation, highest power first.
TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SPLIT = 7.07106781186547


def _horner(x, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def _tail(x):
    """Continued fraction of the upper tail beyond SPLIT, without its density."""
    return 1.0 / (x + 1.0 / (x + 2.0 / (x + 3.0 / (x + 4.0 / (x + 0.65))))) / 2.506628274631


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function as a column expression. NULL in, NULL out."""
    a = F.abs(x)
    density = F.exp(-a * a / 2.0)
    upper = F.when(a > 37.0, 0.0).when(a < SPLIT, density * _horner(a, tuple(map(F.lit, TOP))) / _horner(a, tuple(map(F.lit, BOTTOM)))).otherwise(density * _tail(a))
    return F.when(x > 0, 1.0 - upper).otherwise(upper)


def cdf(x: np.ndarray) -> np.ndarray:
    """The same on arrays."""
    a = np.minimum(np.abs(x), 37.5)
    density = np.exp(-a * a / 2.0)
    upper = np.where(a < SPLIT, density * _horner(a, TOP) / _horner(a, BOTTOM), density * _tail(np.maximum(a, SPLIT)))
    return np.where(x > 0, 1.0 - upper, upper)


def option_delta(spot: Column, strike: Column, years: Column, vol: Column, call: Column, rate: float = 0.0) -> Column:
    """Sensitivity to spot; time and volatility are floored just above zero."""
    t = F.greatest(years, F.lit(1e-9))
    dev = F.greatest(vol, F.lit(1e-9)) * F.sqrt(t)
    up = normal_cdf((F.ln(spot / strike) + rate * t) / dev + vol * vol * t / (2.0 * dev))
    return F.when(F.coalesce(call, F.lit(False)), up).otherwise(up - 1.0)


def otm_value(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled value of the out-of-the-money side at log distance x <= 0 and total deviation w, and its slope in w."""
    up = x / w + w / 2
    return np.exp(x / 2) * cdf(up) - np.exp(-x / 2) * cdf(up - w), np.exp(x / 2 - up * up / 2) / math.sqrt(2 * math.pi)


def implied(price, spot, strike, years, call, rate=0.0, low=0.01, high=5.0, edge=1e-4, keep=False) -> np.ndarray:
    """Implied volatility within [low, high]. NaN for prices at or below intrinsic value and, unless ``keep``, for those that reach the ceiling.

    Newton steps on a bracket; a step that leaves it is replaced by the middle.
    """
    price, spot, strike, years, rate, call = np.broadcast_arrays(*(np.asarray(a, float) for a in (price, spot, strike, years, rate, call)))
    out = np.full(price.shape, np.nan)
    with np.errstate(invalid="ignore"):
        at = np.flatnonzero((np.minimum(np.minimum(spot, strike), years) > 0) & (price - np.maximum((2 * call - 1) * (spot - strike), 0) > edge))
    if not len(at):
        return out
    grown = np.exp(rate[at] * years[at])
    forward, k = spot[at] * grown, strike[at]
    inside = np.maximum((2 * call[at] - 1) * (forward - k), 0)
    goal = (price[at] * grown - inside) / np.sqrt(forward * k)
    x, root = -np.abs(np.log(forward / k)), np.sqrt(years[at])
    left, right = low * root, high * root
    w = np.clip(np.sqrt(2 * np.abs(x)) + 1e-3, left, right)  # where the value bends
    for _ in range(80):
        value, slope = otm_value(x, w)
        left, right = np.where(value < goal, w, left), np.where(value < goal, right, w)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            step = w - (value - goal) / slope
        new = np.where((step > left) & (step < right), step, (left + right) / 2)
        moved, w = np.abs(new - w).max(), new
        if moved < 1e-13:
            break
    vol = w / root
    out[at] = vol if keep else np.where(vol < high - 1e-3, vol, np.nan)
    return out


@F.pandas_udf(DoubleType())
def implied_vol(price: pd.Series, spot: pd.Series, strike: pd.Series, years: pd.Series, call: pd.Series, rate: pd.Series) -> pd.Series:
    out = pd.Series(implied(price, spot, strike, years, call.fillna(False), rate))
    return out.where(out.notna(), None).astype("float64")


@F.pandas_udf(DoubleType())
def implied_vol_bounded(price: pd.Series, spot: pd.Series, strike: pd.Series, years: pd.Series, call: pd.Series, rate: pd.Series) -> pd.Series:
    """The same with a smaller margin over intrinsic value; a price beyond the ceiling gives the ceiling."""
    out = pd.Series(implied(price, spot, strike, years, call.fillna(False), rate, edge=1e-6, keep=True))
    return out.where(out.notna(), None).astype("float64")


def register(spark: SparkSession) -> None:
    """Make implied volatility callable from SQL."""
    spark.udf.register("implied_vol", implied_vol)
    spark.udf.register("implied_vol_bounded", implied_vol_bounded)
