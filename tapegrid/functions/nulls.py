"""NULL discipline: NaN and infinities become NULL, divisions are guarded."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tapegrid.config import EPS

INF = float("inf")


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def finite(x) -> Column:
    """NaN or +-inf -> NULL."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(INF)), x)


def try_double(x) -> Column:
    """Dirty cell -> finite double or NULL, never an error."""
    return finite(_c(x).try_cast("double"))


def safe_div(a, b, fill: float | None = 0.0) -> Column:
    """a / b; ``fill`` where |b| < EPS or either side is NULL."""
    a, b = _c(a), _c(b)
    q = finite(F.when(F.abs(b) >= EPS, a / b))
    return q if fill is None else F.coalesce(q, F.lit(float(fill)))


def clip(x, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    x = _c(x)
    y = x
    if hi is not None:
        y = F.least(F.lit(float(hi)), y)
    if lo is not None:
        y = F.greatest(F.lit(float(lo)), y)
    return F.when(x.isNotNull(), y)


def mean_of(*cols) -> Column:
    """Row-wise mean over the non-NULL inputs; NULL when all are NULL."""
    cs = [_c(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cs), F.lit(0))
    return F.when(n > 0, total / n)
