"""Window helpers on the dense session grid.

Every window here is keyed by (symbol, session_date) on bar-level rows, so one
partition holds at most one session of bars (391 at one minute) however hot the
symbol is: raw ticks, prints and ladder rows are aggregated to bars first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, functions as F

from tapegrid.functions.nulls import _c, clip, safe_div

SESSION = ("symbol", "session_date")


def by_bar(keys=SESSION, order="bar"):
    return Window.partitionBy(*keys).orderBy(order)


def by_day(keys=("symbol",), order="session_date"):
    return Window.partitionBy(*keys).orderBy(order)


def so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def whole(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def last_rows(w, n: int):
    return w.rowsBetween(-(n - 1), 0)


# Rolling statistics by name; extend with ``register_stat``.
STATS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def register_stat(name: str, fn: Callable[[Column], Column]) -> None:
    STATS[name] = fn


def roll(x, n: int, stat: str, w=None, min_rows: int = 1) -> Column:
    """Statistic over the last ``n`` rows; NULL until ``min_rows`` values are seen."""
    x = _c(x)
    frame = last_rows(w or by_bar(), n)
    return F.when(F.count(x).over(frame) >= min_rows, STATS[stat](x).over(frame))


def rolling_z(x, n: int, min_rows: int, bound: float = 8.0, w=None) -> Column:
    """(x - mean) / std of the last n rows, 0 during warm-up, clipped."""
    x = _c(x)
    return clip(safe_div(x - roll(x, n, "mean", w, min_rows), roll(x, n, "std", w, min_rows), 0.0), -bound, bound)


def diff(x, k: int = 1, w=None) -> Column:
    x = _c(x)
    return x - F.lag(x, k).over(w or by_bar())


def second_diff(x, w=None) -> Column:
    x, w = _c(x), w or by_bar()
    return x - 2.0 * F.lag(x, 1).over(w) + F.lag(x, 2).over(w)


def carry(x, w=None) -> Column:
    return F.last(_c(x), ignorenulls=True).over(so_far(w or by_bar()))


def back_fill(x, w=None) -> Column:
    """First later value. Looks ahead: only for reproducing files built that way."""
    w = w or by_bar()
    return F.first(_c(x), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def fill(x, mode: str = "causal", w=None) -> Column:
    return carry(x, w) if mode == "causal" else F.coalesce(carry(x, w), back_fill(x, w))


def first_value(x, w=None) -> Column:
    return F.first(_c(x), ignorenulls=True).over(whole(w or by_bar()))


def last_value(x, w=None) -> Column:
    return F.last(_c(x), ignorenulls=True).over(whole(w or by_bar()))
