"""Session clock: local date, bar labels, calendar flags.

Local wall time is obtained with ``from_utc_timestamp`` per row, so sessions on
both sides of a DST change open at the same local minute. Arithmetic is done on
microseconds and does not depend on the Spark session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tapegrid.config import SessionConfig

DAY_US = 86_400_000_000
MIN_US = 60_000_000


def local_micros(ts: Column, tz: str) -> Column:
    return F.unix_micros(ts if tz == "UTC" else F.from_utc_timestamp(ts, tz))


def local_date(ts: Column, tz: str) -> Column:
    return F.date_from_unix_date(F.floor(local_micros(ts, tz) / DAY_US).cast("int"))


def micros_of_day(ts: Column, tz: str) -> Column:
    return F.pmod(local_micros(ts, tz), F.lit(DAY_US))


def minute_of_day(ts: Column, tz: str) -> Column:
    return F.floor(micros_of_day(ts, tz) / MIN_US).cast("int")


def ceil_bar(ts: Column, cfg: SessionConfig, minutes: int | None = None) -> Column:
    """Minutes after the open of the bar in which a row completes.

    ``minutes`` is the label spacing (default: the grid). 10:14:37 on a one-minute
    grid is first usable at 10:15.
    """
    step = (minutes or cfg.bar_minutes) * MIN_US
    label = F.floor((micros_of_day(ts, cfg.tz) + F.lit(step - 1)) / step) * (minutes or cfg.bar_minutes)
    return (label - F.lit(cfg.open_minute)).cast("int")


def order_key(ts: Column, seq: Column) -> Column:
    """(ts, seq) packed into one decimal. Unlike a struct it is a fixed-width aggregation buffer, so
    max_by / min_by on it stay in hash aggregation instead of sorting the raw rows."""
    shift = F.lit("10000000000000000000").cast("decimal(20,0)")
    return F.unix_micros(ts).cast("decimal(17,0)") * shift + seq.cast("decimal(19,0)")


def floor_bar(ts: Column, cfg: SessionConfig, minutes: int) -> Column:
    label = F.floor(micros_of_day(ts, cfg.tz) / (minutes * MIN_US)) * minutes
    return (label - F.lit(cfg.open_minute)).cast("int")


def bar_timestamp(session_date: Column, bar: Column, cfg: SessionConfig) -> Column:
    """Instant of a bar: local wall time turned back into UTC."""
    us = F.unix_date(session_date).cast("bigint") * DAY_US + (F.lit(cfg.open_minute) + bar).cast("bigint") * MIN_US
    local = F.timestamp_micros(us)
    return local if cfg.tz == "UTC" else F.to_utc_timestamp(local, cfg.tz)


def in_session(ts: Column, cfg: SessionConfig, closed: str = "both") -> Column:
    """Regular hours on weekdays; ``closed='left'`` leaves the closing minute out."""
    us = micros_of_day(ts, cfg.tz)
    after = us >= cfg.open_minute * MIN_US
    before = us <= cfg.close_minute * MIN_US if closed == "both" else us < cfg.close_minute * MIN_US
    return after & before & (F.weekday(local_date(ts, cfg.tz)) < 5)


def parse_timestamp(text: Column, tz: str) -> Column:
    """Offset-bearing text is an instant; naive text is local time in ``tz``.

    Naive local times that do not exist (spring gap) or exist twice (autumn
    overlap) give NULL: a time is accepted only if converting it to UTC and back
    returns it and the hour before or after does not map to the same wall time.
    """
    has_offset = text.rlike(r"([+-]\d{2}:?\d{2}|Z)$")
    instant = F.try_to_timestamp(text)
    naive = F.when(~has_offset, F.try_to_timestamp(text))
    utc = F.to_utc_timestamp(naive, tz)
    exists = F.from_utc_timestamp(utc, tz) == naive
    hour = F.expr("interval 1 hour")
    twice = (F.from_utc_timestamp(utc + hour, tz) == naive) | (F.from_utc_timestamp(utc - hour, tz) == naive)
    return F.when(has_offset, instant).otherwise(F.when(exists & ~twice, utc))


def third_friday(d: Column) -> Column:
    return (F.weekday(d) == 4) & F.dayofmonth(d).between(15, 21)


def quad_witching(d: Column) -> Column:
    return third_friday(d) & F.month(d).isin(3, 6, 9, 12)


def weekdays_between(start: Column, end: Column) -> Column:
    """Array of business days (Mon-Fri) in [start, end]."""
    return F.filter(F.sequence(start, end), lambda d: F.weekday(d) < 5)
