"""Hour arithmetic on exact microseconds, and the boundary rules of intervals [s, e]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts: str | Column) -> Column:
    return F.unix_micros(_c(ts))


def hour_floor(ts: str | Column) -> Column:
    return F.date_trunc("hour", _c(ts))


def floor_hours(us: str | Column) -> Column:
    """Whole hours since the epoch at or before an instant in microseconds, before 1970 too."""
    us = _c(us)
    return ((us - F.pmod(us, F.lit(HOUR_US))) / HOUR_US).cast("bigint")


def ceil_hours(us: str | Column) -> Column:
    us = _c(us)
    return ((us + F.pmod(-us, F.lit(HOUR_US))) / HOUR_US).cast("bigint")


def hour_to_ts(hour: str | Column) -> Column:
    return F.timestamp_seconds(_c(hour) * 3600)


def invalid(s: str | Column, e: str | Column) -> Column:
    return _c(e) < _c(s)


def overlaps_half_open(s, e, w0, w1) -> Column:
    """Does [s, e] meet the window [w0, w1)? An interval that ends at w0 does not."""
    return (_c(s) < _c(w1)) & (_c(e) > _c(w0))


def covers_instant(s, e, t) -> Column:
    return (_c(s) <= _c(t)) & (_c(e) > _c(t))


def exposed_forward(s, e, t, until) -> Column:
    """Is there alert at an instant in (t, until]?"""
    return (_c(s) <= _c(until)) & (_c(e) > _c(t))


def local_calendar(ts: str | Column, timezone: str) -> dict[str, Column]:
    local = F.from_utc_timestamp(_c(ts), timezone)
    hour, day = F.hour(local), F.weekday(local)
    return {"hour_kyiv": hour, "dow_kyiv": day, "hour_of_week_kyiv": day * 24 + hour}
