"""Scalar expressions shared by the operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitbars.types import micros, utc


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def instant(value: dt.datetime | str | Column) -> Column:
    """A timestamp literal from an aware instant, or a column passed through."""
    if isinstance(value, Column):
        return value
    since_epoch = utc(value) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit(micros(since_epoch)))


def shift(ts: str | Column, duration: str | int | dt.timedelta, times: int = 1) -> Column:
    """``ts`` moved by a fixed duration (negative ``times`` moves it back)."""
    return F.timestamp_micros(F.unix_micros(as_col(ts)) + F.lit(times * micros(duration)))


def elapsed(later: str | Column, earlier: str | Column) -> Column:
    """Whole microseconds between two timestamps."""
    return F.unix_micros(as_col(later)) - F.unix_micros(as_col(earlier))


def bucket_of(value: Column, width: int) -> Column:
    """Floor division of a BIGINT column, exact for negatives."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("bigint")


def time_bucket(ts: str | Column, width: str | int) -> Column:
    return bucket_of(F.unix_micros(as_col(ts)), micros(width))


def floor_time(ts: str | Column, width: str | int) -> Column:
    """Epoch-aligned start of the interval that holds ``ts``."""
    us = F.unix_micros(as_col(ts))
    return F.timestamp_micros(us - F.pmod(us, F.lit(micros(width))))


def floor_to_increment(value: Column, increment: Column, epsilon: float) -> Column:
    """Round toward zero to a multiple of ``increment``; a non-positive increment rounds nothing."""
    steps = F.floor(F.try_divide(F.abs(value), increment) + F.lit(epsilon))
    return F.when(increment <= 0, value).otherwise(F.signum(value) * steps * increment)


def clip(value: Column, lower: Column, upper: Column) -> Column:
    """Clamp, keeping null as null (``least``/``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, upper), lower))


def in_range(ts: str | Column, start, end) -> Column:
    """Half-open membership ``[start, end)``."""
    c = as_col(ts)
    return (c >= instant(start)) & (c < instant(end))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open ranges share an instant."""
    return (a_start < b_end) & (b_start < a_end)


def differs(a: Column, b: Column, rtol: float = 1e-9) -> Column:
    """Null-aware inequality with relative tolerance; never null itself.

    Spark's ``<=>`` already treats null = null and NaN = NaN as equal.
    """
    if rtol < 0:
        raise ValueError("rtol must be non-negative")
    close = F.abs(a - b) <= F.lit(rtol) * F.greatest(F.abs(a), F.abs(b))
    finite = ~(F.isnan(a) | F.isnan(b))
    return ~(a.eqNullSafe(b) | F.coalesce(close & finite, F.lit(False)))
