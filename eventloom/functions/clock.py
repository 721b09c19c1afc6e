"""Time arithmetic on epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts: Column | str) -> Column:
    """Epoch microseconds of a timestamp with or without zone (the session zone is UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def whole_div(x: Column, width: Column | int) -> Column:
    """Floor division of a long by a positive width, exact for negative values as well."""
    w = width if isinstance(width, Column) else F.lit(width)
    return ((x - F.pmod(x, w)) / w).cast("long")


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole seconds from ``earlier`` to ``later`` (both epoch microseconds), cut towards zero."""
    return ((col(later) - col(earlier)) / F.lit(SECOND)).cast("long")


def clock_differences(pairs: dict[str, tuple[str, str]]) -> list[Column]:
    """A bank of named clock differences in seconds."""
    return [seconds_between(a, b).alias(name) for name, (a, b) in pairs.items()]


def as_timestamp(us: Column | str) -> Column:
    return F.timestamp_micros(col(us))


def hour_of(us: Column | str) -> Column:
    return F.hour(as_timestamp(us))


def iso_weekday(us: Column | str) -> Column:
    """1 = Monday … 7 = Sunday."""
    return (F.weekday(as_timestamp(us)) + 1).cast("int")


def month_of(us: Column | str) -> Column:
    return F.month(as_timestamp(us))


def date_of(us: Column | str) -> Column:
    return F.to_date(as_timestamp(us))


def truncate(us: Column | str, unit: str) -> Column:
    """Start of the hour, day, month or minute, again as epoch microseconds."""
    return epoch_us(F.date_trunc(unit, as_timestamp(us)))


def calendar(at: Column, bucket_hours: int = 3) -> dict[str, Column]:
    """Hour, ISO weekday, month, date and hour bucket of one reference clock."""
    return {
        "hour": hour_of(at),
        "dow": iso_weekday(at),
        "month": month_of(at),
        "day": date_of(at),
        "hour_bucket": F.floor(hour_of(at) / F.lit(bucket_hours)).cast("int"),
    }


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a periodic value."""
    turn = x * F.lit(2.0 * 3.141592653589793 / period)
    return F.sin(turn), F.cos(turn)
