"""Time literals and arithmetic on TIMESTAMP_NTZ, independent of the session zone."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "ntz", "micros", "from_micros", "to_timedelta", "to_micros", "as_datetime",
    "ceil_div", "age_seconds", "day", "day_stamp", "minus_days", "day_after_last",
]

# Seconds per unit name.
UNIT_SECONDS = {
    "s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1,
    "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400,
    "w": 604800, "week": 604800, "weeks": 604800,
    "mon": 2592000, "mons": 2592000, "month": 2592000, "months": 2592000,
    "y": 31557600, "year": 31557600, "years": 31557600,
}


def as_datetime(value: datetime | str) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


def ntz(value: datetime | str | Column) -> Column:
    """A TIMESTAMP_NTZ literal (columns pass through)."""
    if isinstance(value, Column):
        return value
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def to_timedelta(value: timedelta | str) -> timedelta:
    """``'90 days'``, ``'5m'``, ``'1 day 12 hours'`` as a timedelta."""
    if isinstance(value, timedelta):
        return value
    parts = re.findall(r"(\d+)\s*([a-z]+)", value.lower())
    unknown = any(unit not in UNIT_SECONDS for _, unit in parts)
    if not parts or unknown or re.sub(r"\d+\s*[a-z]+|\s", "", value.lower()):
        raise ValueError(f"not a duration: {value!r}")
    return timedelta(seconds=sum(int(n) * UNIT_SECONDS[u] for n, u in parts))


def to_micros(value: timedelta | str) -> int:
    return to_timedelta(value) // timedelta(microseconds=1)


def micros(col: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ column."""
    col = F.col(col) if isinstance(col, str) else col
    return F.timestamp_diff("MICROSECOND", ntz("1970-01-01 00:00:00"), col)


def from_micros(col: Column) -> Column:
    return F.timestamp_add("MICROSECOND", col, ntz("1970-01-01 00:00:00"))


def ceil_div(a: Column, b: int) -> Column:
    """Whole-number division rounded up."""
    return ((a + F.pmod(-a, F.lit(b).cast("bigint"))) / F.lit(b)).cast("bigint")


def age_seconds(col: Column | str, as_of, null_as_zero: bool = True) -> Column:
    """Seconds from ``col`` to ``as_of``; a missing time counts as 0 unless told otherwise."""
    col = F.col(col) if isinstance(col, str) else col
    age = F.timestamp_diff("MICROSECOND", col, ntz(as_of)) / F.lit(1e6)
    return F.coalesce(age, F.lit(0.0)) if null_as_zero else age


def day(col: Column | str) -> Column:
    return F.to_date(col)


def day_stamp(col: Column | str, fmt: str = "yyyyMMdd") -> Column:
    return F.date_format(col, fmt)


def minus_days(col: Column, n: Column) -> Column:
    return (col - F.make_dt_interval(n)).cast("timestamp_ntz")


def day_after_last(df: DataFrame, control: str) -> datetime:
    """Midnight after the newest row: the reproducible stand-in for 'now'."""
    newest = df.agg(F.max(control)).first()[0]
    return datetime(newest.year, newest.month, newest.day) + timedelta(days=1)
