"""Month and day arithmetic on zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(ts: Column | str) -> Column:
    """First day of the month as a date."""
    return F.trunc(F.to_date(F.col(ts) if isinstance(ts, str) else ts), "MM")


def month_gap(start: Column, end: Column) -> Column:
    """Month boundaries crossed from start to end."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def day_gap(start: Column, end: Column) -> Column:
    """Calendar-day boundaries crossed from start to end."""
    return F.datediff(F.to_date(end), F.to_date(start))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour days from start to end."""
    return F.floor(seconds_between(start, end) / F.lit(86400)).cast("int")


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    sec = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_add("SECOND", sec.cast("int"), ts)


def parse_time(text: Column) -> Column:
    """ISO-8601 text with any offset, or epoch seconds, as zone-less UTC.

    Text without an offset is taken as UTC, so the session zone must be UTC.
    """
    epoch = F.timestamp_seconds(text.try_cast("double"))
    iso = F.try_to_timestamp(text)
    parsed = F.when(text.rlike(r"^\s*-?\d+(\.\d+)?\s*$"), epoch).otherwise(iso)
    return F.when(F.length(text) > 0, parsed).cast("timestamp_ntz")
