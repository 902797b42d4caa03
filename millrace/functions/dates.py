"""Relative ages and week starts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AGE = r"(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago"
# Hours of each unit; a month has 30 days, a year 365.
HOURS = {"second": 1 / 3600, "minute": 1 / 60, "hour": 1, "day": 24, "week": 168, "month": 720, "year": 8760}


def _unit(c: Column, values: dict, default) -> Column:
    unit, out = F.regexp_extract(F.lower(c), _AGE, 2), None
    for name, value in values.items():
        out = F.when(unit == name, F.lit(value)) if out is None else out.when(unit == name, F.lit(value))
    return out.otherwise(F.lit(default))


def _count(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), _AGE, 1).try_cast("int")


def listed_date(c: Column, as_of: Column) -> Column:
    """FN-14: the day an age text points at; today for hours, "today" and "just"; else null."""
    days = _unit(c, {k: int(h // 24) for k, h in HOURS.items()}, 0)
    return F.when(_count(c).isNotNull(), F.date_sub(as_of.cast("date"), _count(c) * days)).when(F.lower(c).rlike("today|just|hour"), as_of.cast("date"))


def age_hours_text(c: Column) -> Column:
    """FN-15: hours of an age text, 0 by default."""
    return F.coalesce(_count(c) * _unit(c, HOURS, 0.0), F.lit(0.0))


def age_hours(ts: Column, as_of: Column) -> Column:
    """FN-16: hours from ``ts`` to ``as_of``."""
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / 3.6e9


def short_age_days(c: Column) -> Column:
    """FN-14, the dialect of one letter: days of "26d ago"; 0 for hours and minutes; else null."""
    n, unit = F.regexp_extract(F.lower(c), r"([0-9]+)\s*([dhm])\+?\s*ago", 1).try_cast("int"), F.regexp_extract(F.lower(c), r"([0-9]+)\s*([dhm])\+?\s*ago", 2)
    return F.when(unit == "d", n).when(unit.isin("h", "m"), 0)


def parse_iso(c: Column) -> Column:
    """FN-12: an ISO time, UTC unless it says otherwise; null where it is none."""
    return F.try_to_timestamp(F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")))


def from_millis(c: Column) -> Column:
    """FN-13: a time from milliseconds since 1970."""
    return F.timestamp_millis(c.cast("long"))
