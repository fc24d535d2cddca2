"""Dates and instants as text, by the contracts' strict rules. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INSTANT = r"^(\d{4}-\d{2}-\d{2})T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-](0\d|1[0-3]):[0-5]\d|[+-]14:00)$"


def is_date(c: Column) -> Column:
    """YYYY-MM-DD of the Gregorian calendar."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def is_instant(c: Column) -> Column:
    """RFC 3339 with a known offset: no -00:00, no leap second, no offset beyond 14:00."""
    return F.coalesce(c.rlike(INSTANT), F.lit(False)) & ~F.coalesce(c.endswith("-00:00"), F.lit(False)) & is_date(F.substring(c, 1, 10))


def is_utc(c: Column) -> Column:
    """An instant of the calendar with a Z, leap seconds left out; null counts as none given, which is allowed."""
    return c.isNull() | (F.coalesce(c.endswith("Z"), F.lit(False)) & is_instant(c))


def instant(c: Column) -> Column:
    """The timestamp of a valid instant, else null."""
    return F.when(is_instant(c), F.try_to_timestamp(c))


def utc_date(c: Column) -> Column:
    return F.date_format(instant(c), "yyyy-MM-dd")


def is_stale(stale_after: Column, today: Column) -> Column:
    """An invalid date is stale, and so is the day itself."""
    return ~is_date(stale_after) | ~is_date(today) | (today >= stale_after)


def seconds(duration: Column) -> Column:
    """Seconds of <n>d, h, m or s; null if it is not one."""
    n, unit = F.regexp_extract(duration, r"^([1-9]\d*)([dhms])$", 1), F.regexp_extract(duration, r"^([1-9]\d*)([dhms])$", 2)
    factor = F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).when(unit == "s", 1)
    return F.when(n != "", n.cast("long") * factor)
