"""Column functions on times and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The layouts in which times arrive, tried in this order.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")


def with_zone(c: Column) -> Column:
    """`Z` after a time that names no zone."""
    return F.when(c.isNull() | (c == "") | c.rlike(r"Z|\+"), c).otherwise(F.concat(c, F.lit("Z")))


def parse_time(c: Column, fallback: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(x)) for x in LAYOUTS), fallback)


def rfc3339(c: Column) -> Column:
    """A time in UTC (the session's zone) as 2024-01-31T12:00:00Z."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def expired(c: Column, now: Column, days: int = 7) -> Column:
    return c < now - F.make_dt_interval(F.lit(days))


def seconds_between(begin: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(begin)) / 1e6


def day_label(c: Column, now: Column) -> Column:
    """`Today, 09:30`, `Yesterday, 09:30`, else the date; null is `N/A`."""
    days, clock = F.datediff(now, c), F.date_format(c, "HH:mm")
    recent = F.when(days == 0, F.concat(F.lit("Today, "), clock)).when(days == 1, F.concat(F.lit("Yesterday, "), clock))
    return F.when(c.isNull(), "N/A").otherwise(F.coalesce(recent, F.date_format(c, "yyyy-MM-dd")))


def default_title(prefix: str, created_at: Column) -> Column:
    return F.concat(F.lit(prefix), F.lit(" "), F.date_format(created_at, "yyyy-MM-dd HH:mm:ss"))
