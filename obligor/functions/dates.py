"""Lenient date parsing with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted layouts, tried in this order (month before day).
DATE_LAYOUTS = (
    "yyyy-M-d[ H:mm[:ss]]",
    "yyyy-M-d'T'H:mm[:ss]",
    "yyyy/M/d[ H:mm[:ss]]",
    "M/d/yyyy[ H:mm[:ss]]",
    "d/M/yyyy[ H:mm[:ss]]",
    "M-d-yyyy[ H:mm[:ss]]",
    "d-M-yyyy[ H:mm[:ss]]",
    "yyyyMMdd",
    "M/d/yy",
    "M/d/yyyy h:mm[:ss] a",
    "yyyy/M/d H:mm:ss[.SSSSSS][.SSS][.SS][.S]",
    "yyyy.M.d",
    "MMM d[,] yyyy",
    "MMMM d[,] yyyy",
    "d MMM yyyy[ H:mm[:ss]]",
    "d MMMM yyyy[ H:mm[:ss]]",
    "d-MMM-yyyy",
    "d-MMMM-yyyy",
    "yyyy-M",
    "yyyy",
)
# Fixed value: ISO instants with fractions or zone offsets, left to the default parser.
ISO_INSTANT = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
# Fixed value: the name of a day in front says nothing that the date does not.
WEEKDAY = r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
# Fixed value: years of two digits from 69 on belong to the last century.
FIRST_LATE_YEAR = 2069
CLOCK_ONLY = r"^\d{1,2}:\d{2}(:\d{2})?$"


def _parsed(value: Column, layout: str) -> Column:
    moment = F.try_to_timestamp(value, F.lit(layout))
    if not layout.endswith("/yy"):
        return moment
    earlier = moment - F.make_interval(years=F.lit(100))
    return F.when(F.year(moment) >= FIRST_LATE_YEAR, earlier).otherwise(moment)


def parse_mixed(text: Column) -> Column:
    """Timestamp from text in any accepted layout; NULL when none fits."""
    value = F.regexp_replace(F.trim(text), WEEKDAY, "")
    tries = [_parsed(value, layout) for layout in DATE_LAYOUTS]
    instant = F.when(value.rlike(ISO_INSTANT), F.try_to_timestamp(value))
    today = F.concat(F.date_format(F.current_date(), "yyyy-MM-dd "), value)
    clock = F.when(
        value.rlike(CLOCK_ONLY), F.try_to_timestamp(today, F.lit("yyyy-MM-dd H:mm[:ss]"))
    )
    return F.coalesce(instant, *tries, clock)


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Floored count of 24-hour days from ``earlier`` to ``later`` (negative if reversed)."""
    day = F.lit(86_400_000_000).cast("bigint")
    gap = F.unix_micros(later) - F.unix_micros(earlier)
    return ((gap - F.pmod(gap, day)) / day).cast("bigint")
