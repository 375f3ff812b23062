"""Column functions on dates and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """The first of four formats that reads it: month first, ISO, day first, month first with two digits of year."""
    t = F.trim(text)
    formats = ("M/d/yyyy", "yyyy-M-d", "d/M/yyyy", "M/d/yy")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]).cast("date")


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def quarter_ordinal(label: Column) -> Column:
    """Four a year, so that neighbouring quarters differ by one."""
    return F.substring(label, 1, 4).cast("int") * 4 + F.substring(label, 6, 1).cast("int")


def quarter_bounds(label: Column) -> tuple[Column, Column]:
    start = F.make_date(F.substring(label, 1, 4).cast("int"), F.substring(label, 6, 1).cast("int") * 3 - 2, F.lit(1))
    return start, F.last_day(F.add_months(start, 2))


def year_bounds(label: Column) -> tuple[Column, Column]:
    return F.make_date(label.cast("int"), F.lit(1), F.lit(1)), F.make_date(label.cast("int"), F.lit(12), F.lit(31))
