"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value) -> Column:
    """A date literal from ``datetime.date`` or ``yyyy-MM-dd`` text; columns pass through."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def as_timestamp(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def percent_text(ratio: Column) -> Column:
    return F.format_string("%.2f%%", ratio * 100)


def click_rate(click: Column) -> Column:
    """Share of rows with a click; a missing flag counts as no click."""
    return F.avg(F.when(click, 1).otherwise(0))


def with_date_parts(df, date_col: str = "date"):
    d = F.col(date_col)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d)})


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def iso_utc(ts: Column) -> Column:
    """Event time as written by the producers: ISO-8601 with microseconds and a Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
