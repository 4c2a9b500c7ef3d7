"""Column expressions with T-SQL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(19,4)"


def minute_boundaries(start: Column, end: Column) -> Column:
    """``DATEDIFF(minute, start, end)``: minute boundaries crossed, not whole minutes."""
    return F.timestamp_diff("MINUTE", F.date_trunc("MINUTE", start), F.date_trunc("MINUTE", end))


def minutes_of_day(at: Column) -> Column:
    """``DATEDIFF(MINUTE, '00:00:00', CAST(at AS time))``."""
    return F.hour(at) * 60 + F.minute(at)


def isnull(value: Column, default) -> Column:
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def is_blank(value: Column) -> Column:
    """``NULLIF(LTRIM(RTRIM(x)), '') IS NULL``."""
    return F.nullif(F.trim(value), F.lit("")).isNull()


def within_day(at: Column, day: Column) -> Column:
    """``at >= @d AND at < DATEADD(day, 1, @d)``."""
    return (at >= day) & (at < F.date_add(day, 1))


def valid_on(start: Column, end: Column, day: Column) -> Column:
    """Effective-dated row that may be open ended."""
    return (start <= day) & (F.coalesce(end, day) >= day)


def integer_divide(value: Column, divisor: int) -> Column:
    """``value / divisor`` on integers, truncated towards zero."""
    return F.call_function("div", value, F.lit(divisor))


def ratio(numerator: Column, denominator: Column) -> Column:
    """``a / NULLIF(b, 0)``."""
    return numerator / F.nullif(denominator, F.lit(0))


def same_text(left: Column, right: Column) -> Column:
    """String equality of the usual server collation: no case, no trailing spaces."""
    return F.collate(left, "UTF8_LCASE_RTRIM") == F.collate(right, "UTF8_LCASE_RTRIM")
