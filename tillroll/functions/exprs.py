"""Column-expression helpers shared by the operators. All are built-in Spark expressions (codegen,
no Python on the data path).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- dates ---------------------------------------------------------------------------------

def days_between(start: str | Column, end: str | Column) -> Column:
    """Midnights crossed from ``start`` to ``end`` (not whole elapsed days)."""
    return F.datediff(col(end), col(start))


def is_weekend(ts: str | Column) -> Column:
    """Saturday or Sunday in any locale (1 = Sunday, 7 = Saturday)."""
    return F.dayofweek(col(ts)).isin(1, 7)


def month_name(ts: str | Column) -> Column:
    """The full English month name."""
    return F.date_format(col(ts), "MMMM")


# ---- numbers -------------------------------------------------------------------------------

def as_double(c: str | Column) -> Column:
    return col(c).cast("double")


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num`` over ``den`` in double precision, null where ``den`` is 0."""
    return as_double(num) / F.nullif(as_double(den), F.lit(0.0))


def percent(num: str | Column, den: str | Column) -> Column:
    """``num`` as a percentage of ``den`` in double precision, null where ``den`` is 0."""
    return as_double(num) * F.lit(100.0) / F.nullif(as_double(den), F.lit(0.0))


def mean(c: str | Column) -> Column:
    """Mean in double: exact decimal sum, one final division."""
    return ratio(F.sum(col(c)), F.count(col(c)))


def count_when(cond: Column) -> Column:
    """Rows where ``cond`` holds."""
    return F.count(F.when(cond, F.lit(1)))


def sum_when(cond: Column, value: Column | int = 1) -> Column:
    """Sum of ``value`` where ``cond`` holds (0 rather than null on no match)."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.sum(F.when(cond, v).otherwise(F.lit(0)))


def ci_equals(c: str | Column, literal: str) -> Column:
    """Case-insensitive equality."""
    return F.lower(col(c)) == F.lit(literal.lower())
