"""Missing-value rules of the statistics scripts, spelled out for SQL's three-valued logic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice in which a missing condition gives a missing result."""
    return F.when(cond, _value(yes)).when(~cond, _value(no))


def not_in(c, values) -> Column:
    """Negated membership that keeps missing values."""
    return F.coalesce(~_col(c).isin(list(values)), F.lit(True))


def num(c) -> Column:
    """Text to double; text that is no number becomes missing instead of an error."""
    return _col(c).try_cast("double")


def larger_of(a, b) -> Column:
    """The larger of two values, missing as soon as one of them is (``greatest`` skips NULL)."""
    a, b = _col(a), _col(b)
    return if_else(a >= b, a, b)


def strict_mean(c) -> Column:
    """Mean that is missing when any value of the group is missing."""
    c = _col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))


def log_value(c) -> Column:
    """Natural logarithm with -inf at 0 and NaN below (``ln`` of SQL gives NULL for both)."""
    c = _col(c)
    return F.when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(F.ln(c))
