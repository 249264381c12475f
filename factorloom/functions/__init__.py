"""Column functions with the missing-value algebra of the factor language (missing is NULL, never NaN)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL = F.lit


def scrub(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return a - b * F.floor(div(a, b)).cast("double")


def power(a: Column, b: Column) -> Column:
    return scrub(F.pow(a, b))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def compare(op: str, a: Column, b: Column) -> Column:
    """Comparison that is false (``!=``: true) where a side is missing."""
    result = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    return F.coalesce(result, F.lit(op == "!="))


def greatest(a: Column, b: Column) -> Column:
    """The larger one, NULL if either is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def least(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def correlation(x: Column, y: Column, over=None) -> Column:
    """Pearson correlation of the pairs without a missing side; NULL where one of them is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    cov, sx, sy = [p.over(over) for p in parts] if over is not None else parts
    return div(cov, sx * sy)


def rounded(c: Column, digits: int = 6) -> Column:
    """For results: on a grid of ``digits`` decimals.  The grid's borders lie off the decimal ties, on which prices often are."""
    return F.floor(c * float(10**digits) + 0.4987) / float(10**digits)
