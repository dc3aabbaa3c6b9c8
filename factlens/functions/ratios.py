"""Exact ratio predicates on decimals, without a division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_at_least(a: Column, b: Column, threshold: int) -> Column:
    """max(|a/b|, |b/a|) >= threshold, for values other than zero."""
    x, y = F.abs(a), F.abs(b)
    return F.greatest(x, y) >= F.least(x, y) * F.lit(threshold).cast("decimal(9,0)")


def symmetric_ratio(a: Column, b: Column) -> Column:
    """The ratio as a double, for ranking and reports."""
    x, y = F.abs(a).cast("double"), F.abs(b).cast("double")
    return F.greatest(x, y) / F.least(x, y)


def relative_size_at_least(old: Column, new: Column, percent: int) -> Column:
    return F.abs(new - old) * 100 >= F.abs(old) * percent


def rounded(numerator: Column, denominator: Column) -> Column:
    """A ratio of counts as a double of nine digits; null over zero."""
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), 9)
