"""Small column expressions shared by the metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairs_of(count: str | Column) -> Column:
    """n(n-1)/2 as DECIMAL(38,0): a third of a very large table overflows LONG."""
    n = F.col(count) if isinstance(count, str) else count
    n = n.cast("decimal(18,0)")
    return F.floor(n * (n - 1) / 2).cast("decimal(38,0)")


def ratio_or_zero(part: str | Column, whole: str | Column) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f1_of(precision: str, recall: str) -> Column:
    p, r = F.col(precision), F.col(recall)
    return ratio_or_zero(2 * p * r, p + r)


def round_half_even(score: str | Column) -> Column:
    """0.5 rounds to 0, as a tensor library rounds; SQL ``round`` gives 1."""
    return F.rint(score)


def is_above(score: str, threshold: float) -> Column:
    """Strictly above the cut; NaN is never above (Spark orders it as largest)."""
    return ~F.isnan(score) & (F.col(score) > threshold)


def survives(score: str, threshold: float) -> Column:
    """At or above the cut; NaN never survives."""
    return ~F.isnan(score) & (F.col(score) >= threshold)
