"""Ratios of sums: the aggregate behind almost every number here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_pct(numerator: Column | str, denominator: Column | str) -> Column:
    """100 * sum / sum; 0.0 where the denominator's sum is zero or there are no rows."""
    return F.coalesce(100.0 * F.sum(numerator) / F.nullif(F.sum(denominator).cast("double"), F.lit(0.0)), F.lit(0.0))


def nullable_pct(numerator: Column | str, denominator: Column | str) -> Column:
    """100 * sum / sum; null where the denominator's sum is zero."""
    return 100.0 * F.sum(numerator) / F.nullif(F.sum(denominator).cast("double"), F.lit(0.0))


def verdict(low: Column | str, high: Column | str) -> Column:
    """What an interval of a difference says: it holds zero, or one side is better."""
    lo, hi = F.col(low) if isinstance(low, str) else low, F.col(high) if isinstance(high, str) else high
    return F.when((lo <= 0) & (hi >= 0), "not separated").when(hi < 0, "a lower").otherwise("b lower")


def order_statistic(values: Column, quantile: float) -> Column:
    """The value at rank ceil(quantile * (n - 1)) of an array, without interpolation; null for none."""
    ordered = F.array_sort(values)
    at = F.ceil(F.lit(quantile) * (F.size(ordered) - 1) - 1e-9).cast("int") + 1
    return F.when(F.size(ordered) > 0, F.element_at(ordered, F.greatest(at, F.lit(1))))
