"""Statistics of array columns, computed with built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, array_sum(a) / F.size(a))


def array_quantile(a: Column, q: float, ordered: bool = False) -> Column:
    """Interpolated quantile of an array of non-null numbers; ``ordered`` if it is sorted already."""
    ordered = a if ordered else F.sort_array(a)
    at = (F.size(a) - 1) * F.lit(float(q))
    low = F.try_element_at(ordered, F.floor(at).cast("int") + 1)
    high = F.try_element_at(ordered, F.ceil(at).cast("int") + 1)
    return F.when(F.size(a) > 0, low + (high - low) * (at - F.floor(at)))
