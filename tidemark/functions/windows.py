"""Window expressions that are causal and strict about nulls: a window that is not full gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def full(value: Column, order: WindowSpec, n: int, aggregate: Callable[[Column], Column], end: int = 0) -> Column:
    """aggregate(value) over the n rows that end ``end`` rows after the current one, null unless all n exist and are not null."""
    frame = order.rowsBetween(end - n + 1, end)
    return F.when(F.count(value).over(frame) == n, aggregate(value).over(frame))


def change(value: Column, order: WindowSpec, n: int = 1) -> Column:
    """Relative change over n rows; null if the earlier value is null or zero."""
    before = F.lag(value, n).over(order)
    return F.when(before != 0, value / before - 1)


def filled(value: Column, order: WindowSpec) -> Column:
    """The latest value that is not null."""
    return F.last(value, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))


def running_product(value: Column, over: WindowSpec) -> Column:
    """Product of a frame's values, through logarithms; zero and negative factors are counted apart."""
    size = F.exp(F.coalesce(F.sum(F.when(value != 0, F.log(F.abs(value)))).over(over), F.lit(0.0)))
    negative = F.coalesce(F.sum(F.when(value < 0, 1).otherwise(0)).over(over), F.lit(0)) % 2 == 1
    zero = F.coalesce(F.sum(F.when(value == 0, 1).otherwise(0)).over(over), F.lit(0)) > 0
    return F.when(zero, 0.0).otherwise(F.when(negative, -size).otherwise(size))


def product(value: Column) -> Column:
    """Product of an aggregate's values, through logarithms; zero and negative factors are counted apart."""
    size = F.exp(F.sum(F.when(value != 0, F.log(F.abs(value)))))
    sign = F.when(F.sum(F.when(value < 0, 1).otherwise(0)) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.sum(F.when(value == 0, 1).otherwise(0)) > 0, F.lit(0.0)).otherwise(F.coalesce(size, F.lit(1.0)) * sign)
