"""Column expressions over a panel's rows in time order."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_time(key: str = "asset", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last_rows(n: int, key: str = "asset", order: str = "date") -> WindowSpec:
    return by_time(key, order).rowsBetween(-(n - 1), 0)


def so_far(key: str = "asset", order: str = "date") -> WindowSpec:
    return by_time(key, order).rowsBetween(Window.unboundedPreceding, 0)


def rolling(aggregate: Column, value: Column, n: int, key: str = "asset", order: str = "date", least: int | None = None) -> Column:
    """An aggregate over the last n rows; null until ``least`` (default n) of them have a value."""
    frame = last_rows(n, key, order)
    return F.when(F.count(value).over(frame) >= (n if least is None else least), aggregate.over(frame))


def forward_fill(value: Column, key: str = "asset", order: str = "date") -> Column:
    return F.last(value, ignorenulls=True).over(so_far(key, order))


def backward_fill(value: Column, key: str = "asset", order: str = "date") -> Column:
    return F.first(value, ignorenulls=True).over(by_time(key, order).rowsBetween(0, Window.unboundedFollowing))


def ratio(a: Column | float, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a if isinstance(a, Column) else F.lit(a), b)


def log_of(value: Column) -> Column:
    """Natural logarithm, null for zero and below."""
    return F.when(value > 0, F.ln(value))


def floored(value: Column, at: float = 0.0) -> Column:
    """The greater of value and ``at``; null stays null."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(at)))


def not_nan(value: Column) -> Column:
    """NaN is absence in the sources; a panel has null for it."""
    return F.when(~F.isnan(value), value)


def log_return(price: Column, key: str = "asset", order: str = "date") -> Column:
    return log_of(ratio(price, F.lag(price, 1).over(by_time(key, order))))
