"""Contracts on panels: keys, values, columns and calendars."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def duplicate_keys(panel: DataFrame, key: tuple[str, ...] = ("date", "asset")) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return panel.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(panel: DataFrame, key: tuple[str, ...] = ("date", "asset")) -> None:
    found = duplicate_keys(panel, key).count()
    if found:
        raise ValueError(f"{found} duplicate keys {key}")


def negative_rows(panel: DataFrame, columns: list[str]) -> DataFrame:
    return panel.where(reduce(or_, (F.col(c) < 0 for c in columns)))


def require_not_negative(panel: DataFrame, columns: list[str]) -> None:
    first = negative_rows(panel, columns).agg(F.min(F.struct("date", "asset")).alias("k")).first()["k"]
    if first is not None:
        raise ValueError(f"negative value at {first['date']}, {first['asset']}")


def one_sided_dates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Dates that only one of two tables has, with which: left or right."""
    a, b = left.select("date").distinct().withColumn("in_left", F.lit(True)), right.select("date").distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, "date", "full").where("in_left IS NULL OR in_right IS NULL")
    return both.select("date", F.when(F.col("in_left").isNotNull(), "left").otherwise("right").alias("side"))


def missing_columns(table: DataFrame, required: list[str] | StructType) -> list[str]:
    """Required names that a table lacks; with a schema, also those of another type."""
    if isinstance(required, StructType):
        held = {f.name: f.dataType for f in table.schema}
        return [f.name for f in required if held.get(f.name) != f.dataType]
    return [c for c in required if c not in table.columns]


def require_columns(table: DataFrame, required: list[str]) -> None:
    if missing := missing_columns(table, required):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_no_asset(panel: DataFrame, asset: str) -> None:
    if not panel.where(F.col("asset") == asset).isEmpty():
        raise ValueError(f"{asset} is there already")


def watched(panel: DataFrame, not_negative: list[str] | None = None, absent: str | None = None, unique: bool = True) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """panel, and a function that gives the counts of what is wrong once a job over it has run.

    The counts n_rows, n_duplicates (rows whose asset and date the row before has), n_negative (rows with a negative
    value in ``not_negative``) and n_absent (rows of the asset ``absent``) are gathered by the tasks of that job, for
    instance a write: no check runs a job of its own. ``unique`` needs rows by asset and date, which a write by asset
    has anyway; without it n_duplicates is 0.
    """
    found, seen = Observation(), panel
    twice = F.lit(False)
    if unique:
        seen = panel.withColumn("__again", F.coalesce(F.col("date") == F.lag("date", 1).over(Window.partitionBy("asset").orderBy("date")), F.lit(False)))
        twice = F.col("__again")
    below = reduce(or_, (F.coalesce(F.col(c) < 0, F.lit(False)) for c in not_negative or []), F.lit(False))
    counts = {"n_rows": F.count(F.lit(1)), "n_duplicates": F.count_if(twice), "n_negative": F.count_if(below), "n_absent": F.count_if(F.coalesce(F.col("asset") == F.lit(absent), F.lit(False)))}
    out = seen.observe(found, *(c.alias(n) for n, c in counts.items())).select(*(f"`{c}`" for c in panel.columns))
    return out, lambda: dict(found.get)


def require_clean(counts: dict[str, int]) -> None:
    """Raises what the counts of watched() say is wrong, all of it at once."""
    wrong = [f"{counts[n]} {what}" for n, what in (("n_duplicates", "duplicate keys"), ("n_negative", "rows with a negative value"), ("n_absent", "rows of an asset that must not be there")) if counts[n]]
    if wrong:
        raise ValueError("; ".join(wrong))
