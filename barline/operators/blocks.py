"""Blocks of time: a key with most of the rows is dealt to many tasks, and windows see the rows beside their block.

deal() replaces the key by (of, block), so whatever works by key works on blocks; gather() brings the key back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block. A task holds one at a time; a larger key fills several.
BLOCK = 20_000


def time_block(order: str = "date") -> Column:
    """The year: a key has few of them, and none holds more than its share of a key's history."""
    return F.year(F.col(order))


def numbered(df: DataFrame, key: str = "asset", order: str = "date", bucket: Column | None = None) -> DataFrame:
    """Adds __place, a row's number from 0 among its key's in order.

    Rows are numbered within their key's ``bucket`` (a coarse, rising function of the order, by default its year);
    counts by bucket, summed in order, are the rest. No task sees more than one bucket of one key at a time.
    """
    cut = df.withColumn("__bucket", time_block(order) if bucket is None else bucket)
    counts = cut.groupBy(F.col(key).alias("__k"), F.col("__bucket").alias("__b")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = counts.select("__k", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    met = cut.join(starts, F.col(key).eqNullSafe(F.col("__k")) & F.col("__bucket").eqNullSafe(F.col("__b")))
    inside = Window.partitionBy(key, "__bucket").orderBy(order)
    return met.withColumn("__place", F.col("__start") + F.row_number().over(inside) - 1).drop("__bucket", "__k", "__b", "__start")


def deal(df: DataFrame, before: int = 0, after: int = 0, rows: int | None = None, key: str = "asset", order: str = "date", bucket: Column | None = None) -> DataFrame:
    """df with its key replaced by (of, block), dealt and sorted so that windows by key and order add no exchange.

    A block is ``rows`` rows of a key in order; with it go the ``before`` rows before it and the ``after`` rows after
    it, for which __own is false. These are at most a block.
    """
    rows = BLOCK if rows is None else rows
    if max(before, after) > rows:
        raise ValueError("what stands beside a block is more than a block")
    place, block = F.col("__place") % rows, F.floor(F.col("__place") / rows)
    copies = [F.struct(block.alias("block"), F.lit(True).alias("own"))]
    if before:
        copies.append(F.when(place >= rows - before, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))))
    if after:
        copies.append(F.when((place < after) & (block > 0), F.struct((block - 1).alias("block"), F.lit(False).alias("own"))))
    found = numbered(df, key, order, bucket).withColumn("__copy", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
    found = found.withColumns({key: F.struct(F.col(key).alias("of"), F.col("__copy.block").alias("block")), "__own": F.col("__copy.own")}).drop("__copy", "__place")
    # A block that only other blocks' neighbours reached has no rows of its own; gather() drops it.
    return found.repartition(key).sortWithinPartitions(key, order)


def gather(df: DataFrame, key: str = "asset") -> DataFrame:
    """The rows of a table made by deal(), each once and under its own key."""
    return df.where("__own").withColumn(key, F.col(key)["of"]).drop("__own")


def in_blocks(df: DataFrame, add: Callable[[DataFrame], DataFrame], before: int = 0, after: int = 0, rows: int | None = None, key: str = "asset", order: str = "date", bucket: Column | None = None) -> DataFrame:
    """add(df), for an ``add`` whose windows by key look ``before`` rows back and ``after`` rows ahead at most."""
    return gather(add(deal(df, before, after, rows, key, order, bucket)), key)
