"""From provider tables to the panel: names, dates, defaults, tickers, types."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, ShortType

from barline.functions.columns import not_nan
from barline.operators.checks import require_columns

#: Provider names and the panel's, required fields and defaults.
NAMES = {"adjclose": "adj_close", "divcash": "dividends", "splitfactor": "stock_splits"}
BASE = ["open", "high", "low", "close"]
FIELDS = [*BASE, "adj_close", "volume", "dividends", "stock_splits"]


def clean_name(name: str) -> str:
    plain = re.sub(r"[ \-]", "_", name.strip()).lower()
    return NAMES.get(plain, plain)


def rename(table: DataFrame) -> DataFrame:
    return table.toDF(*map(clean_name, table.columns))


def parse_date(text: Column) -> Column:
    """A calendar day in UTC; junk is null."""
    return F.to_date(F.try_to_timestamp(text.cast("string")))


def keep_fields(table: DataFrame, wanted: list[str], keys: tuple[str, ...] = ("date", "asset")) -> DataFrame:
    """The wanted columns that exist, in the given order, after the keys."""
    return table.select(*keys, *(c for c in wanted if c in table.columns))


def with_defaults(table: DataFrame) -> DataFrame:
    """Absent columns get a default; missing cells of present ones stay missing."""
    require_columns(table, BASE)
    defaults = {"adj_close": F.col("close"), "dividends": F.lit(0.0), "stock_splits": F.lit(1.0), "volume": F.lit(0.0)}
    return table.withColumns({c: v for c, v in defaults.items() if c not in table.columns})


def ticker(asset: Column) -> Column:
    upper = F.upper(F.trim(asset))
    return F.when(upper.endswith("-USD"), F.regexp_replace(upper, "-USD$", "USD")).otherwise(upper)


def crypto_flag(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Adds is_crypto: listed so in the universe (asset, is_crypto), or a name that ends with USD."""
    listed = universe.where("is_crypto").select("asset", F.lit(True).alias("listed")).distinct()
    return panel.join(listed, "asset", "left").withColumn("is_crypto", F.coalesce("listed", F.lit(False)) | F.col("asset").endswith("USD")).drop("listed")


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_last(panel: DataFrame, order: str, key: tuple[str, ...] = ("date", "asset")) -> DataFrame:
    """Of rows with one key, the one that ``order`` puts last."""
    newest = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return panel.withColumn("__place", F.row_number().over(newest)).where("__place = 1").drop("__place")


def downcast(panel: DataFrame, flags: tuple[str, ...] = ("is_cash",)) -> DataFrame:
    """Storage types: doubles to float, flags to byte, whole numbers to long."""
    types = {DoubleType: "float", IntegerType: "bigint", ShortType: "bigint", LongType: "bigint"}
    return panel.select(*(F.col(f"`{f.name}`").cast("tinyint" if f.name in flags else types.get(type(f.dataType), f.dataType)).alias(f.name) for f in panel.schema))


def normalize(raw: DataFrame, start: str | None = None, end: str | None = None, wanted: list[str] = FIELDS) -> DataFrame:
    """RAW to panel rows (asset, date, fields as double), dates from start to end, both included."""
    table = rename(raw)
    require_columns(table, [*BASE, "asset", "date"])
    table = table.withColumns({"date": parse_date(F.col("date")), "asset": ticker(F.col("asset"))}).where(F.col("date").isNotNull())
    if start:
        table = table.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        table = table.where(F.col("date") <= F.lit(end).cast("date"))
    table = with_defaults(keep_fields(table, wanted))
    return table.select("date", "asset", *(not_nan(F.col(c).cast("double")).alias(c) for c in FIELDS if c in wanted or c not in BASE))


def ordered(panel: DataFrame) -> DataFrame:
    return panel.orderBy("date", "asset")
