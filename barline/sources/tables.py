"""Parquet tables: read with a contract, written by asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A table; a missing path is an analysis error."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def dealt(df: DataFrame, by: str) -> DataFrame:
    """df shuffled by a column and, if it has dates, their year, so that one key is not one task."""
    return df.repartition(by, F.substring(F.col("date").cast("string"), 1, 4)) if "date" in df.columns else df.repartition(by)


def load_ordered(spark: SparkSession, path: str, out: str = "file_order") -> DataFrame:
    """A Parquet table with the place of each row: its file's path and its number in it, as a struct that sorts.

    The place is the file's, so it is the same however rows are dealt to tasks; of repeated keys the last one in it
    is the one written last (normalize.keep_last, or clean_panel with ``order``).
    """
    return spark.read.parquet(path).select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(out))


def save_parquet(df: DataFrame, path: str, by: str | None = None, keep: bool = False) -> None:
    """Writes a table, parents included; by: partition folders and one shuffle to them.

    The table is replaced; with ``keep`` only the folders that df has rows for are, and the others stay.
    """
    if by:
        mode = "dynamic" if keep else "static"
        dealt(df, by).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(by).parquet(path)
    elif keep:
        raise ValueError("only a table in folders can keep some of them")
    else:
        df.write.mode("overwrite").parquet(path)


def one_asset(panel: DataFrame, asset: str) -> DataFrame:
    """The rows of one asset; a table saved by asset reads one folder."""
    return panel.where(F.col("asset") == asset)
