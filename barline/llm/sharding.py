"""Contiguous shards of near equal byte size, by global prefix sums from per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.shared import written


def shards(docs: DataFrame, count: int = 40, overhead: int = 16, parts: int | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts every row into one of ``count`` shards, contiguous in document order and near equal in bytes.

    A row's size is its text's UTF-8 bytes (null: none) plus ``overhead``. Rows are ordered by id, null first, then
    by size, checksum and the place where they were read. Ranges of that order become partitions; their totals, one
    row each, give every partition its global start, and a row goes to the shard in which the middle of its bytes
    falls, so a shard is off the equal target by half a row at either end at most. Texts are never shuffled.

    Returns {doc}, size, text_crc32 (null for a null text), shard, slot (gapless from 0 in the shard). Repeated
    rows each get a slot; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    content = F.col(text).cast("binary")
    slim = docs.select(F.col(doc).cast("long").alias("doc"), (F.coalesce(F.octet_length(content), F.lit(0)) + overhead).cast("long").alias("size"), F.crc32(content).alias("crc"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc").asc_nulls_first(), F.col("size"), F.col("crc").asc_nulls_first(), F.col("row")]
    # Ranges depend on a sample that is drawn anew at each evaluation, so they are written once.
    ranged = written(slim.repartitionByRange(n, *order).select("*", F.spark_partition_id().alias("part")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_base"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_base"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = ranged.withColumns({"local_bytes": F.sum("size").over(inside) - F.col("size"), "local_row": F.row_number().over(inside) - 1}).join(F.broadcast(starts), "part")
    twice_middle = 2 * (F.col("byte_base") + F.col("local_bytes")) + F.col("size")
    sharded = placed.select("doc", "size", "crc", (F.col("row_base") + F.col("local_row")).alias("global_row"), F.least(F.lit(count - 1), F.floor(twice_middle.cast("decimal(38,0)") * count / (2 * F.col("all_bytes"))).cast("int")).alias("shard"))
    first = sharded.groupBy("shard").agg(F.min("global_row").alias("first_row"))  # one row a shard
    return sharded.join(F.broadcast(first), "shard").select(F.col("doc").alias(doc), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("global_row") - F.col("first_row")).alias("slot"))
