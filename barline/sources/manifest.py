"""What a stage read and wrote: counts, dates and hashes, as one nested JSON row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sha256_files(spark: SparkSession, path: str, most: int = 256 << 20) -> DataFrame:
    """path and sha256 of each file below a path, one task a file at most.

    Files of up to ``most`` bytes are read by Spark as one value each. Larger ones are streamed in the task, a
    megabyte at a time, through the file systems that Arrow opens (local, HDFS, S3, GCS); elsewhere they are an error.
    Spark does not list files without bytes, so these have no row.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = source.where(F.col("length") <= most).select("path", F.sha2("content", 256).alias("sha256"))

    def stream(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for table in tables:
            digests = []
            for name in table["path"]:
                system, inside = fs.FileSystem.from_uri(name if "//" in name or name.startswith("/") else name.replace(":/", ":///", 1))
                held = hashlib.sha256()
                with system.open_input_stream(inside) as file:
                    while piece := file.read(1 << 20):
                        held.update(piece)
                digests.append(held.hexdigest())
            yield pd.DataFrame({"path": table["path"], "sha256": digests})

    # The content is not read for these: only the columns that are used are.
    return small.unionByName(source.where(F.col("length") > most).select("path").mapInPandas(stream, "path string, sha256 string"))


def table_digest(table: DataFrame, columns: list[str], block: Column) -> DataFrame:
    """One row, sha256, of a table's content in the order of ``columns``, however it is laid out in files.

    Rows are hashed as text with a bar between columns and a dash for null; the rows of a ``block`` (a rising function
    of the first column, with as many rows as a task may hold) in order make its digest, and the blocks in order
    make the table's. So digests are gathered, one a block, and no rows.
    """
    told = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    rows = table.select(block.alias("block"), F.struct(*columns).alias("at"), F.sha2(told, 256).alias("digest"))
    joined = lambda listed: F.sha2(F.array_join(F.transform(F.sort_array(listed), lambda x: x["digest"]), ""), 256)
    blocks = rows.groupBy("block").agg(joined(F.collect_list(F.struct("at", "digest"))).alias("digest"))
    return blocks.agg(joined(F.collect_list(F.struct("block", "digest"))).alias("sha256"))


def table_summary(df: DataFrame, name: str) -> DataFrame:
    """path, n_rows, n_cols, date_min, date_max of a table; dates are null without a date column."""
    dates = [F.min("date").cast("string"), F.max("date").cast("string")] if "date" in df.columns else [F.lit(None).cast("string")] * 2
    return df.agg(F.count("*").alias("n_rows"), dates[0].alias("date_min"), dates[1].alias("date_max")).select(F.lit(name).alias("path"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"), "date_min", "date_max")


def file_summary(spark: SparkSession, path: str) -> DataFrame:
    """A table's summary with one hash over its files' hashes in order; the hash alone if it is no Parquet."""
    digest = sha256_files(spark, path).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256"))
    try:
        summary = table_summary(spark.read.parquet(path), path)
    except Exception as error:
        if "PARQUET" not in str(error).upper() and "SCHEMA" not in str(error).upper():
            raise
        summary = spark.range(1).select(F.lit(path).alias("path"), F.lit(None).cast("bigint").alias("n_rows"), F.lit(None).cast("bigint").alias("n_cols"), F.lit(None).cast("string").alias("date_min"), F.lit(None).cast("string").alias("date_max"))
    return summary.join(digest)


def manifest(stage: str, inputs: DataFrame, outputs: DataFrame, spec: dict[str, str] | None = None, env: dict[str, str] | None = None, dataset_id: str = "v1", created_at: str | None = None, git_commit: str = "unknown", calendar: str = "XNYS") -> DataFrame:
    """One row: stage, dataset_id, created_at, git_commit, calendar, spec, inputs, outputs and environment.

    inputs and outputs are summaries, one row a table (file_summary() has hashes, table_summary() none). created_at
    is the time of the query in UTC if not given; the commit is passed in.
    """
    gathered = [side.agg(F.array_sort(F.collect_list(F.struct(*side.columns))).alias(name)) for side, name in ((inputs, "inputs"), (outputs, "outputs"))]
    pairs = lambda d: F.create_map(*(F.lit(x) for kv in sorted((d or {}).items()) for x in kv)) if d else F.lit(None).cast("map<string,string>")
    made = F.lit(created_at) if created_at else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    told = {"stage": F.lit(stage), "dataset_id": F.lit(dataset_id), "created_at": made, "git_commit": F.lit(git_commit), "calendar": F.lit(calendar), "spec": pairs(spec)}
    return gathered[0].join(gathered[1]).select(*(v.alias(n) for n, v in told.items()), "inputs", "outputs", pairs(env).alias("env"))


def write_manifest(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)
