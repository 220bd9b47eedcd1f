"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder named by spark.checkpoint.dir.

    Unset, a local master gets a temporary folder; a cluster is refused, since its machines share none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            held = spark.sparkContext.getCheckpointDir()
        base = held
    return f"{base.rstrip('/')}/barline-{uuid.uuid4().hex}"


#: Rows of a file, where written() knows how many rows there are.
FILE_ROWS = 4096


def written(df: DataFrame, sort: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """The same rows, written once as Parquet and read back, so that a lost executor costs no recomputation.

    rows: how many there are at most, if known. Few rows then go to few files: each file costs a task, and on a local
    file system without Hadoop's native library some processes that set its mode. Rows that fill a file for each
    shuffle partition are written as they are dealt.
    """
    path = shared_dir(df.sparkSession)
    if rows is not None and (files := rows // FILE_ROWS + 1) < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(files)
    (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files behind a table made by written(), once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("barline-"):
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
