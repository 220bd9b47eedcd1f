"""A corpus pipeline: documents to packed training windows. Each stage works on all that the one before kept.

Every stage takes null ids and texts, repeated rows, empty tables and further columns: what becomes of each is said
with the stage and with the operator that it calls.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import packing, quality, secrets, simhash
from barline.llm.shared import discard, fresh, named, written


#: Rows that executor and Python worker hold at once, each on its side; Spark's own default is 10,000 whole texts.
BATCH_ROWS = 500
#: Words that a packing worker keeps: some 50 MB, where a million and their pieces are over 200.
WORDS = 200_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session to hand rows to Python workers in batches of BATCH_ROWS at most; a smaller number stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, with all columns of docs.

    A null or empty text has no words and goes; a null id or language does not matter; repeated rows are judged each.
    """
    own = [c for c in docs.columns if c in quality.RESULTS]  # columns of docs named like a result
    aside = dict(zip(own, fresh(docs.columns, *(f"own {c}" for c in own)), strict=True))
    judged = quality.quality(docs.withColumns({v: F.col(c) for c, v in aside.items()}) if own else docs)
    return judged.where("kept").select(*(named(aside.get(c, c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, the one with the least id, with all columns of docs.

    Rows are told apart by id and text, so rows that share an id both stay if unlike; of repeated rows one stays; null
    ids come last; null and empty texts are one group.
    """
    small_batches(spark)
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets replaced in their texts and n_chars (if docs has it) to match.

    A null text stays null, repeated rows stay each.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents laid into windows of 1024 token ids.

    A null or empty text is one end id, a null id stays null, repeated rows are packed each.
    """
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), words=WORDS)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]
#: Token ids and forests are beyond SQL; tests hold the stages and the chain against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over all documents; each result is written and read back as the next one's input."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        held.append(docs)
    for table in held[:-1]:
        discard(table)
    return STAGES[-1][1](spark, docs, sf_dir)
