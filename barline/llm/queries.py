"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import audio, bytebpe, conversations, idstore, licenses, manifest, packing, quality, secrets, sharding, simhash, toxicity, warc
from barline.llm.shared import discard, shared_dir, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of all pages and a replica in which some were damaged, as WARC files; the audit of the two."""
    path = shared_dir(spark)
    warc.write_archive(_table(spark, sf_dir, "pages"), f"{path}/one")
    body = F.instr("record", warc.BREAK) + len(warc.BREAK)
    hit = (F.col("page_id") % 97 == 13) & (F.char_length("record") >= body)
    warc.copy_archive(spark, f"{path}/one", f"{path}/two", F.when(hit, F.overlay("record", F.lit("?"), body)).otherwise(F.col("record")))
    one, two = (written(warc.read_archive(spark, f"{path}/{name}")) for name in ("one", "two"))
    return warc.fixity(one, two).select("page_id", "length", "digest", "status")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bytebpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media are written and read back for the tensors, and these are written and read back for the feature."""
    media = written(audio.store_audio(_table(spark, sf_dir, "documents")))
    tensors = written(audio.audio_tensors(media))
    discard(media)
    return audio.audio_features(tensors).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    idstore.write_store(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return idstore.document_sums(spark, path).select(F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def _damaged(rows: DataFrame) -> DataFrame:
    """Conversations with turns dropped, emptied, cut, repeated and put in the user's role, by a checksum of their key."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    role = F.when(k == 4, "user").otherwise(space("role"))
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(k == 0, 0).when(k == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, and the digest of its cheapest repair."""
    rows = _table(spark, sf_dir, "conversations")
    report, turns = conversations.repair(_damaged(rows))
    digests = conversations.repaired_digests(turns)
    every = rows.select("conv_id").distinct()
    told, hashed = report.withColumnRenamed("conv_id", "c"), digests.select(F.col("conv_id").alias("h"), "sha256")
    joined = every.join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and which rows still verify after some texts were lower-cased."""
    docs = _table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest.merkle_manifest(docs, {"text": lowered}, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_fixity": op2_fixity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality": op4_quality,
    "op5_audio": op5_audio,
    "op6_secrets": op6_secrets,
    "op7_licenses": op7_licenses,
    "op8_shards": op8_shards,
    "op9_simhash": op9_simhash,
    "op10_id_store": op10_id_store,
    "op11_repair": op11_repair,
    "op12_manifest": op12_manifest,
    "op13_toxicity": op13_toxicity,
}
_RECORD = "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
ORACLE: dict[str, str] = {
    "op2_fixity": f"SELECT page_id, CAST(strlen({_RECORD}) AS BIGINT) AS length, sha256({_RECORD}) AS digest, CASE WHEN page_id % 97 = 13 AND length(html) > 0 THEN 'altered' ELSE 'intact' END AS status FROM pages",
    "op4_quality": quality.quality_sql(),
    "op7_licenses": licenses.license_sql(),
    "op12_manifest": manifest.manifest_sql(),
}
