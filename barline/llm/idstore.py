"""Content-addressed storage of token ids: unique chunks, document recipes and Merkle manifests.

A store is a folder of three Parquet tables.

chunks    digest (SHA-256 of the ids), ids (little-endian unsigned 16-bit, or 32-bit for larger vocabularies)
recipes   part, row, doc, n_tokens, chunks [digest, n]; files and rows lie in ascending document order
manifest  part, n_docs, n_tokens, base (ids in all parts before), width (bytes of an id), root (Merkle root over the
          part's recipes)
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm.shared import discard, written
from barline.llm.wordcodec import WordCodec, text_groups

#: The rolling hash spans so many ids; its least bits choose the cuts.
SPAN = 16
RECIPE = "row long, doc long, n_tokens long, chunks array<struct<digest:binary,n:int>>, data array<binary>"


def rolling_marks(ids: np.ndarray, mean: int) -> np.ndarray:
    """Places after which a chunk may end: where the hash of the last SPAN ids has zero in its low bits."""
    rolled = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    rolled ^= rolled >> np.uint64(29)
    span, factor = 1, 0xD6E8FEB86659FD93
    while span < SPAN:  # a polynomial over the window, so that it depends on the window alone: 2, 4, 8, 16 ids
        rolled[span:] += rolled[:-span] * np.uint64(factor)
        span, factor = 2 * span, factor * factor % (1 << 64)
    return np.flatnonzero((rolled >> np.uint64(40)) & np.uint64(mean - 1) == 0) + 1


def cut_points(ids: np.ndarray, mean: int, least: int, most: int) -> list[int]:
    """Ends of the content-defined chunks of one sequence, of least to most ids; the last may be shorter.

    mean is a power of two; least is SPAN or more.
    """
    return document_cuts(rolling_marks(ids, mean).tolist(), 0, len(ids), least, most)


def document_cuts(marks: list[int], begin: int, stop: int, least: int, most: int) -> list[int]:
    """The same for ids begin to stop of a longer sequence, from the marks in that range.

    A chunk has SPAN ids or more, so a mark that is used depends on the document's own ids alone.
    """
    ends, start = [], begin
    for cut in [*marks, stop]:
        while cut - start > most:
            start += most
            ends.append(start)
        if cut - start >= least or cut == stop and cut > start:
            ends.append(cut)
            start = cut
    return ends


def _times_x(value: np.ndarray) -> np.ndarray:
    """value * x in the field of CRC-32, bits reflected."""
    return value >> np.uint32(1) ^ np.where(value & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))


@cache
def _shift_tables() -> list[np.ndarray]:
    """For each k, the CRC of what a byte at each of 4 places adds once 2 ** k zero bytes follow: 4 by 256 a table."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        bits = _times_x(bits)
    out = []
    for _ in range(40):
        table = np.zeros((4, 256), np.uint32)
        for place in range(4):
            for bit in range(8):
                table[place, 1 << bit : 2 << bit] = table[place, : 1 << bit] ^ bits[8 * place + bit]
        out.append(table)
        bits = _shifted(bits, table)
    return out


def _shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    low, high = np.uint32(255), np.uint32(8)
    return table[0, crc & low] ^ table[1, crc >> high & low] ^ table[2, crc >> np.uint32(16) & low] ^ table[3, crc >> np.uint32(24)]


def joined_crc32(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The CRC-32 of byte strings in turn from that of each, for many rows of strings at once.

    crcs and sizes (bytes) lie end to end, ``first`` is where each row begins; a row has one string or more. A
    string's CRC is shifted by the bytes that follow it in its row, and the shifted ones are added.
    """
    ends = np.cumsum(sizes, dtype=np.int64)
    counts = np.diff(np.append(first, len(crcs)))
    rest, held = np.repeat(ends[first + counts - 1], counts) - ends, crcs.astype(np.uint32)
    for k in range(int(rest.max(initial=0)).bit_length()):
        at = np.flatnonzero(rest >> k & 1)
        held[at] = _shifted(held[at], _shift_tables()[k])
    return np.bitwise_xor.reduceat(held, first) if len(first) else held


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, mean: int = 256, least: int = 64, most: int = 2048, parts: int | None = None, doc: str = "doc_id", text: str = "text", plain: bool = False) -> None:
    """Encodes every whole text, adds ``end_id``, and writes the ids to a store at ``path``.

    With ``plain`` the tokenizer's special tokens in a text are ordinary text, else their ids.

    Ids are cut where a rolling hash says, so passages that documents share become equal chunks, and each unique
    chunk is written once. A null or empty text has the end id alone. Documents lie in ascending id order, null
    first; repeated rows each have a recipe, in a fixed order. Only digests are sorted and joined; ids move once,
    to the file of their digest, after repeats within a task are dropped.
    """
    spark, width = docs.sparkSession, 2 if max(*WordCodec.of(tokenizer).library.get_vocab().values(), end_id) < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = WordCodec.of(tokenizer, plain), set()
        end = np.array([end_id], "<u4").tobytes()
        for rows in text_groups(batches, 2):
            coded = [c + end for c in codec.encode_all([t or "" for t in rows.column(2).to_pylist()])]
            ids = np.frombuffer(b"".join(coded), "<u4")
            raw = memoryview(ids.astype(f"<u{width}").tobytes())
            edges = np.cumsum([0, *(len(c) // 4 for c in coded)])
            marks = rolling_marks(ids, mean)
            inside = np.searchsorted(marks, edges, "right")
            marks, digests, datas, sizes, offsets, a = marks.tolist(), [], [], [], [0], 0
            for k, (begin, stop) in enumerate(pairwise(edges.tolist())):
                for b in document_cuts(marks[inside[k] : inside[k + 1]], begin, stop, least, most):
                    chunk = raw[width * a : width * b]
                    digest = hashlib.sha256(chunk).digest()
                    digests.append(digest)
                    sizes.append(b - a)
                    if digest in seen:
                        datas.append(None)
                    else:
                        datas.append(bytes(chunk))
                        seen.add(digest)
                    a = b
                offsets.append(len(sizes))
            if len(seen) > 500_000:
                seen.clear()
            place = pa.array(offsets, pa.int32())
            recipes = pa.ListArray.from_arrays(place, pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32())], ["digest", "n"]))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(edges)), recipes, pa.ListArray.from_arrays(place, pa.array(datas, pa.binary()))], ["row", "doc", "n_tokens", "chunks", "data"])

    staged = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, RECIPE))
    chunks = staged.select(F.explode(F.arrays_zip(F.col("chunks.digest").alias("digest"), F.col("data").alias("ids"))).alias("c")).select("c.digest", "c.ids").where("ids IS NOT NULL")
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Spark sorts by digest and spills, so a task's memory does not grow with its digests.
    chunks.repartition(n, "digest").sortWithinPartitions("digest").mapInArrow(first_of_each, "digest binary, ids binary").write.option("compression", "zstd").parquet(f"{path}/chunks")
    ordered = staged.select("row", "doc", "n_tokens", "chunks").repartitionByRange(n, F.col("doc").asc_nulls_first(), F.col("row"))
    ordered.sortWithinPartitions(F.col("doc").asc_nulls_first(), "row").select(F.spark_partition_id().alias("part"), "row", "doc", "n_tokens", "chunks").write.option("compression", "zstd").parquet(f"{path}/recipes")
    discard(staged)
    recipes = read_recipes(spark, path)
    totals = recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).join(merkle_roots(recipes), "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    totals.select("part", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), F.lit(width).alias("width"), "root").coalesce(1).write.parquet(f"{path}/manifest")


def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, ids) of one partition, sorted by digest, without repeats of a digest: only the last one is held."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        digests = batch.column(0)
        same = [digests[0].as_py() == before, *pa.compute.equal(digests.slice(1), digests.slice(0, len(digests) - 1)).to_pylist()]
        before = digests[-1].as_py()
        yield batch.filter(pa.array([not x for x in same])) if any(same) else batch


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, row long, doc long, n_tokens long, chunks array<struct<digest:binary,n:int>>").parquet(f"{path}/recipes")


def _place(order: Column) -> Column:
    return F.row_number().over(Window.partitionBy("part").orderBy(F.col("doc").asc_nulls_first(), order)) - 1


def merkle_roots(recipes: DataFrame, fanout: int = 256) -> DataFrame:
    """The Merkle root of each part: hashes of its recipes in order, then hashes of up to ``fanout`` hashes."""
    leaf = F.sha2(F.concat_ws(",", F.col("doc").cast("string"), F.col("n_tokens").cast("string"), F.array_join(F.transform("chunks", lambda c: F.hex(c["digest"])), ",")), 256)
    level = recipes.select("part", _place(F.col("row")).alias("place"), leaf.alias("hash"))
    for _ in range(4):  # 256 ** 4 recipes a part
        level = level.groupBy("part", F.floor(F.col("place") / fanout).alias("place")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash"))
    return level.select("part", F.col("hash").alias("root"))


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """Parts whose recipes differ from the manifest, and chunks whose ids differ from their digest: none if whole."""
    recipes, manifest = read_recipes(spark, path), spark.read.parquet(f"{path}/manifest")
    parts = manifest.join(merkle_roots(recipes).withColumnRenamed("root", "found"), "part", "full").where(~F.col("root").eqNullSafe(F.col("found")))
    bad = spark.read.parquet(f"{path}/chunks").where(F.sha2("ids", 256) != F.lower(F.hex("digest")))
    return parts.select(F.lit("part").alias("kind"), F.col("part").cast("string").alias("name")).union(bad.select(F.lit("chunk"), F.hex("digest")))


def id_width(spark: SparkSession, path: str) -> int:
    """Bytes of an id in a store, as its manifest says; 2 for a store without documents."""
    return spark.read.parquet(f"{path}/manifest").agg(F.max("width")).first()[0] or 2


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """digest, n and crc32 (of the ids as unsigned 32-bit) of every stored chunk, from its bytes.

    A chunk whose bytes do not have its digest is an error.
    """
    kind = f"<u{id_width(spark, path)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sums, counts = batch.column(0).to_pylist(), [], []
            for digest, raw in zip(digests, batch.column(1).to_pylist(), strict=True):
                if hashlib.sha256(raw).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                ids = np.frombuffer(raw, kind)
                counts.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(sums, pa.int64())], ["digest", "n", "crc"])

    return spark.read.parquet(f"{path}/chunks").select("digest", "ids").mapInArrow(run, "digest binary, n int, crc long")


def document_sums(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from a store: doc, start (ids of all documents before it), n_tokens, crc32 of its ids.

    Each stored chunk is read and summed once; documents join the sums by digest and combine them in order, so no
    ids are shuffled, and a chunk that a third of the documents share is a skewed join that Spark splits. Errors
    are a chunk that is missing or differs from its digest, and a part whose recipes differ from the manifest's
    Merkle root. A null id stays null and comes first; repeated rows come back each; an empty store gives no rows.
    """
    recipes = read_recipes(spark, path)
    uses = recipes.select("part", "row", "doc", F.posexplode("chunks").alias("k", "c")).select("part", "row", "doc", "k", F.col("c.digest").alias("digest"))
    summed = uses.join(chunk_sums(spark, path), "digest", "left")
    per_doc = summed.groupBy("part", "row", "doc").agg(F.sort_array(F.collect_list(F.struct("k", "n", "crc"))).alias("sums"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes, sums = lists.flatten().field("n"), lists.flatten().field("crc")
            if sizes.null_count:
                raise ValueError("a chunk of a recipe is not in the store")
            first = np.asarray(lists.offsets)[:-1].astype(np.int64) - lists.offsets[0].as_py()
            counts = np.asarray(sizes).astype(np.int64)
            total = np.add.reduceat(counts, first) if len(first) else counts
            crc = joined_crc32(np.asarray(sums), 4 * counts, first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total), pa.array(crc.astype(np.int64))], ["part", "row", "doc", "n_tokens", "ids_crc32"])

    back = per_doc.mapInArrow(run, "part int, row long, doc long, n_tokens long, ids_crc32 long")
    earlier = Window.partitionBy("part").orderBy(F.col("doc").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)
    found = spark.read.parquet(f"{path}/manifest").join(merkle_roots(recipes).withColumnRenamed("root", "found"), "part", "left")
    whole = F.when(F.col("root").eqNullSafe(F.col("found")), F.col("base")).otherwise(F.raise_error(F.concat(F.lit("the recipes of part "), "part", F.lit(" differ from the manifest"))))
    base = found.select("part", whole.alias("base"))  # one row a part
    return back.withColumn("local", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).join(F.broadcast(base), "part").select("doc", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc and chunk bytes in order (array of binary): the ids themselves, of the width that id_width() tells.

    A null id stays null, repeated rows come back each, an empty store gives no rows; a missing chunk is a null.
    """
    uses = read_recipes(spark, path).select("row", "doc", F.posexplode("chunks").alias("k", "c")).select("row", "doc", "k", F.col("c.digest").alias("digest"))
    stored = spark.read.parquet(f"{path}/chunks")
    return uses.join(stored, "digest", "left").groupBy("row", "doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]).alias("ids"))
