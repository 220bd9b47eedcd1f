"""WARC archives of pages, and a Merkle audit that finds damaged records between replicas."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.shared import discard, written

BREAK = "\r\n\r\n"


def record_text(page: Column, url: Column, body: Column) -> Column:
    """A WARC 1.0 resource record without the closing blank lines, which the writer puts between records."""
    content = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", ""), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(content).cast("string")
    )
    return F.concat(head, F.lit(BREAK), content)


def write_archive(pages: DataFrame, path: str, segment_bytes: int = 64 << 20, page: str = "page_id", url: str = "url", body: str = "html") -> None:
    """Writes pages as gzipped WARC files of about ``segment_bytes`` each, records in ascending page order in a file.

    Rows are dealt by the place where they were read, so that no order or repetition of pages makes a file large;
    only a record that is longer by itself does. A null body is empty, a null page has no number; repeated rows are
    records each; an empty table gives files without records; other columns are not read.
    """
    rows = pages.select(page, url, body, F.monotonically_increasing_id().alias("__row"))
    record = record_text(F.col(page), F.col(url), F.col(body))
    total = pages.agg(F.sum(F.octet_length(record))).first()[0] or 0
    ordered = rows.repartition(max(1, -(-total // segment_bytes)), "__row").sortWithinPartitions(F.col(page).asc_nulls_first(), F.xxhash64(url, body), "__row")
    ordered.select(record.alias("value")).write.option("lineSep", BREAK).option("compression", "gzip").text(path)


def copy_archive(spark: SparkSession, source: str, path: str, record: Column | None = None) -> None:
    """Writes the archive at source anew: each segment to one file by the task that reads it, in the same order.

    record: what becomes of a record, from the columns of read_archive() with content; by default it stays.
    """
    held = read_archive(spark, source, content=True).withColumn("record", F.col("record") if record is None else record)
    ordered = held.select(F.col("segment").alias("file"), "seq", "record").sortWithinPartitions("file", "seq")
    ordered.select("file", F.col("record").alias("value")).write.partitionBy("file").option("lineSep", BREAK).option("compression", "gzip").text(path)


def parse_head(head: bytes) -> dict[bytes, bytes]:
    """Header lines by lower-case name; of lines of one name the first counts."""
    out: dict[bytes, bytes] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def unpacked(raw: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of a file, plain or of one or more gzip members, what ``step`` of its bytes hold at a time."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[k : k + step] for k in range(0, len(raw), step))
        return
    member, fed = zlib.decompressobj(31), False
    for k in range(0, len(raw), step):
        rest = raw[k : k + step]
        while rest:
            yield member.decompress(rest)
            rest, fed = member.unused_data, not member.eof
            if member.eof:
                member = zlib.decompressobj(31)
    if fed:
        raise ValueError("the file is cut off")


def parse_records(pieces: Iterable[bytes] | bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """Offset, header and bytes (closing lines included) of each record of an uncompressed WARC file, given in pieces.

    One record and one piece are held.
    """
    held, at, source = bytearray(), 0, iter([pieces] if isinstance(pieces, bytes) else pieces)

    def more() -> bool:
        piece = next(source, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held:
                    raise ValueError(f"the record at {at} is cut off")
                return
        head = parse_head(bytes(held[:end]))
        stop = end + 4 + int(head[b"content-length"]) + 4
        while len(held) < stop:
            if not more():
                raise ValueError(f"the record at {at} is cut off")
        yield at, head, bytes(held[:stop])
        del held[:stop]
        at += stop


def read_archive(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """segment (file name without its run-specific part), seq, offset, length, page_id and digest of every record.

    content adds record, the text without the closing lines. Each file is read by one task, and up to 1,000 records
    or 2 MB leave it at once; it is unpacked piece by piece, so a task holds the packed file and a record. A record without a page's number has
    a null page_id; repeated records come back each; an archive without records gives no rows.
    """
    kinds, names = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()], ["segment", "seq", "offset", "length", "page_id", "digest", "record"]
    width = len(names) if content else len(names) - 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[:width], strict=True)], names[:width])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment, rows, size = int((re.search(r"/file=(\d+)/", name) or re.search(r"part-(\d+)", name))[1]), [], 0
                for k, (at, head, record) in enumerate(parse_records(unpacked(held.as_py()))):
                    page = re.fullmatch(rb"<urn:page:(-?\d+)>", head.get(b"warc-record-id", b""))
                    rows.append((segment, k, at, len(record), int(page[1]) if page else None, hashlib.sha256(record).digest(), *([record[:-4].decode()] if content else [])))
                    size += len(record) if content else 100
                    if len(rows) == 1000 or size > 2_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "segment int, seq long, offset long, length long, page_id long, digest binary" + ", record string" * content)


def merkle_levels(records: DataFrame, levels: int, fanout: int) -> list[DataFrame]:
    """Tables (segment, node, start, stop, hash) from the records (level 0) up to one root a segment.

    A node's hash covers its children's hashes in order and the byte range they span. Each level is written, so that
    the plan of an audit does not repeat the levels below at every step.
    """
    level = written(records.select("segment", F.col("seq").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), F.sha2(F.concat("digest", F.col("offset").cast("string").cast("binary"), F.lit(b":"), F.col("length").cast("string").cast("binary")), 256).alias("hash")))
    out = [level]
    for _ in range(levels):
        children = F.array_sort(F.collect_list(F.struct("node", "start", "stop", "hash")))
        grouped = level.groupBy("segment", F.floor(F.col("node") / fanout).alias("node")).agg(children.alias("c"))
        start, stop = F.col("c")[0]["start"], F.element_at("c", -1)["stop"]
        level = written(grouped.select("segment", "node", start.alias("start"), stop.alias("stop"), F.sha2(F.concat_ws(",", F.array_join(F.transform("c", lambda x: x["hash"]), ""), start, stop), 256).alias("hash")))
        out.append(level)
    return out


def audit(left: DataFrame, right: DataFrame, fanout: int = 16) -> DataFrame:
    """Records (segment, seq) in which two replicas differ, with both digests (null where one has none).

    Trees of ordered offset ranges are built over each replica's records. Roots are compared first, then only the
    children of mismatching nodes, level by level down to the records. Groups are of ``fanout`` hashes, so none
    grows with the archive. Two archives without records differ in none, one without records misses all of the
    other; (segment, seq) is to be unique in each; columns other than those of read_archive() are not read.
    """
    most = (left.agg(F.max("seq").alias("m")).union(right.agg(F.max("seq").alias("m")))).agg(F.max("m")).first()[0]
    levels = 1
    while fanout**levels <= (most or 0):
        levels += 1
    a, b = merkle_levels(left, levels, fanout), merkle_levels(right, levels, fanout)
    suspects: list[DataFrame] = []
    for x, y in zip(reversed(a), reversed(b), strict=True):
        mine, theirs = x.select("segment", "node", F.col("hash").alias("left_hash")), y.select("segment", "node", F.col("hash").alias("right_hash"))
        if suspects:
            parent = suspects[-1].select("segment", F.col("node").alias("parent"))
            mine = mine.withColumn("parent", F.floor(F.col("node") / fanout)).join(parent, ["segment", "parent"], "left_semi").drop("parent")
            theirs = theirs.withColumn("parent", F.floor(F.col("node") / fanout)).join(parent, ["segment", "parent"], "left_semi").drop("parent")
        suspects.append(written(mine.join(theirs, ["segment", "node"], "full").where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))))
    found = suspects[-1].select("segment", F.col("node").alias("seq"))
    mine = left.join(found, ["segment", "seq"], "left_semi").select("segment", "seq", "offset", "length", "page_id", F.lower(F.hex("digest")).alias("left_digest"))
    theirs = right.join(found, ["segment", "seq"], "left_semi").select("segment", "seq", F.col("offset").alias("o2"), F.col("length").alias("l2"), F.col("page_id").alias("p2"), F.lower(F.hex("digest")).alias("right_digest"))
    both = mine.join(theirs, ["segment", "seq"], "full")
    out = written(both.select("segment", "seq", F.coalesce("offset", "o2").alias("offset"), F.coalesce("length", "l2").alias("length"), F.coalesce("page_id", "p2").alias("page_id"), "left_digest", "right_digest"))
    for table in (*a, *b, *suspects):
        discard(table)
    return out


def fixity(records: DataFrame, damaged: DataFrame, fanout: int = 16) -> DataFrame:
    """Every record of either replica with status intact, altered, missing (in the right one) or extra.

    Nulls, repeated rows, empty archives and other columns are as in audit(); a record without a page's number keeps
    its null page_id.
    """
    bad = audit(records, damaged, fanout)
    status = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("altered")
    rest = records.join(bad.select("segment", "seq"), ["segment", "seq"], "left_anti")
    good = rest.select("segment", "seq", "offset", "length", "page_id", F.lower(F.hex("digest")).alias("digest"), F.lit("intact").alias("status"))
    return good.unionByName(bad.select("segment", "seq", "offset", "length", "page_id", F.coalesce("left_digest", "right_digest").alias("digest"), status.alias("status")))
