"""SimHash near-copy groups: BK-trees over shards of fingerprints, and connected components of their links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.shared import discard, fresh, named, written
from barline.llm.wordcodec import text_groups

SEED = 42


def fingerprint(text: bytes, words: int = 4) -> int:
    """64 bits; a bit is 1 if set in over half of the XXH64 of the word shingles, repeats included."""
    import xxhash

    found = text.lower().split()  # A-Z and the six ASCII white-space bytes only
    if not found:
        return 0
    joined, last = b" ".join(found), max(0, len(found) - words)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:last] + 1]).tolist()
    stops = ends[min(words, len(found)) - 1 :].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 100_000):
        ones += np.unpackbits(hashes[k : k + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and print (the fingerprint as a signed long) of every row; a null text has no words and print 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint((t.as_py() or "").encode(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc", "print"])

    return docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, "doc long, print long")


def shard_keys(n: int, radius: int) -> list[tuple[int, ...]]:
    """Sets of bit positions such that two fingerprints within the radius agree on all bits of one set or more.

    64 bits are cut into blocks; within the radius, all but ``radius`` blocks agree. More blocks make longer keys;
    as many are used as make an average shard of n prints hold 64 or fewer.
    """
    for blocks in range(radius + 1, 17):
        same = blocks - radius
        if n >> (64 * same // blocks) <= 64 or blocks == radius + 4:
            edges = [64 * i // blocks for i in range(blocks + 1)]
            return [tuple(b for i in chosen for b in range(edges[i], edges[i + 1])) for chosen in combinations(range(blocks), same)]
    raise AssertionError


class BkForest:
    """A BK-tree for each group of distinct fingerprints: a node's children are keyed by their distance from it.

    All trees grow level by level side by side: of the rows below a node at one distance, the first is the child
    and the others go below it.
    """

    def __init__(self, prints: np.ndarray, groups: np.ndarray):
        """prints: rows of unsigned 64-bit words. groups: equal numbers stand together."""
        n, self.prints, self.edges = len(prints), prints, 64 * prints.shape[1] + 1
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        self.root = np.repeat(first, np.diff(np.append(first, n)))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # children and their parents
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        parent, keys = self.root[rest], []
        while len(rest):
            key = parent * self.edges + self.far(rest, parent)
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            keys.append(key[new])
            self.levels.append((rest[new], key[new] // self.edges))
            parent = np.repeat(rest[new], np.diff(np.append(np.flatnonzero(new), len(rest))))[~new]
            rest = rest[~new]
        every = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.children = np.concatenate([c for c, _ in self.levels])[np.argsort(every)] if keys else every
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(every, minlength=self.edges * n), dtype=np.int32)])

    def far(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Differing bits of rows left and right."""
        return np.bitwise_count(self.prints[left] ^ self.prints[right]).sum(axis=1, dtype=np.int64)

    def label(self, radius: int, most: int = 1_000_000) -> np.ndarray:
        """The least row of each row's component under links within the radius, groups apart.

        Every row is looked up, and edges outside the radius are not followed. Lookups come in growing batches;
        between them each node learns whether all below it are one component, and a row of that component need not
        go there, so a group of thousands of copies of each other costs little more than one look at each.
        ``most`` (row, node) pairs are held at once.
        """
        n = len(self.prints)
        label, start, size = np.arange(n), 0, 256
        # Rows of large groups take turns, so that each batch has a few of every group.
        place = np.arange(n) - self.root
        queries = np.argsort(place, kind="stable")
        while start < n:
            low, high = label.copy(), label.copy()
            for child, parent in reversed(self.levels):
                np.minimum.at(low, parent, low[child])
                np.maximum.at(high, parent, high[child])
            one = low == high
            batch = queries[start : start + size]
            for left, right in self._links(batch, radius, most, label, low, one):
                label = merge_labels(label, left, right)
            start, size = start + size, size * 2
        return label

    def _links(self, batch: np.ndarray, radius: int, most: int, label: np.ndarray, below: np.ndarray, one: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = label.copy()  # labels at the start, as below and one are
        waiting = [(batch, self.root[batch])]
        while waiting:
            query, node = waiting.pop()
            if len(query) > most:
                waiting += [(query[k : k + most], node[k : k + most]) for k in range(0, len(query), most)]
                continue
            open_ = ~(one[node] & (below[node] == own[query]))
            query, node = query[open_], node[open_]
            if not len(query):
                continue
            far = self.far(query, node)
            near = (far <= radius) & (query != node)
            if near.any():
                yield query[near], node[near]
            low, high = self.begin[node * self.edges + np.maximum(far - radius, 0)], self.begin[node * self.edges + np.minimum(far + radius, self.edges - 1) + 1]
            count = (high - low).astype(np.int64)
            ends = np.cumsum(count)
            start = 0
            while start < len(query):  # children of so many pairs at once
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
                some = count[start:stop]
                if total := int(some.sum()):
                    step = np.arange(total) - np.repeat(np.cumsum(some) - some, some)
                    waiting.append((np.repeat(query[start:stop], some), self.children[np.repeat(low[start:stop], some) + step]))
                start = stop


def merge_labels(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels (the least row of each component) after the links left-right."""
    while True:
        a, b = label[left], label[right]
        open_ = a != b
        if not open_.any():
            return label
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def link_prints(prints: DataFrame, radius: int = 4, most: int = 20_000, rows_at_once: int = 100_000) -> DataFrame:
    """Links u, v between distinct fingerprints (column print) that connect all those within the radius.

    Each print goes to one shard for each key of shard_keys(), so no link is lost; see link_shards().
    """
    n = prints.count()
    keys = shard_keys(n, radius)

    def bits(where: tuple[int, ...]) -> Column:
        out, k = F.lit(0).cast("long"), 0
        while k < len(where):  # runs of adjacent bits
            run = 1
            while k + run < len(where) and where[k + run] == where[k] + run:
                run += 1
            out = F.shiftleft(out, run).bitwiseOR(F.shiftrightunsigned("print", where[k]).bitwiseAND(F.lit((1 << run) - 1)))
            k += run
        return out

    keyed = prints.select("print", F.explode(F.array(*(F.struct(F.lit(i).alias("set"), bits(w).alias("value")) for i, w in enumerate(keys)))).alias("k")).select("print", "k.set", "k.value")
    return link_shards(keyed, radius, most, rows_at_once)


def deal(keyed: DataFrame, by: list[str], large: DataFrame) -> DataFrame:
    """keyed with its shard: the columns ``by``, cut into the parts that large has for them; a shard has two parts."""
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    return (
        keyed.join(large, by, "left")
        .withColumns({"parts": F.coalesce("parts", F.lit(1))})
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .withColumn("shard", F.xxhash64(*by, "i", "j"))
    )


def link_shards(keyed: DataFrame, radius: int, most: int, rows_at_once: int) -> DataFrame:
    """Links u, v between prints that share a key (set, value) and that are within the radius.

    With a column words (array of long) those are compared, else the prints themselves.
    A shard is all prints of one key. Its BK-tree is built in the task that holds it and every print of the shard is
    looked up. A shard of over ``most`` prints is cut into parts: each part's tree goes to every later part's prints,
    so no task holds more than two parts. Of the links found a spanning forest leaves the task, never all pairs.
    """
    large = keyed.groupBy("set", "value").count().where(F.col("count") > most).withColumn("parts", F.ceil(F.col("count") / (most // 2)).cast("int")).drop("count")
    dealt, wide = deal(keyed, ["set", "value"], large), "words" in keyed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(groups: np.ndarray, values: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
            label = BkForest(words.view(np.uint64), groups).label(radius)
            moved = np.flatnonzero(label != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[label[moved]])], ["u", "v"])

        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(batch.num_columns - 1)
            words = (words.flatten() if wide else words).to_numpy().reshape(batch.num_rows, -1)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), words))
            size += batch.num_rows
            if size >= rows_at_once:
                groups, values, words = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.searchsorted(groups, groups[-1]))  # the last shard may go on
                if whole:
                    yield from linked(groups[:whole], values[:whole], np.ascontiguousarray(words[:whole]))
                held, size = [(groups[whole:], values[whole:], words[whole:])], size - whole
        if size:
            groups, values, words = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from linked(groups, values, np.ascontiguousarray(words))

    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select("shard", "print", *["words"] * wide).repartition(parts, "shard").sortWithinPartitions("shard", "print").mapInArrow(run, "u long, v long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the least node it is connected with) of every node in a link, by alternating stars.

    Each round joins links to the least neighbour of their nodes and writes the new links to the shared folder;
    a node with very many links is pre-aggregated and then a skewed join. It ends when a round changes nothing.
    """
    least, most = F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")
    edges = written(links.where("u <> v").select(most, least).distinct())  # from the greater node u to the lesser v
    state, count = None, edges.count()  # no round has more links than the one before
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        big = written(large, rows=count)
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        joined = big.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m")).distinct()
        new = written(small.select(most, least), rows=count)
        discard(edges)
        discard(big)
        edges, before = new, state
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        count = state[0]
        if state == before:
            out = written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct()), rows=2 * count)
            discard(edges)
            return out
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def grouped(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """print and component (the least of ``least`` reachable) from distinct (print, least) and links between prints."""
    roots, count = components(links).withColumnRenamed("node", "print"), distinct.count()
    rooted = written(distinct.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), rows=count)
    # Written, so that a root with very many prints is a skewed join of two plain tables.
    leasts = written(rooted.groupBy("root").agg(F.min("least").alias("component")), rows=count)
    out = written(rooted.join(leasts, "root").select("print", "component"), rows=count)
    for table in (roots, rooted, leasts):
        discard(table)
    return out


def near_groups(docs: DataFrame, radius: int = 4, words: int = 4, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """{doc}, print (signed long) and component of every row.

    A to Z are lower-cased; words are runs of characters other than space and U+0009 to U+000D; fewer than
    ``words`` words are one shingle; no words (or a null text) give print 0, linked like any other. Prints within
    ``radius`` differing bits link, and component is the least id reachable over links. Rows with a null id stay
    and count for no component; a component of those alone is null. Repeated rows come back each; an empty table
    gives no rows; other columns are not read.
    """
    held = written(fingerprints(docs, words, doc, text))
    distinct = written(held.groupBy("print").agg(F.min("doc").alias("least")))
    by_print = grouped(distinct, link_prints(distinct.select("print"), radius))
    discard(distinct)
    return held.join(by_print, "print").select(F.col("doc").alias(doc), "print", "component")


#: Bits of a wide print.
WIDE = 256
#: Differing bits of wide prints up to which two sets of shingles are compared. At a similarity of 0.8, 39 are expected
#: with a deviation of 5.7 (48 for sets of a few shingles); unrelated sets differ in 128 with a deviation of 8.
NEAR = 80
#: Shingles are counted in so many buckets, by the upper bits of their hash.
BUCKET_BITS = 16


def bit_counts(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit prints in a row: each takes the hashes, mixed anew, and the majority of each bit."""
    out = np.empty(words, np.uint64)
    for w in range(words):
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * w)
        mixed ^= mixed >> np.uint64(31)
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for k in range(0, len(mixed), 100_000):
            ones += np.unpackbits(mixed[k : k + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = int.from_bytes(np.packbits(2 * ones > len(mixed), bitorder="little").tobytes(), "little")
    return out


#: What tells rows apart: rows of one id and one text are repeats. In this order the row that stays is the least.
ROW_KEY = ["no_doc", "doc", "k1", "k2"]


def row_key(doc: str, text: str) -> list[Column]:
    """ROW_KEY of a row: its id, null last, and 128 bits of its text; a null text is not an empty one."""
    told = F.concat_ws("", F.when(F.col(text).isNull(), "n").otherwise("t"), F.col(text).cast("string"))
    return [F.col(doc).isNull().alias("no_doc"), F.col(doc).cast("long").alias("doc"), F.xxhash64(told).alias("k1"), F.xxhash64(F.lit(SEED), told).alias("k2")]


def wide_prints(docs: DataFrame, words: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """words (the wide print) and shingles (hashes of the distinct ones) of every row, arrays of long; and its ROW_KEY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def shingles(found: list[bytes]) -> np.ndarray:
            joined, last = b" ".join(found), max(0, len(found) - words)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
            starts = np.concatenate([[0], ends[:last] + 1]).tolist()
            stops = ends[min(words, len(found)) - 1 :].tolist()
            return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))

        for batch in text_groups(batches, 0):
            prints, sets = [], []
            for t in batch.column(0):
                found = (t.as_py() or "").encode().lower().split()
                sets.append(shingles(found) if found else np.zeros(0, np.uint64))
                prints.append(bit_counts(sets[-1], WIDE // 64) if found else np.zeros(WIDE // 64, np.uint64))
            arrays = [pa.array([x.view(np.int64) for x in some], pa.list_(pa.int64())) for some in (prints, sets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], [*ROW_KEY, "words", "shingles"])

    return docs.select(F.col(text).alias("text"), *row_key(doc, text)).mapInArrow(run, "no_doc boolean, doc long, k1 long, k2 long, words array<long>, shingles array<long>")


def bucket_counts(held: DataFrame) -> np.ndarray:
    """How many shingles of all rows fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            tokens = batch.column(0).flatten().to_numpy().view(np.uint64)
            total += np.bincount((tokens >> np.uint64(64 - BUCKET_BITS)).view(np.int64), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for bucket, n in held.select("shingles").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def prefix_keys(held: DataFrame, similarity: float) -> DataFrame:
    """print and value: shingles of each set such that two sets with ``similarity`` or more have one in common.

    In one order of all shingles, sets that share s of their n share one of the first n - s + 1 of each. The order is
    by the count of a shingle's bucket and then by hash, so that common shingles come last; any order is as right.
    Values of one print alone are left out.
    """
    counts = bucket_counts(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, first = np.unique(batch.column(0).to_numpy(), return_index=True)  # copies in a batch once
            values = []
            for k in first.tolist():
                tokens = batch.column(1)[k].values.to_numpy()
                n = len(tokens)
                size = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
                often = counts[(tokens.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).view(np.int64)]
                values.append(tokens[np.lexsort((tokens, often))[:size]])
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(prints, [len(v) for v in values])), pa.array(np.concatenate(values))], ["print", "value"])

    keys = held.select("print", "shingles").mapInArrow(run, "print long, value long")
    shared = keys.groupBy("value").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low <> high").select("value")
    return keys.join(shared, "value").select("print", "value").distinct()


def set_links(prints: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all rows whose sets have a Jaccard similarity of ``similarity`` or more.

    prints: rows of unsigned 64-bit words; rows over NEAR bits apart are not compared. tokens: the sets, end to end.
    Rows are reached breadth first, and each meets only those not reached yet, so mutual copies cost one look each.
    """
    _, code = np.unique(tokens, return_inverse=True)
    starts, seen = np.cumsum(sizes) - sizes, np.zeros(len(code), bool)
    rest, queue, left, right = np.arange(len(sizes)), [], [], []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        row = queue.pop()
        own, n = code[starts[row] : starts[row] + sizes[row]], sizes[rest]
        can = np.minimum(n, sizes[row]) >= similarity * np.maximum(n, sizes[row]) - 1e-9
        can[can] = np.bitwise_count(prints[rest[can]] ^ prints[row]).sum(axis=1, dtype=np.int64) <= NEAR
        if not can.any():
            continue
        some = np.flatnonzero(can)
        count = sizes[rest[some]]
        first = np.cumsum(count) - count
        seen[own] = True
        same = np.add.reduceat(seen[code[np.arange(count.sum()) + np.repeat(starts[rest[some]] - first, count)]], first, dtype=np.int64)
        seen[own] = False
        hit = some[same * (1 + similarity) >= similarity * (count + sizes[row]) - 1e-9]
        left += [row] * len(hit)
        right += rest[hit].tolist()
        queue += rest[hit].tolist()
        rest = np.delete(rest, hit)
    return np.array(left, np.int64), np.array(right, np.int64)


def confirmed(held: DataFrame, links: DataFrame, similarity: float, most: int = 2_000_000) -> DataFrame:
    """Links u, v that connect the prints of held whose sets are as similar, among those that ``links`` connect.

    Each set goes once to the task of its component under ``links``. A component of over ``most`` shingles is cut
    into parts, and every two parts meet in a task.
    """
    nodes = components(links).withColumnRenamed("node", "print")
    # A bit for each node's print, in a table of fixed size: sets without a candidate do not move.
    cell, bit = F.pmod("print", F.lit(1 << 17)).alias("cell"), F.expr("shiftleft(1L, cast(pmod(shiftright(print, 17), 64) AS int))")
    cells = nodes.groupBy(cell).agg(F.bit_or(bit).alias("bits"))
    moved = held.select("print", "words", "shingles", cell).join(F.broadcast(cells), "cell").where(F.col("bits").bitwiseAND(bit) != 0)
    sets = moved.groupBy("print").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles")).join(nodes, "print")
    sets = written(sets.where(F.size("shingles") > 0))  # wide rows stay as dealt
    large = sets.groupBy("root").agg(F.sum(F.size("shingles")).alias("n")).where(F.col("n") > most).select("root", F.ceil(F.col("n") / (most // 2)).cast("int").alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(rows: list[tuple]) -> pa.RecordBatch:
            prints, sizes = np.array([r[2] for r in rows]).view(np.uint64), np.array([len(r[3]) for r in rows])
            u, v = set_links(prints, sizes, np.concatenate([r[3] for r in rows]), similarity)
            values = np.array([r[1] for r in rows], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(values[u]), pa.array(values[v])], ["u", "v"])

        held: list[tuple] = []
        for batch in batches:
            shards, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, shard in enumerate(shards):
                if held and held[0][0] != shard:
                    yield linked(held)
                    held = []
                held.append((shard, values[k], batch.column(2)[k].values.to_numpy(), batch.column(3)[k].values.to_numpy()))
        if held:
            yield linked(held)

    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = deal(sets, ["root"], large).select("shard", "print", "words", "shingles")
    out = written(dealt.repartition(parts, "shard").sortWithinPartitions("shard", "print").mapInArrow(run, "u long, v long"))
    discard(nodes)
    discard(sets)
    return out


def similar_rows(docs: DataFrame, similarity: float = 0.8, words: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """ROW_KEY, print and component (the least ROW_KEY reachable, a struct) of every row, repeats included.

    Rows link at ``similarity`` or more in word shingles. Candidates share a key of prefix_keys(), which loses none,
    and their 256-bit prints differ in NEAR bits or fewer; each link is then confirmed by the Jaccard similarity of
    the whole sets. Texts without words, null ones included, have one print and so are one group.
    """
    held = written(wide_prints(docs, words, doc, text).withColumn("print", F.xxhash64("shingles")))
    count = held.count()
    distinct = written(held.groupBy("print").agg(F.min(F.struct(*ROW_KEY)).alias("least"), F.first("words").alias("words")), rows=count)
    keys = prefix_keys(held, similarity).join(distinct.select("print", "words"), "print")
    keyed = written(keys.select("print", F.lit(0).alias("set"), "value", "words"))
    links = confirmed(held, link_shards(keyed, NEAR, most=10_000, rows_at_once=20_000), similarity)
    rows = written(held.select(*ROW_KEY, "print"), rows=count)
    discard(keyed)
    discard(held)
    out = written(rows.join(grouped(distinct.select("print", "least"), links), "print"), rows=count)
    for table in (distinct, links, rows):
        discard(table)
    return out


def similar_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """{doc}, print and component (the least id reachable) of every row of similar_rows()."""
    return similar_rows(docs, similarity, words, doc, text).select(F.col("doc").alias(doc), "print", F.col("component.doc").alias("component"))


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = 5, doc: str = "doc_id", text: str = "text", most: int = 2_000_000) -> DataFrame:
    """The rows of docs without near copies: of each group of similar_rows() one row stays, with all its columns.

    It is the row with the least id (rows with a null id come last), then the least hash of its text; rows that
    share an id are told apart by their texts, and of repeats (one id, one text) one stays. So every row that goes
    has a like one that stays. Null and empty texts, and texts of white space alone, are one group. An empty table
    stays empty.

    The keys of the rows that go meet docs in a join: broadcast up to ``most`` of them, as 2 million take some 100 MB,
    so texts do not move; beyond that they are shuffled, texts included.
    """
    rows = similar_rows(docs.select(named(doc), named(text)), similarity, words, doc, text)
    stays = F.col("component") == F.struct(*ROW_KEY)
    count = rows.count()
    gone = written(rows.where(~stays).select(*ROW_KEY).distinct(), rows=count)
    again = written(rows.where(stays).groupBy(*ROW_KEY).count().where("count > 1").drop("count"), rows=count)
    discard(rows)
    names = fresh(docs.columns, *ROW_KEY)
    others = fresh([*docs.columns, *names], *(f"{n} of" for n in names))
    told = docs.select("*", *(c.alias(n) for c, n in zip(row_key(doc, text), names, strict=True)))

    def meets(keys: DataFrame) -> tuple[DataFrame, Column]:
        listed = keys.toDF(*others)
        small = F.broadcast(listed) if keys.count() <= most else listed.hint("shuffle_hash")
        same = [named(n).eqNullSafe(named(o)) if k == "doc" else named(n) == named(o) for k, n, o in zip(ROW_KEY, names, others, strict=True)]
        return small, reduce(and_, same)

    once = told.join(*meets(gone), "left_anti")
    if not again.isEmpty():
        once = once.join(*meets(again), "left_anti").unionByName(told.join(*meets(again), "left_semi").dropDuplicates(names))
    return once.drop(*names)
