"""Packing of documents into fixed windows of token ids by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.wordcodec import WordCodec, text_groups

PIECES = "{doc} long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """A segment tree over remaining capacities: a node counts the open windows below it."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.at[capacity].append(window)
            self._add(capacity, 1)

    def tightest(self, need: int) -> int | None:
        """The least capacity of an open window that is need or more."""
        node, count = need + self.size, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.size

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.at[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each piece (1 to window long), and the number of windows used.

    Pieces are placed longest first, equal ones in the order given.
    """
    places, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    tree = OpenWindows(window)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        if need == window:
            places[k], offsets[k], used = used, 0, used + 1
            continue
        capacity = tree.tightest(need)
        if capacity is None:
            capacity, number, used = window, used, used + 1
        else:
            number = tree.take(capacity)
        places[k], offsets[k] = number, window - capacity
        tree.put(capacity - need, number)
    return places, offsets, used


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, block_tokens: int = 4_000_000, doc: str = "doc_id", text: str = "text", plain: bool = False, words: int = 1_000_000) -> DataFrame:
    """Pieces of documents laid into windows of at most ``window`` ids.

    Each document is its ids by the tokenizers file ``tokenizer`` and then ``end_id``; with ``plain`` the file's special
    tokens in a text are ordinary text. Longer ones are first cut
    into full windows; the rest goes, longest first, to the open window with the least room that holds it. Every
    partition is packed by itself in blocks of about ``block_tokens`` ids, so nothing is shuffled and memory is
    bounded; a block leaves a window or two with padding. A worker keeps up to ``words`` words between texts.

    Returns {doc}, start (its ids before the piece), ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset (of the piece in its window). A null or empty text is one end id. Repeated rows are packed each; a null
    id stays null; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = WordCodec.of(tokenizer, plain, words), np.array([end_id], "<u4").tobytes()
        base, names, held, size = TaskContext.get().partitionId() << 40, [doc, "start", "ids", "doc_tokens", "sequence_id", "offset"], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            cut = [(d, at, ids[4 * at : 4 * (at + window)], len(ids) // 4) for d, ids in held for at in range(0, len(ids) // 4, window)]
            held.clear()
            lengths = np.array([len(c[2]) // 4 for c in cut], np.int64)
            places, offsets, used = best_fit_decreasing(lengths, window)
            for k in range(0, len(cut), 1024):  # 4 MB of ids at once
                d, at, ids, n = zip(*cut[k : k + 1024], strict=True)
                columns = [pa.array(d, pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(places[k : k + 1024] + base), pa.array(offsets[k : k + 1024])]
                yield pa.RecordBatch.from_arrays(columns, names)
            base += used

        for batch in text_groups(batches, 1):
            for d, coded in zip(batch.column(0).to_pylist(), codec.encode_all([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = coded + end
                held.append((d, ids))
                size += len(ids) // 4
                if size >= block_tokens:
                    yield from packed()
                    size = 0
        if held:
            yield from packed()

    return docs.select(F.col(doc).cast("long").alias(doc), F.col(text).alias("text")).mapInArrow(run, PIECES.format(doc=f"`{doc}`"))
