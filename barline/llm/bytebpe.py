"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding by retained offsets."""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.wordcodec import text_groups

# Symbols: what a code point is, given the one or two after it.
END, LETTER, NUMBER, OTHER, SHORT, LONG, JOIN, SPACE, LAST = range(9)
# States before a code point. ONE and TWO: so many letters of a contraction are still due.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, IN_SPACE, ONE, TWO = range(8)
SYMBOLS, STATES, UNKNOWN = 9, 8, 9


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """The next state, and whether a slice begins, by symbol and state.

    A space before another character joins it; a run of white space gives up its last character otherwise; an
    apostrophe opens a contraction (SHORT: one letter, LONG: two) unless it continues others or a joined space.
    """
    after, begins = np.zeros((SYMBOLS, STATES), np.uint8), np.ones((SYMBOLS, STATES), bool)
    for symbol, state in ((END, FRESH), (LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (JOIN, JOINED), (SPACE, IN_SPACE), (LAST, FRESH)):
        after[symbol] = state
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (SHORT, IN_OTHERS), (LONG, IN_OTHERS)):
        begins[symbol, [state, JOINED]] = False
    begins[SPACE, IN_SPACE] = False
    for symbol, due in ((SHORT, ONE), (LONG, TWO)):
        after[symbol] = due
        after[symbol, [IN_OTHERS, JOINED]] = IN_OTHERS
    after[LETTER, TWO], after[LETTER, ONE] = ONE, FRESH
    begins[LETTER, [ONE, TWO]] = False
    return after, begins


def _closure(generators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All functions that the symbols' transitions compose to, and the number of "first a, then b" by a and b."""
    known = {tuple(g): k for k, g in reversed([*enumerate(generators.tolist())])}
    functions = [tuple(g) for g in generators.tolist()]
    for f in functions:
        for g in generators.tolist():
            both = tuple(g[s] for s in f)
            if both not in known:
                known[both] = len(functions)
                functions.append(both)
    table = np.array(functions, np.uint8)
    compose = np.array([[known[tuple(b[list(a)])] for b in table] for a in table], np.uint8)
    return table, compose


AFTER, BEGINS = _rules()
FUNCTIONS, COMPOSE = _closure(AFTER)
assert len(FUNCTIONS) < 256, "function numbers are held in a byte"


def scan(numbers: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of a sequence of function numbers, blocks side by side."""
    n = len(numbers)
    if n <= 64:
        out = numbers.copy()
        for i in range(1, n):
            out[i] = COMPOSE[out[i - 1], numbers[i]]
        return out
    width = max(16, int(n**0.5) // 4)
    blocks = -(-n // width)
    identity = _identity()
    grid = np.full(blocks * width, identity, np.uint8)
    grid[:n] = numbers
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    flat, k = COMPOSE.ravel(), len(COMPOSE)
    for j in range(1, width):
        grid[j] = flat.take(grid[j - 1].astype(np.uint16) * k + grid[j])
    before = np.concatenate([[identity], scan(grid[-1])[:-1]]).astype(np.uint16) * k
    for j in range(width):
        grid[j] = flat.take(before + grid[j])
    return grid.T.reshape(-1)[:n]


def _identity() -> int:
    return int(np.flatnonzero((FUNCTIONS == np.arange(STATES)).all(axis=1))[0])


def _with_identity() -> None:
    global FUNCTIONS, COMPOSE
    if not (FUNCTIONS == np.arange(STATES)).all(axis=1).any():
        n = len(FUNCTIONS)
        FUNCTIONS = np.vstack([FUNCTIONS, np.arange(STATES, dtype=np.uint8)])
        COMPOSE = np.pad(COMPOSE, ((0, 1), (0, 1)))
        COMPOSE[n, :n], COMPOSE[:n, n], COMPOSE[n, n] = np.arange(n), np.arange(n), n


_with_identity()
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE, OTHER, or UNKNOWN where the Unicode version at hand has no character yet."""
    global _classes
    if _classes is None:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        kinds = np.array(list(map(unicodedata.category, map(chr, range(sys.maxunicode + 1)))))
        for kind, names in ((LETTER, ["Lu", "Ll", "Lt", "Lm", "Lo"]), (NUMBER, ["Nd", "Nl", "No"]), (SPACE, ["Zs", "Zl", "Zp"]), (UNKNOWN, ["Cn"])):
            table[np.isin(kinds, names)] = kind
        table[[*range(9, 14), 0x85]] = SPACE
        _classes = table
    return _classes


def _learn(points: list[int]) -> None:
    """Sets the classes of UNKNOWN code points by the Unicode version of the tiktoken library."""
    import tiktoken

    table, ranks = classes(), {bytes([b]): b for b in range(256)}
    table[points] = OTHER
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        table[[p for p in points if probe.encode_ordinary(chr(p))]] = kind


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ends are the places between texts."""
    kind = classes()[points]
    if (kind == UNKNOWN).any():
        _learn(np.unique(points[kind == UNKNOWN]).tolist())
        kind = classes()[points]
    kind[ends] = END
    following = np.append(kind[1:], np.uint8(END))
    inner = (following != SPACE) & (following != END)
    spaces = kind == SPACE
    kind[spaces & inner] = LAST
    kind[spaces & inner & (points == 32)] = JOIN
    at = np.flatnonzero(points == 39)
    if len(at):
        padded = np.append(points, [0, 0])
        first, second = padded[at + 1], padded[at + 2]
        kind[at[np.isin(first, [ord(c) for c in "stmd"])]] = SHORT
        for pair in ("re", "ve", "ll"):
            kind[at[(first == ord(pair[0])) & (second == ord(pair[1]))]] = LONG
    return kind


def slices(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, where each slice begins in it, and the number of the first slice of each text.

    A place between two texts has a slice of its own; the last begin is the end of the whole.
    """
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1
    if not len(points):
        return joined, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    kind = symbols(points, ends[:-1])
    state = FUNCTIONS[scan(kind), FRESH]
    before = np.concatenate([[FRESH], state[:-1]])
    begins = np.flatnonzero(BEGINS[kind, before])
    starts = np.concatenate([[0], ends[:-1] + 1])
    return joined, np.append(begins, len(points)), np.append(np.searchsorted(begins, starts), len(begins))


#: Greater than any id: no merge.
NONE = 1 << 40


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    """A key's first place in a table of 2 ** bits."""
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class RankMerger:
    """Pair merging by a rank file, with the ids of slices met before kept."""

    _held: dict[str, RankMerger] = {}

    def __init__(self, path: str, limit: int = 500_000):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.lengths = np.zeros(max(self.tokens) + 1, np.uint32)
        self.lengths[list(self.tokens)] = [len(x) for x in self.tokens.values()]
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.table = self._joins()
        self.limit, self.known = limit, {}

    @classmethod
    def of(cls, path: str) -> RankMerger:
        """One for each file and Python worker."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _joins(self) -> tuple[np.ndarray, np.ndarray, int]:
        """An open hash table from two adjacent ids to the id of their bytes together."""
        pairs = {}
        for token, number in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = number
        bits = max(4, (2 * len(pairs)).bit_length())
        keys, values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        left, wait = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        at = _slot(left, bits)
        while len(left):  # one key takes each free place, the others go to the next
            free = keys[at] == -1
            keys[at[free]] = left[free]
            mine = keys[at] == left
            values[at[mine]] = wait[mine]
            left, wait, at = left[~mine], wait[~mine], (at[~mine] + 1) & ((1 << bits) - 1)
        return keys, values, bits

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each two adjacent ids merge into, or NONE."""
        keys, values, bits = self.table
        key = (left << 32 | right).ravel()
        at, out, rest = _slot(key, bits), np.full(key.shape, NONE, np.int64), np.arange(len(key))
        while len(rest):
            held = keys[at]
            mine = held == key[rest]
            out[rest[mine]] = values[at[mine]]
            go = ~mine & (held != -1)
            rest, at = rest[go], (at[go] + 1) & ((1 << bits) - 1)
        return out.reshape(left.shape)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the adjacent pair of least rank is merged first, the leftmost of equal ones."""
        return np.frombuffer(self.merge_all([piece])[0], "<u4").tolist()

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many slices. Those of one length are merged side by side, each by one pair a step."""
        out: list[bytes] = [b""] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(k)
        for length, rows in by_length.items():
            if length > 64:
                for k in rows:
                    out[k] = np.array(self._merge_long(pieces[k]), "<u4").tobytes()
                continue
            where = np.array(rows)
            ids = self.single[np.frombuffer(b"".join([pieces[k] for k in rows]), np.uint8)].reshape(len(rows), length)
            rank = self._rank(ids[:, :-1], ids[:, 1:])
            while len(where):
                width = ids.shape[1]
                best = rank.argmin(axis=1) if width > 1 else np.zeros(len(where), np.int64)
                least = rank[np.arange(len(where)), best] if width > 1 else np.full(len(where), NONE)
                done = least == NONE
                flat = ids[done].astype("<u4").tobytes()
                for i, k in enumerate(where[done].tolist()):
                    out[k] = flat[4 * width * i : 4 * width * (i + 1)]
                go = ~done
                where, ids, rank, best, least = where[go], ids[go], rank[go], best[go], least[go]
                if not len(where):
                    break
                row, column = np.arange(len(where)), np.arange(width)
                ids[row, best] = least
                ids = ids[column != best[:, None] + 1].reshape(len(where), width - 1)
                rank = rank[column[:-1] != best[:, None]].reshape(len(where), width - 2)
                for at in (best - 1, best):
                    ok = (at >= 0) & (at < width - 2)
                    r, c = row[ok], at[ok]
                    rank[r, c] = self._rank(ids[r, c], ids[r, c + 1])
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list: n log n."""
        n, rank = len(piece), self.ranks.get
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left, j = part[i], after[i]
            if left is None or j < 0 or len(left) + len(part[j]) != size:
                continue  # one side has been merged since
            part[i], part[j], after[i] = left + part[j], None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
        return [self.ranks[p] for p in part if p is not None]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        joined, begins, first = slices(texts)
        edges, known = begins.tolist(), self.known
        pieces = list(map(joined.__getitem__, map(slice, edges, edges[1:])))
        if len(known) > self.limit:
            known.clear()
        new = list(set(pieces).difference(known))
        known.update(zip(new, self.merge_all([p.encode() for p in new]), strict=True))
        found, out = list(map(known.__getitem__, pieces)), []
        for k, (a, b) in enumerate(pairwise(first.tolist())):
            out.append(b"".join(found[a : b - (k < len(texts) - 1)]))  # without the place after the text
        for piece in new:
            if len(piece) > 48:
                del known[piece]
        return out

    def offsets(self, ids: bytes) -> bytes:
        """Where each id's bytes end in the text, as little-endian unsigned 32-bit bytes."""
        return np.cumsum(self.lengths[np.frombuffer(ids, "<u4")], dtype="<u4").tobytes()

    def decode(self, ids: bytes, ends: bytes | None = None, start: int = 0, stop: int | None = None) -> bytes:
        """The bytes of the ids; with the retained ends, only bytes start to stop, from the ids that hold them."""
        numbers = np.frombuffer(ids, "<u4")
        if ends is None or (start == 0 and stop is None):
            return b"".join(map(self.tokens.__getitem__, numbers.tolist()))
        edges = np.frombuffer(ends, "<u4")
        stop = int(edges[-1]) if stop is None and len(edges) else (stop or 0)
        a, b = np.searchsorted(edges, start, "right"), np.searchsorted(edges, stop, "left") + 1
        skipped = int(edges[a - 1]) if a else 0
        return b"".join(map(self.tokens.__getitem__, numbers[a:b].tolist()))[start - skipped : stop - skipped]


def encode_decode(docs: DataFrame, ranks: str, doc: str = "doc_id", text: str = "text", batch_bytes: int = 4_000_000) -> DataFrame:
    """Ids of every whole text by the rank file ``ranks``, and the bytes that they decode to.

    Boundaries come from arrays of code-point classes and a scan of composed transition functions, not from a
    pattern; each slice is merged pair by pair or looked up. Returns {doc}, ids and ends (little-endian unsigned
    32-bit; ends are the byte offsets where the ids' bytes end, for decoding of spans), decoded (binary).
    Nothing is shuffled; about ``batch_bytes`` of text are held at once, or one text.

    A null or empty text has no ids. Repeated rows are encoded each; a null id stays null; an empty table gives no
    rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = RankMerger.of(ranks)
        for batch in text_groups(batches, 1, batch_bytes):
            ids = merger.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = [merger.offsets(x) for x in ids]
            decoded = [merger.decode(x, e) for x, e in zip(ids, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in (ids, ends, decoded))], [doc, "ids", "ends", "decoded"])

    return docs.select(F.col(doc).cast("long").alias(doc), F.col(text).alias("text")).mapInArrow(run, f"`{doc}` long, ids binary, ends binary, decoded binary")
