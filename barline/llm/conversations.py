"""Conversation repair by generalised LR parsing: the cheapest edits that make the turns' roles a sentence of a grammar.

Stacks are nodes (state, node below), each held once, so stacks share what is below their tops and equal ones are
one node. A node's cheapest way to it is a pair (cost, audit); merging takes the least. Audits of one node over the
same turns are never prefixes of each other at equal cost, as further letters could only be inserts, which cost: so
the least pair stays least whatever follows, and parts of a conversation can be parsed apart and put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.shared import discard, written

#: A conversation is empty, or exchanges of user and assistant, perhaps after one turn of the system.
GRAMMAR = (("S", ""), ("S", "P"), ("S", "sP"), ("P", "ua"), ("P", "Pua"))
ROLES = {"u": "user", "a": "assistant"}
RIGHT = ("su", "ua", "au")
#: Costs of edits; a truncated turn that stays adds one.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
WORDS, CLOSED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
Best = tuple[int, str]


class Node:
    """A stack: a state on top of another stack."""

    __slots__ = ("after", "below", "ends", "id", "state")

    def __init__(self, state: int, below: Node | None, number: int):
        self.state, self.below, self.id = state, below, number
        self.after: dict[str, Node] = {}
        self.ends = False


class Parser:
    """SLR tables of a grammar (pairs of a capital and its right side) and all stacks that its sentences reach.

    Reductions that need no lookahead follow each shift at once; those of the start symbol wait for the end. The
    grammar must keep stacks bounded, as left recursion does.
    """

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR):
        self.rules = (("^", grammar[0][0]), *grammar)
        self.sets: list[frozenset[tuple[int, int]]] = [self._closed({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        for state, items in enumerate(self.sets):  # grows while it is read
            for symbol in sorted({self.rules[r][1][at] for r, at in items if at < len(self.rules[r][1])}):
                found = self._closed({(r, at + 1) for r, at in items if self.rules[r][1][at : at + 1] == symbol})
                if found not in self.sets:
                    self.sets.append(found)
                self.goto[state, symbol] = self.sets.index(found)
        self.terminals = "".join(sorted({c for _, right in grammar for c in right if not c.isupper()}))
        self.nodes: list[Node] = []
        self._known: dict[tuple[int, Node | None], Node] = {}
        self.root = self._node(0, None)
        for node in self.nodes:  # grows while it is read
            for t in self.terminals:
                if (node.state, t) in self.goto:
                    node.after[t] = self._reduced(self._node(self.goto[node.state, t], node))
            node.ends = self._accepts(node)
        self.tops = [self.root, *{to for node in self.nodes for to in node.after.values()}]

    def _closed(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        held = list(items)
        for r, at in held:
            wanted = self.rules[r][1][at : at + 1]
            held += [(k, 0) for k, (left, _) in enumerate(self.rules) if left == wanted and (k, 0) not in held]
        return frozenset(held)

    def _node(self, state: int, below: Node | None) -> Node:
        if (state, below) not in self._known:
            self._known[state, below] = Node(state, below, len(self.nodes))
            self.nodes.append(self._known[state, below])
        return self._known[state, below]

    def _done(self, node: Node) -> list[int]:
        return [r for r, at in self.sets[node.state] if at == len(self.rules[r][1])]

    def _pop(self, node: Node, rule: int) -> Node | None:
        for _ in self.rules[rule][1]:
            node = node.below
        to = self.goto.get((node.state, self.rules[rule][0]))
        return None if to is None else self._node(to, node)

    def _reduced(self, node: Node) -> Node:
        """Reductions of states that can do nothing else."""
        while len(self.sets[node.state]) == 1 and (done := self._done(node)) and done[0]:
            node = self._pop(node, done[0])
        return node

    def _accepts(self, node: Node) -> bool:
        return any(r == 0 or ((up := self._pop(node, r)) is not None and self._accepts(up)) for r in self._done(node))

    def start(self, node: Node) -> dict[Node, Best]:
        return self._inserted({node: (0, "")})

    def _inserted(self, tops: dict[Node, Best]) -> dict[Node, Best]:
        """With all turns that may be inserted here: nothing is inserted twice that brings no cheaper stack."""
        ahead = list(tops)
        for node in ahead:  # grows while it is read
            cost, audit = tops[node]
            for t in ROLES:
                to = node.after.get(t)
                if to is not None and (to not in tops or (cost + INSERT, audit + "I") < tops[to]):
                    tops[to] = (cost + INSERT, audit + "I")
                    ahead.append(to)
        return tops

    def step(self, tops: dict[Node, Best], initial: str, must_go: bool, truncated: bool) -> dict[Node, Best]:
        """The stacks after one more turn: kept, given another role or deleted, and what may be inserted then."""
        out: dict[Node, Best] = {}

        def merge(node: Node, best: Best) -> None:
            if node not in out or best < out[node]:
                out[node] = best

        for node, (cost, audit) in tops.items():
            merge(node, (cost + DELETE, audit + "D"))
            if must_go:
                continue
            stays = cost + TRUNCATED * truncated
            if initial in node.after:
                merge(node.after[initial], (stays, audit + "K"))
            for t in ROLES:
                if t in node.after:
                    merge(node.after[t], (stays + REROLE, audit + "R"))
        return self._inserted(out)

    def applied(self, node: Node, audit: str, turns: Iterator[tuple[str, str]]) -> list[dict[str, str]]:
        """The turns that an audit makes of (role, text) from a stack on: edit, role and text each."""
        out = []
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(turns)
            if edit == "D":
                continue
            t = role[:1] if edit == "K" else next(t for t in ROLES if t in node.after)  # never both in one stack
            out.append({"edit": edit, "role": role if edit == "K" else ROLES[t], "text": text})
            node = node.after[t]
        return out


@cache
def parser() -> Parser:
    return Parser()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _in_runs(df: DataFrame, keys: list[str], order: list[str], made: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, ddl: str, at_once: int = 500) -> DataFrame:
    """made(rows) of the rows of each partition, dealt by keys and sorted, streamed: no group is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in made(_rows(batches)):
            held.append(row)
            if len(held) == at_once:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
                held = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


def _parsed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (key, part, first, place, initial, must_go, truncated) to what each part makes of each stack."""
    p = parser()
    for (key, part, first), turns in groupby(rows, key=lambda r: r[:3]):
        tops = {n: p.start(n) for n in ([p.root] if first else p.tops)}
        opening, before, illegal = None, None, 0
        for _, _, _, _, initial, must_go, truncated in turns:
            tops = {n: p.step(t, initial, must_go, truncated) for n, t in tops.items()}
            illegal += before is not None and before + initial not in RIGHT
            opening, before = initial if opening is None else opening, initial
        ways = [{"from": n.id, "to": to.id, "cost": cost, "audit": audit} for n, t in tops.items() for to, (cost, audit) in t.items()]
        yield key, part, opening, before, illegal, ways


def _joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (key, part, opening, closing, illegal, ways) in order to the cheapest edits of each part."""
    p = parser()
    for key, parts in groupby(rows, key=lambda r: r[0]):
        best: dict[int, tuple[int, str, list]] = {p.root.id: (0, "", [])}
        before, illegal, n = None, 0, 0
        for _, part, opening, closing, inside, ways in parts:
            after: dict[int, tuple[int, str, list]] = {}
            for way in ways:
                if way["from"] in best:
                    cost, audit, cuts = best[way["from"]]
                    made = (cost + way["cost"], audit + way["audit"])
                    if way["to"] not in after or made < after[way["to"]][:2]:
                        after[way["to"]] = (*made, [*cuts, (part, way["from"], len(audit))])
            illegal += inside + (before is not None and before + opening not in RIGHT)
            best, before, n = after, closing, n + 1
        cost, audit, cuts = min(b for i, b in best.items() if p.nodes[i].ends)
        stops = [*(c[2] for c in cuts[1:]), len(audit)]
        for k, ((part, node, start), stop) in enumerate(zip(cuts, stops, strict=True)):
            yield key, part, k, n, node, audit[start:stop], cost, illegal


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (key, part, place, role, text, number, parts, node, audit), a part's audit first, to its repaired turns."""
    p = parser()
    for (key, _), turns in groupby(rows, key=lambda r: r[:2]):
        _, _, _, _, _, number, parts, node, audit = next(turns)
        yield key, number, parts, p.applied(p.nodes[node], audit, ((r[3], r[4]) for r in turns))


def repair(rows: DataFrame, part_rows: int = 1024, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The report of each conversation and its repaired turns.

    Report: {conv}, gaps, blank, duplicate, truncated, illegal, cost, audit. Turns: {conv}, part, parts and turns (an
    array of edit, role, text), a row for each part, of up to ``part_rows`` rows of the input. Turns follow ``turn``,
    null first; those with the same one follow role, a hash of the text and the text. A turn's first fault counts:
    blank (white space only), duplicate (an earlier turn has its role and text), truncated (it does not end in a
    full stop, exclamation or question mark). Edits: K keep, R other role, D delete, I insert an empty turn.

    A conversation fills as many parts as it needs; parts are parsed in parallel, from every stack if others stand
    before them, and what they make of stacks is put together in order, by letters and not by texts. Texts move
    twice: to their order, and to their part. A null role or text counts as one space; a null conversation is one of
    its own; repeated rows are duplicates; an empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    known = rows.select(F.coalesce(F.concat(F.lit("="), F.col(f"`{conv}`").cast("string")), F.lit("")).alias("key"), F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    known = known.withColumn("hash", F.xxhash64("text"))
    order = ["key", "turn", "role", "hash"]
    placed = known.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").withColumn("place", F.monotonically_increasing_id())
    table = written(placed.withColumn("part", F.floor(F.col("place") / part_rows)))
    light = table.select("key", "conv", "turn", "part", "place", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(WORDS)).alias("blank"), (~F.col("text").rlike(CLOSED)).alias("open"), F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("same"))
    light = written(light)
    # First ones of equal turns, met again by place, which is unique: no key is hot.
    firsts = light.groupBy("key", "same").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    faulty = light.drop("same").join(firsts, "place", "left").select("*", (~F.col("blank") & F.col("new").isNull()).alias("again"))
    faulty = written(faulty.withColumn("cut", ~F.col("blank") & ~F.col("again") & F.col("open")))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = faulty.groupBy("key").agg(F.first("conv").alias("conv"), gaps.alias("gaps"), *(F.count_if(c).alias(name) for c, name in (("blank", "blank"), ("again", "duplicate"), ("cut", "truncated"))))
    start = faulty.groupBy("key").agg(F.min("part").alias("start"))
    lines = faulty.join(start, "key").select("key", "part", (F.col("part") == F.col("start")).alias("first"), "place", "initial", (F.col("blank") | F.col("again")).alias("must_go"), F.col("cut").alias("truncated"))
    way = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    parsed = _in_runs(lines, ["key", "part"], ["place"], _parsed, pa.schema([("key", pa.string()), ("part", pa.int64()), ("opening", pa.string()), ("closing", pa.string()), ("illegal", pa.int64()), ("ways", pa.list_(way))]), "key string, part long, opening string, closing string, illegal long, ways array<struct<from:int,to:int,cost:long,audit:string>>")
    chosen = _in_runs(parsed, ["key"], ["part"], _joined, pa.schema([("key", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("parts", pa.int64()), ("node", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())]), "key string, part long, number long, parts long, node int, audit string, cost long, illegal long")
    chosen = written(chosen)
    discard(light)
    whole = chosen.groupBy("key").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    report = counts.join(whole, "key").select(F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    # A part's audit comes before its turns; turns themselves need no other column.
    heads = chosen.select("key", "part", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "number", "parts", "node", "audit")
    bodies = table.select("key", "part", "place", "role", "text", *(F.lit(None).cast(t).alias(c) for c, t in (("number", "long"), ("parts", "long"), ("node", "int"), ("audit", "string"))))
    kept = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
    edited = _in_runs(heads.unionByName(bodies), ["key", "part"], ["place"], _edited, pa.schema([("key", pa.string()), ("part", pa.int64()), ("parts", pa.int64()), ("turns", kept)]), "key string, part long, parts long, turns array<struct<edit:string,role:string,text:string>>", 50)
    back = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(rows.select(f"`{conv}`").schema[0].dataType)
    return report, edited.select(back.alias(conv), "part", "parts", "turns")


def repaired_digests(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """{conv} and the SHA-256 of its repaired turns as lines ``role:text``.

    A conversation of one part is hashed where it is. A hash runs over its lines in order, so the lines of a longer
    one are streamed through one task, line by line.
    """
    line = lambda x: F.concat(x["role"], F.lit(":"), x["text"])
    one = turns.where("parts = 1").select(F.col(f"`{conv}`").alias("conv"), F.sha2(F.array_join(F.transform("turns", line), "\n"), 256).alias("sha256"))
    many = turns.where("parts > 1").select(F.coalesce(F.concat(F.lit("="), F.col(f"`{conv}`").cast("string")), F.lit("")).alias("key"), "part", F.posexplode_outer(F.transform("turns", line)).alias("n", "line"))

    def hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, lines in groupby(rows, key=lambda r: r[0]):
            held, between = hashlib.sha256(), b""
            for _, _, _, text in lines:
                if text is not None:
                    held.update(between + text.encode())
                    between = b"\n"
            yield key, held.hexdigest()

    streamed = _in_runs(many, ["key"], ["part", "n"], hashed, pa.schema([("key", pa.string()), ("sha256", pa.string())]), "key string, sha256 string")
    back = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(turns.select(f"`{conv}`").schema[0].dataType)
    return one.unionByName(streamed.select(back.alias("conv"), "sha256")).withColumnRenamed("conv", conv)
