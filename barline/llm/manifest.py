"""Merkle manifest of a dataset by time-forward processing: digests travel up to parents, proofs travel down to leaves.

Nodes are labelled by level and place. A queue ordered by label hands every node the digests of its children in turn
(the way up), and in reverse order hands every node what stands beside its ancestors (the way down). Leaves reach the
queue sorted by Spark, a block of ``FANOUT ** DEPTH`` at a time; the roots of blocks are the leaves of the next round,
so a queue never holds more than one block and a billion leaves take two rounds.
"""

from __future__ import annotations

import hashlib
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.shared import discard, written

FANOUT, DEPTH = 8, 4
#: One row's parts of a leaf, in order.
PARTS = ("doc_id", "source", "lang", "n_chars", "text")


def H(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(parts: list[Column]) -> Column:
    """SHA-256 in hex over each part's UTF-8 size, a colon and the part; a dash for a null one."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("binary")).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(told(c.cast("string")) for c in parts)), 256)


def forward(leaves: list[str], levels: int | None, fanout: int) -> list[tuple[tuple[int, int], str]]:
    """All nodes of a tree over ``leaves`` as (label, digest) in label order, a label being (level, place).

    The queue holds what is on its way to a parent: (its label, the child's place, the child's digest). A node is
    made once its label is the least. Nodes rise ``levels`` levels, or until one is left.
    """
    nodes = [((0, k), d) for k, d in enumerate(leaves)]
    if levels is None:
        levels, left = 0, len(leaves)
        while left > 1:
            levels, left = levels + 1, -(-left // fanout)
    queue = [((1, k // fanout), k, d) for (_, k), d in nodes] if levels else []
    heapq.heapify(queue)
    while queue:
        label, children = queue[0][0], []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        nodes.append((label, H(children)))
        if label[0] < levels:
            heapq.heappush(queue, ((label[0] + 1, label[1] // fanout), label[1], nodes[-1][1]))
    return nodes


def backward(nodes: list[tuple[tuple[int, int], str]], above: tuple, fanout: int) -> list[tuple]:
    """For each leaf the linked steps to the root: (digests left of it, digests right of it, the parent's steps).

    Labels are taken in reverse order, so a parent's steps are known before its children ask for them.
    """
    rows: dict[tuple[int, int], list[str]] = {}
    for (level, place), digest in nodes:
        rows.setdefault((level + 1, place // fanout), []).append(digest)
    steps: dict[tuple[int, int], tuple] = {}
    for (level, place), _ in reversed(nodes):
        parent = (level + 1, place // fanout)
        beside, at = rows[parent], place % fanout
        steps[level, place] = ("".join(beside[:at]), "".join(beside[at + 1 :]), steps[parent]) if parent in steps else above
    return [steps[0, k] for k in range(sum(label[0] == 0 for label, _ in nodes))]


def linked(path: list) -> tuple:
    """Steps from a node to the root as nested tuples, from a list that has the nearest first."""
    out: tuple = ()
    for left, right in reversed(path):
        out = (left, right, out)
    return out


def proof_of(steps: tuple) -> str:
    told = []
    while steps:
        told += steps[:2]
        steps = steps[2]
    return H(told)


def fold(digest: str, steps: tuple) -> str:
    """The root that a leaf's digest and its siblings lead to."""
    while steps:
        left, right, steps = steps
        digest = H([left, digest, right])
    return digest


def placed(rows: DataFrame, key: str, order: list[Column], parts: int | None = None) -> DataFrame:
    """Adds place, a row's number from 0 among those of its key in order, and total, their count; written once.

    Ranges of (key, order) are sorted partitions; a row's number in its range, less that of its key's first row
    there, and the counts of the ranges before give its place. A key with most of the rows fills many ranges.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, F.col(key), *order).sortWithinPartitions(F.col(key), *order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy(key, "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = counts.select(key, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy(key)).alias("total"))
    out = written(ranged.join(starts, [key, "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift"))
    discard(ranged)
    return out


def raised(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """key, block, digest and total of the roots of blocks: nodes of (key, place, total, digest) ``depth`` levels up.

    A key with one block rises until one node is left. A block is at most fanout ** depth rows.
    """
    size = fanout**depth

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table, total = table.sort_values("place"), int(table["total"].iloc[0])
        made = forward(table["digest"].tolist(), depth if total > size else None, fanout)
        return pd.DataFrame({"key": [table["key"].iloc[0]], "place": [table["block"].iloc[0]], "total": [-(-total // size)], "digest": [made[-1][1]]})

    slim = nodes.select("key", "place", "total", "digest", F.floor(F.col("place") / size).alias("block"))
    return slim.groupBy("key", "block").applyInPandas(run, "key string, place long, total long, digest string")


def tree(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """Rounds of nodes (key, place, total, digest), the given ones first, until each key has one node; each is written."""
    rounds = [nodes]
    most = rounds[0].agg(F.max("total")).first()[0] or 0
    while True:
        rounds.append(written(raised(rounds[-1], fanout, depth)))
        most = -(-most // fanout**depth)
        if most <= 1:
            return rounds


STEPS = "array<struct<left:string,right:string>>"


def delivered(nodes: DataFrame, above: DataFrame, fanout: int, depth: int) -> DataFrame:
    """key, place and path of nodes, for the paths (key, place, path) of their blocks' roots.

    A path is a list of (digests left, digests right) from the node to the root of all.
    """
    size = fanout**depth

    def run(table: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        table, total = table.sort_values("place"), int(table["total"].iloc[0])
        made = forward(table["digest"].tolist(), depth if total > size else None, fanout)
        paths = []
        for steps in backward(made, linked([(s["left"], s["right"]) for s in top["path"].iloc[0]]), fanout):
            path = []
            while steps:
                path.append({"left": steps[0], "right": steps[1]})
                steps = steps[2]
            paths.append(path)
        return pd.DataFrame({"key": table["key"], "place": table["place"], "path": paths})

    blocks = nodes.withColumn("block", F.floor(F.col("place") / size)).groupBy("key", "block")
    return blocks.cogroup(above.withColumnRenamed("place", "block").groupBy("key", "block")).applyInPandas(run, f"key string, place long, path {STEPS}")


def merkle_manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None, parts: tuple[str, ...] = PARTS, doc: str = "doc_id", group: str = "lang", fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """{doc}, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    A leaf is the digest of a row's ``parts``. Leaves of one ``group`` ascend by id, null first, equal ids by digest,
    so that repeated rows have neighbouring equal leaves; every ``fanout`` neighbours become the digest of their
    digests, the last run also with fewer, until one is left, the group's subroot. Subroots by group (null first,
    then by bytes) give the root likewise. proof_sha256 is the digest of all siblings up to the root.

    ``tampered`` replaces columns in rows for which ``where`` holds, after the manifest was made: folded_root is the
    root that such a row and the manifest's siblings lead to, and verified says whether it is still the root. Texts
    are read once and hashed where they are; digests alone are moved, and written once for each round.

    Nulls count as absent parts, an empty text as one of no bytes; other columns are not read; an empty table gives
    no rows. A table with further columns named like a result is no matter.
    """
    now = [F.col(f"`{c}`") for c in parts]
    hit = F.lit(False) if where is None else F.coalesce(where, F.lit(False))
    then = [tampered[c] if tampered and c in tampered else F.col(f"`{c}`") for c in parts]
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # null first, and never null
    rows = docs.select(F.col(f"`{doc}`").cast("long").alias("doc"), key.alias("key"), leaf_digest(now).alias("digest"), F.when(hit, leaf_digest(then)).alias("shown"))
    leaves = placed(rows, "key", [F.col("doc").asc_nulls_first(), F.col("digest"), F.col("shown").asc_nulls_first()])
    rounds = tree(leaves, fanout, depth)
    tops = rounds[-1]
    # The subroots are the leaves of one more tree.
    every = placed(tops.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), "key", [F.col("name")])
    upper = tree(every, fanout, depth)
    root = upper[-1].select(F.col("digest").alias("root"))  # one row
    path = upper[-1].select("key", "place", F.array().cast(STEPS).alias("path"))
    for nodes in upper[-2::-1]:
        path = written(delivered(nodes, path, fanout, depth))
    above = every.select("place", "name").join(path, "place").select(F.col("name").alias("key"), F.lit(0).cast("long").alias("place"), "path")
    for nodes in rounds[-2:0:-1]:
        above = written(delivered(nodes, above, fanout, depth))
    size = fanout**depth

    def proven(table: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        table, total = table.sort_values("place"), int(table["total"].iloc[0])
        made = forward(table["digest"].tolist(), depth if total > size else None, fanout)
        steps = backward(made, linked([(s["left"], s["right"]) for s in top["path"].iloc[0]]), fanout)
        shown = table["shown"].where(table["shown"].notna(), table["digest"])
        table["proof"] = [proof_of(s) for s in steps]
        table["folded"] = [fold(d, s) for d, s in zip(shown, steps, strict=True)]
        return table[["doc", "key", "digest", "proof", "folded"]]

    blocks = leaves.withColumn("block", F.floor(F.col("place") / size)).groupBy("key", "block")
    checked = blocks.cogroup(above.withColumnRenamed("place", "block").groupBy("key", "block")).applyInPandas(proven, "doc long, key string, digest string, proof string, folded string")
    named = checked.join(every.select(F.col("name").alias("key"), F.col("digest").alias("subroot")), "key").join(F.broadcast(root))
    for table in [*rounds[1:-1], *upper[1:-1]]:
        discard(table)
    return named.select(F.col("doc").alias(doc), F.col("digest").alias("leaf"), "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bit = "list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)"
    bytes_ = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {bytes_}), lambda c, b: {bit}), 4294967295::UBIGINT)"


def manifest_sql(levels: int = 6, fanout: int = FANOUT) -> str:
    """merkle_manifest() of a view named documents, for trees of up to ``levels`` levels, for a check by another engine.

    Where 3 divides the checksum of the id, the text's letters A to Z are lower-cased after the manifest was made.
    """

    def leaf(text: str) -> str:
        told = [f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in (f"{'text' if p == 'text' else p + '::VARCHAR'}" for p in PARTS)]
        return f"sha256({' || '.join(told[:-1])} || coalesce(strlen({text})::VARCHAR || ':' || {text}, '-'))"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = _crc32_sql("doc_id::VARCHAR")

    def rising(name: str, by: str) -> list[str]:
        """Levels name0, name1 and so on of (by, place, digest, n) and their siblings name_s0 and so on."""
        out = []
        for k in range(levels):
            run = f"PARTITION BY {by}, place // {fanout} ORDER BY place ROWS BETWEEN"
            out.append(f"{name}_s{k} AS (SELECT {by}, place, n, digest, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {name}{k})")
            out.append(f"{name}{k + 1} AS (SELECT {by}, place // {fanout} AS place, CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE max(digest) END AS digest, CAST(ceil(max(n) / {fanout}) AS BIGINT) AS n FROM {name}{k} GROUP BY {by}, place // {fanout})")
        return out

    pieces = [
        f"leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS k, {leaf('text')} AS leaf, CASE WHEN coalesce({hit} % 3 = 0, false) THEN {leaf(lowered)} ELSE {leaf('text')} END AS shown FROM documents)",
        "ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY k) AS n FROM leaves)",
        "a0 AS (SELECT k, place, leaf AS digest, n FROM ranked)",
        *rising("a", "k"),
        f"b0 AS (SELECT 0 AS g, k, row_number() OVER (ORDER BY k) - 1 AS place, digest, count(*) OVER () AS n FROM a{levels})",
        *rising("b", "g"),
    ]
    joins, path, folded = "", [], "shown"
    for k in range(levels):
        joins += f" JOIN a_s{k} s{k} ON s{k}.k = d.k AND s{k}.place = d.place // {fanout**k}"
        path.append((f"s{k}.l", f"s{k}.r", f"s{k}.n"))
    joins += " JOIN b0 sub ON sub.k = d.k"
    for k in range(levels):
        joins += f" JOIN b_s{k} t{k} ON t{k}.place = sub.place // {fanout**k}"
        path.append((f"t{k}.l", f"t{k}.r", f"t{k}.n"))
    steps = []
    for k, (left, right, n) in enumerate(path):
        steps.append(f"f{k} AS (SELECT *, CASE WHEN n{k} > 1 THEN sha256(l{k} || {folded} || r{k}) ELSE {folded} END AS y{k} FROM {'paths' if k == 0 else f'f{k - 1}'})")
        folded = f"y{k}"
    listed = ", ".join(f"{left} AS l{k}, {right} AS r{k}, {n} AS n{k}" for k, (left, right, n) in enumerate(path))
    pieces.append(f"paths AS (SELECT d.doc_id, d.leaf, d.shown, sub.digest AS subroot, (SELECT digest FROM b{levels}) AS root, {listed} FROM ranked d{joins})")
    proof = " || ".join(f"l{k} || r{k}" for k in range(len(path)))
    return f"WITH {', '.join(pieces + steps)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {folded} AS folded_root, {folded} = root AS verified FROM f{len(path) - 1}"
