"""The Merkle manifest against a plain recursive tree."""

import hashlib
import os
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.llm import manifest, queries

SF = "/root/testdata/sf0.01"


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def climb(nodes, fanout):
    """The root of nodes, and for each of them the rows (left, right) from there up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // fanout * fanout : place // fanout * fanout + fanout]
            paths[k].append((run[: place % fanout], run[place % fanout + 1 :]))
            at[k] = place // fanout
        nodes = [H(nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute_force(rows, fanout):
    """Rows (doc_id, source, lang, n_chars, text) to the sorted results of the operator, text lower-cased in some."""
    groups = {}
    for row in rows:
        shown = row if row[4] is None or row[0] is None or zlib.crc32(str(row[0]).encode()) % 3 else (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
        groups.setdefault(row[2], []).append((row[0], leaf_of(row), leaf_of(shown)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(climb([x[1] for x in groups[g]], fanout))
    root, above = climb([t[0] for t in trees], fanout)
    out = []
    for g, (sub, paths), top in zip(names, trees, above, strict=True):
        for (doc, leaf, shown), path in zip(groups[g], paths, strict=True):
            told, folded = [], shown
            for left, right in path + top:
                told += [*left, *right]
                folded = H([*left, folded, *right])
            out.append((doc, leaf, sub, root, H(told), folded, folded == root))
    return sorted(out, key=str)


def result(docs, **how):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = manifest.merkle_manifest(docs, {"text": lowered}, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, **how)
    return sorted(map(tuple, made.collect()), key=str)


@pytest.mark.parametrize("fanout,depth", [(8, 4), (8, 1), (3, 2), (2, 1)])
def test_blocks_and_rounds_make_no_difference(spark, fanout, depth):
    rows = [(k, f"s{k % 3}", ["en", "de", None, "é", "zz"][k % 5 if k < 40 else 0], k, f"Text {k} of É") for k in range(150)] + [(7, None, "one", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert result(docs, fanout=fanout, depth=depth) == brute_force(rows, fanout)


def test_nulls_repeats_ties_and_empty_tables(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in edge_docs.collect()]
    assert result(edge_docs) == brute_force(rows, 8)
    assert result(no_docs) == []
    assert result(edge_docs.where("doc_id = 3")) == brute_force([r for r in rows if r[0] == 3], 8)
    clash = edge_docs.withColumns({c: F.lit("x") for c in ("key", "digest", "place", "root", "a.b")})
    assert result(clash) == brute_force(rows, 8)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    got, want = queries.op12_manifest(spark, SF).toPandas(), con.execute(queries.ORACLE["op12_manifest"]).df()
    order = lambda t: t[sorted(t.columns)].sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
    assert not got["verified"].all() and got["verified"].mean() > 0.5
