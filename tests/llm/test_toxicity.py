"""Toxicity: held-out accuracy, and scores against a plain loop."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import queries, toxicity

SF = "/root/testdata/sf0.1"
INSULTS = ["blockhead", "nitwit", "dunderhead", "numbskull"]


def prose(rng, n, insults=0):
    words = ["".join(rng.choice(["ta", "ro", "mi", "len", "so", "ka", "pi"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for _ in range(insults):
        words[rng.randrange(n)] = rng.choice(INSULTS)
    return " ".join(words)


@pytest.fixture(scope="module")
def planted(spark):
    """600 documents, a fifth toxic, one of them in a hundred copies."""
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.randint(20, 200), 3 if k % 5 == 0 else 0), int(k % 5 == 0)) for k in range(600)]
    rows += [(1000 + k, rows[0][1], 1) for k in range(100)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_documents_are_told_apart(spark, planted):
    model = toxicity.fit(planted.select("doc_id", "text"), planted.select("doc_id", "toxic"))
    found = toxicity.toxicity(planted.drop("toxic"), model).join(planted.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert set(found["held_out"]) == {True} and len(found) > 80
    assert all((zlib.crc32(str(d).encode()) % 5 == 0) for d in found["doc_id"])
    hit = (found["predicted"] * found["toxic"]).sum()
    assert hit / found["toxic"].sum() > 0.9 and hit / found["predicted"].sum() > 0.9
    assert any(w.encode() in model.toxic for w in INSULTS) and not any(w.encode() in model.ordinary for w in INSULTS)


def test_no_held_out_label_is_read(spark, planted):
    """Labels of held-out rows, whatever they say, change nothing."""
    labels = planted.select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit(planted.select("doc_id", "text"), x) for x in (labels, flipped))
    assert (one.ordinary, one.toxic) == (two.ordinary, two.toxic) and np.allclose(one.weights, two.weights)


def test_scores_by_a_plain_loop_and_edge_rows(spark, edge_docs, no_docs, planted):
    model = toxicity.fit(planted.select("doc_id", "text"), planted.select("doc_id", "toxic"))
    found = toxicity.toxicity(edge_docs, model).collect()
    texts = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    want = sorted((d is None, d or 0, float(model.score(np.array([model.measures(t)]))[0])) for d, t in texts)
    assert [x[2] for x in want] == pytest.approx([x[2] for x in sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in found)])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] is not None for r in found)
    assert toxicity.toxicity(no_docs, model).count() == 0
    none = toxicity.fit(no_docs, planted.select("doc_id", "toxic").limit(0))
    assert all(r["score"] < 0.01 for r in toxicity.toxicity(edge_docs, none).collect())


def test_the_given_tables(spark):
    found = queries.op13_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, order = found["toxic"].to_numpy(), found["score"].rank().to_numpy()
    area = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert area > 0.88 and (found["predicted"] * y).sum() / y.sum() > 0.6
