"""The pipeline's stages, each on what the one before kept, against brute force."""

import hashlib

import corpus_pipeline as pipeline
import numpy as np
import pytest
import test_near
import test_text
import test_tokens

from barline.llm import secrets
from barline.llm.queries import QUERIES

COMMON = ["the", "of", "and", "is", "in", "that", "was", "for", "a", "to"]


def prose(rng, n):
    return " ".join(str(rng.choice(COMMON)) if k % 3 == 0 else f"w{''.join(map(chr, rng.integers(97, 123, 5)))}" for k in range(n))


def planted(rng):
    """Clean texts, exact and near copies, texts that only share a half, junk, and secrets."""
    clean = [prose(rng, 120) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(100 + k, clean[0]) for k in range(20)] + [(5, clean[1]), (5, clean[2])]
    for k in range(10):  # one word of 120 changed, then ten
        w = clean[k].split()
        w[60] = "changed"
        rows.append((200 + k, " ".join(w)))
        for j in range(5, 115, 11):
            w[j] = f"other{j}"
        rows.append((300 + k, " ".join(w)))
    rows += [(400, "#$% " * 60), (401, "too short"), (402, None), (403, ""), (404, "same word again " * 40), (None, clean[3]), (None, prose(rng, 60))]
    key = hashlib.sha1(b"1").hexdigest()
    rows += [(500, f"{prose(rng, 40)} token = \"{key}\" {prose(rng, 40)} {key}"), (501, f"{prose(rng, 40)} see commit {hashlib.sha1(b'2').hexdigest()} {prose(rng, 40)}")]
    return rows, key


def test_the_chain_equals_brute_force(spark):
    rows, key = planted(np.random.default_rng(21))
    table = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs, seen = table, []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").persist()
        assert docs.columns == table.columns, name
        seen.append([(r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()])
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    good = [(d, t) for d, t in rows if not test_text.base_of(t)[-1] and not test_text.rejected_by(t, "en")]
    assert sorted([x[:2] for x in seen[0]], key=order) == sorted(good, key=order)
    roots = test_near.brute_force({k: t for k, (_, t) in enumerate(good)})
    groups = {}
    for k, root in roots.items():
        groups.setdefault(root, []).append(good[k])
    least = lambda g: min((d is None, d or 0) for d, _ in g)
    assert len(groups) < len(good) and len(seen[1]) == len(groups)
    for group in groups.values():  # the row with the least id stays
        stayed = [x[:2] for x in seen[1] if x[:2] in group]
        assert len(stayed) == 1 and least(stayed) == least(group)
    clean = {x[0]: x for x in seen[2]}
    assert [order(x)[:2] for x in sorted(seen[1], key=order)] == [order(x)[:2] for x in sorted(seen[2], key=order)]
    assert key not in clean[500][1] and clean[500][1].count(secrets.REDACTED) == 2 and clean[500][2] == len(clean[500][1])
    assert hashlib.sha1(b"2").hexdigest() in clean[501][1]
    assert all(x in seen[1] for x in seen[2] if x[0] != 500)
    test_tokens.check_pieces(pipeline.STAGES[-1][1](spark, docs, "").collect(), [x[:2] for x in seen[2]])


@pytest.mark.parametrize("place", range(len(pipeline.STAGES)))
def test_each_stage_on_edge_rows_and_an_empty_table(spark, edge_docs, no_docs, place):
    stage = pipeline.STAGES[place][1]
    texts = {r["text"] for r in edge_docs.collect()}
    made = stage(spark, edge_docs, "")
    if place < len(pipeline.STAGES) - 1:
        assert made.columns == edge_docs.columns and {r["text"] for r in made.collect()} <= texts
    else:
        assert {r["doc_id"] for r in made.collect()} == {r["doc_id"] for r in edge_docs.collect()}
    assert stage(spark, no_docs, "").count() == 0


CLASHING = ["__secrets", "found", "__doc", "doc", "no_doc", "k1", "__k1", "__no_doc", "a.b", "a`b", "kept", "n_words", "__words", "own kept", "__judged", "component", "print"]


@pytest.mark.parametrize("place", range(len(pipeline.STAGES) - 1))
def test_columns_of_any_name_pass_with_their_values(spark, place):
    rng, key = np.random.default_rng(5), hashlib.sha1(b"1").hexdigest()
    rows = [(k, prose(rng, 60), "en", "web", 7, *(f"{c} {k}" for c in CLASHING)) for k in range(6)]
    rows += [(9, rows[0][1], *rows[0][2:]), rows[1], (10, f"{prose(rng, 40)} token = \"{key}\" {prose(rng, 20)}", "en", "web", 7, *("x" for _ in CLASHING))]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    table = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    made = pipeline.STAGES[place][1](spark, table, "")
    assert made.columns == names
    held = {(r[0], *r[5:]) for r in map(tuple, rows)}
    found = [tuple(r) for r in made.collect()]
    assert found and {(r[0], *r[5:]) for r in found} <= held
    if place == 1:
        assert sorted(r[0] for r in found) == [0, 1, 2, 3, 4, 5, 10]
    else:
        assert len(found) == len(rows)
    assert (key in str(found)) == (place != 2)


def test_the_stages_reread_what_was_written(spark):
    sf = "/root/testdata/sf0.001"
    first = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in pipeline.run(spark, sf).select("doc_id").collect()}
    assert ids < {r["doc_id"] for r in first.collect()} and len(ids) > 0.4 * first.count()


@pytest.mark.parametrize("place", [1, 3])
def test_stages_with_python_workers_take_rows_in_small_batches(spark, edge_docs, place):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, held in (("10000", pipeline.BATCH_ROWS), ("0", pipeline.BATCH_ROWS), ("7", 7)):
            spark.conf.set(key, given)
            made = pipeline.STAGES[place][1](spark, edge_docs, "")
            sizes = made.select("doc_id").coalesce(1).mapInArrow(lambda batches: batches, "doc_id long")
            assert sizes.count() == made.count() and int(spark.conf.get(key)) == held
    finally:
        spark.conf.set(key, before)


def test_every_operator_has_one_query():
    numbers = [n.split("_")[0] for n in QUERIES]
    assert sorted(numbers, key=lambda n: int(n[2:])) == [f"op{n}" for n in range(1, 14)]
