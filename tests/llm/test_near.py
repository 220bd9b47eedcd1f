"""Near copies against the exact similarity of all pairs."""

from collections import Counter

import numpy as np

from barline.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def links(texts, similarity=0.8):
    sets = {d: shingles(t) for d, t in texts.items()}
    holders, shared = {}, Counter()
    for d in sorted(sets):
        for x in sets[d]:
            shared.update((a, d) for a in holders.get(x, []))
            holders.setdefault(x, []).append(d)
    return [p for p, n in shared.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= similarity]


def brute_force(texts):
    root = {d: d for d in texts}
    for a, b in links(texts):
        a, b = root[a], root[b]
        if a != b:
            root = {d: min(a, b) if r in (a, b) else r for d, r in root.items()}
    return root


def found(spark, texts):
    table = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r["component"] for r in simhash.similar_groups(table).collect()}


def edited(rng, share, scattered):
    """A text of 300 words, and a copy in which about ``share`` of the shingles differ."""
    text = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    if not scattered:
        gone = int(300 * share)
        start = int(rng.integers(0, 300 - gone))
        return " ".join(text), " ".join(text[:start] + text[start + gone :])
    near = [*text]
    for k in rng.choice(300, max(1, int(300 * share / 10)), replace=False):
        near[k] = "changed"
    return " ".join(text), " ".join(near)


def test_pairs_about_the_similarity_link_exactly_from_it_on(spark):
    for n in (20, 400):
        rng, texts = np.random.default_rng(11), {}
        for k in range(n):
            texts[2 * k], texts[2 * k + 1] = edited(rng, rng.uniform(0.1, 0.35), k % 2)
        assert 0.1 * n < len(links(texts)) < 0.9 * n
        assert found(spark, texts) == brute_force(texts)


def test_sets_cut_into_parts_link_alike(spark):
    rng, rows = np.random.default_rng(3), []
    base = rng.integers(0, 2**62, 400)
    for k in range(40):
        rows.append((k, [0] * 4, sorted({*base[: 400 - 6 * k].tolist(), *rng.integers(0, 2**62, 5).tolist()})))
    held = spark.createDataFrame(rows, "print long, words array<long>, shingles array<long>")
    star = spark.createDataFrame([(0, k) for k in range(1, 40)], "u long, v long")
    sets = [set(r[2]) for r in rows]
    root = list(range(40))
    for b in range(40):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    for most in (2_000_000, 2_000):
        got = {r["node"]: r["root"] for r in simhash.components(simhash.confirmed(held, star, 0.8, most)).collect()}
        assert [got.get(k, k) for k in range(40)] == root


def test_few_rows_go_to_few_files_and_link_alike(spark):
    links = [(k, k + 1) for k in range(0, 400) if k % 20 != 19]
    table = spark.createDataFrame(links, "u long, v long").repartition(9)
    set_before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        made = simhash.components(table)
        assert len(made.inputFiles()) == 1
        assert {r["node"]: r["root"] for r in made.collect()} == {k: k - k % 20 for k in range(400)}
    finally:
        for k, v in set_before.items():
            spark.conf.set(k, v)
