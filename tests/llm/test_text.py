"""Quality, sharding, near copies, secrets, licences, audio and archives against brute force."""

import hashlib
import os
import re
import textwrap
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import test_near
import xxhash
from pyspark.sql import functions as F

from barline.llm import audio, licenses, quality, secrets, sharding, simhash, warc
from barline.llm.shared import shared_dir

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base_of(text):
    w, text = WORDS.findall(text or ""), text or ""
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def rejected_by(text, lang):
    """The names of all rules that reject a text, by plain counting."""
    w, text = WORDS.findall(text or ""), text or ""
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n, chars = len(w), sum(map(len, w))
    letters = sum(unicodedata.category(c)[0] == "L" for c in text)
    told = {
        "word_length": chars > 12 * n or chars < 2 * n,
        "symbols": 10 * len(re.findall(r"[#*$%&|<>]", text)) > n,
        "duplicate_lines": 100 * (len(lines) - len(set(lines))) > 60 * len(lines),
        "letters": letters < 0.6 * chars,
        "capitals": 2 * sum(unicodedata.category(c) == "Lu" for c in text) > letters,
        "distinct_words": 20 * len(set(w)) < n,
        "stutter": 2 * sum(a == b for a, b in zip(w, w[1:])) > n,  # noqa: B905
        "stop_words": lang in quality.STOP_LANGUAGES and n >= 50 and not {x.lower() for x in w} & set(quality.STOP_WORDS),
    }
    return {name for name, hit in told.items() if hit}


def test_kept_equals_plain_counting(spark, docs, edge_docs):
    prose = "the quick brown fox said that it was in the house of a friend and then it ran far away again for " * 1
    odd = ["zbozi ktere jest velmi dobre a nic vice nez to co bylo " * 6, "AAA BBB CCC DDD " * 8, "12 345 6789 " * 9, "a b c d e f g h i j " * 3, "#x $y % & " + prose, prose, ("word " * 30).strip(), "\n".join([prose] * 5), "x" * 900 + " y" * 25, "👍 é ñ " * 10]
    rows = [(i, t, lang) for i, t in enumerate(odd) for lang in ("en", "cs", None)]
    for table in (docs, edge_docs, spark.createDataFrame(rows, "doc_id long, text string, lang string")):
        for r in quality.quality(table).select("text", "lang", "kept", "failed_rule").collect():
            hit = {"base"} if base_of(r["text"])[-1] else rejected_by(r["text"], r["lang"])
            assert r["kept"] == (not hit) and (r["failed_rule"] in hit if hit else r["failed_rule"] is None)
    assert quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string").drop("lang")).where("failed_rule = 'stop_words'").count() == 0


def test_quality_counts(spark, docs, edge_docs, no_docs):
    tricky = ["a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 9, "x " * 200, "a\n\na\n \nb\na", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0 " * 3, "\x0b\x0c\r\n", "    a#b*c$"]
    more = spark.createDataFrame([(i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    for table in (docs, edge_docs, more):
        for r in quality.quality(table).select("text", *BASE, "kept").collect():
            assert tuple(r[c] for c in BASE) == base_of(r["text"])
            assert not (r["base_failed"] and r["kept"])
    assert quality.quality(no_docs).count() == 0
    assert [c for c in edge_docs.columns if c not in ("n_words", "kept")] == [c for c in quality.quality(edge_docs).columns if c in edge_docs.columns and c not in ("n_words", "kept")]


def test_quality_agrees_with_labels(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.quality(table).where("NOT base_failed").join(labels, "doc_id").select("kept", "quality").toPandas()
    assert judged[judged.quality == 1].kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.1


def test_rule_order_does_not_change_the_verdict(spark, docs):
    given = quality.rules(lang="lang")
    order = quality.rule_order(docs, given, 50, lang="lang")
    assert {r.name for r, _, _ in order} == {r.name for r in given} and all(c > 0 and 0 <= n <= 1 for _, c, n in order)
    costs = {r.name: c for r, c, _ in quality.rule_order(docs, given, 200, lang="lang")}
    assert costs["letters"] > costs["symbols"]  # a scan of the text costs more than a comparison of counts
    measured = quality.base_measures(docs)
    any_rule = measured.where(~F.col("base_failed"))
    for rule in given:
        any_rule = any_rule.where(~F.coalesce(rule.rejects(), F.lit(False)))
    assert any_rule.count() == quality.quality(docs).where("kept").count()


def test_shards(spark, docs, edge_docs, no_docs):
    for table, n in ((docs, 40), (edge_docs, 3)):
        rows = sharding.shards(table, n).collect()
        texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32(r["text"].encode()) if r["text"] is not None else None) for r in table.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
        by_shard = {}
        for r in rows:
            by_shard.setdefault(r["shard"], []).append(r)
        ends, total, most = [], sum(r["size"] for r in rows), max(r["size"] for r in rows)
        for s in sorted(by_shard):
            part = sorted(by_shard[s], key=lambda r: r["slot"])
            assert [r["slot"] for r in part] == list(range(len(part)))
            ids = [r["doc_id"] if r["doc_id"] is not None else -(10**9) for r in part]
            assert ids == sorted(ids) and (not ends or ends[-1] <= ids[0])
            ends.append(ids[-1])
            assert abs(sum(r["size"] for r in part) - total / n) <= most
    assert sharding.shards(no_docs).count() == 0


def print_of(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def component_of(prints, radius):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash_components(spark, docs, edge_docs, no_docs):
    prints = {r["doc_id"]: print_of(r["text"]) for r in docs.collect()}
    found = {r["doc_id"]: (r["print"] % 2**64, r["component"]) for r in simhash.near_groups(docs).collect()}
    roots = component_of(prints, 4)
    assert found == {i: (prints[i], roots[i]) for i in prints}
    rows = simhash.near_groups(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {r["component"] for r in rows if r["doc_id"] in (1, 6)} == {1} and {r["component"] for r in rows if r["doc_id"] in (2, 3, 7)} == {2}
    assert simhash.near_groups(no_docs).count() == 0


@pytest.mark.parametrize("words", [1, 4])
def test_bk_forest_against_all_pairs(words):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**63, (12, words)).astype(np.uint64)
    near = np.repeat(centres, 40, axis=0)
    for row in near:
        for bit in rng.integers(0, 64, rng.integers(0, 5)):
            row[rng.integers(0, words)] ^= np.uint64(1) << np.uint64(bit)
    prints = np.unique(np.concatenate([near, rng.integers(0, 2**63, (200, words)).astype(np.uint64)]), axis=0)
    groups = np.sort(rng.integers(0, 3, len(prints)))
    label = simhash.BkForest(prints, groups).label(4, most=500)
    parent = np.arange(len(prints))
    for i in range(len(prints)):
        for j in range(i):
            if groups[i] == groups[j] and np.bitwise_count(prints[i] ^ prints[j]).sum() <= 4:
                parent = np.where(parent == max(parent[i], parent[j]), min(parent[i], parent[j]), parent)
    assert label.tolist() == parent.tolist()


def test_shards_over_the_bound_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (150, 2))} | {int(x) for x in rng.integers(0, 2**62, 100)})
    table = spark.createDataFrame([(v,) for v in values], "print long")
    links = simhash.link_prints(table, 4, most=20, rows_at_once=50)
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    roots = component_of({v: v for v in values}, 4)
    groups = {}
    for v, r in roots.items():
        groups.setdefault(r, set()).add(v)
    mine = {}
    for v in values:
        mine.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 300)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert len(found) == 61 + 300 and len({found[i] for i in range(61)}) == 1 and len({found[1000 + k] for k in range(300)}) == 1


def test_one_of_each_near_group_stays(spark, edge_docs, no_docs):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(2000)]
    text = [words[i] for i in rng.integers(0, 2000, 400)]
    near = [*text]
    near[200] = "changed"
    other = [words[i] for i in rng.integers(0, 2000, 400)]
    half = text[:150] + other[150:]
    rows = [(3, " ".join(text)), (1, " ".join(near)), (9, " ".join(text)), (4, " ".join(other)), (4, " ".join(other)), (5, " ".join(half).upper())]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 4, 5]
    assert simhash.keep_one(no_docs).count() == 0
    left = simhash.keep_one(edge_docs)
    assert left.columns == edge_docs.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == [(False, -8), (False, 1), (False, 2), (False, 4), (False, 5), (True, 0)]


def test_rows_that_share_an_id_are_told_apart(spark):
    for n in (0, 300):  # among other documents or not
        rng = np.random.default_rng(8)
        a, b, c, d, *others = (" ".join(f"w{i}" for i in rng.integers(0, 9000, 60)) for _ in range(4 + n))
        rows = [(5, a), (5, b), (1, c), (7, c), (7, d), (7, d), (None, a), (None, c + " end"), (None, "alone"), *((100 + k, t) for k, t in enumerate(others))]
        table = spark.createDataFrame(rows, "doc_id long, text string")
        kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(table).collect()]
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        expected = [(5, a), (5, b), (1, c), (7, d), (None, "alone"), *rows[9:]]
        assert sorted(kept, key=key) == sorted(expected, key=key)
        shuffled = [(r["doc_id"], r["text"]) for r in simhash.keep_one(table, most=0).collect()]
        assert sorted(shuffled, key=key) == sorted(expected, key=key)


def test_similar_groups_are_those_of_all_pairs(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    group = {r["doc_id"]: r["component"] for r in simhash.similar_groups(table).collect()}
    wanted = test_near.brute_force({r["doc_id"]: r["text"] for r in table.collect()})
    assert group == wanted and len(set(wanted.values())) < 0.95 * len(wanted)


def test_secrets(spark, docs, edge_docs, no_docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = table.where("doc_id % 2 = 1")
    true = {m for r in held.collect() for m in re.findall(r'AKIA[A-Z0-9]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}', r["text"])}
    found = secrets.secret_scan(held).collect()
    told = {r["value"] for r in found if r["secret"]}
    assert len(true) > 3 and len(true & told) >= 0.95 * len(true) and len(told - true) <= 0.05 * len(true)
    texts = {r["doc_id"]: r["text"] for r in held.collect()}
    assert all(texts[r["doc_id"]][r["start"] - 1 :].startswith(r["value"]) for r in found)
    clean = " ".join(r["text"] for r in secrets.redact(held).collect())
    assert not any(s in clean for s in told)
    for table in (edge_docs, no_docs):
        assert secrets.secret_scan(table).count() >= 0
        assert secrets.redact(table).exceptAll(table).count() == 0 and secrets.redact(table).count() == table.count()


def test_known_texts_are_found_at_any_wrap(spark):
    """Paragraphs wrapped at 40 to 100 columns, as licence files are."""
    rows = [(n, name, "Copyright (c) 2001 A. Person\n\n" + "\n\n".join(textwrap.fill(" ".join(part.split()), width, break_on_hyphens=False) for part in text.split("\n\n"))) for n, (name, text, width) in enumerate((n, t, w) for n, some in licenses.TEXTS.items() for t in some if len(t) > 400 for w in range(40, 101))]
    table = spark.createDataFrame([(n, t) for n, _, t in rows], "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(table).where("unit = 0").collect()}
    assert found == {n: name for n, name, _ in rows}
    assert {"ISC", "MIT", "BSD-2-Clause", "BSD-3-Clause"} <= set(found.values())


def test_licenses(spark, edge_docs, no_docs):
    mit = licenses.TEXTS["MIT"][0]
    changed = "Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sub-license").replace(",", " ;").upper()
    rows = [(1, changed), (2, "text\n# Licensed under the Apache Licence, version 2.0!\nmore"), (3, mit + " and more"), (4, None), (5, ""), (6, "All rights reserved")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["unit"], r["license_id"]) for r in licenses.license_scan(table).collect())
    assert found == [(1, 0, "MIT"), (2, 2, "Apache-2.0"), (6, 0, "all-rights-reserved"), (6, 1, "all-rights-reserved")]
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    assert sorted(con.execute(licenses.license_sql()).fetchall()) == found
    folder = "/usr/share/common-licenses"
    full = {n: open(f"{folder}/{f}", encoding="utf-8").read() for f, n in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")) if os.path.exists(f"{folder}/{f}")}
    wrapped = {n: "Copyright (c) 2024 Somebody\r\n\r\n" + t.upper().replace("LICENSE", "LICENCE").replace("\n", "  \r\n") for n, t in full.items()}
    bsd = [t for t in licenses.TEXTS["BSD-3-Clause"] if len(t) > 500]
    planted = [*wrapped.items(), ("BSD-3-Clause", "Copyright 2020 Z\n" + bsd[0].replace(". ", ".\n")), ("Unlicense", licenses.TEXTS["Unlicense"][0]), ("BSL-1.0", licenses.TEXTS["BSL-1.0"][0]), (None, bsd[1][:-30])]
    more = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(planted)], "doc_id long, text string")
    whole = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(more).where("unit = 0").collect()}
    assert whole == {k: n for k, (n, _) in enumerate(planted) if n}
    con.register("documents", more.toPandas())
    assert sorted(con.execute(licenses.license_sql()).fetchall()) == sorted(map(tuple, licenses.license_scan(more).collect()))
    assert licenses.license_scan(edge_docs).count() == 0 and licenses.license_scan(no_docs).count() == 0


def feature_of(text):
    """The feature by plain loops over samples, phases, frequencies and frames."""
    raw = (text or "").encode()
    x = [(b - 128) / 128 for b in raw.ljust(max(192, -(-len(raw) // 192) * 192))]
    half = []  # every second sample of the windowed sinc that passes the lower half of the band
    for m in range(-(-len(x) // 2)):
        taps = [(k, 0.5 * np.sinc(0.5 * (k - 2 * m)) * (0.5 + 0.5 * np.cos(np.pi * (k - 2 * m) / 16))) for k in range(2 * m - 15, 2 * m + 17)]
        total = sum(h for _, h in taps)
        half.append(sum(h * x[k] for k, h in taps if 0 <= k < len(x)) / total)
    edges = [700 * (10 ** (i * np.log10(1 + 4000 / 700) / 25) - 1) for i in range(26)]
    frames = []
    for f in range(1 + max(0, -(-(len(half) - 256) // 128))):
        cut = [half[128 * f + i] if 128 * f + i < len(half) else 0.0 for i in range(256)]
        cut = np.array([v * (0.5 - 0.5 * np.cos(2 * np.pi * i / 256)) for i, v in enumerate(cut)])
        power = [abs((cut * np.exp(-2j * np.pi * np.arange(256) * q / 256)).sum()) ** 2 for q in range(129)]
        bands = []
        for b in range(24):
            low, mid, high = edges[b : b + 3]
            bands.append(np.log(sum(p * max(0, min((q * 31.25 - low) / (mid - low), (high - q * 31.25) / (high - mid))) for q, p in enumerate(power)) + 1e-6))
        frames.append(bands)
    energy = [np.log(sum(np.exp(bands))) for bands in frames]
    mean, spread = np.mean(energy), np.std(energy)
    spans, on = [], None
    for f, e in enumerate([*energy, -np.inf]):
        if on is None and f < len(energy) and e >= mean + spread / 2 and spread > 1e-9:
            on = f
        elif on is not None and e < mean - spread / 2:
            spans.append((on * 128 / 8000, ((f - 1) * 128 + 256) / 8000))
            on = None
    return len(frames), np.mean(frames, axis=0), spans


def test_audio_round_trip(spark, docs, edge_docs, no_docs):
    few = docs.where("length(text) < 3000").orderBy("doc_id").limit(25)
    small = edge_docs.where("text IS NULL OR length(text) < 6000")
    for table in (small, few):
        read = audio.audio_features(audio.audio_tensors(audio.store_audio(table))).collect()
        assert len(read) == table.count()
        by_digest = {hashlib.sha256((b := (r["text"] or "").encode()).ljust(max(192, -(-len(b) // 192) * 192))).hexdigest(): r["text"] for r in table.collect()}
        assert {r["payload_sha256"] for r in read} == set(by_digest)
        for r in read:
            text = by_digest[r["payload_sha256"]]
            frames, means, spans = feature_of(text)
            n, told, shown = r["feature"].split(";")
            assert int(n) == frames and np.abs(np.array(told.split(","), float) - means).max() < 0.03
            assert [tuple(map(float, x.split("-"))) for x in shown.split(",") if x] == [(pytest.approx(a, abs=1e-3), pytest.approx(b, abs=1e-3)) for a, b in spans]
            raw = (text or "").encode()
            media = audio.wav_bytes(raw.ljust(r["payload_bytes"]))
            assert (r["n_bytes"], r["media_bytes"], r["media_sha256"], r["tail_crc32"]) == (len(raw), len(media), hashlib.sha256(media).hexdigest(), zlib.crc32(raw.ljust(r["payload_bytes"])[-16:]))
            tensors = pa.ipc.open_stream(bytes(r["tensors"])).read_all()
            assert tensors.schema.field("log_mel").type == audio.TENSOR and audio.tensor_frames(bytes(r["tensors"])).shape == (frames, audio.BANDS)
    whole = audio.audio_features(audio.audio_tensors(audio.store_audio(edge_docs))).collect()
    assert len(whole) == edge_docs.count() and len({r["feature"] for r in whole if r["doc_id"] in (1, 6)}) == 1
    gone = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert audio.audio_features(audio.audio_tensors(gone)).first()["feature"] is None
    assert audio.audio_features(audio.audio_tensors(audio.store_audio(no_docs))).count() == 0


def test_audio_features_of_a_tone():
    t = np.arange(16_000) / audio.RATE
    tone = (np.sin(2 * np.pi * 1000 * t) * (t > 0.4) * (t < 0.7)).astype(np.float32)
    for up, down in ((1, 2), (3, 4), (2, 1)):
        y = audio.resample(tone, up, down)
        at = np.arange(len(y)) * down / up / audio.RATE
        inside = (at > 0.45) & (at < 0.65)
        assert np.abs(y - np.sin(2 * np.pi * 1000 * at))[inside].max() < 0.01
    mel = audio.log_mel(audio.resample(tone, 1, 2))
    ((start, end),) = audio.segments(mel)
    assert abs(start - 0.4) < 0.04 and abs(end - 0.7) < 0.04
    assert audio.segments(np.zeros((5, audio.BANDS), np.float32)) == []
    with pytest.raises(ValueError, match="WAVE"):
        audio.wav_samples(b"no such file")


def test_archive_audit(spark):
    rows = [(i, f"http://h{i % 3}/", f"<p>{i}</p>\r\n\r\nWARC/1.0 {'x' * (i % 50)}é") for i in range(300)] + [(300, None, None), (None, "u", ""), (5, "again", "<p>"), (301, "http://x/?q=Content-Length: 3", "<p>long"), (None, "http://x/<urn:page:5>", "<p>"), (302, "a\r\nContent-Length: 1", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, path = shared_dir(spark), shared_dir(spark)
    warc.write_archive(pages.withColumns({"segment": F.lit("x"), "record": F.lit(1), "__row": F.lit(2)}), one, 15_000)
    left = warc.read_archive(spark, one).persist()
    assert left.count() == len(rows)
    key = lambda x: (x is not None, x or 0)
    assert sorted((r["page_id"] for r in left.collect()), key=key) == sorted((r[0] for r in rows), key=key)
    by_segment = {}
    for r in left.collect():
        by_segment.setdefault(r["segment"], []).append(r)
    assert len(by_segment) > 3
    for part in by_segment.values():
        part.sort(key=lambda r: r["seq"])
        assert [r["offset"] for r in part] == np.concatenate([[0], np.cumsum([r["length"] for r in part])[:-1]]).tolist()
    assert warc.audit(left, left).count() == 0
    bad = {(r["segment"], r["seq"]) for k, r in enumerate(left.orderBy("segment", "seq").collect()) if k in (0, 77, 150, 301)}
    hit = F.struct("segment", "seq").isin([F.struct(F.lit(a), F.lit(b).cast("long")) for a, b in bad])
    right = left.withColumn("digest", F.when(hit, F.unhex(F.lit("00" * 32))).otherwise(F.col("digest")))
    assert {(r["segment"], r["seq"]) for r in warc.audit(left, right, fanout=4).collect()} == bad
    status = Counter(r["status"] for r in warc.fixity(left, right.where("segment <> 0 OR seq < 20")).collect())
    lost = left.where("segment = 0 AND seq >= 20").count()
    assert status["missing"] == lost and sum(status.values()) == len(rows)
    copy = shared_dir(spark)
    warc.copy_archive(spark, one, copy, F.when(F.col("page_id") == 301, F.replace("record", F.lit("long"), F.lit("song"))).otherwise(F.col("record")))
    copied = warc.read_archive(spark, copy)
    assert [(r["page_id"], r["status"]) for r in warc.fixity(left.withColumn("extra", F.lit(1)), copied).where("status <> 'intact'").collect()] == [(301, "altered")]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(empty, path)
    none = warc.read_archive(spark, path)
    assert none.count() == 0 and warc.fixity(none, none).count() == 0 and warc.audit(left, none).count() == len(rows)
    assert {r["status"] for r in warc.fixity(none, left).collect()} == {"extra"}
