"""Packing, byte-level BPE and the id store against the libraries and brute force."""

import base64
import json
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barline.llm import bytebpe, idstore, packing
from barline.llm.shared import shared_dir
from barline.llm.wordcodec import WordCodec

RANKS = P.path("byte_bpe_50k.tiktoken")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library(path, plain=False):
    t = Tokenizer.from_file(path)
    if plain:
        t.encode_special_tokens = True
    return t


PARTS = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "é", "B", "1", "²", "!", ",", " ", "　", "漢", "👍", "\x1c", "́", "\r\n", "<|endoftext|>", "<|", "word", "rock'n'", "n't.", "_", "§", "Σ", "İ", "\U000323b0"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=40).map(lambda t: t.encode("utf-8", "ignore").decode())


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_byte_bpe_equals_the_library(own, texts):
    merger = bytebpe.RankMerger.of(RANKS)
    for text, ids in zip(texts, merger.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
        assert merger.decode(ids) == text.encode()
        ends, size = merger.offsets(ids), len(text.encode())
        assert merger.decode(ids, ends, size // 3, size // 2) == text.encode()[size // 3 : size // 2]


def test_long_slices_merge_like_short_ones(own):
    merger, rng = bytebpe.RankMerger.of(RANKS), random.Random(3)
    for piece in ["a" * 5000, "".join(rng.choice("abcdeé") for _ in range(3000)), "!?" * 900, " " * 700]:
        assert np.frombuffer(merger.encode([piece])[0], "<u4").tolist() == own.encode_ordinary(piece)


def test_scan_composes_in_order():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000, 5003):
        numbers = rng.integers(0, bytebpe.SYMBOLS, n).astype(np.uint8)
        state, out = 0, []
        for s in numbers:
            state = bytebpe.AFTER[s, state]
            out.append(state)
        assert bytebpe.FUNCTIONS[bytebpe.scan(numbers), 0].tolist() == out


def test_special_tokens_are_ids_as_the_library_loads_them():
    for path in (BYTE, WORD):
        for text in ("hello <|endoftext|> world", "a<|ENDOFTEXT|>b", "<|startoftext|><|endoftext|>", "x <| y"):
            for plain in (False, True):
                assert np.frombuffer(WordCodec.of(path, plain).encode(text), "<u4").tolist() == library(path, plain).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("plain", [False, True])
def test_word_codec_equals_the_library(path, plain):
    codec, whole = WordCodec(path, plain, limit=50), library(path, plain)

    @settings(max_examples=300, deadline=None)
    @given(TEXTS)
    def check(text):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids

    check()


def test_a_packing_worker_keeps_few_words():
    codec, most, whole = WordCodec.of(BYTE, False, corpus_pipeline.WORDS), 0, library(BYTE, False)
    for k in range(40):
        text = " ".join(f"v{k}x{i}" for i in range(10_000))
        ids = codec.encode(text)
        most = max(most, len(codec.words), len(codec.pieces))
    assert 100_000 < most <= 220_000
    assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_byte_bpe_on_edge_rows(spark, edge_docs, no_docs, own):
    rows = bytebpe.encode_decode(edge_docs, RANKS, batch_bytes=1000).collect()
    assert len(rows) == edge_docs.count()
    texts = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in edge_docs.collect()))
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["decoded"]).decode(), bytes(r["ids"])) for r in rows))
    for (a, b, text), (c, d, decoded, ids) in zip(texts, found, strict=True):
        assert (a, b, text) == (c, d, decoded) and np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
    assert bytebpe.encode_decode(no_docs, RANKS).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(5)
    lengths = np.array([rng.choice([1, 2, 50, 300, 511, 512, 700, 1023, 1024]) for _ in range(400)])
    places, offsets, used = packing.best_fit_decreasing(lengths, 1024)
    room: list[int] = []
    for k in np.argsort(-lengths, kind="stable"):
        open_ = [r for r in room if r >= lengths[k]]
        if open_:
            i = room.index(min(open_))
            room[i] -= lengths[k]
        else:
            room.append(1024 - lengths[k])
    assert used == len(room)
    assert sorted(1024 - np.bincount(places, lengths).astype(int)) == sorted(room)
    for p in range(used):
        at = np.flatnonzero(places == p)
        at = at[np.argsort(offsets[at])]
        assert offsets[at].tolist() == np.concatenate([[0], np.cumsum(lengths[at])[:-1]]).tolist()


def check_pieces(rows, texts):
    whole, seen, windows = library(BYTE), {}, {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], len(r["ids"]) // 4))
        assert r["doc_tokens"] >= len(r["ids"]) // 4
    for places in windows.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    expected = {}
    for d, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        expected.setdefault(d, []).append(ids)
    for d, ids in expected.items():
        assert sum(len(x) for _, x in seen[d]) == sum(map(len, ids))
        if len(ids) == 1:
            assert b"".join(x for _, x in sorted(seen[d])) == ids[0]
    assert set(seen) == set(expected)
    return windows


def test_packing_against_the_library(spark, docs, edge_docs, no_docs):
    windows = check_pieces(packing.pack(docs, BYTE).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(n for w in windows.values() for _, n in w) > 0.98 * 1024 * len(windows)
    check_pieces(packing.pack(edge_docs, BYTE, block_tokens=2000).collect(), [(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    assert packing.pack(no_docs, BYTE).count() == 0


def test_cuts_depend_on_content():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 40_000, 20_000).astype(np.uint32)
    ends = idstore.cut_points(ids, 256, 64, 2048)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes[:-1].min() >= 64 and sizes.max() <= 2048 and 150 < sizes.mean() < 500
    moved = idstore.cut_points(np.concatenate([ids[:100], [7], ids[100:]]), 256, 64, 2048)
    assert len(set(ends) & {e - 1 for e in moved}) > 0.9 * len(ends)
    flat = idstore.cut_points(np.zeros(10_000, np.uint32), 256, 64, 2048)
    assert flat[-1] == 10_000 and np.diff([0, *flat]).max() <= 2048
    assert idstore.cut_points(ids[:0], 256, 64, 2048) == []


def test_crc_of_parts():
    rng = random.Random(1)
    rows = [[rng.randbytes(rng.choice([0, 1, 4, 300, 70_000])) for _ in range(rng.randrange(1, 6))] for _ in range(60)]
    parts, first = [p for row in rows for p in row], np.cumsum([0] + [len(row) for row in rows])[:-1]
    found = idstore.joined_crc32(np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts]), first)
    assert found.tolist() == [zlib.crc32(b"".join(row)) for row in rows]
    assert idstore.joined_crc32(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_marks_are_those_of_a_polynomial_over_the_window():
    ids, factor = np.random.default_rng(4).integers(0, 50_000, 300), 0xD6E8FEB86659FD93
    mixed = [(int(x) + 1) * 0x9E3779B97F4A7C15 % 2**64 for x in ids]
    mixed = [m ^ m >> 29 for m in mixed]
    hashes = [sum(mixed[i - b] * factor**b for b in range(min(16, i + 1))) % 2**64 for i in range(len(ids))]
    for n in (0, 1, 5, 15, 16, 17, 300):
        assert idstore.rolling_marks(ids[:n], 8).tolist() == [i + 1 for i in range(n) if hashes[i] >> 40 & 7 == 0]


def test_id_store_round_trip(spark, docs, edge_docs, no_docs):
    whole = library(WORD)
    for table in (docs, edge_docs, no_docs):
        path = shared_dir(spark)
        idstore.write_store(table, path, WORD, end_id=2, parts=3)
        assert idstore.verify_store(spark, path).count() == 0
        ids = lambda t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        texts = [(r["doc_id"], r["text"]) for r in table.collect()]
        back = [(r["doc"], b"".join(map(bytes, r["ids"]))) for r in idstore.read_ids(spark, path).collect()]
        narrow = lambda raw: np.frombuffer(raw, "<u4").astype("<u2").tobytes()
        key = lambda x: (x[0] is not None, x[0] or 0, x[1])
        assert sorted(back, key=key) == sorted(((d, narrow(ids(t))) for d, t in texts), key=key)
        sums = sorted(idstore.document_sums(spark, path).collect(), key=lambda r: r["start"])
        assert [r["start"] for r in sums] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in sums])[:-1]]).tolist() if sums else not texts
        assert [r["doc"] for r in sums] == sorted((d for d, _ in texts), key=lambda d: (d is not None, d or 0))
        assert sorted(r["ids_crc32"] for r in sums) == sorted(zlib.crc32(ids(t)) for _, t in texts)
        digests = [r["digest"] for r in spark.read.parquet(f"{path}/chunks").select("digest").collect()]
        assert len(digests) == len({bytes(x) for x in digests})


def test_damage_is_found(spark, docs):
    path = shared_dir(spark)
    idstore.write_store(docs, path, WORD, end_id=2, parts=2)
    chunks = spark.read.parquet(f"{path}/chunks")
    one = chunks.orderBy("digest").first()["digest"]
    from pyspark.sql import functions as F

    broken = chunks.withColumn("ids", F.when(F.col("digest") == F.lit(one), F.concat("ids", F.lit(b"\x01\x00"))).otherwise(F.col("ids")))
    other = shared_dir(spark)
    broken.write.parquet(f"{other}/chunks")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{other}/{name}")
    assert [r["kind"] for r in idstore.verify_store(spark, other).collect()] == ["chunk"]
    with pytest.raises(Exception, match="damaged"):
        idstore.document_sums(spark, other).collect()
    moved = shared_dir(spark)
    for name in ("chunks", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{moved}/{name}")
    idstore.read_recipes(spark, path).withColumn("doc", F.when(F.col("doc") == 7, F.lit(8)).otherwise(F.col("doc"))).write.parquet(f"{moved}/recipes")
    with pytest.raises(Exception, match="differ from the manifest"):
        idstore.document_sums(spark, moved).collect()


def test_ids_of_large_vocabularies_take_four_bytes(spark, docs, tmp_path):
    spec = json.load(open(WORD, encoding="utf-8"))
    spec["model"]["vocab"] |= {f"unused{k}</w>": k for k in range(60_000, 70_000)}
    spec["added_tokens"] = []
    large = str(tmp_path / "large.json")
    json.dump(spec, open(large, "w", encoding="utf-8"))
    path, end = shared_dir(spark), 69_999
    idstore.write_store(docs.limit(20), path, large, end_id=end, parts=2)
    whole = library(large)
    expected = {r["doc_id"]: np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, end], "<u4").tobytes() for r in docs.limit(20).collect()}
    assert idstore.id_width(spark, path) == 4
    assert {r["doc"]: (r["n_tokens"], r["ids_crc32"]) for r in idstore.document_sums(spark, path).collect()} == {d: (len(x) // 4, zlib.crc32(x)) for d, x in expected.items()}
