"""Conversation repair against brute force."""

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from barline.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\f\r"


def faults_of(turns):
    """Fault of each (turn, role, text) in order: blank, duplicate, truncated or none."""
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, faults):
    """(cost, audit, repaired lines) by trying every edit of every turn and up to two inserts in every gap."""
    gaps = ["", "u", "a", "ua", "au"]
    best = None
    edits = [[("D", "", 3)] if f in ("blank", "duplicate") else [("K", r[:1], f == "truncated"), ("R", "u", 2 + (f == "truncated")), ("R", "a", 2 + (f == "truncated")), ("D", "", 3)] for (_, r, _), f in zip(turns, faults, strict=True)]
    for chosen in itertools.product(*edits):
        for inserts in itertools.product(gaps, repeat=len(turns) + 1):
            initials = inserts[0] + "".join(c[1] + i for c, i in zip(chosen, inserts[1:], strict=True))
            if any(c[0] == "K" and len(c[1]) != 1 for c in chosen) or not re.fullmatch("(s?(ua)+)?", initials):
                continue
            cost = sum(c[2] for c in chosen) + 2 * sum(map(len, inserts))
            audit = "I" * len(inserts[0]) + "".join(c[0] + "I" * len(i) for c, i in zip(chosen, inserts[1:], strict=True))
            if best is None or (cost, audit) < best[:2]:
                name = {"u": "user", "a": "assistant"}
                lines = [f"{name[x]}:" for x in inserts[0]]
                for (edit, to, _), i, (_, role, text) in zip(chosen, inserts[1:], turns, strict=True):
                    lines += ([f"{role if edit == 'K' else name[to]}:{text}"] if edit != "D" else []) + [f"{name[x]}:" for x in i]
                best = (cost, audit, "\n".join(lines))
    return best


#: What may follow where: nothing yet, after the system's turn, after a user's, after an assistant's.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def by_table(turns, faults):
    """The same by a table over turns and last initials; a value holds the lines made so far."""
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):
            for at, (cost, audit, lines) in list(best.items()):
                for t in NEXT[at].replace("s", ""):
                    made = (cost + 2, audit + "I", [*lines, name[t] + ":"])
                    if t not in best or made[:2] < best[t][:2]:
                        best[t] = made
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(turns, faults, strict=True):
        after = {}
        for at, (cost, audit, lines) in best.items():
            ways = [(at, cost + 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                stays = cost + (fault == "truncated")
                ways += [(t, stays, "K", [f"{role}:{text}"]) for t in NEXT[at] if role[:1] == t] + [(t, stays + 2, "R", [f"{name[t]}:{text}"]) for t in NEXT[at] if t != "s"]
            for to, value, letter, line in ways:
                if to not in after or (value, audit + letter) < after[to][:2]:
                    after[to] = (value, audit + letter, lines + line)
        best = inserted(after)
    cost, audit, lines = min(v for k, v in best.items() if k in ("", "a"))
    return cost, audit, "\n".join(lines)


def expected(turns):
    faults = faults_of(turns)
    cost, audit, text = cheapest(turns, faults) if len(turns) < 4 else by_table(turns, faults)
    if len(turns) < 4:
        assert by_table(turns, faults) == (cost, audit, text)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def result(rows, part_rows=1024):
    report, turns = conversations.repair(rows, part_rows)
    digests = {r["conv_id"]: r["sha256"] for r in conversations.repaired_digests(turns).collect()}
    return {r["conv_id"]: (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), digests[r["conv_id"]]) for r in report.collect()}


@pytest.fixture(scope="module")
def small():
    """All role sequences of up to three turns, of which some are blank, repeated or cut, with gaps and null turns."""
    out, n = {}, 0
    for size in (1, 2, 3):
        for roles in itertools.product(["user", "assistant", "system", "tool", ""], repeat=size):
            n += 1
            texts = [["Ask.", "Tell it", " \t", "Well!  ", "Ask."][zlib.crc32(f"{n}:{k}".encode()) % 5] for k in range(size)]
            turns = [None if n % 11 == 0 and k == 0 else k * (1 + n % 3) for k in range(size)]
            out[n] = list(zip(turns, roles, texts, strict=True))
    out[None] = [(5, "user", "Twice."), (5, "user", "Twice."), (6, "assistant", "Yes?")]
    out[-1] = [(None, "assistant", "b"), (None, "user", "a.")]
    return out


def test_every_short_conversation_has_the_cheapest_repair(spark, small):
    rows = spark.createDataFrame([(c, *t) for c, turns in small.items() for t in turns], SCHEMA)
    assert result(rows) == {c: expected(turns) for c, turns in small.items()}


def test_parts_make_no_difference(spark, small):
    """Also one conversation with most of the rows, cut into many parts."""
    long = [(k, ["user", "assistant", "user", "tool", "system"][zlib.crc32(f"r{k}".encode()) % 5], ["a.", "b", "", f"c{k}!"][zlib.crc32(f"t{k}".encode()) % 4]) for k in range(700)]
    rows = spark.createDataFrame([(c, *t) for c, turns in (small | {9999: long}).items() for t in turns], SCHEMA)
    whole = result(rows, 1 << 20)
    assert whole == result(rows, 2) == result(rows, 97)
    assert whole[9999] == expected(long)


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    rows = spark.createDataFrame([(1, 0, None, "x."), (1, 1, "user", None), (None, None, None, None)], SCHEMA).withColumn("key", F.lit("k")).withColumn("place", F.lit(3)).withColumn("a.b", F.lit(1))
    found = result(rows)
    assert found[1] == expected([(0, " ", "x."), (1, "user", " ")]) and found[None] == expected([(None, " ", " ")])
    assert result(rows.where("conv_id = 7")) == {}


def test_query_over_the_table(spark):
    """Each conversation after damage, by brute force, and every conversation is there."""
    sf = "/root/testdata/sf0.01"
    got = {r["conv_id"]: r for r in queries.op11_repair(spark, sf).collect()}
    held = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        held.setdefault(r["conv_id"], []).append(r)
    assert set(got) == set(held)
    for conv, rows in held.items():
        turns = []
        for r in rows:
            k = zlib.crc32(f"{conv}:{r['turn']}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", r["text"]) if k == 2 else r["text"]
            turns += [(r["turn"], "user" if k == 4 else r["role"], text)] * (0 if k == 0 else 2 if k == 3 else 1)
        turns.sort(key=lambda t: t[0])
        want = expected(turns) if turns else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert tuple(got[conv][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) == want
