"""Quality rules over whole texts in native expressions, run as a short-circuit cascade."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.shared import fresh, named

#: Words are runs of characters other than space and U+0009 to U+000D.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 8
#: Languages by code, and frequent function words of each.
STOP_LANGUAGES = ["en", "fr", "es", "de"]
STOP_WORDS = ["the", "of", "and", "is", "in", "that", "was", "for", "de", "la", "le", "les", "des", "et", "que", "el", "los", "en", "der", "die", "das", "und", "ist", "von"]


#: Columns that quality() adds.
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", "kept"]


@dataclass(frozen=True)
class Rule:
    """rejects: a condition on the table of base_measures(); null counts as not rejected."""

    name: str
    rejects: Callable[[], Column]


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds words, lines and the counts n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    n_repeat_words: words that lie in a window of 8 words found twice or more in the text. Windows are compared by
    a 64-bit hash of hashes, built by doubling (2, 4, then 8 words). Only a text in which the distinct windows are
    fewer than the windows is looked into further: its windows are sorted by hash, those equal to a neighbour are
    kept, and the gaps between their places give the words covered. Nothing leaves the row, so there is no shuffle.
    A null text counts as an empty one.
    """
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS), "")
    out = docs.withColumn("__words", words)
    out = out.withColumns({"n_words": F.size("__words").cast("long"), "word_chars": F.char_length(F.array_join("__words", "")).cast("long"), "__h1": F.when(F.size("__words") > WINDOW, F.transform("__words", lambda w: F.xxhash64(w)))})
    for span, half in (("__h2", 1), ("__h4", 2), ("__h8", 4)):
        left = f"__h{half}"
        shifted = F.slice(left, half + 1, F.greatest(F.size(left) - half, F.lit(0)))
        out = out.withColumn(span, F.zip_with(left, shifted, lambda a, b: F.xxhash64(a, b)))
    # The shorter side of each zip is padded with nulls; only the first n - 7 entries are whole windows.
    out = out.withColumn("__h8", F.slice("__h8", 1, F.greatest(F.size("__words") - (WINDOW - 1), F.lit(0))))
    out = out.withColumn("__repeats", F.size(F.array_distinct("__h8")) < F.size("__h8"))
    placed = F.when(F.col("__repeats"), F.sort_array(F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("__sorted", placed)
    n = F.size("__sorted")
    neighbours = F.zip_with(F.zip_with("__sorted", F.slice("__sorted", 2, n), lambda a, b: F.struct(a["i"].alias("i"), a["h"].alias("h"), (a["h"] == b["h"]).alias("next"))), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("__sorted", 1, n - 1)), lambda x, p: F.struct(x["i"].alias("i"), (F.coalesce(x["next"], F.lit(False)) | F.coalesce(x["h"] == p["h"], F.lit(False))).alias("twice")))
    out = out.withColumn("__sorted", F.when(F.col("__repeats"), F.sort_array(F.transform(F.filter(neighbours, lambda x: x["twice"]), lambda x: x["i"]))))
    gaps = F.zip_with("__sorted", F.slice("__sorted", 2, F.size("__sorted")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.when(F.col("__repeats"), F.aggregate(gaps, F.lit(0), lambda s, x: s + x)).otherwise(0)
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    symbols = F.octet_length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SYMBOLS, ""))
    out = out.withColumns({"n_repeat_words": covered.cast("long"), "__lines": lines, "n_symbols": symbols.cast("long")})
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    # A later filter is not pushed below a column that is not deterministic; pushed, it would repeat the expressions
    # above for each use and run lambdas within lambdas.
    out = out.withColumn("__held", F.monotonically_increasing_id())
    return out.withColumn("base_failed", (F.col("__held") >= 0) & ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))


def rules(text: str = "text", lang: str | None = None) -> list[Rule]:
    """The rules beside the base: each rejects text that is not running prose in some way.

    lang: a column of language codes. Only texts of the languages of STOP_WORDS are to have one of these words; texts
    of other or unknown languages pass that rule, and without the column all do.
    """
    n_words, chars = F.col("n_words"), F.col("word_chars")
    letters = F.char_length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\P{L}+", ""))
    shouted = F.char_length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\P{Lu}+", ""))
    stops = F.size(F.array_intersect(F.transform(F.slice("__words", 1, F.size("__words")), lambda w: F.lower(w)), F.array(*map(F.lit, STOP_WORDS))))
    following = F.slice("__words", 2, F.greatest(F.size("__words") - 1, F.lit(0)))
    again = F.size(F.array_remove(F.zip_with("__words", following, lambda a, b: F.coalesce(a == b, F.lit(False))), False))
    listed = F.lower(F.col(lang).cast("string")).isin(STOP_LANGUAGES) if lang else F.lit(False)
    return [
        Rule("word_length", lambda: (chars > 12 * n_words) | (chars < 2 * n_words)),
        Rule("symbols", lambda: 10 * F.col("n_symbols") > n_words),
        Rule("duplicate_lines", lambda: 100 * F.col("n_dup_lines") > 60 * F.size("__lines")),
        Rule("letters", lambda: 10 * letters < 6 * chars),
        Rule("capitals", lambda: 2 * shouted > letters),
        Rule("distinct_words", lambda: 20 * F.size(F.array_distinct("__words")) < n_words),
        Rule("stutter", lambda: 2 * again > n_words),
        Rule("stop_words", lambda: listed & (n_words >= 50) & (stops < 1)),
    ]


def rule_order(docs: DataFrame, given: list[Rule], sample_rows: int = 200, text: str = "text", lang: str | None = None, most: int = 128) -> list[tuple[Rule, float, float]]:
    """The rules by falling rejection per cost, with each one's seconds a row and rejected share on a sample.

    The sample is the ``sample_rows`` rows with the least hash of their text and place, so it comes from all parts of
    the table. Rejection is the share among its rows that pass the base. For the cost a rule runs over the sample 16
    and then ``most`` times, until the median of three jobs takes twice what a job without a rule does; what it takes
    beyond that is its cost. A rule that does not get there counts as the cheapest one measured, as its cost cannot be
    told from none. Rules that reject nothing of the sample come last, unmeasured. The order decides which rule is
    tried first, not which rows are kept.
    """
    columns = [named(c).cast("string").alias(c) for c in ([text, lang] if lang else [text])]
    drawn = docs.select(*columns, F.xxhash64(named(text), F.monotonically_increasing_id()).alias("drawn")).orderBy("drawn").limit(sample_rows)
    rows = drawn.select(*(named(c) for c in ([text, lang] if lang else [text]))).collect()
    listed = docs.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ([text, lang] if lang else [text])))
    sample = base_measures(listed, text).where("NOT base_failed").coalesce(1).persist()

    @cache
    def seconds(given: Rule | None, times: int) -> float:
        rule = F.col("n_words") < 0 if given is None else given.rejects()
        more = sample.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(times))))
        took = []
        for _ in range(3):
            began = time.perf_counter()
            more.agg(F.count_if(rule & (F.col("__k") > 0))).collect()
            took.append(time.perf_counter() - began)
        return statistics.median(took)

    def cost(rule: Rule) -> float | None:
        for times in (16, most):
            spent, empty = seconds(rule, times), seconds(None, times)
            if spent >= 2 * empty:
                return (spent - empty) / times
        return None

    try:
        shares = sample.agg(F.count("*"), *(F.count_if(r.rejects()) for r in given)).first()
        costs = [cost(r) if n else None for r, n in zip(given, shares[1:], strict=True)]
    finally:
        sample.unpersist()
    least = min((c for c in costs if c is not None), default=1.0)
    n = max(1, shares[0])
    judged = [(r, (least if c is None else c) / n, x / n) for r, c, x in zip(given, costs, shares[1:], strict=True)]
    return sorted(judged, key=lambda x: (-x[2] / x[1], x[0].name))


def quality(docs: DataFrame, text: str = "text", lang: str | None = "lang", sample_rows: int = 200) -> DataFrame:
    """Adds the base counts, base_failed, kept and failed_rule to every row.

    kept is false if the base fails; else the rules are tried in the order of rule_order() and the first that
    rejects ends the row's cascade, since CASE branches are evaluated in turn; failed_rule is that one, so of several
    that reject a row it depends on the order. A null text has no words and fails, a null language is unknown (as
    all are in a table without the column ``lang``). Repeated rows are judged each; all other columns stay, whatever
    their names, but those named like a result are replaced; an empty table stays empty.
    """
    lang = lang if lang in docs.columns else None
    # Columns named like the measures' own are kept under other names meanwhile.
    own = [c for c in docs.columns if c.startswith("__")]
    aside = dict(zip(own, fresh(docs.columns, *(f"own {c}" for c in own)), strict=True))
    held = docs.select(*(named(c).alias(aside.get(c, c)) for c in docs.columns)) if own else docs
    measured = base_measures(held, text)
    cascade = F.when(F.col("base_failed"), F.lit("base"))
    for rule, _, _ in rule_order(held, rules(text, lang), sample_rows, text=text, lang=lang):
        cascade = cascade.when(rule.rejects(), F.lit(rule.name))
    judged = measured.withColumns({"failed_rule": cascade, "__judged": F.monotonically_increasing_id()})
    out = judged.withColumn("kept", F.col("failed_rule").isNull() & (F.col("__judged") >= 0))
    stay = [c for c in docs.columns if c not in RESULTS]
    return out.select(*(named(aside.get(c, c)).alias(c) for c in stay), *RESULTS)


def quality_sql() -> str:
    """The counts and verdicts of quality() over a view named documents, for a check by another engine."""
    word = "[^\\x20\\x09-\\x0D]"
    stops, languages = (", ".join(f"'{x}'" for x in some) for some in (STOP_WORDS, STOP_LANGUAGES))
    letters, capitals = (f"length(regexp_replace(t, '\\P{{{c}}}', '', 'g'))" for c in ("L", "Lu"))
    rejected = [
        "word_chars > 12 * n_words OR word_chars < 2 * n_words",
        "10 * n_symbols > n_words",
        "100 * n_dup_lines > 60 * len(lines)",
        f"10 * {letters} < 6 * word_chars",
        f"2 * {capitals} > {letters}",
        "20 * len(list_distinct(ws)) < n_words",
        "2 * len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) > n_words",
        f"coalesce(lower(lang) IN ({languages}), false) AND n_words >= 50 AND len(list_intersect(list_transform(ws, lambda x: lower(x)), [{stops}])) < 1",
    ]
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
    w AS MATERIALIZED (SELECT *, regexp_extract_all(t, '{word}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM d),
    windows AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r),
    counts AS (SELECT w.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN covered c USING (r)),
    base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
        base_failed, NOT base_failed AND NOT (({') OR ('.join(rejected)})) AS kept FROM base
    """
