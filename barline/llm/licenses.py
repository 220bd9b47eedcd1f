"""Licence scans: whole texts and whole lines by the digest of a canonical form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.license_texts import DIGESTS, SPELLINGS, TEXTS

#: Lines that name a copyright holder; they differ between copies of one licence. After the word comes (c), a sign, "by"
#: or a year, which the sentences of licences that happen to be wrapped before the word do not have.
COPYRIGHT = r"(?m)^[ \t#*/;-]*(copyright[ \t]+(\(c\)|©|by[ \t]|.*[0-9]{4})|\(c\)[ \t]+.*[0-9]{4}|©).*$"
NOT_WORDS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, with one spelling for equal ones, and one space for all punctuation."""
    bare = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    spelled = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, bare)
    return F.trim(F.regexp_replace(spelled, NOT_WORDS, " "))


def known_digests(spark: SparkSession, texts: dict[str, list[str]] | None = None, digests: dict[str, list[str]] | None = None) -> DataFrame:
    """digest and license_id of each known text; the lists are part of the library, so their size is fixed."""
    rows = [(name, text) for name, some in sorted((texts or TEXTS).items()) for text in some]
    listed = spark.createDataFrame(rows, "license_id string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id")
    held = spark.createDataFrame([(d, name) for name, some in sorted((DIGESTS if digests is None else digests).items()) for d in some], "digest string, license_id string")
    return listed.union(held).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, texts: dict[str, list[str]] | None = None, digests: dict[str, list[str]] | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """{doc}, unit and license_id: unit 0 for a document that is a known text as a whole, n for its nth line.

    Every line is brought to canonical form; a whole text's form is that of its lines, put together. Both are hashed,
    and the digests meet the known ones (of ``texts`` and ``digests``, by default the library's) in a hash join whose
    known side is small by construction. Nothing is shuffled. A null or empty text has no match; a null id stays
    null; repeated rows match each; an empty table gives no rows; other columns are not read.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), canonical)
    whole = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    units = docs.select(F.col(doc).alias(doc), F.posexplode(F.concat(F.array(whole), lines)).alias("unit", "part")).where("part <> ''")
    hashed = units.select(doc, "unit", F.sha2("part", 256).alias("digest"))
    return hashed.join(F.broadcast(known_digests(docs.sparkSession, texts, digests)), "digest").select(doc, "unit", "license_id")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_sql() -> str:
    """The same over a view named documents, for a check by another engine."""

    def canonical_sql(column: str) -> str:
        out = f"regexp_replace(lower({column}), {_sql_text(COPYRIGHT)}, '', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, {_sql_text(old)}, {_sql_text(new)})"
        return f"trim(regexp_replace({out}, {_sql_text(NOT_WORDS)}, ' ', 'g'))"

    rows = ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, some in sorted(TEXTS.items()) for text in some)
    digests = ", ".join(f"({_sql_text(d)}, {_sql_text(name)})" for name, some in sorted(DIGESTS.items()) for d in some)
    return f"""
    WITH known AS (SELECT digest, min(license_id) AS license_id FROM (
        SELECT sha256({canonical_sql("text")}) AS digest, license_id FROM (VALUES {rows}) AS t(license_id, text) UNION ALL SELECT * FROM (VALUES {digests}) AS d(digest, license_id)) GROUP BY 1),
    units AS (
        SELECT doc_id, 0 AS unit, coalesce(text, '') AS part FROM documents
        UNION ALL
        SELECT doc_id, unnest(range(1, len(lines) + 1)) AS unit, unnest(lines) AS part FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
    )
    SELECT doc_id, CAST(unit AS INTEGER) AS unit, license_id FROM (SELECT doc_id, unit, sha256({canonical_sql("part")}) AS digest FROM units) JOIN known USING (digest)
    """
