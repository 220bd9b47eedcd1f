"""Secret scans: candidates by pattern, false positives removed by a random forest turned into expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.secret_findings import WORDS, findings as labelled_findings
from barline.llm.shared import fresh, named

if TYPE_CHECKING:
    from pyspark.ml.classification import RandomForestClassificationModel

#: Names that secrets are assigned to, each ending a longer name or standing alone.
NAMES = "passw(?:or)?d|secret|token|api_?key|access_?key|secret_?key|credential"
#: A candidate is a whole run of 12 or more of these characters with a digit in it, or 8 or more characters up to
#: white space, quotes or a bracket that are assigned to such a name.
RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{12,}"
ASSIGNED = r"(?<=[=:\"' \t])(?<=[=:\"']|[=:][ \t]{1,2})(?<=(?i:" + NAMES + r")s?[\"']?[ \t]{0,2}[=:]{1,2}[ \t]{0,2}[\"']?)[^\s\"'(){}<>\[\],;=:]{8,}"
CANDIDATE = f"{RUN}|{ASSIGNED}"
#: Words that mark a value as no secret: whole words, also between digits and signs, but not letters.
HARMLESS = r"(?i)((?<![a-z])(example|sample|dummy|test|changeme)s?(?![a-z])|xxxx|0000000)"
#: The name that a value is assigned to; what belongs to an e-mail, a host or a path is none.
ASSIGNED_NAME = r"(?<![A-Za-z0-9_.@/\-])([A-Za-z0-9_\-]*)[\"']?[ \t]*[=:]+[ \t]*[\"']?$"
FEATURES = ["length", "digits", "upper", "lower", "signs", "transitions", "coverage", "hex_only", "assigned", "telling_word", "quoted", "harmless", "path_harmless"]
REDACTED = "[SECRET]"


def harmless(c: Column) -> Column:
    """Whether a harmless word stands in the value or in the name that it is assigned to.

    E-mails, hosts and other words before the assignment do not count.
    """
    name = F.regexp_extract(c["before"], ASSIGNED_NAME, 1)
    return c["value"].rlike(HARMLESS) | name.rlike(HARMLESS)


def candidates(text: Column, context: int = 40) -> Column:
    """Candidates of a text at all their places: array of struct(value, start, before, after).

    start counts characters from 1; before and after are up to ``context`` characters beside this place.
    """
    body = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0))
    # What stands before each candidate; the part after the last one has a null value. Most texts have no candidate.
    pieces = F.when(F.size(found) > 0, F.split(body, CANDIDATE, -1)).otherwise(F.array().cast("array<string>"))
    gaps = F.zip_with(found, pieces, lambda v, gap: F.struct(v.alias("value"), F.char_length(gap).alias("gap"), F.coalesce(F.char_length(v), F.lit(0)).alias("length")))
    none = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<value:string,start:int>>").alias("out"))

    def placed(held: Column, x: Column) -> Column:
        start = held["next"] + x["gap"]
        return F.struct((start + x["length"]).alias("next"), F.concat(held["out"], F.array(F.struct(x["value"].alias("value"), start.alias("start")))).alias("out"))

    def described(c: Column) -> Column:
        value, start = c["value"], c["start"]
        begin = F.greatest(start - context, F.lit(1))
        return F.struct(value.alias("value"), start.alias("start"), F.substring(body, begin, start - begin).alias("before"), F.substring(body, start + F.char_length(value), F.lit(context)).alias("after"))

    places = F.aggregate(gaps, none, placed, lambda held: held["out"])
    return F.transform(F.filter(places, lambda c: c["value"].isNotNull()), described)


def features(c: Column, path: Column, dictionary: list[str]) -> list[Column]:
    """FEATURES of a candidate, all double.

    coverage: the share of its characters in words of the dictionary; path: where the document comes from.
    """
    value, count = c["value"], lambda pattern: F.regexp_count(c["value"], F.lit(pattern)).cast("double")
    words = "|".join(sorted(dictionary, key=lambda w: (-len(w), w))) or "(?!)"
    length = F.char_length(value).cast("double")
    changes = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    uncovered = F.char_length(F.regexp_replace(F.lower(value), f"({words})", "")).cast("double")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return [
        length,
        count("[0-9]") / length,
        count("[A-Z]") / length,
        count("[a-z]") / length,
        count(r"[+/_\-]") / length,
        count(changes) / length,
        1 - uncovered / length,
        flag(value.rlike("^[0-9a-f]+$")),
        flag(c["before"].rlike(r"[=:][ \t]*[\"']?$")),
        flag(c["before"].rlike(r"(?i)(passw|secret|token|key|credential|auth)")),
        flag(c["before"].rlike("[\"']$") & c["after"].rlike("^[\"']")),
        flag(harmless(c)),
        flag(path.rlike(r"(?i)(^|[/_.-])(tests?|examples?|docs?|samples?)([/_.-]|$)")),
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as nested tuples (feature, threshold, left, right) or a leaf's share of secrets, and the dictionary."""

    trees: list
    dictionary: list[str]

    def score(self, values: list[Column]) -> Column:
        """The mean over the trees of the share of secrets in the leaf that a candidate falls in."""

        def tree(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, left, right = node
            return F.when(values[feature] <= threshold, tree(left)).otherwise(tree(right))

        return sum((tree(t) for t in self.trees[1:]), tree(self.trees[0])) / len(self.trees)


def feature_table(spark: SparkSession, rows: list[tuple], words: list[str] = WORDS) -> DataFrame:
    """label and FEATURES of labelled findings (value, before, after, path, live)."""
    listed = spark.createDataFrame(rows, "value string, before string, after string, path string, live boolean")
    described = listed.select(F.struct("value", "before", "after").alias("c"), "path", F.col("live").cast("double").alias("label"))
    return described.select("label", *(f.alias(n) for n, f in zip(FEATURES, features(F.col("c"), F.col("path"), words), strict=True)))


def fit_model(table: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel:
    """A random forest over the columns FEATURES and label (1 for a live secret)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(table.coalesce(1)).persist()
    try:
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="vector").fit(vectors)
    finally:
        vectors.unpersist()


def as_forest(model: RandomForestClassificationModel, words: list[str] = WORDS) -> Forest:
    """A fitted forest as plain tuples, so that it is scored by expressions."""

    def nested(node):
        if node.getClass().getSimpleName() == "LeafNode":
            counts = list(node.impurityStats().stats())
            return counts[1] / sum(counts)
        return node.split().featureIndex(), float(node.split().threshold()), nested(node.leftChild()), nested(node.rightChild())

    return Forest([nested(t._java_obj.rootNode()) for t in model.trees], list(words))


@cache
def trained_forest(spark: SparkSession, count: int = 1200, seed: int = 0) -> Forest:
    """The forest from the library's own labelled findings, ``count`` of them: a bound that no table changes.

    It sees lengths, transitions, coverage by the dictionary's words, path and neighbouring words only. It is the
    same for every table, so that a text's verdict depends on the text and its path alone.
    """
    return as_forest(fit_model(feature_table(spark, labelled_findings(count, seed))))


def scored(text: Column, path: Column, forest: Forest) -> Column:
    """All candidates of a text with score and secret (a score of half or more): no row leaves its place."""
    held = lambda c: [c["value"].alias("value"), c["start"].alias("start")]
    measured = F.transform(candidates(text), lambda c: F.struct(*held(c), F.array(*features(c, path, forest.dictionary)).alias("f")))
    judged = F.transform(measured, lambda c: F.struct(*held(c), forest.score([c["f"][i] for i in range(len(FEATURES))]).alias("score")))
    return F.transform(judged, lambda c: F.struct(*held(c), c["score"].alias("score"), (c["score"] >= 0.5).alias("secret")))


def secret_scan(docs: DataFrame, forest: Forest | None = None, doc: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """{doc}, start, value, score and secret for each place of each candidate of each whole text.

    A null or empty text has no candidates, a null path counts as harmless in nothing, a null id stays null.
    Repeated rows are scanned each; an empty table gives no rows; other columns are not read. Nothing is shuffled.
    ``forest`` is trained_forest() if not given.
    """
    out = docs.select(F.col(doc).alias(doc), F.explode(scored(F.col(text), F.col(path).cast("string"), forest or trained_forest(docs.sparkSession))).alias("c"))
    return out.select(doc, "c.start", "c.value", "c.score", "c.secret")


def redact(docs: DataFrame, forest: Forest | None = None, text: str = "text", path: str = "source") -> DataFrame:
    """docs with every occurrence of each secret found in a text replaced by [SECRET]; other columns as they are.

    Secrets leave in no column, whatever names docs has. A value is replaced at all its places if it is a secret at one of them. A null text stays null, repeated rows
    stay each, an empty table stays empty.
    """
    secret = F.filter(scored(F.col(text), F.col(path).cast("string"), forest or trained_forest(docs.sparkSession)), lambda c: c["secret"])
    # Longest first, so that no secret is cut by one that it contains.
    values = F.transform(F.sort_array(F.array_distinct(F.transform(secret, lambda c: F.struct(F.char_length(c["value"]).alias("n"), c["value"].alias("value")))), asc=False), lambda c: c["value"])
    (hidden,) = fresh(docs.columns, "found")  # a column that docs does not have, and that does not leave here
    held = docs.withColumn(hidden, values)
    clean = F.when(F.size(hidden) > 0, F.aggregate(hidden, named(text), lambda t, v: F.replace(t, v, F.lit(REDACTED)))).otherwise(named(text))
    return held.select(*(clean.alias(c) if c == text else named(c) for c in docs.columns))
