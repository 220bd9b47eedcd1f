"""Toxicity by compression distance: a window's length under a toxic and under an ordinary zstandard dictionary."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.shared import discard, written
from barline.llm.wordcodec import text_groups

#: Characters of a gram, counted over words with a space at both ends.
GRAM = 6
LETTERS = r"\p{L}+"
MEASURES = ["max double", "top double", "share double", "mean double", "windows double"]


def held_out(doc: Column) -> Column:
    """Rows that no label is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc.cast("string")) % 5 == 0, F.lit(False))


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of about ``size`` bytes; the samples themselves where there are too few to train one."""
    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


@lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zs.ZstdCompressor:
    """Compressor with a dictionary as plain content: no frame extras, and literals of one byte each in short windows."""
    held = zs.ZstdCompressionDict(dictionary or b"\n" * 8, dict_type=zs.DICT_TYPE_RAWCONTENT)
    how = zs.ZstdCompressionParameters(format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, strategy=zs.STRATEGY_GREEDY, min_match=4, hash_log=13, chain_log=13, search_log=3, window_log=15)
    held.precompute_compress(compression_params=how)
    return zs.ZstdCompressor(dict_data=held, compression_params=how)


@dataclass(frozen=True)
class Toxicity:
    """Two dictionaries and the weights that make a score of a document's windows.

    ``toxic`` stands before ``ordinary`` in the toxic compressor, so both know ordinary text alike and a window gains
    by toxic content alone. ``weights`` are the intercept and one weight for each of MEASURES; 0.5 is the threshold.
    """

    ordinary: bytes
    toxic: bytes
    window: int = 4
    least: int = 2
    weights: tuple[float, ...] = (-1e3, 0.0, 0.0, 0.0, 0.0, 0.0)

    def gains(self, text: str) -> np.ndarray:
        """Bytes that each window of the lower-cased text is shorter under the toxic dictionary.

        Windows are runs of ``window`` words. A fixed piece of the ordinary dictionary stands before each, so that
        even one short window is stored compressed and its length is fine-grained.
        """
        words = text.lower().encode().split()
        context, n = self.ordinary[-96:-32], self.window
        windows = [context + b" ".join([b"", *words[k : k + n], b""]) for k in range(0, len(words), n)]
        plain, toxic = _compressor(self.ordinary).compress, _compressor(self.toxic + self.ordinary).compress
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows], np.int64)

    def measures(self, text: str | None) -> tuple[float, ...]:
        """Greatest gain, mean of the highest thirtieth, share of windows that gain ``least``, mean, and log of the count."""
        g = self.gains(text or "")
        if not len(g):
            return (0.0,) * len(MEASURES)
        top = np.sort(g)[-max(1, len(g) // 30) :]
        return float(g.max()), float(top.mean()), float((g >= self.least).mean()), float(g.mean()), float(np.log1p(len(g)))

    def score(self, measures: np.ndarray) -> np.ndarray:
        z = self.weights[0] + measures @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _measured(docs: DataFrame, model: Toxicity, keep: list[str], types: str) -> DataFrame:
    """The columns ``keep`` and MEASURES of a table whose last column is the text; no shuffle, 2 MB of text at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, *(m.split()[0] for m in MEASURES)]
        for batch in text_groups(batches, len(keep)):
            found = np.array([model.measures(t) for t in batch.column(len(keep)).to_pylist()], np.float64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c) for c in found.T)], names)

    return docs.mapInArrow(run, ", ".join([types, *MEASURES]))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, doc: str, text: str, label: str) -> DataFrame:
    """doc, toxic, fitting, body of at most ``most`` documents for each class, for fitting and for calibration each.

    A document is toxic if one of its labels says so; of rows with one id the least text counts. Held-out ids, null
    labels and null ids are left out. Documents are drawn by a hash of the id.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull() & ~held_out(F.col(doc))).groupBy(F.col(doc).alias("doc")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    known = known.withColumn("fitting", F.crc32(F.col("doc").cast("string")) % 5 != 4)
    drawn = [known.where((F.col("toxic") == t) & (F.col("fitting") == F.lit(fitting))).orderBy(F.xxhash64("doc"), "doc").limit(most) for t in (0, 1) for fitting in (True, False)]
    few = drawn[0].union(drawn[1]).union(drawn[2]).union(drawn[3])  # 4 * most rows, whatever the tables hold
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(F.broadcast(few), "doc")
    return written(rows.groupBy("doc", "toxic", "fitting").agg(F.min("body").alias("body")))


def telling_grams(sample: DataFrame, lift: float = 3.0, sure: float = 2.5, most: int = 2000) -> DataFrame:
    """word and n of words of toxic documents that hold a gram which toxic text has far more often than ordinary text.

    A word counts once for each word that it follows in its class, so copies of a document count once. ``lift`` is
    the least ratio of a gram's shares, ``sure`` the least difference in deviations; of grams the ``most`` surest.
    """
    words = F.regexp_extract_all(F.lower("body"), F.lit(LETTERS), F.lit(0))
    pairs = sample.where("fitting").select("toxic", words.alias("w")).select("toxic", F.explode(F.array_distinct(F.arrays_zip(F.col("w").alias("word"), F.concat(F.array(F.lit("")), F.col("w")).alias("before")))).alias("p")).select("toxic", "p.*").where("word IS NOT NULL").distinct()
    counts = written(pairs.groupBy("toxic", "word").agg(F.count("*").alias("n")))
    spaced = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(spaced) - GRAM + 1)), lambda k: F.substring(spaced, k, F.lit(GRAM))))
    by_gram = counts.select("toxic", "n", "word", F.explode(grams).alias("gram"))
    summed = by_gram.groupBy("gram").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    totals = counts.agg((F.sum(F.when(F.col("toxic") == 1, F.col("n"))) / F.sum(F.when(F.col("toxic") == 0, F.col("n")))).alias("ratio"))  # one row
    even = F.col("b") * F.col("ratio")
    rated = summed.join(F.broadcast(totals)).withColumn("z", (F.col("a") - even) / F.sqrt(F.col("a") + even + 1)).where((F.col("z") >= sure) & (F.col("a") >= lift * (even + 0.5)))
    best = rated.orderBy(F.col("z").desc(), "gram").limit(most).select("gram")
    return by_gram.where("toxic = 1").join(F.broadcast(best), "gram").groupBy("word").agg(F.max("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(2 * most)


def fit(docs: DataFrame, labels: DataFrame, most: int = 2000, dictionary_docs: int = 600, ordinary_bytes: int = 8000, toxic_bytes: int = 2000, window: int = 4, doc: str = "doc_id", text: str = "text", label: str = "toxic") -> Toxicity:
    """Dictionaries and weights from a bounded sample of labelled documents: ``most`` for each class and purpose.

    The ordinary dictionary is trained on windows of ``dictionary_docs`` ordinary documents, the toxic one on the
    words of toxic documents whose grams ordinary ones lack (telling_grams). Weights of MEASURES come from a logistic
    regression on documents that the dictionaries have not seen, weighed to the classes' true shares; the threshold
    of best F1 there becomes the score 0.5. Without labels of both classes every score is near 0.
    """
    sample = labelled_sample(docs, labels, most, doc, text, label)
    rng = random.Random(0)
    told = [(" " + r["word"] + " ").encode() for r in telling_grams(sample).collect() for _ in range(min(r["n"], 1000))]
    plain = [r["body"].lower().encode().split() for r in sample.where("fitting AND toxic = 0").orderBy(F.xxhash64("doc"), "doc").select("body").limit(dictionary_docs).collect()]
    runs = [b" ".join([b"", *ws[k : k + 6], b""]) for ws in plain for k in range(0, len(ws), 6)]
    rng.shuffle(told)
    rng.shuffle(runs)
    model = Toxicity(trained(runs[:150_000], ordinary_bytes), trained([b"".join(told[k : k + 4]) for k in range(0, len(told), 4)], toxic_bytes), window)
    seen = _measured(sample.where("NOT fitting").select("toxic", "body"), model, ["toxic"], "toxic int").toPandas()
    shares = {r["t"]: r["count"] for r in labels.where(F.col(label).isNotNull() & ~held_out(F.col(doc))).groupBy((F.col(label) > 0).cast("int").alias("t")).count().collect()}
    discard(sample)
    y, x = seen["toxic"].to_numpy(float), seen.drop(columns="toxic").to_numpy(float)
    if y.all() or not y.any():
        return model
    weight = np.where(y > 0, shares[1] / y.sum(), shares[0] / (1 - y).sum())
    return Toxicity(model.ordinary, model.toxic, window, model.least, calibrated(x, y, weight / weight.mean()))


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of a logistic regression (Newton steps), moved so that the threshold of best F1 is a score of 0.5."""
    mean, wide = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.column_stack([np.ones(len(x)), (x - mean) / wide])
    penalty, b = np.diag([1e-6, *[ridge] * x.shape[1]]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + penalty, design.T @ (weight * (y - p)) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    z = design @ b
    order = np.argsort(-z, kind="stable")
    hit, miss = np.cumsum((weight * y)[order]), np.cumsum((weight * (1 - y))[order])
    f1 = 2 * hit / (hit + miss + (weight * y).sum())
    last = np.append(z[order][:-1] != z[order][1:], True)  # a threshold lies between different values
    k = int(np.argmax(np.where(last, f1, -1)))
    cut = (z[order][k] + z[order][k + 1]) / 2 if k + 1 < len(z) else z[order][k]
    scaled = b[1:] / wide
    return float(b[0] - (b[1:] * mean / wide).sum() - cut), *map(float, scaled)


def toxicity(docs: DataFrame, model: Toxicity, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """{doc}, held_out, score (0 to 1) and predicted (1 from a score of 0.5) of every whole text.

    Only the text makes a score. A null or empty text has no windows and the score of a text without a sign; a null id
    stays null and is not held out; repeated rows are scored each; an empty table gives no rows; other columns are
    not read. Nothing is shuffled.
    """
    found = _measured(docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("body")), model, ["doc"], "doc long")
    z = sum((F.lit(w) * F.col(m.split()[0]) for w, m in zip(model.weights[1:], MEASURES, strict=True)), F.lit(model.weights[0]))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return found.select(F.col("doc").alias(doc), held_out(F.col("doc")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
