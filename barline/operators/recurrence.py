"""Exponential smoothing as a scan over blocks of rows that are dealt apart.

Over the rows with a value, smoothing without adjustment is y = a * y_before + b: after a gap of k rows
a = d / (d + alpha) and b = alpha * x / (d + alpha) with d = (1 - alpha) ** k; the first value of all is y itself.
So within a block y = A * first + S, where first is y at the block's first value and A, S come from running sums.
Only what blocks end with (A, S, counts and gaps) is gathered, one row a block, and folded in order of time; that
gives each block the y before it and its first y.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from barline.operators.blocks import deal, gather
from barline.sources.scratch import written

#: The decay over which sums run at once, as a natural logarithm; with one gap's clamp it stays in double range.
SPAN = 300.0


@dataclass(frozen=True)
class Smoothing:
    """out: mean of ``value`` smoothed by ``alpha``, null until ``least`` values were seen."""

    value: str
    alpha: float
    out: str
    least: int


def decay(alpha: float, k: np.ndarray | int) -> np.ndarray | float:
    return np.maximum((1 - alpha) ** np.asarray(k, float), 1e-100)


def chained(x: np.ndarray, at: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """A and S of the values ``x`` at rows ``at``: y = A * first + S."""
    d = decay(alpha, np.diff(at))
    b, spent = alpha * x[1:] / (d + alpha), np.cumsum(-np.log(d / (d + alpha)))
    A, S = np.ones(len(x)), np.zeros(len(x))
    edges = np.append(np.flatnonzero(np.diff(np.floor(spent / SPAN), prepend=-1)), len(spent))
    for start, stop in zip(edges[:-1], edges[1:], strict=True):
        p = np.exp((spent[start - 1] if start else 0.0) - spent[start:stop])
        A[start + 1 : stop + 1] = p * A[start]
        S[start + 1 : stop + 1] = p * (S[start] + np.cumsum(b[start:stop] / p))
    return A, S


def smooth(df: DataFrame, specs: list[Smoothing], key: str = "asset", order: str = "date", rows: int | None = None, bucket: Column | None = None, dealt: bool = False) -> DataFrame:
    """Adds all of ``specs`` in one pass over blocks of up to ``rows`` rows.

    A missing value decays the weight of what came before and shows the last result, as a series' own smoothing does.
    dealt: df comes from deal(), perhaps with columns added by windows over its key, and so does the result, without
    the rows that stood beside blocks; it may then be passed on. Block results are written once, since both their
    ends and their rows are needed.
    """
    if not dealt:
        return gather(smooth(deal(df, 0, 0, rows, key, order, bucket), specs, key, order, dealt=True), key).select(*df.columns, *(s.out for s in specs))
    values = list(dict.fromkeys(s.value for s in specs))
    own = df.where("__own")
    extra = [StructField(f"__{n}{i}", DoubleType()) for i in range(len(specs)) for n in "AS"] + [StructField(f"__n{j}", LongType()) for j in range(len(values))] + [StructField("__end", ArrayType(DoubleType()))]
    schema = StructType([*own.schema.fields, *extra])
    arrow = [pa.float64()] * (2 * len(specs)) + [pa.int64()] * len(values) + [pa.list_(pa.float64())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One block: its rows with A and S of each series, values seen so far, and on the last row what it ends with."""
        block = pa.concat_batches(list(batches))
        m, found, counts, end = len(block), [], [], [float(len(block))]
        known = {}
        for v in values:
            x = block[v].cast(pa.float64()).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(~np.isnan(x))
            seen = np.searchsorted(at, np.arange(m), "right")
            known[v] = x[at], at, seen
            counts.append(seen)
            end += [len(at), x[at[0]], at[0], m - 1 - at[-1]] if len(at) else [0, 0, 0, 0]
        for s in specs:
            x, at, seen = known[s.value]
            A, S = (chained(x, at, s.alpha)) if len(at) else (np.ones(1), np.zeros(1))
            hidden, place = seen == 0, np.maximum(seen - 1, 0)
            found += [pa.array(A[place], pa.float64(), mask=hidden), pa.array(S[place], pa.float64(), mask=hidden)]
            end += [A[-1], S[-1]]
        ends = pa.array([None] * (m - 1) + [end], arrow[-1])
        yield pa.RecordBatch.from_arrays([*block.columns, *found, *(pa.array(c, pa.int64()) for c in counts), ends], [*block.schema.names, *(f.name for f in extra)])

    scanned = written(own.groupBy(key).applyInArrow(scan, schema))
    ends = scanned.where("__end IS NOT NULL").select(F.col(key)["of"].alias("__k"), F.col(key)["block"].alias("__b"), "__end")

    def fold(table: pd.DataFrame) -> pd.DataFrame:
        """What each block of a key starts with: y before it, its first y, and values seen before it."""
        table = table.sort_values("__b")
        seen, gap, y, out = [0] * len(values), [0.0] * len(values), [None] * len(specs), []
        for end in table["__end"]:
            m, told, tails = end[0], np.reshape(end[1 : 1 + 4 * len(values)], (-1, 4)), np.reshape(end[1 + 4 * len(values) :], (-1, 2))
            held, first = list(y), [None] * len(specs)
            for i, s in enumerate(specs):
                j = values.index(s.value)
                n, x, lead, _ = told[j]
                if n:
                    d = decay(s.alpha, gap[j] + lead + 1)
                    first[i] = x if y[i] is None else (d * y[i] + s.alpha * x) / (d + s.alpha)
                    y[i] = tails[i][0] * first[i] + tails[i][1]
            out.append((held, first, list(seen)))
            for j, (n, _, _, tail) in enumerate(told):
                seen[j], gap[j] = seen[j] + int(n), tail if n else gap[j] + m
        return pd.DataFrame({"__k": table["__k"].to_numpy(), "__b": table["__b"].to_numpy(), "__held": [o[0] for o in out], "__first": [o[1] for o in out], "__seen": [o[2] for o in out]})

    kind = df.schema[key].dataType["of"].dataType.simpleString()
    starts = ends.groupBy("__k").applyInPandas(fold, f"__k {kind}, __b long, __held array<double>, __first array<double>, __seen array<long>")
    met = scanned.join(starts, F.col(key)["of"].eqNullSafe(F.col("__k")) & (F.col(key)["block"] == F.col("__b")))
    results = {}
    for i, s in enumerate(specs):
        j = values.index(s.value)
        y = F.when(F.col(f"__A{i}").isNull(), F.col("__held")[i]).otherwise(F.col(f"__A{i}") * F.col("__first")[i] + F.col(f"__S{i}"))
        results[s.out] = F.when(F.col("__seen")[j] + F.col(f"__n{j}") >= s.least, y)
    return met.select(*df.columns, *(v.alias(k) for k, v in results.items()))


def again(df: DataFrame, key: str = "asset", order: str = "date") -> DataFrame:
    """A smoothed table in the shape that smooth() takes: dealt by block and sorted."""
    return df.repartition(key).sortWithinPartitions(key, order)
