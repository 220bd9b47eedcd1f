"""Signals, score weights, fixed-weight portfolios and weight grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import columns as C
from barline.operators import kpis
from barline.operators.indicators import sma

SCORES = ("sharpe", "sortino", "calmar")


def crossover(panel: DataFrame, fast: int = 50, slow: int = 200, price: str = "close") -> DataFrame:
    """Adds signal: 1 where the fast mean is over the slow one, else 0, also before there are enough rows."""
    value = F.col(price)
    return panel.withColumn("signal", F.coalesce(sma(value, fast) > sma(value, slow), F.lit(False)).cast("int"))


def score_weights(returns: DataFrame, method: str = "sharpe", cap: float = 1.0, r: str = "r") -> DataFrame:
    """asset and weight by a score: floored at 0, scaled to 1, capped, and scaled once more."""
    if method not in SCORES:
        raise ValueError(f"unknown method {method!r}")
    scores = kpis.report(returns, r=r).select("asset", F.coalesce(C.floored(F.col(method)), F.lit(0.0)).alias("score"))
    every = Window.partitionBy()  # one row an asset
    raw = scores.withColumn("raw", F.coalesce(C.ratio(F.col("score"), F.sum("score").over(every)), F.lit(0.0)))
    capped = raw.withColumn("capped", F.least("raw", F.lit(cap)))
    total = F.sum("capped").over(every)
    return capped.select("asset", F.when(total > 0, F.col("capped") / total).otherwise(F.col("raw")).alias("weight"))


def signal_returns(signals: DataFrame, r: str = "r") -> DataFrame:
    """date and r: the sum over assets of the signal before times the return; missing counts as 0."""
    lagged = signals.withColumn("__before", F.lag("signal", 1).over(C.by_time()))
    return lagged.groupBy("date").agg(F.coalesce(F.sum(F.col("__before") * F.col(r)), F.lit(0.0)).alias("r"))


def weighted_returns(returns: DataFrame, weights: DataFrame, r: str = "r") -> DataFrame:
    """portfolio, date and r for weights (portfolio, asset, weight)."""
    return returns.join(weights, "asset").groupBy("portfolio", "date").agg(F.coalesce(F.sum(F.col("weight") * F.col(r)), F.lit(0.0)).alias("r"))


def wide(panel: DataFrame, assets: list[str] | None = None, value: str = "close", most: int = 10_000) -> DataFrame:
    """date and one column for each asset, by default all that the panel has, which may be ``most`` at most."""
    if assets is None:
        assets = [r["asset"] for r in panel.select("asset").distinct().orderBy("asset").limit(most + 1).collect()]
        if len(assets) > most:
            raise ValueError(f"more than {most} assets make no wide table")
    return panel.groupBy("date").pivot("asset", assets).agg(F.first(value, ignorenulls=True))


def moments(pairs: DataFrame) -> DataFrame:
    """One row of what any weight's score needs, from rows (r1, r2, m)."""
    r1, r2, m = F.col("r1"), F.col("r2"), F.col("m")
    named = {"e1": F.avg(r1), "e2": F.avg(r2), "em": F.avg(m), "v1": F.var_samp(r1), "v2": F.var_samp(r2), "vm": F.var_samp(m), "c12": F.covar_samp(r1, r2), "c1m": F.covar_samp(r1, m), "c2m": F.covar_samp(r2, m)}
    return pairs.where(r1.isNotNull() & r2.isNotNull() & m.isNotNull()).agg(*(v.alias(k) for k, v in named.items()))


def weight_grid(moment_row: DataFrame, steps: int = 100) -> DataFrame:
    """w (share of the first asset) from 0 to 1 with mean, variance and market covariance of the mix."""
    grid = moment_row.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("w", F.col("k") / steps)
    w, u = F.col("w"), 1 - F.col("w")
    return grid.withColumns({"mean": w * F.col("e1") + u * F.col("e2"), "variance": w * w * F.col("v1") + u * u * F.col("v2") + 2 * w * u * F.col("c12"), "cov_m": w * F.col("c1m") + u * F.col("c2m")})


def grid_scores(grid: DataFrame, rate: float | Column = 0.0) -> DataFrame:
    """Adds the score that each optimizer maximizes."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    beta = C.ratio(F.col("cov_m"), F.col("vm"))
    return grid.withColumns(
        {
            "treynor": C.ratio(F.col("mean") * kpis.YEAR - rate, beta),
            "jensen": F.col("mean") * kpis.YEAR - (rate + beta * (F.col("em") * kpis.YEAR - rate)),
            "low_beta": -F.abs(beta),
            "low_correlation": -F.abs(C.ratio(F.col("cov_m"), F.sqrt(F.col("variance") * F.col("vm")))),
            "sharpe": C.ratio(F.col("mean") * kpis.YEAR - rate, F.sqrt(F.col("variance") * kpis.YEAR)),
        }
    )


def best_weight(scored: DataFrame, score: str) -> DataFrame:
    """The row w, score of the greatest score, the least w of equal ones."""
    best = F.max(F.when(F.col(score).isNotNull(), F.struct(F.col(score).alias("score"), (-F.col("w")).alias("v"))))
    return scored.agg(best.alias("b")).select((-F.col("b.v")).alias("w"), F.col("b.score").alias("score"))


def covariances(returns: DataFrame, r: str = "r", block: Column | None = None) -> DataFrame:
    """The covariance of every two assets (a <= b) in long form, over the dates on which both have a return.

    A Gram matrix: each block of dates (a month by default) becomes one matrix of dates by assets, whose products
    give counts, sums and sums of products of all pairs at once; these are added up by pair. Nothing is joined. A block
    holds dates times assets, and its result assets squared, which is what the result has.
    """
    kind = returns.schema["asset"].dataType.simpleString()
    rows = returns.select("date", "asset", F.col(r).cast("double").alias("r")).where("r IS NOT NULL AND NOT isnan(r)").withColumn("block", F.trunc("date", "month") if block is None else block)

    def gram(table: pd.DataFrame) -> pd.DataFrame:
        at, assets = pd.factorize(table["asset"], sort=True)
        day = pd.factorize(table["date"])[0]
        x, n = np.zeros((day.max() + 1, len(assets))), np.zeros((day.max() + 1, len(assets)))
        x[day, at], n[day, at] = table["r"], 1
        i, j = np.triu_indices(len(assets))
        # Moments about 0 of returns, which are small; both sums are over common dates.
        each = [m[i, j] for m in (n.T @ n, x.T @ n, n.T @ x, x.T @ x)]
        return pd.DataFrame({"a": assets[i], "b": assets[j], "n": each[0].astype("int64"), "sx": each[1], "sy": each[2], "sxy": each[3]})

    parts = rows.groupBy("block").applyInPandas(gram, f"a {kind}, b {kind}, n long, sx double, sy double, sxy double").where("n > 0")
    sums = parts.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")))
    return sums.select("a", "b", F.when(F.col("n") > 1, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)).alias("cov"), "n")
