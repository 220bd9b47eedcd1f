"""Portfolio metrics of log returns, one row for each portfolio. Rows with a missing return are dropped first."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import columns as C
from barline.operators.blocks import time_block

YEAR = 252


def annual_return(r: Column) -> Column:
    return F.avg(r) * YEAR


def annual_volatility(r: Column) -> Column:
    return F.stddev_samp(r) * YEAR**0.5


def sharpe(r: Column, rate: float = 0.0) -> Column:
    return C.ratio(F.avg(r - rate / YEAR), F.stddev_samp(r)) * YEAR**0.5


def sharpe_excess(excess: Column) -> Column:
    """Of excess returns over a daily rate, by their own deviation."""
    return C.ratio(F.avg(excess), F.stddev_samp(excess)) * YEAR**0.5


def sortino(r: Column, rate: float = 0.0) -> Column:
    excess = r - rate / YEAR
    down = F.stddev_samp(F.when(excess < 0, excess))
    return F.when(down > 0, F.avg(excess) / down) * YEAR**0.5


def beta(r: Column, market: Column) -> Column:
    return C.ratio(F.covar_samp(r, market), F.var_samp(market))


def jensen_alpha(r: Column, market: Column, rate: float = 0.0) -> Column:
    return annual_return(r) - (rate + beta(r, market) * (annual_return(market) - rate))


def treynor(r: Column, market: Column, rate: float = 0.0) -> Column:
    return C.ratio(annual_return(r) - rate, beta(r, market))


def parametric_var(r: Column, confidence: float = 0.95) -> Column:
    """-(z * deviation - mean), z the normal quantile of 1 - confidence; the mean's sign is the reference one."""
    return -(NormalDist().inv_cdf(1 - confidence) * F.stddev_samp(r) - F.avg(r))


def kurtosis(r: Column) -> Column:
    return F.kurtosis(r) + 3


def growth(returns: DataFrame, r: str = "r", key: str = "asset", order: str = "date", block: Column | None = None, simple: bool = False) -> DataFrame:
    """Adds __block, __sum (the block's returns so far, as logarithms) and __top (its highest so far).

    A block of a portfolio is what one task sees, by default a year. simple: returns are not logarithms.
    """
    step = C.log_of(1 + F.col(r)) if simple else F.col(r)
    w = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = returns.withColumn("__block", time_block(order) if block is None else block).withColumn("__sum", F.sum(step).over(w))
    return inside.withColumn("__top", F.max("__sum").over(w))


def with_wealth(returns: DataFrame, r: str = "r", key: str = "asset", simple: bool = False, order: str = "date", block: Column | None = None) -> DataFrame:
    """Adds wealth: the exponential of summed log returns, or the product of 1 + simple returns.

    Sums run within blocks; a block's start is the sum of the totals before it, one row a block.
    """
    grown = growth(returns, r, key, order, block, simple)
    totals = grown.groupBy(F.col(key).alias("__k"), F.col("__block").alias("__b")).agg(F.sum(C.log_of(1 + F.col(r)) if simple else F.col(r)).alias("__total"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__k", "__b", F.sum("__total").over(before).alias("__start"))
    met = grown.join(starts, F.col(key).eqNullSafe(F.col("__k")) & F.col("__block").eqNullSafe(F.col("__b")))
    # Without any return so far there is no wealth; a block without one has that of the block before.
    both = F.when(F.col("__sum").isNotNull() | F.col("__start").isNotNull(), F.coalesce("__start", F.lit(0.0)) + F.coalesce("__sum", F.lit(0.0)))
    return met.select(*returns.columns, F.exp(both).alias("wealth"))


def with_drawdown(wealth: DataFrame, key: str = "asset", order: str = "date", block: Column | None = None) -> DataFrame:
    """Adds drawdown: wealth by its highest value so far, less 1; the first peak is the first observation.

    Peaks are those of the block so far and of the blocks before it, one row a block.
    """
    cut = wealth.withColumn("__block", time_block(order) if block is None else block)
    tops = cut.groupBy(F.col(key).alias("__k"), F.col("__block").alias("__b")).agg(F.max("wealth").alias("__high"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = tops.select("__k", "__b", F.max("__high").over(before).alias("__peak"))
    met = cut.join(starts, F.col(key).eqNullSafe(F.col("__k")) & F.col("__block").eqNullSafe(F.col("__b")))
    inside = F.max("wealth").over(Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("drawdown", F.col("wealth") / F.greatest("__peak", inside) - 1).select(*wealth.columns, "drawdown")


def max_drawdown(returns: DataFrame, r: str = "r", key: str = "asset", order: str = "date", block: Column | None = None) -> DataFrame:
    """The deepest fall of wealth from a peak, by portfolio.

    Each block gives the total, top, low and deepest fall of its running sum; a portfolio's are merged in order of
    time: a fall ends in the block that it began in, or leads from the highest top before a block to the block's low.
    """
    grown = growth(returns.where(F.col(r).isNotNull()), r, key, order, block)
    parts = grown.groupBy(key, "__block").agg(F.sum(r).alias("total"), F.max("__sum").alias("top"), F.min("__sum").alias("low"), F.min(F.col("__sum") - F.col("__top")).alias("fall"))
    listed = F.sort_array(F.collect_list(F.struct("__block", "total", "top", "low", "fall")))  # one of each block
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("total"), none.alias("top"), none.alias("fall"))

    def merged(a: Column, b: Column) -> Column:
        top, low = a["total"] + b["top"], a["total"] + b["low"]
        return F.struct((a["total"] + b["total"]).alias("total"), F.greatest(a["top"], top).alias("top"), F.least(a["fall"], b["fall"], low - a["top"]).alias("fall"))

    return parts.groupBy(key).agg(F.expm1(F.aggregate(listed, start, merged, lambda x: x["fall"])).alias("max_drawdown"))


def calmar(mean: Column, drawdown: Column) -> Column:
    return C.ratio(mean, F.abs(drawdown))


def report(returns: DataFrame, rate: float = 0.0, market: str | None = None, r: str = "r", key: str = "asset", confidence: float = 0.95, strict: bool = False, block: Column | None = None) -> DataFrame:
    """Nine metrics by portfolio, and Treynor and Jensen if a market column is given.

    One aggregate of moments, joined by portfolio to max_drawdown(), which works by time ``block``. strict gives nulls
    for a portfolio with a missing return.
    """
    x = F.col(r)
    metrics = {
        "annual_return": annual_return(x),
        "annual_volatility": annual_volatility(x),
        "sharpe": sharpe(x, rate),
        "sortino": sortino(x, rate),
        "var": parametric_var(x, confidence),
        "skewness": F.skewness(x),
        "kurtosis": kurtosis(x),
    }
    if market:
        metrics |= {"treynor": treynor(x, F.col(market), rate), "jensen_alpha": jensen_alpha(x, F.col(market), rate)}
    known = returns.where(x.isNotNull())
    falls = max_drawdown(known, r, key, block=block).withColumnRenamed(key, "__k")
    out = known.groupBy(key).agg(*(m.alias(n) for n, m in metrics.items())).join(falls, F.col(key).eqNullSafe(F.col("__k"))).drop("__k")
    out = out.withColumn("calmar", calmar(F.col("annual_return"), F.col("max_drawdown")))
    names = ["annual_return", "annual_volatility", "sharpe", "sortino", "max_drawdown", "calmar", *list(metrics)[4:]]
    out = out.select(key, *names)
    if not strict:
        return out
    gaps = returns.groupBy(key).agg(F.count_if(F.col(r).isNull()).alias("gaps"))
    joined = out.join(gaps, key)
    return joined.select(key, *(F.when(F.col("gaps") == 0, F.col(n)).alias(n) for n in names))
