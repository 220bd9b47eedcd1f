"""Returns, liquidity, spread and volatility estimates, and rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import columns as C

_K = 3 - 2 * math.sqrt(2)


def log_return(panel: DataFrame, price: str = "close", out: str = "daily_return_log", key: str = "asset") -> DataFrame:
    return panel.withColumn(out, C.log_return(F.col(price), key))


def linear_return(panel: DataFrame, price: str = "close", out: str = "return_linear", key: str = "asset") -> DataFrame:
    """p / previous p - 1, where a missing price counts as the one before it."""
    filled = panel.withColumn("__filled", C.forward_fill(F.col(price), key))
    return filled.withColumn(out, C.ratio(F.col("__filled"), F.lag("__filled", 1).over(C.by_time(key))) - 1).drop("__filled")


def dollar_volume(panel: DataFrame, n: int = 20, out: str | None = None) -> DataFrame:
    value = F.col("close") * F.col("volume")
    return panel.withColumn(out or f"average_dollar_volume_{n}", C.rolling(F.avg(value), value, n))


def spread_terms(panel: DataFrame, sample: int = 1) -> DataFrame:
    """Adds spread_beta (two-day squared log ranges) and spread_gamma (squared log range of two days)."""
    out = panel.withColumn("__range", F.pow(C.log_of(C.ratio(F.col("high"), F.col("low"))), 2))
    out = out.withColumn("spread_beta", C.rolling(F.sum("__range"), F.col("__range"), 2))
    if sample > 1:
        out = out.withColumn("spread_beta", C.rolling(F.avg("spread_beta"), F.col("spread_beta"), sample))
    top, bottom = C.rolling(F.max("high"), F.col("high"), 2), C.rolling(F.min("low"), F.col("low"), 2)
    return out.withColumns({"__top": top, "__bottom": bottom}).withColumn("spread_gamma", F.pow(C.log_of(C.ratio(F.col("__top"), F.col("__bottom"))), 2)).drop("__range", "__top", "__bottom")


def spread_alpha(beta: Column, gamma: Column) -> Column:
    return C.floored((math.sqrt(2) - 1) / _K * F.sqrt(beta) - F.sqrt(gamma / _K))


def spread_of(alpha: Column) -> Column:
    return 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))


def range_volatility(beta: Column, gamma: Column) -> Column:
    k = math.sqrt(8 / math.pi)
    return C.floored((2**-0.5 - 1) * F.sqrt(beta) / (k * _K) + F.sqrt(gamma / (k * k * _K)))


def spread_estimates(panel: DataFrame, sample: int = 1) -> DataFrame:
    """Adds volatility_becker_parkinson and bid_ask_spread_corwin_schultz."""
    terms = spread_terms(panel, sample)
    beta, gamma = F.col("spread_beta"), F.col("spread_gamma")
    return terms.withColumns({"volatility_becker_parkinson": range_volatility(beta, gamma), "bid_ask_spread_corwin_schultz": spread_of(spread_alpha(beta, gamma))}).drop("spread_beta", "spread_gamma")


def next_open(panel: DataFrame, out: str = "execution_price_t_plus_1_open") -> DataFrame:
    return panel.withColumn(out, F.lead("open", 1).over(C.by_time()))


def daily_rate(percent: Column, basis: int = 360) -> Column:
    return percent / 100 / basis


def daily_factor(percent: Column, basis: int = 360) -> Column:
    return 1 + daily_rate(percent, basis)
