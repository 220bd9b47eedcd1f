"""The synthetic cash asset that accrues the risk-free rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barline.functions import columns as C

def _all() -> WindowSpec:
    """All sessions in order: one row each, so one partition is enough."""
    return Window.partitionBy("one").orderBy("date")


def accrual(rates: DataFrame, basis: int = 360) -> DataFrame:
    """date, days_to_next, factor and log_factor from (date, risk_free_annual), one row a session.

    The last session has one day and factor 1; a missing rate is the one before it.
    """
    out = rates.withColumn("one", F.lit(1)).withColumn("risk_free_annual", C.forward_fill(F.col("risk_free_annual"), "one"))
    ahead = F.lead("date", 1).over(_all())
    out = out.withColumns({"days_to_next": F.coalesce(F.date_diff(ahead, "date"), F.lit(1)), "__last": ahead.isNull()})
    factor = F.when(F.col("__last"), 1.0).otherwise(1 + F.col("risk_free_annual") * F.col("days_to_next") / basis)
    return out.withColumn("factor", factor).withColumn("log_factor", C.log_of(F.col("factor"))).drop("__last")


def cash_close(accrued: DataFrame) -> DataFrame:
    """Adds close, the product of the factors so far: the close of a day holds the accrual up to the next one."""
    product = F.exp(F.sum("log_factor").over(_all().rowsBetween(Window.unboundedPreceding, 0)))
    return accrued.withColumn("close", F.when(F.col("factor").isNotNull(), product))


def cash_bars(accrued: DataFrame) -> DataFrame:
    """Adds open (the close before, 1 at first), high and low; null where open or close is."""
    out = cash_close(accrued).withColumn("open", F.coalesce(F.lag("close", 1).over(_all()), F.lit(1.0)))
    both = F.col("open").isNotNull() & F.col("close").isNotNull()
    return out.withColumns({"high": F.when(both, F.greatest("open", "close")), "low": F.when(both, F.least("open", "close"))})


def cash_rows(rates: DataFrame, columns: list[str], symbol: str = "CASH", basis: int = 360) -> DataFrame:
    """Cash in the clean panel's columns: zero volume and spread, no indicators."""
    made = cash_bars(accrual(rates, basis))
    known = {
        "date": F.col("date"), "asset": F.lit(symbol), "open": F.col("open"), "high": F.col("high"), "low": F.col("low"), "close": F.col("close"), "adj_close": F.col("close"),
        "volume": F.lit(0.0), "dividends": F.lit(0.0), "stock_splits": F.lit(1.0), "daily_return_log": F.col("log_factor"), "average_dollar_volume_20": F.lit(0.0), "volatility_becker_parkinson": F.lit(0.0),
        "bid_ask_spread_corwin_schultz": F.lit(0.0), "execution_price_t_plus_1_open": F.lead("open", 1).over(_all()), "is_cash": F.lit(1),
    }
    return made.select(*(known.get(c, F.lit(None).cast("double")).alias(c) for c in columns))
