"""Fills at the next open with half the spread, lots, fees and slippage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_spread_price(reference: Column, spread: Column, side: Column) -> Column:
    """Buys (side >= 0) pay half the spread, sells give it; a missing or negative spread is 0."""
    half = F.greatest(F.coalesce(spread, F.lit(0.0)), F.lit(0.0)) / 2
    return reference * F.when(side >= 0, 1 + half).otherwise(1 - half)


def round_lots(q: Column, lot: float = 1.0) -> Column:
    """Toward zero to whole lots; missing is 0."""
    q = F.coalesce(q, F.lit(0.0))
    return F.when(q >= 0, F.floor(q / lot)).otherwise(F.ceil(q / lot)).cast("double") * lot


def apply_execution(orders: DataFrame, prices: DataFrame, reference: str = "execution_price_t_plus_1_open", spread: str | None = "bid_ask_spread_corwin_schultz", fixed_bps: float | None = None, lot: float | None = None) -> DataFrame:
    """Orders (date, asset, delta_shares) joined to prices: q, p_ref, p_exec, notional_abs, spread_cost.

    The spread is a column (0 where the table has none), a fixed number of basis points, or none.
    """
    width = F.lit(0.0) if fixed_bps is None and (spread is None or spread not in prices.columns) else F.lit(fixed_bps / 1e4) if fixed_bps is not None else F.col(spread)
    q = round_lots(F.col("delta_shares"), lot) if lot else F.coalesce(F.col("delta_shares"), F.lit(0.0))
    out = orders.join(prices.select("date", "asset", F.col(reference).alias("p_ref"), width.alias("__spread")), ["date", "asset"], "left").withColumn("q", q)
    out = out.withColumn("p_exec", half_spread_price(F.col("p_ref"), F.col("__spread"), F.col("q")))
    return out.select("date", "asset", "q", "p_ref", "p_exec", F.abs(F.col("q") * F.col("p_exec")).alias("notional_abs"), F.abs(F.col("q") * (F.col("p_exec") - F.col("p_ref"))).alias("spread_cost"))


def apply_fees(trades: DataFrame, bps: float, sigma: DataFrame | None = None, k: float = 0.0) -> DataFrame:
    """Adds fees, vol_slip and total_cost. sigma: (date, asset, sigma_bps); missing ones count as 0."""
    out = trades.withColumn("fees", F.col("notional_abs") * bps / 1e4)
    if sigma is None:
        out = out.withColumn("vol_slip", F.lit(0.0))
    else:
        out = out.join(sigma.select("date", "asset", "sigma_bps"), ["date", "asset"], "left")
        out = out.withColumn("vol_slip", F.abs("q") * F.col("p_ref") * k * F.coalesce("sigma_bps", F.lit(0.0)) / 1e4).drop("sigma_bps")
    return out.withColumn("total_cost", F.col("spread_cost") + F.col("fees") + F.col("vol_slip"))
