"""The clean panel: prices, features, indicators, next open and the cash asset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions import columns as C
from barline.operators import blocks, cash, checks, features, indicators, normalize

# The column names of the clean panel.
RAW = ["open", "high", "low", "close", "adj_close", "volume", "dividends", "stock_splits"]
CORE = ["daily_return_log", "average_dollar_volume_20", "volatility_becker_parkinson", "bid_ask_spread_corwin_schultz"]
TECHNICAL = [
    "simple_moving_average_20", "simple_moving_average_60", "exponential_moving_average_12", "exponential_moving_average_26", "relative_strength_index_14", "macd_line_12_26_9", "macd_signal_12_26_9", "macd_histogram_12_26_9",
    "bollinger_middle_band_20_2_0", "bollinger_upper_band_20_2_0", "bollinger_lower_band_20_2_0", "bollinger_bandwidth_20_2_0", "commodity_channel_index_20", "average_directional_index_14", "positive_directional_index_14", "negative_directional_index_14",
]
COLUMNS = ["date", "asset", *RAW, *CORE, *TECHNICAL, "execution_price_t_plus_1_open", "is_cash"]


def clean_panel(prices: DataFrame, rates: DataFrame, symbol: str = "CASH", sample: int = 1, checked: bool = True, order: str | None = None, rows: int | None = None) -> DataFrame:
    """All columns of the clean panel for prices (date, asset, ...) and rates (date, risk_free_annual).

    Rows of one (date, asset) count each in the windows, in the order of the column ``order``, and the last of them
    stays; by default the order of a hash of their values, which does not depend on how rows are dealt (tables.load_ordered()
    gives the order of files). An asset is dealt in blocks of ``rows`` rows; its windows see the rows beside a block.
    checked probes for an asset named like cash, which is an error.
    """
    checks.require_columns(prices, ["date", "asset"])
    if checked:
        checks.require_no_asset(prices, symbol)
    # Windows order by date; while they are made, a date also holds its row's place among equals.
    place = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(prices.columns))) if order is None else F.col(order)
    full = normalize.with_defaults(prices.withColumn("date", F.struct(F.col("date").alias("day"), place.alias("place"))))
    kept = full.select("date", "asset", *RAW)
    dealt = blocks.deal(kept, max(indicators.LOOK_BACK, sample + 1), 1, rows, bucket=F.year("date.day"))
    out = features.next_open(features.spread_estimates(features.dollar_volume(features.log_return(dealt)), sample))
    made = indicators.all_indicators(out.withColumn("__ahead", F.lead("date.day", 1).over(C.by_time())))
    last = blocks.gather(made).where(F.col("__ahead").isNull() | (F.col("__ahead") != F.col("date.day")))
    panel = last.withColumns({"date": F.col("date.day"), "is_cash": F.lit(0)}).select(*COLUMNS)
    days = prices.select("date").distinct().join(rates.select("date", "risk_free_annual"), "date", "left")
    return normalize.downcast(panel.unionByName(cash.cash_rows(days, COLUMNS, symbol)))


def export_names(panel: DataFrame) -> DataFrame:
    """Band columns under their outside names, which hold a dot."""
    return panel.toDF(*(c.replace("_2_0", "_2.0") if c.startswith("bollinger_") else c for c in panel.columns))
