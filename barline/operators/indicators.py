"""Technical indicators; each adds its columns to a panel of (asset, date) rows.

sma(), bollinger() and cci() are windows by asset, to be wrapped in blocks.in_blocks() where an asset is large; what
smooths (ema, rsi, macd, adx) deals blocks itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import columns as C
from barline.operators.blocks import deal, gather
from barline.operators.recurrence import Smoothing, again, smooth


def sma(value: Column, n: int, key: str = "asset") -> Column:
    return C.rolling(F.avg(value), value, n, key)


def ema_of(value: str, span: int, out: str) -> Smoothing:
    return Smoothing(value, 2 / (span + 1), out, span)


def wilder_of(value: str, period: int, out: str) -> Smoothing:
    return Smoothing(value, 1 / period, out, period)


def ema(panel: DataFrame, span: int, price: str = "close", out: str | None = None, rows: int | None = None) -> DataFrame:
    return smooth(panel, [ema_of(price, span, out or f"exponential_moving_average_{span}")], rows=rows)


def with_moves(panel: DataFrame) -> DataFrame:
    """Adds up and down moves of the close, true range, and directional moves of the range."""
    w = C.by_time()
    moved = panel.withColumns({"__d": F.col("close") - F.lag("close", 1).over(w), "__pc": F.lag("close", 1).over(w), "__hu": F.col("high") - F.lag("high", 1).over(w), "__ld": F.lag("low", 1).over(w) - F.col("low")})
    up, down, hu, ld = C.floored(F.col("__d")), C.floored(-F.col("__d")), F.col("__hu"), F.col("__ld")
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__pc")), F.abs(F.col("low") - F.col("__pc")))
    return moved.withColumns({"__up": up, "__down": down, "__tr": true_range, "__plus": F.when((hu > ld) & (hu > 0), hu).otherwise(0.0), "__minus": F.when((ld > hu) & (ld > 0), ld).otherwise(0.0)}).drop("__d", "__pc", "__hu", "__ld")


def rsi_specs(period: int) -> list[Smoothing]:
    return [wilder_of("__up", period, "__rup"), wilder_of("__down", period, "__rdown")]


def rsi_value() -> Column:
    return 100 - C.ratio(100.0, 1 + C.ratio(F.col("__rup"), F.col("__rdown")))


def adx_specs(period: int) -> list[Smoothing]:
    return [wilder_of("__tr", period, "__str"), wilder_of("__plus", period, "__splus"), wilder_of("__minus", period, "__sminus")]


def directional() -> dict[str, Column]:
    return {"__pdi": 100 * C.ratio(F.col("__splus"), F.col("__str")), "__mdi": 100 * C.ratio(F.col("__sminus"), F.col("__str"))}


def direction_index() -> Column:
    plus, minus = F.col("__pdi"), F.col("__mdi")
    return 100 * C.ratio(F.abs(plus - minus), plus + minus)


def _plain(out: DataFrame) -> DataFrame:
    """Without hidden columns; blocks are gathered."""
    out = gather(out) if "__own" in out.columns else out
    return out.select(*(f"`{c}`" for c in out.columns if not c.startswith("__")))


def rsi(panel: DataFrame, period: int = 14, rows: int | None = None) -> DataFrame:
    return _plain(smooth(with_moves(deal(panel, 1, rows=rows)), rsi_specs(period), dealt=True).withColumn(f"relative_strength_index_{period}", rsi_value()))


def macd(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close", rows: int | None = None) -> DataFrame:
    """Line, signal (which starts where the line does) and histogram."""
    tail = f"{fast}_{slow}_{signal}"
    lines = smooth(deal(panel, rows=rows), [ema_of(price, fast, "__fast"), ema_of(price, slow, "__slow")], dealt=True).withColumn(f"macd_line_{tail}", F.col("__fast") - F.col("__slow"))
    out = smooth(again(lines), [ema_of(f"macd_line_{tail}", signal, f"macd_signal_{tail}")], dealt=True)
    return _plain(out.withColumn(f"macd_histogram_{tail}", F.col(f"macd_line_{tail}") - F.col(f"macd_signal_{tail}")))


def _bollinger(panel: DataFrame, n: int, wide: float, price: str) -> DataFrame:
    value, tail = F.col(price), f"{n}_{str(wide).replace('.', '_')}"
    out = panel.withColumns({"__mid": sma(value, n), "__std": C.rolling(F.stddev_samp(value), value, n)})
    mid, half = F.col("__mid"), wide * F.col("__std")
    return out.withColumns({f"bollinger_middle_band_{tail}": mid, f"bollinger_upper_band_{tail}": mid + half, f"bollinger_lower_band_{tail}": mid - half, f"bollinger_bandwidth_{tail}": C.ratio((mid + half) - (mid - half), mid)})


#: Columns that windows add on the way.
HELPERS = ("__mid", "__std", "__tp", "__mean", "__window")


def bollinger(panel: DataFrame, n: int = 20, wide: float = 2.0, price: str = "close") -> DataFrame:
    return _bollinger(panel, n, wide, price).drop(*HELPERS)


def _cci(panel: DataFrame, n: int) -> DataFrame:
    out = panel.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    out = out.withColumns({"__mean": sma(F.col("__tp"), n), "__window": F.collect_list("__tp").over(C.last_rows(n))})
    spread = F.aggregate(F.transform("__window", lambda x: F.abs(x - F.col("__mean"))), F.lit(0.0), lambda s, x: s + x) / n
    return out.withColumn(f"commodity_channel_index_{n}", C.ratio(F.col("__tp") - F.col("__mean"), 0.015 * spread))


def cci(panel: DataFrame, n: int = 20) -> DataFrame:
    return _cci(panel, n).drop(*HELPERS)


def adx(panel: DataFrame, period: int = 14, rows: int | None = None) -> DataFrame:
    out = smooth(with_moves(deal(panel, 1, rows=rows)), adx_specs(period), dealt=True).withColumns(directional())
    out = smooth(again(out.withColumn("__dx", direction_index())), [wilder_of("__dx", period, f"average_directional_index_{period}")], dealt=True)
    return _plain(out.withColumns({f"positive_directional_index_{period}": F.col("__pdi"), f"negative_directional_index_{period}": F.col("__mdi")}))


#: Rows before a block that the windows of all_indicators() see.
LOOK_BACK = 59


def all_indicators(dealt: DataFrame) -> DataFrame:
    """Every indicator of the clean panel, over a panel dealt in blocks with LOOK_BACK rows before each.

    The recurrences share two passes. The result is dealt too, without the rows beside blocks.
    """
    value = F.col("close")
    out = dealt.withColumns({"simple_moving_average_20": sma(value, 20), "simple_moving_average_60": sma(value, 60)})
    out = with_moves(_cci(_bollinger(out, 20, 2.0, "close"), 20))
    first = [ema_of("close", 12, "exponential_moving_average_12"), ema_of("close", 26, "exponential_moving_average_26"), *rsi_specs(14), *adx_specs(14)]
    out = smooth(out.drop(*(c for c in out.columns if c in HELPERS)), first, dealt=True)
    out = out.withColumns({"relative_strength_index_14": rsi_value(), "macd_line_12_26_9": F.col("exponential_moving_average_12") - F.col("exponential_moving_average_26"), **directional()})
    out = out.withColumns({"__dx": direction_index(), "positive_directional_index_14": F.col("__pdi"), "negative_directional_index_14": F.col("__mdi")})
    out = out.drop(*(c for c in out.columns if c.startswith("__") and c not in ("__own", "__dx", "__ahead")))
    out = smooth(again(out), [ema_of("macd_line_12_26_9", 9, "macd_signal_12_26_9"), wilder_of("__dx", 14, "average_directional_index_14")], dealt=True)
    return out.withColumn("macd_histogram_12_26_9", F.col("macd_line_12_26_9") - F.col("macd_signal_12_26_9")).drop("__dx")
