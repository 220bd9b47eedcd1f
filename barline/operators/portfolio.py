"""Target weights, rebalancing over time and marking to market."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.columns import not_nan

STATE = "portfolio_id string, date date, asset string, value double, cash double, fees double, vol_slip double, q double, p_exec double, shares double, weight double"


def target_weights(raw: DataFrame, short: bool = False, weight: str = "weight") -> DataFrame:
    """Weights of each portfolio and date scaled to 1, floored at 0 unless short positions are allowed."""
    floor = F.col(weight) if short else F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0))
    total = F.sum("__w").over(Window.partitionBy("portfolio_id", "date"))
    return raw.withColumn("__w", floor).withColumn(weight, F.col("__w") / F.greatest(total, F.lit(1e-12))).drop("__w")


def rebalance(targets: DataFrame, prices: DataFrame, cash: float = 1e6, bps: float = 5.0, mark: str = "close", reference: str = "execution_price_t_plus_1_open", spread: str = "bid_ask_spread_corwin_schultz", sigma: str | None = None, k: float = 0.0, opening: DataFrame | None = None) -> DataFrame:
    """The state of each portfolio after each date's rebalancing to targets (portfolio_id, date, asset, weight).

    A date's value at ``mark`` sets target shares; the trade fills at ``reference`` and half the spread on it (at
    ``mark`` if prices have no such column; with no trade the fill is the reference) and pays fees on its notional
    and, with ``sigma`` (a column, in basis points), slippage of k times sigma. Without a reference price an asset is
    not traded that day, with a mark of zero its target is no shares; an asset without a row has no part in the day.
    A portfolio whose value is not positive trades no more that day. ``opening`` (portfolio_id, asset, shares, cash;
    see closing()) is what portfolios hold before their first date instead of ``cash`` alone.

    Cash and shares carry over, so a portfolio is a fold over rows in date order. Rows are dealt by portfolio and
    sorted by Spark, which spills; the fold reads them batch by batch and holds a batch, one date and a number for
    each asset, however long the history is.
    """
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    width = F.col(spread) if spread in prices.columns else zero
    known = prices.select("date", "asset", F.coalesce(mark, zero).alias("mark"), F.col(reference if reference in prices.columns else mark).alias("ref"), F.greatest(F.coalesce(width, zero), zero).alias("spread"), (F.coalesce(sigma, zero) if sigma else zero).alias("sigma"))
    rows = targets.select("portfolio_id", "date", "asset", F.coalesce("weight", zero).alias("weight")).join(known, ["date", "asset"])
    names = ["portfolio_id", "date", "asset", "weight", "mark", "ref", "spread", "sigma"]
    rows = rows.select(*names, none.alias("shares"), none.alias("cash"))
    if opening is not None:  # rows without a date come first
        rows = rows.unionByName(opening.select("portfolio_id", F.lit(None).cast("date").alias("date"), "asset", *(none.alias(c) for c in names[3:]), "shares", "cash"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        money, held, index = cash, np.zeros(0), {}
        for rows in whole_dates(batches):
            codes = np.array([index.setdefault(a, len(index)) for a in rows["asset"].to_pylist()], np.int64)
            held = np.append(held, np.zeros(len(index) - len(held)))
            marks, refs, spreads, sigmas, weights, shares, opened = (rows[c].to_numpy(zero_copy_only=False).astype(float) for c in ("mark", "ref", "spread", "sigma", "weight", "shares", "cash"))
            before = rows["date"].null_count
            if before:
                money = opened[0]
                held[codes[:before]] = np.nan_to_num(shares[:before])
            days = rows["date"].cast(pa.int32()).to_numpy(zero_copy_only=False)[before:]
            starts = before + np.append(np.flatnonzero(np.append(True, days[1:] != days[:-1])), len(days)) if len(days) else np.zeros(1, int)
            made = {c: np.empty(len(rows)) for c in ("value", "cash", "fees", "vol_slip", "q", "p_exec", "shares", "weight")}
            for a, b in pairwise(starts.tolist()):
                here, price, ref = codes[a:b], marks[a:b], refs[a:b]
                value = money + held[here] @ price
                goal = np.divide(weights[a:b] * value, price, out=np.zeros(b - a), where=price != 0)
                q = np.where(np.isnan(ref) | (value <= 0), 0.0, goal - held[here])
                fill = ref * (1 + spreads[a:b] / 2 * np.sign(q))
                traded = np.where(q == 0, 0.0, np.abs(q))
                fees = np.nansum(traded * fill) * bps / 1e4
                slip = np.nansum(traded * ref * sigmas[a:b]) * k / 1e4
                money -= np.nansum(q * fill) + fees + slip
                held[here] += q
                worth = money + held[here] @ price
                for name, x in (("value", worth), ("cash", money), ("fees", fees), ("vol_slip", slip), ("q", q), ("p_exec", fill), ("shares", held[here]), ("weight", held[here] * price / max(worth, 1e-12))):
                    made[name][a:b] = x
            keys = [rows[c].slice(before) for c in ("portfolio_id", "date", "asset")]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x[before:]) for x in made.values())], ["portfolio_id", "date", "asset", *made])

    # Dealt and sorted here, so that grouping adds neither an exchange nor a sort and keeps the order of dates.
    dealt = rows.repartition("portfolio_id").sortWithinPartitions("portfolio_id", "date", "asset")
    return dealt.groupBy("portfolio_id").applyInArrow(fold, STATE).withColumn("p_exec", not_nan(F.col("p_exec")))


def whole_dates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in the same order, cut so that no date is in two of them."""
    first = lambda batch: pa.compute.fill_null(batch["date"].cast(pa.int32()), -(1 << 31)).to_numpy()
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        days = first(batch)
        last = int(np.searchsorted(days, days[-1]))  # where the last date begins
        if last or (held and first(held[-1])[-1] != days[0]):
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def closing(states: DataFrame, until: str | None = None) -> DataFrame:
    """portfolio_id, asset, shares and cash after each portfolio's last date (up to ``until``), to open a run with."""
    known = states if until is None else states.where(F.col("date") <= F.lit(until).cast("date"))
    shares = known.groupBy("portfolio_id", "asset").agg(F.max_by("shares", "date").alias("shares"))
    return shares.join(known.groupBy("portfolio_id").agg(F.max_by("cash", "date").alias("cash")), "portfolio_id")


def resume(saved: DataFrame, targets: DataFrame, prices: DataFrame, **how) -> DataFrame:
    """The states after the last saved date of each portfolio, as a whole run would have them.

    Portfolios without a saved state start with cash; ``how`` is what rebalance() takes.
    """
    last = saved.groupBy("portfolio_id").agg(F.max("date").alias("__last"))
    ahead = targets.join(last, "portfolio_id", "left").where(F.col("__last").isNull() | (F.col("date") > F.col("__last"))).drop("__last")
    return rebalance(ahead, prices, opening=closing(saved), **how)


def mark_to_market(positions: DataFrame, prices: DataFrame, price: str = "close") -> DataFrame:
    """positions (portfolio_id, date, asset, shares, cash) with value and weight at the date's prices."""
    every = Window.partitionBy("portfolio_id", "date")
    held = positions.join(prices.select("date", "asset", F.col(price).alias("price")), ["date", "asset"], "left").withColumn("__worth", F.col("shares") * F.coalesce("price", F.lit(0.0)))
    out = held.withColumn("value", F.col("cash") + F.sum("__worth").over(every))
    return out.withColumn("weight", F.col("__worth") / F.greatest("value", F.lit(1e-12))).drop("__worth", "price")

