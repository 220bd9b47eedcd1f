"""Operators against hand values, pandas and brute force."""

import hashlib
import json
import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions import columns as C
from barline.operators import calendar, cash, checks, execution, features, indicators, kpis, normalize, portfolio, strategies
from barline.operators import recurrence
from barline.operators.recurrence import Smoothing, smooth
from barline.plans import clean
from barline.sources import manifest, provider, tables
from barline.sources.scratch import shared_dir
from barline.streaming.daily import daily_last as stream_daily_last

D = date(2024, 1, 1)
BARS = "asset string, date date, open double, high double, low double, close double, volume double"


def series(spark, values, asset="A", name="x"):
    return spark.createDataFrame([(asset, D + timedelta(days=i), v) for i, v in enumerate(values)], f"asset string, date date, {name} double")


def random_bars(spark, n=300, seed=0, gaps=True):
    rng, rows = np.random.default_rng(seed), []
    for asset in ("A", "B"):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i, p in enumerate(price):
            lo, hi = p * (1 - rng.random() * 0.02), p * (1 + rng.random() * 0.02)
            missing = gaps and 40 <= i < 43
            rows.append((asset, D + timedelta(days=i), None if missing else float(p * 0.999), *(None if missing else float(x) for x in (hi, lo, p)), float(rng.integers(1, 100))))
    return spark.createDataFrame(rows, BARS)


def by_asset(df, column):
    p = df.toPandas().sort_values(["asset", "date"])
    return {a: g[column].astype(float).to_numpy() for a, g in p.groupby("asset")}


def close(a, b, tolerance=1e-9):
    assert (np.isnan(a) == np.isnan(b)).all()
    assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=tolerance, atol=tolerance)


@pytest.mark.parametrize("alpha,least", [(1 / 14, 14), (2 / 13, 12), (2 / 3, 2), (0.9, 1)])
def test_smoothing_equals_pandas_over_gaps(spark, alpha, least):
    rng = np.random.default_rng(3)
    x = rng.normal(100, 5, 4000)
    x[rng.random(4000) < 0.3] = np.nan
    x[1000:1450], x[:7], x[2500:3300] = np.nan, np.nan, np.nan
    y = rng.normal(0, 1, 4000)
    table = spark.createDataFrame([("A", D + timedelta(days=i), None if np.isnan(a) else float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "asset string, date date, x double, y double")
    out = smooth(table, [Smoothing("x", alpha, "sx", least), Smoothing("y", 0.05, "sy", 1)]).toPandas().sort_values("date")
    close(out.sx.to_numpy(float), pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy(), 1e-10)
    close(out.sy.to_numpy(float), pd.Series(y).ewm(alpha=0.05, adjust=False).mean().to_numpy(), 1e-9)


@pytest.mark.parametrize("rows", [7, 64, 100_000])
def test_smoothing_folds_over_blocks_and_spans(spark, monkeypatch, rows):
    """Blocks shorter than gaps, blocks without a value, and sums that run over several spans of a block."""
    monkeypatch.setattr(recurrence, "SPAN", 2.0)
    rng = np.random.default_rng(9)
    x = rng.normal(100, 5, 600)
    x[rng.random(600) < 0.2] = np.nan
    x[100:140], x[:9] = np.nan, np.nan
    table = spark.createDataFrame([(a, D + timedelta(days=i), None if np.isnan(v) else float(v)) for a in "AB" for i, v in enumerate(x)], "asset string, date date, x double")
    out = smooth(table, [Smoothing("x", 0.3, "fast", 1), Smoothing("x", 0.01, "slow", 5)], rows=rows)
    assert out.columns == [*table.columns, "fast", "slow"]
    out = out.toPandas().sort_values(["asset", "date"])
    for a in "AB":
        mine = out[out.asset == a]
        close(mine.fast.to_numpy(float), pd.Series(x).ewm(alpha=0.3, adjust=False).mean().to_numpy(), 1e-10)
        close(mine.slow.to_numpy(float), pd.Series(x).ewm(alpha=0.01, adjust=False, min_periods=5).mean().to_numpy(), 1e-10)


def test_repeated_days_count_in_order_and_the_last_stays(spark):
    rows = [("A", D + timedelta(days=i), 10.0 + i, 11.0 + i, 9.0 + i, 10.5 + i, 1.0, 0) for i in range(25)]
    again = ("A", D + timedelta(days=22), 50.0, 60.0, 40.0, 55.0, 1.0, 1)
    table = spark.createDataFrame([again, *rows], BARS + ", n int")
    rates = table.select("date").distinct().withColumn("risk_free_annual", F.lit(0.03))
    got = clean.clean_panel(table, rates, order="n").where("asset = 'A'").toPandas().sort_values("date", ignore_index=True)
    assert len(got) == 25 and got.date.is_unique
    series_ = pd.Series([r[5] for r in rows[:23]] + [55.0] + [r[5] for r in rows[23:]])
    want = series_.rolling(20).mean().drop(22).reset_index(drop=True)  # the first of the two rows of that day goes
    close(got.simple_moving_average_20.to_numpy(float), want.to_numpy(), 1e-5)
    assert got.close[22] == 55.0 and got.execution_price_t_plus_1_open[22] == 33.0
    with pytest.raises(ValueError, match="CASH"):
        clean.clean_panel(table.withColumn("asset", F.lit("CASH")), rates)


def test_indicators_equal_pandas(spark):
    bars = random_bars(spark)
    source = bars.toPandas().sort_values(["asset", "date"])
    out = clean.clean_panel(bars, bars.select("date").distinct().withColumn("risk_free_annual", F.lit(0.03)))
    assert out.columns == clean.COLUMNS and out.where("asset = 'CASH'").count() == 300
    assert dict(out.dtypes)["close"] == "float" and dict(out.dtypes)["is_cash"] == "tinyint"
    got = out.toPandas().sort_values(["asset", "date"])
    for asset, g in source.groupby("asset"):
        p, mine = g.close.reset_index(drop=True).astype(float), got[got.asset == asset].reset_index(drop=True)
        h, lo = g.high.reset_index(drop=True).astype(float), g.low.reset_index(drop=True).astype(float)
        check = lambda name, expected: close(mine[name].to_numpy(float), expected.to_numpy(float), 1e-4)  # noqa: B023, E731
        check("simple_moving_average_20", p.rolling(20).mean())
        check("exponential_moving_average_12", p.ewm(span=12, adjust=False, min_periods=12).mean())
        d = p.diff()
        up, down = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        check("relative_strength_index_14", 100 - 100 / (1 + up / down))
        line = p.ewm(span=12, adjust=False, min_periods=12).mean() - p.ewm(span=26, adjust=False, min_periods=26).mean()
        check("macd_signal_12_26_9", line.ewm(span=9, adjust=False, min_periods=9).mean())
        check("bollinger_upper_band_20_2_0", p.rolling(20).mean() + 2 * p.rolling(20).std())
        tp = (h + lo + p) / 3
        mad = tp.rolling(20).apply(lambda x: np.mean(np.abs(x - x.mean())), raw=True)
        check("commodity_channel_index_20", (tp - tp.rolling(20).mean()) / (0.015 * mad))
        assert mine.relative_strength_index_14.dropna().between(0, 100).all()
        assert (mine.bid_ask_spread_corwin_schultz.dropna() >= 0).all()
        bands = mine[["bollinger_lower_band_20_2_0", "bollinger_middle_band_20_2_0", "bollinger_upper_band_20_2_0"]].dropna()
        assert (bands.diff(axis=1).iloc[:, 1:] >= 0).all(axis=None)
    held = got[got.asset == "CASH"].close.to_numpy(float)
    assert (np.diff(held) >= 0).all()
    names = clean.export_names(out).columns
    assert "bollinger_bandwidth_20_2.0" in names


def test_all_features_share_one_exchange_by_asset(spark):
    plan = features.next_open(features.spread_estimates(features.dollar_volume(features.log_return(random_bars(spark)))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(asset") == 1


def test_adx_first_rows(spark):
    bars = random_bars(spark, gaps=False)
    got = indicators.adx(bars).toPandas().sort_values(["asset", "date"])
    g = bars.toPandas().sort_values(["asset", "date"])
    g = g[g.asset == "A"].reset_index(drop=True)
    previous = g.close.shift(1)
    tr = pd.concat([g.high - g.low, (g.high - previous).abs(), (g.low - previous).abs()], axis=1).max(axis=1)
    up, down = g.high.diff(), -g.low.diff()
    sm = lambda x: x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    plus = 100 * sm(up.where((up > down) & (up > 0), 0.0)) / sm(tr)
    minus = 100 * sm(down.where((down > up) & (down > 0), 0.0)) / sm(tr)
    mine = got[got.asset == "A"]
    close(mine.positive_directional_index_14.to_numpy(float), plus.to_numpy())
    close(mine.average_directional_index_14.to_numpy(float), sm(100 * (plus - minus).abs() / (plus + minus)).to_numpy())


def test_edge_series(spark):
    flat = series(spark, [5.0, None, 0.0, 5.0, None], name="close")
    assert [r["r"] for r in features.log_return(flat, out="r").orderBy("date").collect()] == [None] * 5
    linear = [r["r"] for r in features.linear_return(flat, out="r").orderBy("date").collect()]
    assert linear == [None, 0.0, -1.0, None, 0.0]
    filled = calendar.fill(flat, ["close"]).orderBy("date").collect()
    assert [r["close"] for r in filled] == [5.0, 5.0, 0.0, 5.0, 5.0]
    back = calendar.fill(flat, ["close"], "bfill").orderBy("date").collect()
    assert [r["close"] for r in back] == [5.0, 0.0, 0.0, 5.0, None]
    with pytest.raises(ValueError, match="unknown"):
        calendar.fill(flat, ["close"], "sideways")
    assert flat.select(C.floored(F.col("close") - 3).alias("f")).collect()[1]["f"] is None
    empty = series(spark, [None] * 30, name="close")
    assert all(r["exponential_moving_average_12"] is None for r in indicators.ema(empty, 12).collect())


def test_execution_hand_values(spark):
    orders = spark.createDataFrame([(D, "SPY", 10.0), (D + timedelta(days=1), "SPY", 0.0)], "date date, asset string, delta_shares double")
    prices = spark.createDataFrame([(D, "SPY", 100.0, 0.002, 99.5), (D + timedelta(days=1), "SPY", 101.0, 0.002, 100.5)], "date date, asset string, ref double, spread double, open double")
    trades = execution.apply_execution(orders, prices, reference="ref", spread="spread")
    costs = execution.apply_fees(trades, 5.0).orderBy("date").collect()
    assert costs[0]["p_exec"] == pytest.approx(100.1) and costs[0]["spread_cost"] == pytest.approx(1.0)
    assert costs[0]["fees"] == pytest.approx(0.5005) and costs[0]["total_cost"] == pytest.approx(1.5005)
    assert costs[1]["total_cost"] == 0
    plain = execution.apply_execution(orders, prices, reference="ref", spread="absent").orderBy("date").first()
    assert plain["p_exec"] == 100.0
    fixed = execution.apply_execution(orders, prices, reference="ref", fixed_bps=20.0).orderBy("date").first()
    assert fixed["p_exec"] == pytest.approx(100.1)
    lots = spark.createDataFrame([(7.9,), (-7.9,), (None,), (0.0,)], "q double").select(execution.round_lots(F.col("q"), 2.0).alias("q")).collect()
    assert [r["q"] for r in lots] == [6.0, -6.0, 0.0, 0.0]
    sold = spark.createDataFrame([(100.0, -0.5, -1.0), (100.0, None, -1.0), (100.0, 0.02, -1.0)], "p double, s double, q double").select(execution.half_spread_price(F.col("p"), F.col("s"), F.col("q")).alias("p")).collect()
    assert [r["p"] for r in sold] == [100.0, 100.0, 99.0]
    sigma = spark.createDataFrame([(D, "SPY", 50.0)], "date date, asset string, sigma_bps double")
    slipped = execution.apply_fees(trades, 5.0, sigma, 0.1).orderBy("date").collect()
    assert slipped[0]["vol_slip"] == pytest.approx(10 * 100 * 0.1 * 50 / 1e4) and slipped[1]["vol_slip"] == 0


def test_rebalance_equals_a_plain_fold(spark):
    bars = random_bars(spark, 40, gaps=False)
    targets = portfolio.target_weights(bars.select(F.lit("p").alias("portfolio_id"), "date", "asset", F.col("volume").alias("weight")))
    sums = targets.groupBy("date").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1) for r in sums)
    prices = bars.withColumn("bid_ask_spread_corwin_schultz", F.lit(0.01))
    got = portfolio.rebalance(targets, prices, cash=1000.0).toPandas().sort_values(["date", "asset"])
    want, cash_, held = targets.toPandas(), 1000.0, {}
    price = {(r.date, r.asset): r.close for r in bars.toPandas().itertuples()}
    for day in sorted(want.date.unique()):
        rows = want[want.date == day]
        value, paid = cash_ + sum(held.get(a, 0) * price[day, a] for a in rows.asset), 0.0
        for r in rows.itertuples():
            goal = r.weight * value / price[day, r.asset]
            q = goal - held.get(r.asset, 0)
            fill = price[day, r.asset] * (1 + 0.005 * (1 if q >= 0 else -1))
            paid += q * fill + abs(q * fill) * 5e-4
            held[r.asset] = goal
        cash_ -= paid
        mine = got[got.date == day]
        assert mine.cash.iloc[0] == pytest.approx(cash_) and mine.value.iloc[0] == pytest.approx(cash_ + sum(held[a] * price[day, a] for a in held))
    day = lambda i: D + timedelta(days=i)
    wanted = spark.createDataFrame([("p", day(i), a, 0.5) for i in range(4) for a in "AB"], "portfolio_id string, date date, asset string, weight double")
    quoted = spark.createDataFrame(
        [(day(0), "A", 10.0, 11.0, 0.0), (day(0), "B", 20.0, 22.0, 100.0), (day(1), "A", 10.0, None, 0.0), (day(1), "B", 20.0, 20.0, None), (day(2), "A", 0.0, 10.0, 0.0), (day(2), "B", 0.0, 10.0, 0.0), (day(3), "A", 5.0, 5.0, 0.0), (day(3), "B", 5.0, 5.0, 0.0)],
        "date date, asset string, close double, execution_price_t_plus_1_open double, sigma_bps double",
    )
    rows = {(r["date"], r["asset"]): r for r in portfolio.rebalance(wanted, quoted, cash=100.0, bps=10.0, sigma="sigma_bps", k=2.0).collect()}
    a, b = rows[day(0), "A"], rows[day(0), "B"]
    assert (a["shares"], b["shares"], a["p_exec"]) == (5.0, 2.5, 11.0)  # shares by the mark, fills at the reference
    assert b["fees"] == pytest.approx(110 * 1e-3) and b["vol_slip"] == pytest.approx(2.5 * 22 * 2 * 100 / 1e4)
    assert b["cash"] == pytest.approx(100 - 110 - 0.11 - 1.1) and b["value"] == pytest.approx(b["cash"] + 100)
    assert rows[day(1), "A"]["q"] == 0 and rows[day(1), "A"]["p_exec"] is None and rows[day(1), "B"]["q"] != 0
    assert rows[day(2), "A"]["q"] == rows[day(2), "B"]["q"] == 0 and rows[day(2), "A"]["value"] < 0  # no wealth, no trade
    assert all(np.isfinite(r["value"]) for r in rows.values())
    short = portfolio.target_weights(spark.createDataFrame([("p", D, "A", -1.0), ("p", D, "B", 3.0)], "portfolio_id string, date date, asset string, weight double"), short=True)
    assert sorted(r["weight"] for r in short.collect()) == [-0.5, 1.5]


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(1)
    r, m = rng.normal(0.0005, 0.01, 500), rng.normal(0.0003, 0.01, 500)
    table = spark.createDataFrame([("P", D + timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(r, m, strict=True))], "asset string, date date, r double, m double")
    got = kpis.report(table, 0.03, market="m").first()
    wealth = np.exp(np.cumsum(r))
    down = (r - 0.03 / 252)[r < 0.03 / 252]
    beta = np.cov(r, m)[0, 1] / np.var(m, ddof=1)
    drawdown = (wealth / np.maximum.accumulate(wealth) - 1).min()
    expected = {
        "annual_return": r.mean() * 252, "annual_volatility": r.std(ddof=1) * math.sqrt(252), "sharpe": (r - 0.03 / 252).mean() / r.std(ddof=1) * math.sqrt(252), "sortino": (r - 0.03 / 252).mean() / down.std(ddof=1) * math.sqrt(252), "max_drawdown": drawdown,
        "calmar": r.mean() * 252 / abs(drawdown), "var": -(-1.6448536269514722 * r.std(ddof=1) - r.mean()), "skewness": ((r - r.mean()) ** 3).mean() / r.std() ** 3, "kurtosis": ((r - r.mean()) ** 4).mean() / r.std() ** 4,
        "treynor": (r.mean() * 252 - 0.03) / beta, "jensen_alpha": r.mean() * 252 - (0.03 + beta * (m.mean() * 252 - 0.03)),
    }
    assert {k: got[k] for k in expected} == pytest.approx(expected)
    one = kpis.report(series(spark, [0.01], name="r")).first()
    assert one["annual_volatility"] is None and one["sharpe"] is None and one["calmar"] is None
    gap = series(spark, [0.01, None, 0.02], name="r")
    assert kpis.report(gap).first()["annual_return"] == pytest.approx(0.015 * 252) and kpis.report(gap, strict=True).first()["annual_return"] is None
    assert kpis.with_wealth(series(spark, [0.1, -0.5], name="r"), simple=True).agg(F.min("wealth")).first()[0] == pytest.approx(0.55)


def test_weight_grid_equals_the_loop(spark):
    rng = np.random.default_rng(4)
    a, b, m = rng.normal(0.001, 0.01, (3, 400))
    b = 0.3 * a + b
    pairs = spark.createDataFrame([tuple(map(float, x)) for x in zip(a, b, m, strict=True)], "r1 double, r2 double, m double")
    scored = strategies.grid_scores(strategies.weight_grid(strategies.moments(pairs)), 0.02)

    def best(score):
        values = [(score(w * a + (1 - w) * b), w) for w in np.arange(101) / 100]
        return max(values, key=lambda v: (v[0], -v[1]))

    beta = lambda x: np.cov(x, m)[0, 1] / np.var(m, ddof=1)
    for name, score in {
        "treynor": lambda x: (x.mean() * 252 - 0.02) / beta(x),
        "jensen": lambda x: x.mean() * 252 - (0.02 + beta(x) * (m.mean() * 252 - 0.02)),
        "low_beta": lambda x: -abs(beta(x)),
        "low_correlation": lambda x: -abs(np.corrcoef(x, m)[0, 1]),
        "sharpe": lambda x: (x.mean() * 252 - 0.02) / (x.std(ddof=1) * math.sqrt(252)),
    }.items():
        got, want = strategies.best_weight(scored, name).first(), best(score)
        assert got["score"] == pytest.approx(want[0]) and got["w"] == pytest.approx(want[1])


def test_score_weights(spark):
    up, down = [0.01, 0.02, 0.005], [-0.01, -0.02, -0.005]
    table = series(spark, up, "A", "r").unionByName(series(spark, down, "B", "r")).unionByName(series(spark, [0.02, 0.01, 0.001], "C", "r"))
    weights = {r["asset"]: r["weight"] for r in strategies.score_weights(table).collect()}
    assert weights["B"] == 0 and sum(weights.values()) == pytest.approx(1)
    none = {r["asset"]: r["weight"] for r in strategies.score_weights(series(spark, down, "B", "r")).collect()}
    assert none == {"B": 0.0}
    with pytest.raises(ValueError, match="unknown"):
        strategies.score_weights(table, "luck")


def test_calendar_and_alignment(spark):
    bounds = spark.createDataFrame([(D, date(2024, 1, 31))], "start date, end date")
    days = calendar.sessions(bounds)
    assert days.count() == 23 and days.where("weekday(date) > 4").count() == 0
    closed = spark.createDataFrame([(D,)], "date date")
    assert calendar.sessions(bounds, holidays=closed).count() == 22
    sparse = spark.createDataFrame([("A", date(2024, 1, 2), 100.0), ("A", date(2024, 1, 5), 101.0), ("A", date(2024, 1, 6), 1.0)], "asset string, date date, x double")
    aligned = calendar.align(sparse, days).orderBy("date").collect()
    assert len(aligned) == 23 and [r["x"] for r in aligned[:5]] == [None, 100.0, None, None, 101.0]
    assert calendar.gap_report(sparse, days).count() == 21
    ticks = spark.createDataFrame([("C", datetime(2024, 1, 2, 1), 1.0, 5.0), ("C", datetime(2024, 1, 2, 9), 2.0, None), ("C", datetime(2024, 1, 3, 9), None, None)], "asset string, ts timestamp, p double, v double")
    daily = calendar.daily_last(ticks, ["p", "v"]).orderBy("date").collect()
    assert [(r["p"], r["v"]) for r in daily] == [(2.0, 5.0), (None, None)]
    rates = spark.createDataFrame([(date(2024, 1, 3), 5.0), (date(2024, 1, 6), 6.0), (date(2024, 1, 8), 7.0)], "date date, percent double")
    free = {r["date"]: r["risk_free_annual"] for r in calendar.risk_free_on(rates, days).collect()}
    assert date(2024, 1, 2) not in free and free[date(2024, 1, 5)] == 0.05 and free[date(2024, 1, 9)] == 0.07
    slow = {r["date"]: r["percent"] for r in calendar.as_of(days, rates, "percent").collect()}
    assert slow[date(2024, 1, 2)] is None and slow[date(2024, 1, 5)] == 5.0 and slow[date(2024, 1, 8)] == 7.0


def test_cash(spark):
    rates = spark.createDataFrame([(date(2024, 1, 5), 0.036), (date(2024, 1, 8), None), (date(2024, 1, 9), None)], "date date, risk_free_annual double")
    rows = cash.cash_bars(cash.accrual(rates)).orderBy("date").collect()
    assert [r["days_to_next"] for r in rows] == [3, 1, 1]
    assert [r["factor"] for r in rows] == pytest.approx([1 + 0.036 * 3 / 360, 1 + 0.036 / 360, 1.0])
    assert rows[0]["open"] == 1.0 and rows[1]["open"] == rows[0]["close"] and rows[1]["high"] == rows[1]["close"]
    none = cash.cash_bars(cash.accrual(rates.withColumn("risk_free_annual", F.lit(None).cast("double")))).orderBy("date").collect()
    assert [r["close"] for r in none] == [None, None, 1.0]
    clash = spark.createDataFrame([("CASH", D, 1.0, 1.0, 1.0, 1.0, 0.0)], BARS)
    with pytest.raises(ValueError, match="CASH"):
        clean.clean_panel(clash, rates)


def test_checks(spark):
    bars = random_bars(spark, 5, gaps=False)
    checks.require_unique(bars)
    checks.require_not_negative(bars, ["close"])
    with pytest.raises(ValueError, match="duplicate"):
        checks.require_unique(bars.union(bars))
    with pytest.raises(ValueError, match="negative"):
        checks.require_not_negative(bars.withColumn("close", -F.col("close")), ["close"])
    with pytest.raises(ValueError, match="missing columns: high"):
        normalize.with_defaults(bars.drop("high"))
    with pytest.raises(ValueError, match="missing columns: open, close"):
        checks.require_columns(bars.drop("open", "close"), normalize.BASE)
    with pytest.raises(ValueError, match="A is there"):
        checks.require_no_asset(bars, "A")
    assert checks.missing_columns(bars, bars.withColumn("volume", F.lit(1)).schema) == ["volume"]


def test_normalize(spark):
    raw = spark.createDataFrame([("btc-usd", "2024-01-02T00:00:00Z", 1.0, 2.0, 0.5, float("nan"), 3), (" spy", "junk", 1.0, 2.0, 0.5, 1.5, 3), ("spy", "2024-01-03", 1.0, 2.0, 0.5, 1.5, 3)], "asset string, `Date ` string, Open double, High double, Low double, Close double, adjClose int")
    rows = normalize.normalize(raw, "2024-01-01", "2024-01-31").orderBy("date").collect()
    assert [(r["asset"], r["close"], r["adj_close"], r["stock_splits"]) for r in rows] == [("BTCUSD", None, 3.0, 1.0), ("SPY", 1.5, 3.0, 1.0)]
    listed = spark.createDataFrame([("ETH", True), ("SPY", False)], "asset string, is_crypto boolean")
    flags = {r["asset"]: r["is_crypto"] for r in normalize.crypto_flag(spark.createDataFrame([("ETH",), ("SPY",), ("BTCUSD",)], "asset string"), listed).collect()}
    assert flags == {"ETH": True, "SPY": False, "BTCUSD": True}
    twice = spark.createDataFrame([(D, "A", 1, "old"), (D, "A", 2, "new")], "date date, asset string, n int, v string")
    assert normalize.keep_last(twice, "n").first()["v"] == "new"


def test_provider_files(spark, tmp_path):
    day = {"date": "2024-01-02T00:00:00.000Z", "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "adjClose": 1.4, "volume": 10, "divCash": 0.1, "splitFactor": 1.0}
    (tmp_path / "spy.json").write_text(json.dumps([day, day | {"date": "2024-01-03"}]))
    (tmp_path / "bad.json").write_text("{broken")
    (tmp_path / "none.json").write_text("[]")
    files = provider.payloads(spark, str(tmp_path))
    raw = provider.equity_bars(files)
    assert raw.count() == 2 and sorted(r["asset"] for r in provider.rejected(files).collect()) == ["BAD", "NONE"]
    assert [r["asset"] for r in provider.land(raw, shared_dir(spark)).collect()] == ["SPY"]
    panel = normalize.normalize(raw).orderBy("date").collect()
    assert panel[0]["dividends"] == 0.1 and panel[0]["date"] == date(2024, 1, 2)
    coins = tmp_path / "coins"
    coins.mkdir()
    (coins / "btc-usd.json").write_text(json.dumps([{"priceData": [{k: day[k] for k in ("date", "open", "high", "low", "close")} | {"volume": 1.5}]}]))
    (coins / "eth-usd.json").write_text("[]")
    files = provider.payloads(spark, str(coins))
    assert [r["asset"] for r in provider.crypto_bars(files).collect()] == ["BTCUSD"]
    assert [r["asset"] for r in provider.rejected(files, crypto=True).collect()] == ["ETHUSD"]
    (tmp_path / "fred.txt").write_text(json.dumps({"observations": [{"date": "2024-01-02", "value": "5.25"}, {"date": "2024-01-03", "value": "."}]}))
    seen = provider.observations(provider.payloads(spark, str(tmp_path / "fred.txt"))).orderBy("date").collect()
    assert [r["percent"] for r in seen] == [5.25, None]


def test_tables_and_manifest(spark, tmp_path):
    bars = random_bars(spark, 5)
    path = str(tmp_path / "bars")
    tables.save_parquet(bars, path, by="asset")
    assert tables.one_asset(tables.load_parquet(spark, path), "A").count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_parquet(spark, str(tmp_path / "nothing"))
    summary = manifest.file_summary(spark, path)
    row = summary.first()
    assert row["n_rows"] == 10 and row["date_min"] == "2024-01-01" and len(row["sha256"]) == 64
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "x.txt").write_text("no table")
    assert manifest.file_summary(spark, str(tmp_path / "plain")).first()["n_rows"] is None
    assert [r["sha256"] for r in manifest.sha256_files(spark, str(tmp_path / "plain")).collect()] == [hashlib.sha256(b"no table").hexdigest()]
    out = str(tmp_path / "manifest")
    manifest.write_manifest(manifest.manifest("clean", summary, summary, {"a": "b"}, git_commit="abc"), out)
    told = spark.read.json(out).first()
    assert told["outputs"][0]["n_rows"] == 10 and told["inputs"][0]["sha256"] == row["sha256"]
    assert (told["dataset_id"], told["git_commit"], told["calendar"]) == ("v1", "abc", "XNYS") and told["created_at"].endswith("+00:00")


def test_streamed_daily_last_equals_batch(spark, tmp_path):
    rows = [("C", datetime(2024, 1, 1 + d, h), float(d * 24 + h) if h % 5 else None) for d in range(4) for h in range(0, 24, 3)]
    table = spark.createDataFrame(rows, "asset string, ts timestamp, price double")
    table.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "ticks"))
    query = stream_daily_last(stream).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["date"], r["price"]) for r in spark.table("daily").collect())
    assert got == sorted((r["date"], r["price"]) for r in calendar.daily_last(table, ["price"]).collect())
