"""What is dealt in blocks of time equals its plain form, and no task sees a whole asset."""

import hashlib
import re
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_market import D, by_asset, close, random_bars

from barline.operators import blocks, calendar, checks, features, indicators, kpis, normalize, portfolio, strategies
from barline.plans import clean, queries
from barline.sources import manifest, provider, tables
from barline.sources.scratch import shared_dir

SF = "/root/testdata/sf0.001"


def hot_bars(spark):
    """Three years of one asset, and a few days of others that share none of its blocks."""
    many = random_bars(spark, 1100, seed=4).where("asset = 'A'")
    return many.unionByName(random_bars(spark, 60, seed=5).where("asset = 'B'"))


WINDOWS = {
    "dollar_volume": (lambda p: features.dollar_volume(p, 20, "x"), 19, 0, ["x"]),
    "spread_terms": (lambda p: features.spread_terms(p, 3), 3, 0, ["spread_beta", "spread_gamma"]),
    "bollinger": (indicators.bollinger, 19, 0, ["bollinger_upper_band_20_2_0"]),
    "cci": (indicators.cci, 19, 0, ["commodity_channel_index_20"]),
    "sma_and_next_open": (lambda p: features.next_open(p.withColumn("x", indicators.sma(F.col("close"), 60)), "ahead"), 59, 1, ["x", "ahead"]),
}


@pytest.mark.parametrize("name", WINDOWS)
@pytest.mark.parametrize("rows", [59, 64, 1000])
def test_windows_in_blocks_equal_the_plain_ones(spark, name, rows):
    add, before, after, columns = WINDOWS[name]
    bars = hot_bars(spark)
    plain, cut = add(bars), blocks.in_blocks(bars, add, before, after, rows)
    assert cut.columns == plain.columns and cut.count() == bars.count()
    for c in columns:
        for a, want in by_asset(plain, c).items():
            close(by_asset(cut, c)[a], want)


def test_no_task_reads_more_than_a_block_and_what_stands_beside_it(spark):
    bars = hot_bars(spark)
    dealt = blocks.deal(bars, 19, 1, 100)
    sizes = dealt.groupBy("asset").agg(F.count("*").alias("n"), F.count_if("__own").alias("own")).collect()
    assert max(r["n"] for r in sizes) <= 120 and sum(r["own"] for r in sizes) == bars.count()
    made = blocks.in_blocks(bars, indicators.cci, 19, rows=100)
    plan = made._jdf.queryExecution().executedPlan().toString()
    # Windows are by asset and year, by blocks, or over one row a year; none is by asset over rows.
    for line in re.findall(r"Window \[.*", plan):
        assert "row_number()" in line and "__bucket" in line or "__start" in line or "sum(__n" in line or "__tp" in line or "__mean" in line or "__window" in line, line
    with pytest.raises(ValueError, match="more than a block"):
        blocks.deal(bars, 200, rows=100)


def test_adx_macd_and_rsi_do_not_depend_on_blocks(spark):
    bars = hot_bars(spark)
    for make, column in ((indicators.adx, "average_directional_index_14"), (indicators.macd, "macd_signal_12_26_9"), (indicators.rsi, "relative_strength_index_14")):
        whole, cut = make(bars), make(bars, rows=50)
        assert whole.columns == cut.columns
        for a, want in by_asset(whole, column).items():
            close(by_asset(cut, column)[a], want, 1e-9)


def test_the_clean_panel_does_not_depend_on_blocks_or_on_how_rows_are_dealt(spark):
    bars = hot_bars(spark)
    bars = bars.unionByName(bars.where("day(date) = 3").withColumns({"close": F.col("close") * 1.5, "high": F.col("high") * 1.5}))  # some days twice
    rates = bars.select("date").distinct().withColumn("risk_free_annual", F.lit(0.03))
    order = ["asset", "date"]
    want = clean.clean_panel(bars, rates).toPandas().sort_values(order, ignore_index=True)
    for other in (clean.clean_panel(bars.repartition(7, "volume"), rates), clean.clean_panel(bars.orderBy(F.col("close").desc()), rates, rows=60)):
        pd.testing.assert_frame_equal(other.toPandas().sort_values(order, ignore_index=True), want, rtol=1e-5)


def test_the_last_row_of_a_file_stays(spark, tmp_path):
    rows = [("A", D, float(k)) for k in range(50)]
    spark.createDataFrame(rows, "asset string, date date, close double").coalesce(1).write.parquet(str(tmp_path / "t"))
    held = tables.load_ordered(spark, str(tmp_path / "t"))
    for dealt in (held, held.repartition(5), held.orderBy("close")):
        assert [r["close"] for r in normalize.keep_last(dealt, "file_order").collect()] == [49.0]


def test_drawdown_and_wealth_by_blocks(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.03, 900)
    days = [date(2020, 12, 20) + timedelta(days=i) for i in range(900)]
    rows = [("P", d, None if k % 50 == 7 else float(x)) for k, (d, x) in enumerate(zip(days, r, strict=True))] + [("Q", days[0], -0.1), ("R", days[0], None)]
    table = spark.createDataFrame(rows, "asset string, date date, r double")
    known = np.array([x for k, x in enumerate(r) if k % 50 != 7])
    wealth = np.exp(np.cumsum(known))
    down = wealth / np.maximum.accumulate(wealth) - 1
    for block in (None, F.trunc("date", "month"), F.col("date"), F.lit(1)):
        got = {x["asset"]: x["max_drawdown"] for x in kpis.max_drawdown(table, block=block).collect()}
        assert got["P"] == pytest.approx(down.min(), abs=1e-12) and got["Q"] == 0 and "R" not in got
        every = kpis.with_drawdown(kpis.with_wealth(table, block=block), block=block).where("asset = 'P' AND r IS NOT NULL").orderBy("date").toPandas()
        assert np.allclose(every.wealth, wealth) and np.allclose(every.drawdown, down)
    told = kpis.report(table).where("asset = 'P'").first()
    assert told["max_drawdown"] == pytest.approx(down.min()) and told["calmar"] == pytest.approx(known.mean() * 252 / abs(down.min()))
    whole = kpis.max_drawdown(table)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(asset" in whole and all("__block" in w for w in re.findall(r"windowspecdefinition\((.*?)\)", whole))


def test_as_of_by_key(spark):
    slow = [("A", D, 1.0), ("A", D + timedelta(days=40), None), ("A", D + timedelta(days=400), 2.0), ("B", D + timedelta(days=5), 7.0)]
    days = [(k, D + timedelta(days=i)) for k in "AB" for i in (-3, 0, 5, 5, 41, 399, 400, 1200)]
    got = calendar.as_of(spark.createDataFrame(days, "asset string, date date"), spark.createDataFrame(slow, "asset string, date date, v double"), "v", key="asset").collect()
    want = []
    for k, d in days:
        known = [v for a, t, v in slow if a == k and t <= d and v is not None]
        want.append((k, d, known[-1] if known else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_fills_by_blocks_equal_the_plain_ones(spark):
    rows = [(a, D + timedelta(days=i), None if (i // 45) % 2 or i < 9 else float(i)) for a in "AB" for i in range(0, 200, 1 + (a == "B"))]
    panel = spark.createDataFrame(rows, "asset string, date date, close double")
    for how in ("ffill", "bfill"):
        plain = by_asset(calendar.fill(panel, ["close"], how), "close")
        for block in (blocks.time_block(), F.trunc("date", "month"), F.col("date")):
            for a, got in by_asset(calendar.fill(panel, ["close"], how, block=block), "close").items():
                close(got, plain[a])


def test_alignment_of_edges(spark):
    """Rows off sessions, repeated days, an asset with no session, and gaps at both ends."""
    day = lambda i: D + timedelta(days=i)
    rows = [("A", day(2), 1.0), ("A", day(2), 2.0), ("A", day(5), 3.0), ("B", day(5), 4.0), ("C", day(1), 5.0), ("C", day(7), None)]
    panel = spark.createDataFrame(rows, "asset string, date date, `a.b` double")
    open_days = spark.createDataFrame([(day(i),) for i in (1, 2, 3, 7)], "date date")
    got = sorted(map(tuple, calendar.align(panel, open_days).collect()), key=str)
    want = [("A", day(1), None), ("A", day(2), 1.0), ("A", day(2), 2.0), ("A", day(3), None), ("A", day(7), None), *(("B", day(i), None) for i in (1, 2, 3, 7)), ("C", day(1), 5.0), ("C", day(2), None), ("C", day(3), None), ("C", day(7), None)]
    assert got == sorted(want, key=str)
    gaps = sorted((r["asset"], r["date"]) for r in calendar.gap_report(panel, open_days).collect())
    assert gaps == sorted([("A", day(1)), ("A", day(3)), ("A", day(7)), *(("B", day(i)) for i in (1, 2, 3, 7)), ("C", day(2)), ("C", day(3))])
    assert queries.c2(spark, SF)._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2


def test_covariances_equal_pandas(spark):
    rng = np.random.default_rng(8)
    table = pd.DataFrame([(a, D + timedelta(days=i), float(rng.normal(0.001, 0.02))) for a in "WXYZ" for i in range(200) if rng.random() > 0.2], columns=["asset", "date", "r"])
    table.loc[::17, "r"] = None
    want = table.pivot(index="date", columns="asset", values="r").cov()
    for block in (None, F.lit(0), F.col("date")):
        for row in strategies.covariances(spark.createDataFrame(table, "asset string, date date, r double"), block=block).collect():
            assert row["cov"] == pytest.approx(want.loc[row["a"], row["b"]], abs=1e-15)


def test_wide_finds_all_assets(spark):
    assert strategies.wide(hot_bars(spark)).columns == ["date", "A", "B"]
    with pytest.raises(ValueError, match="more than 1"):
        strategies.wide(hot_bars(spark), most=1)


def test_dates_are_never_cut(spark):
    import pyarrow as pa

    days = [None, None, 1, 1, 1, 2, 3, 3, 3, 3, 9]
    whole = pa.RecordBatch.from_pydict({"date": pa.array(days, pa.int32()).cast(pa.date32()), "n": list(range(len(days)))})
    for size in range(1, 12):
        made = list(portfolio.whole_dates([whole.slice(0, 0), *(whole.slice(k, size) for k in range(0, len(days), size))]))
        assert sum((b["n"].to_pylist() for b in made), []) == list(range(len(days)))
        held = [set(b["date"].to_pylist()) for b in made]
        assert all(not a & b for k, a in enumerate(held) for b in held[k + 1 :])


def test_a_resumed_run_equals_a_whole_one(spark):
    bars = random_bars(spark, 80, gaps=False).withColumn("bid_ask_spread_corwin_schultz", F.lit(0.004))
    pids = [F.lit(f"p{k}").alias("portfolio_id") for k in range(3)]
    targets = portfolio.target_weights(bars.select(F.explode(F.array(*pids)).alias("portfolio_id"), "date", "asset", F.col("volume").alias("weight")).where("portfolio_id <> 'p2' OR date >= '2024-02-20'"))
    targets = targets.where("NOT (asset = 'B' AND date BETWEEN '2024-01-30' AND '2024-02-05')")  # held, but without a row around the cut
    whole = portfolio.rebalance(targets, bars)
    for cut in ("2024-01-01", "2024-02-01", "2024-02-03"):
        saved = portfolio.rebalance(targets.where(F.col("date") <= cut), bars)
        both = saved.unionByName(portfolio.resume(saved, targets, bars))
        order = ["portfolio_id", "date", "asset"]
        pd.testing.assert_frame_equal(both.toPandas().sort_values(order, ignore_index=True), whole.toPandas().sort_values(order, ignore_index=True))
    one = {(r["asset"], r["cash"]) for r in portfolio.closing(whole, "2024-01-02").where("portfolio_id = 'p0'").collect()}
    assert {a for a, _ in one} == {"A", "B"} and len({c for _, c in one}) == 1
    plan = whole._jdf.queryExecution().executedPlan().toString()
    fold = plan[: plan.index("Exchange hashpartitioning(portfolio_id")]
    assert fold.count("Sort [") == 1 and "date" in re.search(r"Sort \[(.*?)\], false", fold)[1]  # the fold sees rows by date


def test_no_trade_fills_at_the_reference_and_ruin_ends_trading(spark):
    wanted = spark.createDataFrame([("p", D, "A", 0.0)], "portfolio_id string, date date, asset string, weight double")
    quoted = spark.createDataFrame([("A", D, 10.0, 11.0, 0.5)], "asset string, date date, close double, execution_price_t_plus_1_open double, bid_ask_spread_corwin_schultz double")
    row = portfolio.rebalance(wanted, quoted).first()
    assert row["q"] == 0 and row["p_exec"] == 11.0
    assert queries.i8b(spark, SF).where("ruined").count() > 0


def test_landing_keeps_other_assets_and_may_be_repeated(spark):
    path = shared_dir(spark)
    raw = lambda a, v: spark.createDataFrame([(a, "2024-01-02", v)], "asset string, date string, close double")
    assert [tuple(r) for r in provider.land(raw("AAA", 1.0), path, "1").collect()] == [("AAA", 1)]
    for _ in range(2):
        provider.land(raw("BBB", 2.0), path, "2")
    provider.land(raw("AAA", 3.0), path, "3")
    assert sorted((r["asset"], r["close"]) for r in tables.load_parquet(spark, path).collect()) == [("AAA", 3.0), ("BBB", 2.0)]
    assert sorted(map(tuple, provider.commits(spark, path).collect())) == [("1", "AAA", 1), ("2", "BBB", 1), ("3", "AAA", 1)]
    files = spark.createDataFrame([("CCC", "{"), ("DDD", '[{"date":"2024-01-02","open":1,"high":1,"low":1,"close":1}]')], "asset string, payload string")
    landed, bad = provider.land_payloads(files, path, "4")
    assert [r["asset"] for r in landed.collect()] == ["DDD"] and [r["asset"] for r in bad.collect()] == ["CCC"]
    with pytest.raises(ValueError, match="folders"):
        tables.save_parquet(raw("A", 1.0), path, keep=True)


def test_checks_ride_on_a_write(spark):
    rows = [("A", D, 1.0), ("A", D, -2.0), ("A", D + timedelta(days=1), None), ("CASH", D, 1.0)]
    panel = spark.createDataFrame(rows, "asset string, date date, close double")
    out, counts = checks.watched(panel, ["close"], "CASH")
    path = shared_dir(spark)
    tables.save_parquet(out, path, by="asset")
    assert counts() == {"n_rows": 4, "n_duplicates": 1, "n_negative": 1, "n_absent": 1}
    assert tables.load_parquet(spark, path).count() == 4
    with pytest.raises(ValueError, match="1 duplicate keys; 1 rows with a negative value; 1 rows of an asset"):
        checks.require_clean(counts())
    fine, told = checks.watched(panel.where("close > 0"), ["close"])
    fine.write.format("noop").mode("overwrite").save()
    checks.require_clean(told())


def test_large_files_are_hashed_by_stream(spark, tmp_path):
    for k, size in enumerate((1, 5, 3_000_000)):
        (tmp_path / f"f{k}").write_bytes(bytes(range(256)) * (size // 256) + b"x" * (size % 256))
    want = sorted(hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir())
    for most in (-1, 10, 1 << 30):
        assert sorted(r["sha256"] for r in manifest.sha256_files(spark, str(tmp_path), most).collect()) == want
