"""Every operator over the given tables, with the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions import columns as C
from barline.operators import calendar as cal
from barline.operators import blocks, cash, checks, execution, features, indicators, kpis, normalize, portfolio, strategies
from barline.plans import clean, sql
from barline.sources import fixtures, manifest, provider, tables
from barline.sources.scratch import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
PAIR = ("AF", "RO")


def cut(value: Column | str, digits: int) -> Column:
    """A value on a decimal grid, set off from the usual ties so that rounding errors do not show."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value * 10.0**digits + 0.3) / 10.0**digits


def registered(name: str, body: str | None = None, *needs: str, extra: dict[str, str] | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if body is not None:
            ORACLE[name] = sql.query(body, *needs, extra=extra)
        return f

    return add


def _cuts(df: DataFrame, keys: list[str], digits: dict[str, int]) -> DataFrame:
    return df.select(*keys, *(cut(F.col(f"`{c}`"), d).alias(c) for c, d in digits.items()))


def _sql_cuts(keys: str, digits: dict[str, tuple[str, int]]) -> str:
    return f"SELECT {keys}, " + ", ".join(f"{sql.cut(e, d)} AS {c}" for c, (e, d) in digits.items())


KEYS = ["asset", "date"]
bars = fixtures.bars


def panel(s: SparkSession, d: str) -> DataFrame:
    b = bars(s, d)
    return cal.align(b, cal.sessions_of(b))


def held_panel(s: SparkSession, d: str) -> DataFrame:
    """The panel from bars that are written once, as it reads them three times."""
    b = written(bars(s, d))
    return cal.align(b, cal.sessions_of(b))


def returns(s: SparkSession, d: str) -> DataFrame:
    return features.log_return(bars(s, d), out="r").where("r IS NOT NULL")


def market_returns(s: SparkSession, d: str) -> DataFrame:
    r = returns(s, d)
    return r.join(r.groupBy("date").agg(F.avg("r").alias("m")), "date")


def risk_free(s: SparkSession, d: str) -> DataFrame:
    return cal.risk_free_on(fixtures.rates(s, d), cal.sessions_of(bars(s, d)))


# A. Sources, sinks, metadata


@registered("a1_load_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def a1(s, d):
    return tables.load_parquet(s, f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")


@registered("a2_save_by_asset", "SELECT asset, date, open, close FROM bars", "bars")
def a2(s, d):
    path = shared_dir(s)
    tables.save_parquet(bars(s, d), path, by="asset")
    return tables.load_parquet(s, path).select("asset", "date", "open", "close")


def _month_files(s: SparkSession, d: str) -> DataFrame:
    """Bars as provider payloads, one for each asset and month, so none grows with the history."""
    day = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", F.col("close").alias("adjClose"), F.col("volume").cast("bigint").alias("volume"), F.lit(0.0).alias("divCash"), F.lit(1.0).alias("splitFactor"))
    return bars(s, d).groupBy("asset", F.trunc("date", "month").alias("month")).agg(F.to_json(F.collect_list(day)).alias("payload"))


_RAW_SQL = "SELECT date, asset, open, high, low, close, close AS adj_close, volume, 0.0::DOUBLE AS dividends, 1.0::DOUBLE AS stock_splits FROM bars"


@registered("a3_equity_json", _RAW_SQL, "bars")
def a3(s, d):
    return normalize.normalize(provider.equity_bars(_month_files(s, d)))


@registered("a4_crypto_json", "SELECT asset, date, close, volume FROM bars", "bars")
def a4(s, d):
    files = _month_files(s, d).withColumn("payload", F.concat(F.lit('[{"priceData":'), "payload", F.lit("}]")))
    return provider.crypto_bars(files).select("asset", normalize.parse_date(F.col("date")).alias("date"), "close", "volume")


def _broken(s: SparkSession, d: str) -> DataFrame:
    return _month_files(s, d).withColumn("payload", F.when(F.col("asset") == "NF", "{broken").otherwise(F.col("payload")))


@registered("a5_land_batch", "SELECT asset, date, open, high, low, close, volume FROM bars WHERE asset <> 'NF'", "bars")
def a5(s, d):
    """The rows of a table after two batches, one of which was landed twice; one asset's payloads cannot be read."""
    path, files = shared_dir(s), written(_broken(s, d))
    early = files.where(F.col("asset") < "O")
    for batch, part in (("1", early), ("2", files.where(F.col("asset") >= "O")), ("1", early)):
        provider.land_payloads(part, path, batch)
    rows = tables.load_parquet(s, path)
    return rows.select("asset", normalize.parse_date(F.col("date")).alias("date"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))


@registered("a5_commits", "SELECT CASE WHEN asset < 'O' THEN '1' ELSE '2' END AS batch, asset, count(*) AS n_rows, CASE WHEN asset = 'NF' THEN 'rejected' ELSE 'landed' END AS state FROM bars WHERE asset <> 'NF' GROUP BY asset UNION ALL SELECT '1', 'NF', NULL, 'rejected'", "bars")
def a5c(s, d):
    """What the batches of a table landed and rejected."""
    path, files = shared_dir(s), written(_broken(s, d))
    bad = []
    for batch, part in (("1", files.where(F.col("asset") < "O")), ("2", files.where(F.col("asset") >= "O"))):
        bad.append(provider.land_payloads(part, path, batch)[1].select(F.lit(batch).alias("batch"), "asset", F.lit(None).cast("long").alias("n_rows"), F.lit("rejected").alias("state")))
    return provider.commits(s, path).withColumn("state", F.lit("landed")).unionByName(bad[0]).unionByName(bad[1])


@registered("a6_rate_json", "SELECT date, CASE WHEN day(date) % 5 <> 0 THEN percent END AS percent FROM rates", "rates")
def a6(s, d):
    value = F.when(F.dayofmonth("date") % 5 == 0, ".").otherwise(F.col("percent").cast("string"))
    months = fixtures.rates(s, d).groupBy(F.trunc("date", "month").alias("month")).agg(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), value.alias("value"))).alias("observations"))
    return provider.observations(months.select(F.to_json(F.struct("observations")).alias("payload")))


@registered("a7_file_summary", "SELECT count(*) AS n_rows, CAST(7 AS BIGINT) AS n_cols, CAST(min(date) AS VARCHAR) AS date_min, CAST(max(date) AS VARCHAR) AS date_max FROM bars", "bars")
def a7(s, d):
    path = shared_dir(s)
    tables.save_parquet(bars(s, d), path)
    return manifest.file_summary(s, path).select("n_rows", "n_cols", "date_min", "date_max")


@registered("a8_sha256_files")
def a8(s, d):
    return manifest.sha256_files(s, f"{d}/lineitem.parquet").select("sha256")


@registered("a8_table_digest", "SELECT sha256(string_agg(digest, '' ORDER BY block)) AS sha256 FROM (SELECT o_orderkey // 4096 AS block, sha256(string_agg(sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus), '' ORDER BY o_orderkey, o_custkey, o_orderstatus)) AS digest FROM orders GROUP BY 1)")
def a8d(s, d):
    return manifest.table_digest(fixtures.table(s, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], F.floor(F.col("o_orderkey") / 4096))


_SUMMARY = "count(*) AS {0}_rows, CAST({1} AS BIGINT) AS {0}_cols, CAST(min(date) AS VARCHAR) AS {0}_from, CAST(max(date) AS VARCHAR) AS {0}_to, CAST(64 AS INTEGER) AS {0}_hash_length"


@registered(
    "a9_manifest",
    "SELECT 'clean' AS stage, 'v2' AS dataset_id, '2024-01-01T00:00:00+00:00' AS created_at, 'abc1234' AS git_commit, 'XNYS' AS calendar, '1992-01-01' AS start, '4' AS engine, i.*, o.* "
    f"FROM (SELECT {_SUMMARY.format('input', 2)} FROM rates) i, (SELECT {_SUMMARY.format('output', 7)} FROM bars) o",
    "bars",
    "rates",
)
def a9(s, d):
    """The manifest of a stage that read rates and wrote bars, both as files, laid out flat."""
    source, target = shared_dir(s), shared_dir(s)
    tables.save_parquet(fixtures.rates(s, d), source)
    tables.save_parquet(bars(s, d), target)
    row = manifest.manifest("clean", manifest.file_summary(s, source), manifest.file_summary(s, target), {"start": "1992-01-01"}, {"engine": "4"}, "v2", "2024-01-01T00:00:00+00:00", "abc1234")
    side = lambda name: [F.col(f"{name}s")[0][c].alias(f"{name}_{n}") for n, c in (("rows", "n_rows"), ("cols", "n_cols"), ("from", "date_min"), ("to", "date_max"))] + [F.length(F.col(f"{name}s")[0]["sha256"]).alias(f"{name}_hash_length")]
    return row.select("stage", "dataset_id", "created_at", "git_commit", "calendar", F.col("spec")["start"].alias("start"), F.col("env")["engine"].alias("engine"), *side("input"), *side("output"))


@registered("a10_universe", "SELECT upper(trim(n_name)) AS asset, min(n_nationkey) AS ord FROM nation GROUP BY 1")
def a10(s, d):
    return provider.universe(fixtures.table(s, d, "nation").select(F.col("n_name").alias("asset"), F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("ord")))


@registered("a11_one_asset", "SELECT date, close FROM bars WHERE asset = 'AF'", "bars")
def a11(s, d):
    return tables.one_asset(bars(s, d), "AF").select("date", "close")


# B. Normalization


@registered("b1_rename", "SELECT asset, date, close AS adj_close, volume AS stock_splits, open AS first_price FROM bars", "bars")
def b1(s, d):
    return normalize.rename(bars(s, d).select("asset", "date", F.col("close").alias(" adjClose "), F.col("volume").alias("splitFactor"), F.col("open").alias("First-Price")))


@registered("b2_parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders")
def b2(s, d):
    text = F.when(F.col("o_orderkey") % 7 == 0, "junk").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return fixtures.table(s, d, "orders").select("o_orderkey", normalize.parse_date(text).alias("date"))


@registered("b3_date_range", "SELECT asset, date, close FROM bars WHERE date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'", "bars")
def b3(s, d):
    return bars(s, d).where(cal.between(F.col("date"), "1994-01-01", "1995-12-31")).select("asset", "date", "close")


@registered("b4_keep_fields", "SELECT date, asset, close, volume FROM bars", "bars")
def b4(s, d):
    return normalize.keep_fields(bars(s, d), ["close", "volume", "dividends"])


@registered("b5_required_fields", "SELECT date, asset, open, high, low, close FROM bars", "bars")
def b5(s, d):
    b = bars(s, d)
    checks.require_columns(b, normalize.BASE)
    return normalize.keep_fields(b, normalize.BASE)


@registered("b6_defaults", "SELECT asset, date, close AS adj_close, 0.0::DOUBLE AS dividends, 1.0::DOUBLE AS stock_splits, 0.0::DOUBLE AS volume FROM bars", "bars")
def b6(s, d):
    return normalize.with_defaults(bars(s, d).drop("volume")).select("asset", "date", "adj_close", "dividends", "stock_splits", "volume")


@registered("b7_ticker", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN upper(event_type) || 'USD' ELSE upper(event_type) || '-EUR' END AS asset FROM events")
def b7(s, d):
    name = F.concat("event_type", F.when(F.col("user_id") % 2 == 0, "-usd").otherwise("-eur"))
    return fixtures.table(s, d, "events").select("event_id", normalize.ticker(name).alias("asset"))


@registered("b8_crypto_flag", "SELECT asset || CASE WHEN open > close THEN 'USD' ELSE '' END AS asset, date, asset = 'AF' AND open <= close OR open > close AS is_crypto FROM bars", "bars")
def b8(s, d):
    b = bars(s, d)
    listed = b.select("asset").distinct().withColumn("is_crypto", F.col("asset") == "AF")
    named = b.withColumn("asset", F.concat("asset", F.when(F.col("open") > F.col("close"), "USD").otherwise("")))
    return normalize.crypto_flag(named, listed).select("asset", "date", "is_crypto")


@registered("b9_stack", "SELECT asset, date, close, volume FROM bars UNION ALL SELECT event_type, CAST(ts AS DATE), arg_max(value, ts), NULL FROM events WHERE value IS NOT NULL GROUP BY 1, 2", "bars")
def b9(s, d):
    daily = cal.daily_last(fixtures.ticks(s, d), ["price"]).withColumnRenamed("price", "close")
    return normalize.stack([bars(s, d), daily]).select("asset", "date", "close", "volume")


@registered("b10_ordered", "SELECT date, asset, close FROM bars ORDER BY date, asset", "bars")
def b10(s, d):
    return normalize.ordered(bars(s, d).select("date", "asset", "close"))


@registered("b11_keep_last", "SELECT o_custkey, o_orderstatus, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def b11(s, d):
    return normalize.keep_last(fixtures.table(s, d, "orders"), "o_orderkey", ("o_custkey", "o_orderstatus")).select("o_custkey", "o_orderstatus", "o_orderkey")


@registered("b12_downcast", "SELECT asset, date, CAST(close AS FLOAT) AS close, CAST(1 AS TINYINT) AS is_cash, CAST(CAST(volume AS INTEGER) AS BIGINT) AS volume FROM bars", "bars")
def b12(s, d):
    return normalize.downcast(bars(s, d).select("asset", "date", "close", F.lit(1).alias("is_cash"), F.col("volume").cast("int").alias("volume")))


@registered("b13_guards", "SELECT asset, count(*) AS n FROM bars GROUP BY asset", "bars")
def b13(s, d):
    b = bars(s, d)
    checks.require_columns(b, KEYS)
    checks.require_no_asset(b, "CASH")
    return b.groupBy("asset").agg(F.count("*").alias("n"))


@registered(
    "b13_watched_write",
    "SELECT count(*) AS n_rows, count(*) FILTER (again) AS n_duplicates, count(*) FILTER (volume < 300) AS n_negative, count(*) FILTER (asset = 'NF') AS n_absent FROM (SELECT *, coalesce(date = lag(date) OVER (PARTITION BY asset ORDER BY date), false) AS again FROM (SELECT asset, CASE WHEN day(date) = 2 THEN date - 1 ELSE date END AS date, volume FROM bars))",
    "bars",
)
def b13w(s, d):
    """Counts of faults that the tasks of a write gathered: days moved onto others, volumes under 300, one asset."""
    moved = bars(s, d).select("asset", F.when(F.dayofmonth("date") == 2, F.date_sub("date", 1)).otherwise(F.col("date")).alias("date"), (F.col("volume") - 300).alias("volume"))
    checked, counts = checks.watched(moved, ["volume"], "NF")
    tables.save_parquet(checked, shared_dir(s), by="asset")
    return s.createDataFrame([counts()], "n_rows long, n_duplicates long, n_negative long, n_absent long")


# C. Calendar, alignment, gap filling, checks


@registered("c1_sessions", "SELECT date FROM sess WHERE date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 50 = 0)", "sess")
def c1(s, d):
    closed = fixtures.table(s, d, "orders").where("o_orderkey % 50 = 0").select(F.to_date("o_orderdate").alias("date")).distinct()
    return cal.sessions_of(bars(s, d), closed)


@registered("c2_align", "SELECT asset, date, close, volume FROM panel", "panel")
def c2(s, d):
    return panel(s, d).select("asset", "date", "close", "volume")


@registered(
    "c3_daily_last",
    """SELECT a.asset, s.date, v.price FROM (SELECT DISTINCT event_type AS asset FROM events) a CROSS JOIN
    (SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS d FROM events) WHERE isodow(d) < 6) s
    LEFT JOIN (SELECT event_type AS asset, CAST(ts AS DATE) AS date, arg_max(value, ts) AS price FROM events WHERE value IS NOT NULL GROUP BY 1, 2) v ON a.asset = v.asset AND s.date = v.date""",
)
def c3(s, d):
    daily = cal.daily_last(fixtures.ticks(s, d), ["price"])
    return cal.align(daily, cal.sessions_of(daily)).select("asset", "date", "price")


@registered("c4_forward_fill", "SELECT asset, date, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date) AS close FROM panel", "panel")
def c4(s, d):
    return cal.fill(panel(s, d), ["close"], block=blocks.time_block()).select("asset", "date", "close")


@registered("c5_backward_fill", "SELECT asset, date, first_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM panel", "panel")
def c5(s, d):
    return cal.fill(panel(s, d), ["close"], "bfill", block=blocks.time_block()).select("asset", "date", "close")


@registered("c6_risk_free", f"SELECT date, {sql.cut('risk_free_annual', 8)} AS risk_free_annual FROM rf", "rf")
def c6(s, d):
    return _cuts(risk_free(s, d), ["date"], {"risk_free_annual": 8})


@registered("c7_as_of", f"SELECT s.date, {sql.cut('m.percent', 6)} AS percent FROM sess s ASOF LEFT JOIN (SELECT date_trunc('month', date)::DATE AS date, avg(percent) AS percent FROM rates GROUP BY 1) m ON s.date >= m.date", "sess", "rates")
def c7(s, d):
    monthly = cal.month_starts(fixtures.rates(s, d), "percent")
    return _cuts(cal.as_of(cal.sessions_of(bars(s, d)), monthly, "percent"), ["date"], {"percent": 6})


@registered("c8_gap_report", "SELECT p.asset, p.date FROM panel p WHERE close IS NULL", "panel")
def c8(s, d):
    b = bars(s, d)
    return cal.gap_report(b, cal.sessions_of(b))


@registered("c9_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def c9(s, d):
    return checks.duplicate_keys(fixtures.table(s, d, "lineitem"), ("l_orderkey", "l_linenumber"))


@registered("c10_negative_rows", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def c10(s, d):
    return checks.negative_rows(fixtures.table(s, d, "customer"), ["c_acctbal"]).select("c_custkey", "c_acctbal")


@registered("c11_one_sided_dates", "SELECT coalesce(a.date, b.date) AS date, CASE WHEN b.date IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT date FROM bars) a FULL JOIN (SELECT DISTINCT date FROM rates) b ON a.date = b.date WHERE a.date IS NULL OR b.date IS NULL", "bars", "rates")
def c11(s, d):
    return checks.one_sided_dates(bars(s, d), fixtures.rates(s, d))


@registered("c12_column_contract", "SELECT count(*) AS n, 'adj_close,dividends,stock_splits' AS missing FROM bars", "bars")
def c12(s, d):
    b = bars(s, d)
    return b.agg(F.count("*").alias("n")).withColumn("missing", F.lit(",".join(checks.missing_columns(b, normalize.FIELDS))))


@registered("c13_common_dates", "SELECT asset, date, close FROM panel WHERE date IN (SELECT date FROM panel GROUP BY date HAVING count(close) = (SELECT count(DISTINCT asset) FROM panel))", "panel")
def c13(s, d):
    return cal.common_dates(panel(s, d), "close").select("asset", "date", "close")


@registered("c14_present_sessions", "SELECT DISTINCT date FROM bars", "bars")
def c14(s, d):
    return cal.present_sessions(bars(s, d))


# D. Core features


@registered("d1_log_return", _sql_cuts("asset, date", {"r": ("ln(close / lag(close) OVER (PARTITION BY asset ORDER BY date))", 8)}) + " FROM bars", "bars")
def d1(s, d):
    return _cuts(features.log_return(bars(s, d), out="r"), KEYS, {"r": 8})


@registered("d2_linear_return", _sql_cuts("asset, date", {"r": ("f / lag(f) OVER (PARTITION BY asset ORDER BY date) - 1", 8)}) + " FROM (SELECT asset, date, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date) AS f FROM panel)", "panel")
def d2(s, d):
    return _cuts(features.linear_return(panel(s, d), out="r"), KEYS, {"r": 8})


_W = "OVER (PARTITION BY asset ORDER BY date ROWS {} PRECEDING)"


def _rolled(aggregate: str, value: str, n: int, least: int | None = None) -> str:
    frame = _W.format(n - 1)
    return f"CASE WHEN count({value}) {frame} >= {n if least is None else least} THEN {aggregate}({value}) {frame} END"


@registered("d3_dollar_volume", _sql_cuts("asset, date", {"adv": (_rolled("avg", "close * volume", 20), 2)}) + " FROM panel", "panel")
def d3(s, d):
    return _cuts(blocks.in_blocks(panel(s, d), lambda p: features.dollar_volume(p, 20, "adv"), 19), KEYS, {"adv": 2})


@registered("d4_spread_beta", _sql_cuts("asset, date", {"beta": (_rolled("avg", "beta", 3), 6)}) + " FROM terms", "terms")
def d4(s, d):
    return _cuts(blocks.in_blocks(bars(s, d), lambda p: features.spread_terms(p, 3), 3).withColumnRenamed("spread_beta", "beta"), KEYS, {"beta": 6})


@registered("d5_spread_gamma", _sql_cuts("asset, date", {"gamma": ("gamma", 6)}) + " FROM terms", "terms")
def d5(s, d):
    return _cuts(blocks.in_blocks(bars(s, d), features.spread_terms, 1).withColumnRenamed("spread_gamma", "gamma"), KEYS, {"gamma": 6})


@registered("d6_spread_alpha", _sql_cuts("asset, date", {"alpha": ("alpha", 6)}) + " FROM spreads", "spreads")
def d6(s, d):
    return _cuts(features.spread_terms(bars(s, d)).withColumn("alpha", features.spread_alpha(F.col("spread_beta"), F.col("spread_gamma"))), KEYS, {"alpha": 6})


@registered("d7_spread", _sql_cuts("asset, date", {"spread": ("spread", 6)}) + " FROM spreads", "spreads")
def d7(s, d):
    return _cuts(features.spread_estimates(bars(s, d)).withColumnRenamed("bid_ask_spread_corwin_schultz", "spread"), KEYS, {"spread": 6})


@registered("d8_range_volatility", _sql_cuts("asset, date", {"sigma": ("sigma", 6)}) + " FROM spreads", "spreads")
def d8(s, d):
    return _cuts(features.spread_estimates(bars(s, d)).withColumnRenamed("volatility_becker_parkinson", "sigma"), KEYS, {"sigma": 6})


@registered("d9_next_open", "SELECT asset, date, next_open FROM spreads", "spreads")
def d9(s, d):
    return features.next_open(bars(s, d), "next_open").select("asset", "date", "next_open")


@registered("d10_daily_rate", _sql_cuts("date", {"rate_360": ("percent / 100 / 360", 10), "rate_365": ("percent / 100 / 365", 10)}) + " FROM rates", "rates")
def d10(s, d):
    return fixtures.rates(s, d).select("date", cut(features.daily_rate(F.col("percent")), 10).alias("rate_360"), cut(features.daily_rate(F.col("percent"), 365), 10).alias("rate_365"))


@registered("d11_daily_factor", _sql_cuts("date", {"factor": ("1 + percent / 100 / 360", 10)}) + " FROM rates", "rates")
def d11(s, d):
    return fixtures.rates(s, d).select("date", cut(features.daily_factor(F.col("percent")), 10).alias("factor"))


# E. Indicators


@registered("e1_rolling", _sql_cuts("asset, date", {"mean": (_rolled("avg", "close", 20, 5), 3)}) + " FROM panel", "panel")
def e1(s, d):
    return _cuts(blocks.in_blocks(panel(s, d), lambda p: p.withColumn("mean", C.rolling(F.avg("close"), F.col("close"), 20, least=5)), 19), KEYS, {"mean": 3})


@registered("e2_sma", _sql_cuts("asset, date", {"sma": (_rolled("avg", "close", 20), 3)}) + " FROM panel", "panel")
def e2(s, d):
    return _cuts(blocks.in_blocks(panel(s, d), lambda p: p.withColumn("sma", indicators.sma(F.col("close"), 20)), 19, rows=500), KEYS, {"sma": 3})


def _ema(name: str, value: str, span: int, source: str = "panel") -> dict[str, str]:
    return sql.smoothed(name, source, value, f"(2.0::DOUBLE / {span + 1})")


def _wilder(name: str, value: str, source: str = "panel_moves", n: int = 14) -> dict[str, str]:
    return sql.smoothed(name, source, value, f"(1.0::DOUBLE / {n})")


def _on(source: str, *names: str) -> str:
    return f"FROM {source} b" + "".join(f" LEFT JOIN {n} ON b.asset = {n}.asset AND b.date = {n}.date" for n in names)


@registered("e3_ema", _sql_cuts("b.asset, b.date", {"ema": ("CASE WHEN e12.rn >= 12 THEN e12.y END", 3)}) + " " + _on("panel", "e12"), "panel", extra=_ema("e12", "close", 12))
def e3(s, d):
    return _cuts(indicators.ema(held_panel(s, d), 12, out="ema"), KEYS, {"ema": 3})


_RSI = "CASE WHEN up14.rn >= 14 THEN 100 - 100 / (1 + up14.y / nullif(down14.y, 0)) END"


@registered("e4_rsi", _sql_cuts("b.asset, b.date", {"relative_strength_index_14": (_RSI, 4)}) + " " + _on("panel", "up14", "down14"), "panel_moves", extra=_wilder("up14", "up") | _wilder("down14", "down"))
def e4(s, d):
    return _cuts(indicators.rsi(held_panel(s, d)), KEYS, {"relative_strength_index_14": 4})


def _macd(source: str) -> dict[str, str]:
    line = "SELECT e12.asset, e12.date, CASE WHEN e26.rn >= 26 THEN e12.y - e26.y END AS v FROM e12 JOIN e26 ON e12.asset = e26.asset AND e12.date = e26.date"
    return _ema("e12", "close", 12, source) | _ema("e26", "close", 26, source) | {"line": line} | _ema("sig", "v", 9, "line")


_SIGNAL = "CASE WHEN sig.rn >= 9 THEN sig.y END"


@registered("e5_macd", _sql_cuts("b.asset, b.date", {"macd_line_12_26_9": ("line.v", 3), "macd_signal_12_26_9": (_SIGNAL, 3), "macd_histogram_12_26_9": (f"line.v - {_SIGNAL}", 3)}) + " " + _on("panel", "line", "sig"), "panel", extra=_macd("panel"))
def e5(s, d):
    return _cuts(indicators.macd(held_panel(s, d)), KEYS, {"macd_line_12_26_9": 3, "macd_signal_12_26_9": 3, "macd_histogram_12_26_9": 3})


_MID, _STD = _rolled("avg", "close", 20), _rolled("stddev_samp", "close", 20)
_BANDS = {"bollinger_middle_band_20_2_0": ("mid", 3), "bollinger_upper_band_20_2_0": ("mid + 2 * sd", 3), "bollinger_lower_band_20_2_0": ("mid - 2 * sd", 3), "bollinger_bandwidth_20_2_0": ("4 * sd / nullif(mid, 0)", 6)}


@registered("e6_bollinger", _sql_cuts("asset, date", _BANDS) + f" FROM (SELECT asset, date, {_MID} AS mid, {_STD} AS sd FROM panel)", "panel")
def e6(s, d):
    return _cuts(blocks.in_blocks(panel(s, d), indicators.bollinger, 19), KEYS, {k: v for k, (_, v) in _BANDS.items()})


_CCI = "(SELECT asset, date, tp, CASE WHEN len(xs) = 20 THEN list_avg(xs) END AS m, xs FROM (SELECT asset, date, (high + low + close) / 3 AS tp, list((high + low + close) / 3) " + _W.format(19) + " AS xs FROM bars))"


@registered("e7_cci", _sql_cuts("asset, date", {"commodity_channel_index_20": ("(tp - m) / nullif(0.015 * list_avg(list_transform(xs, lambda x: abs(x - m))), 0)", 4)}) + f" FROM {_CCI}", "bars")
def e7(s, d):
    return _cuts(blocks.in_blocks(bars(s, d), indicators.cci, 19), KEYS, {"commodity_channel_index_20": 4})


def _adx(source: str) -> dict[str, str]:
    smooth = _wilder("tr14", "tr", source) | _wilder("pl14", "plus", source) | _wilder("mi14", "minus", source)
    di = "SELECT tr14.asset, tr14.date, CASE WHEN tr14.rn >= 14 THEN 100 * pl14.y / nullif(tr14.y, 0) END AS pdi, CASE WHEN tr14.rn >= 14 THEN 100 * mi14.y / nullif(tr14.y, 0) END AS mdi FROM tr14 JOIN pl14 ON tr14.asset = pl14.asset AND tr14.date = pl14.date JOIN mi14 ON tr14.asset = mi14.asset AND tr14.date = mi14.date"
    return smooth | {"di": di, "dx": "SELECT asset, date, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS v FROM di"} | _wilder("adx", "v", "dx")


_ADX_CUTS = {"average_directional_index_14": ("CASE WHEN adx.rn >= 14 THEN adx.y END", 4), "positive_directional_index_14": ("di.pdi", 4), "negative_directional_index_14": ("di.mdi", 4)}


@registered("e8_adx", _sql_cuts("b.asset, b.date", _ADX_CUTS) + " " + _on("panel", "di", "adx"), "panel_moves", extra=_adx("panel_moves"))
def e8(s, d):
    return _cuts(indicators.adx(held_panel(s, d)), KEYS, {k: v for k, (_, v) in _ADX_CUTS.items()})


# F. Cash and the clean panel


def _accrued(s: SparkSession, d: str) -> DataFrame:
    return cash.accrual(bars(s, d).select("date").distinct().join(risk_free(s, d), "date", "left"))


@registered("f1_days_to_next", "SELECT date, CAST(days_to_next AS INTEGER) AS days_to_next FROM accrued", "accrued")
def f1(s, d):
    return _accrued(s, d).select("date", "days_to_next")


@registered("f2_accrual_factor", _sql_cuts("date", {"factor": ("factor", 8)}) + " FROM accrued", "accrued")
def f2(s, d):
    return _cuts(_accrued(s, d), ["date"], {"factor": 8})


@registered("f3_cash_close", _sql_cuts("date", {"close": ("close", 6)}) + " FROM accrued", "accrued")
def f3(s, d):
    return _cuts(cash.cash_close(_accrued(s, d)), ["date"], {"close": 6})


_CASH_BARS = "(SELECT date, open, close, CASE WHEN close IS NOT NULL THEN greatest(open, close) END AS high, CASE WHEN close IS NOT NULL THEN least(open, close) END AS low, log_factor FROM (SELECT *, coalesce(lag(close) OVER (ORDER BY date), 1.0) AS open FROM accrued))"


@registered("f4_cash_bars", _sql_cuts("date", {c: (c, 6) for c in ("open", "high", "low", "close")}) + f" FROM {_CASH_BARS}", "accrued")
def f4(s, d):
    return _cuts(cash.cash_bars(_accrued(s, d)), ["date"], {c: 6 for c in ("open", "high", "low", "close")})


@registered("f5_cash_rows", _sql_cuts("date, 'CASH' AS asset, CAST(NULL AS DOUBLE) AS simple_moving_average_20, 0.0::DOUBLE AS volume, 1 AS is_cash", {"adj_close": ("close", 6), "daily_return_log": ("log_factor", 8), "execution_price_t_plus_1_open": ("lead(open) OVER (ORDER BY date)", 6)}) + f" FROM {_CASH_BARS}", "accrued")
def f5(s, d):
    days = bars(s, d).select("date").distinct().join(risk_free(s, d), "date", "left")
    rows = cash.cash_rows(days, clean.COLUMNS)
    return _cuts(rows, ["date", "asset", "simple_moving_average_20", "volume", "is_cash"], {"adj_close": 6, "daily_return_log": 8, "execution_price_t_plus_1_open": 6})


def clean_panel(s: SparkSession, d: str) -> DataFrame:
    held = written(bars(s, d))  # read three times: for the panel, its days and their bounds
    rates = cal.risk_free_on(fixtures.rates(s, d), cal.sessions_of(held))
    return clean.clean_panel(held, rates)


def _clean_sql() -> tuple[str, dict[str, tuple[str, int]]]:
    """SQL of every column of the clean panel, and the digits that hold in single precision."""
    on_b = lambda piece: piece.replace("PARTITION BY asset ORDER BY date", "PARTITION BY b.asset ORDER BY b.date")
    rolled = lambda aggregate, value, n: on_b(_rolled(aggregate, value, n))
    mid, sd = rolled("avg", "b.close", 20), rolled("stddev_samp", "b.close", 20)
    columns = {
        "open": ("b.open", 3), "high": ("b.high", 3), "low": ("b.low", 3), "close": ("b.close", 3), "adj_close": ("b.close", 3), "volume": ("b.volume", 3), "dividends": ("0.0::DOUBLE", 3), "stock_splits": ("1.0::DOUBLE", 3),
        "daily_return_log": (on_b("ln(b.close / lag(b.close) OVER (PARTITION BY asset ORDER BY date))"), 5), "average_dollar_volume_20": (rolled("avg", "b.close * b.volume", 20), 0), "volatility_becker_parkinson": ("s.sigma", 5), "bid_ask_spread_corwin_schultz": ("s.spread", 5),
        "simple_moving_average_20": (mid, 3), "simple_moving_average_60": (rolled("avg", "b.close", 60), 3), "exponential_moving_average_12": ("CASE WHEN e12.rn >= 12 THEN e12.y END", 3), "exponential_moving_average_26": ("CASE WHEN e26.rn >= 26 THEN e26.y END", 3), "relative_strength_index_14": (_RSI, 3),
        "macd_line_12_26_9": ("line.v", 3), "macd_signal_12_26_9": (_SIGNAL, 3), "macd_histogram_12_26_9": (f"line.v - {_SIGNAL}", 3),
        "bollinger_middle_band_20_2_0": (mid, 3), "bollinger_upper_band_20_2_0": (f"{mid} + 2 * {sd}", 3), "bollinger_lower_band_20_2_0": (f"{mid} - 2 * {sd}", 3), "bollinger_bandwidth_20_2_0": (f"4 * {sd} / nullif({mid}, 0)", 5),
        "commodity_channel_index_20": ("(cci.tp - cci.m) / nullif(0.015 * list_avg(list_transform(cci.xs, lambda x: abs(x - cci.m))), 0)", 3), **{c: (v, 3) for c, (v, _) in _ADX_CUTS.items()},
        "execution_price_t_plus_1_open": ("s.next_open", 3),
    }
    single = {c: (f"CAST({v} AS FLOAT)::DOUBLE", n) for c, (v, n) in columns.items()}
    held = {"open": "open", "high": "high", "low": "low", "close": "close", "adj_close": "close", "volume": "0.0", "dividends": "0.0", "stock_splits": "1.0", "daily_return_log": "log_factor", "average_dollar_volume_20": "0.0", "volatility_becker_parkinson": "0.0", "bid_ask_spread_corwin_schultz": "0.0", "execution_price_t_plus_1_open": "lead(open) OVER (ORDER BY date)"}
    cash_row = {c: (f"CAST({held.get(c, 'NULL')} AS FLOAT)::DOUBLE", n) for c, (_, n) in columns.items()}
    joined = _on("bars", "e12", "e26", "line", "sig", "up14", "down14", "di", "adx") + f" JOIN spreads s ON b.asset = s.asset AND b.date = s.date JOIN {_CCI} cci ON b.asset = cci.asset AND b.date = cci.date"
    return _sql_cuts("b.asset, b.date, CAST(0 AS TINYINT) AS is_cash", single) + f" {joined} UNION ALL BY NAME " + _sql_cuts("'CASH' AS asset, date, CAST(1 AS TINYINT) AS is_cash", cash_row) + f" FROM {_CASH_BARS}", columns


_CLEAN_SQL, _CLEAN = _clean_sql()


@registered("f6_clean_panel", _CLEAN_SQL, "moves", "spreads", "accrued", extra=_macd("bars") | _wilder("up14", "up", "moves") | _wilder("down14", "down", "moves") | _adx("moves"))
def f6(s, d):
    p = clean_panel(s, d)
    return p.select("asset", "date", "is_cash", *(cut(F.col(c).cast("double"), n).alias(c) for c, (_, n) in _CLEAN.items()))


# G. Portfolio metrics, an asset being a portfolio


def _metric(name: str, body: str, make: Callable[[], Column], digits: int = 6) -> None:
    short = name.split("_", 1)[1]

    @registered(name, f"SELECT asset, {sql.cut(body, digits)} AS {short} FROM retm GROUP BY asset", "retm")
    def run(s, d):
        return market_returns(s, d).groupBy("asset").agg(cut(make(), digits).alias(short))


RATE = 0.03
_BETA = "covar_samp(r, m) / nullif(var_samp(m), 0)"
_metric("g1_annual_return", "avg(r) * 252", lambda: kpis.annual_return(F.col("r")))
_metric("g2_annual_volatility", "stddev_samp(r) * sqrt(252)", lambda: kpis.annual_volatility(F.col("r")))
_metric("g3_sharpe", "avg(r - 0.03 / 252) / stddev_samp(r) * sqrt(252)", lambda: kpis.sharpe(F.col("r"), RATE))
_metric("g4_sortino", "avg(r - 0.03 / 252) / stddev_samp(CASE WHEN r - 0.03 / 252 < 0 THEN r - 0.03 / 252 END) * sqrt(252)", lambda: kpis.sortino(F.col("r"), RATE))
_metric("g7_beta", _BETA, lambda: kpis.beta(F.col("r"), F.col("m")))
_metric("g8_jensen_alpha", f"avg(r) * 252 - (0.03 + {_BETA} * (avg(m) * 252 - 0.03))", lambda: kpis.jensen_alpha(F.col("r"), F.col("m"), RATE))
_metric("g9_treynor", f"(avg(r) * 252 - 0.03) / ({_BETA})", lambda: kpis.treynor(F.col("r"), F.col("m"), RATE))
_metric("g10_var", "-(-1.6448536269514715 * stddev_samp(r) - avg(r))", lambda: kpis.parametric_var(F.col("r")))
_metric("g12_kurtosis", "kurtosis_pop(r) + 3", lambda: kpis.kurtosis(F.col("r")))


@registered("g5_max_drawdown", f"SELECT asset, {sql.cut('min(drawdown)', 6)} AS max_drawdown FROM dd GROUP BY asset", "dd")
def g5(s, d):
    return _cuts(kpis.max_drawdown(returns(s, d)), ["asset"], {"max_drawdown": 6})


@registered("g6_calmar", f"SELECT asset, {sql.cut('avg(r) * 252 / abs(nullif(min(drawdown), 0))', 6)} AS calmar FROM dd GROUP BY asset", "dd")
def g6(s, d):
    return _cuts(kpis.report(returns(s, d)), ["asset"], {"calmar": 6})


@registered("g11_skewness", f"SELECT asset, {sql.cut('avg(pow(r - mu, 3)) / pow(var_pop(r), 1.5)', 6)} AS skewness FROM (SELECT *, avg(r) OVER (PARTITION BY asset) AS mu FROM ret) GROUP BY asset", "ret")
def g11(s, d):
    return returns(s, d).groupBy("asset").agg(cut(F.skewness("r"), 6).alias("skewness"))


_REPORT = {
    "annual_return": ("avg(r) * 252", 6), "annual_volatility": ("stddev_samp(r) * sqrt(252)", 6), "sharpe": ("avg(r - 0.03 / 252) / stddev_samp(r) * sqrt(252)", 6), "max_drawdown": ("min(drawdown)", 6),
    "sortino": ("avg(r - 0.03 / 252) / stddev_samp(CASE WHEN r - 0.03 / 252 < 0 THEN r - 0.03 / 252 END) * sqrt(252)", 6), "calmar": ("avg(r) * 252 / abs(nullif(min(drawdown), 0))", 6), "var": ("-(-1.6448536269514715 * stddev_samp(r) - avg(r))", 6),
    "kurtosis": ("kurtosis_pop(r) + 3", 6), "treynor": (f"(avg(r) * 252 - 0.03) / ({_BETA})", 6), "jensen_alpha": (f"avg(r) * 252 - (0.03 + {_BETA} * (avg(m) * 252 - 0.03))", 6),
}


@registered("g13_report", _sql_cuts("asset", _REPORT) + " FROM dd JOIN mkt USING (date) GROUP BY asset", "dd", "mkt")
def g13(s, d):
    return _cuts(kpis.report(market_returns(s, d), RATE, market="m"), ["asset"], {k: v for k, (_, v) in _REPORT.items()})


@registered("g14_sharpe_daily_rate", f"SELECT asset, {sql.cut('avg(x) / stddev_samp(x) * sqrt(252)', 6)} AS sharpe FROM (SELECT asset, r - risk_free_annual / 252 AS x FROM ret JOIN rf USING (date)) GROUP BY asset", "ret", "rf")
def g14(s, d):
    joined = returns(s, d).join(risk_free(s, d), "date")
    return joined.groupBy("asset").agg(cut(kpis.sharpe_excess(F.col("r") - F.col("risk_free_annual") / 252), 6).alias("sharpe"))


@registered("g15_sharpe_simple", f"SELECT asset, {sql.cut('avg(x - 0.03 / 252) / stddev_samp(x - 0.03 / 252) * sqrt(252)', 6)} AS sharpe, {sql.cut('avg(x) / stddev_samp(x) * sqrt(252)', 6)} AS sharpe_plain FROM (SELECT asset, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS x FROM bars) WHERE x IS NOT NULL GROUP BY asset", "bars")
def g15(s, d):
    simple = features.linear_return(bars(s, d), out="x").where("x IS NOT NULL")
    return simple.groupBy("asset").agg(cut(kpis.sharpe_excess(F.col("x") - RATE / 252), 6).alias("sharpe"), cut(kpis.sharpe_excess(F.col("x")), 6).alias("sharpe_plain"))


# H. Signals, weights, portfolio returns

_SIGNALS = {"signals": f"SELECT asset, date, close, CAST(coalesce(({_rolled('avg', 'close', 50)}) > ({_rolled('avg', 'close', 200)}), false) AS INTEGER) AS signal, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY date)) AS r FROM bars"}


def _signals(s: SparkSession, d: str) -> DataFrame:
    return strategies.crossover(features.log_return(bars(s, d), out="r"))


@registered("h1_crossover", "SELECT asset, date, signal FROM signals", "bars", extra=_SIGNALS)
def h1(s, d):
    return _signals(s, d).select("asset", "date", "signal")


_WEIGHTS = """SELECT asset, {cut} AS weight FROM (SELECT asset, raw, capped, CASE WHEN sum(capped) OVER () > 0 THEN capped / sum(capped) OVER () ELSE raw END AS w FROM (SELECT *, least(raw, 0.5) AS capped FROM
    (SELECT asset, coalesce(score / nullif(sum(score) OVER (), 0), 0) AS raw FROM (SELECT asset, coalesce(greatest(avg(r) / stddev_samp(r) * sqrt(252), 0), 0) AS score FROM ret GROUP BY asset))))""".replace("{cut}", sql.cut("w", 6))


@registered("h2_score_weights", _WEIGHTS, "ret")
def h2(s, d):
    return _cuts(strategies.score_weights(returns(s, d), "sharpe", 0.5), ["asset"], {"weight": 6})


def _grid(s: SparkSession, d: str, rate: float = RATE) -> DataFrame:
    r = market_returns(s, d)
    two = r.where(F.col("asset") == PAIR[0]).select("date", F.col("r").alias("r1"), "m").join(r.where(F.col("asset") == PAIR[1]).select("date", F.col("r").alias("r2")), "date")
    return strategies.grid_scores(strategies.weight_grid(strategies.moments(two)), rate)


_SCORES = {
    "treynor": "(mean * 252 - 0.03) / (cov_m / vm)",
    "jensen": "mean * 252 - (0.03 + cov_m / vm * (em * 252 - 0.03))",
    "low_beta": "-abs(cov_m / vm)",
    "low_correlation": "-abs(cov_m / sqrt(variance * vm))",
    "sharpe": "(mean * 252 - 0.03) / sqrt(variance * 252)",
}


def _best(name: str, score: str) -> None:
    best = f"SELECT w, {sql.cut('score', 6)} AS score FROM (SELECT w, {_SCORES[score]} AS score FROM grid) WHERE score IS NOT NULL ORDER BY score DESC, w LIMIT 1"

    @registered(name, f"SELECT w, score FROM ({best})", "grid")
    def run(s, d):
        return strategies.best_weight(_grid(s, d), score).select("w", cut("score", 6).alias("score"))


_best("h3_max_treynor", "treynor")
_best("h4_max_jensen", "jensen")
_best("h5_min_beta", "low_beta")
_best("h6_min_correlation", "low_correlation")
_best("h11_max_sharpe", "sharpe")


@registered("h7_signal_returns", f"SELECT date, {sql.cut('coalesce(sum(b * r), 0)', 8)} AS r FROM (SELECT *, lag(signal) OVER (PARTITION BY asset ORDER BY date) AS b FROM signals) GROUP BY date", "bars", extra=_SIGNALS)
def h7(s, d):
    return _cuts(strategies.signal_returns(_signals(s, d)), ["date"], {"r": 8})


@registered("h8_wealth", _sql_cuts("asset, date", {"wealth": ("wealth", 4), "drawdown": ("drawdown", 6)}) + " FROM dd", "dd")
def h8(s, d):
    return _cuts(kpis.with_drawdown(kpis.with_wealth(returns(s, d))), KEYS, {"wealth": 4, "drawdown": 6})


@registered("h9_fixed_weights", f"SELECT portfolio, date, {sql.cut('coalesce(sum(weight * r), 0)', 8)} AS r FROM ret JOIN (VALUES ('half', 'AF', 0.5), ('half', 'RO', 0.5), ('sixty', 'AF', 0.6), ('sixty', 'RO', 0.4)) t(portfolio, asset, weight) USING (asset) GROUP BY portfolio, date", "ret")
def h9(s, d):
    weights = s.createDataFrame([("half", "AF", 0.5), ("half", "RO", 0.5), ("sixty", "AF", 0.6), ("sixty", "RO", 0.4)], "portfolio string, asset string, weight double")
    return _cuts(strategies.weighted_returns(returns(s, d), weights), ["portfolio", "date"], {"r": 8})


@registered("h10_wide", "SELECT * FROM (PIVOT (SELECT date, asset, close FROM bars) ON asset USING first(close) GROUP BY date)", "bars")
def h10(s, d):
    """All assets that the table has."""
    return strategies.wide(bars(s, d))


@registered("h12_weight_grid", "SELECT w, " + ", ".join(f"{sql.cut(e, 6)} AS {n}" for n, e in _SCORES.items()) + " FROM grid", "grid")
def h12(s, d):
    return _cuts(_grid(s, d), ["w"], {n: 6 for n in _SCORES})


@registered("h12_covariances", f"SELECT x.asset AS a, y.asset AS b, {sql.cut('covar_samp(x.r, y.r)', 8)} AS cov, count(*) AS n FROM ret x JOIN ret y ON x.date = y.date AND x.asset <= y.asset GROUP BY 1, 2", "ret")
def h12c(s, d):
    return strategies.covariances(returns(s, d)).select("a", "b", cut("cov", 8).alias("cov"), "n")


# I. Execution, costs, portfolio


def _priced(s: SparkSession, d: str, b: DataFrame | None = None) -> DataFrame:
    return features.next_open(features.spread_estimates(bars(s, d) if b is None else b))


def _trades(s: SparkSession, d: str, **how) -> DataFrame:
    return execution.apply_execution(fixtures.trades_in(s, d), _priced(s, d), **how)


@registered("i1_half_spread", _sql_cuts("date, asset", {"p_exec": ("p_exec", 3)}) + " FROM trades", "trades")
def i1(s, d):
    return _cuts(_trades(s, d), ["date", "asset"], {"p_exec": 3})


@registered("i2_round_lots", "SELECT date, asset, CASE WHEN delta_shares >= 0 THEN floor(delta_shares / 10) ELSE ceil(delta_shares / 10) END * 10 AS q FROM trades_in", "trades_in")
def i2(s, d):
    return fixtures.trades_in(s, d).select("date", "asset", execution.round_lots(F.col("delta_shares"), 10.0).alias("q"))


_TRADE = {"q": ("q", 4), "p_ref": ("p_ref", 3), "p_exec": ("p_exec", 3), "notional_abs": ("abs(q * p_exec)", 2), "spread_cost": ("abs(q * (p_exec - p_ref))", 2)}


@registered("i3_execution", _sql_cuts("date, asset", _TRADE) + " FROM trades", "trades")
def i3(s, d):
    return _cuts(_trades(s, d), ["date", "asset"], {k: v for k, (_, v) in _TRADE.items()})


@registered("i4_fees", _sql_cuts("date, asset", {"fees": ("abs(q * p_exec) * 5 / 1e4", 4), "total_cost": ("abs(q * (p_exec - p_ref)) + abs(q * p_exec) * 5 / 1e4", 2)}) + " FROM trades", "trades")
def i4(s, d):
    return _cuts(execution.apply_fees(_trades(s, d), 5.0), ["date", "asset"], {"fees": 4, "total_cost": 2})


@registered("i5_slippage", _sql_cuts("date, asset", {"vol_slip": ("abs(q) * p_ref * 0.1 * coalesce(sigma * 1e4, 0) / 1e4", 3)}) + " FROM trades", "trades")
def i5(s, d):
    sigma = _priced(s, d).select("date", "asset", (F.col("volatility_becker_parkinson") * 1e4).alias("sigma_bps"))
    return _cuts(execution.apply_fees(_trades(s, d), 5.0, sigma, 0.1), ["date", "asset"], {"vol_slip": 3})


def _targets(b: DataFrame, vintages: bool = False) -> DataFrame:
    """Two portfolios: volume-weighted, and dollar-weighted without the days of falling prices.

    vintages: instead two for each month, which hold what theirs holds in it.
    """
    one = b.select(F.lit("volume").alias("portfolio_id"), "date", "asset", F.col("volume").alias("weight"))
    two = b.select(F.lit("rising").alias("portfolio_id"), "date", "asset", (F.col("close") - F.col("open")).alias("weight"))
    both = one.unionByName(two)
    return portfolio.target_weights(both.withColumn("portfolio_id", F.concat_ws(" ", "portfolio_id", F.date_format("date", "yyyy-MM"))) if vintages else both)


def _raw(source: str, vintages: bool = False) -> dict[str, str]:
    month = " || ' ' || strftime(date, '%Y-%m')" * vintages
    return {"raw": f"SELECT 'volume'{month} AS portfolio_id, date, asset, coalesce(volume, 0) AS w FROM {source} UNION ALL BY NAME SELECT 'rising'{month} AS portfolio_id, date, asset, greatest(coalesce(close - open, 0), 0) AS w FROM {source}"}


@registered("i6_target_weights", f"SELECT portfolio_id, date, asset, {sql.cut('w / greatest(sum(w) OVER (PARTITION BY portfolio_id, date), 1e-12)', 6)} AS weight FROM raw", "bars", extra=_raw("bars"))
def i6(s, d):
    return _cuts(_targets(bars(s, d)), ["portfolio_id", "date", "asset"], {"weight": 6})


def _fold_prices(known: DataFrame) -> DataFrame:
    """Every asset on every session, gaps filled: marks and fills within a hundredth of a level of 100, low spreads."""
    level = lambda c: 100 + F.sin(c)
    most = lambda c, top: F.when(F.col(c).isNotNull(), F.least(c, F.lit(top)))
    bounded = known.select("date", "asset", level(F.col("close")).alias("close"), level(F.col("execution_price_t_plus_1_open")).alias("execution_price_t_plus_1_open"), most("bid_ask_spread_corwin_schultz", 0.001).alias("bid_ask_spread_corwin_schultz"), (most("volatility_becker_parkinson", 0.02) * 1e4).alias("sigma_bps"))
    return cal.fill(cal.align(bounded, cal.sessions_of(bounded)), [c for c in bounded.columns if c not in KEYS])


#: Days of a portfolio with lists over its assets, and the fold over them: a day's trades follow from the state before.
_FOLD = {
    "weights": "SELECT portfolio_id, date, asset, w / greatest(sum(w) OVER (PARTITION BY portfolio_id, date), 1e-12) AS weight FROM raw",
    "priced": "SELECT p.date, p.asset, " + ", ".join(f"last_value({v} IGNORE NULLS) OVER (PARTITION BY p.asset ORDER BY p.date) AS {n}" for n, v in {"mark": "100 + sin(p.close)", "ref": "100 + sin(s.next_open)", "spread": "CASE WHEN s.spread IS NOT NULL THEN least(s.spread, 0.001) END", "sigma": "CASE WHEN s.sigma IS NOT NULL THEN least(s.sigma, 0.02) * 1e4 END"}.items()) + " FROM panel p LEFT JOIN spreads s ON p.date = s.date AND p.asset = s.asset",
    "slots": "SELECT p.portfolio_id, a.asset FROM (SELECT DISTINCT portfolio_id FROM raw) p CROSS JOIN (SELECT DISTINCT asset FROM bars) a",
    "days": """SELECT portfolio_id, date, row_number() OVER (PARTITION BY portfolio_id ORDER BY date) AS n, l FROM (SELECT d.portfolio_id, d.date, list({'a': s.asset, 'mark': p.mark, 'ref': p.ref, 'spread': p.spread, 'sigma': p.sigma, 'w': w.weight} ORDER BY s.asset) AS l
        FROM (SELECT DISTINCT portfolio_id, date FROM raw) d JOIN slots s USING (portfolio_id) LEFT JOIN weights w ON w.portfolio_id = d.portfolio_id AND w.date = d.date AND w.asset = s.asset LEFT JOIN priced p ON p.date = w.date AND p.asset = w.asset GROUP BY 1, 2)""",
    "fold": """SELECT portfolio_id, CAST(0 AS BIGINT) AS n, 1e6::DOUBLE AS cash, list_transform(l, lambda x: 0.0::DOUBLE) AS shares, list_transform(l, lambda x: 0.0::DOUBLE) AS q, 0.0::DOUBLE AS fees, 0.0::DOUBLE AS slip FROM days WHERE n = 1
        UNION ALL SELECT portfolio_id, n, cash - list_sum(list_transform(q, lambda x, i: x * fill[i])) - fees - slip, list_transform(shares, lambda x, i: x + q[i]), q, fees, slip FROM (
        SELECT *, list_sum(list_transform(q, lambda x, i: abs(x) * fill[i])) * 5 / 1e4 AS fees, list_sum(list_transform(q, lambda x, i: abs(x) * coalesce(l[i].ref * l[i].sigma, 0))) * 0.01 / 1e4 AS slip FROM (
        SELECT *, list_transform(q, lambda x, i: coalesce(l[i].ref, 0) * (1 + coalesce(l[i].spread, 0) / 2 * CASE WHEN x >= 0 THEN 1 ELSE -1 END)) AS fill FROM (
        SELECT *, list_transform(shares, lambda x, i: CASE WHEN l[i].mark IS NULL OR l[i].ref IS NULL OR worth <= 0 THEN 0 ELSE l[i].w * worth / l[i].mark - x END) AS q FROM (
        SELECT d.portfolio_id, d.n, d.l, f.cash, f.shares, f.cash + list_sum(list_transform(f.shares, lambda x, i: x * coalesce(d.l[i].mark, 0))) AS worth FROM fold f JOIN days d ON d.portfolio_id = f.portfolio_id AND d.n = f.n + 1))))""",
    "states": """SELECT *, cash + list_sum(list_transform(shares, lambda x, i: x * coalesce(l[i].mark, 0))) AS value FROM (SELECT d.portfolio_id, d.date, d.l, f.cash, f.shares, f.q, f.fees, f.slip FROM fold f JOIN days d ON d.portfolio_id = f.portfolio_id AND d.n = f.n)""",
    "each": "SELECT portfolio_id, date, value, cash, fees, slip, unnest(l) AS x, unnest(shares) AS held, unnest(q) AS q FROM states",
}
_STATE = {"value": ("value", 2), "cash": ("cash", 2), "fees": ("fees", 4), "vol_slip": ("slip", 4), "q": ("q", 4), "shares": ("held", 4), "weight": ("held * coalesce(x.mark, 0) / greatest(value, 1e-12)", 6), "p_exec": ("x.ref * (1 + coalesce(x.spread, 0) / 2 * sign(q))", 4)}


def _rebalanced(s: SparkSession, d: str, vintages: bool) -> tuple[DataFrame, DataFrame]:
    held = written(bars(s, d))
    return _targets(cal.align(held, cal.sessions_of(held)), vintages), _fold_prices(_priced(s, d, held))


_STATE_SQL, _STATE_KEYS = _sql_cuts("portfolio_id, date, x.a AS asset", _STATE) + " FROM each", ["portfolio_id", "date", "asset"]
_COSTS = {"sigma": "sigma_bps", "k": 0.01}


@registered("i7_i8_rebalance", _STATE_SQL, "spreads", "panel", extra=_raw("panel") | _FOLD)
def i8(s, d):
    """Two portfolios over all sessions."""
    return _cuts(portfolio.rebalance(*_rebalanced(s, d, False), **_COSTS), _STATE_KEYS, {c: n for c, (_, n) in _STATE.items()})


@registered("i8_resumed", _STATE_SQL, "spreads", "panel", extra=_raw("panel") | _FOLD)
def i8r(s, d):
    """The same in two runs: the states up to a date are saved, and a second run goes on from them."""
    targets, prices = _rebalanced(s, d, False)
    saved = written(portfolio.rebalance(targets.where("date <= DATE '1995-02-15'"), prices, **_COSTS))
    return _cuts(saved.unionByName(portfolio.resume(saved, targets, prices, **_COSTS)), _STATE_KEYS, {c: n for c, (_, n) in _STATE.items()})


@registered("i8_vintages", _STATE_SQL, "spreads", "panel", extra=_raw("panel", True) | _FOLD)
def i8v(s, d):
    """Two portfolios for each month, some 160."""
    return _cuts(portfolio.rebalance(*_rebalanced(s, d, True), **_COSTS), _STATE_KEYS, {c: n for c, (_, n) in _STATE.items()})


#: Prices as they are: bars move by multiples from day to day, so wealth can vanish; large numbers are told by their logarithm.
_BAR_FOLD = _raw("bars", True) | _FOLD | {"priced": "SELECT date, asset, close AS mark, next_open AS ref, spread, 0.0 AS sigma FROM spreads"}
_BAR_STATE = {c: (f"sign({v}) * ln(1 + abs({v}))", 5) for c, (v, _) in _STATE.items() if c not in ("weight", "vol_slip")}


@registered("i8_real_bars", _sql_cuts("portfolio_id, date, x.a AS asset", _BAR_STATE) + ", value <= 0 AS ruined FROM each WHERE x.mark IS NOT NULL", "spreads", extra=_BAR_FOLD)
def i8b(s, d):
    """Monthly portfolios at the bars' own prices and spreads; who has no wealth left trades no more."""
    held = written(bars(s, d))
    states = portfolio.rebalance(_targets(held, True), _priced(s, d, held))
    told = lambda c: cut(F.signum(c) * F.ln(1 + F.abs(c)), 5).alias(c)
    return states.select(*_STATE_KEYS, *(told(c) for c in _BAR_STATE), (F.col("value") <= 0).alias("ruined"))


@registered("i9_mark_to_market", _sql_cuts("portfolio_id, date, asset", {"value": ("v", 2), "weight": ("x / greatest(v, 1e-12)", 6)}) + " FROM (SELECT *, 1000 + sum(x) OVER (PARTITION BY portfolio_id, date) AS v FROM (SELECT 'all' AS portfolio_id, date, asset, volume * close AS x FROM bars))", "bars")
def i9(s, d):
    held = bars(s, d).select(F.lit("all").alias("portfolio_id"), "date", "asset", F.col("volume").alias("shares"), F.lit(1000.0).alias("cash"))
    return _cuts(portfolio.mark_to_market(held, bars(s, d)), ["portfolio_id", "date", "asset"], {"value": 2, "weight": 6})


# Plans


@registered("plan_strategy", "SELECT 'crossover' AS asset, " + ", ".join(f"{sql.cut(e, 6)} AS {n}" for n, (e, _) in _REPORT.items() if n in ("annual_return", "annual_volatility", "sharpe", "max_drawdown", "var")) + " FROM (SELECT *, exp(sum(r) OVER (ORDER BY date)) / max(w) OVER (ORDER BY date) - 1 AS drawdown FROM (SELECT *, exp(sum(r) OVER (ORDER BY date)) AS w FROM (SELECT date, coalesce(sum(b * r), 0) AS r FROM (SELECT *, lag(signal) OVER (PARTITION BY asset ORDER BY date) AS b FROM signals) GROUP BY date)))", "bars", extra=_SIGNALS)
def plan_strategy(s, d):
    """Signals, the returns of holding them from the next day on, and their report."""
    held = strategies.signal_returns(_signals(s, d)).withColumn("asset", F.lit("crossover"))
    return _cuts(kpis.report(held, RATE), ["asset"], {n: 6 for n in ("annual_return", "annual_volatility", "sharpe", "max_drawdown", "var")})
