"""Provider JSON: equity and crypto bars, and rate observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators.normalize import ticker
from barline.sources.tables import save_parquet

#: The providers' fields.
EQUITY = "array<struct<date:string,open:double,high:double,low:double,close:double,adjClose:double,volume:bigint,divCash:double,splitFactor:double>>"
CRYPTO = "array<struct<priceData:array<struct<date:string,open:double,high:double,low:double,close:double,volume:double>>>>"
OBSERVATIONS = "struct<observations:array<struct<date:string,value:string>>>"


def payloads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """asset (the file's name without its ending) and payload (its text), one row a file."""
    return spark.read.text(paths, wholetext=True).select(ticker(F.regexp_extract("_metadata.file_name", r"^(.*?)\.[^.]*$", 1)).alias("asset"), F.col("value").alias("payload"))


def _equity(payload: Column) -> Column:
    return F.filter(F.from_json(payload, EQUITY), lambda d: d["date"].isNotNull())


def _crypto(payload: Column) -> Column:
    return F.get(F.from_json(payload, CRYPTO), F.lit(0))["priceData"]


def equity_bars(files: DataFrame) -> DataFrame:
    """RAW rows of payloads that hold an array of days each; unreadable ones give no rows."""
    return files.select("asset", F.inline(_equity(F.col("payload"))))


def crypto_bars(files: DataFrame) -> DataFrame:
    """RAW rows of payloads that hold [{priceData: [...]}]; empty ones give no rows."""
    return files.select("asset", F.inline(_crypto(F.col("payload"))))


def rejected(files: DataFrame, crypto: bool = False) -> DataFrame:
    """Assets none of whose payloads can be read or has a day."""
    days = (_crypto if crypto else _equity)(F.col("payload"))
    return files.groupBy("asset").agg(F.bool_and(F.coalesce(F.size(days), F.lit(0)) <= 0).alias("bad")).where("bad").select("asset")


def land(raw: DataFrame, path: str, batch: str = "0") -> DataFrame:
    """Writes RAW by asset, and gives asset and n_rows of what this batch wrote.

    Assets of the batch are replaced, others stay as earlier batches left them, so a batch may be landed again. Its
    record (the rows given back) is kept in the table's folder _commits, where readers of the table do not look.
    """
    save_parquet(raw, path, by="asset", keep=True)
    record = f"{path}/_commits/batch={batch}"
    raw.groupBy("asset").agg(F.count("*").alias("n_rows")).coalesce(1).write.mode("overwrite").json(record)
    return raw.sparkSession.read.schema("asset string, n_rows long").json(record)


def land_payloads(files: DataFrame, path: str, batch: str = "0", crypto: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lands the payloads that can be read, and gives what landed and the assets that were rejected."""
    return land((crypto_bars if crypto else equity_bars)(files), path, batch), rejected(files, crypto)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """batch, asset and n_rows of all batches landed in a table."""
    return spark.read.schema("asset string, n_rows long, batch string").option("basePath", f"{path}/_commits").json(f"{path}/_commits/batch=*").select("batch", "asset", "n_rows")


def observations(files: DataFrame) -> DataFrame:
    """date and percent of a rate series; a dot is a missing value."""
    rows = files.select(F.inline(F.from_json("payload", OBSERVATIONS)["observations"]))
    return rows.select(F.to_date(F.try_to_timestamp("date")).alias("date"), F.expr("try_cast(value AS DOUBLE)").alias("percent")).where("date IS NOT NULL")


def universe(groups: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """asset and ord of asset groups (asset, grp, ord): each once, at its first place; overrides replace the list."""
    chosen = groups if overrides is None else overrides
    return chosen.groupBy(ticker(F.col("asset")).alias("asset")).agg(F.min("ord").alias("ord"))
