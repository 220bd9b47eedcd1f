"""Market tables derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of six assets from line items: price is extended price by quantity."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rank = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.to_date("l_shipdate").alias("date"))
        .agg(F.min_by(price, rank).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, rank).alias("close"), F.sum("l_quantity").alias("volume"))
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("asset"), "ts", F.col("value").alias("price"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual percent by order date."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 1e5).alias("percent"))


def trades_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed orders by date and asset, fractional."""
    signed = F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"), F.concat("l_returnflag", "l_linestatus").alias("asset")).agg((F.sum(signed) / 3).alias("delta_shares"))
