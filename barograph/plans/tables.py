"""The given tables read as the series model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.operators import returns as ret
from barograph.plans.registry import shared
from barograph.sources.bars import daily_bars, to_ticks

SERIES = ("A", "N", "R")
BENCHMARK = "N"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_ticks(
        table(spark, sf_dir, "lineitem"),
        key="l_returnflag",
        ts="l_shipdate",
        price=F.col("l_extendedprice") / F.col("l_quantity"),
        volume="l_quantity",
        seq=F.col("l_orderkey") * 8 + F.col("l_linenumber"),
        # order and line number repeat in these tables: the line's amount and quantity decide
        tie=F.round(F.col("l_extendedprice") * 100).cast("bigint") * 50
        + F.col("l_quantity").cast("bigint"),
    )


@shared(store=True)
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(lineitem_ticks(spark, sf_dir))


@shared()
def rets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ret.with_returns(bars(spark, sf_dir))


@shared()
def vols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ret.with_volatility(rets(spark, sf_dir))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the event stream, ordered by microsecond."""
    return to_ticks(
        table(spark, sf_dir, "events"),
        key="event_type",
        ts="ts",
        price="value",
        volume=F.lit(1.0),
        seq=F.unix_micros(F.col("ts").cast("timestamp")),
    )
