"""Running a stream over what is available and reading back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.functions.windows import KEY
from barograph.sources.checkpoint import cut, shared_folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input into a Parquet table with exactly-once file output."""
    spark = stream.sparkSession
    folder = fresh_folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def staged(df: DataFrame, name: str, slices: int = 3) -> DataFrame:
    """Write a table to the shared folder slice by slice in time order and open it as a stream.

    Files are picked up oldest first and a slice keeps each series in one file, so keyed
    state sees every series in order over several micro-batches, wherever those are cut.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark, name)
    df = cut(df)
    day = F.unix_date("t")
    inner = [i / slices for i in range(1, slices)]
    cuts = df.agg(F.percentile_approx(day, inner).alias("q")).first()["q"] or []
    low = None
    for high in [*cuts, None]:
        part = df if low is None else df.filter(day > low)
        part = part if high is None else part.filter(day <= high)
        part.repartition(KEY).write.mode("append").parquet(folder)
        low = high
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).parquet(folder)
