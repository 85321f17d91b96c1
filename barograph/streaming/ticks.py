"""Event-time bars and realised variance over a tick stream.

Ticks carry ``event_id, series_id, ts, price``. Windows close when the watermark passes
their end; ticks later than the watermark are dropped, and a repeated event id counts once.
Aggregations combine before the shuffle, so a hot series costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.functions.windows import KEY


def unique_ticks(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def window_bars(ticks: DataFrame, width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Open, high, low, close and count per tumbling (or sliding) window."""
    first_last = F.struct("ts", "event_id")
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return ticks.groupBy(KEY, span.alias("w")).agg(
        F.min_by("price", first_last).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", first_last).alias("close"),
        F.count(F.lit(1)).alias("n"),
    )


def realised_variance(ticks: DataFrame, bar: str = "5 minutes", span: str = "1 day") -> DataFrame:
    """Realised variance per ``span`` from the closes of short bars, two chained windows.

    A span holds at most span / bar closes, whatever the tick rate.
    """
    bars = window_bars(ticks, bar)
    days = bars.groupBy(KEY, F.window(F.window_time("w"), span).alias("d")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("w.start").alias("at"), F.ln("close").alias("p")))).alias("_a")
    )
    steps = F.zip_with(
        F.slice("_a", F.lit(2), F.greatest(F.size("_a") - 1, F.lit(0))),
        F.slice("_a", F.lit(1), F.greatest(F.size("_a") - 1, F.lit(0))),
        lambda b, a: (b["p"] - a["p"]) * (b["p"] - a["p"]),
    )
    return days.select(
        KEY,
        F.col("d.start").alias("start"),
        F.size("_a").alias("n_bars"),
        F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x).alias("rv"),
    )


def activity_sessions(ticks: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Runs of ticks without a pause longer than ``gap``."""
    return ticks.groupBy(KEY, F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.max("price").alias("high"), F.min("price").alias("low")
    )
