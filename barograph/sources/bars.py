"""Daily bars, ticks and panels.

Model: ``bars(series_id, t, open, high, low, close, volume)``, one row per series and
day; ``ticks(series_id, day, seq, price, volume)``, any number of rows per day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barograph.functions.windows import KEY, TIME, col, stack

BAR_SCHEMA = (
    "series_id string, t date, open double, high double, low double, close double, volume double"
)


def read_bars(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    columns: dict[str, str] | None = None,
    series_id: str | None = None,
) -> DataFrame:
    """Read daily bars of all series in one scan; NaN becomes null.

    ``columns`` maps file columns to model columns, as in ``{"Date": "t", "Close": "close"}``.
    ``series_id`` names the one series of a file that has no key column.
    """
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    for old, new in (columns or {}).items():
        df = df.withColumnRenamed(old, new)
    if series_id is not None:
        df = df.withColumn(KEY, F.lit(series_id))
    missing = [c for c in (KEY, TIME, "close") if c not in df.columns]
    if missing:
        raise ValueError(f"bars lack required columns {missing}; found {df.columns}")
    doubles = [c for c in ("open", "high", "low", "close", "volume") if c in df.columns]
    return df.withColumns(
        {
            TIME: F.to_date(TIME),
            **{c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in doubles},
        }
    )


def to_ticks(
    df: DataFrame,
    key: str,
    ts: str,
    price: Column | str,
    volume: Column | str,
    seq: Column | str,
    tie: Column | str | None = None,
) -> DataFrame:
    """Map a raw table to ticks; the whole number ``seq`` orders the ticks of one day.

    Where ``seq`` may repeat, ``tie`` (any whole number of the row) settles it: its low 16
    bits are packed below ``seq``. The order stays one long, which lets the bar aggregation
    run as a hash aggregation on fixed-width buffers; ordering by a struct would sort every
    input partition.
    """
    order = col(seq).cast("bigint")
    if tie is not None:
        order = order * 65536 + F.pmod(col(tie).cast("bigint"), F.lit(65536))
    return df.select(
        F.col(key).alias(KEY),
        F.to_date(ts).alias("day"),
        order.alias("seq"),
        col(price).cast("double").alias("price"),
        col(volume).cast("double").alias("volume"),
    )


def daily_bars(ticks: DataFrame) -> DataFrame:
    """Ticks to daily bars in one map-side combined hash aggregation.

    Whatever share of the ticks one series holds, a task ships one row per series and day.
    """
    return ticks.groupBy(KEY, F.col("day").alias(TIME)).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("volume").alias("volume"),
    )


def aligned_panel(df: DataFrame, value: str, series: Sequence[str]) -> DataFrame:
    """One row per date with a column per named series; dates lacking any of them are dropped.

    The series are named by the caller, so the width is fixed and nothing is collected to
    find it. Dates bound the height.
    """
    wide = (
        df.filter(F.col(KEY).isin(list(series)))
        .groupBy(TIME)
        .agg(*[F.max(F.when(F.col(KEY) == s, F.col(value))).alias(s) for s in series])
    )
    return wide.dropna("any")


def series_pairs(series: Sequence[str], ordered: bool = False, diagonal: bool = False):
    """The pairs of a named list of series."""
    names = list(series)
    out = []
    for a, i in enumerate(names):
        for b, j in enumerate(names):
            if a == b and not diagonal:
                continue
            if a > b and not ordered:
                continue
            out.append((i, j))
    return out


def panel_pairs(panel: DataFrame, pairs: Sequence[tuple[str, str]], *extra: str) -> DataFrame:
    """Pair-long rows ``(t, i, j, x, y)`` from a wide panel: no self-join, one row per pair and date."""
    cells = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(i).alias("x"), F.col(j).alias("y")
        )
        for i, j in pairs
    ]
    return panel.select(TIME, *extra, F.inline(F.array(*cells)))


def panel_long(panel: DataFrame, series: Sequence[str], value: str = "value") -> DataFrame:
    return panel.unpivot([TIME], list(series), KEY, value)


def head_per_series(df: DataFrame, rows: int) -> DataFrame:
    """First ``rows`` rows of every series in time order."""
    w = Window.partitionBy(KEY).orderBy(TIME)
    return df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= rows)


def union_metrics(*frames: DataFrame) -> DataFrame:
    """Stack metric tables with differing columns and fold ``version`` into ``model``."""
    out = stack(*frames, missing=True)
    if "version" in out.columns:
        out = out.withColumn("model", F.concat_ws("_", "model", "version")).drop("version")
    return out


def write_series(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write partitioned by series, one shuffle so that a series does not scatter over files."""
    out = df.repartition(KEY, F.year(TIME)) if TIME in df.columns else df.repartition(KEY)
    writer = out.write.mode(mode).partitionBy(KEY)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
