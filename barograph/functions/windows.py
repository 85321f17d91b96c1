"""Frames over keyed series.

Daily series hold at most one row per key and day, so a window over one series is
bounded by the calendar (a century is 36,525 rows) whatever the size of the tick
table it came from. Tick-level windows have no such bound: they go through
:func:`in_blocks`, which cuts a series into fixed-size blocks with a halo.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "series_id"
TIME = "t"


def by_series(*keys: str, order: str = TIME) -> WindowSpec:
    return Window.partitionBy(*(keys or (KEY,))).orderBy(order)


def whole_series(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or (KEY,)))


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x: Column | str, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col(x), k).over(w or by_series())


def lead(x: Column | str, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lead(col(x), k).over(w or by_series())


def correlation(x: Column | str, y: Column | str) -> Column:
    """Correlation over the rows of a group; null where a side is constant, which ``corr`` refuses."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def trailing(
    agg: Callable[[Column], Column],
    x: Column | str,
    size: int,
    min_rows: int | None = None,
    skip: int = 0,
    w: WindowSpec | None = None,
) -> Column:
    """``agg`` over the last ``size`` rows, ``skip`` rows back; null below ``min_rows`` values."""
    frame = (w or by_series()).rowsBetween(-(size - 1) - skip, -skip)
    x = col(x)
    return F.when(F.count(x).over(frame) >= (min_rows or size), agg(x).over(frame))


def trailing2(
    agg: Callable[[Column, Column], Column],
    x: Column | str,
    y: Column | str,
    size: int,
    min_rows: int | None = None,
    skip: int = 0,
    w: WindowSpec | None = None,
) -> Column:
    """Two-argument form of :func:`trailing`; a row counts when both values are present."""
    frame = (w or by_series()).rowsBetween(-(size - 1) - skip, -skip)
    both = col(x).isNotNull() & col(y).isNotNull()
    xs, ys = F.when(both, col(x)), F.when(both, col(y))
    return F.when(F.count(xs).over(frame) >= (min_rows or size), agg(xs, ys).over(frame))


def skew_corrected(x: Column) -> Callable[[WindowSpec | None], Column]:
    """Bias-corrected skewness; pass a frame, or None inside ``groupBy().agg``."""

    def build(frame: WindowSpec | None = None) -> Column:
        n, g = F.count(x), F.skewness(x)
        if frame is not None:
            n, g = n.over(frame), g.over(frame)
        n = n.cast("double")
        return F.when(n >= 3, g * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))

    return build


def kurt_corrected(x: Column) -> Callable[[WindowSpec | None], Column]:
    """Bias-corrected excess kurtosis; pass a frame, or None inside ``groupBy().agg``."""

    def build(frame: WindowSpec | None = None) -> Column:
        n, g = F.count(x), F.kurtosis(x)
        if frame is not None:
            n, g = n.over(frame), g.over(frame)
        n = n.cast("double")
        low = F.nullif((n - 2) * (n - 3), F.lit(0.0))
        return F.when(n >= 4, ((n + 1) * g + 6) * (n - 1) / low)

    return build


def stack(first: DataFrame, *rest: DataFrame, missing: bool = False) -> DataFrame:
    """Rows of several tables, matched by column name.

    Spark 4.1 lets a union claim the partitioning its inputs were planned with. When AQE
    then changes the partitions of one input, a grouping on top skips its shuffle and equal
    keys stay apart, which gives wrong results. The claim is switched off for the session.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=missing)
    return first


def decayed_sum(
    df: DataFrame,
    columns: dict[str, Column | str],
    decay: float | Column,
    keys: Sequence[str] = (KEY,),
    order: str = TIME,
) -> DataFrame:
    """Add ``out_t = sum over s <= t of decay^(t-s) * x_s`` for every ``out: x``.

    This is the linear recursion ``out_t = decay * out_(t-1) + x_t`` without a loop.
    Rows are numbered per series and cut into stretches short enough that
    ``decay^-i`` stays near 1e150. One stretch later the weight is 1e-150, so a row
    needs its own stretch plus the closing value of the one before: nothing overflows
    and series of any length work. A decay in (0, 1) that differs between keys is a
    column; each key's stretch follows its own decay. Outside (0, 1) it raises.
    """
    if not isinstance(decay, Column):
        if not 0.0 < decay < 1.0:
            raise ValueError(f"decay must lie in (0, 1), got {decay}")
        decay = F.lit(decay)
    valid = F.when((decay > 0) & (decay < 1), decay).otherwise(
        F.raise_error(F.concat(F.lit("decay must lie in (0, 1), got "), decay.cast("string"))).cast("double")
    )
    stretch = F.greatest(F.lit(2), F.floor(345.0 / F.abs(F.log(valid)))).cast("bigint")
    line = by_series(*keys, order=order)
    df = df.withColumn("_pos", F.row_number().over(line) - 1)
    df = df.withColumns(
        {"_stretch": F.floor(F.col("_pos") / stretch), "_i": F.col("_pos") % stretch}
    )
    inside = by_series(*keys, "_stretch", order=order).rowsBetween(Window.unboundedPreceding, 0)
    grow = F.pow(decay, -F.col("_i"))
    shrink = F.pow(decay, F.col("_i"))
    df = df.withColumns(
        {
            f"_in_{name}": shrink * F.sum(F.coalesce(col(x), F.lit(0.0)) * grow).over(inside)
            for name, x in columns.items()
        }
    )
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    closing = {
        name: F.last(
            F.when(F.col("_i") == stretch - 1, F.col(f"_in_{name}")), ignorenulls=True
        ).over(before)
        for name in columns
    }
    df = df.withColumns(
        {
            name: F.col(f"_in_{name}")
            + F.coalesce(closing[name] * shrink * decay, F.lit(0.0))
            for name in columns
        }
    )
    return df.drop("_pos", "_stretch", "_i", *(f"_in_{n}" for n in columns))


def ewm_mean(
    df: DataFrame, out: str, x: Column | str, span: int, min_rows: int, keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """Exponentially weighted mean with weights normalised over the values seen so far."""
    keep = 1.0 - 2.0 / (span + 1.0)
    x = col(x)
    df = df.withColumn("_x", x)
    df = decayed_sum(
        df,
        {"_num": F.col("_x"), "_den": F.when(F.col("_x").isNotNull(), 1.0)},
        keep,
        keys,
    )
    seen = F.count("_x").over(by_series(*keys).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn(out, F.when(seen >= min_rows, F.try_divide("_num", "_den")))
    return df.drop("_x", "_num", "_den")


def in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    slot: str,
    order: Sequence[str],
    lookback: int,
    block_rows: int = 200_000,
) -> DataFrame:
    """Cut long series into blocks so that no window holds a whole hot key.

    ``slot`` is any coarse, order-preserving bucket of the ordering (an hour, a key
    range). Rows get an exact ``rn`` per key: rows in earlier slots (a prefix sum over
    the counts, one row per key and slot) plus the row number inside the slot. Block b
    holds rows ``b * block_rows ... (b+1) * block_rows - 1`` and, marked ``halo``, the
    ``lookback`` rows before it, so any frame of at most ``lookback`` rows back is exact
    inside one block. Use ``Window.partitionBy(*keys, "block").orderBy("rn")`` and drop
    ``halo`` rows afterwards (see :func:`drop_halo`).
    """
    if lookback > block_rows:
        raise ValueError("lookback must not exceed block_rows")
    keys = list(keys)
    sizes = df.groupBy(*keys, slot).agg(F.count(F.lit(1)).alias("_size"))
    running = Window.partitionBy(*keys).orderBy(slot)
    starts = sizes.select(
        *keys,
        slot,
        (F.sum("_size").over(running) - F.col("_size")).alias("_start"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("key_rows"),
    )
    inside = Window.partitionBy(*keys, slot).orderBy(*order)
    numbered = (
        df.withColumn("_in_slot", F.row_number().over(inside))
        .join(starts, [*keys, slot])
        .withColumn("rn", F.col("_start") + F.col("_in_slot"))
        .drop("_start", "_in_slot")
    )
    home = F.floor((F.col("rn") - 1) / block_rows)
    is_tail = (F.col("rn") - 1) % block_rows >= block_rows - lookback
    copies = F.when(is_tail, F.array(home, home + 1)).otherwise(F.array(home))
    return (
        numbered.withColumn("_home", home)
        .withColumn("block", F.explode(copies))
        .withColumn("halo", F.col("block") != F.col("_home"))
        .drop("_home")
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("halo")).drop("halo", "block")
