"""Latent volatility regimes: mixtures per series, their transitions, most likely paths and smoothed states."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.windows import KEY, TIME, by_series, stack
from barograph.sources.checkpoint import stored

NAMES = ("low", "med", "high")
STATES = range(len(NAMES))
LEAST_VARIANCE = 1e-4
STEPS_PER_JOB = 5
BLOCK = 512


def log_volatility(df: DataFrame, vol: str) -> DataFrame:
    """Log volatility standardised per series."""
    x = df.filter(F.col(vol).isNotNull()).select(KEY, TIME, F.col(vol).alias("vol"), F.ln(F.col(vol) + 1e-10).alias("lv"))
    stats = x.groupBy(KEY).agg(F.avg("lv").alias("_m"), F.stddev_pop("lv").alias("_s"))
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return x.join(stats, KEY).withColumn("z", (F.col("lv") - F.col("_m")) / scale).drop("_m", "_s")


# --- mixtures ------------------------------------------------------------------------

def _each(*texts: str, sep: str = ", ") -> str:
    """The texts for each state, its number in place of ``#``."""
    return sep.join(t.replace("#", str(k)) for k in STATES for t in texts)


# log weight plus log density of a state; null for a state without weight
_DENSITY = f"CASE WHEN w# > 0 THEN ln(w#) - 0.5 * (pow(z - m#, 2) / v# + ln(v# * {2 * math.pi!r})) END"
_KEPT = "coalesce(exp(_d# - _top), 0.0D)"


def _weighed(rows: DataFrame) -> DataFrame:
    """Posterior weights ``r0, r1, r2`` of each row and its log likelihood ``_l``."""
    rows = rows.selectExpr("*", *[_DENSITY.replace("#", str(k)) + f" AS _d{k}" for k in STATES])
    rows = rows.selectExpr("*", f"greatest({_each('_d#')}) AS _top")
    rows = rows.selectExpr("*", *[_KEPT.replace("#", str(k)) + f" AS _e{k}" for k in STATES])
    rows = rows.selectExpr("*", f"{_each('_e#', sep=' + ')} AS _sum")
    out = rows.selectExpr("*", *[f"_e{k} / _sum AS r{k}" for k in STATES], "_top + ln(_sum) AS _l")
    return out.drop("_top", "_sum", *[f"_{c}{k}" for c in "de" for k in STATES])


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One EM step of all series: weighted sums by series, combined before they are shuffled."""
    weighed = _weighed(rows.join(params.drop("loglik"), KEY))
    sums = _each("sum(r#) AS _r#", "sum(r# * z) AS _z#", "sum(r# * z * z) AS _q#", "first(m#) AS m#", "first(v#) AS v#")
    out = weighed.groupBy(KEY).agg(
        F.expr("count(*)").alias("_n"), F.expr("avg(_l)").alias("loglik"),
        *[F.expr(e.split(" AS ")[0]).alias(e.split(" AS ")[1]) for e in sums.split(", ")],
    )
    new = _each(
        "_r# / _n AS w#",
        "CASE WHEN _r# > 1e-12 THEN _z# / _r# ELSE m# END AS m#",
        f"CASE WHEN _r# > 1e-12 THEN greatest(_q# / _r# - pow(_z# / _r#, 2), {LEAST_VARIANCE}D) ELSE v# END AS v#",
        sep="; ",
    )
    return out.selectExpr(KEY, "loglik", *new.split("; "))


def mixture_parameters(data: DataFrame, iterations: int = 40, tolerance: float = 0.0) -> DataFrame:
    """Weights, means and variances of three normal states per series, in the order of the means.

    Every step updates all series at once; a series whose mean log likelihood rises by no more than
    ``tolerance`` in a job of STEPS_PER_JOB steps has settled and leaves the next one. States start as the
    terciles of the values.
    """
    rows = stored(data.select(KEY, TIME, "z"), "levels")
    third = F.ntile(3).over(by_series(order="z").orderBy("z", TIME)) - 1
    start = rows.withColumn("_k", third).groupBy(KEY).agg(
        F.lit(None).cast("double").alias("loglik"),
        *[
            c
            for k in STATES
            for c in (
                F.lit(1 / 3).alias(f"w{k}"),
                F.coalesce(F.avg(F.when(F.col("_k") == k, F.col("z"))), F.lit(0.0)).alias(f"m{k}"),
                F.greatest(
                    F.coalesce(F.var_pop(F.when(F.col("_k") == k, F.col("z"))), F.lit(1.0)), F.lit(LEAST_VARIANCE)
                ).alias(f"v{k}"),
            )
        ],
    )
    active, done = stored(start, "mixture"), []
    while iterations > 0:
        now = active
        for _ in range(min(STEPS_PER_JOB, iterations)):
            now = _step(rows, now)
        iterations -= STEPS_PER_JOB
        before = active.select(KEY, F.col("loglik").alias("_before"))
        rise = F.col("loglik") - F.col("_before")
        now = now.join(before, KEY).withColumn("_settled", F.coalesce(rise <= tolerance, F.lit(False)) & F.lit(tolerance > 0))
        now = stored(now.drop("_before"), "mixture")
        done.append(now.filter("_settled").drop("_settled"))
        active = now.filter("NOT _settled").drop("_settled")
        if tolerance > 0 and active.isEmpty():
            break
    fits = stack(*done, active)
    cells = [F.struct(F.col(f"m{k}").alias("m"), F.lit(k).alias("k"), F.col(f"w{k}").alias("w"), F.col(f"v{k}").alias("v")) for k in STATES]
    sorted_fits = fits.select(KEY, "loglik", F.array_sort(F.array(*cells)).alias("_o"))
    return sorted_fits.select(KEY, "loglik", *[F.col("_o")[k][c].alias(f"{c}{k}") for k in STATES for c in "wmv"])


def mixture_regimes(df: DataFrame, vol: str, iterations: int = 40, tolerance: float = 0.0) -> DataFrame:
    """Regime 0, 1, 2 by rising mean, with posterior probabilities in the same order."""
    data = stored(log_volatility(df, vol), "log_volatility")
    out = _weighed(data.join(mixture_parameters(data, iterations, tolerance).drop("loglik"), KEY))
    best = F.greatest(*[f"r{k}" for k in STATES])
    label = F.when(F.col("r0") == best, 0).when(F.col("r1") == best, 1).otherwise(2)
    posts = [F.col(f"r{k}").alias(f"post_{n}") for k, n in zip(STATES, NAMES)]
    return out.select(KEY, TIME, "vol", "lv", "z", label.alias("regime"), *posts)


# --- labelled regimes ----------------------------------------------------------------


def regime_statistics(regimes: DataFrame) -> DataFrame:
    """Level, spread, frequency and persistence of every regime per series."""
    nxt = F.lead("regime").over(by_series())
    rows = regimes.withColumn("_next", nxt)
    out = rows.groupBy(KEY, "regime").agg(
        F.exp(F.avg("lv")).alias("mean_vol"),
        F.stddev_samp("lv").alias("std_log_vol"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("_next").isNotNull(), (F.col("_next") == F.col("regime")).cast("double"))).alias(
            "persistence"
        ),
    )
    total = F.sum("n").over(Window.partitionBy(KEY))
    return out.withColumn("frequency_pct", F.col("n") / total * 100)


def transition_matrix(regimes: DataFrame) -> DataFrame:
    """Share of moves from each regime to each other."""
    pairs = regimes.withColumn("_to", F.lead("regime").over(by_series())).filter(F.col("_to").isNotNull())
    wide = pairs.groupBy(KEY, "regime").pivot("_to", [0, 1, 2]).count().na.fill(0)
    total = F.col("0") + F.col("1") + F.col("2")
    return wide.select(
        KEY, F.col("regime").alias("from_regime"),
        *[(F.col(str(i)) / total).alias(f"to_{n}") for i, n in enumerate(NAMES)],
    )


# --- paths ---------------------------------------------------------------------------
#
# A row is a matrix that takes the scores of the states before it to the scores after it, and matrices of
# neighbouring rows combine: with (max, +) to the best path between two states, with (log-sum, +) to the sum
# of all paths. Blocks of rows are combined in tasks of their own, a series only scans its block matrices
# from both ends, and with what arrives at its two ends every block finishes on its own again.


def _combined(a: np.ndarray, b: np.ndarray, best: bool) -> np.ndarray:
    cells = a[..., :, :, None] + b[..., None, :, :]
    return cells.max(axis=-2) if best else np.logaddexp.reduce(cells, axis=-2)


def _matrices(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows of a block in their order and the matrix of each; the first row of a series needs no move."""
    table = table.sort_by("pos").combine_chunks()
    with np.errstate(divide="ignore"):
        moves = np.log(np.array(table.column("moves")[0].as_py(), dtype=float).reshape(3, 3))
    levels = np.array(table.column("levels")[0].as_py(), dtype=float).reshape(3, 2)
    z = table.column("z").to_numpy()[:, None]
    seen = levels[:, 1] > 0
    spread = np.where(seen, levels[:, 1], 1.0)
    emit = np.where(seen, -0.5 * ((z - levels[:, 0]) / spread) ** 2 - np.log(spread), -np.inf)
    out = moves[None] + emit[:, None, :]
    if table.column("pos")[0].as_py() == 1:
        out[0] = emit[0][None, :] - np.log(3)
    return table, out


def _blocks(regimes: DataFrame) -> DataFrame:
    """Rows numbered and cut into blocks, with the levels and moves estimated from the labels of their series."""
    stats = regimes.groupBy(KEY, "regime").agg(
        F.avg("z").alias("m"), F.greatest(F.stddev_pop("z"), F.lit(1e-3)).alias("s")
    )
    levels = stats.groupBy(KEY).agg(
        F.array(*[
            F.coalesce(F.max(F.when(F.col("regime") == k, F.col(c))), F.lit(0.0)) for k in STATES for c in ("m", "s")
        ]).alias("levels")
    )
    even = F.lit(1 / 3)
    moves = transition_matrix(regimes).groupBy(KEY).agg(
        F.array(*[
            F.coalesce(F.max(F.when(F.col("from_regime") == k, F.col(f"to_{n}"))), even) for k in STATES for n in NAMES
        ]).alias("moves")
    )
    rows = regimes.withColumn("pos", F.row_number().over(by_series()).cast("long"))
    rows = rows.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK))
    moves_or_even = F.coalesce("moves", F.array(*[even] * 9))
    out = rows.join(levels, KEY).join(moves, KEY, "left").withColumn("moves", moves_or_even)
    return stored(out.select(KEY, TIME, "pos", "block", "z", "levels", "moves"), "path_blocks")


def _ends(rows: DataFrame, best: bool) -> DataFrame:
    """``KEY, block, before, after``: what arrives at a block from the rows before it and from those behind."""

    def product(table: pa.Table) -> pa.Table:
        table, cells = _matrices(table)
        while len(cells) > 1:  # neighbours in pairs; an odd one waits
            odd = cells[len(cells) - len(cells) % 2 :]
            cells = np.concatenate([_combined(cells[0:-1:2][: len(cells) // 2], cells[1::2], best), odd])
        return pa.table([table.column(KEY).slice(0, 1), table.column("block").slice(0, 1), pa.array([cells[0].ravel()])], names=[KEY, "block", "cells"])

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("block").combine_chunks()
        cells = np.array(table.column("cells").to_pylist()).reshape(-1, 3, 3)
        count = len(cells)
        before, after = np.full((count, 3), -np.inf), np.zeros((count, 3))
        before[0, 0] = 0.0  # the first row of a series starts from any state alike
        for b in range(1, count):
            before[b] = _combined(before[b - 1][None, :], cells[b - 1], best)[0]
        for b in range(count - 2, -1, -1):
            after[b] = _combined(cells[b + 1], after[b + 1][:, None], best)[:, 0]
        return pa.table([table.column(KEY), table.column("block"), pa.array(list(before)), pa.array(list(after))], names=[KEY, "block", "before", "after"])

    kind = rows.schema[KEY].dataType.simpleString()
    blocks = rows.groupBy(KEY, "block").applyInArrow(product, f"{KEY} {kind}, block long, cells array<double>")
    return blocks.groupBy(KEY).applyInArrow(scan, f"{KEY} {kind}, block long, before array<double>, after array<double>")


def _finished(rows: DataFrame, ends: DataFrame, finish, columns: str) -> DataFrame:
    """``finish`` gives the result columns of a block from its matrices and what arrives at its ends."""
    kind = rows.schema[KEY].dataType.simpleString()
    time = rows.schema[TIME].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table, cells = _matrices(left)
        before, after = (np.array(right.column(c)[0].as_py()) for c in ("before", "after"))
        return pa.table([table.column(KEY), table.column(TIME), *finish(cells, before, after)], names=[KEY, TIME, *names])

    both = rows.groupBy(KEY, "block").cogroup(ends.groupBy(KEY, "block"))
    return both.applyInArrow(run, f"{KEY} {kind}, {TIME} {time}, {columns}")


def likely_path(regimes: DataFrame) -> DataFrame:
    """Most likely state path of every series for normal states with the estimated moves.

    State levels and moves come from the labelled rows. Ties go to the lower state.
    """

    def finish(cells: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[pa.Array]:
        score, back = before, np.zeros((len(cells), 3), dtype=np.int64)
        for t in range(len(cells)):
            step = score[:, None] + cells[t]
            back[t], score = step.argmax(axis=0), step.max(axis=0)
        path = np.zeros(len(cells), dtype=np.int32)
        path[-1] = (score + after).argmax()
        for t in range(len(cells) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return [pa.array(path, pa.int32())]

    rows = _blocks(regimes)
    return _finished(rows, _ends(rows, best=True), finish, "state int")


def smoothed_states(regimes: DataFrame) -> DataFrame:
    """Probability of each state at a row given all rows of its series, for the same states and moves."""

    def finish(cells: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[pa.Array]:
        ahead, behind = np.zeros((len(cells), 3)), np.zeros((len(cells), 3))
        for t in range(len(cells)):
            before = ahead[t] = np.logaddexp.reduce(before[:, None] + cells[t], axis=0)
        for t in range(len(cells) - 1, -1, -1):
            behind[t] = after
            after = np.logaddexp.reduce(cells[t] + after[None, :], axis=1)
        both = ahead + behind
        return [pa.array(c) for c in np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None]).T]

    rows = _blocks(regimes)
    return _finished(rows, _ends(rows, best=False), finish, ", ".join(f"smooth_{n} double" for n in NAMES))


def regime_table(regimes: DataFrame, path: DataFrame) -> DataFrame:
    """Labels, posteriors and most likely state side by side."""
    return regimes.join(path, [KEY, TIME])
