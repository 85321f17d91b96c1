"""Ridge forecasts that learn in time order, as keyed state.

Two learners see the same rows. The EWMA ridge solves a ridge regression on decayed moments of the
normalised features; the SGD ridge takes a gradient step per row. Both forecast a row from the rows before
it. All moments are linear recursions, so a batch of rows is one pass of array operations: running means,
decayed sums, and one stacked solve for the weights after every row. Only the gradient steps, whose size
depends on the forecast before, go row by row.

A row that isn't newer than the last one learned of its key can't be learned any more; it is left out and
counted in ``late``. State per key is a few small arrays and is kept as long as the key may send rows. The
batch form takes one series at a time, bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barograph.functions.windows import KEY, TIME, by_series, whole_series
from barograph.operators.evaluate import rmse

BURN_IN = 252
OUTPUT = (
    f"{KEY} string, {TIME} date, step bigint, actual double, pred_ewma double, pred_sgd double, "
    "weights array<double>, late bigint"
)
STATE = (
    "step bigint, late bigint, last_day string, mean array<double>, spread array<double>, slow array<double>, "
    "gram array<double>, cross array<double>, sgd array<double>"
)
EWMA = {"alpha": 10.0, "decay": 0.97}
SGD = {"alpha": 0.01, "rate": 0.005, "fade": 1e-4, "decay": 0.99}
TINY = 1e-8
STRETCH = 256


class Moments(NamedTuple):
    """What is known after ``step`` rows; ``sgd`` holds the weights and, last, the intercept."""

    step: int
    late: int
    last_day: str
    mean: np.ndarray
    spread: np.ndarray
    slow: np.ndarray
    gram: np.ndarray
    cross: np.ndarray
    sgd: np.ndarray


def nothing_seen(k: int) -> Moments:
    return Moments(0, 0, "", *np.zeros((3, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k + 1))


def decayed(x: np.ndarray, decay: float, start: np.ndarray) -> np.ndarray:
    """``out_t = decay * out_(t-1) + (1 - decay) * x_t``, the first before it being ``start``; row 0 is ``start``."""
    out = [start[None]]
    for a in range(0, len(x), STRETCH):
        part = x[a : a + STRETCH]
        power = (decay ** np.arange(1, len(part) + 1)).reshape(-1, *[1] * (x.ndim - 1))
        out.append(power * (out[-1][-1] + (1 - decay) * np.cumsum(part / power, axis=0)))
    return np.concatenate(out)


def normalised(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return (x - mean) / np.sqrt(np.maximum(spread, TINY))


def gradient_steps(inputs: np.ndarray, y: np.ndarray, first: int, start: np.ndarray) -> np.ndarray:
    """Weights and intercept before each row and after the last one; inputs end with a one."""
    shrink = np.append(np.full(inputs.shape[1] - 1, SGD["alpha"]), 0.0)
    size = 2 * SGD["rate"] / (1 + SGD["fade"] * np.arange(first, first + len(y)))
    path = np.vstack([start, np.zeros_like(inputs)])
    for t, u in enumerate(inputs):
        path[t + 1] = path[t] + size[t] * ((y[t] - path[t] @ u) * u - shrink * path[t])
    return path


def advance(seen: Moments, x: np.ndarray, y: np.ndarray) -> tuple[Moments, np.ndarray, np.ndarray, np.ndarray]:
    """Learn rows in order: the new moments, and per row both forecasts and the EWMA weights before it."""
    count = seen.step + np.arange(len(y) + 1)[:, None]
    mean = (seen.step * seen.mean + np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)])) / np.maximum(count, 1)
    moved = (x - mean[:-1]) * (x - mean[1:])
    spread = decayed(moved, EWMA["decay"], seen.spread)
    slow = decayed(moved, SGD["decay"], seen.slow)
    z = normalised(x, mean[1:], spread[1:])
    gram = decayed(z[:, :, None] * z[:, None, :], EWMA["decay"], seen.gram)
    cross = decayed(z * y[:, None], EWMA["decay"], seen.cross)
    weights = np.linalg.solve(gram + EWMA["alpha"] * np.eye(x.shape[1]), cross[..., None])[..., 0]
    ahead = normalised(x, mean[:-1], spread[:-1])
    one = np.ones((len(y), 1))
    path = gradient_steps(np.hstack([normalised(x, mean[1:], slow[1:]), one]), y, seen.step + 1, seen.sgd)
    ahead_slow = np.hstack([normalised(x, mean[:-1], slow[:-1]), one])
    after = seen._replace(
        step=seen.step + len(y), mean=mean[-1], spread=spread[-1], slow=slow[-1], gram=gram[-1], cross=cross[-1], sgd=path[-1]
    )
    return after, (weights[:-1] * ahead).sum(1), (path[:-1] * ahead_slow).sum(1), weights[:-1]


def fold(pdf: pd.DataFrame, seen: Moments, features: Sequence[str], burn_in: int) -> tuple[pd.DataFrame, Moments]:
    """Forecast and learn the rows that are newer than the state, one per day, in time order."""
    pdf = pdf.sort_values(TIME, kind="stable")
    day = pdf[TIME].astype(str)
    new = pdf[(day > seen.last_day) & ~day.duplicated()]
    seen = seen._replace(late=seen.late + len(pdf) - len(new))
    y = new["target"].to_numpy(float)
    before = seen.step
    seen, ewma, sgd, weights = advance(seen, new[list(features)].to_numpy(float), y)
    if len(new):
        seen = seen._replace(last_day=str(new[TIME].iloc[-1]))
    step = np.arange(before, seen.step)
    ready = step >= burn_in
    return pd.DataFrame(
        {
            KEY: new[KEY].to_numpy(),
            TIME: new[TIME].to_numpy(),
            "step": step,
            "actual": y,
            "pred_ewma": np.where(ready, ewma, np.nan),
            "pred_sgd": np.where(ready, sgd, np.nan),
            "weights": [w.tolist() if r else None for w, r in zip(weights, ready)],
            "late": seen.late,
        }
    ), seen


def online_batch(table: DataFrame, features: Sequence[str], burn_in: int = BURN_IN) -> DataFrame:
    features = list(features)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf, nothing_seen(len(features)), features, burn_in)[0]

    return table.select(KEY, TIME, "target", *features).groupBy(KEY).applyInPandas(run, OUTPUT)


def online_stream(stream: DataFrame, features: Sequence[str], burn_in: int = BURN_IN) -> DataFrame:
    """The same learners over a stream of feature rows."""
    features = list(features)
    k = len(features)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = nothing_seen(k)
        if state.exists:
            step, late, day, *arrays = state.get
            seen = Moments(step, late, day, *(np.array(v, float).reshape(old.shape) for v, old in zip(arrays, seen[3:])))
        out, seen = fold(pd.concat(list(batches)), seen, features, burn_in)
        state.update((*seen[:3], *(v.ravel().tolist() for v in seen[3:])))
        yield out

    return (
        stream.select(KEY, TIME, "target", *features)
        .groupBy(KEY)
        .applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    )


def coefficient_trace(online: DataFrame, features: Sequence[str], every: int = 5) -> DataFrame:
    """Weights in use on every ``every``-th row after the burn-in."""
    kept = online.filter(F.col("weights").isNotNull() & (F.col("step") % every == 0))
    return kept.select(KEY, TIME, "step", *[F.col("weights")[i].alias(f"w_{f}") for i, f in enumerate(features)])


def online_against_offline(online: DataFrame, offline: DataFrame, test_rows: int = 500) -> DataFrame:
    """RMSE of both online learners and the periodically refitted model on the common tail."""
    w = by_series()
    tail = online.withColumn("_back", F.count(F.lit(1)).over(whole_series()) - F.row_number().over(w))
    tail = tail.filter((F.col("_back") < test_rows) & F.col("pred_ewma").isNotNull())
    both = tail.join(offline.select(KEY, TIME, F.col("pred").alias("pred_offline")), [KEY, TIME], "left")
    models = {"EWMA_Online": "pred_ewma", "SGD_Online": "pred_sgd", "Offline_21d": "pred_offline"}
    long = both.select(KEY, "actual", *[F.col(c).alias(m) for m, c in models.items()]).unpivot(
        [KEY, "actual"], list(models), "model", "pred"
    )
    return (
        long.filter(F.col("pred").isNotNull())
        .groupBy(KEY, "model")
        .agg(rmse().alias("rmse"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 10)
    )
