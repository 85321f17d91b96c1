"""Gradient boosted trees for every series and window at once.

A series is bounded by the calendar, so Spark deals the rows to (series, run of windows) groups, and a group
fits its windows one after the other from histograms: columns are binned once for a window, a level of a
tree is one weighted count over (node, feature, bin) for all its nodes, running sums over the bins give
every split, and the same sums give the gain of each feature. All fits of all series and windows are one
job; nothing is looped over by the driver.

Loss is squared error; a split maximises GL^2/(NL+l2) + GR^2/(NR+l2) - G^2/(N+l2). Samples of rows and
columns are drawn by a hash of the row's place, or the column's, with the round, so a fit is reproducible and
the same wherever it runs. Edges come from the training rows of the window only. Missing values go right.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.functions.windows import KEY, TIME, by_series, whole_series


TIE = 1e-9


@dataclass(frozen=True)
class Boosting:
    rounds: int = 100
    depth: int = 3
    rate: float = 0.05
    l2: float = 1.0
    row_share: float = 0.8
    column_share: float = 1.0
    bins: int = 256
    least_rows: int = 1
    seed: int = 42


# the forecasting models, and the lighter ones that only rank features
FORECAST = Boosting(rounds=200, l2=2.0, column_share=0.8)
HISTORY = Boosting(rounds=100)
RANKING = Boosting(rounds=100, rate=0.1)


def share(seed: int, turn: int, place: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on nothing but the arguments."""
    start = (seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64
    x = place.astype(np.uint64) + np.uint64(start)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of all bins but the last; every distinct value is a bin where they are few."""
    values = np.unique(column[~np.isnan(column)])
    if len(values) > bins:
        values = np.unique(np.quantile(column[~np.isnan(column)], np.arange(1, bins + 1) / bins, method="lower"))
    return values[:-1]


class Trees:
    """Trees over binned columns; a node without a split sends everything left."""

    def __init__(self, x: np.ndarray, y: np.ndarray, place: np.ndarray, options: Boosting):
        self.options = o = options
        self.edges = [edges(x[:, f], o.bins) for f in range(x.shape[1])]
        code = self.code(x)
        rows, columns = code.shape
        self.base = float(y.mean())
        self.gain, self.splits = np.zeros(columns), np.zeros(columns, dtype=np.int64)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = max(len(e) for e in self.edges) + 1
        cell = code + np.arange(columns) * width
        taken = max(1, int(o.column_share * columns))
        least = 1e-12 * float(np.square(y - self.base).sum())
        pred = np.full(rows, self.base)
        for turn in range(o.rounds):
            used = np.flatnonzero(share(o.seed, turn, place) < o.row_share)
            chosen = np.sort(np.argsort(share(o.seed + 1, turn, np.arange(columns)), kind="stable")[:taken])
            barred = np.ones(columns, dtype=bool)
            barred[chosen] = False
            gradient = pred - y
            node = np.zeros(rows, dtype=np.int64)
            feature, cut = np.full(2**o.depth - 1, -1), np.zeros(2**o.depth - 1, dtype=np.int64)
            for level in range(o.depth):
                nodes = 2**level
                key = (node[used, None] * (columns * width) + cell[used][:, chosen]).ravel()
                shape = (nodes, columns, width)
                g = np.bincount(key, np.repeat(gradient[used], taken), nodes * columns * width).reshape(shape).cumsum(axis=2)
                n = np.bincount(key, minlength=nodes * columns * width).reshape(shape).cumsum(axis=2)
                all_g = np.bincount(node[used], gradient[used], nodes)[:, None, None]
                all_n = np.bincount(node[used], minlength=nodes)[:, None, None]
                right = all_n - n
                gain = g**2 / (n + o.l2) + (all_g - g) ** 2 / (right + o.l2) - all_g**2 / (all_n + o.l2)
                gain[(n < o.least_rows) | (right < o.least_rows)] = -np.inf
                gain[:, barred] = -np.inf
                gain = gain.reshape(nodes, -1)
                won = gain.max(axis=1)
                # splits that part the same rows differ by rounding only: the first one is taken
                best = (gain >= (won - TIE * np.abs(won))[:, None]).argmax(axis=1)
                own = slice(nodes - 1, 2 * nodes - 1)
                feature[own] = np.where(won > least, best // width, -1)
                cut[own] = best % width
                np.add.at(self.gain, feature[own][won > least], won[won > least])
                np.add.at(self.splits, feature[own][won > least], 1)
                node = self.step(code, node, feature[own], cut[own])
            leaves = 2**o.depth
            value = np.bincount(node[used], gradient[used], leaves) / (np.bincount(node[used], minlength=leaves) + o.l2)
            value *= -o.rate
            self.trees.append((feature, cut, value))
            pred += value[node]

    def code(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)])

    @staticmethod
    def step(code: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        f = feature[node]
        return 2 * node + ((f >= 0) & (code[np.arange(len(node)), f] > cut[node]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        code = self.code(x)
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.options.depth):
                own = slice(2**level - 1, 2 ** (level + 1) - 1)
                node = self.step(code, node, feature[own], cut[own])
            out += value[node]
        return out

    def importance(self) -> np.ndarray:
        """Mean gain of a feature's splits, all together one."""
        mean = self.gain / np.maximum(self.splits, 1)
        return mean / mean.sum() if mean.sum() > 0 else mean


_CELL = pa.struct([("feature", pa.string()), ("importance", pa.float64())])


def fitted(
    groups: DataFrame, keys: Sequence[str], features: Sequence[str], options: Boosting,
    windows: Callable[[pa.Table, np.ndarray], list[tuple[int, np.ndarray, np.ndarray]]],
    keep: Sequence[str] = (),
) -> DataFrame:
    """A fit for each window of each group: ``KEY, window, n_train``, scored rows and importances.

    ``windows`` names (number, training rows, rows to score) of a group whose rows are in order of ``pos``.
    """
    features, keep, keys = list(features), [TIME, *keep], list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    cells = ", ".join([f"{c}: {kinds[c]}" for c in keep] + ["actual: double", "pred: double"])
    schema = (
        f"{KEY} {kinds[KEY]}, window long, n_train long, scored array<struct<{cells}>>, "
        "importances array<struct<feature: string, importance: double>>"
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        x = np.column_stack([table.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features])
        y = table.column("target").cast(pa.float64()).to_numpy(zero_copy_only=False)
        pos = table.column("pos").to_numpy()
        out = []
        for number, train, rest in windows(table, pos):
            if not len(train):
                continue
            trees = Trees(x[train], y[train], pos[train], options)
            at = pa.array(rest)
            columns = [table.column(c).take(at).combine_chunks() for c in keep]
            columns += [pa.array(y[rest]), pa.array(trees.predict(x[rest]))]
            scored = pa.StructArray.from_arrays(columns, [*keep, "actual", "pred"])
            gains = pa.StructArray.from_arrays([pa.array(features), pa.array(trees.importance())], fields=list(_CELL))
            out.append(
                pa.table(
                    [
                        table.column(KEY).slice(0, 1), pa.array([number], pa.int64()), pa.array([len(train)], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), scored),
                        pa.ListArray.from_arrays(pa.array([0, len(features)], pa.int32()), gains),
                    ],
                    names=[KEY, "window", "n_train", "scored", "importances"],
                )
            )
        if out:
            return pa.concat_tables(out)
        structs = pa.struct([(c, table.schema.field(c).type) for c in keep] + [("actual", pa.float64()), ("pred", pa.float64())])
        types = [table.schema.field(KEY).type, pa.int64(), pa.int64(), pa.list_(structs), pa.list_(_CELL)]
        return pa.schema(list(zip([KEY, "window", "n_train", "scored", "importances"], types))).empty_table()

    columns = list(dict.fromkeys([*keys, "pos", *keep, "target", *features]))
    extra = [c for c in ("is_test", "_n") if c in groups.columns and c not in columns]
    return groups.select(*columns, *extra).groupBy(*keys).applyInArrow(run, schema)


def _tail(table: pa.Table, pos: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    test = table.column("is_test").to_numpy(zero_copy_only=False).astype(bool)
    return [(0, np.flatnonzero(~test), np.flatnonzero(test))]


def boosted_tail(
    split: DataFrame, features: Sequence[str], name: str, options: Boosting = FORECAST, keep: Sequence[str] = ()
) -> DataFrame:
    """Trees fitted on the training rows of each series, forecasts of its test tail (``is_test``)."""
    fits = fitted(_placed(split), [KEY], features, options, _tail, keep)
    return fits.select(KEY, F.inline("scored")).select(KEY, TIME, *keep, F.lit(name).alias("model"), "actual", "pred")


def _placed(table: DataFrame) -> DataFrame:
    return table if "pos" in table.columns else table.withColumn("pos", F.row_number().over(by_series()))


def tree_gains(train: DataFrame, features: Sequence[str], options: Boosting = RANKING) -> DataFrame:
    """``KEY, feature, importance`` of trees fitted on all rows of each series."""
    fits = fitted(_placed(train).withColumn("is_test", F.lit(False)), [KEY], features, options, _tail)
    return fits.select(KEY, F.inline("importances"))


def walk_forward(
    table: DataFrame, features: Sequence[str], options: Boosting = FORECAST, start: int = 756, step: int = 21,
    rolling: int | None = None, run: int = 6,
) -> DataFrame:
    """A fit after every ``step`` rows from row ``start`` on, scored on the ``step`` rows behind it.

    As in the other windowed evaluations the last, shorter window isn't scored. A group holds ``run`` windows,
    so a row goes to at most 1 / ``run`` of the windows behind it.
    """
    rows = table.withColumn("_n", F.count(F.lit(1)).over(whole_series()))

    def number(row: Column) -> Column:
        """The window that scores a row."""
        return F.ceil((row - start) / step) - 1

    last = number(F.col("_n") - step)
    first = F.greatest(number(F.col("pos")), F.lit(0))
    upto = last if rolling is None else F.least(last, F.floor((F.col("pos") - start + rolling - 1) / step))
    # sequence() counts down where the end is smaller
    spread = rows.filter((last >= 0) & (first <= upto)).withColumn(
        "run", F.explode(F.sequence(F.floor(first / run), F.floor(upto / run)))
    )

    def windows(rows: pa.Table, pos: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        count = -(-(rows.column("_n")[0].as_py() - step - start) // step)
        mine = int(rows.column("run")[0].as_py())
        out = []
        for w in range(mine * run, min((mine + 1) * run, count)):
            end = start + w * step
            low = 0 if rolling is None else end - rolling
            train = np.flatnonzero((pos > low) & (pos <= end))
            out.append((w, train, np.flatnonzero((pos > end) & (pos <= end + step))))
        return out

    return fitted(spread, [KEY, "run"], features, options, windows)


def forecasts(fits: DataFrame) -> DataFrame:
    return fits.select(KEY, "window", "n_train", F.inline("scored"))


def importances(fits: DataFrame) -> DataFrame:
    return fits.select(KEY, "window", F.inline("importances"))
