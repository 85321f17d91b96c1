"""Alerts on a stream of forecasts.

State per key: the running loss of the baseline rows and at most one window of forecasts. Rows that aren't
newer than the last row of their key come too late for its windows; every record says how many there were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barograph.functions.windows import KEY, TIME

OUTPUT = (
    f"{KEY} string, window bigint, date date, rmse double, qlike double, alert_upper_rmse double, "
    "perf_alert int, health_alert int, alert_level string, late bigint"
)
STATE = "seen bigint, late bigint, last_day string, base_sum double, actual array<double>, pred array<double>"


def monitor_stream(
    stream: DataFrame, rows: int = 63, step: int = 21, limit: float = 1.4
) -> DataFrame:
    """A record for every full window of ``rows`` forecasts, moved by ``step``, after the baseline.

    ``stream`` has ``series_id, t, actual, pred``; the performance limit is ``limit`` times the
    loss of the first ``rows`` forecasts.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, late, last, base, ys, ps = state.get if state.exists else (0, 0, "", 0.0, [], [])
        ys, ps = list(ys), list(ps)
        out = []
        for day, y, p in pd.concat(list(batches)).sort_values(TIME)[[TIME, "actual", "pred"]].itertuples(index=False):
            if p is None or p != p:
                continue
            if str(day) <= last:
                late += 1
                continue
            last = str(day)
            seen += 1
            if seen <= rows:
                base += (y - p) ** 2
                continue
            ys, ps = (ys + [y])[-rows:], (ps + [p])[-rows:]
            done = seen - 2 * rows
            if done >= 0 and done % step == 0:
                record = _record(np.array(ys), np.array(ps), base / rows, limit)
                out.append((key[0], done // step, day, *record, late))
        state.update((seen, late, last, base, [float(v) for v in ys], [float(v) for v in ps]))
        yield pd.DataFrame(
            out,
            columns=[KEY, "window", "date", "rmse", "qlike", "alert_upper_rmse", "perf_alert", "health_alert", "alert_level", "late"],
        )

    return (
        stream.select(KEY, TIME, "actual", "pred")
        .groupBy(KEY)
        .applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    )


def _record(y: np.ndarray, p: np.ndarray, base_mse: float, limit: float) -> tuple:
    loss = float(np.sqrt(np.mean((y - p) ** 2)))
    h = np.maximum(p, 1e-8)
    qlike = float(np.mean(np.log(h) + np.maximum(y, 1e-8) / h))
    upper = float(np.sqrt(base_mse) * limit)
    perf = int(loss > upper)
    size = np.abs(p)
    health = int(p.std() < 1e-8 or (p < 0).any() or size.max() > 10 * size.mean())
    return loss, qlike, upper, perf, health, ("GREEN", "YELLOW", "RED")[perf + health]
