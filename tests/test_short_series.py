"""Series that are shorter than folds, blocks or windows, and panels with equal series."""

import numpy as np
import pandas as pd
import pytest
from helpers import days, wide_frame
from pyspark.sql import functions as F

from barograph.operators import regression, risk, selection

X = ["x0", "x1", "x2", "x3", "x4", "x5"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    frames = []
    for name, n in (("long", 90), ("short", 4), ("one", 1)):
        f = pd.DataFrame(rng.normal(size=(n, 6)), columns=X)
        frames.append(f.assign(target=rng.normal(size=n), series_id=name, t=days(n), pos=range(1, n + 1)))
    return spark.createDataFrame(pd.concat(frames))


def test_folds_of_short_series(table):
    rows = regression.fold_ids(table, 5).groupBy("series_id").agg(F.max("fold").alias("f")).collect()
    assert {r["series_id"]: r["f"] for r in rows} == {"long": 5, "short": 0, "one": 0}


def test_elimination_keeps_all_features_of_a_short_series(table):
    out = {r["series_id"]: r for r in selection.recursive_elimination(table, X).collect()}
    assert set(out) == {"long", "short", "one"}
    assert out["short"]["selected_features"] == X and list(out["one"]["cv_rmse"]) == []


def test_equal_series_rule_a_grid_point_out(spark):
    """Two equal series make every correlation matrix singular."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=60)
    y = rng.normal(size=60)
    wide = wide_frame(np.column_stack([x, x, y]), "ABC")
    grid = risk.dcc_grid(risk.matrix_pairs(spark.createDataFrame(wide), "ABC"), "ABC", (0.02, 0.05), (0.9,)).collect()
    assert grid and all(r["loglik"] == -np.inf or np.isfinite(r["loglik"]) for r in grid)
