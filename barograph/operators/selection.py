"""Feature ranking and elimination, histories of importances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions import linalg
from barograph.functions.windows import KEY, TIME, correlation
from barograph.operators.boosting import RANKING, Boosting, tree_gains
from barograph.operators.cross import target_correlations
from barograph.operators.evaluate import qlike, rmse
from barograph.operators.regression import ALPHA, fold_ids


def _place(df: DataFrame, score: str, out: str, top_k: int | None) -> DataFrame:
    # scores equal but for rounding (a feature and a monotone twin) tie, then the name decides
    w = Window.partitionBy(KEY).orderBy(F.round(score, 9).desc_nulls_last(), "feature")
    df = df.withColumn(out, F.row_number().over(w))
    return df if top_k is None else df.filter(F.col(out) <= top_k)


def pearson_ranking(train: DataFrame, features: Sequence[str], top_k: int | None = 20) -> DataFrame:
    corr = target_correlations(train, features).select(
        KEY, "feature", F.abs("corr").alias("pearson_abs_corr")
    )
    return _place(corr, "pearson_abs_corr", "rank_pearson", top_k)


def mutual_information_ranking(
    train: DataFrame, features: Sequence[str], bins: int = 10, top_k: int | None = 20
) -> DataFrame:
    """Mutual information of each feature with the target over quantile bins.

    Values that agree to nine decimals are ties, which the date settles.
    Bins come from window ranks of the feature columns; what is shuffled afterwards is the
    joint count table, at most ``bins^2`` rows per series and feature.
    """
    rows = train.select(KEY, TIME, "target", *features)

    def binned(c: str):
        return F.ntile(bins).over(Window.partitionBy(KEY).orderBy(F.round(c, 9), TIME)).alias(c)

    coded = rows.select(KEY, binned("target"), *[binned(f) for f in features])
    long = coded.unpivot([KEY, "target"], list(features), "feature", "b")
    joint = long.groupBy(KEY, "feature", "b", "target").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(KEY, "feature")
    n = F.sum("_n").over(whole)
    nx = F.sum("_n").over(Window.partitionBy(KEY, "feature", "b"))
    ny = F.sum("_n").over(Window.partitionBy(KEY, "feature", "target"))
    parts = joint.withColumn("_part", F.col("_n") / n * F.ln(F.col("_n") * n / (nx * ny)))
    mi = parts.groupBy(KEY, "feature").agg(F.sum("_part").alias("mutual_info"))
    return _place(mi, "mutual_info", "rank_mi", top_k)


def tree_gain_ranking(
    train: DataFrame, features: Sequence[str], options: Boosting = RANKING, top_k: int | None = 20
) -> DataFrame:
    """Gain importance of boosted trees fitted on each series."""
    gains = tree_gains(train, features, options)
    return _place(gains.withColumnRenamed("importance", "tree_gain"), "tree_gain", "rank_tree", top_k)


def recursive_elimination(
    train: DataFrame, features: Sequence[str], alpha: float = ALPHA, folds: int = 5, least: int = 5
) -> DataFrame:
    """Backward elimination by the size of the ridge coefficients, number of features by CV.

    Spark aggregates the moments of every fold once; training sets are sums of folds. The
    elimination runs on sub-matrices, one row of moments per series.
    """
    features = list(features)
    cols = [*features, "target"]
    k = len(features)
    rows = fold_ids(train.select(KEY, TIME, *cols), folds)
    blocks = linalg.grouped_moments(rows, [KEY, "fold"], cols).groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct("fold", "n", "mean", "comoment"))).alias("blocks")
    )

    def eliminate(mean, cov, n) -> list[list[int]]:
        """Feature sets from all down to ``least``, dropping the smallest coefficient each time."""
        keep, path = list(range(k)), []
        while True:
            path.append(list(keep))
            if len(keep) <= least:
                return path
            w = linalg.solve_fit(n, mean, cov, keep, k, alpha, True)["coef"]
            keep.pop(int(np.argmin(np.abs(w))))

    def error(fit: dict, xs: list[int], mean, cov) -> float:
        beta = np.asarray(fit["beta"])
        bias = mean[k] - fit["intercept"] - beta @ mean[xs]
        spread = cov[k, k] - 2 * beta @ cov[xs, k] + beta @ cov[np.ix_(xs, xs)] @ beta
        return float(np.sqrt(max(spread + bias * bias, 0.0)))

    @F.pandas_udf("struct<n_selected:int,selected:array<int>,sizes:array<int>,cv_rmse:array<double>>")
    def select(blocks: pd.Series) -> pd.DataFrame:
        out = []
        for series in blocks:
            parts = [(b["n"], *linalg.unpack(b["mean"], b["comoment"])) for b in series]
            scores: dict[int, list[float]] = {}
            for i in range(1, len(parts)):
                n, mean, cov = linalg.pooled(parts[:i])
                for xs in eliminate(mean, cov, n):
                    f = linalg.solve_fit(n, mean, cov, xs, k, alpha, True)
                    scores.setdefault(len(xs), []).append(error(f, xs, parts[i][1], parts[i][2]))
            if not scores:  # too short for a fold: nothing speaks against any feature
                out.append((k, list(range(k)), [], []))
                continue
            sizes = sorted(scores)
            means = [float(np.mean(scores[s])) for s in sizes]
            best = sizes[int(np.argmin(means))]
            n, mean, cov = linalg.pooled(parts)
            chosen = next(xs for xs in eliminate(mean, cov, n) if len(xs) == best)
            out.append((best, chosen, sizes, means))
        return pd.DataFrame(out, columns=["n_selected", "selected", "sizes", "cv_rmse"])

    names = F.array(*[F.lit(f) for f in features])
    return blocks.select(KEY, select("blocks").alias("s")).select(
        KEY,
        "s.n_selected",
        F.transform("s.selected", lambda i: F.element_at(names, i + 1)).alias("selected_features"),
        "s.sizes",
        "s.cv_rmse",
    )


def merge_rankings(
    pearson: DataFrame, mutual: DataFrame, tree: DataFrame, elimination: DataFrame | None
) -> DataFrame:
    """Outer join of the rankings with the mean of the ranks present and the selected flag."""
    on = [KEY, "feature"]
    merged = pearson.join(mutual, on, "full_outer").join(tree, on, "full_outer")
    if elimination is not None:
        chosen = elimination.select(KEY, F.explode("selected_features").alias("feature")).withColumn(
            "rfecv_selected", F.lit(1)
        )
        merged = merged.join(chosen, on, "left").na.fill(0, ["rfecv_selected"])
    ranks = F.array_compact(F.array("rank_pearson", "rank_mi", "rank_tree"))
    mean = F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x) / F.size(ranks)
    return merged.withColumn("avg_rank", mean)


def selection_summary(merged: DataFrame) -> DataFrame:
    return merged.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("features_ranked"),
        *[
            F.min_by("feature", F.struct(F.col(r).isNull(), F.col(r), F.col("feature"))).alias(f"top_{m}")
            for m, r in (("pearson", "rank_pearson"), ("mi", "rank_mi"), ("tree", "rank_tree"))
        ],
    )


def window_metrics(preds: DataFrame) -> DataFrame:
    """Metrics of each window of the forecasts of a walk-forward."""
    return preds.groupBy(KEY, "window").agg(
        F.first("n_train").alias("n_train"), F.count(F.lit(1)).alias("n"), F.min(TIME).alias("test_start"), F.max(TIME).alias("test_end"),
        rmse().alias("rmse"), qlike().alias("qlike"),
    )


def correlation_history(table: DataFrame, features: Sequence[str], step: int = 252) -> DataFrame:
    """Absolute correlation with the target per stretch of ``step`` rows, as an importance history.

    The last stretch may be shorter: ``n`` has its rows, and one row or a constant has no correlation.
    """
    rows = table.withColumn("window", F.floor((F.col("pos") - 1) / step))
    wide = rows.groupBy(KEY, "window").agg(
        F.count(F.lit(1)).alias("n"), *[F.abs(correlation(f, "target")).alias(f) for f in features]
    )
    return wide.unpivot([KEY, "window", "n"], list(features), "feature", "importance")


def importance_profile(history: DataFrame, top_k: int = 10) -> DataFrame:
    """The ``top_k`` features by mean importance, each scaled to [0, 1] over the windows."""
    mean = history.groupBy(KEY, "feature").agg(F.avg("importance").alias("mean_importance"))
    place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("mean_importance"), "feature"))
    top = mean.withColumn("place", place).filter(F.col("place") <= top_k)
    w = Window.partitionBy(KEY, "feature")
    low, high = F.min("importance").over(w), F.max("importance").over(w)
    scaled = F.coalesce(F.try_divide(F.col("importance") - low, high - low), F.lit(0.0))
    return history.join(top, [KEY, "feature"]).withColumn("scaled", scaled)
