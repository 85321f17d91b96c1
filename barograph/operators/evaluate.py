"""Forecast evaluation, ranking and regimes.

Forecasts are long rows ``(series_id, t, model, actual, pred)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.windows import KEY, TIME, by_series, trailing, whole_series

FLOOR = 1e-8
WEIGHTS = {"rmse": 0.35, "qlike": 0.30, "dir_acc": 0.20, "mae": 0.15}
LOWER_IS_BETTER = ("rmse", "mae", "qlike")


def rmse(actual: str = "actual", pred: str = "pred") -> Column:
    return F.sqrt(F.avg(F.pow(F.col(actual) - F.col(pred), F.lit(2.0))))


def mae(actual: str = "actual", pred: str = "pred") -> Column:
    return F.avg(F.abs(F.col(actual) - F.col(pred)))


def mape(actual: str = "actual", pred: str = "pred", eps: float = 1e-10) -> Column:
    return F.avg(F.abs(F.col(actual) - F.col(pred)) / (F.abs(F.col(actual)) + eps)) * 100


def qlike(actual: str = "actual", pred: str = "pred", floor: float = FLOOR) -> Column:
    h, v = F.greatest(pred, F.lit(floor)), F.greatest(actual, F.lit(floor))
    return F.avg(F.ln(h) + v / h)


def qlike_ratio(actual: str = "actual", pred: str = "pred", floor: float = 1e-6) -> Column:
    h, v = F.greatest(pred, F.lit(floor)), F.greatest(actual, F.lit(floor))
    return F.avg(v / h - F.ln(v / h) - 1)


def with_direction(df: DataFrame, *keys: str) -> DataFrame:
    """1 where forecast and actual moved the same way since the row before, null on the first."""
    w = by_series(*keys)
    moved = F.signum(F.col("actual") - F.lag("actual").over(w))
    guessed = F.signum(F.col("pred") - F.lag("pred").over(w))
    return df.withColumn("_hit", (moved == guessed).cast("double"))


def metric_table(predictions: DataFrame, *extra: str) -> DataFrame:
    """RMSE, MAE, QLIKE, directional accuracy and N per series, model and ``extra`` keys."""
    keys = (KEY, "model", *extra)
    return (
        with_direction(predictions, *keys)
        .groupBy(*keys)
        .agg(
            rmse().alias("rmse"),
            mae().alias("mae"),
            qlike().alias("qlike"),
            (F.avg("_hit") * 100).alias("dir_acc"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def metrics_overall_and_by_regime(predictions: DataFrame, min_rows: int = 5) -> DataFrame:
    """Metrics over all rows and over each regime; direction is taken inside the subset."""
    both = predictions.withColumn("regime", F.explode(F.array(F.lit("All"), F.col("regime"))))
    out = metric_table(both, "regime")
    return out.filter((F.col("regime") == "All") | (F.col("n") >= min_rows))


def tercile_labels(df: DataFrame, value: str, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """``low``, ``medium`` or ``high`` by exact quantiles of the series."""
    cuts = df.groupBy(KEY).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_q"))
    x = F.col(value)
    label = F.when(x >= F.col("_q")[1], "high").when(x <= F.col("_q")[0], "low").otherwise("medium")
    return df.join(cuts, KEY).withColumn("regime", label).drop("_q")


def regime_metrics(predictions: DataFrame, regimes: DataFrame, min_rows: int = 10) -> DataFrame:
    joined = predictions.join(regimes.select(KEY, TIME, "regime"), [KEY, TIME])
    return (
        joined.groupBy(KEY, "model", "regime")
        .agg(
            F.count(F.lit(1)).alias("n"),
            rmse().alias("rmse"),
            mae().alias("mae"),
            qlike().alias("qlike"),
        )
        .filter(F.col("n") >= min_rows)
    )


def regime_days(regimes: DataFrame) -> DataFrame:
    return regimes.groupBy(KEY, "regime").agg(F.count(F.lit(1)).alias("n_days"))


def _order(metric: str) -> Column:
    return F.col(metric).asc_nulls_last() if metric in LOWER_IS_BETTER else F.col(metric).desc_nulls_last()


def rank_models(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Rank per metric inside the series (ties share the best rank), weighted score, overall rank."""
    weights = weights or WEIGHTS
    w = Window.partitionBy(KEY)
    df = metrics.withColumns({f"rank_{m}": F.rank().over(w.orderBy(_order(m))) for m in weights})
    score = sum((F.col(f"rank_{m}") * v for m, v in weights.items()), F.lit(0.0))
    # rounded so that equal ranks tie whatever the order of addition
    df = df.withColumn("composite_score", F.round(score, 9))
    return df.withColumn("overall_rank", F.rank().over(w.orderBy("composite_score")))


def rank_across_series(ranked: DataFrame) -> DataFrame:
    """Mean metrics and score per model over all series, best first.

    The position is a window over one row per model.
    """
    cols = ("rmse", "mae", "qlike", "dir_acc", "composite_score")
    mean = ranked.groupBy("model").agg(*[F.avg(c).alias(c) for c in cols])
    order = Window.partitionBy(F.lit(1)).orderBy(F.round("composite_score", 9), "model")
    return mean.withColumn("final_rank", F.row_number().over(order))


def pivot_metric(metrics: DataFrame, metric: str, series: Sequence[str]) -> DataFrame:
    return metrics.groupBy("model").pivot(KEY, list(series)).agg(F.avg(metric))


def pipeline_summary(ranked: DataFrame, by_regime: DataFrame) -> DataFrame:
    """Ranking joined with the RMSE per regime."""
    wide = (
        by_regime.groupBy(KEY, "model")
        .pivot("regime", ["high", "low", "medium"])
        .agg(F.avg("rmse"))
        .withColumnsRenamed({r: f"rmse_{r}" for r in ("high", "low", "medium")})
    )
    return ranked.join(wide, [KEY, "model"], "left")


def normalise_metrics(ranking: DataFrame, *keys: str) -> DataFrame:
    """Min-max per metric over the models, 1 is best; a constant metric gives 1 or 0.5."""
    w = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(1))
    out = {}
    for m in (*LOWER_IS_BETTER, "dir_acc"):
        low, high = F.min(m).over(w), F.max(m).over(w)
        part = F.try_divide(F.col(m) - low, high - low)
        if m in LOWER_IS_BETTER:
            out[f"{m}_norm"] = F.when(high > low, 1 - part).otherwise(1.0)
        else:
            out[f"{m}_norm"] = F.when(high > low, part).otherwise(0.5)
    return ranking.withColumns(out)


def rolling_rmse(predictions: DataFrame, window: int = 63, min_rows: int = 10) -> DataFrame:
    sq = F.pow(F.col("actual") - F.col("pred"), F.lit(2.0))
    return predictions.withColumn("_se", sq).withColumn(
        "rolling_rmse",
        F.sqrt(trailing(F.avg, "_se", window, min_rows, w=by_series(KEY, "model"))),
    ).drop("_se")


def naive_forecasts(table: DataFrame, test_rows: int | None = 500) -> DataFrame:
    """Long forecasts of the target from its own lagged averages (last value, 5 and 21 rows)."""
    if test_rows is not None:
        rows = F.count(F.lit(1)).over(whole_series())
        table = table.withColumn("_rows", rows).filter(F.col("pos") > F.col("_rows") - test_rows)
    models = {"last": "rv_lag_1", "mean5": "rv_lag_5", "mean21": "rv_lag_21"}
    return table.select(
        KEY, TIME, F.col("target").alias("actual"), *[F.col(c).alias(m) for m, c in models.items()]
    ).unpivot([KEY, TIME, "actual"], list(models), "model", "pred")
