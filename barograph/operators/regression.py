"""Ridge forecasts, walk-forward evaluation, bootstrap intervals and forecast combination.

All fits come from grouped moments. Refits over moving windows reuse block sums, so a
walk-forward run reads every row once however many windows it has.
Tables carry ``series_id, t, pos`` (1..n per series), feature columns and ``target``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions import linalg
from barograph.functions.windows import KEY, TIME, by_series, stack, whole_series
from barograph.operators.evaluate import qlike, rmse, with_direction
from barograph.operators.returns import HAR

ALPHA = 10.0
TEST_ROWS = 500


def train_test(table: DataFrame, test_rows: int = TEST_ROWS) -> DataFrame:
    """Add ``is_test``: the last ``test_rows`` rows of every series."""
    rows = F.count(F.lit(1)).over(whole_series())
    pos = F.row_number().over(by_series())
    return table.withColumns({"is_test": pos > rows - test_rows})


def ridge_models(
    table: DataFrame, sets: dict[str, Sequence[str]], alpha: float = ALPHA, keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """One fit per key and feature set on the training rows: a single pass for all sets."""
    cols = sorted({c for s in sets.values() for c in s}) + ["target"]
    m = linalg.grouped_moments(table.filter(~F.col("is_test")), list(keys), cols)
    fits = linalg.fit_many(m, cols, {name: (xs, alpha, True) for name, xs in sets.items()}, "target")
    return fits.select(*keys, "model", "fit", F.element_at("mean", -1).alias("mean_target"))


def ridge_predictions(
    table: DataFrame, models: DataFrame, sets: dict[str, Sequence[str]], keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """Score the test rows with every model of their key."""
    rows = table.filter(F.col("is_test"))
    score = F.lit(None).cast("double")
    for name, xs in sets.items():
        score = F.when(F.col("model") == name, linalg.linear_score("fit", xs)).otherwise(score)
    joined = rows.join(models, list(keys))
    extra = [k for k in keys if k != KEY]
    return joined.select(
        KEY, TIME, *extra, "model", F.col("target").alias("actual"), score.alias("pred")
    )


def coefficients(models: DataFrame, sets: dict[str, Sequence[str]]) -> DataFrame:
    """Long coefficients: ``coef`` on the standardised feature, ``beta`` on the raw one."""
    names = F.lit(None).cast("array<string>")
    for name, xs in sets.items():
        names = F.when(F.col("model") == name, F.array(*[F.lit(x) for x in xs])).otherwise(names)
    zipped = F.arrays_zip(
        names.alias("term"), F.col("fit.coef").alias("coef"), F.col("fit.beta").alias("beta")
    )
    keep = [c for c in models.columns if c not in ("fit", "mean_target")]
    return models.select(*keep, F.col("fit.intercept").alias("intercept"), F.inline(zipped))


def har_variant_metrics(
    table: DataFrame, sets: dict[str, Sequence[str]], alpha: float = ALPHA
) -> DataFrame:
    """Losses per feature set with the leverage coefficient and the fall-rise contrast."""
    split = train_test(table)
    models = ridge_models(split, sets, alpha)
    losses = (
        ridge_predictions(split, models, sets)
        .groupBy(KEY, "model")
        .agg(rmse().alias("rmse"), qlike().alias("qlike"), F.count(F.lit(1)).alias("n"))
    )
    terms = coefficients(models, sets).groupBy(KEY, "model").agg(
        F.max(F.when(F.col("term") == "leverage_term", F.col("coef"))).alias("lev_coef"),
        (
            F.max(F.when(F.col("term") == "rv_neg_lag_1", F.col("coef")))
            - F.max(F.when(F.col("term") == "rv_pos_lag_1", F.col("coef")))
        ).alias("asym_coef"),
    )
    return losses.join(terms, [KEY, "model"])


# --- alpha grid ----------------------------------------------------------------------


def fold_ids(table: DataFrame, folds: int) -> DataFrame:
    """``fold`` 0 is the first training block, 1..folds the test blocks of expanding CV.

    A series with fewer rows than blocks has training rows only.
    """
    n = F.count(F.lit(1)).over(whole_series())
    pos = F.row_number().over(by_series())
    size = F.floor(n / (folds + 1))
    first = n - folds * size
    fold = F.when(pos <= first, 0).otherwise(F.floor((pos - first - 1) / F.greatest(size, F.lit(1))) + 1)
    return table.withColumn("fold", fold.cast("int"))


def alpha_grid(
    table: DataFrame, xs: Sequence[str] = HAR, alphas: Sequence[float] = (0.1, 1.0, 10.0), folds: int = 5
) -> DataFrame:
    """Mean RMSE over expanding folds for every alpha, unscaled features, best one marked."""
    rows = fold_ids(table, folds)
    cols = [*xs, "target"]
    m = linalg.running_moments(rows, [KEY], "fold", cols).filter(F.col("fold") < folds)
    specs = {str(a): (xs, float(a), False) for a in alphas}
    fits = linalg.fit_many(m, cols, specs, "target").select(
        KEY, (F.col("fold") + 1).alias("fold"), F.col("model").cast("double").alias("alpha"), "fit"
    )
    scored = rows.join(fits, [KEY, "fold"])
    err = F.pow(F.col("target") - linalg.linear_score("fit", xs), F.lit(2.0))
    per_fold = scored.groupBy(KEY, "alpha", "fold").agg(F.sqrt(F.avg(err)).alias("_rmse"))
    cv = per_fold.groupBy(KEY, "alpha").agg(F.avg("_rmse").alias("cv_rmse"))
    best = F.row_number().over(Window.partitionBy(KEY).orderBy("cv_rmse", "alpha")) == 1
    return cv.withColumn("is_best", best)


# --- walk-forward --------------------------------------------------------------------


def walk_forward_models(
    table: DataFrame, xs: Sequence[str], alpha: float, start: int, step: int,
    rolling: int | None = None,
) -> DataFrame:
    """A fit after every ``step`` rows from row ``start`` on; ``block`` is the block it predicts.

    Train windows are whole blocks of ``step`` rows, expanding or the last ``rolling`` rows.
    """
    for name, size in (("start", start), ("rolling", rolling or step)):
        if size % step:
            raise ValueError(f"{name} must be a multiple of step")
    cols = [*xs, "target"]
    rows = table.withColumn("block", F.floor((F.col("pos") - 1) / step))
    frame = None if rolling is None else rolling // step
    m = linalg.running_moments(rows, [KEY], "block", cols, frame)
    m = m.filter(F.col("block") >= start // step - 1)
    ends = rows.groupBy(KEY, "block").agg(F.max(TIME).alias("window_end"))
    fits = linalg.fit(m.join(ends, [KEY, "block"]), cols, xs, "target", alpha, scaled=True)
    return fits.select(
        KEY,
        (F.col("block") + 1).alias("block"),
        "window_end",
        F.col("n").alias("n_train"),
        F.element_at("mean", -1).alias("mean_target"),
        "fit",
    )


def walk_forward_predictions(
    table: DataFrame, models: DataFrame, xs: Sequence[str], step: int, whole_only: bool
) -> DataFrame:
    """Predictions of every block by the fit before it.

    ``whole_only`` keeps blocks that are full and not the last of the series, as the
    windowed evaluation does; otherwise the tail is predicted too.
    """
    rows = table.withColumns(
        {
            "block": F.floor((F.col("pos") - 1) / step),
            "_n": F.count(F.lit(1)).over(whole_series()),
        }
    )
    out = rows.join(models, [KEY, "block"])
    if whole_only:
        out = out.filter(F.col("block") * step < F.col("_n") - step)
    return out.select(
        KEY, TIME, "block", "n_train", F.col("target").alias("actual"),
        linalg.linear_score("fit", xs).alias("pred"),
    )


def walk_forward(
    table: DataFrame, xs: Sequence[str] = HAR, alpha: float = 12.0, start: int = 756,
    step: int = 21, rolling: int | None = None,
) -> DataFrame:
    """Metrics per test window."""
    models = walk_forward_models(table, xs, alpha, start, step, rolling)
    preds = walk_forward_predictions(table, models, xs, step, whole_only=True)
    return (
        with_direction(preds, KEY, "block")
        .groupBy(KEY, (F.col("block") - start // step).alias("window"))
        .agg(
            F.first("n_train").alias("n_train"),
            F.min(TIME).alias("test_start"),
            F.max(TIME).alias("test_end"),
            rmse().alias("rmse"),
            F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("mae"),
            qlike().alias("qlike"),
            (F.avg("_hit") * 100).alias("dir_acc"),
        )
    )


def walk_forward_experiments(table: DataFrame, **options) -> DataFrame:
    out = None
    for mode, rolling in (("expanding", None), ("rolling", 756)):
        f = walk_forward(table, rolling=rolling, **options).withColumn("mode", F.lit(mode))
        out = f if out is None else stack(out, f)
    return out


def walk_forward_summary(windows: DataFrame) -> DataFrame:
    return windows.groupBy(KEY, "mode").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.avg("rmse").alias("mean_rmse"),
        F.stddev_samp("rmse").alias("std_rmse"),
        F.min("rmse").alias("min_rmse"),
        F.max("rmse").alias("max_rmse"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("mae", "qlike", "dir_acc")],
    )


def coefficient_history(
    table: DataFrame, xs: Sequence[str] = HAR, alpha: float = ALPHA, start: int = 756, step: int = 21
) -> DataFrame:
    """Standardised coefficients of every expanding fit that has a whole window after it."""
    models = walk_forward_models(table, xs, alpha, start, step)
    sizes = table.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    kept = models.join(sizes, KEY).filter(F.col("block") * step < F.col("_n") - step)
    return kept.select(
        KEY,
        (F.col("block") - start // step).alias("window"),
        "window_end",
        "n_train",
        "mean_target",
        F.posexplode("fit.coef").alias("_k", "coef"),
    ).select(
        KEY, "window", "window_end", "n_train", F.col("mean_target").alias("intercept"),
        F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("_k") + 1).alias("term"), "coef",
    )


def coefficient_drift(history: DataFrame) -> DataFrame:
    """Distance, direction and largest change between the coefficients of adjacent windows."""
    w = Window.partitionBy(KEY, "term").orderBy("window")
    rows = history.withColumn("_b", F.lag("coef").over(w)).filter(F.col("_b").isNotNull())
    step = F.col("coef") - F.col("_b")
    norm = F.sqrt(F.sum(F.col("coef") * F.col("coef")) * F.sum(F.col("_b") * F.col("_b")))
    return rows.groupBy(KEY, "window").agg(
        F.max("window_end").alias("window_end"),
        F.sqrt(F.sum(step * step)).alias("l2_drift"),
        F.when(norm > 1e-10, F.sum(F.col("coef") * F.col("_b")) / norm).otherwise(0.0).alias("cosine_sim"),
        F.max(F.abs(step)).alias("max_abs_change"),
    )


# --- bootstrap -----------------------------------------------------------------------


def bootstrap_intervals(
    table: DataFrame, xs: Sequence[str] = HAR, alpha: float = ALPHA, replicas: int = 200,
    block: int = 22, level: float = 0.90, test_rows: int = TEST_ROWS,
) -> DataFrame:
    """Block-bootstrap prediction intervals of the ridge forecast.

    The design is the same in every replica, so a replica needs only the cross-products of
    the standardised features with its resampled residuals. Block starts are a hash of
    series, replica and block number: repeatable, and no generator state to share.
    """
    split = train_test(table, test_rows)
    models = ridge_models(split, {"har": xs}, alpha)
    stats = split.filter(~F.col("is_test")).groupBy(KEY).agg(
        *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(xs)],
        *[F.stddev_pop(x).alias(f"_s{i}") for i, x in enumerate(xs)],
    )
    z = [
        (F.col(x) - F.col(f"_m{i}"))
        / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0)
        for i, x in enumerate(xs)
    ]
    rows = (
        split.join(stats, KEY)
        .join(models.select(KEY, "fit", "mean_target"), KEY)
        .select(
            KEY, TIME, "is_test", "target",
            F.row_number().over(by_series()).alias("row"),
            linalg.linear_score("fit", xs).alias("point"),
            *[c.alias(f"z{i}") for i, c in enumerate(z)],
        )
    )
    train = rows.filter(~F.col("is_test")).withColumn("resid", F.col("target") - F.col("point"))
    train = train.withColumn("_n", F.count(F.lit(1)).over(whole_series()))
    slots = train.select(
        KEY, "row", "_n", *[f"z{i}" for i in range(len(xs))],
        F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica"),
    ).withColumns({"_blk": F.floor((F.col("row") - 1) / block), "_off": (F.col("row") - 1) % block})
    # blocks of a series shorter than a block go round its end
    start = F.pmod(F.xxhash64(KEY, "replica", "_blk"), F.greatest(F.col("_n") - block + 1, F.lit(1)))
    drawn = slots.withColumn("_src", F.pmod(start + F.col("_off"), F.col("_n")) + 1).join(
        train.select(KEY, F.col("row").cast("bigint").alias("_src"), F.col("resid").alias("_e")), [KEY, "_src"]
    )
    shift = drawn.groupBy(KEY, "replica").agg(
        F.avg("_e").alias("_mean_e"),
        F.array(*[F.sum(F.col(f"z{i}") * F.col("_e")) for i in range(len(xs))]).alias("_ze"),
    )
    # ridge on y* = fitted + drawn residuals: the fitted part re-fits to a fixed vector
    cols = [*[f"z{i}" for i in range(len(xs))], "point"]
    gram = linalg.grouped_moments(train, [KEY], cols)
    k = len(xs)

    @F.pandas_udf("array<double>")
    def replica_coef(n: pd.Series, mean: pd.Series, comoment: pd.Series, ze: pd.Series) -> pd.Series:
        out = []
        for count, m, c, e in zip(n, mean, comoment, ze):
            mu, cov = linalg.unpack(m, c)
            sxx = cov[:k, :k] * count
            rhs = cov[:k, k] * count + np.asarray(e, float)
            out.append(np.linalg.solve(sxx + alpha * np.eye(k), rhs).tolist())
        return pd.Series(out)

    coefs = shift.join(gram, KEY).select(
        KEY, "replica",
        (F.col("mean")[k] + F.col("_mean_e")).alias("_c"),
        replica_coef("n", "mean", "comoment", "_ze").alias("_w"),
    )
    test = rows.filter("is_test").join(coefs, KEY)
    pred = sum((F.col("_w")[i] * F.col(f"z{i}") for i in range(k)), F.col("_c"))
    tail = (1 - level) / 2
    out = test.groupBy(KEY, TIME).agg(
        F.first("target").alias("actual"),
        F.first("point").alias("point_pred"),
        F.percentile(pred, F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"),
    )
    out = out.withColumns(
        {"lower": F.greatest(F.col("_q")[0], F.lit(0.0)), "upper": F.col("_q")[1]}
    ).drop("_q")
    inside = (F.col("actual") >= F.col("lower")) & (F.col("actual") <= F.col("upper"))
    return out.withColumns(
        {"in_interval": inside.cast("int"), "pi_width": F.col("upper") - F.col("lower")}
    )


def coverage(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg("in_interval") * 100).alias("coverage_pct"),
        F.avg("pi_width").alias("mean_width"),
    )


# --- regimes -------------------------------------------------------------------------


def regime_predictions(
    table: DataFrame, xs: Sequence[str] = HAR, alpha: float = ALPHA, min_rows: int = 50,
    regimes: Sequence[int] = (0, 1, 2),
) -> DataFrame:
    """A ridge per series and regime (column ``regime``); thin regimes use the series' model.

    Returns long forecasts of the global and the regime-conditional model on the test tail.
    """
    split = train_test(table)
    sets = {"har": xs}
    overall = ridge_models(split, sets, alpha).select(KEY, F.col("fit").alias("fit_all"))
    own = ridge_models(split, sets, alpha, (KEY, "regime")).select(
        KEY, "regime", F.when(F.col("fit.n") >= min_rows, F.col("fit")).alias("fit_own")
    )
    rows = split.filter("is_test").join(overall, KEY).join(own, [KEY, "regime"], "left")
    rows = rows.withColumn("fit_used", F.coalesce("fit_own", "fit_all"))
    cells = F.array(
        F.struct(F.lit("global_har").alias("model"), linalg.linear_score("fit_all", xs).alias("pred")),
        F.struct(F.lit("regime_har").alias("model"), linalg.linear_score("fit_used", xs).alias("pred")),
    )
    return rows.select(KEY, TIME, "regime", F.col("target").alias("actual"), F.inline(cells))


# --- combination ---------------------------------------------------------------------


def _validation(predictions: DataFrame, share: float) -> DataFrame:
    """Mark the first ``share`` of the dates of every series."""
    w = by_series(KEY, "model")
    return predictions.withColumns(
        {
            "_at": F.row_number().over(w),
            "_n": F.count(F.lit(1)).over(whole_series(KEY, "model")),
        }
    ).withColumn("is_val", F.col("_at") <= F.floor(F.col("_n") * share)).drop("_at", "_n")


def simple_combination(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(KEY, TIME).agg(
        F.first("actual").alias("actual"), F.avg("pred").alias("pred")
    ).withColumn("model", F.lit("Simple"))


def inverse_rmse_weights(predictions: DataFrame, share: float = 0.3) -> DataFrame:
    val = _validation(predictions, share).filter("is_val")
    inv = val.groupBy(KEY, "model").agg((1 / (rmse() + 1e-10)).alias("_inv"))
    return inv.select(KEY, "model", (F.col("_inv") / F.sum("_inv").over(whole_series())).alias("weight"))


def granger_ramanathan_weights(
    predictions: DataFrame, models: Sequence[str], share: float = 0.3
) -> DataFrame:
    """Non-negative least squares weights, scaled to one; equal where all are zero.

    The gram matrix comes from one aggregation; the exact solution is the best of the
    least squares fits over all subsets of the few models.
    """
    val = _validation(predictions, share).filter("is_val")
    wide = val.groupBy(KEY, TIME).agg(
        F.first("actual").alias("_y"), *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in models]
    ).dropna("any")
    k = len(models)
    names = [*models, "_y"]
    gram = wide.groupBy(KEY).agg(
        F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in linalg.triangle(k + 1)]).alias("g")
    )

    @F.pandas_udf("array<double>")
    def nnls(g: pd.Series) -> pd.Series:
        out = []
        for row in g:
            _, full = linalg.unpack(np.zeros(k + 1), row)
            xx, xy, yy = full[:k, :k], full[:k, k], full[k, k]
            best, weights = yy, np.zeros(k)
            for mask in range(1, 2**k):
                on = [i for i in range(k) if mask >> i & 1]
                w = np.linalg.lstsq(xx[np.ix_(on, on)], xy[on], rcond=None)[0]
                loss = yy - 2 * w @ xy[on] + w @ xx[np.ix_(on, on)] @ w
                if (w >= 0).all() and loss < best:
                    best, weights = loss, np.zeros(k)
                    weights[on] = w
            total = weights.sum()
            out.append((weights / total if total > 1e-10 else np.full(k, 1.0 / k)).tolist())
        return pd.Series(out)

    return gram.select(KEY, F.posexplode(nnls("g")).alias("_k", "weight")).select(
        KEY, F.element_at(F.array(*[F.lit(m) for m in models]), F.col("_k") + 1).alias("model"), "weight"
    )


def weighted_combination(predictions: DataFrame, weights: DataFrame, name: str) -> DataFrame:
    return (
        predictions.join(weights, [KEY, "model"])
        .groupBy(KEY, TIME)
        .agg(F.first("actual").alias("actual"), F.sum(F.col("pred") * F.col("weight")).alias("pred"))
        .withColumn("model", F.lit(name))
    )


def combination_summary(
    predictions: DataFrame, models: Sequence[str], share: float = 0.3
) -> DataFrame:
    """RMSE of single models and combinations after the validation part, and the best of them."""
    cols = (KEY, TIME, "model", "actual", "pred")
    base = _validation(predictions, share)
    later = base.filter(~F.col("is_val")).select(*cols)
    both = later
    for combo in (
        simple_combination(later),
        weighted_combination(later, inverse_rmse_weights(predictions, share), "InvRMSE"),
        weighted_combination(later, granger_ramanathan_weights(predictions, models, share), "GrangerRam"),
    ):
        both = stack(both, combo.select(*cols))
    losses = both.groupBy(KEY, "model").agg(rmse().alias("rmse"), F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy(KEY).orderBy("rmse", "model")) == 1
    return losses.withColumn("is_best", best)


# --- attribution ---------------------------------------------------------------------


def linear_attribution(
    table: DataFrame, xs: Sequence[str] = HAR, alpha: float = ALPHA
) -> DataFrame:
    """Mean absolute and signed contribution ``beta * (x - mean)`` of every feature on the test tail."""
    split = train_test(table)
    models = ridge_models(split, {"har": xs}, alpha)
    means = split.filter(~F.col("is_test")).groupBy(KEY).agg(
        *[F.avg(x).alias(f"_m_{x}") for x in xs]
    )
    rows = split.filter("is_test").join(models, KEY).join(means, KEY)
    parts = {x: F.col("fit.beta")[i] * (F.col(x) - F.col(f"_m_{x}")) for i, x in enumerate(xs)}
    wide = rows.groupBy(KEY).agg(
        F.array(
            *[
                F.struct(
                    F.lit(x).alias("feature"),
                    F.avg(F.abs(p)).alias("mean_abs"),
                    F.avg(p).alias("mean_signed"),
                )
                for x, p in parts.items()
            ]
        ).alias("_rows")
    )
    out = wide.select(KEY, F.inline("_rows"))
    place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("mean_abs"), "feature"))
    direction = F.when(F.col("mean_signed") > 0, "increases forecast").otherwise("decreases forecast")
    return out.withColumns({"direction": direction, "place": place})


def dependence_curve(df: DataFrame, feature: str, response: str, window: int = 25) -> DataFrame:
    """Centred rolling mean of the response along the ordered feature (shorter at the ends)."""
    half = window // 2
    frame = by_series(order=feature).orderBy(feature, TIME).rowsBetween(-half, window - half - 1)
    return df.select(KEY, TIME, feature, response, F.avg(response).over(frame).alias("smoothed"))
