"""Batch and stream agree; hand-made edge cases of sources, quality and violations."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from helpers import days
from pyspark.sql import functions as F

from barograph.operators import drift, hypothesis, quality, regimes, sentiment
from barograph.sources import articles, bars
from barograph.sources.checkpoint import shared_folder
from barograph.streaming import monitor, online, ticks
from barograph.streaming.runner import drain, fresh_folder, staged

FEATURES = ["f1", "f2"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    frames = []
    for s in ("A", "B"):
        x = rng.normal(size=(120, 2))
        f = pd.DataFrame(x, columns=FEATURES)
        f["target"] = x @ [1.0, -2.0] + 3 + rng.normal(size=120) * 0.1
        f["series_id"], f["t"] = s, days(120)
        frames.append(f)
    return spark.createDataFrame(pd.concat(frames))


def test_online_stream_equals_batch(table):
    want = online.online_batch(table, FEATURES, 20).toPandas().sort_values(["series_id", "t"]).reset_index(drop=True)
    got = drain(online.online_stream(staged(table, "rows"), FEATURES, 20), "out").toPandas()
    got = got.sort_values(["series_id", "t"]).reset_index(drop=True)
    assert len(got) == 240
    for c in ("step", "actual", "pred_ewma", "pred_sgd"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9)
    # forecasts are made before the row is learned, and only after the burn-in
    assert want.groupby("series_id")["pred_ewma"].apply(lambda v: v.isna().sum()).eq(20).all()
    late = want[want.step > 80]
    assert np.sqrt(((late.pred_sgd - late.actual) ** 2).mean()) < late.actual.std()


def test_late_rows_are_dropped(spark, table):
    folder = fresh_folder(spark, "late")
    half = F.col("t") > F.lit(days(120)[59])
    table.filter(half).coalesce(1).write.parquet(folder)
    table.filter(~half).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drain(online.online_stream(stream, FEATURES, 5), "late-out")
    assert got.count() == 120
    assert got.agg(F.min("t")).first()[0] == days(120)[60]


def test_alert_stream_equals_batch(table):
    preds = table.select("series_id", "t", F.col("target").alias("actual"), (F.col("target") + F.col("f1")).alias("pred"))
    got = drain(monitor.monitor_stream(staged(preds, "p"), 30, 10), "alerts").toPandas()
    base = drift.monitor_baseline(preds, 30)
    want = drift.monitor_windows(preds, 30, 10).join(base.drop("n"), "series_id").toPandas()
    on = ["series_id", "window"]
    both = got.merge(want, on=on, suffixes=("", "_b"))
    assert len(both) == len(got) == len(want) > 0
    np.testing.assert_allclose(both["rmse"], both["rmse_b"])
    np.testing.assert_allclose(both["alert_upper_rmse"], both["alert_upper_rmse_b"])
    assert (both["date"] == both["date_b"]).all()


def test_alerts_count_late_rows(spark, table):
    folder = fresh_folder(spark, "late-alerts")
    preds = table.select("series_id", "t", F.col("target").alias("actual"), (F.col("target") + F.col("f1")).alias("pred"))
    early = F.col("t") <= F.lit(days(120)[9])
    preds.filter(~early).coalesce(1).write.parquet(folder)
    preds.filter(early).unionByName(preds.filter(F.col("t") > F.lit(days(120)[89])).withColumn("t", F.date_add("t", 60))).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(preds.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drain(monitor.monitor_stream(stream, 30, 10), "late-alerts-out").toPandas()
    assert set(got[got["date"] <= days(120)[119]].late) == {0}
    assert set(got[got["date"] > days(120)[119]].late) == {10}


def test_event_bars_drop_repeats_and_late_ticks(spark):
    base = dt.datetime(2024, 1, 1)
    schema = "event_id bigint, series_id string, ts timestamp, price double"
    first = [(1, "A", base, 1.0), (1, "A", base, 1.0), (2, "A", base + dt.timedelta(minutes=2), 3.0),
             (3, "A", base + dt.timedelta(hours=5), 2.0)]
    # a batch judges lateness by the watermark its predecessor closed windows with
    second = [(6, "A", base + dt.timedelta(hours=6), 4.0)]
    third = [(4, "A", base + dt.timedelta(minutes=1), 99.0), (5, "A", base + dt.timedelta(hours=9), 4.0)]
    folder = fresh_folder(spark, "ticks")
    for rows in (first, second, third):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = drain(ticks.window_bars(ticks.unique_ticks(stream), "1 hour").select("series_id", "w.start", "open", "close", "n"), "b")
    rows = {r["start"]: r for r in out.collect()}
    assert rows[base]["n"] == 2 and rows[base]["close"] == 3.0  # the late 99.0 and the repeat are gone


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_articles(spark):
    items = [
        {"title": "Up", "description": "more", "publishedAt": "2024-01-02T00:00:00Z", "source": {"name": "X"}},
        {"title": None, "description": "d", "publishedAt": "2024-01-02T00:00:00Z"},
        {"title": "[Removed]", "publishedAt": "2024-01-02T00:00:00Z"},
        {"title": "Bad date", "publishedAt": "yesterday"},
        {"title": "No source", "publishedAt": "2024-01-03T10:00:00Z", "source": None},
    ]
    df = spark.createDataFrame([(1, json.dumps(items))], "id int, payload string")
    rows = articles.flatten_articles(df, "payload", "id").orderBy("date").collect()
    assert [(r["title"], r["text"], r["source"]) for r in rows] == [("Up", "Up. more", "X"), ("No source", "No source.", "unknown")]


def test_quality_flags(spark):
    d = dt.date(2024, 1, 5)  # a Friday
    rows = [("A", d, 1.0, 2.0, 0.5, 1.5, 10.0), ("A", d, 1.0, 2.0, 0.5, 1.5, 0.0),
            ("A", d + dt.timedelta(days=1), 1.0, 0.5, 2.0, -1.0, None), ("B", d, 1.0, 2.0, 0.5, 1.5, 1.0)]
    out = quality.quality_report(spark.createDataFrame(rows, bars.BAR_SCHEMA)).toPandas().set_index("series_id")
    a = out.loc["A"]
    assert (a["rows"], a["missing_cells"], a["duplicate_dates"], a["non_bdays"], a["neg_prices"], a["zero_volume"], a["bad_ohlc"]) == (3, 1, 1, 1, 1, 1, 1)
    assert a["status"] == "CHECK" and out.loc["B", "status"] == "OK"


def test_csv_round_trip(spark):
    folder = fresh_folder(spark, "csv")
    rows = [("A", dt.date(2024, 1, 5), 1.0, 2.0, 0.5, float("nan"), 10.0)]
    spark.createDataFrame(rows, bars.BAR_SCHEMA).write.option("header", True).csv(folder)
    out = bars.read_bars(spark, folder, "csv").first()
    assert out["close"] is None and out["t"] == dt.date(2024, 1, 5) and out["volume"] == 10.0
    with pytest.raises(ValueError):
        bars.read_bars(spark, folder, "csv", {"close": "last"})


def test_panel_drops_incomplete_dates(spark):
    rows = [(s, d, 1.0) for s in "AB" for d in days(3) if not (s == "B" and d == days(3)[1])]
    df = spark.createDataFrame(rows, "series_id string, t date, v double")
    assert bars.aligned_panel(df, "v", ("A", "B")).count() == 2


@pytest.mark.parametrize("pattern,edge", [([0] * 20, True), ([1] * 20, True), ([0, 1] * 10, False)])
def test_violation_edges(spark, pattern, edge):
    pdf = pd.DataFrame({"series_id": "A", "t": days(20), "alpha": 0.05, "violation": pattern})
    df = spark.createDataFrame(pdf)
    k = hypothesis.kupiec(df, ["series_id", "alpha"]).first()
    assert (k["p_value"] == 1.0) == edge
    c = hypothesis.christoffersen(df, ["series_id", "alpha"]).first()
    assert c["lr_ind"] is None and c["independent"]


def test_drift_with_a_single_reference_value(spark):
    v = [1.0] * 40 + list(np.linspace(0, 2, 20))
    df = spark.createDataFrame(pd.DataFrame({"series_id": "A", "t": days(60), "v": v}))
    row = drift.drift_scan(df, "v", 40, 20).first()
    assert row["psi"] > 1 and row["ks_stat"] == pytest.approx(0.5) and 0 <= row["jsd"] <= np.log(2) + 1e-9
    same = spark.createDataFrame(pd.DataFrame({"series_id": "A", "t": days(60), "v": list(range(20)) * 3}))
    calm = drift.drift_scan(same.withColumn("v", F.col("v").cast("double")), "v", 40, 20).first()
    assert calm["psi"] == pytest.approx(0, abs=1e-6) and calm["ks_stat"] == 0 and calm["psi_level"] == "stable"


def test_as_of_takes_the_latest_at_or_before(spark):
    a = spark.createDataFrame([("A", days(10)[i]) for i in (0, 3, 5, 9)], "series_id string, date date")
    b = spark.createDataFrame([("A", days(10)[3], 1.0), ("A", days(10)[6], 2.0), ("B", days(10)[0], 9.0)], "series_id string, date date, psi double")
    got = drift.as_of(a, b, "date", "psi", "psi_rv").orderBy("date").toPandas()["psi_rv"].tolist()
    assert got[0] != got[0] and got[1:] == [1.0, 1.0, 2.0]


def test_likely_path_beats_any_other(spark):
    import itertools

    rng = np.random.default_rng(2)
    lab = [0, 0, 1, 2, 2, 2, 1, 0]
    z = np.array(lab) - 1 + rng.normal(size=8) * 0.6
    pdf = pd.DataFrame({"series_id": "A", "t": days(8), "z": z, "regime": lab})
    df = spark.createDataFrame(pdf).withColumn("regime", F.col("regime").cast("int"))
    got = regimes.likely_path(df).orderBy("t").toPandas()["state"].tolist()
    T = np.zeros((3, 3))
    for a, b in zip(lab, lab[1:]):
        T[a, b] += 1
    T /= T.sum(1, keepdims=True)
    m = [z[np.array(lab) == k].mean() for k in range(3)]
    s = [max(z[np.array(lab) == k].std(), 1e-3) for k in range(3)]

    def value(p):
        with np.errstate(divide="ignore"):
            out = sum(-0.5 * ((z[i] - m[k]) / s[k]) ** 2 - np.log(s[k]) for i, k in enumerate(p))
            return out + sum(np.log(T[a, b]) for a, b in zip(p, p[1:]))

    best = max(itertools.product(range(3), repeat=8), key=value)
    assert value(got) == pytest.approx(value(best))


def test_sentiment(spark):
    df = spark.createDataFrame([("Record PROFIT, no loss!",), ("nothing here",), ("weak sell",)], "text string")
    got = [r["compound_score"] for r in sentiment.scored(df, "text").collect()]
    assert got == [pytest.approx(1 / 3), 0.0, -1.0]


def test_groups_over_a_union_stay_whole(spark):
    # regrouping co-partitioned inputs must not leave one key in two groups
    from barograph.functions.windows import stack

    a = spark.range(2000).select((F.col("id") % 7).cast("string").alias("series_id"), F.col("id").alias("v"))
    left = a.groupBy("series_id").agg(F.sum("v").alias("v"))
    right = a.join(left.select("series_id"), "series_id").groupBy("series_id").agg(F.max("v").alias("v"))
    out = stack(left, right).groupBy("series_id").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in out) == [2] * 7
