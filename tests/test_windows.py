import numpy as np
import pandas as pd
import pytest
from helpers import days, long_frame
from pyspark.sql import Window
from pyspark.sql import functions as F

from barograph.functions import special
from barograph.functions.windows import decayed_sum, drop_halo, ewm_mean, in_blocks
from barograph.operators import intraday as it
from barograph.operators import returns as rt
from barograph.operators import technical as te


def test_decayed_sum_over_many_stretches(spark):
    n, decay = 700, 0.2  # a stretch is 214 rows here
    x = np.random.default_rng(0).normal(size=(n, 2))
    df = spark.createDataFrame(long_frame(x, "AB"))
    got = decayed_sum(df, {"v": "value"}, decay).toPandas()
    for i, s in enumerate("AB"):
        want, acc = [], 0.0
        for v in x[:, i]:
            acc = decay * acc + v
            want.append(acc)
        mine = got[got.series_id == s].sort_values("t")["v"].to_numpy()
        np.testing.assert_allclose(mine, want, rtol=1e-12, atol=1e-12)


def test_decayed_sum_with_a_decay_per_key(spark):
    pdf = pd.DataFrame({"series_id": ["A"] * 300 + ["B"] * 300, "t": days(300) * 2, "value": 1.0,
                        "d": [0.5] * 300 + [0.9] * 300})
    df = decayed_sum(spark.createDataFrame(pdf), {"v": "value"}, F.col("d"))
    last = df.groupBy("series_id").agg(F.max_by("v", "t").alias("v")).toPandas().set_index("series_id")["v"]
    assert last["A"] == pytest.approx(2.0)
    assert last["B"] == pytest.approx(10.0, rel=1e-9)


def test_slow_decay_beside_a_fast_one(spark):
    n = 6000
    pdf = pd.DataFrame({"series_id": ["A"] * n + ["B"] * n, "t": days(n) * 2, "value": 1.0, "d": [0.8] * n + [0.999] * n})
    df = decayed_sum(spark.createDataFrame(pdf), {"v": "value"}, F.col("d"))
    last = df.groupBy("series_id").agg(F.max_by("v", "t").alias("v")).toPandas().set_index("series_id")["v"]
    assert last["A"] == pytest.approx(5.0)
    assert last["B"] == pytest.approx((1 - 0.999**n) / 0.001, rel=1e-9)


def test_decay_out_of_range(spark):
    df = spark.createDataFrame(long_frame(np.ones((3, 1)), "A"))
    with pytest.raises(ValueError):
        decayed_sum(df, {"v": "value"}, 1.0)


def test_ewm_matches_pandas_with_nulls(spark):
    x = np.random.default_rng(1).normal(size=200)
    x[[0, 7, 8, 50]] = np.nan
    pdf = long_frame(x[:, None], "A")
    df = spark.createDataFrame(pdf).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    got = ewm_mean(df, "e", "value", 10, 5).orderBy("t").toPandas()["e"].astype(float).to_numpy()
    want = pd.Series(x).ewm(span=10, min_periods=5).mean().to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("block_rows", [5, 16, 1000])
def test_blocks_give_the_plain_window(spark, block_rows):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "cold"], 300, p=[0.9, 0.1]), "o": rng.permutation(300),
                        "x": rng.normal(size=300)})
    df = spark.createDataFrame(pdf).withColumn("slot", F.floor(F.col("o") / 40))
    cut = in_blocks(df, ["k"], "slot", ["o"], 4, block_rows)
    w = Window.partitionBy("k", "block").orderBy("rn").rowsBetween(-4, -1)
    got = drop_halo(cut.withColumn("s", F.sum("x").over(w)))
    plain = Window.partitionBy("k").orderBy("o")
    want = df.withColumn("s0", F.sum("x").over(plain.rowsBetween(-4, -1))).withColumn(
        "rn0", F.row_number().over(plain))
    both = got.join(want.select("k", "o", "s0", "rn0"), ["k", "o"]).toPandas()
    assert len(both) == 300
    assert (both["rn"] == both["rn0"]).all()
    np.testing.assert_allclose(both["s"].astype(float), both["s0"].astype(float), rtol=1e-9)


@pytest.mark.parametrize("block_rows", [12, 30, 10_000])
def test_intraday_measures_do_not_depend_on_blocks(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [("A", d, i, float(p), 1.0) for d, m in zip(days(4), (1, 4, 9, 120))
            for i, p in enumerate(np.exp(rng.normal(size=m) * 0.1))]
    ticks = spark.createDataFrame(rows, "series_id string, day date, seq bigint, price double, volume double")
    r = it.tick_returns(ticks, 7, block_rows=block_rows)
    got = it.realised_measures(r).orderBy("t").toPandas().set_index("t")
    for d, m in zip(days(4), (1, 4, 9, 120)):
        x = np.diff(np.log([p for s, q, _, p, _ in rows if q == d]))
        if m == 1:
            assert d not in got.index
            continue
        row = got.loc[d]
        assert row["m"] == m - 1
        np.testing.assert_allclose(row["rv"], (x**2).sum())
        np.testing.assert_allclose(row["bv"], np.pi / 2 * (np.abs(x[1:]) * np.abs(x[:-1])).sum())
        if len(x) < 10:
            assert row["rk"] == pytest.approx(row["rv"])
        else:
            k = (x**2).sum() + sum(2 * it.parzen(h, 8) * (x[h:] * x[:-h]).sum() for h in range(1, 9))
            np.testing.assert_allclose(row["rk"], max(k, 0.0))
    lm = it.lee_mykland(r, block_rows=max(block_rows, 30)).toPandas()
    x = np.concatenate([np.diff(np.log([p for s, q, _, p, _ in rows if q == d])) for d in days(4)])
    a, n = np.abs(x), len(x)
    assert len(lm) == n - 20
    want = [a[i] / np.sqrt(np.pi / 2 * (a[i - 19:i] * a[i - 20:i - 1]).sum() / 19 + 1e-12) for i in range(20, n)]
    np.testing.assert_allclose(np.sort(lm["l_stat"]), np.sort(want))


def test_technical_against_pandas(spark):
    rng = np.random.default_rng(4)
    c = np.exp(np.cumsum(rng.normal(size=120) * 0.02))
    pdf = pd.DataFrame({"series_id": "A", "t": days(120), "open": c, "high": c * 1.01, "low": c * 0.99,
                        "close": c, "volume": rng.uniform(1, 2, 120)})
    df = rt.with_returns(spark.createDataFrame(pdf))
    got = te.technical_features(df).orderBy("t").toPandas()
    s = pd.Series(c)
    macd = s.ewm(span=12, min_periods=12).mean() - s.ewm(span=26, min_periods=26).mean()
    np.testing.assert_allclose(got["macd_norm"].astype(float), (macd / (s + 1e-6)).shift(1), rtol=1e-9)
    sd = s.rolling(20).std()
    np.testing.assert_allclose(got["bb_width_20d"].astype(float), (2 * sd / (s.rolling(20).mean() + 1e-6)).shift(1), rtol=1e-9)
    sign = np.sign(np.log(s).diff())
    run, runs = 0, []
    for i in range(120):
        run = run + 1 if i > 1 and sign[i] == sign[i - 1] else 0
        runs.append(run)
    assert got["return_streak"].iloc[1:].astype(int).tolist() == runs[:-1]
    shape = te.rolling_shape(df).orderBy("t").toPandas()
    r = pd.Series(np.log(c)).diff().shift(1)
    np.testing.assert_allclose(shape["realized_skew_21d"].astype(float), r.rolling(21, min_periods=15).skew(), rtol=1e-7)
    np.testing.assert_allclose(shape["realized_kurt_21d"].astype(float), r.rolling(21, min_periods=15).kurt(), rtol=1e-7)


def test_constant_prices_do_not_fail(spark):
    pdf = pd.DataFrame({"series_id": "A", "t": days(60), "open": 5.0, "high": 5.0, "low": 5.0, "close": 5.0, "volume": 0.0})
    df = rt.with_volatility(rt.with_returns(spark.createDataFrame(pdf)))
    out = te.surface_features(te.technical_features(df)).toPandas()
    assert len(out) == 60
    assert (out["vol_c2c_21d"].dropna() == 0).all()


def test_distribution_functions(spark):
    df = spark.createDataFrame([(0.3, 5), (2.0, 10), (4.5, 400)], "x double, n int")
    out = df.select("x", "n", special.t_tail2(F.col("x"), F.col("n").cast("double")).alias("t"),
                    special.f_tail(F.col("x"), F.lit(2.0), F.col("n").cast("double")).alias("f"),
                    special.chi2_tail_even_odd(F.col("x"), 5).alias("c5"),
                    special.norm_quantile(F.lit(0.975)).alias("q")).toPandas()
    # published table values: t tails, F(2, v) closed form, chi-square with 5 degrees
    np.testing.assert_allclose(out["t"], [0.7762, 0.0734, 0.0000089], atol=5e-5)
    np.testing.assert_allclose(out["f"], (1 + 2 * out["x"] / out["n"]) ** (-out["n"] / 2), rtol=1e-9)
    np.testing.assert_allclose(out["c5"], [0.99764, 0.84915, 0.47988], atol=5e-5)
    np.testing.assert_allclose(out["q"], 1.959964, atol=1e-6)
