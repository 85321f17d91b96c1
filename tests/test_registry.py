"""Rounding of long results is rounding."""

import math

from pyspark.sql import functions as F

from barograph.plans.registry import quick_round


def test_quick_round_is_round(spark):
    rows = spark.range(4_000).select(
        F.explode(
            F.array(
                *[(F.rand(k) - 0.5) * 10.0**k for k in (-9, -6, -2, 0, 3, 9, 14)],
                *[F.round(F.randn(9) * 100, k) + 5 * 10.0 ** -(k + 1) for k in (4, 6, 7)],
                *[F.lit(x) for x in (0.0, -0.0, -1e-9, 2.5e-7, math.inf, -math.inf, math.nan)],
                F.lit(None).cast("double"),
            )
        ).alias("v")
    )
    for places in (4, 6, 7):
        both = rows.select("v", F.round("v", places).alias("a"), quick_round(F.col("v"), places).alias("b"))
        assert both.filter("NOT string(a) <=> string(b)").collect() == []
