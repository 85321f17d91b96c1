import math
import random

from llm.common import CLASHING, collected
from pyspark.sql import functions as F

from barograph.llm import topk


def brute(rows, k):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault((i, tuple(math.floor(256 * x) for x in v)), None)
    out = []
    for q, a in whole:
        if q % 5 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHING if c != "v"])


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(8)]) for i in range(150)]
    rows += [(i, [0.5] * 8) for i in range(150, 260)]  # ties in plenty
    rows += [(300, None), (305, [None, 1.0]), (310, [float("nan")] * 8), (315, [float("inf")] * 8), (None, [0.1] * 8)]
    rows += [(320, [1.0, 2.0, 3.0]), (325, []), (330, [3e7] * 12), rows[5], rows[160]]
    got = collected(topk.top_k(frame(spark, rows), F.col("id") % 5 == 0), "query_id", "rank", "vec_id", "score")
    assert got == brute(rows, 5)


def test_few_rows(spark):
    assert topk.top_k(frame(spark, []), F.col("id") % 5 == 0).collect() == []
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    got = collected(topk.top_k(frame(spark, rows), F.col("id") % 5 == 0), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 1, 0)]
