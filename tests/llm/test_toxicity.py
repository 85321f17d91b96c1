from llm.common import CLASHING, collected, docs_frame
from pyspark.sql import functions as F

from barograph.llm import toxicity
from barograph.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_ranking(spark):
    got = QUERIES["op10_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    fresh = [r for r in got if r["held_out"]]
    bad, good = ([r["score"] for r in fresh if r["toxic"] == k] for k in (1, 0))
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert wins >= 0.8 * len(bad) * len(good)  # six fresh toxic texts at this size


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int").select("*", *[F.lit(c).alias(c) for c in CLASHING])


def test_awkward_rows(spark):
    rows = [(i, f"you awful blockhead number {i} " + "word " * (i % 9)) for i in range(60)]
    rows += [(i, f"a kind and quiet text number {i} " + "word " * (i % 9)) for i in range(60, 200)]
    told = [(i, int(i < 60)) for i in range(200)] + [(3, 0), (None, 1), (7, None)]
    rows += [(300, None), (301, ""), (None, "you blockhead"), (302, "quiet word " * 30_000), (5, rows[5][1])]
    got = collected(toxicity.score(docs_frame(spark, rows), labels(spark, told)), "doc_id", "score", "predicted")
    by = {r[0]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r[1] <= 1 and r[2] == int(r[1] >= 0.5) for r in got)
    assert by[None][2] == 1 and by[10][2] == 1 and by[150][2] == 0 and by[302][2] == 0


def test_one_kind_of_label(spark):
    docs = docs_frame(spark, [(1, "x"), (2, None)])
    assert collected(toxicity.score(docs, labels(spark, [])), "score") == [(0.0,), (0.0,)]
    assert {r["score"] for r in toxicity.score(docs, labels(spark, [(1, 1), (2, 1), (3, 1)])).collect()} == {1.0}
    assert toxicity.score(docs_frame(spark, []), labels(spark, [(1, 1)])).collect() == []
