import corpus_pipeline

from llm.common import docs_frame

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns, name
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in now.select("doc_id").collect()}
        now = after
    left = {r["doc_id"] for r in now.collect()}
    assert 0.5 * docs.count() < len(left) < docs.count()
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == left
    assert all(len(r["ids_sha256"]) == 64 for r in got)


def test_awkward_tables(spark):
    rows = [(1, "the quick fox jumps over it"), (2, None), (3, ""), (None, "a text of its own"), (1, "the quick fox jumps over it")]
    docs = docs_frame(spark, rows, {1: "en"})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
