import zlib

from llm.common import collected, docs_frame

from barograph.llm import langid
from barograph.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op4_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    fresh = [r for r in got if r["held_out"]]
    assert len(got) == 1000
    assert sum(r["lang"] == r["lang_pred"] for r in fresh) >= 0.98 * len(fresh)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_awkward_rows(spark):
    rows = [(i, "the cat and the dog of " * 9) for i in range(20)] + [(i, "der hund und die katze von " * 9) for i in range(20, 40)]
    lang = {i: "en" if i < 20 else "de" for i in range(40)}
    rows += [(50, None), (51, ""), (52, "123 ... !"), (None, "the cat"), (53, "die katze " * 40_000), (0, rows[0][1])]
    got = collected(langid.identify(docs_frame(spark, rows, lang)), "doc_id", "lang_pred", "score")
    named = {r[0]: r[1] for r in got}
    assert len(got) == len(rows) and got.count(got[0]) >= 1
    assert [named[i] for i in (50, 51, 52)] == ["und"] * 3
    assert named[None] == "en" and named[53] == "de" and named[3] == "en"
    kept = langid.confident(docs_frame(spark, rows, lang), 0.3)
    assert kept.columns == docs_frame(spark, rows, lang).columns
    assert {50, 51, 52}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert kept.count() == len(rows) - 3


def test_without_labels(spark):
    got = collected(langid.identify(docs_frame(spark, [(1, "word"), (2, None)])), "lang_pred", "score")
    assert got == [("und", 0.0), ("und", 0.0)]
    assert langid.identify(docs_frame(spark, [])).collect() == []
    one = docs_frame(spark, [(1, "a word"), (3, "a word"), (4, "one")], {1: "en", 3: "en", 4: "en"})
    assert {r["lang_pred"] for r in langid.identify(one).collect()} == {"en"}
