import random

from llm.common import CLASHING, collected, docs_frame
from pyspark.sql import functions as F

from barograph.llm import decontaminate

SF = "/root/testdata/sf0.01"


def test_common_subsequence():
    rnd = random.Random(0)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 20))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.common(a, b) == best[-1][-1]


def test_recall_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    words = {r["item_id"]: r["text"].lower().split() for r in items.collect()}
    want = set()
    for r in docs.collect():
        own = " ".join(r["text"].lower().split())
        want |= {(r["doc_id"], i) for i, w in words.items() if " ".join(w)[:-1] in own}
    assert len(got & want) >= 0.9 * len(want)
    assert len(got - want) <= 0.02 * len(want) + 1


def test_paraphrases_and_awkward_rows(spark):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    item = [rnd.choice(vocabulary) for _ in range(40)]

    def noise(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    changed = item.copy()
    for k in (3, 11, 19, 25):
        changed[k] = "changed"
    shortened = [w for k, w in enumerate(item) if k % 9 != 4]
    rows = [(i, " ".join(noise(120))) for i in range(30)]
    rows += [(40, " ".join(noise(77) + item + noise(50))), (41, " ".join(noise(9) + changed + noise(30)).upper())]
    rows += [(42, ", ".join(shortened)), (43, " ".join(item[:12] + noise(90))), (44, None), (45, "")]
    rows += [(None, " ".join(item)), (40, "other"), (46, " ".join(noise(20_000) + item))]
    items = [(1, " ".join(item)), (2, None), (3, ""), (4, "...")] + [(10 + i, " ".join(noise(30))) for i in range(20)]
    table = spark.createDataFrame(items, "item_id long, text string").select("*", *[F.lit(c).alias(c) for c in CLASHING])
    found = collected(decontaminate.leaks(docs_frame(spark, rows), table), "doc_id", "item_id")
    assert found == sorted([(40, 1), (41, 1), (42, 1), (46, 1), (None, 1)], key=repr)
    assert decontaminate.leaks(docs_frame(spark, []), table).collect() == []
    assert decontaminate.leaks(docs_frame(spark, rows), table.limit(0)).collect() == []


def test_copies_are_found_in_a_large_benchmark(spark):
    """With 1,200 items of unrelated words each passage keeps its whole length, and every copy is found."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(20_000)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(16, 59)))) for i in range(1_200)]
    items.append((5_000, " ".join(rnd.choice(vocabulary) for _ in range(64 * 140))))  # longer than a block
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(20)) + " " + t) for i, t in items if i % 4 == 0]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(docs_frame(spark, rows), table).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(i, i) for i, _ in rows]


def test_latent_passages_keep_their_length():
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(5_000)]
    own = [decontaminate.split_words([" ".join(rnd.choice(vocabulary) for _ in range(40))])[0] for _ in range(127)]
    own.append(own[0])
    idf = decontaminate.np.ones(decontaminate.TERMS)
    known, vectors = decontaminate.latent_terms(own, idf)
    for p in own:
        terms, w = decontaminate.weighted(p, idf)
        assert abs(decontaminate.np.linalg.norm(w @ vectors[decontaminate.np.searchsorted(known, terms)]) - 1) < 1e-6


def test_copies_among_rare_words_are_found(spark):
    """Words that no passage has weigh much, and nothing in the latent space: they don't hide a copy."""
    rnd = random.Random(13)
    common = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    items = [(k, " ".join(rnd.sample(common, 33))) for k in range(8)]

    def rare(n):
        return " ".join("".join(rnd.choice("klmnopqrst") for _ in range(9)) for _ in range(n))

    rows = [(k, f"{rare(60)} {t} {rare(60)}") for k, t in items]
    rows += [(100 + k, " ".join(rnd.choice(common) for _ in range(200))) for k in range(300)]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(docs_frame(spark, rows), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(k, k) for k, _ in items}
    # in the latent space a copy is the item, whatever stands beside it
    assert min(r["cosine"] for r in found) > 0.8
