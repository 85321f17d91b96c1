from llm.common import collected, docs_frame

from barograph.llm import lines


def kept(spark, rows):
    got = lines.drop_lines(docs_frame(spark, rows))
    return {(r["row"]["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"]) for r in got.collect()}


def test_recurring_templates_stay_once(spark):
    same = "All rights reserved by the owner"
    logs = [f"user {i} logged in from host h{i} today" for i in range(6)]
    names = [f"Posted on the main page by {n} of this site" for n in ("anna", "bert", "carl", "dora")]
    rows = [(i, f"{'abcdefghij'[i] * 3} is own text here\n{same}\n\n{logs[i]}") for i in range(6)]
    rows += [(10 + i, f"{n}\n{'klmnopqrst'[i] * 4} clean line of a document") for i, n in enumerate(names)]
    rows += [(20, None), (21, ""), (None, same), (22, "twice in two\nonly"), (23, "twice in two\nelse"), (22, "twice in two\nonly")]
    rows += [(24, same + "\n" + same)]
    got = kept(spark, rows)
    own = "{} is own text here"
    assert got[0, rows[0][1]] == (4, 0)
    for i in range(1, 6):
        assert got[i, own.format("abcdefghij"[i] * 3) + "\n"] == (4, 2)
    assert got[10, rows[6][1]] == (2, 0)
    for i in range(1, 4):
        assert got[10 + i, rows[6 + i][1].split("\n")[1]] == (2, 1)
    assert got[20, None] == (0, 0) and got[21, ""] == (1, 0) and got[None, same] == (1, 0)
    assert got[22, "twice in two\nonly"] == (2, 0) and got[23, "twice in two\nelse"] == (2, 0)
    assert got[24, ""] == (2, 2)


def test_empty_table(spark):
    assert lines.drop_lines(docs_frame(spark, [])).collect() == []


def test_many_and_odd_columns(spark):
    from pyspark.sql import functions as F

    docs = docs_frame(spark, [(1, "a b")]).select("*", *[F.lit(k).alias(f"odd name, {k}") for k in range(40)])
    row = lines.drop_lines(docs).collect()[0]
    assert row["text"] == "a b" and row["row"]["odd name, 39"] == 39 and len(row["row"]) == len(docs.columns) - 1


def test_tree_by_hand():
    a = "a b c d e f g h i j".split()
    other = a[:9] + ["x"]
    far = a[:3] + ["q"] * 7
    found = {line: (at, shown) for line, at, shown in lines.templates([(1, a), (2, other), (3, far)])}
    assert found[1] == found[2] == (1, a[:9] + ["<*>"])
    assert found[3] == (3, far)


def test_leaves_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lines, "LEAF_LINES", 10)
    rows = [(i, f"the big red {'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i // 26]} thing of many words in a line") for i in range(60)]
    got = lines.drop_lines(docs_frame(spark, rows))
    assert sum(r["n_dropped"] for r in got.collect()) == 59


def test_dropped_lines_match_brute_force(spark):
    """Without templates of several lines, dropping is counting equal parsed lines."""
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    lost = {r["doc_id"]: set(r["lines"]) for r in lines.recurring(docs).collect()}
    seen = {}
    for r in docs.collect():
        for raw in (r["text"] or "").split("\n"):
            if tokens := lines.parsed(raw):
                seen.setdefault(lines.line_hash(tokens), set()).add(r["doc_id"])
    for line, ids in seen.items():
        if len(ids) >= lines.MIN_DOCS:
            assert all(line in lost[d] for d in ids if d != min(ids))
    assert collected(lines.drop_lines(docs).select("row.doc_id"), "doc_id") == sorted(((i,) for i in range(200)), key=repr)


def test_rare_templates_of_large_leaves(spark, monkeypatch):
    """Three lines of one template are found however many parts their leaf is parsed in."""
    monkeypatch.setattr(lines, "LEAF_LINES", 10)
    letters = "abcdefghijklmnopqrst"

    def word(*number):
        return "".join(letters[k] for k in number)

    rows = [
        (3 * i + j, f"the big red {word(j, i)} " + " ".join(word(i, k, k) for k in range(7)))
        for i in range(20)
        for j in range(3)
    ]
    got = {r["row"]["doc_id"]: r["n_dropped"] for r in lines.drop_lines(docs_frame(spark, rows)).collect()}
    assert got == {d: int(d % 3 > 0) for d, _ in rows}


def test_similar_lines_share_a_segment():
    import random

    rnd = random.Random(4)
    for n in range(lines.MIN_TOKENS, 40):
        a = [str(k) for k in range(n)]
        b = a.copy()
        for k in rnd.sample(range(lines.DEPTH, n), min(n - lines.DEPTH, int(n * (1 - lines.SIMILARITY) + 1e-9))):
            b[k] = "x"
        assert len({at for _, at, _ in lines.templates([(1, a), (2, b)])}) == 1
        assert set(lines.segments(a)) & set(lines.segments(b))


def test_long_lines_recur_from_two_documents(spark):
    long = "a passage of many words that was copied into another document as a whole line"
    near = long.replace("another", "some")
    fields = " ".join(f"n{k}" for k in range(20))
    rows = [(1, f"first\n{long}"), (2, f"second\n{long}"), (3, f"third\n{fields} end"), (4, f"fourth\n{fields} end")]
    got = {r["row"]["doc_id"]: r["n_dropped"] for r in lines.drop_lines(docs_frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}
    rows = [(1, f"first\n{near}"), (2, f"second\n{long}")]
    got = {r["row"]["doc_id"]: r["n_dropped"] for r in lines.drop_lines(docs_frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 1}
