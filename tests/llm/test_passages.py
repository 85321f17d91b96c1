import hashlib
import random
import re

from llm.common import collected, docs_frame

from barograph.llm import passages

NAMES = ("doc_id", "n_words", "n_removed", "kept_sha256")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    first = {}
    for d, t in rows:
        ws = split(t)
        for i in range(len(ws) - 12 if d is not None else 0):
            key = tuple(ws[i : i + 13])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        ws = split(t)
        gone = set()
        for i in range(len(ws) - 12 if d is not None else 0):
            if first[tuple(ws[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_rows(seed, docs=80):
    rnd = random.Random(seed)
    pool = [[rnd.choice("abcdeéf") * rnd.randint(1, 2) for _ in range(rnd.randint(8, 60))] for _ in range(9)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rnd.randint(0, 5)):
            part = list(rnd.choice(pool)) if rnd.random() < 0.6 else [str(rnd.random())[:5] for _ in range(rnd.randint(1, 15))]
            if rnd.random() < 0.3 and part:
                part[rnd.randrange(len(part))] = "edit"
            words += part[rnd.randint(0, 4) :]
        rows.append((rnd.randint(0, docs), rnd.choice(" \n\t").join(words)))
    rows += [(500, None), (501, ""), (502, " \t "), (503, "a " * 12), (504, "a " * 300), (505, "b " + "a " * 40), (None, " ".join(pool[0]) * 3)]
    rows += [(None, " ".join(pool[1])), (1, rows[0][1]), (1, rows[0][1]), (506, "A " * 40), (507, "x y" * 20)]
    return rows + [(600 + i, " ".join(pool[8] + pool[2])) for i in range(6)] + [(700, " ".join(sum(pool, [])) + " " + " ".join(pool[3]) * 40)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(passages, "SHARD_BYTES", 2500)
    monkeypatch.setattr(passages, "FAN_IN", 4)
    rows = some_rows(4)
    found = collected(passages.remove_passages(docs_frame(spark, rows)), *NAMES)
    assert found == brute(rows) and sum(r[2] for r in found) > 1000
    assert passages.remove_passages(docs_frame(spark, [])).collect() == []


def test_one_block_with_text(spark):
    rows = some_rows(9, 20)
    found = passages.remove_passages(docs_frame(spark, rows), with_text=True).collect()
    assert sorted(((r[0], r[1], r[2], hashlib.sha256(r["kept"]).hexdigest()) for r in found), key=repr) == brute(rows)


def test_automaton():
    """Matching statistics of random words against all windows of what was added."""
    rnd = random.Random(2)
    for _ in range(60):
        automaton, windows = passages.Automaton(), set()
        for _ in range(rnd.randint(1, 5)):
            words = [rnd.choice("ab") for _ in range(rnd.randint(0, 30))]
            automaton.add(words)
            windows |= {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
        words = [rnd.choice("abc") if rnd.random() < 0.1 else rnd.choice("ab") for _ in range(60)]
        assert automaton.known(words, 4).tolist() == [tuple(words[i : i + 4]) in windows for i in range(57)]
        assert len(automaton.size) <= 2 * 150 + 2


def test_a_common_passage_is_sent_once_a_block():
    """The edges of a passage differ in every document and stay at home."""
    rnd = random.Random(1)
    passage = [f"w{k}" for k in range(30)]
    rows = [(i, None, 0, passage) for i in range(50)]
    rnd.shuffle(rows)
    spans, fresh = passages.streamed(rows)
    assert [f[0] for f in fresh] == [0] and len(spans) == 49
