import hashlib
import random

import numpy as np
from llm.common import collected, docs_frame

from barograph.llm import repeats


def brute(rows):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - 49 if d is not None else 0):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], d), d)
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49 if d is not None else 0):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("barograph.llm.blocks.BLOCK_BYTES", 1500)
    rnd = random.Random(4)
    pool = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(30, 150))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rnd.choice(pool)[rnd.randint(0, 9) :] if rnd.random() < 0.6 else str(rnd.random()) for _ in range(rnd.randint(0, 5))]
        rows.append((rnd.randint(0, 50), "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 49), (103, "a" * 400), (104, "a" * 120), (None, pool[0] * 2), (1, rows[0][1])]
    rows += [(200 + i, pool[1] * 3) for i in range(5)] + [(300, "".join(pool) * 60)]
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert collected(repeats.remove_repeats(docs_frame(spark, rows)), *names) == brute(rows)
    assert repeats.remove_repeats(docs_frame(spark, [])).collect() == []


def test_equal_strings():
    rnd = random.Random(1)
    data = bytes(rnd.choice(b"ab") for _ in range(3000)) + b"ab" * 60
    place, group = repeats.equal_strings(np.frombuffer(data, np.uint8), 50)
    found = {}
    for p, g in zip(place.tolist(), group.tolist()):
        found.setdefault(g, set()).add(p)
    want = {}
    for i in range(len(data) - 49):
        want.setdefault(data[i : i + 50], set()).add(i)
    many = sorted(sorted(s) for s in want.values() if len(s) > 1)
    assert sorted(map(sorted, found.values())) == many


def test_edges_of_a_common_passage_spread_over_parts(spark, monkeypatch):
    """Every document has its own runs at the edges of a passage; no part gets all runs of an anchor."""
    monkeypatch.setattr("barograph.llm.blocks.BLOCK_BYTES", 3000)
    monkeypatch.setattr(repeats, "HOT_DOCS", 20, raising=False)

    def text():
        return "".join(rnd.choice("abcdefgh ") for _ in range(80))

    rnd = random.Random(6)
    passage = text()
    rows = [(i, text() + passage + text()) for i in range(150)]
    rows += [(200 + i, rows[0][1][i : 150 + i]) for i in range(20)]
    docs = docs_frame(spark, rows)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert collected(repeats.remove_repeats(docs), *names) == brute(rows)

    def counted(table):
        runs = sum(len(sizes) for _, text, sizes, *_ in repeats.unpacked(table) if text)
        return repeats.pa.table({"runs": [runs]})

    found, frame = [], type(docs)
    grouped = frame.groupBy

    def group(self, *columns):
        if columns == ("part",) and "anchors" in self.columns:
            found.extend(r["runs"] for r in grouped(self, "part").applyInArrow(counted, "runs long").collect())
        return grouped(self, *columns)

    monkeypatch.setattr(frame, "groupBy", group)
    repeats.remove_repeats(docs)
    assert sum(found) > 100 and max(found) < 0.2 * sum(found)
