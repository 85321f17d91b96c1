import random

from llm.common import collected, docs_frame

from barograph.llm import jaccard


def brute(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        own = {b"\0".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b"\0".join(w)} if w else set()
        sets.setdefault(d, own)
    ids = [d for d in sets if d is not None]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted(((d, len(sets[d]), None if d is None else find(d)) for d, _ in rows), key=repr)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 12)
    monkeypatch.setattr("barograph.llm.blocks.BLOCK_BYTES", 4000)
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(900)]

    def text(n):
        return [rnd.choice(words) for _ in range(n)]

    def near(t, changes):
        t = list(t)
        for _ in range(changes):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        return t

    rows, base, passage = [], text(150), text(60)
    rows += [near(base, rnd.randint(0, 5)) for _ in range(60)]  # a large group of near copies
    rows += [passage + text(rnd.randint(4, 40)) for _ in range(50)]  # a passage in many texts
    rows += [passage + text(8) for _ in range(10)]
    rows += [near(rows[k], 1) for k in range(60, 80)]
    rows += [text(rnd.randint(1, 7)) for _ in range(20)] + [text(300)] + [["the", "The", "tHe"]] * 3
    rows = [(k, rnd.choice(" \n\t").join(t)) for k, t in enumerate(rows)]
    rnd.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n "), (None, rows[0][1]), rows[3], (903, rows[5][1].upper()), (904, " ".join(text(30_000)))]
    got = collected(jaccard.link(docs_frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows)


def test_near_misses_write_no_square_of_pairs(spark, monkeypatch):
    """Sixty texts that all but reach the threshold with each other, and a copy of some that reaches it."""
    monkeypatch.setattr(jaccard, "HOME_BYTES", 200_000, raising=False)
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(2_000)]

    def changed(words, changes, tag):
        words = list(words)
        for k, at in enumerate(rnd.sample(range(len(words)), changes)):
            words[at] = f"{tag}x{k}"
        return words

    texts = [changed(base, 27, f"d{d}") for d in range(60)]
    texts += [changed(texts[d], 5, f"c{d}") for d in range(0, 60, 6)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    written = []

    def stored(df, name):
        out = kept(df, name)
        written.append((name, out.count()))
        return out

    kept = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", stored)
    got = collected(jaccard.link(docs_frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows)
    assert len({c for _, _, c in got}) == 60
    assert sum(n for name, n in written if name == "tested") <= 4 * len(rows)


def test_empty(spark):
    assert jaccard.link(docs_frame(spark, [])).collect() == []
