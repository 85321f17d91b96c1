import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from llm.common import collected, docs_frame

from barograph.llm import variants

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            cut = h % len(run)
            count[run[:cut] + run[cut + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=repr)


def noisy_rows(seed, docs=120):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9))) for _ in range(25)] + ["Ünglaublich", "ÄÖÜßäöüÿ", "b" * 300]

    def word():
        w = stems[int(len(stems) * rnd.random() ** 3)]
        for _ in range(rnd.choice((0, 0, 0, 0, 1, 2))):
            i = rnd.randrange(len(w) + 1)
            w = rnd.choice((w[:i] + rnd.choice("abcÀ") + w[i:], w[:i] + w[i + 1 :], w[:i] + rnd.choice("abÿ") + w[i + 1 :]))
        return w

    rows = [(i, rnd.choice((" ", ", ", "-")).join(word() for _ in range(rnd.randint(0, 60)))) for i in range(docs)]
    return rows + [(500, None), (501, ""), (502, "x1y"), (None, "abababa Abababa"), (3, rows[3][1]), (3, rows[3][1])]


def test_against_brute_force(spark):
    chain = [("quellwasser", 2), ("quellwassers", 30), ("quellwasserst", 400)]
    rows = noisy_rows(2) + [(600 + i, " ".join([w] * n)) for i, (w, n) in enumerate(chain)]
    found = collected(variants.variants(docs_frame(spark, rows)), *NAMES)
    assert found == brute(rows)
    assert any(r[1] for r in found) and any(r[2] != (r[1] or r[0]) for r in found)
    assert variants.variants(docs_frame(spark, [])).collect() == []


def test_long_lists_are_halved(spark, monkeypatch):
    """The same result when every list is cut down to one or two free code points."""
    rows = noisy_rows(5, 60)
    monkeypatch.setattr(variants, "LIST_WORDS", 3)
    monkeypatch.setattr(variants, "CHUNK_ROWS", 7)
    assert collected(variants.variants(docs_frame(spark, rows)), *NAMES) == brute(rows)


def test_scan_of_one_list():
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))) for _ in range(200)})
    data = np.frombuffer("".join(words).encode() + b"?", np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    new = np.arange(len(words)) == 0
    lcp = variants.common_prefixes(data, start, size, new)
    q, v = variants.scan(data, start, size, lcp, np.full(len(words), 99), np.arange(len(words)))
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    assert {(words[a], words[b]) for a, b in zip(q, v)} == want and len(q) == len(want)


def test_letters():
    words = ["abc", "", "ÿàz", "Ã"]
    data, place = variants.letters(pa.array(words)[1:])
    assert bytes(data) == "ÿàzÃ".encode("latin-1") and place.tolist() == [0, 0, 3, 4]
