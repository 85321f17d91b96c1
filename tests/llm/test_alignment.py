import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from llm.common import collected, docs_frame
from tokenizers import Tokenizer

from barograph.llm import alignment
from barograph.llm.bpe import byte_alphabet

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows):
    """Token by token with the libraries of the two files."""
    first = Tokenizer.from_file(BYTE)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    found, count = [], Counter()
    for doc, text in rows:
        tokens = []
        if text:
            e = first.encode(" " + text, add_special_tokens=False)
            tokens.append([(i, bytes(byte[c] for c in t)) for i, t in zip(e.ids, e.tokens)])
            pieces = [(i, second.id_to_piece(i)) for i in second.encode(text)]
            tokens.append([(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
        if not text or any(b"".join(b for _, b in side) != (" " + text).encode() for side in tokens):
            found.append((doc, 0, 0, 0, [], ""))
            continue
        placed = []
        for side in tokens:
            at, out = 0, []
            for i, b in side:
                out.append((i, at, at + len(b)))
                at += len(b)
            placed.append(out)
        links = [(a, b) for a, s, e in placed[0] for b, t, f in placed[1] if max(s, t) < min(e, f)]
        count.update(links)
        cuts = sorted({e for _, _, e in placed[0]} & {e for _, _, e in placed[1]})
        groups, at = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if at <= s < cut) for side in placed))
            at = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        found.append((doc, len(placed[0]), len(placed[1]), len(groups), links, digest))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(
        (
            (doc, a, b, g, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest)
            for doc, a, b, g, links, digest in found
        ),
        key=repr,
    )


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 700)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)
    rnd = random.Random(8)
    pool = "the quick brown Straßenbahn niño l'été naïve 12345 3.14 don't  \n\t [x] <s> </s> <|endoftext|> 日本語 😀 ﬁ <0x41>  ".split(" ")
    rows = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "x" * 3000), (105, "\0"), (106, "é"), (None, "the quick"), (1, rows[1][1])]
    rows += [(200 + i, "the quick brown") for i in range(5)]
    docs = docs_frame(spark, rows)
    assert collected(alignment.align(docs, BYTE, PIECE), *NAMES) == brute(rows)
    assert alignment.align(docs_frame(spark, []), BYTE, PIECE).collect() == []


def test_ids_of_the_file():
    """The encoder gives the ids that the file's library gives, also for scripts and marks at the edges."""
    texts = ["".join(map(chr, range(a, a + 400))) for a in range(32, 0xD400, 397)]
    texts += ["\U0001F600 \U00010400\U00010428", "١٢٣ ४५६", "a​b c\u0085d\x1ce", "'s'T'Re don'LL", "   x  \n\n y\t"]
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert alignment.byte_encoder(BYTE).lists(texts).to_pylist() == want
