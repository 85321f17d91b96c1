import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from llm.common import collected, docs_frame
from tokenizers import Tokenizer

from barograph.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.WordBPE(PATH)


def ids_of(own, text):
    return np.frombuffer(own.encode_batch([text])[0], "<u4").tolist()


def test_every_low_character(own):
    for c in range(0x300):
        for text in (f"a{chr(c)}b", f"{chr(c)}{chr(c)}1", f"'{chr(c)}s"):
            assert ids_of(own, text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_random_texts(own):
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzéèßñ'’ \n\t\0.,!?0123456789ÀΣσİ日本한😀́<|>"
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
        if rnd.random() < 0.1:
            text += "<|endoftext|>" + text + "<|startoftext|>"
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        got = own.encode_batch([text])[0]
        assert np.frombuffer(got, "<u4").tolist() == want
        assert own.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


def test_pairs_and_long_runs(own):
    for text in ("aaaaaaaaaaaaaaaaaaaaa", "abababababab", "in" * 40, "!" * 50, "th" * 33 + "e"):
        assert ids_of(own, text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_cache_that_overflows(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 7)
    small = bpe.WordBPE(PATH)
    texts = ["one two three four five six seven eight nine <|endoftext|> ten one two", "zwei <|endoftext|> drei one"] * 3
    for text, ids in zip(texts, small.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_query_rows(spark):
    rows = [(1, "Hello World"), (2, None), (3, ""), (4, " \n\t "), (None, "x"), (1, "Hello World"), (5, "ab " * 30_000)]

    def want(text):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        data = np.array(ids, dtype="<u4").tobytes()
        return len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    got = collected(bpe.round_trip(docs_frame(spark, rows), PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(((d, *want(t)) for d, t in rows), key=repr)
    decoded = bpe.decode(bpe.encode(docs_frame(spark, rows), PATH), PATH)
    assert (1, "hello</w> world</w>") in collected(decoded, "doc_id", "text")
    assert bpe.round_trip(docs_frame(spark, []), PATH).collect() == []
