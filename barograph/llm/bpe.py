"""BPE encoding and decoding: speculate with greedy longest match, verify pairs, merge only what fails.

A token sequence is what the merges produce exactly when every two neighbours, taken alone, are left
apart by the merges. So each word is cut greedily by longest match, all neighbouring pairs of all new
words of a batch are tested at once in numpy, and only words with a failing pair are merged rank by
rank. The test undoes the two tokens step by step in the order of their ranks and looks whether a merge
across the border would have come first.

Texts are normalised and split as the vocabulary file says (NFC, white space, lower case, the pattern
for words). Special tokens that stand in a text become their ids, as in the public library.

Cases: null or empty text gives no tokens (``n_tokens`` 0, digests of nothing); text of white space only
likewise; texts are never cut; repeated rows give repeated results; an empty table gives an empty table;
other columns of the input are ignored. Memory: one Arrow batch and a word cache of two generations; a new
one begins beyond ``CACHE_WORDS`` entries, and words in use move on to it.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 150_000
CHUNK_TEXTS = 1_024
NEVER = np.iinfo(np.int64).max
# below this character normalising is the identity and lower case stays below it
SIMPLE_BELOW = "\u0180"


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte: printable Latin-1 stays, the rest moves to 256 and up."""
    stays = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in stays else chr(next(moved)) for b in range(256)]


class WordBPE:
    """Vocabulary, merges and caches of one tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        # the same pattern with its classes written out below SIMPLE_BELOW, for the faster module
        simple = [chr(c) for c in range(ord(SIMPLE_BELOW))]
        written = pattern
        for name in ("\\p{L}", "\\p{N}", "\\s"):
            members = "".join(re.escape(c) for c in simple if regex.fullmatch(name, c))
            written = written.replace(f"[{name}]", f"[{members}]").replace(name, members)
        self.split_simple = re.compile(written).findall
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.not_simple = regex.compile(f"[^\\x00-{chr(ord(SIMPLE_BELOW) - 1)}]").search
        self.vocab = vocab
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.token = np.empty(n, dtype=object)
        self.token[:] = ""
        for table in (vocab, self.special):
            for s, i in table.items():
                self.token[i] = s
        # rank of a token: 0 for the alphabet, else 1 + number of the merge that makes it
        self.rank = np.zeros(n, dtype=np.int64)
        self.left = np.full(n, -1, dtype=np.int64)
        self.right = np.full(n, -1, dtype=np.int64)
        keys, makes = [], []
        for r, (a, b) in enumerate(merges, 1):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            keys.append(x * n + y)
            makes.append(z)
            if self.left[z] < 0 and len(a + b) > 1:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        order = np.argsort(keys, kind="stable")
        self.n = n
        self.pair_key = np.array(keys, dtype=np.int64)[order]
        self.pair_rank = order + 1
        self.pair_makes = np.array(makes, dtype=np.int64)[order]
        self.longest = max(len(s) for s in vocab)
        self.to_chars = dict(enumerate(byte_alphabet()))
        # no word looks like a special token with its mark: the pattern never joins letters and signs
        self.marked = {s + "\0": np.array([i], dtype="<u4").tobytes() for s, i in self.special.items()}
        self.cache: dict[str, bytes] = dict(self.marked)
        self.older: dict[str, bytes] = {}
        # a token that its own text isn't merged to can't be proposed
        own = self.exact(list(vocab))
        self.unsafe = np.zeros(n, dtype=bool)
        self.unsafe[[i for i, ids in zip(vocab.values(), own) if ids.tolist() != [i]]] = True

    def units(self, s: str) -> list[int]:
        """Ids of the alphabet units of a stand-in text, its last one with the word end if ``s`` has it."""
        if s.endswith(self.end) and len(s) > len(self.end):
            body = s[: -len(self.end)]
            return [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + self.end]]
        return [self.vocab[c] for c in s]

    def exact(self, texts: list[str]) -> list[np.ndarray]:
        """Merge by rank, leftmost first, all texts side by side: the definition."""
        units = [self.units(s) for s in texts]
        ids = np.array([i for u in units for i in u], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(u) for u in units])
        out: list = [None] * len(texts)
        while len(ids):
            rank, makes = np.full(len(ids), NEVER), np.zeros(len(ids), dtype=np.int64)
            rank[:-1], makes[:-1] = self.merge_of(ids[:-1], ids[1:])
            rank[:-1][owner[1:] != owner[:-1]] = NEVER
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(start, append=len(ids))
            best = np.minimum.reduceat(rank, start)
            for a, k in zip(start[best == NEVER].tolist(), size[best == NEVER].tolist()):
                out[owner[a]] = ids[a : a + k]
            best = np.repeat(best, size)
            hit = np.flatnonzero((rank == best) & (best < NEVER))
            # in a run such as a a a a the first, third, ... pair is merged
            first = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, hit, 0))
            hit = hit[(hit - first) % 2 == 0]
            ids[hit] = makes[hit]
            keep = best < NEVER
            keep[hit + 1] = False
            ids, owner = ids[keep], owner[keep]
        return out

    def greedy(self, s: str) -> list[int] | None:
        """Longest token at each place of ``s``, which ends with the word end; None if it gets stuck."""
        ids, at, stop = [], 0, len(s)
        last = stop - len(self.end)
        find = self.vocab.get
        while at < stop:
            i = find(s[at:stop]) if stop - at <= self.longest else None
            if i is not None:
                ids.append(i)
                break
            end = min(last, at + self.longest)
            while (i := find(s[at:end])) is None:
                end -= 1
                if end == at:  # the last unit stands with the word end
                    return None
            ids.append(i)
            at = end
            if at == last:
                return None
        return ids

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair, ``NEVER`` if there is none, and the token that it makes."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER), self.pair_makes[at]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For all pairs at once: do the merges of ``a + b`` end with ``a`` and ``b`` apart?

        Going back in time, the younger of the two border tokens is replaced by its half at the
        border. A merge across the border must not be older than the merge that was undone: on the
        left side it must be younger or equal to lose, on the right side an equal rank wins
        because merging goes from left to right.
        """
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        bound = np.full(len(a), NEVER)  # a crossing merge below this rank comes first
        while len(live):
            crossing = self.merge_of(x, y)[0] < bound
            ok[live[crossing]] = False
            rx, ry = self.rank[x], self.rank[y]
            done = crossing | ((rx == 0) & (ry == 0))
            live, x, y, rx, ry = (v[~done] for v in (live, x, y, rx, ry))
            undo_left = rx > ry
            bound = np.where(undo_left, rx, ry + 1)
            x = np.where(undo_left, self.right[x], x)
            y = np.where(undo_left, y, self.left[y])
        return ok

    def learn(self, words: list[str]) -> None:
        """Encode words that the cache lacks."""
        chars = self.to_chars
        texts = [
            (w if w.isascii() and w.isprintable() else "".join([chars[b] for b in w.encode()])) + self.end
            for w in words
        ]
        proposed = [self.greedy(s) or [0] for s in texts]
        sizes = np.fromiter(map(len, proposed), dtype=np.int64, count=len(words))
        flat = np.fromiter((i for ids in proposed for i in ids), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = self.unsafe[flat] | (flat == 0)  # 0 is a unit without word end and never a whole word
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
        bad[inner] |= ~self.compatible(pairs // self.n, pairs % self.n)[back]
        data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        self.cache.update(zip(words, map(data.__getitem__, map(slice, [0, *ends], ends))))
        failing = np.unique(owner[bad]).tolist()
        for k, ids in zip(failing, self.exact([texts[k] for k in failing])):
            self.cache[words[k]] = ids.astype("<u4").tobytes()

    def words(self, text: str) -> list[str]:
        if self.not_simple(text):
            return self.split(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if "İ" in text:  # its lower case has a mark
            return self.split(text.lower())
        return self.split_simple(text.lower())

    def parts(self, text: str) -> list[str]:
        """Words of a text; special tokens stand as themselves at odd places of the cut."""
        if "<|" not in text:
            return self.words(text)
        out = []
        for k, part in enumerate(self.cut_special(text)):
            out += [part + "\0"] if k % 2 else self.words(part)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for start in range(0, len(texts), CHUNK_TEXTS):
            split = [self.parts(t) if t else [] for t in texts[start : start + CHUNK_TEXTS]]
            if len(self.cache) > CACHE_WORDS:
                self.older, self.cache = self.cache, dict(self.marked)
            missing = {w for words in split for w in words if w not in self.cache}
            known = missing & self.older.keys()
            self.cache.update((w, self.older[w]) for w in known)
            if len(missing) > len(known):
                self.learn(list(missing - known))
            out += [b"".join(map(self.cache.__getitem__, words)) for words in split]
        return out

    def decode(self, ids: bytes) -> str:
        """The file has no decoder, so tokens are set apart by single spaces, special ones included."""
        return " ".join(self.token[np.frombuffer(ids, dtype="<u4")].tolist())


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordBPE:
    """One per Python worker; workers serve many tasks."""
    return WordBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` of whole texts."""

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            ids = t.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                [id_col, "ids", "n_tokens"],
            )

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return kept.mapInArrow(run, f"`{id_col}` long, ids binary, n_tokens long")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``text`` of encoded rows, special tokens kept."""

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            text = [t.decode(x) if x else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], [id_col, "text"])

    return tokens.select(id_col, "ids").mapInArrow(run, f"`{id_col}` long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: encode, then decode the ids, in one pass."""

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            ids = t.encode_batch(b.column(1).to_pylist())
            decoded = (hashlib.sha256(t.decode(x).encode()).hexdigest() for x in ids)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array(list(decoded), pa.string()),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return kept.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
