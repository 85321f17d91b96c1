"""Removal of repeated passages with suffix automata of reference shards.

Every word goes that is covered by a window of ``LENGTH`` words whose words also start in a document with a
smaller id. What decides is a suffix automaton over the words of smaller documents: a document is streamed
through it, the matching statistic (length of the longest match that ends at a word) says where windows are
known, and the windows that aren't are added before the next document comes.

One automaton over all documents can't be broadcast, so the reference is cut into shards, and only documents
that could match a shard are streamed through it:

1. Texts are dealt to blocks of bounded bytes. A window's anchor is the smallest hash of its ``GRAM``-word
   grams, so equal windows have equal anchors. A block sends each anchor once with the smallest hash of an id
   that holds it; anchors of two documents or more come back with the smallest hash of all, which names the
   shard. Neighbouring anchors of a copied passage have the same holders, so a passage mostly stays in one shard.
2. Of the windows with shared anchors a block sends each hash once and learns which stand in two documents.
   This trims the edges of common passages, which are different in every document. Hashes only leave windows
   out that can't repeat; equal hashes of different windows cost time but no correctness.
3. Within its block, a document is streamed through the automaton of each shard that its windows name. Known
   windows are settled there and then; new ones go to the shard as passages.
4. A shard does the same with the passages of ``FAN_IN`` blocks at a time, in the order of the ids, round by
   round until it has met itself wholly. However many documents hold a passage, a block sends it once.
5. Blocks get the spans back and apply them to their texts.

Texts are shuffled once and read by steps 1, 2, 3 and 5.

Cases: null texts count as empty; texts of fewer than ``LENGTH`` words stay whole; a window that repeats only
within a document, or in rows with the same id, stays; rows with a null id neither lose nor cause anything;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.functions.windows import stack
from barograph.llm.hashing import BASE, SPACES, joined, mix, pack, powers, prefix_sums, range_hash, runs, unpack

LENGTH = 13
GRAM = 6
BLOCK_BYTES = 6 << 20
CHUNK_BYTES = 1 << 20
SHARD_BYTES = 1 << 20
FAN_IN = 512
KEY_BITS = 44


class Automaton:
    """Suffix automaton over sequences of words."""

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def state(self, size: int, link: int, step: dict) -> int:
        self.size.append(size)
        self.link.append(link)
        self.step.append(step)
        return len(self.size) - 1

    def split(self, p: int, q: int, word) -> int:
        """The state after ``p`` by ``word`` with strings of at most size(p) + 1; cut out of ``q`` if that holds more."""
        step, link, size = self.step, self.link, self.size
        if size[q] == size[p] + 1:
            return q
        copy = self.state(size[p] + 1, link[q], dict(step[q]))
        link[q] = copy
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = copy
            p = link[p]
        return copy

    def add(self, words) -> None:
        step, link = self.step, self.link
        last = 0
        for word in words:
            p = last
            q = step[p].get(word)
            if q is not None:
                last = self.split(p, q, word)
                continue
            last = self.state(self.size[p] + 1, 0, {})
            while p >= 0 and word not in step[p]:
                step[p][word] = last
                p = link[p]
            if p >= 0:
                link[last] = self.split(p, step[p][word], word)

    def known(self, words: list, length: int) -> np.ndarray:
        """For each window of ``length`` words whether it stands in what was added."""
        step, link, size = self.step, self.link, self.size
        out = np.zeros(len(words) - length + 1, dtype=bool)
        if len(size) == 1:
            return out
        state = count = 0
        for i, word in enumerate(words):
            to = step[state].get(word)
            while to is None and state:
                state = link[state]
                count = size[state]
                to = step[state].get(word)
            if to is None:
                count = 0
                continue
            state = to
            count += 1
            if count >= length:
                out[i - length + 1] = True
        return out


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true values as [first, end)."""
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def streamed(passages: list[tuple[int, object, int, list]]) -> tuple[list[tuple], list[tuple]]:
    """Spans that repeat, and new passages, of ``(id, address, place, words)`` rows of one shard.

    Rows come in the order of their ids; what a document holds is added after its last row.
    """
    automaton = Automaton()
    spans, fresh = [], []
    passages.sort(key=lambda p: p[0])
    waiting: list[list] = []
    for k, (doc, address, place, words) in enumerate(passages):
        known = automaton.known(words, LENGTH)
        spans += [(address, place + a, b - a + LENGTH - 1) for a, b in stretches(known)]
        for a, b in stretches(~known):
            own = words[a : b + LENGTH - 1]
            fresh.append((doc, address, place + a, own))
            waiting.append(own)
        if k + 1 == len(passages):
            break
        if passages[k + 1][0] != doc:
            for own in waiting:
                automaton.add(own)
            waiting = []
    return spans, fresh


def block_rows(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts in an order that depends on nothing but them; ids come first that aren't null."""
    rows = [(d is None, d or 0, t or b"") for d, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist())]
    rows.sort()
    return [None if null else d for null, d, _ in rows], [t for _, _, t in rows]


class Windows:
    """Windows of a block in the order of its rows: row, place in the text, hash and anchor key."""

    def __init__(self, ids: list, texts: list[bytes]):
        known = len(ids) - ids.count(None)
        parts = []
        for first, last in runs([len(t) for t in texts[:known]], CHUNK_BYTES):
            parts.append(self.chunk(texts[first:last], first))
        empty = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2
        self.row, self.place, self.hash, self.anchor = (np.concatenate(c) for c in zip(*(parts or [empty])))

    @staticmethod
    def chunk(texts: list[bytes], first: int) -> list[np.ndarray]:
        data, start = joined(texts)
        edge = np.flatnonzero(np.diff(SPACES[data], prepend=True))
        begin, end = edge[::2], edge[1::2]
        word = range_hash(prefix_sums(data), begin, end)
        row = np.searchsorted(start, begin, side="right") - 1
        count = max(0, len(word) - LENGTH + 1)

        def grams(size: int) -> np.ndarray:
            sums = np.zeros(max(0, len(word) - size + 1), dtype=np.uint64)
            for k in range(size if len(sums) else 0):
                sums += word[k : k + len(sums)] * powers(BASE, size + 1)[k + 1]
            return mix(sums)

        small = grams(GRAM)
        anchor = small[:count].copy()
        for k in range(1, LENGTH - GRAM + 1):
            np.minimum(anchor, small[k : k + count], out=anchor)
        place = np.arange(len(word)) - np.searchsorted(row, row)
        inside = row[:count] == row[LENGTH - 1 :]
        return [x[:count][inside] for x in (row + first, place, grams(LENGTH), anchor)]


def distinct(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, whether each stands under several ids, and the places of each key; ``ids`` ascend."""
    key, first, back = np.unique(keys, return_index=True, return_inverse=True)
    last = np.zeros(len(key), dtype=np.int64)
    last[back] = np.arange(len(keys))  # the last assignment stands
    return key, ids[first] != ids[last], back


KEYS = "part int, block int, keys binary, bits binary, least binary"
KEY_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("bits", pa.binary()), ("least", pa.binary())])


def cuts(keys: np.ndarray, parts: int) -> list[int]:
    """Where each part's range of the sorted keys begins, and the end."""
    bounds = [(p << KEY_BITS) // parts for p in range(parts + 1)]
    return np.searchsorted(keys, np.array(bounds, dtype=np.uint64)).tolist()


def sent(block: int, keys: np.ndarray, several: np.ndarray, least: np.ndarray | None, parts: int) -> pa.Table:
    """Keys of a block, by range, with a bit for several documents."""
    at = cuts(keys, parts)
    rows = [
        (p, block, pack(keys[a:b]), np.packbits(several[a:b]).tobytes(), None if least is None else least[a:b].tobytes())
        for p, (a, b) in enumerate(zip(at[:-1], at[1:]))
        if b > a
    ]
    return pa.table([list(c) for c in zip(*rows)], schema=KEY_SCHEMA) if rows else KEY_SCHEMA.empty_table()


def answered(table: pa.Table) -> pa.Table:
    """For the keys of each block, in the order they came, which stand in two documents, and their smallest hash."""
    table = table.sort_by("block")
    own = [unpack(k) for k in table.column("keys").to_pylist()]
    bits = [
        np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)).astype(bool) for b, k in zip(table.column("bits").to_pylist(), own)
    ]
    key, back, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = count > 1
    np.logical_or.at(shared, back, np.concatenate(bits))
    least = None
    if table.column("least").null_count == 0:
        sends = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("least").to_pylist()])
        least = np.full(len(key), np.iinfo(np.uint32).max, dtype="<u4")
        np.minimum.at(least, back, sends)
    rows, at = [], 0
    for part, block, k in zip(table.column("part").to_pylist(), table.column("block").to_pylist(), own):
        places = back[at : at + len(k)]
        at += len(k)
        hit = shared[places]
        if hit.any():
            rows.append((part, block, None, np.packbits(hit).tobytes(), None if least is None else least[places[hit]].tobytes()))
    return pa.table([list(c) for c in zip(*rows)], schema=KEY_SCHEMA) if rows else KEY_SCHEMA.empty_table()


def replies(table: pa.Table, keys: np.ndarray, parts: int, with_least: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which of a block's sorted keys are shared, and the smallest hash of each (0 where it isn't)."""
    hit, least = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype="<u4")
    at = cuts(keys, parts)
    for part, bits, low in zip(*(table.column(c).to_pylist() for c in ("part", "bits", "least"))):
        if (low is not None) != with_least:
            continue
        a, b = at[part], at[part + 1]
        hit[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        if with_least:
            least[a:b][hit[a:b]] = np.frombuffer(low, "<u4")
    return hit, least


PASSAGES = "shard int, fan int, block int, doc_id long, row int, place int, size int, text binary"
PASSAGE_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("fan", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64())]
    + [("row", pa.int32()), ("place", pa.int32()), ("size", pa.int32()), ("text", pa.binary())]
)


class Block:
    """A block's rows, windows and what it knows of them."""

    def __init__(self, table: pa.Table, parts: int):
        self.parts = parts
        self.number = table.column("block")[0].as_py()
        self.ids, self.texts = block_rows(table)
        self.windows = Windows(self.ids, self.texts)
        self.id = np.array([d for d in self.ids if d is not None], dtype=np.int64)
        shift = np.uint64(64 - KEY_BITS)
        self.of = self.id[self.windows.row]
        self.anchors, self.several, self.anchor = distinct(self.windows.anchor >> shift, self.of)

    def first(self) -> pa.Table:
        holder = (mix(self.of.astype(np.uint64)) >> np.uint64(32)).astype("<u4")
        least = np.full(len(self.anchors), np.iinfo(np.uint32).max, dtype="<u4")
        np.minimum.at(least, self.anchor, holder)
        return sent(self.number, self.anchors, self.several, least, self.parts)

    def narrowed(self, table: pa.Table) -> None:
        """Keep the windows whose anchors are shared."""
        hit, least = replies(table, self.anchors, self.parts, True)
        self.live = np.flatnonzero(hit[self.anchor])
        self.holder = least[self.anchor[self.live]]
        shift = np.uint64(64 - KEY_BITS)
        self.keys, self.repeated, self.key = distinct(self.windows.hash[self.live] >> shift, self.of[self.live])

    def second(self) -> pa.Table:
        return sent(self.number, self.keys, self.repeated, None, self.parts)

    def candidates(self, table: pa.Table, shards: int) -> dict[int, list[tuple]]:
        """Rows for ``streamed`` by shard."""
        hit, _ = replies(table, self.keys, self.parts, False)
        keep = hit[self.key]
        at = self.live[keep]
        shard = (mix(self.holder[keep].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        row, place = self.windows.row[at], self.windows.place[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(row) != 0) | (np.diff(shard) != 0)
        first = np.flatnonzero(new)
        end = place[np.append(first[1:], len(at)) - 1] + LENGTH if len(at) else first
        out: dict[int, list[tuple]] = {}
        split, words = -1, []
        for r, a, b, s in zip(row[first].tolist(), place[first].tolist(), end.tolist(), shard[first].tolist()):
            if r != split:
                split, words = r, self.texts[r].split()
            out.setdefault(s, []).append((self.ids[r], (self.number, r), a, words[a:b]))
        return out


def passage_rows(shard: int, fan: int, spans: list[tuple], fresh: list[tuple]) -> list[tuple]:
    # what is settled doesn't go to the shard but travels by block: a shard of many copies has many spans
    rows = [(-1 - block, fan, block, None, row, place, size, None) for (block, row), place, size in spans]
    return rows + [
        (shard, fan, block, doc, row, place, len(words), b" ".join(words)) for doc, (block, row), place, words in fresh
    ]


def passage_table(rows: list[tuple]) -> pa.Table:
    return pa.table([list(c) for c in zip(*rows)], schema=PASSAGE_SCHEMA) if rows else PASSAGE_SCHEMA.empty_table()


def met(table: pa.Table) -> pa.Table:
    """Step 4: the passages of some blocks in one shard; the spans of a block are passed on."""
    rows = table.to_pylist()
    shard, fan = rows[0]["shard"], rows[0]["fan"]
    if shard < 0:
        return table
    spans, fresh = streamed([(r["doc_id"], (r["block"], r["row"]), r["place"], r["text"].split()) for r in rows])
    return passage_table(passage_rows(shard, fan, spans, fresh))


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
RESULT_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
)


def applied(with_text: bool):
    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = block_rows(left)
        spans: dict[int, list[tuple[int, int]]] = {}
        for row, place, size, text in zip(*(right.column(c).to_pylist() for c in ("row", "place", "size", "text"))):
            if text is None:
                spans.setdefault(row, []).append((place, place + size))
        out = []
        for row, (doc, text) in enumerate(zip(ids, texts)):
            words = text.split()
            kept = words
            if row in spans:
                gone = np.zeros(len(words), dtype=bool)
                for a, b in spans[row]:
                    gone[a:b] = True
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            data = b" ".join(kept)
            out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(data).hexdigest(), data if with_text else None))
        return pa.table([list(c) for c in zip(*out)], schema=RESULT_SCHEMA) if out else RESULT_SCHEMA.empty_table()

    return remove


def remove_passages(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, the ``kept`` words joined by spaces."""
    text = F.col("text").cast("string").cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = 1 + size // BLOCK_BYTES, 1 + size // SHARD_BYTES
    # the text takes part, so that rows without an id, or with one id, are spread
    base = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    by_block = base.groupBy("block")

    def ask_anchors(table: pa.Table) -> pa.Table:
        return Block(table, blocks).first()

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return KEY_SCHEMA.empty_table()
        block = Block(left, blocks)
        block.narrowed(right)
        return block.second()

    def stream(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return PASSAGE_SCHEMA.empty_table()
        block = Block(left, blocks)
        block.narrowed(right)
        rows = []
        for shard, passages in block.candidates(right, shards).items():
            rows += passage_rows(shard, block.number, *streamed(passages))
        return passage_table(rows)

    anchors = by_block.applyInArrow(ask_anchors, KEYS).groupBy("part").applyInArrow(answered, KEYS)
    windows = by_block.cogroup(anchors.groupBy("block")).applyInArrow(ask_windows, KEYS)
    windows = windows.groupBy("part").applyInArrow(answered, KEYS)
    known = stack(anchors, windows)
    passages = by_block.cogroup(known.groupBy("block")).applyInArrow(stream, PASSAGES)
    left = blocks
    while left > 1:
        left = -(-left // FAN_IN)
        passages = passages.withColumn("fan", (F.col("fan") / FAN_IN).cast("int"))
        passages = passages.groupBy("shard", "fan").applyInArrow(met, PASSAGES)
    result = by_block.cogroup(passages.groupBy("block")).applyInArrow(applied(with_text), RESULT)
    return result if with_text else result.drop("kept")
