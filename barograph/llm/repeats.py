"""Removal of repeated byte strings with a Burrows-Wheeler transform.

Every byte goes that is covered by a string of ``LENGTH`` bytes which also starts in a document with a
smaller id. To find equal strings without bringing all text together, each string is represented by its
anchor: of the ``GRAM``-byte grams in it the leftmost with the smallest hash. Equal strings have equal
anchors, and neighbouring strings mostly share one, so a text is cut into runs of strings by anchor.

1. Texts are dealt to blocks of bounded bytes. A block sends each of its anchors once; those that stand in
   two documents or more come back. Other runs can't repeat and drop out.
2. A block sends the bytes of the remaining runs, equal runs once with their smallest id, by range of the
   anchor. Where a block holds an equal run with a smaller id, the run is removed there and then. Runs of an
   anchor in more than ``HOT_DOCS`` documents are sent as single strings by range of the string's hash, so the
   many different runs at the edge of a common passage don't meet in one task.
3. A range collapses equal runs again. Where an anchor still has several different runs, their bytes are
   concatenated, and intervals of the sorted suffixes are extended backwards through the Burrows-Wheeler
   transform, breadth first, one byte a level from ``START`` on: after level l each interval holds the places
   of one string of l bytes. Intervals of one place are left, and level ``LENGTH`` gives the groups of equal
   strings with their smallest id.
4. Blocks get the spans to remove and apply them to the input texts.

The texts are shuffled once, and read by steps 1, 2 and 4. However often a run or a string occurs, a block sends
it once.

Cases: null texts count as empty; texts shorter than ``LENGTH`` stay whole; a string that repeats only within
a document, or in rows with the same id, stays; rows with a null id neither lose nor cause anything; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from barograph.llm.blocks import KEY_SHIFT, answered, places, shared_frequencies, with_blocks
from barograph.llm.hashing import joined, mix, prefix_sums, range_hash, runs

LENGTH = 50
GRAM = 24
CHUNK_BYTES = 1 << 20
SORT_BYTES = 1 << 19
START = 32
HOT_DOCS = 1 << 14


class Runs:
    """Runs of strings with one anchor: text, place of the first string, bytes covered, anchor key and place."""

    __slots__ = ("text", "start", "size", "key", "anchor")

    def __init__(self, text, start, size, key, anchor):
        self.text, self.start, self.size, self.key, self.anchor = text, start, size, key, anchor


def smallest_in(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def anchored(texts: list[bytes], first_text: int) -> Runs:
    """The runs of some texts, whose numbers start with ``first_text``."""
    data, start = joined(texts)
    if len(data) <= LENGTH:
        return Runs(*[np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64)])
    sums = prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = range_hash(sums, at, at + GRAM)
    low = np.uint64((1 << 32) - 1)
    least = smallest_in((gram & ~low) | at.astype(np.uint64), LENGTH - GRAM + 1)
    anchor = (least & low).astype(np.int64)  # by place of the string
    place = np.arange(len(anchor))
    owner = np.searchsorted(start, place, side="right") - 1
    whole = place + LENGTH <= start[owner + 1] - 1  # the byte before the next text is a separator
    place, anchor, owner = place[whole], anchor[whole], owner[whole]
    edge = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(edge[1:], len(place)) - 1
    begin = place[edge]
    text = owner[edge]
    key = mix(gram[anchor[edge]])  # the smallest of many hashes are small, which ranges must not see
    return Runs(text + first_text, begin - start[text], place[last] - begin + LENGTH, key, anchor[edge] - begin)


def chunked(texts: list[bytes]):
    for a, b in runs([len(t) for t in texts], CHUNK_BYTES):
        yield anchored(texts[a:b], a)


def block_texts(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a block by id; null ids last."""
    rows = zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist())
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    return [r[0] for r in rows], [(r[1] or "").encode("utf-8", "surrogatepass") for r in rows]


def anchor_sets(table: pa.Table) -> list[np.ndarray]:
    """The distinct anchors of each document; rows with one id are one document."""
    ids, texts = block_texts(table)
    known = [t for i, t in zip(ids, texts) if i is not None]
    number = np.cumsum([k > 0 and ids[k] != ids[k - 1] for k in range(len(known))])
    pairs = [(number[r.text], r.key) for r in chunked(known)]
    if not pairs:
        return []
    text, key = (np.concatenate(c) for c in zip(*pairs))
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(key, prepend=~key[:1]) != 0))
    return [key[new]]  # frequencies only need all of them together


SPANS = "part int, block int, bytes binary, sizes binary, anchors binary, docs binary, rows binary, starts binary"
SPAN_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32())] + [(c.split()[0], pa.binary()) for c in SPANS.split(", ")[2:]])


def span_row(part: int, block: int, found: list[tuple]) -> tuple:
    """A packed row of (bytes, size, anchor, doc, row, start); without bytes they are spans to remove.

    Numbers are kept as differences and all columns compressed: they make up half of what is shuffled.
    """
    text, *numbers = zip(*found)
    text = b"".join(text)
    steps = (np.diff(np.array(c, "<i8"), prepend=0) for c in numbers)
    return (part, block, zlib.compress(text, 1) if text else b"", *(zlib.compress(c.tobytes(), 1) for c in steps))


def unpacked(table: pa.Table):
    """(block, bytes, sizes, anchors, docs, rows, starts) of each packed row."""
    columns = [table.column(c).to_pylist() for c in SPAN_SCHEMA.names[1:]]
    for block, text, *rest in zip(*columns):
        numbers = (np.cumsum(np.frombuffer(zlib.decompress(x), "<i8")) for x in rest)
        yield block, zlib.decompress(text) if text else b"", *numbers


def candidates(blocks: int, hot_docs: int):
    """Step 2: runs with shared anchors, and spans that the block can settle alone."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return SPAN_SCHEMA.empty_table()
        keys, df = answered(right)
        ids, texts = block_texts(left)
        block = left.column("block")[0].as_py()
        first: dict[tuple[bytes, int], int] = {}
        strings: dict[bytes, int] = {}
        settled, parts = [], {}
        for r in chunked(texts):
            shared, at = places(keys, r.key >> KEY_SHIFT)
            hot = np.zeros(len(shared), dtype=bool)
            hot[shared] = df[at[shared]] > hot_docs
            part = ((r.key >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            columns = (r.text, r.start, r.size, r.anchor, part, hot)
            for text, start, size, anchor, p, single in zip(*(c[shared].tolist() for c in columns)):
                doc = ids[text]
                if doc is None:
                    continue
                own = texts[text][start : start + size]
                if first.setdefault((own, anchor), doc) < doc:
                    settled.append((b"", size, 0, doc, text, start))
                elif not single:
                    parts.setdefault(p, []).append((own, size, anchor, doc, text, start))
                else:
                    known = []
                    for k in range(size - LENGTH + 1):
                        string = own[k : k + LENGTH]
                        if strings.setdefault(string, doc) < doc:
                            known.append(k)
                        else:
                            p = (xxhash.xxh3_64_intdigest(string) >> 32) * blocks >> 32
                            parts.setdefault(p, []).append((string, LENGTH, anchor - k, doc, text, start + k))
                    if known:  # strings of a run overlap
                        settled.append((b"", known[-1] - known[0] + LENGTH, 0, doc, text, start + known[0]))
        out = [span_row(p, block, found) for p, found in sorted(parts.items())]
        if settled:  # they only pass through a part
            out.append(span_row(block % blocks, block, settled))
        return pa.table([list(c) for c in zip(*out)], schema=SPAN_SCHEMA) if out else SPAN_SCHEMA.empty_table()

    return send


def suffix_order(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the 64 bytes that start there, by doubling from 8; and the ranks of START bytes."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    word = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(data)]
    for reach in (8, 16, START):
        order = np.argsort(word)
        rank = np.empty(len(data), dtype=np.uint64)
        rank[order] = np.cumsum(np.diff(word[order], prepend=word[order[:1]]) != 0) + 1
        later = np.zeros(len(data), dtype=np.uint64)
        later[:-reach] = rank[reach:]
        word = rank << np.uint64(32) | later
    return np.argsort(word).astype(np.int32), rank.astype(np.int32)


def equal_strings(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose ``length`` bytes occur more than once, and the number of each one's string.

    The sort gives the intervals of equal strings of START bytes. Level by level, an interval of sorted
    suffixes that start with one string is extended by the byte in front: the transform holds that byte, and
    stepping to it moves each suffix to its own place in the order. Places of an interval with equal bytes
    in front form an interval again. Only intervals of two places or more go on, up to ``length``, which the
    sort order covers.
    """
    whole = len(data) - length
    # a byte behind lets strings end with the last byte, a byte in front lets them start with the first
    data = np.concatenate([np.zeros(1, np.uint8), data, np.zeros(1, np.uint8)])
    order, rank = suffix_order(data)
    back = np.empty(len(data), dtype=np.int32)
    back[order] = np.arange(len(data), dtype=np.int32)
    step = back[order - 1]  # where the suffix one byte longer stands; the first one wraps around
    head = data[order]
    group = rank[order]
    live = np.flatnonzero((np.bincount(group)[group] > 1) & (order != 0)).astype(np.int32)
    group = group[live]
    group_at = np.empty(len(data), dtype=np.int32)
    marked = np.zeros(len(data), dtype=bool)
    for level in range(START, length):
        to = step[live]
        group_at[to], marked[to] = group, True
        live = np.flatnonzero(marked).astype(np.int32)
        marked[live] = False
        own, byte = group_at[live], head[live]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (live[1:] - live[:-1] != 1) | (own[1:] != own[:-1]) | (byte[1:] != byte[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(live)))
        several = np.repeat(size > 1, size)
        group = np.repeat(np.arange(len(first), dtype=np.int32), size)
        if level < length - 1:
            several &= order[live] != 0  # nothing stands in front of the first byte
        live, group = live[several], group[several]
        if not len(live):
            break
    place = order[live].astype(np.int64) - 1
    inside = (place >= 0) & (place <= whole)
    return place[inside], group[inside]


def smallest_ids(texts: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each string of each text the smallest id of a text that holds it; ``least`` is each text's own."""
    data, start = joined(texts)
    count = np.array([len(t) - LENGTH + 1 for t in texts])
    at = np.repeat(start[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
    owner = np.repeat(np.arange(len(texts)), count)
    number = np.full(len(data), -1, dtype=np.int64)
    place, group = equal_strings(data, LENGTH)
    number[place] = group
    own = number[at]
    best = least[owner].copy()
    if (own >= 0).any():
        low = np.full(int(own.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, own[own >= 0], least[owner[own >= 0]])
        best[own >= 0] = low[own[own >= 0]]
    return np.split(best, np.cumsum(count)[:-1])


def settle(table: pa.Table) -> pa.Table:
    """Step 3: spans to remove of the runs of a part."""
    packed = list(unpacked(table))
    number: dict[tuple[bytes, int], int] = {}
    least: list[int] = []
    by_anchor: dict[bytes, list[int]] = {}
    texts, entries, out = [], [], []
    for block, text, sizes, anchors, docs, rows, starts in packed:
        if not text:
            found = zip(sizes.tolist(), docs.tolist(), rows.tolist(), starts.tolist())
            out.append(span_row(0, block, [(b"", size, 0, doc, row, start) for size, doc, row, start in found]))
            continue
        at = 0
        for size, anchor, doc, row, start in zip(*(c.tolist() for c in (sizes, anchors, docs, rows, starts))):
            own = (text[at : at + size], anchor)
            at += size
            k = number.setdefault(own, len(least))
            if k == len(least):
                least.append(doc)
                texts.append(own[0])
                by_anchor.setdefault(own[0][anchor : anchor + GRAM], []).append(k)
            else:
                least[k] = min(least[k], doc)
            entries.append((block, k, doc, row, start))
    low = np.array(least, dtype=np.int64)
    several: dict[int, np.ndarray] = {}
    # different runs of one string each have nothing in common
    many = [ks for ks in by_anchor.values() if len(ks) > 1 and any(len(texts[k]) > LENGTH for k in ks)]
    for a, b in runs([sum(len(texts[k]) for k in ks) for ks in many], SORT_BYTES):
        ks = [k for own in many[a:b] for k in own]
        several.update(zip(ks, smallest_ids([texts[k] for k in ks], low[ks])))
    spans: dict[int, list[tuple]] = {}
    for block, k, doc, row, start in entries:
        if k in several:
            hit = np.flatnonzero(several[k] < doc)
            if len(hit):
                # strings of a run overlap, so what they cover is one span
                spans.setdefault(block, []).append((b"", int(hit[-1] - hit[0]) + LENGTH, 0, doc, row, start + int(hit[0])))
        elif least[k] < doc:
            spans.setdefault(block, []).append((b"", len(texts[k]), 0, doc, row, start))
    out += [span_row(0, block, found) for block, found in sorted(spans.items())]
    return pa.table([list(c) for c in zip(*out)], schema=SPAN_SCHEMA) if out else SPAN_SCHEMA.empty_table()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def applied(with_text: bool):
    """Step 4: remove the spans from the texts of a block."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
        + [("kept_sha256", pa.string()), ("kept", pa.binary())]
    )

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = block_texts(left)
        spans: dict[int, list[tuple[int, int]]] = {}
        for _, _, sizes, _, _, rows, starts in unpacked(right):
            for row, start, size in zip(rows.tolist(), starts.tolist(), sizes.tolist()):
                spans.setdefault(row, []).append((start, start + size))
        out = []
        for row, (doc, text) in enumerate(zip(ids, texts)):
            kept, at, count = [], 0, 0
            reach = -1
            for a, b in sorted(spans.get(row, ())):
                if a > reach:
                    kept.append(text[at:a])
                    count += 1
                reach = at = max(reach, b)
            kept = b"".join(kept) + text[at:]
            digest = hashlib.sha256(kept).hexdigest()
            out.append((doc, len(text), len(text) - len(kept), count, digest, kept if with_text else None))
        return pa.table([list(c) for c in zip(*out)], schema=schema) if out else schema.empty_table()

    return remove


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, the ``kept`` bytes."""
    base, blocks = with_blocks(docs)
    shared = shared_frequencies(base, blocks, anchor_sets)
    by_block = base.groupBy("block")
    sent = by_block.cogroup(shared.groupBy("block")).applyInArrow(candidates(blocks, HOT_DOCS), SPANS)
    spans = sent.groupBy("part").applyInArrow(settle, SPANS)
    result = by_block.cogroup(spans.groupBy("block")).applyInArrow(applied(with_text), RESULT)
    return result if with_text else result.drop("kept")
