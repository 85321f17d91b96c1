"""Benchmark decontamination by latent semantic retrieval.

1. Inverse document frequencies of hashed words over every document.
2. Randomised SVDs of the TF-IDF passages of the benchmark, a block of ``BLOCK_PASSAGES`` at a time and
   spread over the tasks, give each word of a block a latent vector. The rank is the number of passages, so
   that every passage keeps its whole length: an exact copy has cosine 1 however many items there are.
3. Windows of every document, as wide as the passages of a scale and a quarter of that apart, are folded into
   the latent space and compared with the passages of the scale there: the cosine is relative to the window's
   latent length, so words about which the passages say nothing don't hide a copy that stands among them. A
   window also has to be mostly the passage (``MIN_COSINE`` of its full length) or to hold ``MIN_HELD`` of the
   passage's weight. A window whose words known to a block carry too little weight for either (repeated words
   apart) is left out before its vector is built.
4. Around each window that reaches it, the longest common subsequence of words decides: a large share of the
   item, or a smaller one if its answer, the last part of the item, is there as well. So an item is found
   after words were exchanged, dropped or put in.

Everything after the frequencies is one pass over the documents without a shuffle. The benchmark is the
stated query set; it is taken in groups of about ``GROUP_PASSAGES`` passages (a longer item stays whole), whose
vectors go to the tasks, and each group meets all documents in one pass.

Cases: null and empty texts match nothing; items without words are never found; an item or document that
repeats gives a row for each of its rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.hashing import mix, runs, words

TERMS = 1 << 18
RANGE = 1 << 12  # terms per row of the frequency table
SCALES = (16, 32, 64)  # CELL times powers of two
BLOCK_PASSAGES = 128  # the largest rank as well
GROUP_PASSAGES = 1_024
MIN_COSINE = 0.4
MIN_KNOWN = MIN_COSINE**2
MIN_HELD = 0.6
CELL = 4
CHUNK_BYTES = 1 << 18
WHOLE = 0.8
PART, ANSWER = 0.6, 0.8
ANSWER_SHARE = 1 / 3

LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Block(NamedTuple):
    row: np.ndarray  # by term: its place in vectors, or -1
    vectors: np.ndarray  # latent vectors of the block's terms, times idf
    scale: np.ndarray  # by passage
    owner: np.ndarray  # by passage: place of its item
    passages: np.ndarray  # latent unit-length passages
    length: np.ndarray  # by passage: its TF-IDF length


class Index(NamedTuple):
    idf: np.ndarray  # by term
    known: np.ndarray  # by term: does a block have it
    blocks: list[Block]
    ids: list[int]
    items: list[list[int]]  # word hashes of whole items


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-case words without punctuation, and the number of the text of each."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    return words(raw, separators=~LETTERS)


def term(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(46)).astype(np.int64)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents."""

    def count(batches):
        total = np.zeros(TERMS, dtype=np.int64)
        rows = 0
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            rows += len(texts)
            for first, last in runs([len(t) for t in texts], 1 << 20):
                word, owner = split_words(texts[first:last])
                key = owner * TERMS + term(word)
                if last - first < 1 << 13:  # narrow keys sort faster
                    key = key.astype(np.uint32)
                key.sort()
                total += np.bincount(key[np.diff(key, prepend=key[:1] + 1) != 0] % TERMS, minlength=TERMS)
        parts = [total[a : a + RANGE].astype("<i8").tobytes() for a in range(0, TERMS, RANGE)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(-1, len(parts)), pa.int32()),
                pa.array([np.array([rows], dtype="<i8").tobytes(), *parts], pa.binary()),
            ],
            ["part", "total"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype="<i8") for x in table.column("total").to_pylist())
        return pa.table([table.column("part")[:1], pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    kind = "part int, total binary"
    got = dict(
        docs.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(count, kind)
        .groupBy("part")
        .applyInArrow(add, kind)
        .collect()
    )
    if -1 not in got:
        return np.zeros(TERMS, dtype=np.int64), 0
    total = np.concatenate([np.frombuffer(got[p], dtype="<i8") for p in range(TERMS // RANGE)])
    return total, int(np.frombuffer(got[-1], dtype="<i8")[0])


def passages_of(word: np.ndarray) -> list[np.ndarray]:
    return [word[a : a + SCALES[-1]] for a in range(0, len(word), SCALES[-1])]


def passage_count(items: DataFrame) -> int:
    def run(batches):
        for b in batches:
            n = [len(passages_of(split_words([t or ""])[0])) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    return items.select("text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def tfidf_length(word: np.ndarray, idf: np.ndarray) -> float:
    terms, tf = np.unique(term(word), return_counts=True)
    return float(np.linalg.norm(tf * idf[terms]))


def weighted(word: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a passage and their TF-IDF weights, of unit length together."""
    terms, tf = np.unique(term(word), return_counts=True)
    w = tf * idf[terms]
    return terms, w / (np.sqrt((w**2).sum()) or 1)


def gaussian(terms: np.ndarray, width: int) -> np.ndarray:
    """Rows of the random test matrix, from the numbers of the terms alone."""
    place = terms.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)
    u = ((mix(place * np.uint64(2) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    v = (mix(place * np.uint64(2) + np.uint64(2)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def latent_terms(passages: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of some passages, and the right singular vectors (terms by rank) of their TF-IDF matrix.

    Randomised range finding with one power iteration. The rank is the number of passages.
    """
    rows = [weighted(p, idf) for p in passages]
    known = np.unique(np.concatenate([terms for terms, _ in rows]))
    matrix = np.zeros((len(rows), len(known)))
    for k, (terms, w) in enumerate(rows):
        matrix[k, np.searchsorted(known, terms)] = w
    rank = min(len(rows), len(known))
    basis, _ = np.linalg.qr(matrix.T @ (matrix @ gaussian(known, rank + 8)))
    basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    _, _, turn = np.linalg.svd(matrix @ basis, full_matrices=False)
    return known, basis @ turn[:rank].T


def build_index(items: DataFrame, idf: np.ndarray) -> Index | None:
    """The index of one group of items."""
    got = items.select("item_id", "text").collect()
    own = [split_words([r["text"] or ""])[0] for r in got]
    keep = [k for k, w in enumerate(own) if len(w)]
    if not keep:
        return None
    ids, own = [got[k]["item_id"] for k in keep], [own[k] for k in keep]
    pieces = [(k, p) for k, w in enumerate(own) for p in passages_of(w)]

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("place").to_numpy())
        words = table.column("words").take(pa.array(order)).to_pylist()
        known, vectors = latent_terms([np.frombuffer(w, dtype="<u8") for w in words], idf)
        parts = [[x] for x in (known.astype("<i8").tobytes(), vectors.astype("<f8").tobytes())]
        return pa.table([table.column("block")[:1], *(pa.array(x, pa.binary()) for x in parts)], names=["block", "known", "vectors"])

    rows = [(at // BLOCK_PASSAGES, at, p.astype("<u8").tobytes()) for at, (_, p) in enumerate(pieces)]
    latent = (
        items.sparkSession.createDataFrame(rows, "block int, place int, words binary")
        .groupBy("block")
        .applyInArrow(run, "block int, known binary, vectors binary")
        .collect()
    )
    blocks, anywhere = [], np.zeros(TERMS, dtype=bool)
    for block, known, vectors in sorted(tuple(r) for r in latent):
        known = np.frombuffer(known, dtype="<i8")
        vectors = np.frombuffer(vectors, dtype="<f8").reshape(len(known), -1)
        row = np.full(TERMS, -1, dtype=np.int32)
        row[known] = np.arange(len(known))
        anywhere[known] = True
        scale, owner, passages, length = [], [], [], []
        for k, p in pieces[block * BLOCK_PASSAGES : (block + 1) * BLOCK_PASSAGES]:
            terms, weight = weighted(p, idf)
            v = weight @ vectors[row[terms]]
            scale.append(next(s for s in SCALES if s >= len(p)))
            owner.append(k)
            passages.append(v / (np.linalg.norm(v) or 1))
            length.append(tfidf_length(p, idf))
        scaled = (idf[known][:, None] * vectors).astype(np.float32)
        parts = (np.array(scale), np.array(owner), np.array(passages, dtype=np.float32), np.array(length, dtype=np.float32))
        blocks.append(Block(row, scaled, *parts))
    return Index(idf.astype(np.float32), anywhere, blocks, ids, [w.tolist() for w in own])


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit of an integer for each place of ``a``."""
    at: dict = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def contained(item: list[int], region: list[int]) -> tuple[bool, float, float]:
    """Does the region hold the item, and the shares of the item and of its answer found in it."""
    whole = common(item, region) / len(item)
    answer = item[-max(1, round(len(item) * ANSWER_SHARE)) :]
    part = common(answer, region) / len(answer)
    return whole >= WHOLE or (whole >= PART and part >= ANSWER), whole, part


def windows(cells: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and past-the-last cell of the windows of texts with so many cells each.

    A text has at least one window, and its last window reaches its end.
    """
    width, step = scale // CELL, max(1, scale // CELL // 4)
    count = np.where(cells > 0, 1 + np.maximum(0, -(-(cells - width) // step)), 0)
    text = np.repeat(np.arange(len(cells)), count)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
    return text, first, np.minimum(first + width, cells[text])


def candidates(index: Index, word: np.ndarray, owner: np.ndarray, texts: int):
    """(text, item, cosine, held share, first word, past-the-last word) of the windows that reach the thresholds."""
    length = np.bincount(owner, minlength=texts)
    begin = np.cumsum(length) - length
    cells = -(-length // CELL)
    gap = SCALES[-1] // CELL  # empty cells behind each text, into which its last windows reach
    base = np.cumsum(cells + gap) - cells - gap
    cell = base[owner] + (np.arange(len(word)) - begin[owner]) // CELL
    terms = term(word)
    weight = index.idf[terms].astype(np.float64) ** 2
    total = int((cells + gap).sum())
    mass = np.concatenate([[0.0], np.cumsum(np.bincount(cell, weight, minlength=total))])
    spread = []
    for scale in sorted({s for b in index.blocks for s in b.scale.tolist()}):
        text, first, last = windows(cells, scale)
        a, z = base[text] + first, base[text] + last
        m = mass[z] - mass[a]
        spread.append((scale, text, first, last, a, z, m))
    anywhere = np.flatnonzero(index.known[terms])
    for block in index.blocks:
        row = block.row[terms[anywhere]]
        known, row = anywhere[row >= 0], row[row >= 0]
        inside = np.concatenate([[0.0], np.cumsum(np.bincount(cell[known], weight[known], minlength=total))])
        looked_at, edges = [], np.zeros(total + 1, dtype=np.int64)
        for scale, text, first, last, a, z, m in spread:
            of = np.flatnonzero(block.scale == scale)
            if not len(of):
                continue
            least = np.minimum(MIN_KNOWN * m, (MIN_HELD * block.length[of].min()) ** 2)
            live = np.flatnonzero((inside[z] - inside[a] >= least) & (m > 0))
            if not len(live):
                continue
            looked_at.append((of, *(v[live] for v in (text, first, last, a, m)), scale))
            np.add.at(edges, a[live], 1)
            np.add.at(edges, z[live], -1)
        if not looked_at:
            continue
        covered = np.cumsum(edges)[:-1] > 0
        near = covered[cell[known]]  # words of windows that are looked at
        known, row = known[near], row[near]
        # only the cells in reach of such windows get sums; the others would stay empty
        reach = np.zeros(total + 1, dtype=np.int64)
        for _, _, _, _, a, _, scale in looked_at:
            np.add.at(reach, a, 1)
            np.add.at(reach, np.minimum(a + SCALES[-1] // CELL, total), -1)
        at_cell = np.cumsum(reach)[:-1] > 0
        short = np.cumsum(at_cell) - 1
        sums = np.zeros((int(at_cell.sum()) + SCALES[-1] // CELL, block.vectors.shape[1]), dtype=np.float32)
        slot = (known - begin[owner[known]]) % CELL
        for k in range(CELL):  # no cell has two words in one slot
            own = slot == k
            sums[short[cell[known[own]]]] += block.vectors[row[own]]
        width = 1
        for of, text, first, last, a, m, scale in looked_at:
            while width * CELL < scale:  # sums of twice as many cells from each cell on
                sums[:-width] += sums[width:]
                width *= 2
            folded = sums[short[a]]
            full = np.sqrt(m).astype(np.float32)
            # the full length leaves repeated words apart, so that it may be the smaller one
            latent = np.minimum(np.sqrt(np.einsum("ij,ij->i", folded, folded)), full)
            along = folded @ block.passages[of].T
            near = (along >= MIN_COSINE * full[:, None]) | (along >= MIN_HELD * block.length[of])
            at, k = np.nonzero(near & (along >= MIN_COSINE * latent[:, None]) & (along > 0))
            along = along[at, k]
            found = (text[at], block.owner[of[k]], along / latent[at], along / block.length[of[k]], first[at] * CELL, last[at] * CELL)
            yield from zip(*(v.tolist() for v in found))


def search_texts(index: Index, word: np.ndarray, owner: np.ndarray, texts: int) -> list[tuple]:
    """(text, place of the item, cosine, share, share of the answer) of the items that texts hold.

    Of windows that overlap, the one that holds most is tried; the others add nothing to its surroundings.
    """
    edge = np.searchsorted(owner, np.arange(texts + 1)).tolist()
    tried: dict[tuple[int, int], list] = {}
    found: dict[tuple[int, int], tuple] = {}
    for text, k, cosine, _, a, b in sorted(candidates(index, word, owner, texts), key=lambda c: (-c[3], c)):
        seen = tried.setdefault((text, k), [])
        if (text, k) in found or any(a < y and x < b for x, y in seen):
            continue
        seen.append((a, b))
        item, own = index.items[k], word[edge[text] : edge[text + 1]]
        margin = max(len(item) // 2, len(item) - (b - a) // 2)  # the item may reach past the window
        region = own[max(0, a - margin) : b + margin]
        region = region.tolist()
        there = set(region)
        if sum(w in there for w in item) < PART * len(item):  # no common subsequence is longer than this
            continue
        ok, whole, part = contained(item, region)
        if ok:
            found[text, k] = (text, k, cosine, whole, part)
    return list(found.values())


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_share, answer_share`` for each document and item that it holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    df, n = frequencies(docs)
    idf = np.log(1 + n / (1 + df))
    groups = max(1, -(-passage_count(items) // GROUP_PASSAGES))
    kind = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    result = docs.sparkSession.createDataFrame([], kind)
    for group in range(groups):
        index = build_index(items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group), idf)
        if index is not None:
            result = result.union(docs.mapInArrow(_searcher(index), kind))
    return result


def _searcher(index: Index):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            rows = []
            for first, last in runs([len(t) for t in texts], CHUNK_BYTES):
                word, owner = split_words(texts[first:last])
                found = search_texts(index, word, owner, last - first) if len(word) else []
                rows += [(ids[first + t], index.ids[k], *rest) for t, k, *rest in found]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"],
            )

    return run
