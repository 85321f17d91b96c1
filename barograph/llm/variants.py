"""Spelling variants: words that differ by one code point, and the common form each rare one belongs to.

Two words of n and n or n + 1 code points that are one edit apart share a prefix or a suffix of half their
length. So each word is listed under its halves (``band``: the shorter length of the pairs looked for), and
every list is sorted by what is left of the words. A list is scanned for all its words at once: the edit
matrix between a word and the list has three cells a row around the diagonal, a row belongs to a prefix of
the list and is handed on to the whole range of neighbours whose common prefix (LCP) is that long, and a
range ends as soon as all three cells exceed one edit. Rows are kept as numpy columns, one depth at a time.

Lists of more than ``LIST_WORDS`` words are halved again, and again until none is left or one or two free
code points remain. A pair that shares the prefix isn't looked for under the suffix, so each pair is found
in one list.

Counting is native: runs, their deletions and the number of occurrences are one hash aggregation, so a very
frequent word is a number before it is shuffled. Roots follow forms by doubling; a form is ten times as
frequent as its word, which bounds the rounds.

Cases: null or empty texts have no runs; a null id counts as the empty text in front of the colon; rows
that repeat count as often as they stand there; ties of the form go to the smaller word; words of any length
are taken whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.functions.windows import stack
from barograph.sources.checkpoint import stored

MIN_LENGTH = 7
MIN_COUNT = 2
DELETE_EVERY = 31
RATIO = 10
LIST_WORDS = 20_000
CHUNK_ROWS = 40_000
QUERY_ROWS = 10_000
FAR = 2  # more edits than one


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: runs of letters in lower case, some with a code point deleted, and their occurrences."""
    # a greedy run of at least min_length letters starts where the maximal run starts
    runs = F.regexp_extract_all("text", F.lit(f"([A-Za-zÀ-ÿ]{{{min_length},}})"), F.lit(1))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    found = docs.select(doc, F.explode(runs).alias("run"))
    found = found.select("doc", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    cut = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.expr("substring(run, 1, cut)"), F.expr("substring(run, cut + 2)"))
    word = F.when(F.col("h") % DELETE_EVERY == 0, shorter).otherwise(F.col("run"))
    words = found.withColumn("cut", cut).select(word.alias("word")).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def halved(rows: DataFrame) -> DataFrame:
    """Each row under a longer prefix and under a longer suffix: ``band, head, tail, cap, key``.

    Pairs of a list share ``head`` code points in front and ``tail`` at the end; those that share ``cap``
    code points in front belong to another list.
    """
    half = F.expr("int((band - head - tail) / 2)")
    front = F.struct((F.col("head") + half).alias("head"), F.col("tail"), F.col("cap"))
    back = F.struct(F.col("head"), (F.col("tail") + half).alias("tail"), F.least("cap", F.col("head") + half).alias("cap"))
    rows = rows.withColumn("side", F.explode(F.array(front, back)))
    rows = rows.select("word", "n", "band", "side.head", "side.tail", "side.cap")
    rows = rows.filter("cap > head")  # else all pairs of the list share cap code points in front
    fixed = F.concat(F.expr("substring(word, 1, head)"), F.lit("|"), F.expr("substring(word, length(word) - tail + 1)"))
    return rows.withColumn("key", F.concat_ws(" ", "band", "head", "tail", "cap", fixed))


def lists(words: DataFrame) -> DataFrame:
    """Rows of all lists, none longer than LIST_WORDS while it can be halved."""
    size = F.length("word")
    bands = F.when(size > MIN_LENGTH, F.array(size, size - 1)).otherwise(F.array(size))
    rows = words.select("word", "n", F.explode(bands).alias("band"))
    rows = rows.select("*", F.lit(0).alias("head"), F.lit(0).alias("tail"), F.expr("band + 2").alias("cap"))
    done = []
    while True:
        rows = halved(rows)
        counts = rows.groupBy("key").agg(F.count("*").alias("size"), F.first(F.expr("band - head - tail")).alias("free"))
        hot = stored(counts.filter((F.col("size") > LIST_WORDS) & (F.col("free") > 1)).select("key"), "long_lists")
        if hot.isEmpty():
            return stack(*done, rows)
        done.append(rows.join(hot, "key", "left_anti").select(*rows.columns))
        rows = stored(rows.join(hot, "key", "left_semi").drop("key"), "long_rows")


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each code point of all words (they end at U+00FF), and where each word starts."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    lead = data == 0xC3
    second = np.zeros(len(data), dtype=bool)
    second[1:] = lead[:-1]
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lead, out=before[1:])
    place = at - at[0]
    return np.where(second, data + np.uint8(0x40), data)[~lead], place - before[place]


def common_prefixes(data: np.ndarray, start: np.ndarray, size: np.ndarray, new: np.ndarray) -> np.ndarray:
    """LCP of each row with the row above; -1 where a list begins."""
    lcp = np.where(new, -1, 0)
    live = np.flatnonzero(~new)
    depth = 0
    while len(live):
        live = live[(size[live] > depth) & (size[live - 1] > depth)]
        live = live[data[start[live] + depth] == data[start[live - 1] + depth]]
        depth += 1
        lcp[live] = depth
    return lcp


def scan(data, start, size, lcp, skip, queries) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of one list that are exactly one edit apart.

    ``data[start : start + size]`` is what is left of a row, sorted within its list; a pair that is equal in
    its first ``skip`` code points is left out.
    """
    q = queries
    rows = len(size)
    first = np.flatnonzero(lcp < 0)
    run = np.searchsorted(first, q, side="right") - 1  # the range of depth 0 is the whole list
    edge = first
    # cells of the rows and columns (depth, depth - 1), (depth, depth), (depth, depth + 1)
    low = np.full(len(q), FAR, dtype=np.int8)
    mid = np.zeros(len(q), dtype=np.int8)
    high = np.where(size[q] > 0, 1, FAR).astype(np.int8)
    alive = np.arange(rows)
    left, right = [], []
    depth = 0
    ended = np.zeros(0, dtype=np.int64)

    def letter(of, place):
        known = size[of] > place
        return np.where(known, data[np.where(known, start[of] + place, 0)], 0)

    # a row that ends at depth 0 is one edit from rows of one code point
    empty = size[edge[run]] == 0
    hit = empty & (high <= 1) & (size[q] == 1)
    left.append(q[hit])
    right.append(edge[run][hit])
    while len(q):
        upto = np.append(edge, rows)[run + 1]
        begin = edge[run]
        alive = alive[size[alive] > depth]
        edge = alive[lcp[alive] <= depth]
        a, b = np.searchsorted(edge, begin), np.searchsorted(edge, upto)
        count = b - a
        old = np.repeat(np.arange(len(q)), count)
        run = np.arange(len(old)) - np.repeat(np.cumsum(count) - count, count) + a[old]
        child, q = edge[run], q[old]
        c = data[start[child] + depth]
        own_low, own_mid, own_high = low[old], mid[old], high[old]
        before = letter(q, depth - 1) if depth else np.zeros(len(q), np.uint8)
        low = np.minimum(own_mid + 1, own_low + (c != before))
        mid = np.minimum(np.minimum(own_high + 1, low + 1), own_mid + (c != letter(q, depth)))
        high = np.minimum(mid + 1, own_high + (c != letter(q, depth + 1)))
        wide = size[q] - depth
        low = np.where(wide < 0, FAR, np.minimum(low, FAR)).astype(np.int8)
        mid = np.where(wide < 1, FAR, np.minimum(mid, FAR)).astype(np.int8)
        high = np.where(wide < 2, FAR, np.minimum(high, FAR)).astype(np.int8)
        depth += 1
        keep = (np.minimum(np.minimum(low, mid), high) < FAR) & ~((mid == 0) & (skip[q] == depth))
        q, run, child, low, mid, high = (x[keep] for x in (q, run, child, low, mid, high))
        ended = size[child] == depth
        gap = size[q] - depth
        cell = np.where(gap == 0, mid, np.where(gap == -1, low, np.where(gap == 1, high, FAR)))
        hit = ended & (cell == 1)
        left.append(q[hit])
        right.append(child[hit])
    return np.concatenate(left), np.concatenate(right)


NEAR = "word string, near long, best_n long, best string"
NEAR_SCHEMA = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def neighbours(table: pa.Table) -> pa.RecordBatch:
    """For every word of some whole lists the number of near words in its list and the most frequent of them."""
    table = table.combine_chunks()
    word = table.column("word").combine_chunks() if isinstance(table.column("word"), pa.ChunkedArray) else table.column("word")
    n, band, head, tail, cap = (table.column(c).to_numpy() for c in ("n", "band", "head", "tail", "cap"))
    data, place = letters(word)
    full = np.diff(place)
    start, size = place[:-1] + head, full - head - tail
    key = table.column("key").to_numpy(zero_copy_only=False)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    lcp = common_prefixes(data, start, size, new)
    asking = np.flatnonzero(full == band)
    pairs = [scan(data, start, size, lcp, cap - head, asking[a : a + QUERY_ROWS]) for a in range(0, len(asking), QUERY_ROWS)]
    if not pairs:
        return NEAR_SCHEMA.empty_table().to_batches()
    q, v = (np.concatenate(side) for side in zip(*pairs))
    longer = full[v] > band[v]  # rows of the longer length don't ask themselves
    q, v = np.concatenate([q, v[longer]]), np.concatenate([v, q[longer]])
    rank = np.empty(len(key), dtype=np.int64)
    rank[pc.sort_indices(word.cast(pa.binary())).to_numpy()] = np.arange(len(key))
    order = np.lexsort((rank[v], -n[v], q))
    q, v = q[order], v[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    count = np.diff(np.append(first, len(q)))
    columns = [word.take(pa.array(q[first])), pa.array(count), pa.array(n[v[first]]), word.take(pa.array(v[first]))]
    return pa.table(columns, schema=NEAR_SCHEMA).to_batches()


def scanned(batches):
    """Whole lists of a sorted partition, about CHUNK_ROWS rows at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        last = table.column("key")[-1]
        whole = pc.index(table.column("key"), last).as_py()  # the last list may go on
        if whole:
            yield from neighbours(table.slice(0, whole))
        held = table.slice(whole).combine_chunks().to_batches()
        rows = sum(b.num_rows for b in held) if whole else 0
    if held:
        yield from neighbours(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, best_n, best``: up to two rows a word for each list that holds near words of it."""
    left = F.expr("substring(word, head + 1, length(word) - head - tail)")
    rows = lists(words).repartition("key").sortWithinPartitions("key", left)
    return rows.select("key", "word", "n", "band", "head", "tail", "cap").mapInArrow(scanned, NEAR)


def rooted(forms: DataFrame, most: int) -> DataFrame:
    """``word, root`` of the words that have a form; ``most`` is the largest number of occurrences."""
    links = forms.select("word", F.col("form").alias("root"))
    steps = 1 + int(math.log(max(most, 1)) / math.log(RATIO))  # each step multiplies the occurrences by RATIO
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        links = stored(
            links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots"
        )
    return links


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words with their occurrences and near words."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    words = stored(vocabulary(texts), "words")
    own = words.select("word", "n", *[F.lit(None).cast(t).alias(c) for c, t in (("near", "long"), ("best_n", "long"), ("best", "string"))])
    near = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "near", "best_n", "best")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    known = stack(own, near).groupBy("word").agg(
        F.max("n").alias("n"), F.coalesce(F.sum("near"), F.lit(0)).alias("n_near"), best.alias("b")
    )
    common = -F.col("b.m") >= RATIO * F.col("n")
    known = stored(
        known.select(
            "word",
            F.when(common, F.col("b.w")).alias("form"),
            "n",
            "n_near",
            F.when(common, -F.col("b.m")).alias("form_n"),
        ),
        "forms",
    )
    most = known.agg(F.max("n")).first()[0] or 1
    roots = rooted(known.filter("form is not null"), most)
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
