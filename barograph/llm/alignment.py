"""Alignment of two tokenizers: where their tokens end together, which tokens overlap, and how often.

A slice of texts is encoded by both tokenizers into Arrow lists; everything after that is Arrow. Lists are
flattened with parent indices, the token lengths are summed up within each document, and the two tables of
token ends meet in an Acero full outer hash join on the key (document, end). A sorted row of that join is a
stretch of bytes without an end inside, so, with gaps filled from behind, it is exactly one pair of tokens
that overlap; rows with both sides close a group.

Each slice counts its pairs with ``Table.group_by``, and Spark adds up the partial counts. A block of
documents asks for the corpus-wide counts of its distinct pairs, each once, and gets them back by a join on
the pair; a pair is asked for at most once a block, however common it is. The documents' own pairs, distinct
and with their multiplicity, are written to the shared folder, so texts are encoded once.

Encoding uses the merges' own order as ranks where the vocabulary file allows it (token ids follow the
merges), which gives the same tokens as the file's library; otherwise that library.

Cases: texts that are null, empty or not reproduced byte by byte by both tokenizers have no tokens, zero
counts and an empty digest; special tokens in a text are plain text; a null id stays null; repeated rows
are counted and returned as often as they stand there; long texts are slices of their own; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barograph.llm.bpe import byte_alphabet
from barograph.sources.checkpoint import stored

SLICE_BYTES = 1 << 18
BLOCK_BYTES = 8 << 20
SPACE_MARK = "▁"


class Encoder:
    """Ids of whole texts as Arrow lists, and the bytes of each id."""

    def __init__(self, encode, token_bytes: list[bytes]):
        self.encode = encode
        self.bytes = pa.array(token_bytes, pa.large_binary())
        self.sizes = pc.cast(pc.binary_length(self.bytes), pa.int64())
        self.names = pa.array([str(i) for i in range(len(token_bytes))], pa.large_string())

    def lists(self, texts: list[str]) -> pa.LargeListArray:
        return pa.array(self.encode(texts), pa.large_list(pa.int32()))


@lru_cache(maxsize=1)
def byte_encoder(path: str) -> Encoder:
    """Byte-level BPE file; one per Python worker."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    special = {i: t.content for i, t in Tokenizer.from_file(path).get_added_tokens_decoder().items()}
    count = 1 + max(max(model["vocab"].values()), *special)
    token = [b""] * count
    for t, i in model["vocab"].items():
        token[i] = t.encode() if i in special else bytes(byte[c] for c in t)
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [model["vocab"][t] for t in merged] == list(range(256, 256 + len(merged))):
        ranks = {t: i for i, t in enumerate(token) if i not in special}
        own = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Encoder(lambda texts: [own.encode_ordinary(t) for t in texts], token)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    return Encoder(lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)], token)


@lru_cache(maxsize=1)
def piece_encoder(path: str) -> Encoder:
    """Sentence-piece file; one per Python worker."""
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    token = [
        bytes([int(p[1:-1], 16)]) if own.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)
    ]
    return Encoder(lambda texts: own.encode(texts, num_threads=1), token)


def spans(encoder: Encoder, lists: pa.LargeListArray) -> tuple[pa.Table, np.ndarray, bytes]:
    """Tokens with their document and end, where each document starts among all bytes, and all bytes."""
    doc, ids = pc.list_parent_indices(lists), pc.list_flatten(lists)
    running = np.concatenate([[0], pc.cumulative_sum(encoder.sizes.take(ids)).to_numpy()])
    begin = running[lists.offsets.to_numpy()]
    end = pc.subtract(pa.array(running[1:]), pa.array(begin[:-1]).take(doc))
    joined = encoder.bytes.take(ids)
    return pa.table({"doc": doc, "end": end, "id": ids}), begin, joined.buffers()[2].to_pybytes() if len(ids) else b""


def reproduced(begin: np.ndarray, joined: bytes, texts: list[bytes]) -> np.ndarray:
    return np.array([joined[a:b] == t for a, b, t in zip(begin[:-1].tolist(), begin[1:].tolist(), texts)], dtype=bool)


def group_texts(encoder: Encoder, tokens: pa.Table, last: pa.Array) -> pa.Array:
    """Ids of each group joined by commas; ``last`` is the place of each group's last token."""
    offsets = pa.array(np.concatenate([[0], last.to_numpy() + 1]))
    named = encoder.names.take(tokens.column("id").combine_chunks())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, named), pa.scalar(",", pa.large_string()))


DOC = "block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
DOC_SCHEMA = pa.schema(
    [("block", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64())]
    + [("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
    + [("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)


def alignments(block: str, ids: pa.Array, texts: list[str], first: Encoder, second: Encoder) -> pa.RecordBatch:
    """One row a document: token, group and link counts, digest of the groups, distinct pairs and how often."""
    rows = len(texts)
    have = np.flatnonzero([bool(t) for t in texts])
    spaced = [" " + texts[k] for k in have]
    a_lists, b_lists = first.lists(spaced), second.lists([texts[k] for k in have])
    a, a_begin, a_bytes = spans(first, a_lists)
    b, b_begin, b_bytes = spans(second, b_lists)
    wanted = [t.encode() for t in spaced]
    same = reproduced(a_begin, a_bytes, wanted) & reproduced(b_begin, b_bytes, wanted)
    if not same.all():
        have = have[same]
        a_lists, b_lists = a_lists.filter(pa.array(same)), b_lists.filter(pa.array(same))
        (a, _, _), (b, _, _) = spans(first, a_lists), spans(second, b_lists)
    docs = len(have)

    def ended(tokens: pa.Table, name: str) -> pa.Table:
        key = pc.add(pc.shift_left(tokens.column("doc"), 40), tokens.column("end"))
        return pa.table({"key": key, name: tokens.column("id"), f"{name}_at": pa.array(np.arange(len(key)))})

    met = ended(a, "a").join(ended(b, "b"), "key", join_type="full outer", use_threads=False)
    met = met.take(pc.sort_indices(met.column("key"))).combine_chunks()
    both = pc.and_(pc.is_valid(met.column("a")), pc.is_valid(met.column("b")))
    doc = pc.shift_right(met.column("key"), 40)
    closing = met.filter(both)
    n_links = np.bincount(doc.to_numpy(), minlength=docs)
    n_groups = np.bincount(doc.filter(both).to_numpy(), minlength=docs)
    sides = [group_texts(e, t, closing.column(f"{c}_at").combine_chunks()) for e, t, c in ((first, a, "a"), (second, b, "b"))]
    groups = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
    whole = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)])), groups)
    digests = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in pc.binary_join(whole, pa.scalar(";", pa.large_string()))]

    of_a, of_b = (pc.cast(pc.fill_null_backward(met.column(c)), pa.int64()) for c in ("a", "b"))
    pair = pc.add(pc.multiply(of_a, len(second.sizes)), of_b)
    counted = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    counted = counted.sort_by([("doc", "ascending"), ("pair", "ascending")])
    distinct = np.bincount(counted.column("doc").to_numpy(), minlength=docs)

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(rows, dtype=np.int64)
        out[have] = values
        return out

    digest = np.full(rows, "", dtype=object)
    digest[have] = digests
    offsets = pa.array(np.concatenate([[0], np.cumsum(spread(distinct))]).astype(np.int32))
    columns = [pa.array([block] * rows), ids]
    columns += [pa.array(spread(c)) for c in (np.diff(a_lists.offsets.to_numpy()), np.diff(b_lists.offsets.to_numpy()), n_groups, n_links)]
    columns += [pa.array(digest, pa.string())]
    columns += [pa.ListArray.from_arrays(offsets, counted.column(c).combine_chunks()) for c in ("pair", "count_all")]
    return pa.RecordBatch.from_arrays(columns, schema=DOC_SCHEMA)


def aligned(byte_path: str, piece_path: str):
    def run(batches):
        first, second = byte_encoder(byte_path), piece_encoder(piece_path)
        block, filled = uuid.uuid4().hex, 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            size = np.cumsum([len(t) for t in texts])
            start = 0
            while start < len(texts):
                before = size[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
                if filled > BLOCK_BYTES:
                    block, filled = uuid.uuid4().hex, 0
                filled += int(size[stop - 1] - before)
                yield alignments(block, batch.column(0).slice(start, stop - start), texts[start:stop], first, second)
                start = stop

    return run


def partial_counts(batches):
    """Links of each pair in the documents of a block, as far as they stand in one Arrow batch."""
    for batch in batches:
        pairs = batch.column("pairs")
        block = batch.column("block").take(pc.list_parent_indices(pairs))
        table = pa.table({"block": block, "pair": pc.list_flatten(pairs), "n": pc.list_flatten(batch.column("times"))})
        counted = table.group_by(["block", "pair"], use_threads=False).aggregate([("n", "sum")])
        yield from counted.rename_columns(["block", "pair", "n"]).combine_chunks().to_batches()


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
RESULT_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    + [("groups_sha256", pa.string())]
)


def weighed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums of corpus-wide counts over the links of each document of a block."""
    docs = docs.combine_chunks()
    pairs = docs.column("pairs").combine_chunks()
    times = pc.list_flatten(docs.column("times").combine_chunks())
    counts = counts.combine_chunks()
    place = pc.index_in(pc.list_flatten(pairs), counts.column("pair").combine_chunks())
    table = pa.table(
        {
            "doc": pc.list_parent_indices(pairs),
            "sum": pc.multiply(times, counts.column("n").take(place)),
            "best": pc.multiply(times, pc.cast(counts.column("best").take(place), pa.int64())),
        }
    )
    total = table.group_by("doc", use_threads=False).aggregate([("sum", "sum"), ("best", "sum")])
    at = total.column("doc").to_numpy()
    out = {"best": np.zeros(docs.num_rows, np.int64), "sum": np.zeros(docs.num_rows, np.int64)}
    for c, values in out.items():
        values[at] = total.column(f"{c}_sum").to_numpy()
    columns = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    columns += [pa.array(out["best"]), pa.array(out["sum"]), docs.column("groups_sha256")]
    return pa.table(columns, schema=RESULT_SCHEMA)


def pair_counts(partial: DataFrame, pieces: int) -> DataFrame:
    """``pair, n, best``: corpus-wide links of each pair; ``best`` where no pair of its piece has more.

    A piece has at most as many pairs as the other tokenizer has ids, so its window is bounded.
    """
    counts = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair") % pieces))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of whole texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = DOC + "pairs array<long>, times array<long>"
    own = stored(texts.mapInArrow(aligned(byte_path, piece_path), schema), "alignments")
    partial = own.select("block", "pairs", "times").mapInArrow(partial_counts, "block string, pair long, n long")
    partial = stored(partial, "pairs")
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    counts = pair_counts(partial, pieces)
    answers = partial.select("block", "pair").distinct().join(counts, "pair").select("block", "pair", "n", "best")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(weighed, RESULT)
