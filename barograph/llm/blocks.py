"""Blocks of texts and the keys that blocks share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.hashing import pack, unpack

# the C library's way to return freed memory, where it has one
trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

BLOCK_BYTES = 6 << 20
KEY_SHIFT = np.uint64(16)  # frequencies are counted on the upper 48 bits of a key


def give_back() -> None:
    """Free memory of this worker goes back to the machine: workers are kept and serve later stages."""
    pa.default_memory_pool().release_unused()
    if trim is not None:
        trim(0)


def sliced(batches, rows: int = 1_024):
    """Smaller Arrow batches, so that few rows stand in Python's memory at a time; none is kept at the end."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)
    b = None
    give_back()


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again."""
    for df in tables:
        files = df.inputFiles()
        if files:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def let_go(df: DataFrame) -> None:
    """Shuffle files of finished jobs go when the driver's collectors find that nothing refers to them.

    Tables that Python functions refer to are in cycles, so Python's collector comes first.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def with_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, text, block`` and the number of blocks, so that a block has about BLOCK_BYTES."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    return texts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")), blocks


def shared_frequencies(base: DataFrame, blocks: int, sets_of: Callable[[pa.Table], list[np.ndarray]]) -> DataFrame:
    """``part, block, keys, df``: for every block those of its keys that occur in two sets or more.

    ``sets_of`` gives the sets of distinct 64-bit keys of a block. A block sends each of its keys once, by
    range of the key; a range adds up the counts and answers the blocks. However common a key is, a range
    gets it once from a block.
    """
    sent = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("df", pa.binary())])

    def send(table: pa.Table) -> pa.Table:
        sets = [s for s in sets_of(table) if len(s)]
        if not sets:
            return sent.empty_table()
        keys, count = np.unique(np.concatenate(sets) >> KEY_SHIFT, return_counts=True)
        count = np.minimum(count, 65_535).astype("<u2")
        edge = np.searchsorted((keys >> np.uint64(16)) * np.uint64(blocks) >> np.uint64(32), np.arange(blocks + 1))
        block = table.column("block")[0].as_py()
        rows = [
            (p, block, pack(keys[a:b]), count[a:b].tobytes())
            for p, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist()))
            if b > a
        ]
        del sets, keys, count
        give_back()
        return pa.table([list(c) for c in zip(*rows)], schema=sent)

    def answer(table: pa.Table) -> pa.Table:
        own = [unpack(k) for k in table.column("keys").to_pylist()]
        keys = np.concatenate(own)
        count = np.concatenate([np.frombuffer(c, "<u2") for c in table.column("df").to_pylist()]).astype(np.int64)
        order = np.argsort(keys)
        first = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] ^ np.uint64(1)))
        total = np.add.reduceat(count[order], first)
        df = np.empty(len(keys), dtype=np.int64)
        df[order] = np.repeat(total, np.diff(first, append=len(keys)))
        df = np.minimum(df, (1 << 32) - 1)
        rows, at = [], 0
        part = table.column("part")[0].as_py()
        for block, k in zip(table.column("block").to_pylist(), own):
            d = df[at : at + len(k)]
            at += len(k)
            if (d > 1).any():
                rows.append((part, block, pack(k[d > 1]), d[d > 1].astype("<u4").tobytes()))
        return pa.table([list(c) for c in zip(*rows)], schema=sent) if rows else sent.empty_table()

    kind = "part int, block int, keys binary, df binary"
    return base.groupBy("block").applyInArrow(send, kind).groupBy("part").applyInArrow(answer, kind)


def answered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shared keys of a block and their frequencies."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "keys", "df"))))
    keys = np.concatenate([np.zeros(0, np.uint64)] + [unpack(k) for _, k, _ in rows])
    return keys, np.concatenate([np.zeros(0, "<u4")] + [np.frombuffer(d, "<u4") for _, _, d in rows])


def places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` stand in the sorted ``keys``, and where."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at
