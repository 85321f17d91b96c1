"""Connected components of an edge table: contraction in bounded parts, then alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.sources.checkpoint import stored


EDGES_PER_PART = 200_000


def contracted(batches):
    """The edges of a part as stars: each node with the smallest node that the part's edges link it to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(a, a)
            root.setdefault(b, b)
            low, high = sorted((find(a), find(b)))
            root[high] = low
    linked = [(x, find(x)) for x in root]
    nodes, roots = zip(*((x, r) for x, r in linked if x != r)) if any(x != r for x, r in linked) else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest one: the larger neighbours, or the smaller."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.withColumn("least", F.least("a", "least"))
    linked = both.join(least, "a")
    if large:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes of ``a, b``; the component is its smallest node.

    Parts of about EDGES_PER_PART edges become stars by themselves. Where there are several parts, rounds of
    stars follow, each written to the shared folder, until one changes nothing. No neighbour list is ever
    gathered: a node's minimum is an aggregate, joined back.
    """
    parts = 1 + edges.count() // EDGES_PER_PART
    now = stored(edges.select("a", "b").coalesce(parts).mapInArrow(contracted, "a long, b long"), "edges")
    before = None
    while parts > 1:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        now = stored(star(star(now, large=True), large=False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
