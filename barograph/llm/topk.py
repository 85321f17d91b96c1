"""Exact top-k by inner product with pivot-table elimination.

With d the Euclidean distance, q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2. Every row stores its distances to
the pivots; the largest |d(q, p) - d(x, p)| bounds d(q, x) from below and so q.x from above. A query looks
at candidates in the order of that bound (ties by id) and stops at the first that can't enter its top k.
Bounds are rounded after a slack far above the rounding error, so the result is exact.

Queries and rows are dealt to blocks of bounded size by a hash of the id, and every block of queries meets
every block of rows: a stated query set against all rows, in blocks. A pair of blocks gives k rows per
query at most; a window keeps the best k of all blocks. No value of the data decides where a row goes, so
many equal vectors do no harm. Pivots are chosen among a sample of ``PIVOT_SAMPLE`` rows; the pivot table
covers every row.

Cases: rows with a null id, a null vector, or a null or non-finite component take no part; of vectors of
different lengths the shorter counts as ending in zeros; repeated rows count once; rows with the query's
id are its own; fewer rows than k give all of them; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2_048
ROW_BLOCK = 8_192
PIVOTS = 24
PIVOT_SAMPLE = 1_024
STEP = 256


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, v``: components as floor(scale * x), unusable rows left out."""
    x = F.col(vector_col)
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return df.filter(F.col(id_col).isNotNull() & x.isNotNull() & usable).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v"),
    )


def choose_pivots(sample: list[list[int]], count: int) -> np.ndarray:
    """Rows far apart: each next pivot is the row farthest from those chosen."""
    if not sample:
        return np.zeros((0, 0))
    rows = padded(sample, max(map(len, sample)))
    far, chosen = np.full(len(rows), np.inf), [0]
    for _ in range(min(count, len(rows)) - 1):
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(far.argmax()))
    return rows[chosen]


def padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def with_pivot_distances(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, v, near``: the vector as 64-bit integers and its distances to the pivots as doubles."""

    def run(batches):
        for b in batches:
            vs = [np.array(v, dtype="<i8") for v in b.column(1).to_pylist()]
            width = max([pivots.shape[1], *map(len, vs)])
            own = padded(vs, width)
            table = padded(list(pivots), width)
            near = np.stack([np.sqrt(((own - p) ** 2).sum(1)) for p in table], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([v.tobytes() for v in vs], pa.binary()),
                    pa.array([n.tobytes() for n in near], pa.binary()),
                ],
                ["id", "v", "near"],
            )

    return vectors.mapInArrow(run, "id long, v binary, near binary")


class Side:
    """A block: distinct rows in the order of their ids."""

    def __init__(self, table: pa.Table):
        rows = sorted(set(zip(*(table.column(c).to_pylist() for c in ("id", "v", "near")))))
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.vectors = [np.frombuffer(r[1], dtype="<i8") for r in rows]
        self.near = np.array([np.frombuffer(r[2], dtype="<f8") for r in rows]).reshape(len(rows), -1)
        self.width = max([0, *map(len, self.vectors)])

    def matrix(self, width: int) -> np.ndarray:
        out = np.zeros((len(self.vectors), width), dtype=np.int64)
        for i, v in enumerate(self.vectors):
            out[i, : len(v)] = v
        return out


def search(queries: Side, rows: Side, k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of the best k rows of the block for each query."""
    width = max(queries.width, rows.width)
    q, x = queries.matrix(width), rows.matrix(width)
    q_norm, x_norm = ((m.astype(np.float64) ** 2).sum(1) for m in (q, x))
    if max(q_norm.max(), x_norm.max()) < 2.0**52:  # doubles hold every product and sum exactly
        q, x = q.astype(np.float64), x.astype(np.float64)
    slack = 1e-9 * (q_norm.max() + x_norm.max()) + 1e-6
    out = []
    for i, own in enumerate(queries.ids.tolist()):
        apart = np.abs(rows.near - queries.near[i]).max(1)
        bound = np.floor((q_norm[i] + x_norm - apart**2) / 2 + slack)
        order = np.argsort(-bound, kind="stable")
        order = order[rows.ids[order] != own]
        best: list[tuple[int, int]] = []  # (-score, id)
        for at in range(0, len(order), STEP):
            if len(best) == k and (-bound[order[at]], rows.ids[order[at]]) > best[-1]:
                break
            part = order[at : at + STEP]
            score = (x[part] @ q[i]).astype(np.int64)
            if len(best) == k:
                keep = score >= -best[-1][0]
                part, score = part[keep], score[keep]
            elif len(score) > k:
                floor = np.partition(score, -k)[-k]
                part, score = part[score >= floor], score[score >= floor]
            top = np.lexsort((rows.ids[part], -score))[:k]
            best = sorted(best + list(zip((-score[top]).tolist(), rows.ids[part[top]].tolist())))[:k]
        out += [(own, row, -minus) for minus, row in best]
    return out


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score``; ``is_query`` is a condition on the column ``id``."""
    vectors = whole_vectors(df, id_col, vector_col, scale)
    n, m = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()
    table = with_pivot_distances(vectors, choose_pivots([r["v"] for r in sample], PIVOTS))
    query_blocks, row_blocks = max(1, -(-m // QUERY_BLOCK)), max(1, -(-n // ROW_BLOCK))

    def block(of: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")

    def every(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    queries = table.filter(is_query).select("*", block(query_blocks).alias("qb"), every(row_blocks).alias("rb"))
    rows = table.select("*", block(row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        found = search(Side(left), Side(right), k)
        return pa.table([pa.array(c, pa.int64()) for c in zip(*found)] if found else [[], [], []], schema=schema)

    best = (
        queries.groupBy("qb", "rb")
        .cogroup(rows.groupBy("qb", "rb"))
        .applyInArrow(meet, "query_id long, vec_id long, score long")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", place.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
