"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

Every text becomes the set of its five-word shingles. The rarest shingles of a set come first; two sets
that reach the threshold share one of the first ``n - ceil(0.8 n) + 1``. Shingles that stand in one set
only can't be shared, so most texts have nothing left to share and drop out before any comparison.

1. Texts are dealt to blocks of bounded bytes by a hash of the id. A block sends each of its shingles once,
   as packed arrays by range of the hash; a range sums the frequencies and answers with the shared ones.
2. A block orders its sets by frequency and keeps, for sets that can still have a partner, the leading
   shared shingles, a bitmap of the set and the set. Equal sets are one class from here on.
3. Sets that lead with the same shingle and whose sizes lie in the same or neighbouring bands (a band spans
   a factor of 1/0.8) meet in a tile; large tiles are cut into pairs of blocks. In a tile the number of
   bits in which two bitmaps differ bounds the overlap from above.
4. What passes is intersected exactly. A tile of more than ``SMALL_TILE`` sets first proposes one partner
   per set; what is linked then counts as one component, in which nothing more is compared.
5. Near misses stay in different components however often they are compared, and a group of them has a
   square of pairs. So the last round writes no pairs of sets: a set's home is the commonest of its leading
   shingles, and a tile names the homes that have a pair between different components that passes the
   bitmaps. The sets of two such homes come together once and are intersected exactly; only links that join
   components are written. So no link between components is lost and no group writes all its pairs.

Cases: null and empty texts and texts of white space have no shingles and no links; texts of one to four
words have one shingle of the whole sequence; null ids form no links and are their own component (null);
rows that repeat an id are one document for links; ties go to the smaller id; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.blocks import (
    KEY_SHIFT, answered, discard, give_back, let_go, places, shared_frequencies, sliced, with_blocks,
)
from barograph.llm.graph import components
from barograph.llm.hashing import mix, runs, shingle_sets, signature
from barograph.sources.checkpoint import stored

BITMAP_WORDS = 16
SMALL_TILE = 4
TILE = 1_024
BUCKET_ROWS = 8_000
HOME_BYTES = 8 << 20  # sets of a home that come together; a larger home is cut into parts
CHUNK_BYTES = 1 << 20  # texts whose sets stand in memory at a time


def block_sets(table: pa.Table):
    """Per row of a block: id, set, signature, and whether it is the first row of its set in the block."""
    ids = table.column("doc_id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    texts = table.column("text").to_pylist()
    texts = [(texts[i] or "").encode("utf-8", "surrogatepass") for i in order]
    seen: set[bytes] = set()
    for a, b in runs([len(t) for t in texts], CHUNK_BYTES):
        for i, s in zip(order[a:b], shingle_sets(texts[a:b])):
            mark = signature(s)
            yield ids[i], s, mark, ids[i] is not None and len(s) > 0 and mark not in seen
            seen.add(mark)


def first_sets(table: pa.Table) -> list[np.ndarray]:
    """The different sets of a block."""
    return [s for _, s, _, first in block_sets(table) if first]


def bitmap(values: np.ndarray) -> bytes:
    """A bit of BITMAP_WORDS x 64 for each element."""
    bit = np.zeros(BITMAP_WORDS * 64, dtype=np.uint8)
    bit[(mix(values) % np.uint64(len(bit))).astype(np.int64)] = 1
    return np.packbits(bit).tobytes()


def leading_sets(base: DataFrame, shared: DataFrame) -> DataFrame:
    """One row per document; ``tokens, bits, items`` where the set can have a partner and is its block's first."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n", pa.int64()),
            ("sig", pa.binary()),
            ("tokens", pa.list_(pa.int64())),
            ("bits", pa.binary()),
            ("items", pa.binary()),
        ]
    )

    def lead(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, df = answered(right)
        rows = []
        for doc, s, mark, first in block_sets(left):
            tokens = None
            if first:
                known, at = places(keys, s >> KEY_SHIFT)
                known = np.flatnonzero(known)
                spare = len(s) - (4 * len(s) + 4) // 5 + 1 - (len(s) - len(known))
                if spare > 0:
                    tokens = s[known[np.argsort(df[at[known]], kind="stable")[:spare]]].astype(np.int64).tolist()
            if tokens:
                rows.append((doc, len(s), mark, tokens, bitmap(s), s.tobytes()))
            else:
                rows.append((doc, len(s), mark, None, None, None))
        del keys, df
        out = pa.table([list(c) for c in zip(*rows)], schema=schema) if rows else schema.empty_table()
        del rows
        give_back()
        return out

    return (
        base.groupBy("block")
        .cogroup(shared.groupBy("block"))
        .applyInArrow(lead, "doc_id long, n long, sig binary, tokens array<long>, bits binary, items binary")
    )


def ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, the smaller one first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def proposals(tiles: DataFrame, rows: int, everything: bool) -> DataFrame:
    """``a, b`` with a < b: pairs of different components whose bitmaps leave the threshold in reach.

    Unless ``everything`` is asked for, a set of a tile with more than SMALL_TILE sets proposes only the first
    set of the tile, in the order of sizes and ids, that passes: near copies propose the same one in all tiles.
    With ``everything`` the pairs are those of the homes of such sets, a <= b.
    """
    named = "home" if everything else "doc"
    columns = dict.fromkeys(("tile", "upper", "block", "single", "doc", "n", "component", "sets", named))
    buckets = 1 + rows // BUCKET_ROWS
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in columns}
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(-1, BITMAP_WORDS)
        order = np.lexsort((col["doc"], col["n"], col["tile"]))
        col = {c: v[order] for c, v in col.items()}
        bits = bits[order]
        start = np.flatnonzero(np.diff(col["tile"], prepend=col["tile"][0] - 1))
        size = np.diff(np.append(start, len(order)))
        first, place = np.repeat(start, size), np.arange(len(order)) - np.repeat(start, size)
        thrifty = (col["sets"] > SMALL_TILE) & (not everything)
        live = np.arange(len(order))
        found = []
        for p in range(int(size.max(initial=1)) - 1):
            live = live[place[live] > p]
            j = live
            i = first[j] + p
            ok = 5 * col["n"][i] >= 4 * col["n"][j]
            ok &= col["component"][i] != col["component"][j]
            ok &= col["upper"][i] | col["upper"][j]  # two sets of the lower band meet in their own tile
            ok &= col["single"][i] | (col["block"][i] != col["block"][j])
            i, j = i[ok], j[ok]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
            near = 9 * apart <= col["n"][i] + col["n"][j]
            i, j = i[near], j[near]
            found.append(ordered(col[named][i], col[named][j]))
            live = live[~np.isin(live, j[thrifty[j]], assume_unique=True)]
        if not found:
            return schema.empty_table()
        return pa.table(list(ordered(*(np.concatenate(c) for c in zip(*found)))), schema=schema)

    bucket = F.pmod(F.col("tile"), F.lit(buckets)).cast("int")
    return tiles.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def lay_tiles(posts: DataFrame) -> DataFrame:
    """Each set in the tile of its band and in the next one; large tiles as pairs of blocks."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("sets") / TILE)).cast("int")
    own = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    band = F.floor(F.log("n") / F.lit(float(np.log(1.25))) + 1e-9).cast("int")
    return (
        posts.withColumn("parts", parts)
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("step", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            F.xxhash64(
                "token", band + F.col("step"), F.least("block", "other"), F.greatest("block", "other")
            ).alias("tile"),
            (F.col("step") == 0).alias("upper"),
            "block",
            (F.col("block") == F.col("other")).alias("single"),
            "doc",
            "n",
            "component",
            "sets",
            "bits",
            *(c for c in posts.columns if c == "home"),
        )
    )


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, linked``: exact intersection of the sorted arrays."""

    def run(batches):
        for batch in sliced(batches):
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"]
            )

    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def homes_of(posts: DataFrame) -> DataFrame:
    """``doc, n, component, home``: the commonest of a set's leading shingles."""
    return posts.groupBy("doc").agg(
        F.first("n").alias("n"), F.first("component").alias("component"), F.max(F.struct("sets", "token")).alias("most")
    ).select("doc", "n", "component", F.col("most.token").alias("home"))


def settled(pairs: DataFrame, homes: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, linked``: links between components in the pairs of homes; in a task none that others imply."""
    parts = homes.groupBy("home").agg(
        F.greatest(F.ceil(F.sum("n") * 8 / HOME_BYTES), F.ceil(F.count("*") / TILE)).cast("int").alias("parts")
    )
    cells = (
        pairs.join(parts.select(F.col("home").alias("a"), F.col("parts").alias("of_a")), "a")
        .join(parts.select(F.col("home").alias("b"), F.col("parts").alias("of_b")), "b")
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("of_a") - 1)))
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("of_b") - 1)))
        .filter("a < b OR x <= y")
    )
    # 1 and 2 for the sides of a cell that are compared with each other, 3 for a part that is compared with itself
    side = lambda k, home, part, alone: F.struct(
        F.col(home).alias("home"), F.col(part).alias("part"), F.when(alone, 3).otherwise(k).alias("side")
    )
    alone = (F.col("a") == F.col("b")) & (F.col("x") == F.col("y"))
    sides = F.array_distinct(F.array(side(1, "a", "x", alone), side(2, "b", "y", alone)))
    cells = cells.select(F.xxhash64("a", "b", "x", "y").alias("cell"), F.inline(sides))
    members = homes.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    members = members.join(sets.select(F.col("doc_id").alias("doc"), "bits", "items"), "doc")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def settle(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ("doc", "n", "component", "side")}
        order = np.lexsort((col["doc"], col["n"]))
        doc, n, component, side = (v[order] for v in col.values())
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(-1, BITMAP_WORDS)[order]
        items = table.column("items").to_pylist()
        items = np.frombuffer(b"".join(items[k] for k in order.tolist()), "<u8")
        values, code = np.unique(items, return_inverse=True)
        code = np.split(code.astype(np.int32), np.cumsum(n)[:-1])
        here = np.zeros(len(values), dtype=bool)
        last = np.searchsorted(4 * n, 5 * n, side="right")
        found = []
        for i in range(len(n)):
            j = np.arange(i + 1, last[i])
            j = j[(component[j] != component[i]) & (side[j] | side[i] == 3)]
            j = j[9 * np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64) <= n[j] + n[i]]
            if not len(j):
                continue
            here[code[i]] = True
            both = np.add.reduceat(here[np.concatenate([code[k] for k in j])], np.cumsum(n[j]) - n[j], dtype=np.int64)
            here[code[i]] = False
            for k in j[100 * both >= 80 * (n[j] + n[i] - both)]:
                if component[k] != component[i]:
                    found.append((doc[i], doc[k], True))
                    component[component == component[k]] = component[i]
        return pa.table([list(c) for c in zip(*found)], schema=schema) if found else schema.empty_table()

    met = cells.join(members, ["home", "part"]).select("cell", "side", "doc", "n", "component", "bits", "items")
    return met.groupBy("cell").applyInArrow(settle, "a long, b long, linked boolean")


def link(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    spark = docs.sparkSession
    let_go(docs)
    base, blocks = with_blocks(docs)
    rows = stored(leading_sets(base, shared_frequencies(base, blocks, first_sets)), "sets")
    let_go(docs)
    classes = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("class"))
    sets = rows.filter("tokens IS NOT NULL").join(classes, "sig").filter("doc_id = class")
    sets = stored(sets.dropDuplicates(["doc_id"]).select("doc_id", "n", "tokens", "bits", "items"), "leading")
    posts = sets.select(F.col("doc_id").alias("doc"), "n", "bits", F.explode("tokens").alias("token"))
    many = posts.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1")
    posts = stored(posts.join(many, "token"), "posts")
    let_go(docs)
    largest = posts.agg(F.max("sets")).first()[0] or 0
    tested = spark.createDataFrame([], "a long, b long, linked boolean")
    found = spark.createDataFrame([], "node long, component long")
    for turn in ("first", "again", "rest") if largest > SMALL_TILE else ("first",):
        named = posts
        if turn != "first":
            named = posts.filter(F.col("sets") > SMALL_TILE)
        named = named.join(found.withColumnRenamed("node", "doc"), "doc", "left")
        named = named.withColumn("component", F.coalesce("component", "doc"))
        if turn != "first":
            mixed = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
            mixed = stored(mixed.filter("lo <> hi").select("token"), "mixed")
            if mixed.isEmpty():
                break
            named = named.join(mixed, "token", "left_semi")
        if turn == "rest":
            homes = stored(homes_of(named), "homes")
            named = named.join(homes.select("doc", "home"), "doc")
        tiles = stored(lay_tiles(named), "tiles")
        pairs = proposals(tiles, tiles.count(), turn == "rest")
        if turn == "rest":
            new = stored(settled(pairs, homes, sets), "tested")
            discard(homes)
        else:
            new = stored(verified(pairs.join(tested, ["a", "b"], "left_anti"), sets), "tested")
        discard(tiles)
        let_go(docs)
        if new.isEmpty():
            continue
        tested = tested.union(new)
        found = components(tested.filter("linked").select("a", "b"))
    discard(sets, posts)
    let_go(docs)
    labelled = rows.join(classes, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("node")
    )
    return labelled.join(found, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"),
    )
