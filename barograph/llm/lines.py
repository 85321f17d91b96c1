"""Line dedup with a log-template tree.

A line is parsed as in a tree of fixed depth: first its number of tokens, then its ``DEPTH`` leading tokens.
Tokens with a digit count as variable fields. In a leaf, lines join the template with which they agree in
the largest share of places, if that is at least ``SIMILARITY``; places in which they differ become
variable. A template that occurs in ``MIN_DOCS`` documents or more, or in ``LONG_DOCS`` if ``LONG_TOKENS`` of its
tokens or more aren't variable, is boilerplate: it stays in the document with the smallest id and is dropped
from all others. Lines of fewer than ``MIN_TOKENS`` tokens are templates
of their own, so short lines are dropped only where they recur as they are (fields apart).

Work moves as hashes: one row per document and distinct line, without text. Only leaves that hold several
different lines and enough of them to recur are parsed further, and only for their distinct lines. A leaf
with very many distinct lines is parsed in parts first. Then all its templates, also those of one line, meet by
segments of their places: places beyond the leading tokens are cut into one segment more than the number of
places that may differ, so all lines of one template agree in a segment and are parsed together there. Here a
line may belong to several templates and goes if one of them recurs. A group then holds the templates of a leaf
with one segment in common. Counts of documents are exact and cover every row.

Cases: null text stays null with no lines; blank lines are always kept; rows with a null id are neither
counted nor changed; rows that repeat an id count as one document; ties go to the smaller id; an empty table
gives an empty table; other columns pass through ``drop_lines`` unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barograph.functions.windows import stack
from barograph.llm.blocks import sliced
from barograph.sources.checkpoint import stored

DEPTH = 3
SIMILARITY = 0.8
MIN_TOKENS = 5
MIN_DOCS = 3
LONG_TOKENS, LONG_DOCS = 12, 2
LEAF_LINES = 4_000
BUCKET_LINES = 20_000
FIELD = "<*>"
has_digit = re.compile(r"\d").search


def parsed(line: str) -> list[str]:
    """Tokens of a line, those with a digit as variable fields."""
    tokens = line.split()
    return [FIELD if has_digit(t) else t for t in tokens] if has_digit(line) else tokens


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_hash(tokens: list[str]) -> int:
    return signed(xxhash.xxh3_64_intdigest("\x1f".join(tokens).encode("utf-8", "surrogatepass")))


def is_long(tokens: list[str]) -> bool:
    return len(tokens) - tokens.count(FIELD) >= LONG_TOKENS


def enough(count: str, long: Column) -> Column:
    return F.col(count) >= F.when(long, LONG_DOCS).otherwise(MIN_DOCS)


def leaf_hash(tokens: list[str]) -> int:
    return line_hash([str(len(tokens)), *tokens[:DEPTH]])


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, line, leaf, long`` of every distinct non-blank line of a document; leaf is null for short lines."""

    def run(batches):
        for b in sliced(batches):
            ids, lines, leaves, long = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen = {}
                for raw in text.split("\n"):
                    if tokens := parsed(raw):
                        leaf = leaf_hash(tokens) if len(tokens) >= MIN_TOKENS else None
                        seen[line_hash(tokens)] = leaf, is_long(tokens)
                ids += [doc] * len(seen)
                lines += seen.keys()
                leaves += [leaf for leaf, _ in seen.values()]
                long += [x for _, x in seen.values()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in (ids, lines, leaves)), pa.array(long, pa.bool_())],
                ["doc_id", "line", "leaf", "long"],
            )

    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, line long, leaf long, long boolean")


def lines_of_leaves(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """``leaf, line, tokens`` once for every distinct line of the given leaves."""

    def run(batches):
        for b in sliced(batches):
            found = {}
            for text in b.column(0).to_pylist():
                for raw in text.split("\n"):
                    if len(tokens := parsed(raw)) >= MIN_TOKENS:
                        found[line_hash(tokens)] = (leaf_hash(tokens), "\x1f".join(tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([leaf for leaf, _ in found.values()], pa.int64()),
                    pa.array(list(found), pa.int64()),
                    pa.array([t for _, t in found.values()], pa.string()),
                ],
                ["leaf", "line", "tokens"],
            )

    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("text").cast("string").alias("text"))
    lines = rows.mapInArrow(run, "leaf long, line long, tokens string")
    return lines.join(leaves, "leaf", "left_semi").groupBy("leaf", "line").agg(F.min("tokens").alias("tokens"))


def templates(lines: list[tuple[int, list[str]]]) -> list[tuple[int, int, list[str]]]:
    """(line, template id, template) of the lines of one leaf, which all have the same number of tokens.

    Lines come in the order of their texts; the id of a template is the hash of its first line.
    """
    code: dict[str, int] = {FIELD: 0}
    first: list[int] = []
    members: list[list[int]] = []
    table = np.zeros((0, len(lines[0][1])), dtype=np.int64)
    variable = np.zeros_like(table, dtype=bool)
    for at, (line, tokens) in enumerate(lines):
        own = np.array([code.setdefault(t, len(code)) for t in tokens])
        if len(first):
            share = ((table[: len(first)] == own) & ~variable[: len(first)]).mean(1)
            best = int(share.argmax())
            if share[best] >= SIMILARITY:
                variable[best] |= table[best] != own
                members[best].append(at)
                continue
        if len(first) == len(table):
            more = max(16, len(table))
            table = np.concatenate([table, np.zeros((more, len(own)), dtype=np.int64)])
            variable = np.concatenate([variable, np.zeros((more, len(own)), dtype=bool)])
        table[len(first)] = own
        first.append(line)
        members.append([at])
    out = []
    for k, ats in enumerate(members):
        shown = [FIELD if v else t for t, v in zip(lines[ats[0]][1], variable[k])]
        out += [(lines[at][0], first[k], shown) for at in ats]
    return out


def parsed_groups(placed: DataFrame, total: int) -> DataFrame:
    """``leaf, line, template, tokens, members, long`` for ``leaf, part, line, tokens``: templates of each part."""
    bucket = F.pmod(F.xxhash64("leaf", "part"), F.lit(1 + total // BUCKET_LINES)).cast("int")

    def run(table: pa.Table) -> pa.Table:
        leaves: dict = {}
        for leaf, part, line, tokens in sorted(zip(*(table.column(c).to_pylist() for c in ("leaf", "part", "line", "tokens")))):
            leaves.setdefault((leaf, part), []).append((line, tokens.split("\x1f")))
        rows = []
        for (leaf, _), own in leaves.items():
            own.sort(key=lambda r: r[1])
            found = templates(own)
            size = Counter(at for _, at, _ in found)
            rows += [(leaf, line, at, "\x1f".join(shown), size[at], is_long(shown)) for line, at, shown in found]
        return pa.table(
            [list(c) for c in zip(*rows)],
            schema=pa.schema(
                [("leaf", pa.int64()), ("line", pa.int64()), ("template", pa.int64()), ("tokens", pa.string())]
                + [("members", pa.int64()), ("long", pa.bool_())]
            ),
        )

    return (
        placed.select("leaf", "part", "line", "tokens", bucket.alias("bucket"))
        .groupBy("bucket")
        .applyInArrow(run, "leaf long, line long, template long, tokens string, members long, long boolean")
    )


def generalised(lines: DataFrame) -> DataFrame:
    """Templates of each leaf for ``leaf, line, tokens``, large ones in parts."""
    sizes = lines.groupBy("leaf").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("line"), F.ceil(F.col("size") / LEAF_LINES)).cast("long")
    return parsed_groups(lines.join(sizes, "leaf").withColumn("part", part), lines.count())


def segments(tokens: list[str]) -> list[int]:
    """Hashes of the segments of a line, of which lines that are similar enough have one in common."""
    n = len(tokens)
    differing = sum((n - k) / n >= SIMILARITY for k in range(1, n))
    edge = [DEPTH + (n - DEPTH) * s // (differing + 1) for s in range(differing + 2)]
    return [line_hash([str(s), *tokens[a:b]]) for s, (a, b) in enumerate(zip(edge, edge[1:]))]


def met(first: DataFrame) -> DataFrame:
    """Templates of the templates ``leaf, line, tokens`` of large leaves, wherever they have a segment in common."""

    def run(batches):
        for b in sliced(batches):
            rows = []
            for leaf, line, tokens in zip(*(b.column(c).to_pylist() for c in ("leaf", "line", "tokens"))):
                rows += [(leaf, part, line, tokens) for part in segments(tokens.split("\x1f"))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["leaf", "part", "line", "tokens"]
            )

    placed = stored(first.mapInArrow(run, "leaf long, part long, line long, tokens string"), "segments")
    return parsed_groups(placed, placed.count())


def template_of_lines(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """``line, template, long`` of the lines of templates of several lines."""
    crowded = (
        seen.filter("leaf IS NOT NULL")
        .groupBy("leaf")
        .agg(F.count("*").alias("rows"), F.min("line").alias("lo"), F.max("line").alias("hi"), F.max("long").alias("long"))
        .filter(enough("rows", F.col("long")) & (F.col("lo") != F.col("hi")))
        .select("leaf")
    )
    lines = stored(lines_of_leaves(docs, crowded), "lines")
    first = stored(generalised(lines), "templates")
    named = first.filter("members > 1").select("line", "template", "long")
    large = lines.groupBy("leaf").agg(F.count("*").alias("size")).filter(F.col("size") > LEAF_LINES).select("leaf")
    if large.isEmpty():
        return named
    own = first.join(large, "leaf", "left_semi")
    again = met(own.groupBy("leaf", F.col("template").alias("line")).agg(F.min("tokens").alias("tokens")))
    again = again.filter("members > 1").select(F.col("line").alias("template"), F.col("template").alias("final"), "long")
    later = own.select("line", "template").join(again, "template").select("line", F.col("final").alias("template"), "long")
    return stored(stack(named, later).distinct(), "named")


def recurring(docs: DataFrame) -> DataFrame:
    """``doc_id, lines``: for every document the hashes of the lines that it loses."""
    seen = stored(occurrences(docs), "seen")
    # a line counts as itself and for each template that it belongs to
    template = F.xxhash64("template", F.lit("template"))
    named = stack(
        seen.select("doc_id", "line", F.col("line").alias("template"), "long"),
        seen.filter("leaf IS NOT NULL")
        .select("doc_id", "line")
        .join(template_of_lines(docs, seen), "line")
        .select("doc_id", "line", template.alias("template"), "long"),
    )
    often = (
        named.groupBy("template", "doc_id")
        .agg(F.min("long").alias("long"))
        .groupBy("template")
        .agg(F.count("*").alias("docs"), F.min("doc_id").alias("keeper"), F.min("long").alias("long"))
        .filter(enough("docs", F.col("long")))
    )
    lost = named.join(often.select("template", "keeper"), "template").filter("doc_id <> keeper")
    return lost.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


def without(text: str | None, lines: set[int]) -> tuple[str | None, int, int]:
    """The text without these lines, the number of its lines and of those dropped."""
    if text is None:
        return None, 0, 0
    raw = text.split("\n")
    kept = [r for r in raw if not (t := parsed(r)) or line_hash(t) not in lines] if lines else raw
    return "\n".join(kept), len(raw), len(raw) - len(kept)


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` as a struct ``row`` beside the kept ``text``, ``n_lines`` and ``n_dropped``."""
    lost = recurring(docs.select("doc_id", "text")).withColumnRenamed("doc_id", "id")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"),
        F.col("doc_id").alias("id"),
        F.col("text").cast("string").alias("text"),
    )

    def run(batches):
        for b in sliced(batches):
            found = [
                without(t, set(x or ()))
                for t, x in zip(b.column("text").to_pylist(), b.column("lines").to_pylist())
            ]
            text, total, dropped = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"),
                    pa.array(text, pa.string()),
                    pa.array(total, pa.int64()),
                    pa.array(dropped, pa.int64()),
                ],
                ["row", "text", "n_lines", "n_dropped"],
            )

    joined = rows.join(lost, "id", "left").select("row", "text", "lines")
    kind = StructType().add(joined.schema["row"]).add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(run, kind)
