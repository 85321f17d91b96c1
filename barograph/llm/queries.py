"""The ``opN_`` queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from barograph.llm import alignment, archive, bpe, decontaminate, html, jaccard, langid, lines, passages, repeats, topk, toxicity, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_lines")
def op1_lines(spark, sf_dir):
    kept = lines.drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op2_bpe")
def op2_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op3_warc",
    """
    WITH p AS (
      SELECT page_id, sha1(coalesce(html, '')) AS payload_digest,
             CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
      FROM pages),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p),
    r AS (SELECT *, payload_bytes >= 1000 AND page_id < last AS revisits FROM m)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN revisits THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN revisits THEN last END AS refers_to
    FROM r
    """,
)
def op3_warc(spark, sf_dir):
    return archive.archived(table(spark, sf_dir, "pages"))


@query("op4_langid")
def op4_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query(
    "op5_repeats",
    """
    WITH h AS (
      SELECT doc_id, hex(encode(coalesce(text, ''))) AS x,
             CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes
      FROM documents),
    strings AS (
      SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s
      FROM h, unnest(range(0, greatest(n_bytes - 49, 0))) AS t(i)),
    hits AS (
      SELECT doc_id, i FROM strings JOIN (SELECT s, min(doc_id) AS least FROM strings GROUP BY s) USING (s)
      WHERE least < doc_id),
    parted AS (
      SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM (
        SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh
        FROM hits)),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM parted GROUP BY doc_id, part),
    gaps AS (
      SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS g, a AS e FROM spans
      UNION ALL
      SELECT h.doc_id, coalesce(max(b), 0), n_bytes FROM h LEFT JOIN spans USING (doc_id) GROUP BY h.doc_id, n_bytes),
    kept AS (
      SELECT doc_id, string_agg(substr(x, 2 * g + 1, 2 * (e - g)), '' ORDER BY g) AS k FROM gaps JOIN h USING (doc_id)
      GROUP BY doc_id)
    SELECT h.doc_id, n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
           CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
    FROM h JOIN kept USING (doc_id)
    LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id) USING (doc_id)
    """,
)
def op5_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op6_html")
def op6_html(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


@query("op7_decontaminate")
def op7_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op8_topk",
    """
    WITH cells AS (
      SELECT vec_id, generate_subscripts(embedding, 1) AS i,
             CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x
      FROM embeddings),
    scores AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM cells q JOIN cells c ON q.i = c.i AND q.vec_id <> c.vec_id
      WHERE q.vec_id % 50 = 0 GROUP BY ALL),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM scores)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op8_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query(
    "op9_jaccard",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS ws
      FROM documents),
    sets AS (
      SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
      FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    pairs AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY ALL),
    links AS (
      SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
      WHERE 100 * c >= 80 * (x.n + y.n - c)),
    reach AS (
      SELECT doc_id AS a, doc_id AS b FROM documents
      UNION
      SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT reach.a AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
    FROM reach LEFT JOIN sizes ON reach.a = sizes.doc_id GROUP BY reach.a
    """,
)
def op9_jaccard(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op11_variants",
    r"""
    WITH RECURSIVE steps AS (
      SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
               lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
    runs AS (
      SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
      FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
                   unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
            FROM documents)
      WHERE length(run) >= 7 GROUP BY ALL),
    bytes AS (
      SELECT run, k, list_transform(range(0, CAST(length(x) / 2 AS BIGINT)),
               lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b
      FROM (SELECT run, k, hex(encode(doc_id || ':' || run)) AS x FROM runs)),
    hashed AS (
      SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, b),
               lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) AS h
      FROM bytes, steps),
    made AS (
      SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, (h % length(run)) + 2)
                  ELSE run END AS word, k FROM hashed),
    words AS (
      SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
    cuts AS (
      SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
      FROM words, unnest(range(0, length(word))) AS t(i)),
    near AS (
      SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b USING (i, rest) WHERE a.word <> b.word
      UNION SELECT w.word, w.n, c.word, c.n FROM words w JOIN cuts c ON w.word = c.rest
      UNION SELECT c.word, c.n, w.word, w.n FROM words w JOIN cuts c ON w.word = c.rest),
    ranked AS (
      SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
             row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place
      FROM near),
    forms AS (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
      FROM words w LEFT JOIN ranked r ON w.word = r.word AND place = 1),
    walk AS (
      SELECT word, word AS at FROM words
      UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON walk.at = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
    FROM forms f JOIN walk USING (word) JOIN forms e ON walk.at = e.word AND e.form IS NULL
    """,
)
def op11_variants(spark, sf_dir):
    return variants.variants(table(spark, sf_dir, "documents"))


@query(
    "op12_passages",
    r"""
    WITH w AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    windows AS (
      SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
      FROM w, unnest(range(1, greatest(len(ws) - 11, 1))) AS t(i)),
    hits AS (
      SELECT doc_id, i FROM windows JOIN (SELECT s, min(doc_id) AS least FROM windows GROUP BY s) USING (s)
      WHERE least < doc_id),
    gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hits, range(13) AS r(k)),
    placed AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
    kept AS (
      SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
    removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
           sha256(coalesce(k, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
    """,
)
def op12_passages(spark, sf_dir):
    return passages.remove_passages(table(spark, sf_dir, "documents"))


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *files)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
