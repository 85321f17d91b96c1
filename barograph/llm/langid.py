"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased, everything that isn't a letter becomes a space, and n-grams of the orders in
``ORDERS`` are hashed into ``BUCKETS``. A feature is the share of an n-gram in its text times its inverse
document frequency. The weights are trained with follow-the-regularised-leader steps per coordinate under
elastic-net penalties, so most of them are exactly zero; a temperature fitted on rows that the weights
haven't seen calibrates the probabilities.

Training takes at most about ``ROWS_PER_LANGUAGE`` labelled rows of each language, chosen by a hash of the
id; the rows for prediction are all rows, each with its whole text, in one pass without a shuffle.

Cases: null text or text without a letter gives ``und`` and score 0; without labelled rows every text is
``und``; with a single language that language has score 1; null ids are predicted but never learned from;
repeated rows give repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm.blocks import sliced

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
ROWS_PER_LANGUAGE = 800
CHUNK_CHARS = 1 << 20
UNDETERMINED = "und"


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, with inverse document frequency and temperature inside
    bias: np.ndarray


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point: is it a letter?"""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def buckets(texts: list[str]):
    """For the joined texts: one bucket array per order, where each text starts, and which have letters."""
    lowered = [f" {t.lower()} " for t in texts]
    start = np.cumsum([0] + [len(t) for t in lowered])[:-1]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = letters()[code]
    code = np.where(letter, code, np.uint32(32))
    with_letters = np.add.reduceat(letter, start, dtype=np.int64) > 0
    out, h = [], code * np.uint32(0x9E3779B1)
    for n in ORDERS:
        if n > 1:  # the last n - 1 places of a text meet spaces and the next text's first space only
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            h[: 1 - n] += code[n - 1 :] * np.uint32(0xC2B2AE35)
        out.append(((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(16))
    return out, start, with_letters


def chunks(texts: list[str]):
    """Runs of texts of about CHUNK_CHARS; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CHUNK_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and their shares of its length."""
    found, _, _ = buckets([text])
    index, count = np.unique(np.concatenate(found), return_counts=True)
    return index.astype(np.int32), (count / (len(found[0]))).astype(np.float32)


def training_rows(docs: DataFrame, allowed: Column) -> DataFrame:
    """At most about ROWS_PER_LANGUAGE rows of each language: ``lang, index, share``."""
    rows = docs.filter(allowed & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    part = F.lit(None).cast("double")
    for lang, n in sorted(counts.items()):
        part = F.when(F.col("lang") == lang, min(1.0, ROWS_PER_LANGUAGE / n)).otherwise(part)
    at = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    picked = rows.filter(at < part).select("doc_id", "lang", "text")

    def run(batches):
        for b in batches:
            found = [shares(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([i.tobytes() for i, _ in found], pa.binary()),
                    pa.array([s.tobytes() for _, s in found], pa.binary()),
                ],
                ["doc_id", "lang", "index", "share"],
            )

    return picked.mapInArrow(run, "doc_id long, lang string, index binary, share binary")


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    classes: int,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.01,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS x classes) and bias of a multinomial model, one row at a time."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weight(zs, ns):
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0)
        return -shrunk / ((beta + np.sqrt(ns)) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            index, x = rows[i]
            at = np.append(index, BUCKETS)  # the last one is the bias
            x = np.append(x, 1.0)
            w = weight(z[at], n[at])
            p = softmax((x @ w)[None])[0]
            p[labels[i]] -= 1
            g = x[:, None] * p[None]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(z, n)
    return w[:BUCKETS], w[BUCKETS]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits under which labels of unseen rows are likeliest."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, allowed: Column) -> Model:
    got = sorted(map(tuple, training_rows(docs, allowed).collect()))
    languages = sorted({r[1] for r in got})
    if len(languages) < 2:
        return Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)))
    rows = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in got]
    labels = np.array([languages.index(r[1]) for r in got])
    df = np.bincount(np.concatenate([i for i, _ in rows]), minlength=BUCKETS)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    rows = [(i, s * idf[i]) for i, s in rows]
    kept_out = np.arange(len(rows)) % 5 == 4
    train = [r for r, out in zip(rows, kept_out) if not out]
    w, b = ftrl(train, labels[~kept_out], len(languages))
    logits = np.array([x @ w[i] + b for (i, x), out in zip(rows, kept_out) if out])
    t = temperature(logits, labels[kept_out]) if len(logits) else 1.0
    return Model(languages, (idf[:, None] * w / t).astype(np.float32), b / t)


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lang, score = [], []
    for run in chunks([t or "" for t in texts]):
        found, start, known = buckets(run)
        if not model.languages:
            lang += [UNDETERMINED] * len(run)
            score += [0.0] * len(run)
            continue
        size = np.diff(np.append(start, len(found[0])))
        total = sum(np.add.reduceat(model.weights[b], start, axis=0) for b in found)
        p = softmax(total / size[:, None] + model.bias)
        best = p.argmax(1)
        lang += [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), known.tolist())]
        score += np.where(known, p.max(1), 0.0).tolist()
    return lang, score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""

    def run(batches):
        for b in batches:
            lang, score = predict_texts(model, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str, of: int, part: int) -> Column:
    """Is the row in the fold that nothing is learned from?"""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)) == part, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the rows that aren't held out."""
    model = fit(docs.select("doc_id", "lang", "text"), ~held_out("doc_id", 4, 2))
    return predict(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def confident(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is determined with ``min_score``, all columns and texts as they are."""
    model = fit(docs.select("doc_id", "lang", "text"), ~held_out("doc_id", 4, 2))
    columns = docs.columns

    def run(batches):
        for b in sliced(batches):
            text = b.column(b.schema.get_field_index("text")).to_pylist()
            lang, score = predict_texts(model, text)
            keep = [g != UNDETERMINED and s >= min_score for g, s in zip(lang, score)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*columns)
