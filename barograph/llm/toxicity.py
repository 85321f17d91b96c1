"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and beginnings of words (``BEGINNINGS`` letters) that occur far more often in toxic than in other training texts; those of at
least ``STRONG_SHARE`` of the toxic texts count as strong. Features of a whole text are densities of strong
and other lexicon words, of lexicon words near the second person, of capitals and
punctuation, and of words written with signs or digits between letters, also those that read as lexicon
words once the signs are taken back. Boosted trees learn from one part of the training rows, an isotonic
regression maps their margin to a share of toxic texts on the other.

Training takes at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id. The chosen ids are a
table of bounded size, so labelled texts are found without moving texts; features of all rows are one pass.

Cases: null texts count as empty; empty texts have zero features and a score like any other; without
labelled rows every score is 0, with labels of one kind it is that label; null ids are scored and never
learned from; an id that repeats in labels counts once, as toxic if any says so; repeated documents give
repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm.langid import held_out
from barograph.sources.checkpoint import stored

TRAIN_ROWS = 8_000
LEXICON_WORDS = 300
MIN_TOXIC_DOCS = 5
MIN_LOG_ODDS = 2.5
STRONG_SHARE = 0.05
NEAR = 5
BEGINNINGS = (3, 4, 5, 6, 7)
CACHE_WORDS = 300_000
TREES = 12
DEPTH = 3

# fixed values: second-person words of the languages at hand
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros os tus su sus".split()
)
# fixed values: signs and digits that stand for letters
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
FEATURES = (
    "strong", "strong_log", "weak", "kinds", "near_person", "disguised", "odd_words",
    "capitals", "capital_words", "punctuation", "exclamations", "digits", "words_log",
)
find_words = re.compile(r"[^\W\d_]+").findall
find_odd = re.compile(r"[^\W_]*[^\W\d_][0-9@$!|*.\-_]+[^\W\d_][^\s]*").findall
inner_signs = re.compile(r"[^\W\d_]").findall


def entries(word: str) -> list[str]:
    """What a word can match in the lexicon: itself and, with a mark, its beginnings."""
    return [word] + [word[:k] + "*" for k in BEGINNINGS if k < len(word)]


class Kinds(dict):
    """2 for a word that matches a strong entry, 1 for another entry, 0 for none; answers are kept up to a bound."""

    def __init__(self, strong: frozenset[str], weak: frozenset[str]):
        super().__init__()
        self.strong, self.weak = strong, weak

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        own = entries(word)
        self[word] = kind = 2 * (not self.strong.isdisjoint(own)) or int(not self.weak.isdisjoint(own))
        return kind


def features(text: str | None, kinds: Kinds) -> list[float]:
    text = text or ""
    lower = text.lower()
    words = find_words(lower)
    n, chars = max(1, len(words)), max(1, len(text))
    kind = bytes(map(kinds.__getitem__, words))
    strong = kind.count(2)
    hits = [i for i, k in enumerate(kind) if k == 2] if strong else []
    near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    odd = find_odd(lower)
    plain = (("".join(inner_signs(o)), "".join(inner_signs(o.translate(DISGUISE)))) for o in odd)
    disguised = sum(kinds[a] == 2 or kinds[b] == 2 for a, b in plain)
    if text.isascii():
        upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    else:
        upper = sum(map(str.isupper, text))
    letters = max(1, sum(map(len, words)))
    return [
        strong / n,
        float(np.log1p(strong)),
        kind.count(1) / n,
        float(len({words[i] for i in hits})),
        near / n,
        disguised / n,
        len(odd) / n,
        upper / letters,
        upper / letters if upper * 2 > letters else 0.0,
        sum(map(text.count, ".,;:!?\"'#%&*$")) / chars,
        text.count("!") / chars,
        sum(map(text.count, "0123456789")) / chars,
        float(np.log1p(len(words))),
    ]


def chosen(labels: DataFrame) -> DataFrame:
    """At most about TRAIN_ROWS ids with their label, none of them held out."""
    rows = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id", 5, 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    n = rows.count()
    at = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return rows.filter(at < min(1.0, TRAIN_ROWS / n)) if n else rows


def learned_lexicon(training: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Strong and other words with high log-odds of a toxic text; each distinct text counts once."""

    def run(batches):
        for b in batches:
            words, toxic = [], []
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {e for w in set(find_words(text.lower())) for e in entries(w)}
                words += own
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], ["word", "toxic"])

    texts = training.groupBy("text").agg(F.max("toxic").alias("toxic"))
    n = Counter({r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()})
    words = texts.mapInArrow(run, "word string, toxic int").groupBy("word").agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") != 1).alias("good")
    )
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("good") + 0.5) / (n[0] + 1))
    top = words.filter(F.col("bad") >= MIN_TOXIC_DOCS).withColumn("odds", odds).filter(F.col("odds") >= MIN_LOG_ODDS)
    found = top.orderBy(F.desc("odds"), "word").limit(LEXICON_WORDS).collect()
    strong = frozenset(r["word"] for r in found if r["bad"] >= STRONG_SHARE * n[1])
    return strong, frozenset(r["word"] for r in found) - strong


def with_features(docs: DataFrame, lexicon: tuple[frozenset[str], frozenset[str]]) -> DataFrame:
    """``doc_id, features`` and, where there is one, ``toxic``."""
    labelled = "toxic" in docs.columns
    kept = ["doc_id", "text"] + ["toxic"] * labelled

    def run(batches):
        kinds = Kinds(*lexicon)
        for b in batches:
            found = [features(t, kinds) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array(found, pa.list_(pa.float64())), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "features"] + ["toxic"] * labelled)

    kind = "doc_id long, features array<double>" + ", toxic int" * labelled
    rows = docs.select(*kept).mapInArrow(run, kind)
    return rows.withColumn("features", array_to_vector("features"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = chosen(labels)
    training = stored(
        docs.filter("text IS NOT NULL").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic"), "training"
    )
    kinds = [r[0] for r in training.select("toxic").distinct().collect()]
    if len(kinds) < 2:
        constant = F.lit(float(kinds[0]) if kinds else 0.0)
        return finished(docs.select("doc_id", constant.alias("score")))
    lexicon = learned_lexicon(training)
    rows = stored(
        with_features(training, lexicon).withColumn("calibrate", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0), "features"
    )
    trees = GBTClassifier(labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11)
    model = trees.fit(rows.filter("NOT calibrate"))
    margin = vector_to_array(F.col("rawPrediction")).getItem(1).alias("margin")
    seen = model.transform(rows.filter("calibrate")).select(margin, F.col("toxic").cast("double").alias("label"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(seen)
    every = model.transform(with_features(docs, lexicon)).select("doc_id", margin)
    return finished(curve.transform(every).select("doc_id", "score"))


def finished(scored: DataFrame) -> DataFrame:
    bounded: Column = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        bounded.alias("score"),
        (bounded >= 0.5).cast("int").alias("predicted"),
    )
