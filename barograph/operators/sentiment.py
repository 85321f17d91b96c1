"""Headline sentiment from a word list, averaged per day and merged into features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.functions.windows import KEY, TIME

# Finance words with a sign, in alphabetical order.
POSITIVE = (
    "beat", "best", "better", "boost", "gain", "gains", "good", "great", "growth", "high",
    "improve", "improved", "positive", "profit", "rally", "record", "rise", "rises", "rose",
    "strong", "success", "surge", "up", "upgrade", "win",
)
NEGATIVE = (
    "bad", "bear", "crash", "cut", "decline", "down", "downgrade", "drop", "fall", "falls",
    "fear", "fell", "loss", "losses", "low", "miss", "negative", "poor", "risk", "sell",
    "slump", "warn", "weak", "worse", "worst",
)


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters of the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def score(text: Column) -> Column:
    """(positive - negative) / (positive + negative) words, 0 without any, in [-1, 1].

    Works on the word array of the row, so a text of any length stays one row and no word
    is shuffled.
    """
    found = words(text)
    up = F.size(F.filter(found, lambda w: w.isin(*POSITIVE)))
    down = F.size(F.filter(found, lambda w: w.isin(*NEGATIVE)))
    return F.coalesce(F.try_divide((up - down).cast("double"), up + down), F.lit(0.0))


def scored(df: DataFrame, text: str, out: str = "compound_score") -> DataFrame:
    return df.withColumn(out, score(F.col(text)))


def daily_sentiment(df: DataFrame) -> DataFrame:
    """Mean score and number of texts per series and day."""
    return df.groupBy(KEY, TIME).agg(
        F.avg("compound_score").alias("compound_score"), F.count(F.lit(1)).alias("n_texts")
    )


def merge_sentiment(features: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Left join by series and day; days without texts score 0."""
    side = sentiment.select(KEY, TIME, "compound_score")
    return features.join(side, [KEY, TIME], "left").withColumn(
        "compound_score", F.coalesce("compound_score", F.lit(0.0))
    )
