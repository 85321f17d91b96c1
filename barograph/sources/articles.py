"""News articles held as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARTICLES_SCHEMA = (
    "array<struct<title:string,description:string,publishedAt:string,source:struct<name:string>>>"
)


def flatten_articles(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """One row per usable article: it has a title, was not removed and has a readable date."""
    article = df.select(*keep, F.explode(F.from_json(payload, ARTICLES_SCHEMA)).alias("a"))
    title = F.coalesce("a.title", F.lit(""))
    return (
        article.filter((title != "") & (title != "[Removed]"))
        .select(
            *keep,
            F.to_date(F.try_to_timestamp("a.publishedAt")).alias("date"),
            title.alias("title"),
            F.trim(F.concat(title, F.lit(". "), F.coalesce("a.description", F.lit("")))).alias(
                "text"
            ),
            F.coalesce("a.source.name", F.lit("unknown")).alias("source"),
        )
        .filter(F.col("date").isNotNull())
    )
