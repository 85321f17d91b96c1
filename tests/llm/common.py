"""Small tables with the awkward rows that every operator has to take."""

from pyspark.sql import functions as F

# columns that clash with names the operators use inside
CLASHING = ("id", "block", "part", "n", "sig", "row", "line", "lines", "score", "ids", "key", "features", "tokens", "v")


def docs_frame(spark, rows, lang=None):
    """``doc_id, text`` rows as a documents table with extra columns of clashing names."""
    lang = lang or {}
    full = [(d, t, lang.get(d), "src", None if t is None else len(t)) for d, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHING])


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
