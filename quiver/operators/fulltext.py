"""Full-text search over a text column: tokens, conjunctive search, prefix search and an inverted table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits of at least two bytes."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: F.octet_length(t) >= 2))


def _words(spark, query: str) -> list[str]:
    return spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]


def search(rows: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Keys of rows that hold all tokens of the query; none for a query without tokens."""
    words = _words(rows.sparkSession, query)
    if not words:
        return rows.select(key).limit(0)
    found = tokens(F.col(text))
    condition = F.lit(True)
    for w in words:
        condition = condition & F.array_contains(found, w)
    return rows.filter(condition).select(key)


def search_prefix(rows: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    """Keys of rows with a token that begins with the prefix."""
    return rows.filter(F.exists(tokens(F.col(text)), lambda t: F.startswith(t, F.lit(prefix.lower())))).select(key) if prefix else rows.select(key).limit(0)


def inverted(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key) pairs, to be written partitioned or bucketed by token when a table is searched often."""
    return rows.select(F.explode(tokens(F.col(text))).alias("token"), key).distinct()


def search_inverted(index: DataFrame, key: str, query: str) -> DataFrame:
    """Keys of the inverted table that occur under all tokens of the query."""
    words = _words(index.sparkSession, query)
    if not words:
        return index.select(key).limit(0)
    return index.filter(F.col("token").isin(*words)).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(words)).select(key)
