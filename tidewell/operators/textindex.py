"""Substring search over an index of character trigrams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.frame import col, dtype_of, require
from tidewell.operators.history import text_search

GRAM = 3
# Trigrams of the needle that are looked up; any of them would do, more make fewer candidates.
MOST_GRAMS = 8


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case, found in one walk through it."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1))


def write_text_index(df: DataFrame, path: str, row_id: str, text: Sequence[str]) -> None:
    """Posting rows `gram, id` of the text columns, written in order of trigram and id.

    A trigram that very many rows have spreads over as many files as it needs, since the order goes on with the id. Statistics of
    files, row groups and pages then lead a search to the trigrams it asks for.
    """
    require(df, row_id, *text)
    own = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(col(c)), F.array().cast("array<string>")) for c in text])))
    postings = df.where(col(row_id).isNotNull()).select(F.explode(own).alias("gram"), col(row_id).alias("id"))
    postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.option("parquet.page.row.count.limit", "2000").parquet(path)


def text_search_indexed(spark: SparkSession, df: DataFrame, path: str, query: str, row_id: str, text: Sequence[str], **filters) -> DataFrame:
    """What `text_search` gives, for rows whose ids are in the index at `path`.

    Rows that have all of the needle's trigrams (up to `MOST_GRAMS`, spread over it) are candidates; the search itself then judges them. A
    needle of under three characters has no trigram, and an empty one asks for all: these go over the whole table.
    """
    needle = query.strip().lower()
    found = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)}, key=needle.index)
    if not found:
        return text_search(df, query, text, **filters)
    asked = found[:: -(-len(found) // MOST_GRAMS)]
    postings = spark.read.parquet(path).where(F.col("gram").isin(asked))
    candidates = postings.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(asked))
    candidates = candidates.select(F.col("id").cast(dtype_of(df, row_id)).alias("__id"))
    return text_search(df.join(candidates, col(row_id) == F.col("__id"), "left_semi"), query, text, **filters)
