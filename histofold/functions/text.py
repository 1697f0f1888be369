"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_newlines(text: Column) -> Column:
    """Number of ``\\n`` in a text; a missing (binary/unreadable) text counts 0."""
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0))


def newline_count(documents: DataFrame) -> DataFrame:
    """P3 over the ``documents`` table: line count of each whole text."""
    return documents.select("doc_id", count_newlines(F.col("text")).cast("long").alias("newline_count"))


def one_line(text: Column) -> Column:
    """``\\n`` -> space; ``\\r`` stays (Q26).  A missing message becomes ''."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
