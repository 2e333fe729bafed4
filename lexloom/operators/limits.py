"""Caps on results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.shared import running


def capped(found: DataFrame, max_files: int, max_results: int) -> DataFrame:
    """The first results in order of document and line, of the first documents. Documents are chosen by a top-k, not by ranking all."""
    files = found.select("doc_id").distinct().orderBy("doc_id").limit(max_files)
    return found.join(F.broadcast(files), "doc_id").orderBy("doc_id", "line_no").limit(max_results)


def within_budget(ranked: DataFrame, size: Column, budget: float, order: list[Column]) -> DataFrame:
    """The longest prefix of a ranking whose running size is within a budget: the closed form of a greedy loop. Sizes are not negative.

    No task ranks all rows.
    """
    found = running(ranked.withColumn("_size", size.cast("double")), order, F.col("_size"), "used")
    return found.filter(F.col("used") <= budget).drop("_size")
