"""Classification of log lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import log_level_full


def classify(rows: DataFrame, column: str = "line", model: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows with label, confidence and provider; a model is a function from a column to struct(label, confidence), such as a pandas UDF."""
    found = (model or log_level_full)(F.col(column))
    return rows.withColumn("_l", found).select("*", "_l.label", "_l.confidence", F.lit("model" if model else "heuristic").alias("provider")).drop("_l")


def rendered(classified: DataFrame, least: float, column: str = "line") -> DataFrame:
    kept = classified.filter(F.col("confidence") >= least)
    return kept.withColumn("shown", F.format_string("[%s %.3f] %s", "label", "confidence", column))


def budgeted(rows: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """The first rows in order and whether there are more."""
    top = rows.orderBy(*order).limit(budget + 1)
    n = top.agg(F.count("*").alias("_n"))
    return top.orderBy(*order).limit(budget).crossJoin(F.broadcast(n)).withColumn("truncated", F.col("_n") > budget).drop("_n")


# Words that make a query a question to a model rather than a pattern.
QUESTION_WORDS = ("classify", "detect", "extract entities", "anomaly")


def query_kind(query: str) -> str:
    """NLP for a query that asks for understanding, FAST for one that is a pattern."""
    low = query.lower()
    return "NLP" if any(w in low for w in QUESTION_WORDS) else "FAST"
