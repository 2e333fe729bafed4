"""Where queries are registered with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Lines of documents as SQL: a line ends at \n only, one trailing empty element is dropped, empty text has none.
LINES = """
doc_lines AS (
  SELECT doc_id, lang, source, text, CASE WHEN text = '' THEN []::VARCHAR[]
    WHEN suffix(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls
  FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, lang, source, unnest(ls) AS line, generate_subscripts(ls, 1)::INTEGER AS line_no FROM doc_lines
)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
