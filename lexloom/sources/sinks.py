"""Writers of results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def envelope(matches: DataFrame, query: str, limit: int = 150, incomplete: str | None = None) -> str:
    """The aggregate answer as JSON: totals over all matches, the first `limit` of them, and whether it is complete."""
    totals = matches.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("files")).first()
    shown = [json.loads(r[0]) for r in matches.orderBy("doc_id", "line_no").limit(limit).select(F.to_json(F.struct("doc_id", "line_no", "line"))).collect()]
    body = {"version": 1, "query": query, "total_matches": totals["n"], "total_files": totals["files"], "matches": shown, "result_incomplete": incomplete is not None or totals["n"] > limit}
    if incomplete or totals["n"] > limit:
        body["incomplete_reason"] = incomplete or f"shows {limit} of {totals['n']} matches"
    return json.dumps(body, ensure_ascii=False)


def ndjson(matches: DataFrame, path: str, query: str) -> None:
    """A JSON row for each match, and one record of what was asked even if nothing matched."""
    spark = matches.sparkSession
    head = spark.createDataFrame([("summary", query)], "type string, query string").select(F.to_json(F.struct("type", "query")).alias("value"))
    matches.select(F.to_json(F.struct(F.lit("match").alias("type"), *matches.columns)).alias("value")).unionByName(head).write.mode("overwrite").text(path)


def csv(matches: DataFrame, path: str) -> None:
    matches.select(F.col("doc_id").alias("file"), F.col("line_no").alias("line_number"), F.col("line").alias("text")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def tsv(matches: DataFrame, path: str) -> None:
    matches.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def grep_text(heading: Column, line_no: Column, line: Column, matched: Column | None = None) -> Column:
    """`file:line:text`; context lines have `-` between."""
    sep = F.when(matched, ":").otherwise("-") if matched is not None else F.lit(":")
    return F.concat(heading.cast("string"), sep, line_no.cast("string"), sep, line)


def mermaid(edges: DataFrame, limit: int = 500) -> str:
    """A caller tree of (src, dst) as a Mermaid graph; a bounded picture, not the data."""
    rows = edges.orderBy("src", "dst").limit(limit + 1).collect()
    more = ["  %% incomplete: shows the first " + str(limit) + " edges"] if len(rows) > limit else []
    return "\n".join(["graph TD", *(f"  n{r['src']} --> n{r['dst']}" for r in rows[:limit]), *more])


def markdown(table: DataFrame, limit: int = 500) -> str:
    """The first rows in the order of all columns; says so where there are more."""
    rows = table.orderBy(*table.columns).limit(limit + 1).collect()
    more = ["", f"Shows the first {limit} rows."] if len(rows) > limit else []
    rows = rows[:limit]
    head = f"| {' | '.join(table.columns)} |\n|{'|'.join(['-'] * len(table.columns))}|"
    return "\n".join([head, *("| " + " | ".join(str(x) for x in r) + " |" for r in rows), *more])
