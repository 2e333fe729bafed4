"""Context, groups, sequences and chunks: windows over the lines of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import split_lines
from lexloom.operators.search import SearchSpec, lines, predicate, prefilter


def with_context(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Matching lines and those around them, each once. The lines after a match look back, those before look ahead.

    With max_count the first matches of a document are chosen first, and keep their lines after.
    """
    early = prefilter(spec, F.col("text"))
    own = lines(docs.filter(early) if early is not None else docs).withColumn("matched", predicate(spec, F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    if spec.max_count is not None:
        running = F.sum(F.col("matched").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        own = own.withColumn("matched", F.col("matched") & (running <= spec.max_count))
    near = F.max("matched").over(order.rowsBetween(-spec.after, spec.before))
    return own.withColumn("_near", near).filter("_near").drop("_near")


def context_groups(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Context lines with the number of their group; groups are what a separator stands between."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    own = with_context(docs, spec)
    gap = (F.col("line_no") - F.lag("line_no").over(order) > 1).cast("int")
    return own.withColumn("group_no", F.coalesce(F.sum(F.coalesce(gap, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)).cast("int"))


def eventually(docs: DataFrame, first: SearchSpec, then: SearchSpec, max_count: int | None = None) -> DataFrame:
    """For each line that matches `first`, the next line strictly after it that matches `then`. max_count caps a document's sequences."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    own = lines(docs)
    ahead = F.min(F.when(predicate(then, F.col("line")), F.col("line_no"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    own = own.withColumn("then_line", ahead).filter(predicate(first, F.col("line")) & F.col("then_line").isNotNull())
    own = own.select("doc_id", F.col("line_no").alias("first_line"), "then_line")
    if max_count is not None:
        own = own.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line"))).filter(F.col("_rank") <= max_count).drop("_rank")
    return own


def chunks(docs: DataFrame, size: int = 30, overlap: int = 5) -> DataFrame:
    """Windows of lines, made in the row: doc_id, chunk_no, start_line, end_line, text. The last one reaches the end."""
    step = max(1, size - overlap)
    own = docs.filter(F.coalesce(F.col("text"), F.lit("")) != "").select("doc_id", split_lines(F.col("text")).alias("_lines"))
    own = own.filter(F.size("_lines") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("_lines") - size) / F.lit(step))).cast("int")

    def made(n):
        start = n * step + 1
        end = F.least(start + size - 1, F.size("_lines")).cast("int")
        return F.struct(n.alias("chunk_no"), start.cast("int").alias("start_line"), end.alias("end_line"), F.concat_ws("\n", F.slice("_lines", start, F.lit(size))).alias("text"))

    # Chunks are made before rows are: a row for each chunk with all lines of its document would grow with the square of these.
    return own.select("doc_id", F.transform(F.sequence(F.lit(0), last), made).alias("_chunks")).select("doc_id", F.inline("_chunks"))
