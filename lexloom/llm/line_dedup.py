"""Line dedup: lines found in many documents stay in one of them.

Each document's lines are exploded with their positions as hashes of their normalised form; distinct documents are counted per
hash; a document then loses every line whose hash is over the threshold, except in the largest doc_id that
holds it. The lines left are put together again by position. DataFrame functions only.

Only lines long enough are exploded, and of them only 16-byte hashes and positions move. A line that very many documents have is
counted with partial sums, and the rows that have it are dealt to several tasks in the join. Texts move once, by doc_id and a hash of the text.

Defined results: a null or empty text is one empty line and stays. A line occurring many times in a document
counts once and goes (or stays) everywhere in it. Rows with the same doc_id count as one document and are
rewritten alike; rows with a null doc_id count as one document that is smaller than any other. Further columns
are kept; names starting with "_ld_" are reserved. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import beside, save

MIN_CHARS = 20
MIN_DOCS = 3
#: Lines in more documents than this are dealt to several tasks in the join.
HOT_DOCS = 2_000
SPACE_SQL = "' \\t\\n\\u000B\\u000C\\r'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINES = "split(coalesce(text, ''), '\\n')"


def _held(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_ld_id, _ld_text: a hash, _ld_at, _ld_a, _ld_b: the key's hash) of each line that is long enough."""
    keys = f"transform({LINES}, x -> trim(BOTH {SPACE_SQL} FROM x))"
    # Two hashes, of the key and of the key turned round, make 128 bits.
    hashed = f"transform(transform({keys}, k -> if(length(k) >= {min_chars}, translate(k, '{UPPER}', '{LOWER}'), null)), (k, i) -> if(k is null, null, named_struct('at', i, 'a', xxhash64(k), 'b', xxhash64(xxhash64(k), length(k), reverse(k)))))"
    found = docs.select(F.col("doc_id").cast("long").alias("_ld_id"), F.xxhash64("text").alias("_ld_text"), F.explode(F.expr(f"filter({hashed}, x -> x is not null)")).alias("x"))
    return found.select("_ld_id", "_ld_text", F.col("x.at").alias("_ld_at"), F.col("x.a").alias("_ld_a"), F.col("x.b").alias("_ld_b"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text rewritten, plus _ld_lines (before) and _ld_dropped."""
    held = _held(docs, min_chars)
    often = held.groupBy("_ld_a", "_ld_b", "_ld_id").agg(F.lit(1).alias("_ld_one")).groupBy("_ld_a", "_ld_b").agg(F.count("*").alias("_ld_n"), F.max("_ld_id").alias("_ld_last"))
    often = save(docs.sparkSession, often.filter(F.col("_ld_n") >= min_docs), "lines")
    drops = beside(held, often.drop("_ld_n"), ["_ld_a", "_ld_b"], often.filter(F.col("_ld_n") > HOT_DOCS), F.xxhash64("_ld_id", "_ld_text"))
    drops = drops.filter(~F.col("_ld_id").eqNullSafe(F.col("_ld_last"))).groupBy("_ld_id", "_ld_text").agg(F.collect_set("_ld_at").alias("_ld_drop"))
    # A hash of a null text is that of no value, so texts are never null here.
    drops = drops.select(F.col("_ld_id").alias("_ld_doc"), F.col("_ld_text").alias("_ld_same"), "_ld_drop")
    joined = docs.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col("_ld_doc")) & (F.xxhash64("text") == F.col("_ld_same")), "left")
    joined = joined.withColumn("_ld_split", F.expr(LINES))
    kept = "transform(array_except(sequence(0, size(_ld_split) - 1), _ld_drop), i -> _ld_split[i])"
    text = F.expr(f"if(_ld_drop is null, coalesce(text, ''), array_join({kept}, '\\n'))")
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.size("_ld_split").cast("long").alias("_ld_lines"), F.expr("if(_ld_drop is null, 0, size(_ld_drop))").cast("long").alias("_ld_dropped"))
