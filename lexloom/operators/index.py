"""Trigram index: built, queried, verified, kept up to date. It never changes an answer."""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import required_literal, trigrams
from lexloom.operators.changes import changeset
from lexloom.operators.search import SearchSpec, lines, predicate, search
from lexloom.operators.segments import spread

FORMAT = 1
#: Candidates that are broadcast: about 20 bytes each.
FEW = 100_000


def build(docs: DataFrame) -> DataFrame:
    """Postings (tri, doc_id, line_no) of distinct trigrams per line; every document is indexed, whatever its size."""
    return lines(docs).select("doc_id", "line_no", F.explode(trigrams(F.col("line"))).alias("tri"))


def grams_of(literal: str) -> list[str]:
    low = literal.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def candidates(postings: DataFrame, literal: str) -> DataFrame:
    """Lines that have all trigrams of a literal. Few trigrams are read, counts are summed before the shuffle."""
    grams = grams_of(literal)
    hit = postings.filter(F.col("tri").isin(grams)).groupBy("doc_id", "line_no").agg(F.count("*").alias("n"))
    return hit.filter(F.col("n") == len(grams)).select("doc_id", "line_no")


def usable(spec: SearchSpec) -> list[str] | None:
    """The literals to ask the index for, one for each pattern; None where only a scan is sound."""
    if spec.invert:
        return None
    found = [p if spec.fixed else required_literal(p) for p in spec.patterns]
    if any(x is None or len(x) < 3 or "\n" in x or (spec.folds and not x.isascii()) for x in found):
        return None
    return found


def candidate_lines(postings: DataFrame, literals: Sequence[str]) -> DataFrame:
    """Lines that have all trigrams of any of the literals, in one pass over the postings."""
    grams = [grams_of(x) for x in literals]
    counts = [F.count_if(F.col("tri").isin(g)).alias(f"_n{i}") for i, g in enumerate(grams)]
    hit = postings.filter(F.col("tri").isin(sorted({x for g in grams for x in g}))).groupBy("doc_id", "line_no").agg(*counts)
    return hit.filter(functools.reduce(operator.or_, (F.col(f"_n{i}") == len(g) for i, g in enumerate(grams)))).select("doc_id", "line_no")


def index_search(docs: DataFrame, postings: DataFrame, spec: SearchSpec) -> DataFrame:
    """Candidates from the index, verified by the real predicate; the same rows as a scan."""
    literals = usable(spec)
    if literals is None:
        return search(docs, spec)
    found = candidate_lines(postings, literals)
    # A few candidates, as an index is asked for, go to all tasks, so no text is moved; of more, texts and candidates meet by document.
    few = found.limit(FEW + 1).collect()
    if len(few) <= FEW:
        found = F.broadcast(docs.sparkSession.createDataFrame(few, found.schema))
        near = docs.join(F.broadcast(docs.sparkSession.createDataFrame(sorted({(r["doc_id"],) for r in few}), found.select("doc_id").schema)), "doc_id", "left_semi")
        return lines(near).join(found, ["doc_id", "line_no"], "left_semi").filter(predicate(spec, F.col("line")))
    near = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    return lines(near).join(found, ["doc_id", "line_no"], "left_semi").filter(predicate(spec, F.col("line")))


def refresh(postings: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Postings for `after` from those for `before`: only what changed is read anew. before and after: doc_id, text."""
    side = lambda d: d.select(F.col("doc_id").cast("string").alias("path"), F.xxhash64("text").alias("mtime"), F.length("text").cast("long").alias("size"))
    changes = changeset(side(before), side(after)).select(F.col("path").cast("long").alias("doc_id"), "change")
    kept = postings.join(changes, "doc_id", "left_anti")
    new = after.join(changes.filter("change <> 'removed'"), "doc_id", "left_semi")
    return kept.unionByName(build(new).select(*postings.columns))


def stale_reason(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the first reason for which an index over `before` is stale, or null."""
    order = F.when(F.col("change") == "removed", 1).when(F.col("change") == "modified", 2).otherwise(3)
    first = changeset(before, after).agg(F.min(F.struct(order.alias("o"), "path", "change")).alias("f"))
    return first.select(F.concat_ws(": ", F.col("f.change"), F.col("f.path")).alias("reason"), F.col("f").isNotNull().alias("stale"))


def save_index(postings: DataFrame, path: str) -> None:
    """Sorted by trigram within files, each of a task's documents, so that a query reads few pages of each and nothing is shuffled to build it."""
    _save(postings.sortWithinPartitions("tri", "doc_id"), path, {"kind": "trigrams"})


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, {"kind": "trigrams"})


def save_chunks(chunks: DataFrame, path: str, size: int, overlap: int) -> None:
    """Chunks to rank, with how they were cut."""
    _save(chunks, path, {"kind": "chunks", "size": size, "overlap": overlap})


def load_chunks(spark: SparkSession, path: str, size: int, overlap: int) -> DataFrame:
    return _load(spark, path, {"kind": "chunks", "size": size, "overlap": overlap})


def _save(table: DataFrame, path: str, about: dict) -> None:
    table.write.mode("overwrite").parquet(f"{path}/postings")
    meta = json.dumps({"format": FORMAT, **about}, sort_keys=True)
    table.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _load(spark: SparkSession, path: str, about: dict) -> DataFrame:
    """What was saved, if it is of this format and made the way that is asked for; else an error, never a wrong answer."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("format") != FORMAT:
        raise ValueError(f"index of format {meta.get('format')}; this reads {FORMAT}")
    if {k: v for k, v in meta.items() if k != "format"} != about:
        raise ValueError(f"index is of {meta}, not {about}")
    return spark.read.parquet(f"{path}/postings")


#: Bytes of text whose trigrams a task counts together.
COUNT_BYTES = 1 << 20


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(lines before, piece): a text cut at line ends into pieces of about COUNT_BYTES; a longer line is a piece of its own."""
    at = before = 0
    while len(text) - at > COUNT_BYTES:
        end = text.rfind(b"\n", at, at + COUNT_BYTES)
        end = text.find(b"\n", at + COUNT_BYTES) if end < 0 else end
        if end < 0:
            break
        yield before, text[at:end]
        before += text.count(b"\n", at, end) + 1
        at = end + 1
    yield before, text[at:]


def _distinct(pieces: list[bytes]) -> np.ndarray:
    """Distinct trigrams of each line of all pieces."""
    points = np.frombuffer((b"\n".join(pieces) + b"\n").decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    ends = points == 10
    line = np.cumsum(ends)
    n_lines = int(line[-1])
    whole = np.flatnonzero(~(ends[:-2] | ends[1:-1] | ends[2:]))
    if not len(whole):
        return np.zeros(n_lines, np.int64)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    code = (np.cumsum(seen) - 1)[points]
    k = int(np.count_nonzero(seen))
    tri = (code[whole] * k + code[whole + 1]) * k + code[whole + 2]  # less than 2 to the 61st
    if n_lines * k**3 < 1 << 63:
        both = np.sort(line[whole] * k**3 + tri)
        first = both[np.diff(both, prepend=-1) != 0] // k**3
    else:
        order = np.lexsort((tri, line[whole]))
        tri, own = tri[order], line[whole][order]
        first = own[(np.diff(tri, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0)]
    return np.bincount(first, minlength=n_lines)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(ids: pa.Array, held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        n = _distinct([p for _, _, p in held])
        sizes = np.array([p.count(b"\n") + 1 for _, _, p in held])
        start = np.cumsum(sizes) - sizes
        line_no = np.arange(len(n)) + np.repeat(np.array([b + 1 for _, b, _ in held]) - start, sizes)
        row = np.repeat(np.array([r for r, _, _ in held]), sizes)
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row[some])), pa.array(line_no[some].astype(np.int32)), pa.array(n[some].astype(np.int64))], ["doc_id", "line_no", "n"])

    for batch in batches:
        held, size = [], 0
        for row, text in enumerate(batch.column(1)):
            for before, piece in _pieces(text.as_py()):
                held.append((row, before, piece))
                size += len(piece) + 1
                if size >= COUNT_BYTES:
                    yield made(batch.column(0), held)
                    held, size = [], 0
        if held:
            yield made(batch.column(0), held)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, n): distinct lower-case trigrams of each line that has any. They are told apart as numbers, many lines at a time; none is made as a string."""
    texts = spread(docs.filter("text is not null").select("doc_id", "text")).select("doc_id", F.lower("text").cast("binary").alias("text"))
    return texts.mapInArrow(_counted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, line_no int, n long")
