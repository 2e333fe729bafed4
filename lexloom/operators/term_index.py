"""Term postings in blocks with upper bounds: BM25 without splitting texts, and the best k without reading most blocks.

A block is a row (term, n, max_tf, min_len, sum_tf, units, tfs, lens) of up to BLOCK postings of a term, those with high counts and short units first, so blocks come in
order of impact: a block's bound is the score of max_tf in a unit of min_len. Bounds are read without the postings. Blocks are dealt to buckets by term; one row of each task (term "")
counts units (n), those with a text (max_tf) and their lengths (sum_tf).

The best k: postings of the blocks with the highest bounds give lower bounds of scores, and their k-th best is a threshold. Terms are put in the order of what they can add; a block whose bound, with the best that the terms before it could add, stays below it can't bring a unit
among the best and isn't read. Units of the blocks that are left, with what unread blocks could add to them, are cut at the threshold again, and the few that remain are looked up.

Defined results: null and empty texts are units without terms; empty ones count for the mean length, as in `ranking.bm25`. Rows with the same ids are units of their own where they are built by one task and one in a sum of scores. No rows in, no scores out.
"""

from __future__ import annotations

import functools
import json
import math
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import split_terms as terms
from lexloom.operators.ranking import K1, B, _is, terms_of, top
from lexloom.operators.segments import ranges_of, spread

BLOCK = 128
#: Bytes of text whose blocks a task makes together.
TEXT_BYTES = 8 << 20
#: Units that are looked up by a broadcast of their ids.
FEW = 100_000
def _schema(ids: Sequence[str]) -> str:
    return f"term string, n int, max_tf int, min_len int, sum_tf long, units array<struct<{', '.join(f'{i}: bigint' for i in ids)}>>, tfs array<int>, lens array<int>"


_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_SMALL = ((_BYTE >= 97) & (_BYTE <= 122)) | ((_BYTE >= 48) & (_BYTE <= 57))


def counted_terms(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of some texts; then, by term and text in order, numbers of the term and the text and how often it occurs there; last how many terms each text has.

    On bytes: letters and digits are ASCII, and a term begins at one that stands behind none or, if it is a capital, behind a small letter or digit.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    upper, small = _UPPER[raw], _SMALL[raw]
    inside = upper | small
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (upper[1:] & small[:-1])
    starts = np.flatnonzero(begin)
    text_ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    text = np.searchsorted(text_ends, starts, side="right")
    letters = np.where(upper, raw + np.uint8(32), raw)[inside]
    offsets = np.append(np.cumsum(inside)[starts] - 1, len(letters)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    both = np.sort(coded.indices.to_numpy().astype(np.int64) * len(texts) + text)
    first = np.flatnonzero(np.diff(both, prepend=-1))
    term, unit = np.divmod(both[first], max(len(texts), 1))
    return [x.decode() for x in coded.dictionary.to_pylist()], term, unit, np.diff(np.append(first, len(both))), np.bincount(text, minlength=len(texts))


def _blocks(ids: Sequence[str]):
    def made(units: list[list[int | None]], texts: list[bytes], nulls: int) -> pa.RecordBatch:
        words, t, u, f, size = counted_terms(texts)
        order = np.lexsort((u, size[u], -f, t))
        t, u, f = t[order], u[order], f[order]
        new = np.flatnonzero(np.diff(t, prepend=-1))
        runs = np.diff(np.append(new, len(t)))
        pieces = -(-runs // BLOCK)
        begin = np.repeat(new, pieces) + (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * BLOCK
        ends = np.append(begin, len(t))
        lists = pa.array(np.append(ends, len(t)).astype(np.int32))  # the last row, of the statistics, has none
        at = pa.array(u)
        columns = [pa.array([x[k] for x in units], pa.int64()).take(at) for k in range(len(ids))]
        least, total = (np.minimum.reduceat(size[u], begin), np.add.reduceat(f, begin)) if len(begin) else (begin, begin)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*(words[i] for i in t[begin].tolist()), ""]), pa.array(np.append(np.diff(ends), len(units)).astype(np.int32)), pa.array(np.append(f[begin], len(units) - nulls).astype(np.int32)),
                pa.array(np.append(least, 0).astype(np.int32)), pa.array(np.append(total, size.sum()).astype(np.int64)),
                pa.ListArray.from_arrays(lists, pa.StructArray.from_arrays(columns, list(ids))), pa.ListArray.from_arrays(lists, pa.array(f.astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(size[u].astype(np.int32))),
            ],
            ["term", "n", "max_tf", "min_len", "sum_tf", "units", "tfs", "lens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, texts, nulls, held = [], [], 0, 0
        for batch in batches:
            for *own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                units.append(own), texts.append(text or b"")
                nulls += text is None
                held += len(texts[-1])
                if held >= TEXT_BYTES:
                    yield made(units, texts, nulls)
                    units, texts, nulls, held = [], [], 0, 0
        if units:
            yield made(units, texts, nulls)

    return run


@dataclass(frozen=True)
class Stats:
    n: int
    mean: float
    df: dict[str, int]

    def idf(self, word: str) -> float:
        df = self.df.get(word, 0)
        return math.log(1 + (self.n - df + 0.5) / (df + 0.5))


def build(units: DataFrame, ids: Sequence[str], path: str, text: str = "text", buckets: int | None = None) -> TermIndex:
    """Indexes units (ids, text) into an empty folder."""
    spark = units.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = spread(units).select(*[F.col(i).cast("long").alias(i) for i in ids], F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(_blocks(ids), _schema(ids))
    blocks = blocks.withColumn("bucket", F.pmod(F.crc32(F.encode("term", "utf-8")), F.lit(buckets)).cast("int"))
    ordered = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term", F.desc("max_tf"), "min_len")
    ordered.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/blocks")
    spark.createDataFrame([(json.dumps({"ids": list(ids), "buckets": buckets}),)], "value string").coalesce(1).write.text(f"{path}/meta")
    return TermIndex(spark, path)


class TermIndex:
    def __init__(self, spark: SparkSession, path: str):
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        self.ids, self.buckets = meta["ids"], meta["buckets"]
        self.table = spark.read.schema(f"{_schema(self.ids)}, bucket int").parquet(f"{path}/blocks")

    def blocks(self, words: Sequence[str]) -> DataFrame:
        """Blocks of some terms; only their buckets are opened."""
        import zlib

        own = sorted({zlib.crc32(w.encode()) % self.buckets for w in words})
        return self.table.filter(F.col("bucket").isin(own) & F.col("term").isin(list(words)))

    def stats(self, words: Sequence[str]) -> Stats:
        """Counts of units and of those with each word: no posting is read, a row for each word comes to the driver."""
        rows = {r["term"]: r for r in self.blocks([*words, ""]).groupBy("term").agg(F.sum("n").alias("n"), F.sum("max_tf").alias("texts"), F.sum("sum_tf").alias("tf")).collect()}
        total = rows.get("")
        n, texts, length = (total["n"], total["texts"], total["tf"]) if total else (0, 0, 0)
        return Stats(n, length / texts if texts else 0.0, {w: rows[w]["n"] for w in words if w in rows})

    def postings(self, words: Sequence[str], blocks: DataFrame | None = None) -> DataFrame:
        """term, ids, tf, len."""
        rows = (self.blocks(words) if blocks is None else blocks).select("term", F.explode(F.arrays_zip("units", "tfs", "lens")).alias("_x"))
        return rows.select("term", *[F.col(f"_x.units.{i}").alias(i) for i in self.ids], F.col("_x.tfs").alias("tf"), F.col("_x.lens").alias("len"))

    def _part(self, s: Stats, words: Sequence[str], tf: str, length: str) -> Column:
        idf = F.create_map(*[F.lit(x) for w in words for x in (w, s.idf(w))])[F.col("term")]
        return self._of(s, idf, F.col(tf).cast("double"), F.col(length).cast("double"))

    def _of(self, s: Stats, idf: Column, tf: Column, length: Column) -> Column:
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(s.mean or 1.0)))

    def bm25(self, query: str) -> DataFrame:
        """ids and score of all units that have a query term, as `ranking.bm25` gives them."""
        words = list(dict.fromkeys(terms_of(query)))
        s = self.stats(words)
        parts = self.postings(words).withColumn("_p", self._part(s, words, "tf", "len"))
        return parts.groupBy(*self.ids).agg(F.round(F.sum("_p"), 6).alias("score")).filter("score > 0")

    def top(self, query: str, k: int, units: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, int]]:
        """The k best of `bm25`, ties by ids, and how many blocks there were and how many were read. units: what was indexed; the texts of a few are looked up."""
        words = list(dict.fromkeys(terms_of(query)))
        s = self.stats(words)
        words = [w for w in words if s.df.get(w)]
        if not words:
            return self.bm25(query).limit(0), {"blocks": 0, "read": 0}
        bounded = self.blocks(words).withColumn("_bound", self._part(s, words, "max_tf", "min_len"))
        # A row for each term.
        per = {r["term"]: r for r in bounded.groupBy("term").agg(F.max("_bound").alias("best"), F.count("*").alias("blocks")).collect()}
        best = {w: per[w]["best"] for w in words}
        # Enough of each term's best blocks for k units: lower bounds of scores, and their k-th best.
        heads = bounded.select("term", "_bound", "n").orderBy(F.desc("_bound")).limit(4 * len(words) + 8 * k // BLOCK).agg(F.min("_bound")).first()[0]
        sums = self._sums(s, words, bounded.filter(F.col("_bound") >= heads))
        kth = [r["low"] for r in sums.orderBy(F.desc("low")).limit(k).select("low").collect()]
        least = (kth[-1] if len(kth) == k else 0.0) - 1e-5  # rounded scores tie
        # Terms from the one that can add least on: a unit is found by the last of its terms in this order, whose block bounds it together with all terms before.
        before, total = {}, 0.0
        for w in sorted(words, key=lambda w: (best[w], w)):
            before[w], total = total, total + best[w]
        needed = F.col("_bound") + F.create_map(*[F.lit(x) for w in words for x in (w, before[w])])[F.col("term")] >= least
        kept = bounded.filter(needed)
        # What unread blocks of a term can add at most.
        unread = {r["term"]: r["m"] for r in bounded.filter(~needed).groupBy("term").agg(F.max("_bound").alias("m")).collect()}
        sums = self._sums(s, words, kept)
        missing = sum((F.when(F.array_contains("seen", w), 0.0).otherwise(unread.get(w, 0.0)) for w in words), F.lit(0.0))
        near = sums.filter(F.col("low") + missing >= least)
        read = {"blocks": sum(per[w]["blocks"] for w in words), "read": kept.count()}
        if not unread:
            return top(near.select(*self.ids, F.round("low", 6).alias("score")), k, self.ids), read
        # What these units have in unread blocks is counted in their texts, of which only theirs are read.
        few = near.select(*self.ids).limit(FEW + 1).collect()
        own = near.select(*self.ids)
        if len(few) <= FEW:
            own = F.broadcast(near.sparkSession.createDataFrame(few, own.schema))
            inside = [F.col(self.ids[0]).between(a, b) for a, b in ranges_of([r[0] for r in few], 32)]
            units = units.filter(functools.reduce(operator.or_, inside, F.lit(False)))
        found = units.join(own, self.ids, "left_semi").select(*self.ids, terms(F.col(text)).alias("_t"))
        score = F.lit(0.0)
        for w in words:
            tf = F.size(F.filter("_t", _is(w))).cast("double")
            score = score + F.when(tf > 0, self._of(s, F.lit(s.idf(w)), tf, F.size("_t").cast("double"))).otherwise(0.0)
        return top(found.select(*self.ids, F.round(score, 6).alias("score")), k, self.ids), read

    def _sums(self, s: Stats, words: Sequence[str], blocks: DataFrame) -> DataFrame:
        parts = self.postings(words, blocks).withColumn("_p", self._part(s, words, "tf", "len"))
        return parts.groupBy(*self.ids).agg(F.sum("_p").alias("low"), F.collect_set("term").alias("seen"))
