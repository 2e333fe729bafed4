"""Target-distribution importance resampling: documents drawn as they look like a target corpus, by hashed n-grams of words.

Each task numbers the words of a block of texts and builds their suffix array (`lexloom.llm.word_runs`). Its LCP runs enumerate the n-grams of the
block; each is hashed once, from the hashes of its words, and the bucket is scattered back to its occurrences through the slice of the suffix array. A first pass over the
corpus and one over the target sum occurrences by bucket, which makes the gain of each bucket, as many numbers as there are buckets whatever the
corpus. A second pass sums gains over each document's occurrences. Documents are then drawn without replacement by their weight and
Gumbel noise, which is a number of the document's id, so a draw can be repeated. Ranks come from a sort over all tasks and a sum per task.

Defined results: a null or empty text has no n-grams, weight 0 and is never drawn. A null doc_id is drawn as the empty string and stands before all others
in a tie. Rows with the same doc_id are documents of their own; between rows that are alike in id and score either comes first. With an empty target all gains still are defined, as counts are
smoothed. A text of any length is read in pieces of some megabytes. Extra columns are not carried, whatever their names. No rows in, no rows out.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import few_rows, id_and_text, ranked, save
from lexloom.llm.word_runs import LOWER, SuffixArray, Words, classes, pieces, words_of

BUCKETS = 10_000
LONGEST = 2
#: Bytes of text whose suffix array is built at once.
BLOCK = 8 << 20
#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
KINDS = classes(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
POLYNOMIAL = 0xEDB88320


@functools.cache
def _shift(zeros: int) -> np.ndarray:
    """What so many zero bytes behind a text do to its crc32, as four tables of 256: the crc is linear over bits."""
    one = []  # one zero byte, by bit
    for bit in range(32):
        x = 1 << bit
        for _ in range(8):
            x = (x >> 1) ^ (POLYNOMIAL if x & 1 else 0)
        one.append(x)
    times = lambda m, v: functools.reduce(lambda s, i: s ^ m[i], (i for i in range(32) if v >> i & 1), 0)
    out, power, n = [1 << i for i in range(32)], one, zeros
    while n:
        if n & 1:
            out = [times(power, x) for x in out]
        power, n = [times(power, x) for x in power], n >> 1
    tables = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            half = 1 << bit
            tables[byte, half : 2 * half] = tables[byte, :half] ^ np.uint32(out[8 * byte + bit])
    return tables


def _moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of texts as if `length` zero bytes followed, without the final inversion's part."""
    out = np.empty(len(crc), np.uint32)
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order], prepend=-1))
    for i, j in zip(edges, [*edges, len(order)][1:], strict=True):
        at = order[i:j]
        t, c = _shift(int(length[at[0]])), crc[at]
        out[at] = t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
    return out


def _word_hashes(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 of each distinct word, of a blank and the word, and the length of the latter."""
    words = w.words.to_pylist()
    blank = zlib.crc32(b" ")
    return (
        np.fromiter((zlib.crc32(x) for x in words), np.uint32, len(words)),
        np.fromiter((zlib.crc32(x, blank) for x in words), np.uint32, len(words)),
        np.fromiter((len(x) + 1 for x in words), np.int64, len(words)),
    )


def bucket_runs(w: Words, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, SuffixArray]]:
    """For each length of n-grams: bucket, begin and end in the suffix array of each LCP run, and the array."""
    array = SuffixArray(w, longest)
    plain, spaced, size = _word_hashes(w)
    for k in range(1, longest + 1):
        runs = array.runs(k)
        crc = plain[w.ids[runs.first]] if len(runs.first) else np.zeros(0, np.uint32)
        for j in range(1, k):
            nxt = w.ids[runs.first + j]
            crc = _moved(crc, size[nxt]) ^ spaced[nxt]
        yield crc % np.uint32(buckets), runs, k, array


def _blocks(batches: Iterator[pa.RecordBatch], longest: int, size: int) -> Iterator[tuple[list[tuple[int, bytes]], list[int], list]]:
    """Pieces of texts, about `size` bytes together; the row of each, and the ids of the rows begun so far but not told."""
    held: list[tuple[int, bytes]] = []
    rows: list[int] = []
    ids: list = []
    total = 0
    for batch in few_rows(batches):
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            for part in pieces(text.as_buffer().to_pybytes(), KINDS, longest):
                held.append(part)
                rows.append(len(ids) - 1)
                total += len(part[1])
                if total >= size:
                    yield held, rows, ids
                    held, rows, total = [], [], 0
    yield held, rows, ids


def _count(longest: int, buckets: int):
    """Occurrences by bucket, one row a task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for held, _, ids in _blocks(batches, longest, BLOCK):
            for bucket, runs, _, _ in bucket_runs(words_of(held, KINDS), longest, buckets):
                np.add.at(total, bucket, runs.count)
            ids.clear()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of up to `longest` words fall in each bucket; no more rows than buckets."""
    counted = docs.select(F.lit(0).alias("x"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t")).mapInArrow(_count(longest, buckets), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * log of how much more frequent a bucket is in the target), both smoothed by one a bucket, in doubles."""
    buckets = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def _weigh(gains: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ids: list = []
        sums, counts, words = (np.zeros(0, np.int64) for _ in range(3))
        for held, rows, ids in _blocks(batches, longest, BLOCK):
            w = words_of(held, KINDS)
            row_of = np.array(rows, np.int64)[w.piece] if rows else np.zeros(0, np.int64)
            grow = [np.zeros(len(ids) - len(sums), np.int64)]
            sums, counts, words = (np.concatenate([x, *grow]) for x in (sums, counts, words))
            own = np.zeros(len(w.ids), np.int64)
            features = np.zeros(len(w.ids), np.int64)
            for bucket, runs, k, array in bucket_runs(w, longest, len(gains)):
                # A run's bucket goes to all its occurrences: its slice of the suffix array.
                size = runs.end - runs.begin
                before = np.cumsum(size) - size
                where = array.order[np.arange(int(size.sum())) - np.repeat(before - runs.begin, size)]
                here = array.counts_here(k)[where]
                own[where] += np.where(here, np.repeat(gains[bucket], size), 0)
                features[where] += here
            np.add.at(sums, row_of, own)
            np.add.at(counts, row_of, features)
            np.add.at(words, row_of, w.old == 0)
            # All but the last row are done with; that one's text may go on.
            done = len(ids) - 1 if rows else len(ids)
            if done > 0:
                yield _told(ids[:done], counts[:done], words[:done], sums[:done])
                sums, counts, words = sums[done:], counts[done:], words[done:]
                del ids[:done]
            open_ids = ids
        if open_ids:
            yield _told(open_ids, counts, words, sums)

    return run


def _told(ids: list, counts: np.ndarray, words: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    mean = np.where(counts > 0, sums // np.maximum(counts, 1), 0)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts), pa.array(words), pa.array(mean)], ["doc_id", "n_features", "n_words", "weight"])


def weights(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, n_words, weight: the floored mean of gains over a document's n-grams."""
    spark = docs.sparkSession
    sides = []
    for name, table in (("corpus", docs), ("target", target)):
        total = np.zeros(buckets, np.int64)
        for r in bucket_counts(table, longest, buckets).collect():  # a row a bucket at most
            total[r["bucket"]] = r["n"]
        sides.append(total)
    d = id_and_text(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    weighed = d.mapInArrow(_weigh(gains_of(*sides), longest), "doc_id long, n_features long, n_words long, weight long")
    return save(spark, weighed, "weights")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank: rank of the drawn documents, null for the others.

    Of the documents with at least `least_words` words, `percent` in a hundred (floored) with the highest scores are drawn: weight plus Gumbel noise in thousandths.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weights(docs, target, longest, buckets).withColumn("score", F.col("weight") + noise)
    fit = scored.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    placed = ranked(fit, [F.desc("score"), F.asc_nulls_first("doc_id")], "rank")
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)
