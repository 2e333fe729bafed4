"""Phrase collocations: runs of words that occur together more often than their parts alone, per language.

Texts are dealt to shards in pieces. A shard numbers its words and builds their suffix array by prefix doubling (`lexloom.llm.word_runs`); its LCP intervals
are the distinct n-grams with their counts. Counts are merged globally by key, in two rounds: first n-grams of one and two words, then longer ones, of which
only those are sent whose pairs of neighbours are frequent everywhere, as no phrase is more frequent than a part of it. Keys are 64-bit hashes there, which can only count too much: each shard is told
which of its keys reach the threshold, and those phrases are counted once more by their text, exactly. What is frequent grows with the corpus, so it is never
broadcast: it goes back to the shards that have it. Scores, parts and longer phrases meet in joins; parts that very many phrases have are dealt to several tasks.

Defined results: a null text is empty, a null language is `und` (together with rows that say so). Phrases don't cross pieces, rows or languages. Rows with equal ids or texts all count. A text of any length is dealt in pieces of some
megabytes that overlap by the words before; each n-gram is counted in one of them. Extra columns are not carried, whatever their names. No rows in, no rows out; a language without a phrase that is frequent enough has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import BROADCAST_ROWS, DEAL_BYTES, Blob, beside, few_rows, planes, ranked, rows_of, save, shard_count, unplanes
from lexloom.llm.word_runs import SuffixArray, Words, classes, mixed, pieces, words_of

LONGEST = 4
LEAST = 30
TOP = 2000
KINDS = classes(b" \t", b".,;:!?\n\x0b\x0c\r")
U = np.uint64
#: A part that more phrases than this have is dealt to several tasks.
HOT_PARTS = 10_000
WORDS = "lang string, phrase string, size int, n long"


# Dealing


def _deal(shards: int, longest: int):
    """Pieces of texts by shard, compressed together. A piece's shard is a hash of itself and its place, so copies spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[str, int, bytes]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = sorted(held)
            blobs = [_packed(held[k]) for k in keys]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

        nth = 0
        for batch in few_rows(batches):
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                for at, (old, part) in enumerate(pieces(text.as_buffer().to_pybytes(), KINDS, longest)):
                    shard = xxhash.xxh3_64_intdigest(part[:256] + b"%d %d" % (at, nth)) % shards
                    held.setdefault(shard, []).append((lang.as_py(), old, part))
                    size += len(part)
                    if size >= DEAL_BYTES:
                        yield flush()
                        size = 0
                nth += 1
        if held:
            yield flush()

    return run


def _packed(parts: list[tuple[str, int, bytes]]) -> bytes:
    langs = sorted({x[0] for x in parts})
    number = {x: i for i, x in enumerate(langs)}
    names = json.dumps(langs).encode()
    sizes = np.array([(number[x[0]], x[1], len(x[2])) for x in parts], np.int64).reshape(-1, 3)
    return Blob.pack(np.frombuffer(names, np.uint8), sizes, np.frombuffer(b"".join(x[2] for x in parts), np.uint8))


def _shard(blobs: list[bytes]) -> tuple[list[str], list[tuple[int, bytes]], np.ndarray]:
    """Languages, pieces and the language of each piece."""
    langs: dict[str, int] = {}
    parts, of = [], []
    for blob in blobs:
        names, sizes, raw = Blob.unpack(blob, np.uint8, np.int64, np.uint8)
        own = json.loads(names.tobytes())
        at, text = 0, raw.tobytes()
        for lang, old, size in sizes.reshape(-1, 3).tolist():
            of.append(langs.setdefault(own[lang], len(langs)))
            parts.append((old, text[at : at + size]))
            at += size
    return list(langs), parts, np.array(of, np.int64)


# N-grams of a shard


class Shard:
    """Words of one shard. Words of different languages have different ids (word times languages plus language), so all counts are by language."""

    def __init__(self, blobs: list[bytes], longest: int):
        self.langs, parts, of = _shard(blobs)
        w = words_of(parts, KINDS)
        self.words = w.words
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in w.words.to_pylist()), U, len(w.words))
        seeds = np.fromiter((xxhash.xxh3_64_intdigest(b"lang " + x.encode()) for x in self.langs), U, len(self.langs))
        self.key1 = mixed((hashes[:, None] ^ seeds[None, :]).ravel())
        ids = w.ids * len(self.langs) + of[w.piece] if len(w.ids) else w.ids
        self.w = Words(ids, w.words, w.piece, w.room, w.old)
        self.array = SuffixArray(self.w, longest)

    def keys(self, first: np.ndarray, k: int) -> np.ndarray:
        """A hash of the n-grams of k words that begin at these positions."""
        key = self.key1[self.w.ids[first]]
        for j in range(1, k):
            key = mixed(key * U(0xD6E8FEB86659FD93) + self.key1[self.w.ids[first + j]])
        return mixed(key + U(k))

    def frequent(self, k: int, known: np.ndarray) -> np.ndarray:
        """Of each position, whether an n-gram of k words whose key is known begins there. known: sorted."""
        out = np.zeros(len(self.w.ids), bool)
        runs = self.array.runs(k, known=True)
        hit = _among(self.keys(runs.first, k), known)
        begin, size = runs.begin[hit], (runs.end - runs.begin)[hit]
        before = np.cumsum(size) - size
        out[self.array.order[np.arange(int(size.sum())) - np.repeat(before - begin, size)]] = True
        return out


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _told(table: pa.Table | None) -> np.ndarray:
    """Keys that the buckets told a shard, sorted."""
    found = [Blob.unpack(x, U)[0] for x in table.column("blob").to_pylist()] if table is not None else []
    return np.sort(np.concatenate(found)) if found else np.zeros(0, U)


def _cuts(keys: np.ndarray, buckets: int) -> list[int]:
    """Where each bucket begins and ends in sorted keys: buckets are ranges of keys, so a sort by key is one by bucket."""
    edges = np.array([-(-(i << 64) // buckets) for i in range(buckets)], dtype=object).astype(U)
    return [*np.searchsorted(keys, edges).tolist(), len(keys)]


def _sent(shard: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """Keys and counts by bucket."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    cuts = _cuts(keys, buckets)
    rows = [(b, shard, Blob.pack(keys[i:j], planes(counts[i:j]))) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
    return rows_of({"bucket": pa.int32(), "shard": pa.int32(), "blob": pa.binary()}, rows)


def _ask(sizes: tuple[int, ...], longest: int, buckets: int):
    """A shard's n-grams of these sizes; longer than two words only where all pairs in them are frequent."""

    def run(rows: pa.Table, told: pa.Table | None) -> pa.Table:
        keys, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        number = 0
        if rows.num_rows:
            number = rows.column("shard")[0].as_py()
            shard = Shard(rows.column("blob").to_pylist(), max(sizes))
            pairs = shard.frequent(2, _told(told)) if max(sizes) > 2 else None
            for k in sizes:
                # What a piece has from the one before is asked for, too: longer n-grams begin there.
                runs = shard.array.runs(k, known=k == 2)
                keep = np.ones(len(runs.first), bool)
                for j in range(k - 1 if k > 2 else 0):
                    keep &= pairs[runs.first + j]
                keys.append(shard.keys(runs.first[keep], k))
                counts.append(runs.count[keep])
        return _sent(number, np.concatenate(keys), np.concatenate(counts), buckets)

    return run


def _merge(least: int):
    """For each shard, those of its keys whose counts sum to the threshold over all shards."""

    def run(rows: pa.Table) -> pa.Table:
        shards = rows.column("shard").to_pylist()
        keys, counts = [], []
        for blob in rows.column("blob").to_pylist():
            key, count = Blob.unpack(blob, U, np.uint8)
            keys.append(key)
            counts.append(unplanes(count))
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key)
        key, count = key[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        known = key[first][np.add.reduceat(count, first) >= least]
        out = [(shard, Blob.pack(own[hit])) for shard, own in zip(shards, keys, strict=True) if (hit := _among(own, known)).any()]
        return rows_of({"shard": pa.int32(), "blob": pa.binary()}, out)

    return run


def _count(sizes: tuple[int, ...], longest: int, buckets: int):
    """A shard's counts of the phrases it was told, with their text, and of all its words (size 0), by bucket."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows:
            shard = Shard(rows.column("blob").to_pylist(), longest)
            known, many, ids = _told(told), len(shard.langs), shard.w.ids
            names = np.frombuffer(json.dumps(shard.langs).encode(), np.uint8)
            total = np.bincount(ids[shard.array.counts_here(1)] % many, minlength=many)
            out.append((0, Blob.pack(names, np.arange(many), np.zeros(many, np.int64), total, np.zeros(many, np.int64), np.zeros(0, np.uint8))))
            for k in sizes:
                runs = shard.array.runs(k)
                keys = shard.keys(runs.first, k)
                hit = np.flatnonzero(_among(keys, known))
                hit = hit[np.argsort(keys[hit])]
                first, count = runs.first[hit], runs.count[hit]
                columns = [shard.words.take(pa.array(ids[first + j] // many)) for j in range(k)]
                text = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())) if len(first) else pa.array([], pa.large_binary())
                ends = np.frombuffer(text.buffers()[1], np.int64)[: len(first) + 1] if len(first) else np.zeros(1, np.int64)
                raw = np.frombuffer(text.buffers()[2], np.uint8) if len(first) else np.zeros(0, np.uint8)
                cuts = _cuts(keys[hit], buckets)
                for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if j > i:
                        out.append((b, Blob.pack(names, ids[first[i:j]] % many, np.full(j - i, k), count[i:j], np.diff(ends[i : j + 1]), raw[ends[i] : ends[j]])))
        return rows_of({"bucket": pa.int32(), "blob": pa.binary()}, out)

    return run


def _sum_texts(least: int):
    """Counts by language and text over all shards: exact, whatever keys are alike."""

    def run(rows: pa.Table) -> pa.Table:
        parts = []
        for blob in rows.column("blob").to_pylist():
            names, lang, size, count, length, raw = Blob.unpack(blob, np.uint8, np.int64, np.int64, np.int64, np.int64, np.uint8)
            offsets = np.concatenate(([0], np.cumsum(length)))
            text = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            langs = pa.array(json.loads(names.tobytes()), pa.string()).take(pa.array(lang))
            parts.append(pa.table({"lang": langs, "phrase": text, "size": pa.array(size, pa.int32()), "n": pa.array(count)}))
        found = pa.concat_tables(parts).group_by(["lang", "phrase", "size"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "size", "n"])
        found = found.filter(pc.or_(pc.equal(found["size"], 0), pc.greater_equal(found["n"], least)))
        return found.set_column(1, "phrase", found["phrase"].cast(pa.large_string()).cast(pa.string()))

    return run


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, size, n): all phrases of 1 to `longest` words with n >= least, and for each language a row of size 0 with its number of words."""
    spark = docs.sparkSession
    shards = shard_count(docs, 2)
    buckets = max(8, shards // 4)
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    dealt = own.mapInArrow(_deal(shards, longest), "shard int, blob binary")
    by_bucket, by_shard = "bucket int, shard int, blob binary", "shard int, blob binary"
    short, long = tuple(range(1, min(longest, 2) + 1)), tuple(range(3, longest + 1))
    ask = _ask(short, longest, buckets)
    asked = dealt.groupBy("shard").applyInArrow(lambda rows: ask(rows, None), by_bucket)
    told = save(spark, asked.groupBy("bucket").applyInArrow(_merge(least), by_shard), "frequent")
    if long:
        asked = dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_ask(long, longest, buckets), by_bucket)
        told = told.unionByName(save(spark, asked.groupBy("bucket").applyInArrow(_merge(least), by_shard), "frequent"))
    counted = dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_count(short + long, longest, buckets), "bucket int, blob binary")
    return counted.groupBy("bucket").applyInArrow(_sum_texts(least), WORDS)


# Scores


def _words(phrase: Column, begin, length) -> Column:
    return F.concat_ws(" ", F.slice(F.split(phrase, " "), begin, length))


def _exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def scored(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, size, a, l, r, score of every phrase of two words or more: of its cuts the one with the lowest score, ties to the shortest first part."""
    phrases = counts.filter("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"))
    parts = counts.filter("size >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n"))
    if longest <= 1:
        return phrases.selectExpr("*", "a as l", "a as r", "0L as score").limit(0)
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    sides = F.array(
        F.struct(F.lit("l").alias("side"), _words(F.col("phrase"), F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), _words(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")).alias("part")),
    )
    asked = cuts.withColumn("_x", F.explode(sides)).select("lang", "phrase", "size", "a", "k", "_x.side", "_x.part")
    hot = asked.groupBy("lang", "part").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_PARTS)
    found = beside(asked, parts, ["lang", "part"], hot, F.xxhash64("phrase"))
    by_cut = found.groupBy("lang", "phrase", "size", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("part_n"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("part_n"))).alias("r"))
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = by_cut.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    return best.select("lang", "phrase", "size", "a", "_b.l", "_b.r", "_b.score")


def kept(phrases: DataFrame, percent: int = 80) -> DataFrame:
    """Phrases without those that lie inside a longer one with `percent` in a hundred of their occurrences."""
    inner = F.expr("flatten(transform(sequence(2, greatest(size - 1, 2)), m -> transform(sequence(1, size - m + 1), i -> concat_ws(' ', slice(split(phrase, ' '), i, m)))))")
    longer = phrases.filter("size >= 3").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("_longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    inside = F.col("_longer").isNotNull() & (_exact(F.col("_longer")) * 100 >= _exact(F.col("a")) * percent)
    return phrases.join(most, ["lang", "phrase"], "left").filter(~inside).drop("_longer")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language, by score, count and text. docs: text, lang."""
    spark = docs.sparkSession
    counts = save(spark, phrase_counts(docs, longest, least), "phrases")
    best = kept(save(spark, scored(counts, longest), "scored"))
    # A place in one order over all phrases, less that of the language's first: no task holds a language.
    placed = ranked(best, [F.asc("lang"), F.desc("score"), F.desc("a"), F.asc("phrase")], "_place")
    heads = placed.groupBy("lang").agg((F.min("_place") - 1).alias("_head"))
    heads = save(spark, heads.join(counts.filter("size = 0").select("lang", "n"), "lang"), "langs")
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads
    found = placed.join(heads, "lang").withColumn("rank", F.col("_place") - F.col("_head")).filter(F.col("rank") <= top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
