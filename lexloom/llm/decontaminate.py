"""Benchmark decontamination: documents that hold a benchmark item with few edits.

An item of n words may be off by `budget` = floor(rate * n) words. It is split into budget + 1 pieces: whatever
the edits, one piece is hit exactly (pigeonhole). An automaton finds all piece hits in a pass over each
document, and around each hit Myers' bit-parallel distance verifies the whole item.

Words are runs of letters, digits and underscores, in lower case; punctuation, symbols and case don't count.
Items are read in blocks of bounded size, each of which goes over all documents, so no table has to be small: the driver and each
executor hold one block at a time.

Defined results: a null or empty text holds nothing; an item with no words is never found. A null item_id stays null. Rows with the same doc_id give
a row each, equal items too. Of several places the first of the least distance counts, and of stretches that end there the shortest. Extra columns
are not carried by `leaks` and stay in `drop_leaked`. No documents or no items, no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import few_rows, id_and_text, save
from lexloom.llm.edit import best_in, start_of

RATE = 0.15
#: Characters of benchmark text that a block, which every task holds, may have.
BLOCK_CHARS = 8_000_000
TOKEN = re.compile(r"\w+")
HITS = "doc_id long, item_id long, distance int, start_word long, end_word long, item_words int"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def budget(n: int, rate: float) -> int:
    return int(rate * n)


def pieces(words: list[str], rate: float) -> list[tuple[int, list[str]]]:
    """(first word, words) of budget + 1 pieces of nearly equal length."""
    n = len(words)
    k = min(n, budget(n, rate) + 1)
    cuts = [n * i // k for i in range(k + 1)]
    return [(cuts[i], words[cuts[i] : cuts[i + 1]]) for i in range(k)]


def find_items(words: list[str], automaton, items: list[tuple[int, list[str]]], rate: float) -> list[tuple[int, int, int, int, int]]:
    """(item_id, distance, first word, word after the last, item's words) of the best place of each item found."""
    joined = f" {' '.join(words)} "
    best: dict[int, tuple[int, int, int]] = {}
    tried: set[tuple[int, int]] = set()
    counted, at = 0, 0
    for end, hits in automaton.iter(joined):
        counted += joined.count(" ", at, end)  # end is the space after the piece
        at = end
        for item, first, n in hits:
            start = counted - n - first
            if (item, start) in tried:
                continue
            tried.add((item, start))
            pattern = items[item][1]
            most = budget(len(pattern), rate)
            low = max(0, start - most)
            found = best_in(pattern, words[low : start + len(pattern) + most], most)
            if found and (item not in best or found[0] < best[item][0]):
                best[item] = (found[0], low, low + found[1])
    for item, (d, low, end) in best.items():
        best[item] = (d, low + start_of(items[item][1], words[low:end], end - low, d), end)
    return [(items[i][0], d, a, b, len(items[i][1])) for i, (d, a, b) in sorted(best.items())]


def _search(items, rate: float):
    """items: a broadcast list of (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        own = [(i, w) for i, t in items.value if (w := tokens(t))]
        hits: dict[str, list[tuple[int, int, int]]] = {}
        for at, (_, words) in enumerate(own):
            for first, piece in pieces(words, rate):
                hits.setdefault(f" {' '.join(piece)} ", []).append((at, first, len(piece)))
        automaton = ahocorasick.Automaton()
        for piece, where in hits.items():
            automaton.add_word(piece, where)
        if hits:
            automaton.make_automaton()
        for batch in few_rows(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hits and (words := tokens(text)):
                    rows += [(doc_id, *x) for x in find_items(words, automaton, own, rate)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "start_word", "end_word", "item_words"])

    return run


def _blocks(benchmark: DataFrame, most: int) -> Iterator[tuple[list[tuple[int | None, str]], bool]]:
    """Items in blocks of bounded size, one at a time, and whether it is the only one."""
    block, size, first = [], 0, True
    for row in benchmark.select(F.col("item_id").cast("long"), "text").filter("text != ''").toLocalIterator():
        if block and size + len(row[1]) > most:
            yield block, False
            block, size, first = [], 0, False
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block, first


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, distance, start_word, end_word, item_words."""
    spark = docs.sparkSession
    source = id_and_text(docs)
    out: DataFrame | None = None
    for block, only in _blocks(benchmark, block_chars):
        held = spark.sparkContext.broadcast(block)
        found = source.mapInArrow(_search(held, rate), HITS)
        if only:
            return found
        # With many blocks the driver and the executors hold one at a time.
        found = save(spark, found, "leaks")
        held.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, with their columns. Nothing is shuffled unless items fill several blocks; then names that begin with "_dc_" are reserved."""
    spark = docs.sparkSession
    hashes: DataFrame | None = None
    for block, only in _blocks(benchmark, block_chars):
        held = spark.sparkContext.broadcast(block)
        if only:
            return docs.mapInArrow(_flag(held, rate, docs.columns.index("text"), False), docs.schema)
        found = docs.select("text").mapInArrow(_flag(held, rate, 0, True), "text string").select(F.xxhash64("text").alias("_dc_a"), F.xxhash64(F.reverse("text")).alias("_dc_b"))
        found = save(spark, found.distinct(), "leaked")
        held.unpersist()
        hashes = found if hashes is None else hashes.unionByName(found)
    return docs.join(hashes.distinct(), (F.xxhash64("text") == F.col("_dc_a")) & (F.xxhash64(F.reverse("text")) == F.col("_dc_b")), "left_anti")


def _flag(items, rate: float, at: int, leaked: bool):
    """Rows that hold an item, or those that hold none."""
    search = _search(items, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def numbered() -> Iterator[pa.RecordBatch]:
            for batch in few_rows(batches):
                waiting.append(batch)
                yield pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], ["doc_id", "text"])

        for hits in search(numbered()):
            batch = waiting.pop()
            found = set(hits.column(0).to_pylist())
            yield batch.filter(pa.array([(i in found) == leaked for i in range(batch.num_rows)], pa.bool_()))

    return run
