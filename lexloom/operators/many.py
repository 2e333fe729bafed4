"""Thousands of patterns at once: each is looked for only where its rarest n-gram stands.

A pattern's key is one of its n-grams of up to GRAM bytes, the one that is rarest in a sample of the texts (which only decides how much is verified, never what is found). Texts are hashed by a rolling
window for each length of keys, positions whose hash is a key's are met with the patterns of that key, and these are compared byte by byte. So the work is one pass over the texts and what is verified,
whatever the number of patterns; none of them is an expression of the plan. Patterns are worked off in blocks of bounded size, each a pass.

Defined results: null texts have no lines; a pattern with a line break matches none, an empty one all lines. Equal patterns are found under each of their ids. Rows with the same doc_id are searched each.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import required_literal
from lexloom.operators import rules as R
from lexloom.operators.search import lines
from lexloom.operators.shared import checkpointed

GRAM = 6
#: Bytes of patterns that a pass takes to all tasks.
PATTERN_BYTES = 8 << 20
#: Bytes of text that are looked at together, and pairs of place and pattern that are compared together.
TEXT_BYTES, PAIRS = 1 << 20, 1 << 18
#: Documents of the sample that tells which n-grams are rare.
SAMPLE = 200
ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(raw: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n bytes in a row: below nine bytes, the bytes themselves."""
    if len(raw) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(raw) - n + 1, np.uint64)
    for i in range(n):
        out |= raw[i : len(raw) - n + 1 + i].astype(np.uint64) << np.uint64(8 * i)
    return out * ODD


class Router:
    """Patterns by the hash of their key: for each length of keys the sorted hashes, and which patterns each has."""

    def __init__(self, patterns: Sequence[tuple[int, bytes]], sample: bytes):
        self.ids = np.array([i for i, _ in patterns], np.int64)
        self.size = np.array([len(p) for _, p in patterns], np.int64)
        self.raw = np.frombuffer(b"".join(p for _, p in patterns), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        seen = np.frombuffer(sample, np.uint8)
        self.by_size = []
        widths = np.minimum(self.size, GRAM)
        for n in sorted(set(widths.tolist()) - {0}):
            own = np.flatnonzero(widths == n)
            grams, places = np.unique(_hashes(seen, n), return_counts=True) if len(seen) >= n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keys, offsets = np.zeros(len(own), np.uint64), np.zeros(len(own), np.int64)
            for j, k in enumerate(own.tolist()):
                mine = _hashes(self.raw[self.at[k] : self.at[k] + self.size[k]], n)
                where = np.minimum(np.searchsorted(grams, mine), max(len(grams) - 1, 0))
                often = np.where(grams[where] == mine, places[where], 0) if len(grams) else np.zeros(len(mine), np.int64)
                offsets[j] = int(np.argmin(often))
                keys[j] = mine[offsets[j]]
            order = np.argsort(keys, kind="stable")
            known, first = np.unique(keys[order], return_index=True)
            self.by_size.append((n, known, np.append(first, len(own)), own[order], offsets[order]))

    def hits(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, patterns) of all occurrences."""
        for n, known, cuts, pattern, offset in self.by_size:
            h = _hashes(raw, n)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            place = np.flatnonzero(known[at] == h)
            group = at[place]
            many = cuts[group + 1] - cuts[group]
            # In parts of bounded size, whatever a frequent key has.
            part = (np.cumsum(many) - 1) // PAIRS
            edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(place)]))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                m = many[i:j]
                before = np.cumsum(m) - m
                index = np.arange(int(m.sum())) - np.repeat(before - cuts[group[i:j]], m)
                yield self._equal(raw, np.repeat(place[i:j], m) - offset[index], pattern[index])

    def _equal(self, raw: np.ndarray, start: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = (start >= 0) & (start + self.size[pattern] <= len(raw))
        start, pattern = start[inside], pattern[inside]
        size = self.size[pattern]
        left = np.arange(len(start))
        # The next byte of all that are still alike, up to the longest.
        for i in range(int(size.max(initial=0))):
            left = left[(size[left] <= i) | (raw[np.minimum(start[left] + i, len(raw) - 1)] == self.raw[np.minimum(self.at[pattern[left]] + i, len(self.raw) - 1)])]
            if not len(left):
                break
        return start[left], pattern[left]


def _find(router: Router) -> Callable:
    overlap = int(router.size.max(initial=1)) - 1

    def parts(text: bytes) -> Iterator[tuple[int, bytes]]:
        """(line on which a part begins, bytes): cut behind a line where there is one, else overlapping by the longest pattern."""
        at, line = 0, 0
        while at < len(text):
            end = min(at + TEXT_BYTES + overlap, len(text))
            if end < len(text) and (cut := text.rfind(b"\n", at, end)) >= at:
                end = cut + 1
            yield line, text[at:end]
            step = end if end == len(text) or text[end - 1 : end] == b"\n" else end - overlap
            line, at = line + text.count(b"\n", at, step), step

    def look(held: list[tuple[int, int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        raw = np.frombuffer(b"\n".join(x for _, _, x in held) + b"\n", np.uint8)
        breaks = np.flatnonzero(raw == 10)
        ends = np.cumsum([len(x) + 1 for _, _, x in held])
        first_line = np.searchsorted(breaks, ends - np.array([len(x) + 1 for _, _, x in held]))
        row = np.array([r for r, _, _ in held])
        base = np.array([b for _, b, _ in held])
        for place, pattern in router.hits(raw):
            # Within a line: no pattern holds a break.
            owner = np.searchsorted(ends, place, side="right")
            yield row[owner], base[owner] + np.searchsorted(breaks, place) - first_line[owner] + 1, pattern

    def told(ids: list, found: list) -> pa.RecordBatch:
        row, line, pattern = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        rows = np.unique(np.stack([row, line, pattern], 1).astype(np.int64), axis=0) if len(row) else np.zeros((0, 3), np.int64)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows[:, 0].tolist()], pa.int64()), pa.array(rows[:, 1].astype(np.int32)), pa.array(router.ids[rows[:, 2]])], ["doc_id", "line_no", "pattern_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, found, size = batch.column(0).to_pylist(), [], [], 0
            for row, text in enumerate(batch.column(1)):
                for base, part in parts(text.as_buffer().to_pybytes()):
                    held.append((row, base, part))
                    size += len(part)
                    if size >= TEXT_BYTES:
                        found += look(held)
                        held, size = [], 0
            if held:
                found += look(held)
            yield told(ids, found)

    return run


def _blocks(patterns: Sequence[str]) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    for i, p in enumerate(patterns):
        if p and "\n" not in p:
            held.append((i, p.encode()))
            size += len(held[-1][1])
        if size >= PATTERN_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def match_many(docs: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(doc_id, line_no, pattern_id): the lines that hold a fixed pattern; pattern_id is its place in the sequence, from 0."""
    own = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sample = b"\n".join(bytes(r[0])[:5000] for r in own.select("text").limit(SAMPLE).collect())
    schema = "doc_id long, line_no int, pattern_id long"
    passes = [own.mapInArrow(_find(Router(block, sample)), schema) for block in _blocks(patterns)]
    if empty := [i for i, p in enumerate(patterns) if not p]:
        passes.append(lines(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "line_no", F.explode(F.array(*[F.lit(i).cast("long") for i in empty])).alias("pattern_id")))
    return functools.reduce(DataFrame.unionByName, passes) if passes else docs.sparkSession.createDataFrame([], schema)


def match_rules(docs: DataFrame, rules: tuple[R.Rule, ...]) -> DataFrame:
    """The rows of `rules.match_rules` for hundreds of rules: a rule meets only lines that hold the literal that one of its patterns needs. Rules with a pattern that needs none are tested on all lines."""
    asked: list[tuple[R.Rule, str, str]] = []
    rest = []
    for rule in rules:
        literals = [required_literal(p) for p in rule.patterns]
        if all(literals):
            asked += [(rule, p, x) for p, x in zip(rule.patterns, literals, strict=True)]
        else:
            rest.append(rule)
    out = []
    if asked:
        spark = docs.sparkSession
        table = spark.createDataFrame([(i, r.id, r.severity, p) for i, (r, p, _) in enumerate(asked)], "pattern_id long, rule_id string, severity string, pattern string")
        # Met twice: once for the documents that are split again, once for their lines.
        found = checkpointed(match_many(docs, [x for _, _, x in asked])).join(F.broadcast(table), "pattern_id")
        near = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
        hits = lines(near).join(found, ["doc_id", "line_no"]).filter(F.expr("line rlike pattern"))
        out.append(hits.select("rule_id", "severity", "doc_id", "line_no", "line").distinct())
    if rest:
        out.append(R.match_rules(docs, tuple(rest)))
    return functools.reduce(DataFrame.unionByName, out)
