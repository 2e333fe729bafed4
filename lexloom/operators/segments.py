"""A trigram index in segments: compressed posting blocks, deltas with tombstones, compaction. It never changes an answer.

A posting block is a row (tri, first, last, n_docs, n_lines, docs, lines): up to BLOCK_DOCS sorted doc_ids of documents with a trigram, and on how many of their lines it is. Arrays are written with
Parquet's delta encoding, so a gap takes a few bits, and `first` and `last` are skip keys: a query that knows where its candidates are doesn't read other blocks. Blocks are dealt
to buckets by trigram and sorted in each, so a query opens the files of its trigrams only.

A segment is the blocks and the documents (doc_id, fingerprint) of one build; it is never changed. What changes is written beside it: a delta segment with new and edited documents and tombstones
(segment, doc_id) for what they replace. A manifest lists live segments; the one with the highest version counts, so readers see a refresh whole or not at all.
Compaction merges segments without reading texts. The manifest also holds a digest of the source's files, which tells when the index is behind its source.

Trigrams are of lines in lower case, code points, with one form of sigma. Documents with a null id or text aren't indexed: the former are searched by a scan, the latter have no lines.
Rows with the same doc_id are found and refreshed together; counts hold each that a task has not seen before.
"""

from __future__ import annotations

import functools
import json
import operator
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import grams as G
from lexloom.operators.search import SearchSpec, lines, predicate, search

FORMAT = 2
BLOCK_DOCS = 1024
#: Code points of texts that a task looks at together, and pairs of document and trigram that it gathers before it writes blocks.
CHARS, PAIRS = 1 << 19, 1 << 20
#: Bytes of source files for each bucket of trigrams.
BUCKET_BYTES = 16 << 20
#: Candidates whose ids go to all tasks.
FEW = 100_000
#: Candidates of the rarest trigrams that are looked at at once; of more, the other trigrams are met first.
DIRECT = 1_000
#: Ranges of ids that a scan of few candidates is told, so that pages of Parquet without them are not decoded.
RANGES = 32
#: A tree with more trigrams is asked for its rarest only.
MOST_GRAMS = 128
#: Documents of a range of ids whose postings of one trigram are put in order by one task when segments are merged.
RANGE_DOCS = 1 << 20
#: Segments beyond which the small ones are merged, and the share of dead documents from which a segment is.
MOST_SEGMENTS, DEAD_SHARE = 8, 0.25
BLOCKS = "tri string, first long, last long, n_docs int, n_lines long, docs array<long>, lines array<int>"
POINT = np.uint64(0x1FFFFF)


# Blocks


def _pairs(ids: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram as three code points of 21 bits, doc_id, lines): sorted, each pair once."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) < 3:
        return none
    breaks = points == 10
    line = np.cumsum(breaks) - breaks  # a break ends its own line
    n_lines, n_docs = int(line[-1]) + 1, len(texts)
    # Code points as numbers of the characters that occur, so that trigrams are small numbers.
    known = np.unique(points)
    size = len(known)
    letter = np.zeros(int(known[-1]) + 1, np.int64)
    letter[known] = np.arange(size)
    letter = letter[points]
    code = (letter[:-2] * size + letter[1:-1]) * size + letter[2:]
    inside = ~(breaks[:-2] | breaks[1:-1] | breaks[2:])
    code, at = code[inside], line[:-2][inside]
    if not len(code):
        return none
    trigrams = None
    if size**3 * max(n_lines, n_docs) >= 1 << 62:
        trigrams, code = np.unique(code, return_inverse=True)
    most = len(trigrams) if trigrams is not None else size**3
    # Once for each line, then counted for each document.
    at, code = np.divmod(_distinct(np.sort(at * most + code)), most)
    doc_of_line = np.searchsorted(np.cumsum([t.count("\n") + 1 for t in texts]), np.arange(n_lines), side="right")
    both = np.sort(code * n_docs + doc_of_line[at])
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    code, doc = np.divmod(both[first], n_docs)
    code = trigrams[code] if trigrams is not None else code
    part = lambda x: known[x].astype(np.uint64)
    key = (part(code // (size * size)) << np.uint64(42)) | (part(code // size % size) << np.uint64(21)) | part(code % size)
    return key, ids[doc], np.diff(np.append(first, len(both)))


def _distinct(x: np.ndarray) -> np.ndarray:
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _summed(key: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((doc, key))
    key, doc, n = key[order], doc[order], n[order]
    if not len(key):
        return key, doc, n
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
    return key[first], doc[first], np.add.reduceat(n, first)


def _blocks(key: np.ndarray, doc: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of BLOCKS from sorted pairs."""
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(new, len(key)))
    # Each trigram's list is cut every BLOCK_DOCS documents.
    pieces = -(-size // BLOCK_DOCS)
    begin = np.repeat(new, pieces) + (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * BLOCK_DOCS
    ends = np.append(begin[1:], len(key))
    points = key[begin]
    text = np.stack([points >> np.uint64(42), (points >> np.uint64(21)) & POINT, points & POINT], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    tri = pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())
    offsets = pa.array(np.append(begin, len(key)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [tri, pa.array(doc[begin]), pa.array(doc[ends - 1]), pa.array((ends - begin).astype(np.int32)), pa.array(np.add.reduceat(n, begin)), pa.ListArray.from_arrays(offsets, pa.array(doc)), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))],
        [x.split()[0] for x in BLOCKS.split(", ")],
    )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ids, texts, chars, pairs = [], [], 0, 0

    def look() -> int:
        found = _pairs(np.array(ids, np.int64), texts)
        held.append(found)
        ids.clear(), texts.clear()
        return len(found[0])

    def flush() -> pa.RecordBatch:
        parts = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        return _blocks(*_summed(*parts))

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            whole, at = text.as_py(), 0
            while at < len(whole):
                # A very long text is looked at in parts that end with a line where there is one, else overlap by two characters.
                end = min(at + CHARS, len(whole))
                if end < len(whole) and (cut := whole.rfind("\n", at, end)) > at:
                    end = cut + 1
                ids.append(doc_id.as_py()), texts.append(whole[at:end])
                chars += end - at
                at = end if end == len(whole) or whole[end - 1] == "\n" else end - 2
                if chars >= CHARS:
                    pairs, chars = pairs + look(), 0
            if pairs >= PAIRS:  # between two documents of a batch, which may hold many times as many
                if ids:
                    look()
                yield flush()
                pairs, chars = 0, 0
    if ids:
        look()
    if any(len(x[0]) for x in held):
        yield flush()


def posting_blocks(docs: DataFrame) -> DataFrame:
    """Posting blocks of documents (doc_id, text); a trigram has as many as tasks and sizes ask for."""
    own = spread(docs.select("doc_id", "text")).filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.translate(F.lower("text"), "ς", "σ").alias("text"))
    return own.mapInArrow(_build, BLOCKS)


# Segments on disk


@dataclass(frozen=True)
class Segment:
    id: str
    docs: int
    buckets: int
    dead: int = 0


@dataclass(frozen=True)
class Manifest:
    version: int
    segments: list[Segment]
    source: str = ""
    format: int = FORMAT
    #: What the step that wrote it did: reused, added, modified, removed documents.
    did: dict = field(default_factory=dict)
    #: Sets of tombstones of the steps so far. What a step wrote that was never committed is in none.
    tombstones: list[str] = field(default_factory=list)


class Index:
    """An index in a folder that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        last = _latest(spark, path)
        if last.get("format") != FORMAT:
            raise ValueError(f"index of format {last.get('format')}; this reads {FORMAT}")
        self.manifest = Manifest(last["version"], [Segment(**s) for s in last["segments"]], last["source"], last["format"], last["did"], last["tombstones"])

    # What it holds

    def _table(self, kind: str, schema: str, segments: list[Segment] | None = None) -> DataFrame:
        own = self.manifest.segments if segments is None else segments
        read = lambda s: self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{s.id}").withColumn("seg", F.lit(s.id))
        return functools.reduce(DataFrame.unionByName, map(read, own)) if own else self.spark.createDataFrame([], f"{schema}, seg string")

    def blocks(self, trigrams: list[str] | None = None, segments: list[Segment] | None = None) -> DataFrame:
        """Blocks of all trigrams, or of some: only their buckets are opened."""
        out = None
        for s in self.manifest.segments if segments is None else segments:
            one = self.spark.read.schema(f"{BLOCKS}, bucket int").parquet(f"{self.path}/blocks/{s.id}").withColumn("seg", F.lit(s.id))
            if trigrams is not None:
                one = one.filter(F.col("bucket").isin(sorted({bucket_of(t, s.buckets) for t in trigrams})) & F.col("tri").isin(list(trigrams)))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], f"{BLOCKS}, bucket int, seg string")

    def tombstones(self) -> DataFrame | None:
        """(seg, doc_id) of what later segments have replaced; None if nothing is."""
        if not any(s.dead for s in self.manifest.segments):
            return None
        live = [s.id for s in self.manifest.segments]
        sets = [f"{self.path}/tombstones/{t}" for t in self.manifest.tombstones]
        return self.spark.read.schema("doc_id long, seg string").parquet(*sets).filter(F.col("seg").isin(live)).distinct()

    def _alive(self, rows: DataFrame) -> DataFrame:
        dead = self.tombstones()
        return rows if dead is None else rows.join(dead, ["seg", "doc_id"], "left_anti").select(*rows.columns)

    def documents(self) -> DataFrame:
        """(doc_id, print, seg) of all live documents."""
        return self._alive(self._table("docs", "doc_id long, print long"))

    def postings(self, trigrams: list[str] | None = None) -> DataFrame:
        """(tri, doc_id, n_lines) of live documents."""
        rows = self.blocks(trigrams).select("seg", "tri", F.explode(F.arrays_zip("docs", "lines")).alias("_x"))
        rows = rows.select("seg", "tri", F.col("_x.docs").alias("doc_id"), F.col("_x.lines").cast("long").alias("n_lines"))
        return self._alive(rows).drop("seg")

    def counts(self) -> DataFrame:
        """(tri, n_docs, n_lines). Without tombstones that is a sum over blocks; no list is read."""
        rows = self.blocks() if self.tombstones() is None else self.postings().withColumn("n_docs", F.lit(1))
        return rows.groupBy("tri").agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_lines").alias("n_lines"))

    # Queries

    def candidates(self, tree: G.Tree) -> DataFrame | None:
        """doc_id of documents that hold what a tree asks for; None if it asks for nothing."""
        found = self._candidates(tree)
        return self._ids(found) if isinstance(found, list) else found

    def _ids(self, ids: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in ids], "doc_id long")

    def _candidates(self, tree: G.Tree) -> list[int] | DataFrame | None:
        """Documents that hold what a tree asks for, as a list where they are few.

        The tree's rarest trigrams come first: documents with any of them are the candidates. If these are not very few, the other trigrams are met, of which only blocks are read
        whose skip keys enclose candidates, and only candidates are kept.
        """
        every = sorted(G.grams_in(tree))
        if not every:
            return None
        # A row for each trigram that is asked for.
        cost = {r["tri"]: r["n"] for r in self.blocks(every).groupBy("tri").agg(F.sum("n_docs").alias("n")).collect()}
        least, rarest = G.cheapest(tree, cost)
        hits = self._hits(self.blocks(sorted(rarest)))
        found = sorted({r["doc_id"] for r in hits.select("doc_id").collect()}) if least <= FEW else None  # no more than FEW
        rest = sorted(set(every) - rarest)
        if least <= min(DIRECT, FEW):
            return found
        if not rest or len(every) > MOST_GRAMS:
            return found if found is not None else hits.select("doc_id").distinct()
        if found is not None:
            inside = functools.reduce(operator.or_, ((F.col("last") >= a) & (F.col("first") <= b) for a, b in ranges_of(found, RANGES)), F.lit(False))
            hits = hits.unionByName(self._hits(self.blocks(rest).filter(inside)).join(F.broadcast(self._ids(found)), "doc_id", "left_semi"))
        else:
            hits = hits.unionByName(self._hits(self.blocks(rest)))
        has = [F.max(F.col("tri") == g).alias(f"_g{i}") for i, g in enumerate(every)]
        number = {g: i for i, g in enumerate(every)}
        both = hits.groupBy("doc_id").agg(*has).filter(_condition(tree, lambda g: F.col(f"_g{number[g]}"))).select("doc_id")
        return both if found is None else [r["doc_id"] for r in both.collect()]

    def _hits(self, blocks: DataFrame) -> DataFrame:
        return self._alive(blocks.select("seg", "tri", F.explode("docs").alias("doc_id"))).select("tri", "doc_id")

    def search(self, docs: DataFrame, spec: SearchSpec) -> DataFrame:
        """The rows that a scan of docs gives. docs must be what the index was built or refreshed from."""
        near = self.near(docs, tree_of(spec))
        return search(docs, spec) if near is None else search(near, spec)

    def near(self, docs: DataFrame, tree: G.Tree) -> DataFrame | None:
        """The documents that a tree leaves, and those without an id; None if it asks for nothing."""
        ids = self._candidates(tree)
        if ids is None:
            return None
        if not isinstance(ids, list):
            return docs.join(ids, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
        inside = F.expr(" or ".join(["doc_id is null", *(f"doc_id between {a}L and {b}L" for a, b in ranges_of(ids, RANGES))]))
        if len(ids) <= DIRECT:
            return docs.filter(inside).filter(f"doc_id is null or doc_id in ({', '.join(f'{x}L' for x in ids) or 'null'})")
        return docs.filter(inside).join(F.broadcast(self._ids(ids)), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))

    def candidate_lines(self, docs: DataFrame, tree: G.Tree) -> DataFrame | None:
        """(doc_id, line_no) of lines that hold what a tree asks for."""
        near = self.near(docs.select("doc_id", "text"), tree)
        if near is None:
            return None
        low = F.translate(F.lower("line"), "ς", "σ")
        return lines(near).filter(_condition(tree, low.contains)).select("doc_id", "line_no")

    # Changes

    def changes(self, docs: DataFrame) -> DataFrame:
        """(doc_id, seg, change): documents that the source has anew, edited or no more, with the segment of the old version."""
        now, old = prints(docs).alias("n"), self.documents().alias("o")
        joined = now.join(old, F.col("n.doc_id") == F.col("o.doc_id"), "full_outer")
        change = F.when(F.col("o.doc_id").isNull(), "added").when(F.col("n.doc_id").isNull(), "removed").when(F.col("n.print") != F.col("o.print"), "modified").otherwise("same")
        return joined.select(F.coalesce("n.doc_id", "o.doc_id").alias("doc_id"), "o.seg", change.alias("change"))

    def refresh(self, docs: DataFrame, source: str = "") -> Index:
        """The index of docs from this one: only what changed is indexed, only that and tombstones are written. docs: doc_id, text."""
        step = uuid.uuid4().hex
        write(self.changes(docs), f"{self.path}/changes/{step}")
        changes = self.spark.read.schema("doc_id long, seg string, change string").parquet(f"{self.path}/changes/{step}")
        counted = {(r["change"], r["seg"]): r["n"] for r in changes.groupBy("change", "seg").agg(F.count("*").alias("n")).collect()}  # a row a segment and kind
        did = {kind: sum(n for (k, _), n in counted.items() if k == kind) for kind in ("same", "added", "modified", "removed")}
        did["reused"] = did.pop("same")
        segments, tombstones = list(self.manifest.segments), list(self.manifest.tombstones)
        gone = changes.filter("change in ('modified', 'removed')")
        if did["modified"] + did["removed"]:
            write(gone.select("doc_id", "seg"), f"{self.path}/tombstones/{step}")
            tombstones.append(step)
            lost = {s.id: sum(counted.get((k, s.id), 0) for k in ("modified", "removed")) for s in segments}
            segments = [replace(s, dead=s.dead + lost[s.id]) for s in segments]
        if did["added"] + did["modified"]:
            new = changes.filter("change in ('added', 'modified')").select("doc_id")
            n = did["added"] + did["modified"]
            new = F.broadcast(new) if n <= FEW else new
            segments.append(_write_segment(self.path, docs.select("doc_id", "text").join(new, "doc_id", "left_semi")))
        return self._commit([s for s in segments if s.docs > s.dead], source, did, tombstones)

    def compact(self, most: int = MOST_SEGMENTS, dead_share: float = DEAD_SHARE) -> Index:
        """Merges segments with many dead documents, and the smallest ones until there are no more than `most`. Texts aren't read, the others stay as they are."""
        by_size = sorted(self.manifest.segments, key=lambda s: s.docs - s.dead)
        many = len(by_size) - most + 1 if len(by_size) > most else 0
        chosen = [s for i, s in enumerate(by_size) if i < many or s.dead > dead_share * s.docs]
        if not chosen:
            return self
        rest = [s for s in self.manifest.segments if s not in chosen]
        seg = uuid.uuid4().hex
        docs = self._alive(self._table("docs", "doc_id long, print long", chosen)).select("doc_id", "print")
        write(docs, f"{self.path}/docs/{seg}")
        n, low, high = self.spark.read.parquet(f"{self.path}/docs/{seg}").agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
        buckets = max(s.buckets for s in chosen)
        rows = self.blocks(segments=chosen).select("seg", "tri", F.explode(F.arrays_zip("docs", "lines")).alias("_x")).select("seg", "tri", F.col("_x.docs").alias("doc_id"), F.col("_x.lines").alias("line"))
        rows = self._alive(rows).withColumn("bucket", _bucket(F.col("tri"), buckets))
        # Lists are cut anew by the document's place in its trigram's list of a range of ids, so that a trigram that all documents have is dealt to as many tasks as there are ranges.
        width = max(1.0, ((high or 0) - (low or 0) + 1) / max(1, -(-n // RANGE_DOCS)))
        rows = rows.withColumn("_range", F.floor((F.col("doc_id").cast("double") - F.lit(float(low or 0))) / F.lit(width)))
        place = F.row_number().over(Window.partitionBy("bucket", "tri", "_range").orderBy("doc_id")) - 1
        cut = rows.withColumn("_cut", F.floor(place / BLOCK_DOCS)).groupBy("bucket", "tri", "_range", "_cut").agg(F.sort_array(F.collect_list(F.struct("doc_id", "line"))).alias("_p"))
        merged = cut.select(
            "bucket", "tri", F.col("_p")[0]["doc_id"].alias("first"), F.element_at("_p", -1)["doc_id"].alias("last"), F.size("_p").alias("n_docs"),
            F.aggregate("_p", F.lit(0).cast("long"), lambda s, x: s + x["line"]).alias("n_lines"), F.col("_p.doc_id").alias("docs"), F.col("_p.line").alias("lines"),
        )
        _write_blocks(merged, f"{self.path}/blocks/{seg}", buckets)
        return self._commit([*rest, Segment(seg, n, buckets)] if n else rest, self.manifest.source, {**self.manifest.did, "merged": len(chosen)}, self.manifest.tombstones)

    def _commit(self, segments: list[Segment], source: str, did: dict, tombstones: list[str]) -> Index:
        if (now := _latest(self.spark, self.path)["version"]) != self.manifest.version:
            raise ValueError(f"the index has changed since it was opened: version {now}, not {self.manifest.version}")
        tombstones = tombstones if any(s.dead for s in segments) else []
        _commit(self.spark, self.path, Manifest(self.manifest.version + 1, segments, source, FORMAT, did, tombstones))
        return Index(self.spark, self.path)


def _condition(tree: G.Tree, has) -> Column:
    if isinstance(tree, str):
        return has(tree)
    if isinstance(tree, G.Everything):
        return F.lit(True)
    join = operator.and_ if isinstance(tree, G.All) else operator.or_
    return functools.reduce(join, (_condition(p, has) for p in sorted(tree.parts, key=repr)))


def tree_of(spec: SearchSpec) -> G.Tree:
    """What the documents of a search's matching lines must hold: for one of the patterns all of its trigrams."""
    if spec.invert:
        return G.ANY
    one = lambda p: G.of_fixed(p, spec.folds) if spec.fixed else G.of_regex(p, spec.folds, spec.unicode)
    if spec.fixed and spec.folds and spec.unicode and (spec.word or spec.line_regexp):
        one = lambda p: G._narrowed(G.of_literal(p), True, True)
    return G.some_of([one(p) for p in spec.patterns])


def ranges_of(ids: list[int], most: int) -> list[tuple[int, int]]:
    """Up to `most` ranges that hold all ids, cut at the widest gaps."""
    if not ids:
        return []
    x = np.unique(np.array(ids, np.int64))
    gaps = np.diff(x)
    cuts = np.sort(np.argsort(-gaps, kind="stable")[: most - 1]) + 1
    return [(int(p[0]), int(p[-1])) for p in np.split(x, cuts)]


def bucket_of(tri: str, buckets: int) -> int:
    import zlib

    return zlib.crc32(tri.encode("utf-8", "surrogatepass")) % buckets


def _bucket(tri: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(tri, "utf-8")), F.lit(buckets)).cast("int")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it has fewer partitions: files with few row groups are read by few tasks, and what follows is dearer than reading."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of documents with an id and a text; rows with the same id are one."""
    own = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    return own.groupBy("doc_id").agg(F.expr("bit_xor(h)").alias("x"), F.count("*").alias("n")).select("doc_id", F.xxhash64("x", "n").alias("print"))


def source_digest(spark: SparkSession, path: str) -> str:
    """A digest of paths, times and sizes of the files under a path; nothing of them is read, and one row comes to the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    row = files.agg(F.count("*").alias("n"), F.sum("length").alias("b"), F.expr("bit_xor(xxhash64(path, modificationTime, length))").alias("h")).first()
    return f"{row['n']}-{row['b']}-{row['h']}"


def write(table: DataFrame, path: str) -> None:
    table.write.option("compression", "zstd").parquet(path)


def _write_blocks(blocks: DataFrame, path: str, buckets: int) -> None:
    if "bucket" not in blocks.columns:
        blocks = blocks.withColumn("bucket", _bucket(F.col("tri"), buckets))
    # Parquet's second format has delta encoding for numbers; a dictionary would come before it.
    options = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#docs.list.element": "false", "parquet.enable.dictionary#first": "false", "parquet.enable.dictionary#last": "false"}
    blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket", "tri", "first").write.options(**options).partitionBy("bucket").parquet(path)


def _write_segment(path: str, docs: DataFrame) -> Segment:
    seg = uuid.uuid4().hex
    spark = docs.sparkSession
    buckets = max(8, min(1 << 16, -(-_input_bytes(docs) // BUCKET_BYTES)))
    _write_blocks(posting_blocks(docs), f"{path}/blocks/{seg}", buckets)
    write(prints(docs), f"{path}/docs/{seg}")
    return Segment(seg, spark.read.parquet(f"{path}/docs/{seg}").count(), buckets)


def _input_bytes(df: DataFrame) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def _latest(spark: SparkSession, path: str) -> dict:
    return max((json.loads(r[0]) for r in spark.read.text(f"{path}/manifest").collect()), key=lambda m: m["version"])  # a line a version


def _commit(spark: SparkSession, path: str, m: Manifest) -> None:
    body = {"format": m.format, "version": m.version, "source": m.source, "did": m.did, "tombstones": m.tombstones, "segments": [vars(s) for s in m.segments]}
    spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(f"{path}/manifest")


def build(docs: DataFrame, path: str, source: str = "") -> Index:
    """A new index of docs (doc_id, text) in an empty folder."""
    segment = _write_segment(path, docs.select("doc_id", "text"))
    _commit(docs.sparkSession, path, Manifest(1, [segment] if segment.docs else [], source, FORMAT, {"added": segment.docs, "reused": 0, "modified": 0, "removed": 0}))
    return Index(docs.sparkSession, path)


def current(index: Index, docs: DataFrame, source: str) -> Index:
    """An index, brought up to its source if the files of that have changed since, and merged if it has too many segments."""
    return index if index.manifest.source == source else index.refresh(docs, source).compact()
