"""Near duplicates by order MinHash.

A document's words (letters, digits, underscores; lower case) give k-mers of five words, labelled by their
occurrence, so that repeats count. Each of `orders` random orders picks the `sample` least k-mers, and every `picks` of
these are hashed in the order in which they stand in the text: equal hashes are likely for texts of high edit similarity, not
just of a similar set of words. Texts that share a hash are candidates; a pair is linked if banded alignment
over the words gives a similarity 1 - distance / longer length of at least 0.8.

Texts with the same words are one node. Buckets are formed by each hash. In each
the least node leads and is compared with all others, and links are joined to connected components. Where a bucket then holds
nodes of several components, blocks of its nodes meet the whole bucket in a task, which looks at every pair across components and lists, node by node, those that
lengths and word counts don't show to be unlike. These are aligned where two tiles of nodes meet, unless links found there have joined
them already. So each pair that shares a hash ends up in one component or was found unlike, whoever led; no pair is a row unless it is
compared with a leader or linked.

Defined results: every row gets a class, the least doc_id in its component (null only if all are null), with the class's size and
the links found from the row's words to other words (enough to connect the class, not all there are). Texts
without words are alike only if equal. Rows with the same doc_id are judged each by its text. Extra columns are
kept by `drop_near`, which leaves one row of each class, also of equal rows; names starting with "_nd_" are reserved. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import BROADCAST_ROWS, beside, few_rows, passing, rows_of, save
from lexloom.llm.edit import banded

K = 5
#: Twelve orders of four k-mers: measured recall at the limit of 0.8 is 0.94 or more (README).
ORDERS = 12
SAMPLE = 4
PICKS = 2
SIMILARITY = 0.8
#: Words of members that one alignment task takes on beside the leader's.
TASK_WORDS = 50_000
#: Words are counted in so many cells, whose differences bound a distance from below.
CELLS = 128
#: A bucket's nodes meet in tasks of about so many nodes against the whole bucket.
BLOCK_NODES = 500
#: What may be linked is aligned in tasks of two tiles of about so many nodes.
TILE_NODES = 150
#: What more rows than this share is dealt to several tasks in a join.
HOT_ROWS = 2_000
TOKEN = re.compile(r"\w+")
BLOCK = 1 << 15


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def node_of(text: str | None, words: list[str]) -> bytes:
    raw = " ".join(words) if words else "\0" + (text or "")
    return hashlib.blake2b(raw.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class WordHashes(dict):
    """64-bit hashes of words, kept for a while."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def kmers(hashes: np.ndarray, k: int) -> np.ndarray:
    """Occurrence-labelled hashes of k words in a row; a shorter text is one k-mer."""
    n = len(hashes)
    width = min(k, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0xBF58476D1CE4E5B9) + hashes[i : n - width + 1 + i])
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if not first.all():
        at = np.arange(len(out))
        label = at - np.maximum.accumulate(np.where(first, at, 0))
        out[order] = ranked + label.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    return out


def sketch(hashes: np.ndarray, seeds: np.ndarray, k: int, sample: int, picks: int) -> np.ndarray:
    """Hashes of every `picks` of each seed's `sample` least k-mers; no words give none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    own = kmers(hashes, k)
    sample = min(sample, len(own))
    value, where = np.empty((len(seeds), 0), np.uint64), np.empty((len(seeds), 0), np.int64)
    for begin in range(0, len(own), BLOCK):
        part = own[begin : begin + BLOCK]
        v = (part[None, :] ^ seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        for _ in range(min(sample, len(part))):
            least = v.argmin(axis=1)[:, None]
            value = np.concatenate([value, np.take_along_axis(v, least, 1)], 1)
            where = np.concatenate([where, least + begin], 1)
            np.put_along_axis(v, least, np.uint64(0xFFFFFFFFFFFFFFFF), 1)
        if value.shape[1] > sample:
            least = np.argsort(value, axis=1, kind="stable")[:, :sample]
            value, where = np.take_along_axis(value, least, 1), np.take_along_axis(where, least, 1)
    found = own[np.sort(where, axis=1)]
    out = []
    for some in combinations(range(sample), min(picks, sample)):
        x = seeds.copy()
        for i in some:
            x = mix(x * np.uint64(0xD6E8FEB86659FD93) + found[:, i])
        out.append(x)
    return np.concatenate(out).view(np.int64)


def seeds_of(n: int) -> np.ndarray:
    return mix(mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _sketches(k: int, count: int, sample: int, picks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, table = seeds_of(count), WordHashes()
        for batch in few_rows(batches):
            nodes, sizes, found = [], [], []
            for text in batch.column(1).to_pylist():
                words = tokens(text)
                nodes.append(node_of(text, words))
                sizes.append(len(words))
                found.append(sketch(np.fromiter(map(table.__getitem__, words), np.uint64, len(words)), seeds, k, sample, picks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "node", "n_words", "sketch"])

    return run


def _with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts joined by doc_id, those whose node is the one asked for."""
    for batch in few_rows(batches):
        texts, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        same = [node_of(t, tokens(t)) == n for t, n in zip(texts, wanted, strict=True)]
        kept = batch.filter(pa.array(same, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(1), kept.column(0)], ["node", "text"])


def _align(similarity: float):
    def run(rows: pa.Table) -> pa.Table:
        words = [tokens(t) for t in rows.column("text").to_pylist()]
        leads = rows.column("leads").to_pylist()
        nodes, leaders = rows.column("node").to_pylist(), rows.column("leader").to_pylist()
        head = {nodes[i]: words[i] for i, x in enumerate(leads) if x}
        a, b, ok = [], [], []
        for i, own in enumerate(words):
            if leads[i]:
                continue
            other = head[leaders[i]]
            most = int((1 - similarity) * max(len(own), len(other)) + 1e-9)
            a.append(leaders[i])
            b.append(nodes[i])
            ok.append(banded(own, other, most) is not None)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "linked": pa.array(ok, pa.bool_())})

    return run


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, nid): a bucket for each hash. Half a node's hash stands for it here; two nodes that share it are both taken in the end."""
    return nodes.select("nid", F.explode("sketch").alias("bucket"))


def _named(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(leader, node) for (lead, nid)."""
    of = nodes.select("nid", "node")
    return pairs.join(of, "nid").join(of.select(F.col("nid").alias("lead"), F.col("node").alias("leader")), "lead").select("leader", "node")


def _pairs(nodes: DataFrame) -> DataFrame:
    """(leader, node), once each: in each bucket of two nodes or more the least node leads."""
    buckets = _buckets(nodes)
    heads = buckets.groupBy("bucket").agg(F.min("nid").alias("lead"), F.max("nid").alias("last"), F.count("*").alias("n")).filter("lead != last").drop("last")
    heads = save(nodes.sparkSession, heads, "heads")
    met = beside(buckets, heads.drop("n"), ["bucket"], heads.filter(F.col("n") > HOT_ROWS), F.xxhash64("nid"))
    return _named(met.filter(F.col("nid") != F.col("lead")).select("lead", "nid").distinct(), nodes)


def _aligned(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, linked) for each pair (leader, node)."""
    spark = pairs.sparkSession
    # A leader's members are dealt to as many tasks as their words ask for, each with a copy of the leader's text.
    sized = pairs.join(nodes.select("node", "n_words"), "node")
    parts = sized.groupBy("leader").agg(F.ceil(F.sum("n_words") / TASK_WORDS).cast("int").alias("parts")).filter("parts > 1")
    parts = save(spark, parts, "leaders")  # leaders of large groups only, so pairs need not be brought together by leader
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    members = pairs.join(parts, "leader", "left").select("leader", "node", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(False).alias("leads"))
    heads = members.select("leader", F.col("leader").alias("node"), "part", F.lit(True).alias("leads")).distinct()
    work = members.unionByName(heads).join(texts, "node")
    return save(spark, work.groupBy("leader", "part").applyInArrow(_align(similarity), "a binary, b binary, linked boolean"), "aligned")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, and its words counted by cell (255 at most, which only lowers differences)."""
    table = WordHashes()
    for batch in few_rows(batches):
        found = []
        for text in batch.column(1).to_pylist():
            words = tokens(text)
            cells = np.fromiter(map(table.__getitem__, words), np.uint64, len(words)) % np.uint64(CELLS)
            found.append(np.minimum(np.bincount(cells.astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "counts"])


def _may_link(similarity: float):
    """Of a bucket's nodes, those of a block with the nodes of other components whose lengths and counts leave room for a link, as a list.

    An edit adds one word at most and takes one at most. A pair that shares several buckets is told in the one with the least hash.
    """

    def run(rows: pa.Table) -> pa.Table:
        leads, n, bucket = rows.column("leads").to_numpy(), rows.column("n_words").to_numpy(), rows.column("bucket")[0].as_py()
        nodes, labels = np.array(rows.column("node").to_pylist(), object), np.array(rows.column("label").to_pylist(), object)
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
        sketches = rows.column("sketch").to_pylist()
        own, found = np.flatnonzero(~leads), []
        for i in np.flatnonzero(leads).tolist():
            most = lambda some: ((1 - similarity) * np.maximum(n[some], n[i]) + 1e-9).astype(np.int64)  # noqa: B023, E731
            near = own[(np.abs(n[own] - n[i]) <= most(own)) & (nodes[own] > nodes[i]) & (labels[own] != labels[i])]
            kept: list[bytes] = []
            for at in range(0, len(near), 10_000):
                some = near[at : at + 10_000]
                gap = counts[some] - counts[i]
                apart = np.maximum(np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1))
                lower = {x for x in sketches[i] if x < bucket}
                kept += [nodes[j] for j in some[apart <= most(some)].tolist() if lower.isdisjoint(sketches[j])]
            if kept:
                found.append((nodes[i], b"".join(kept)))
        return rows_of({"leader": pa.binary(), "partners": pa.binary()}, found)

    return run


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = {x for p in batch.column("partners").to_pylist() for x in _split(p)} | set(batch.column("leader").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(every), pa.binary())], ["node"])


def _split(partners: bytes) -> list[bytes]:
    return [partners[i : i + 16] for i in range(0, len(partners), 16)]


def _tile(node: bytes, tiles: int) -> int:
    return int.from_bytes(node[8:16], "little") % tiles


def _tiled(tiles: int):
    """Lists dealt to pairs of tiles of nodes: (x, y, node, text: none, label: none, partners)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for leader, partners in zip(batch.column("leader").to_pylist(), batch.column("partners").to_pylist(), strict=True):
                x, by = _tile(leader, tiles), {}
                for p in _split(partners):
                    by.setdefault(_tile(p, tiles), []).append(p)
                rows += [(min(x, y), max(x, y), leader, None, None, b"".join(own)) for y, own in by.items()]
            yield from rows_of(TILED, rows).to_batches()

    return run


def _copies(tiles: int):
    """Texts dealt to the pairs of tiles that hold their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 100):
            rows = []
            for node, text, label in zip(*(batch.column(c).to_pylist() for c in ("node", "text", "label")), strict=True):
                x = _tile(node, tiles)
                rows += [(min(x, y), max(x, y), node, text, label, None) for y in range(tiles)]
            yield from rows_of(TILED, rows).to_batches()

    return run


TILED = {"x": pa.int32(), "y": pa.int32(), "node": pa.binary(), "text": pa.string(), "label": pa.binary(), "partners": pa.binary()}
TILED_SQL = "x int, y int, node binary, text string, label binary, partners binary"


def _settle(similarity: float):
    """Links between the nodes of two tiles; pairs that are joined by then are passed over."""

    def run(rows: pa.Table) -> pa.Table:
        words, up, lists = {}, {}, []
        for node, text, label, partners in zip(*(rows.column(c).to_pylist() for c in ("node", "text", "label", "partners")), strict=True):
            if partners is None:
                words[node], up[node] = tokens(text), label
            else:
                lists.append((node, partners))

        def root(x: bytes) -> bytes:
            while up.get(x, x) != x:
                x = up[x]
            return x

        found = []
        for leader, partners in sorted(lists):
            for p in _split(partners):
                a, b = root(leader), root(p)
                if a != b and banded(words[leader], words[p], int((1 - similarity) * max(len(words[leader]), len(words[p])) + 1e-9)) is not None:
                    found.append((leader, p, True))
                    up[max(a, b)] = min(a, b)
        return rows_of({"a": pa.binary(), "b": pa.binary(), "linked": pa.bool_()}, found)

    return run


def _open(nodes: DataFrame, aligned: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes that can be in a bucket of several components: leaders that some node was not joined to, and all nodes they met."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    apart = aligned.join(of("a"), "a").join(of("b"), "b").filter("la != lb").select("a").distinct()
    near = aligned.join(apart, "a", "left_semi").select(F.col("b").alias("node")).union(apart).distinct()
    return save(nodes.sparkSession, nodes.join(near, "node").select("node", "nid", "n_words", "sketch"), "open")


def _mixed(near: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, blocks, n, node, nid, n_words, label) for the buckets of several components."""
    spark = near.sparkSession
    own = near.join(labels, "node").withColumn("lid", F.xxhash64("label"))
    buckets = _buckets(own).join(own.drop("sketch"), "nid")
    mixed = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("lid").alias("low"), F.max("lid").alias("high")).filter("n > 2 and low != high")
    mixed = save(spark, mixed.select("bucket", "n", F.ceil(F.col("n") / BLOCK_NODES).cast("int").alias("blocks")), "mixed")
    return beside(buckets, mixed, ["bucket"], mixed.filter(F.col("n") > HOT_ROWS), F.xxhash64("nid")).drop("lid")


def _unsettled(near: DataFrame, labels: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b, linked) of nodes that share a bucket and lie in different components, enough to join all components that any joins."""
    spark = near.sparkSession
    counts = save(spark, texts.join(near.select("node"), "node", "left_semi").mapInArrow(_counted, "node binary, counts binary"), "counts")
    held = _mixed(near, labels).join(counts.join(near.select("node", "sketch"), "node"), "node")
    columns = ["bucket", "block", "node", "n_words", "label", "counts", "sketch"]
    x = held.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).select(*columns, F.lit(True).alias("leads"))
    y = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*columns, F.lit(False).alias("leads"))
    lists = save(spark, x.union(y).groupBy("bucket", "block").applyInArrow(_may_link(similarity), "leader binary, partners binary"), "lists")
    involved = save(spark, lists.mapInArrow(_involved, "node binary").distinct(), "involved")
    tiles = involved.count() // TILE_NODES + 1
    dealt = lists.mapInArrow(_tiled(tiles), TILED_SQL)
    met = dealt.select("x", "y").distinct()
    copies = texts.join(involved, "node").join(labels, "node").mapInArrow(_copies(tiles), TILED_SQL).join(F.broadcast(met) if tiles < 500 else met, ["x", "y"], "left_semi")
    return save(spark, dealt.union(copies).groupBy("x", "y").applyInArrow(_settle(similarity), "a binary, b binary, linked boolean"), "settled")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) of all nodes, with components that links (a, b) join made one. A component's least label is its least node."""
    spark = labels.sparkSession
    of = lambda side, name: labels.select(F.col("node").alias(side), F.col("label").alias(name))
    edges = links.join(of("a", "la"), "a").join(of("b", "lb"), "b").filter("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    new = components(spark, edges).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return save(spark, labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def components(spark, edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of edges (a, b): label is the least node that can be reached.

    Each node points to its least neighbour, if that is less than itself, and then to where such pointers end. Nodes with one end are put together, and of the edges only
    those between ends go on, once each; so a round works on what the one before has left, not on all edges again.
    """
    found = None
    edges = save(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        labels = save(spark, both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
        while True:
            jump = labels.select(F.col("node").alias("target"), F.col("label").alias("beyond"))
            step = save(spark, labels.join(jump, F.col("label") == F.col("target")).select("node", F.col("label").alias("old"), F.col("beyond").alias("label")), "labels")
            labels = step.select("node", "label")
            if step.filter("old != label").isEmpty():
                break
        ends = labels.select(F.col("node").alias("label"), F.col("label").alias("end"))
        found = labels if found is None else save(spark, found.join(ends, "label", "left").select("node", F.coalesce("end", "label").alias("label")), "labels")
        of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))  # noqa: B023, E731
        ahead = edges.join(of("a"), "a").join(of("b"), "b").filter("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
        edges = save(spark, ahead.distinct(), "edges")
        if edges.isEmpty():
            return found


def _nodes(spark, source: DataFrame, k: int, orders: int, sample: int, picks: int) -> tuple[DataFrame, DataFrame]:
    """(node, least, n_docs, n_words, sketch, nid) for each node, and (doc_id, node) for each row. A row's sketch, most of what is written of it, stays until nodes have theirs."""
    with passing(spark) as keep:
        rows = save(spark, source.mapInArrow(_sketches(k, orders, sample, picks), "doc_id long, node binary, n_words long, sketch array<long>"), "sketches")
        nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_docs"), F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"))
        nodes = keep(save(spark, nodes.withColumn("nid", F.expr("cast(conv(hex(substring(node, 1, 8)), 16, -10) as long)")), "nodes"))
        ids = keep(save(spark, rows.select("doc_id", "node"), "ids"))
    return nodes, ids


def _labelled(spark, source: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, n_docs, class_id, class_size, n_links) for each node."""
    pairs = save(spark, _pairs(nodes), "pairs")
    asked = pairs.select("node").union(pairs.select("leader")).distinct().join(nodes.select("node", "least"), "node")
    texts = source.join(asked, F.col("doc_id").eqNullSafe(F.col("least"))).select("text", "node").mapInArrow(_with_node, "node binary, text string")
    texts = save(spark, texts.dropDuplicates(["node"]), "texts")
    aligned = _aligned(pairs, nodes, texts, similarity)
    labels = _joined(nodes.select("node", F.col("node").alias("label")), aligned.filter("linked"))
    near = _open(nodes, aligned, labels)
    rest = _unsettled(near, labels, texts, similarity)
    aligned, labels = aligned.union(rest), _joined(labels, rest)
    labels = nodes.select("node", "least", "n_docs").join(labels, "node")
    links = aligned.filter("linked")
    links = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    labels = save(spark, labels.join(links, "node", "left"), "labelled")
    found = save(spark, labels.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n_docs").alias("class_size"), F.count("*").alias("n_nodes")), "classes")
    labels = beside(labels, found, ["label"], found.filter(F.col("n_nodes") > HOT_ROWS), F.xxhash64("node"))
    return save(spark, labels.select("node", "n_docs", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links")), "node_classes")


def classes(docs: DataFrame, k: int = K, orders: int = ORDERS, sample: int = SAMPLE, picks: int = PICKS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, node (the words' hash), class_id, class_size (documents) and n_links."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with passing(spark) as keep:
        nodes, ids = _nodes(spark, source, k, orders, sample, picks)
        labels = keep(_labelled(spark, source, nodes, similarity))
        keep(ids)
    return beside(ids, labels.drop("n_docs"), ["node"], labels.filter(F.col("n_docs") > HOT_ROWS), F.xxhash64("doc_id")).select("doc_id", "node", "class_id", "class_size", "n_links")


def drop_near(docs: DataFrame, **how) -> DataFrame:
    """The documents with one row of each class left, of the least doc_id."""
    with passing(docs.sparkSession) as keep:
        found = classes(docs, **how)
        one = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id", "node").agg(F.count("*").alias("n"))
        one = one.groupBy("class_id").agg(F.min(F.struct("node", "n")).alias("x"))
        one = keep(save(docs.sparkSession, one.select(F.col("class_id").alias("_nd_id"), F.col("x.node").alias("_nd_node"), F.col("x.n").alias("_nd_n")), "kept"))

    def same(names: list[str]):
        at, text = names.index("_nd_node"), names.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in few_rows(batches):
                texts, wanted = batch.column(text).to_pylist(), batch.column(at).to_pylist()
                yield batch.filter(pa.array([node_of(t, tokens(t)) == n for t, n in zip(texts, wanted, strict=True)], pa.bool_()))

        return run

    def kept(some: DataFrame) -> DataFrame:
        joined = docs.join(some, F.col("doc_id").cast("long").eqNullSafe(F.col("_nd_id")))
        return joined.mapInArrow(same(joined.columns), joined.schema)

    several = one.filter("_nd_n > 1")
    if several.isEmpty():
        return kept(one).drop("_nd_id", "_nd_node", "_nd_n")
    # Equal rows are few: only these are brought together.
    return kept(one.filter("_nd_n = 1")).unionByName(kept(several).dropDuplicates(["_nd_id", "_nd_node"])).drop("_nd_id", "_nd_node", "_nd_n")
