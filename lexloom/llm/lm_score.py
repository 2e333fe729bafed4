"""LM scoring with a probabilistic suffix tree over words.

Symbols are words and one end per document. There are thought to be as many words not seen in training as there are words seen
once, each as likely as one of those. States are contexts of
one to three preceding words (a text is preceded by BEGINs). A context that occurs twice or more is retained if what follows
it diverges from what its longest retained suffix expects: the sum over next symbols of n * ln(share / expected), less
ln(1 / expected) for the first occurrence of each, which any context would show, must exceed `least_gain`. A state's distribution is
smoothed with that of its longest retained suffix (Witten-Bell). A token is scored in its longest retained state. Probabilities are kept as logs in steps of 1/1024 bit, so that a
score is a sum of whole numbers and depends neither on the order of work nor on how it is dealt.

All training tokens are counted, and what is gathered grows with them: the tree is never in one place. Documents are dealt to
shards. First each shard sends its distinct words to the words' buckets and gets their counts and numbers back. Then every
occurrence goes with its context to the bucket of the context's last word: the subtree of contexts that end
with a word lies in one bucket, which decides on its nodes level by level and answers with a probability for each occurrence.
Equal occurrences of a shard are sent once. A word, or pair of words, that makes up more than a small part of all tokens would be too
much for one bucket. Such contexts are named by a sample (which moves work and changes no result) and are bounded in number;
their counts are summed by next word, and what lies deeper is dealt by one more word.

Defined results: a null text is empty and has its end token alone. A null doc_id counts as an empty id text when
held-out documents are chosen. Rows with the same doc_id are scored each. Without training documents counts are 0 and every token
is unknown, with probability 1. Extra columns are not carried. No rows in, no rows out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import NO_ID, Blob, deal, few_rows, id_and_text, planes, rows_of, save, shard_count, unplanes

DEPTH = 3
#: Divergence, in nats, that a context needs beyond the first occurrence of each next symbol.
LEAST_GAIN = 3.0
#: Documents read to name contexts that are too large for one bucket.
SAMPLE_DOCS = 20_000
#: Occurrences that a bucket looks at together.
PART = 300_000
#: Steps of a kept logarithm in a bit.
STEPS = 1024
BEGIN, END = b"", b"\n"
U = np.uint64
ODD, ODD2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def held_out(doc_id: int | None, folds: int = 10) -> bool:
    return zlib.crc32(str("" if doc_id in (None, NO_ID) else doc_id).encode()) % folds == 0


def words_of(text: bytes) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII only, as the rule asks."""
    return text.lower().split()


def code_of(p: np.ndarray) -> np.ndarray:
    """Probabilities as whole steps of -log2."""
    return np.minimum(np.rint(-np.log2(p) * STEPS), 65534).astype(np.int64)


def value_of(code: np.ndarray) -> np.ndarray:
    return np.exp2(code / -STEPS)


def witten_bell(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The suffix's distribution weighs as much as there are different next symbols."""
    return (n + kinds * below) / np.maximum(total + kinds, 1)


def gain_of(n: np.ndarray, total: np.ndarray, below: np.ndarray) -> np.ndarray:
    """What each next symbol adds to its context's divergence; nothing if it never follows."""
    n, seen = np.maximum(n, 1), n > 0
    return np.where(seen, n * np.log(n / np.maximum(total, 1)) - (n - 1) * np.log(below), 0.0)


class Hot:
    """Contexts of one and two words that are dealt by next word, by number from 1 on; parent: the number of the suffix, 0 is the root."""

    def __init__(self, found: list[bytes]):
        ones = sorted(x[1:] for x in found if x.startswith(END))
        self.one = {w: i + 1 for i, w in enumerate(ones)}
        pairs = (tuple(x.split(END)) for x in found if not x.startswith(END))
        codes = sorted(self.one[a] << 31 | self.one[b] for a, b in pairs if a in self.one and b in self.one)
        self.two = np.array(codes, np.int64)
        self.parent = np.zeros(1 + len(ones) + len(codes), np.int64)
        self.parent[1 + len(ones) :] = self.two & 0x7FFFFFFF
        self.depth = np.concatenate([[0], np.full(len(ones), 1), np.full(len(codes), 2)]).astype(np.int64)

    def before(self, words: list[bytes], at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The longest of these contexts before each of the tokens `own` of the sequence `at`."""
        ids = np.array([self.one.get(w, 0) for w in words], np.int64)[at]
        a, b = ids[own - 2], ids[own - 1]
        if not len(self.two):
            return b
        code = a << 31 | b
        where = np.minimum(np.searchsorted(self.two, code), len(self.two) - 1)
        return np.where((self.two[where] == code) & (a > 0), 1 + len(self.one) + where, b)


def hot_contexts(docs: DataFrame, buckets: int) -> Hot:
    """Contexts that hold more than a quarter of a bucket's even share in a sample: at most 8 * buckets."""
    source = id_and_text(docs)
    rows = source.count()
    if rows > SAMPLE_DOCS:
        source = source.sample(SAMPLE_DOCS / rows, seed=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            words: list[bytes] = []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words += (BEGIN, *words_of(text))
            ones, twos = Counter(words), Counter(zip(words, words[1:], strict=False))
            # Some batch has every context that is hot in all of them.
            ones = {b"\n" + w: n for w, n in ones.items() if n * 16 * buckets > len(words)}
            ones |= {a + b"\n" + b: n for (a, b), n in twos.items() if a and b and n * 16 * buckets > len(words)}
            yield pa.RecordBatch.from_arrays([pa.array([*ones, b""], pa.binary()), pa.array([*ones.values(), len(words)], pa.int64())], ["context", "n"])

    counted = source.select("text").mapInArrow(count, "context binary, n long").groupBy("context").agg(F.sum("n").alias("n"))
    found = {bytes(c): n for c, n in counted.orderBy(F.desc("n"), "context").limit(16 * buckets + 1).collect()}
    total = found.pop(b"", 0)
    return Hot([c for c, n in found.items() if n * 4 * buckets > total])


class Shard:
    """A shard's tokens: words (each once, BEGIN and END first), the sequence `at` of their places with BEGINs before each document, the tokens `own` in it.

    Arrow splits and numbers the words: its ASCII functions know the same blanks and letters as the rule.
    """

    def __init__(self, blobs: list[bytes]):
        parts = [Blob.unpack(blob, np.int64, np.int64, np.uint8) for blob in sorted(blobs)]
        ids, lengths, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.ids = ids.tolist()
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        texts = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
        flat = split.flatten()
        counts = np.diff(split.offsets.to_numpy())
        empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        found = flat.dictionary_encode()
        codes = found.indices.to_numpy()[~empty].astype(np.int64)
        # A text without words is split into one empty word.
        blank = np.flatnonzero(counts == 1)
        counts[blank] -= empty[split.offsets.to_numpy()[blank]]
        self.words = [BEGIN, END, *found.dictionary.cast(pa.large_binary()).to_pylist()]
        self.sizes = counts.astype(np.int64) + 1
        starts = np.cumsum(self.sizes + DEPTH) - self.sizes
        self.at = np.zeros(int(self.sizes.sum()) + DEPTH * len(ids), np.int64)
        token = np.ones(len(self.at), bool)
        for i in range(1, DEPTH + 1):
            token[starts - i] = False
        self.own = np.flatnonzero(token)
        ends = starts + self.sizes - 1
        token[ends] = False
        self.at[ends] = 1
        self.at[token] = codes + 2
        self.train = np.repeat([not held_out(i) for i in self.ids], self.sizes)

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The words' places by bucket, and where each bucket begins. BEGIN is no token."""
        bucket = np.fromiter((zlib.crc32(w) % buckets if w else buckets for w in self.words), np.int64, len(self.words))
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))

    def pairs(self, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each token's hot context; the different (place, context) with one, ascending, and which of them each such token is."""
        context = hot.before(self.words, self.at, self.own)
        behind = np.flatnonzero(context)
        which, code = factorize(self.at[self.own[behind]] * len(hot.parent) + context[behind])
        order = np.argsort(code)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return context, behind, code[order], place[which]


def _ask(hot, buckets: int):
    """A shard's words, by bucket, with training counts, and the hot contexts before them, with theirs."""
    kinds = {"bucket": pa.int32(), "shard": pa.int32(), "words": pa.binary(), "blob": pa.binary()}

    def run(rows: pa.Table) -> pa.Table:
        s = Shard(rows.column("blob").to_pylist())
        n = np.bincount(s.at[s.own], s.train, len(s.words)).astype(np.int64)
        _, behind, code, which = s.pairs(hot.value)
        m = np.bincount(which, s.train[behind], len(code)).astype(np.int64)
        word, context = code // len(hot.value.parent), code % len(hot.value.parent)
        begin = np.searchsorted(word, np.arange(len(s.words) + 1))
        order, cuts = s.dealt(buckets)
        shard, out = rows.column("shard")[0].as_py(), []
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if j > i:
                own = order[i:j]
                sizes = begin[own + 1] - begin[own]
                at = ranges(begin[own], sizes)
                raw = np.frombuffer(b" ".join([s.words[k] for k in own.tolist()]), np.uint8)
                out.append((b, shard, Blob.pack(raw), Blob.pack(planes(n[own]), planes(sizes), planes(context[at]), planes(m[at]))))
        return rows_of(kinds, out)

    return run


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start .. start + length - 1, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(lengths.sum())) + np.repeat(starts - (ends - lengths), lengths)


def factorize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the values in the order of their first occurrence, and the values."""
    found = pa.array(x).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy()


def sums(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    which, found = factorize(code)
    order = np.argsort(found)
    return found[order], np.bincount(which, n, len(found)).astype(np.int64)[order]


def _merge(hot):
    """A bucket's words with the counts of all shards, and each shard's words and pairs by their places in it; one row."""
    kinds = {"bucket": pa.int32(), "state": pa.binary(), "shards": pa.list_(pa.int32()), "asked": pa.list_(pa.binary())}

    def run(rows: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        parts = []
        width = len(hot.value.parent)
        order = np.argsort(rows.column("shard").to_numpy(), kind="stable").tolist()
        shards, names, blobs = (rows.column(x).to_pylist() for x in ("shard", "words", "blob"))
        for i in order:
            own = Blob.unpack(names[i], np.uint8)[0].tobytes().split(b" ")
            at = np.fromiter((place.setdefault(w, len(place)) for w in own), np.int64, len(own))
            n, sizes, context, m = map(unplanes, Blob.unpack(blobs[i], *[np.uint8] * 4))
            parts.append((at, n, np.repeat(at, sizes) * width + context, m))
        at, n, code, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        count = np.bincount(at, n, len(place)).astype(np.int64)
        # Up from pairs of words to one word; every code that is asked for stays, if with 0.
        up = hot.value.parent[code % width]
        two = up > 0
        code, m = sums(np.concatenate([code, code[two] // width * width + up[two]]), np.concatenate([m, m[two]]))
        ends = place.get(END, -1) + 1
        state = Blob.pack(planes(count), planes(code), planes(m), planes(np.array([ends])))
        return rows_of(kinds, [(rows.column("bucket")[0].as_py(), state, [shards[i] for i in order], [Blob.pack(planes(a), planes(c)) for a, _, c, _ in parts])])

    return run


class Bucket:
    """The counts of a bucket's words, and by (word, hot context), parents included."""

    def __init__(self, state: bytes, hot: Hot):
        self.count, self.code, self.n, _ = map(unplanes, Blob.unpack(state, *[np.uint8] * 4))
        self.word, self.context = self.code // len(hot.parent), self.code % len(hot.parent)
        self.parent = hot.parent[self.context]
        self.above = np.searchsorted(self.code, self.code - self.context + self.parent)

    def below(self, model: Model, upto: int, hot: Hot) -> np.ndarray:
        """Code of each (word, context) in its longest retained context of at most `upto` words."""
        code = model.root(self.count)[self.word]
        for depth in range(1, upto + 1):
            at = np.flatnonzero((hot.depth[self.context] == depth) & model.keep[self.context])
            up = np.flatnonzero(hot.depth[self.context] > depth - 1)
            if depth == 2:
                code[up] = code[self.above[up]]
            c = self.context[at]
            code[at] = code_of(witten_bell(self.n[at], model.n[c], model.kinds[c], value_of(code[at])))
        if upto == 1:
            two = np.flatnonzero(hot.depth[self.context] == 2)
            code[two] = code[self.above[two]]
        return code


class Model:
    """Totals: of all tokens, of hot contexts, and which of those are retained."""

    def __init__(self, size: int, totals: list[tuple[int, int, int]]):
        self.n, self.kinds, self.keep = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
        self.once = 0
        for context, n, kinds in totals:
            if context >= 0:
                self.n[context], self.kinds[context] = n, kinds
            else:
                self.once = n

    def root(self, count: np.ndarray) -> np.ndarray:
        return code_of(np.maximum(count, 1) / (self.n[0] + max(self.once, 1)))


def _class(count: np.ndarray) -> np.ndarray:
    """Words are numbered by class, most frequent first: numbers then need few bytes."""
    return 63 - np.frexp(np.maximum(count, 0).astype(np.float64))[1]


def _totals(hot):
    """By context: tokens behind it and kinds. Context 0: all tokens and kinds; -1: words seen once. Also, by bucket, its words of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = Bucket(state, hot.value)
                n = np.bincount(b.context, b.n, len(hot.value.parent)).astype(np.int64)
                kinds = np.bincount(b.context[b.n > 0], minlength=len(n))
                n[0], kinds[0] = b.count.sum(), (b.count > 0).sum()
                at = np.flatnonzero(kinds)
                by_class = np.bincount(_class(b.count), minlength=64)
                some = np.flatnonzero(by_class)
                columns = [[-1] * (len(at) + 1) + [bucket] * len(some), [*at.tolist(), -1, *some.tolist()], [*n[at].tolist(), int((b.count == 1).sum()), *by_class[some].tolist()], [*kinds[at].tolist(), 0, *([0] * len(some))]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["bucket", "context", "n", "kinds"])

    return run


def _gains(hot, model, depth: int):
    """By hot context of so many words, a bucket's part of the divergence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hot.value
        for batch in batches:
            for state in batch.column(1).to_pylist():
                b = Bucket(state, own)
                below = value_of(b.below(model.value, depth - 1, own))
                at = np.flatnonzero((own.depth[b.context] == depth) & (b.n > 0))
                part = gain_of(b.n[at], model.value.n[b.context[at]], below[at])
                gain = np.bincount(b.context[at], part, len(own.parent))
                found = np.flatnonzero(np.bincount(b.context[at], minlength=len(own.parent)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(gain[found], pa.float64())], ["context", "gain"])

    return run


def _tell(hot, model, offsets):
    """Back to each shard: counts and numbers of its words, and codes of its words behind hot contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, state, shards, asked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                b = Bucket(state, hot.value)
                code = b.below(model.value, 2, hot.value)
                kind = _class(b.count)
                order = np.argsort(kind, kind="stable")
                number = np.empty(len(order), np.int64)
                number[order] = np.arange(len(order))
                by_class = np.searchsorted(kind[order], np.arange(64))
                number += offsets.value[bucket][kind] - by_class[kind]
                out = []
                for shard, blob in zip(shards, asked, strict=True):
                    at, pairs = map(unplanes, Blob.unpack(blob, np.uint8, np.uint8))
                    out.append((shard, bucket, 0, Blob.pack(planes(b.count[at]), planes(number[at]), planes(code[np.searchsorted(b.code, pairs)]))))
                yield from rows_of(TOLD, out).to_batches()

    return run


TOLD = {"shard": pa.int32(), "bucket": pa.int32(), "step": pa.int32(), "blob": pa.binary()}
TOLD_SQL = "shard int, bucket int, step int, blob binary"


class Occurrences:
    """A shard's tokens with their contexts of DEPTH words, in the order in which they are sent; behind hot pairs equal ones once."""

    def __init__(self, blobs: list[bytes], told: list[tuple[int, bytes]], hot: Hot, model: Model, word_buckets: int, buckets: int):
        s = self.shard = Shard(blobs)
        order, cuts = s.dealt(word_buckets)
        self.count, number = np.zeros(len(s.words), np.int64), np.zeros(len(s.words), np.int64)
        context, behind, code, which = s.pairs(hot)
        begin = np.searchsorted(code // len(hot.parent), np.arange(len(s.words) + 1))
        known = np.zeros(len(code), np.int64)
        for b, blob in told:
            own = order[cuts[b] : cuts[b + 1]]
            self.count[own], number[own], codes = map(unplanes, Blob.unpack(blob, *[np.uint8] * 3))
            known[ranges(begin[own], begin[own + 1] - begin[own])] = codes
        # 0 is BEGIN.
        number[order[: cuts[-1]]] += 1
        below = model.root(self.count)[s.at[s.own]]
        below[behind] = known[which]
        depth = hot.depth[context]
        self.all_below = below
        deep = depth == 2
        # A word that occurs once in training is no context; what follows it stays here.
        flat = np.flatnonzero(~deep & ((depth > 0) | (self.count[s.at[s.own - 1]] >= 2) | (s.at[s.own - 1] == 0)))
        deep = np.flatnonzero(deep)
        # Behind a hot pair a passage that very many texts share would meet itself; a shard sends it once.
        same, first = np.zeros(0, np.int64), deep
        if len(deep):
            at = s.own[deep]
            same, _ = factorize(context[deep] * len(s.words) + s.at[at - DEPTH])
            same, kinds = factorize(same * len(s.words) + s.at[at])
            first = np.empty(len(kinds), np.int64)
            first[same[::-1]] = deep[::-1]
        first = np.concatenate([flat, first])
        self.which = np.full(len(s.own), -1)
        self.which[flat], self.which[deep] = np.arange(len(flat)), len(flat) + same
        at, self.depth, self.below = s.own[first], depth[first], below[first]
        self.next, self.path = number[s.at[at]], [number[s.at[at - i]] for i in range(1, DEPTH + 1)]
        bucket = (dealt_key(self.path, self.depth) >> U(20)) % U(buckets)
        order = np.argsort(bucket << U(40) | self.path[0].astype(U) & U(0xFFFFFFFFFF), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sent = self.which >= 0
        self.which[sent] = place[self.which[sent]]
        self.n = np.bincount(self.which[sent], s.train[sent], len(first)).astype(np.int64)
        self.next, self.depth, self.below, self.path = self.next[order], self.depth[order], self.below[order], [x[order] for x in self.path]
        self.cuts = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(U))


def dealt_key(path: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
    """What is dealt together: contexts that share the hot context, of `depth` words, and one word more."""
    key = mix(path[0].astype(U))
    for i in (1, 2):
        deeper = np.flatnonzero(depth >= i)
        key[deeper] = mix(key[deeper] * ODD2 + path[i][deeper].astype(U))
    return key


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * ODD
    return x ^ x >> U(29)


def _split(told: pa.Table, step: int) -> list[tuple[int, bytes]]:
    rows = zip(*(told.column(x).to_pylist() for x in ("bucket", "step", "blob")), strict=True)
    return sorted((b, blob) for b, s, blob in rows if s == step)


def _send(hot, model, word_buckets: int, buckets: int):
    """Occurrences to their buckets."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows:
            o = Occurrences(rows.column("blob").to_pylist(), _split(told, 0), hot.value, model.value, word_buckets, buckets)
            shard = rows.column("shard")[0].as_py()
            for b, (i, j) in enumerate(zip(o.cuts[:-1].tolist(), o.cuts[1:].tolist(), strict=True)):
                if j > i:
                    out.append((b, shard, Blob.pack(*(planes(x[i:j]) for x in (*o.path, o.next, o.n, o.depth, o.below)))))
        return rows_of({"bucket": pa.int32(), "shard": pa.int32(), "blob": pa.binary()}, out)

    return run


def subtree(path: list[np.ndarray], following: np.ndarray, n: np.ndarray, depth: np.ndarray, below: np.ndarray, least_gain: float) -> np.ndarray:
    """Codes of occurrences in their longest retained context; below: their codes in the context of `depth` words."""
    code, alive = below.copy(), np.arange(len(n))
    context = np.zeros(len(n), np.int64)
    for level in range(1, DEPTH + 1):
        context, _ = factorize(context << 32 | path[level - 1][alive])
        total = np.bincount(context, n[alive])
        # A context that occurs once has no deeper one that occurs twice.
        stay = np.flatnonzero((total[context] >= 2) | (depth[alive] >= level))
        alive, context = alive[stay], context[stay]
        at = np.flatnonzero(depth[alive] < level)
        own = alive[at]
        if not len(own):
            continue
        pair, pairs = factorize(context[at] << 32 | following[own])
        of = pairs >> 32
        count = np.bincount(pair, n[own])
        old = np.empty(len(pairs), np.int64)
        old[pair] = code[own]
        expected = value_of(old)
        kinds = np.bincount(of[count > 0], minlength=len(total))
        gain = np.bincount(of, gain_of(count, total[of], expected), len(total))
        better = code_of(witten_bell(count, total[of], kinds[of], expected))
        code[own] = np.where(gain[of] > least_gain, better, old)[pair]
    return code


def _solve(least_gain: float):
    """The bucket's answer to each shard, occurrence by occurrence."""

    def run(rows: pa.Table) -> pa.Table:
        bucket, shards, blobs = rows.column("bucket")[0].as_py(), rows.column("shard").to_pylist(), rows.column("blob").to_pylist()
        columns: list[list[np.ndarray]] = [[] for _ in range(DEPTH + 4)]
        for x in blobs:
            for column, part in zip(columns, Blob.unpack(x, *[np.uint8] * (DEPTH + 4)), strict=True):
                column.append(unplanes(part).astype(np.uint32))
        sizes = [len(x) for x in columns[0]]
        del blobs, rows
        *path, following, n, depth, below = (np.concatenate(columns.pop(0)) for _ in range(DEPTH + 4))
        several = len(n) // PART + 1
        part = (dealt_key(path, depth) >> U(5)) % U(several)
        code = np.empty(len(n), np.int64)
        for p in range(several):
            at = np.flatnonzero(part == p)
            code[at] = subtree([x[at].astype(np.int64) for x in path], following[at].astype(np.int64), n[at].astype(np.int64), depth[at], below[at].astype(np.int64), least_gain)
        out, at = [], 0
        for shard, size in zip(shards, sizes, strict=True):
            out.append((shard, bucket, 1, Blob.pack(planes(code[at : at + size]))))
            at += size
        return rows_of(TOLD, out)

    return run


def _score(hot, model, word_buckets: int, buckets: int):
    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows_of(kinds, [])
        own = model.value
        o = Occurrences(rows.column("blob").to_pylist(), _split(told, 0), hot.value, own, word_buckets, buckets)
        answers = [unplanes(Blob.unpack(blob, np.uint8)[0]) for _, blob in _split(told, 1)]
        sent = np.flatnonzero(o.which >= 0)
        code = o.all_below.copy()
        code[sent] = np.concatenate([np.zeros(0, np.int64), *answers])[o.which[sent]]
        s = o.shard
        count = o.count[s.at[s.own]]
        base = np.log10((o.count + 0.1) / (own.n[0] + 0.1 * (own.kinds[0] + 1)))[s.at[s.own]]
        first = np.cumsum(s.sizes) - s.sizes
        known, base, score = (np.add.reduceat(x, first).tolist() for x in ((count > 0).astype(np.int64), base, code))
        ids = [None if i == NO_ID else i for i in s.ids]
        return rows_of(kinds, [(i, held_out(i), n, k, int(own.n[0]), b, c * (-np.log10(2) / STEPS)) for i, n, k, b, c in zip(ids, s.sizes.tolist(), known, base, score, strict=True)])

    return run


def score(docs: DataFrame, least_gain: float = LEAST_GAIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    spark = docs.sparkSession
    shards, buckets = shard_count(docs, 2), shard_count(docs, 1)
    share = spark.sparkContext.broadcast
    hot = share(hot_contexts(docs, buckets))
    dealt = deal(docs, shards)
    asked = dealt.groupBy("shard").applyInArrow(_ask(hot, buckets), "bucket int, shard int, words binary, blob binary")
    merged = save(spark, asked.groupBy("bucket").applyInArrow(_merge(hot), "bucket int, state binary, shards array<int>, asked array<binary>"), "words")
    totals = merged.mapInArrow(_totals(hot), "bucket int, context long, n long, kinds long").groupBy("bucket", "context").agg(F.sum("n"), F.sum("kinds")).collect()
    own = Model(len(hot.value.parent), [tuple(r)[1:] for r in totals if r[0] < 0])
    if sum(r[2] for r in totals if r[0] >= 0) >= (1 << 32) - 1:
        raise ValueError("words are numbered with 32 bits")
    by_class = np.zeros((64, buckets), np.int64)
    for bucket, kind, n, _ in totals:
        if bucket >= 0:
            by_class[kind, bucket] = n
    offsets = share((np.cumsum(by_class).reshape(by_class.shape) - by_class).T.copy())
    for depth in (1, 2):
        gains = merged.mapInArrow(_gains(hot, share(own), depth), "context long, gain double").groupBy("context").agg(F.sum("gain")).collect()
        for context, gain in gains:
            own.keep[context] = own.n[context] >= 2 and gain > least_gain
    model = share(own)
    told = merged.mapInArrow(_tell(hot, model, offsets), TOLD_SQL)
    sent = dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_send(hot, model, buckets, buckets), "bucket int, shard int, blob binary")
    answers = sent.groupBy("bucket").applyInArrow(_solve(least_gain), TOLD_SQL)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("shard").cogroup(told.unionByName(answers).groupBy("shard")).applyInArrow(_score(hot, model, buckets, buckets), out)
