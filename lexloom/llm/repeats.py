"""Repeated windows over a corpus: for each window of `length` symbols, the least doc_id that holds it.

This is what suffix-array and substring dedup share: how work is dealt. What orders or searches the strings is
their own (`solve`).

Every window has a minimiser: the least hash among the `seed`-grams in it. Equal windows have equal minimisers,
so windows are dealt to buckets by it, and neighbours with the same minimiser travel as one segment. First only minimisers are
sent; those found in a single document have no repeats and end there. For the others, segments are sent once for
each shard of documents that has them, whatever the number of copies. A bucket's strings are solved
together, in parts of bounded size, and each shard gets back the least doc_id for each window: nothing is removed that the solver did not
find. Strings are known by 64-bit names; equal names are checked byte by byte wherever strings meet. Documents are moved
once, compressed, to their shard; the later steps use the same exchange again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.common import NO_ID, Blob, deal, documents, shard_count

U = np.uint64
ODD = 0x9E3779B97F4A7C15
WORD = 1 << 64
#: Symbols that are looked at together; a longer document is a block of its own.
BLOCK = 1 << 20
#: Bytes of segments that are solved together, so that the work stays in a cache; only one minimiser with more goes beyond.
PART = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(ODD)
    x ^= x >> U(29)
    return x


def gram_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n symbols in a row, put together from hashes of powers of two."""
    base, power, size = {1: symbols}, {1: ODD}, 1
    while size * 2 <= n:
        part = base[size]
        base[size * 2] = part[:-size] * U(power[size]) + part[size:]
        power[size * 2] = power[size] ** 2 % WORD
        size *= 2
    out, have = base[size], size
    for k in sorted(base, reverse=True):
        if k <= n - have:
            m = len(symbols) - have - k + 1
            out = out[:m] * U(power[k]) + base[k][have : have + m]
            have += k
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start .. start + length - 1, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


@dataclass
class Block:
    """Some documents in a row. symbols: hashes to compare; raw: bytes, of which symbol i has at[i] .. at[i + 1] (all of them if at is None)."""

    symbols: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    raw: np.ndarray
    at: np.ndarray | None = None


@dataclass
class Segments:
    key: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    windows: np.ndarray


class Powers:
    """Powers of an odd number and of its inverse, for hashes of any stretch from running sums."""

    def __init__(self):
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, factor in (("up", ODD), ("down", pow(ODD, -1, WORD))):
                x = np.full(n, factor, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down

    def stretches(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        up, down = self.upto(len(symbols) + 1)
        sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * up[: len(symbols)], out=sums[1:])
        return mix((sums[begin + length] - sums[begin]) * down[begin] + length.astype(U) * U(0xD6E8FEB86659FD93))


    def names(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
        """Names of stretches of `seed` symbols or more, over mixed hashes of some symbols in a row: sums over the symbols themselves have well-known collisions."""
        wide = min(8, seed)
        return self.stretches(gram_hashes(symbols, wide), begin, length - wide + 1)


def same_bytes(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Of neighbours i and i + 1 in a list of stretches, whether they are equal; only where ask says so, else false."""
    out = np.zeros(len(ask), bool)
    at = np.flatnonzero(ask)
    at = at[size[at] == size[at + 1]]
    if len(at):
        own = size[at]
        differ = raw[ranges(begin[at], own)] != raw[ranges(begin[at + 1], own)]
        out[at] = np.add.reduceat(differ, np.cumsum(own) - own, dtype=np.int64) == 0
    return out


def segments(block: Block, length: int, seed: int) -> Segments:
    sizes = np.maximum(block.ends - block.starts - length + 1, 0)
    none = np.zeros(0, np.int64)
    if len(block.symbols) < length or not sizes.any():
        return Segments(np.zeros(0, U), none, none, none)
    least = sliding_min(gram_hashes(block.symbols, seed), length - seed + 1)
    where = ranges(block.starts, sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    key = least[where]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    return Segments(key[first], doc[first], where[first], np.diff(np.append(first, len(key))))


def find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x stands in the sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Least hashes are small numbers; mixed again they are even."""
    return (mix(key * U(0xBF58476D1CE4E5B9)) >> U(20)) % U(buckets)


def fine_of(key: np.ndarray) -> np.ndarray:
    return (mix(key * U(0x94D049BB133111EB)) >> U(13)).astype(np.uint16)


def _cuts(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket and where each begins in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1).astype(bucket.dtype))


Encode = Callable[[list[int], list[bytes]], Iterator[Block]]
#: From strings (bytes and cuts), the least doc_id of each and the window length: windows of each string, and the least doc_id for each window.
Solve = Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def _rows(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    parts = list(zip(*rows, strict=True)) or [[]] * len(columns)
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(columns.items(), parts, strict=True)})


def _ask(encode: Encode, length: int, seed: int, buckets: int):
    """A shard's minimisers, by bucket, and whether two of its documents have them."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py() if rows.num_rows else 0
        keys, ids = [], []
        for block in encode(*documents(rows.column("blob").to_pylist())):
            s = segments(block, length, seed)
            keys.append(s.key)
            ids.append(block.ids[s.doc])
        key, doc = np.concatenate(keys or [np.zeros(0, U)]), np.concatenate(ids or [np.zeros(0, np.int64)])
        out = []
        if len(key):
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            more = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            key = key[first]
            order, cuts = _cuts(bucket_of(key, buckets), buckets)
            key, more = key[order], more[order]
            out = [(b, shard, Blob.pack(key[i:j], np.packbits(more[i:j]))) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        return _rows({"bucket": pa.int32(), "shard": pa.int32(), "blob": pa.binary()}, out)

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """For each shard, those of its minimisers that two documents have."""
    keys, mores = [], []
    for blob in rows.column("blob").to_pylist():
        key, more = Blob.unpack(blob, U, np.uint8)
        keys.append(key)
        mores.append(np.unpackbits(more, count=len(key)).astype(bool))
    key, more = np.concatenate(keys), np.concatenate(mores)
    order = np.argsort(key)
    key, more = key[order], more[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    many = (np.diff(np.append(first, len(key))) > 1) | np.logical_or.reduceat(more, first)
    table = key[first][many]
    out = [(shard, Blob.pack(own[find(table, own)[1]])) for shard, own in zip(rows.column("shard").to_pylist(), keys, strict=True)]
    return _rows({"shard": pa.int32(), "blob": pa.binary()}, out)


def _send(encode: Encode, length: int, seed: int, buckets: int):
    """A shard's segments with a shared minimiser, once each, by bucket."""

    def run(rows: pa.Table, shared: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and shared.num_rows:
            shard = rows.column("shard")[0].as_py()
            table = np.sort(np.concatenate([Blob.unpack(x, U)[0] for x in shared.column("blob").to_pylist()]))
            powers, found = Powers(), []
            for block in encode(*documents(rows.column("blob").to_pylist())):
                s = segments(block, length, seed)
                keep = np.flatnonzero(find(table, s.key)[1])
                if not len(keep):
                    continue
                size = s.windows[keep] + length - 1
                name = powers.names(block.symbols, s.begin[keep], size, seed)
                ids = block.ids[s.doc[keep]]
                order = np.argsort(name, kind="stable")
                new = np.concatenate(([True], name[order][1:] != name[order][:-1]))
                if not same_bytes(block.symbols, s.begin[keep][order], size[order], ~new[1:])[~new[1:]].all():
                    raise ValueError("two strings of a shard have the same 64-bit name")
                first = np.flatnonzero(new)
                low, high = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
                pick = order[first]
                begin, size = s.begin[keep][pick], size[pick]
                if block.at is not None:
                    begin, size = block.at[begin], block.at[begin + size] - block.at[begin]
                found.append((name[pick], s.key[keep][pick], low, high, size, block.raw[ranges(begin, size)]))
            if found:
                name, key, low, high, size, raw = (np.concatenate(x) for x in zip(*found, strict=True))
                begin = np.cumsum(size) - size
                order = np.argsort(name, kind="stable")
                new = np.concatenate(([True], name[order][1:] != name[order][:-1]))
                if not same_bytes(raw, begin[order], size[order], ~new[1:])[~new[1:]].all():
                    raise ValueError("two strings of a shard have the same 64-bit name")
                first = np.flatnonzero(new)
                low, high = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
                pick = order[first]
                fine = fine_of(key[pick])
                by, cuts = _cuts(bucket_of(key[pick], buckets), buckets)
                for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if j > i:
                        at = by[i:j]
                        own = pick[at]
                        out.append((b, shard, Blob.pack(name[own], fine[at], low[at], high[at] - low[at], size[own].astype(np.int32), raw[ranges(begin[own], size[own])])))
        return _rows({"bucket": pa.int32(), "shard": pa.int32(), "blob": pa.binary()}, out)

    return run


def _solve(solve: Solve, length: int):
    """For each shard, the least doc_id for the windows of its segments, as runs, where that is below one of its own."""

    def run(rows: pa.Table) -> pa.Table:
        shards = rows.column("shard").to_pylist()
        parts = [Blob.unpack(x, U, np.uint16, np.int64, np.int64, np.int32, np.uint8) for x in rows.column("blob").to_pylist()]
        name, fine, low, more, size, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        # The same segment from several shards is one string; strings with the same minimiser stand together.
        order = np.lexsort((name, fine))
        new = np.concatenate(([True], (name[order][1:] != name[order][:-1]) | (fine[order][1:] != fine[order][:-1])))
        # Strings of the same name are one string if their bytes are equal, and only then.
        new[1:] |= ~same_bytes(raw, begin[order], size[order], ~new[1:])
        first = np.flatnonzero(new)
        string_of = np.empty(len(name), np.int64)
        string_of[order] = np.cumsum(new) - 1
        pick, least = order[first], np.minimum.reduceat(low[order], first)
        group = fine[pick]
        n = len(pick)
        run_n = np.ones(n, np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        # Each string goes through the solver, one that is alone under its minimiser too: what repeats is what it finds.
        ends = np.cumsum(size[pick])
        part = (ends - 1) // PART
        head = np.concatenate(([True], group[1:] != group[:-1]))
        part = part[np.maximum.accumulate(np.where(head, np.arange(n), 0))]  # a minimiser stays in one part
        cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [n]))
        for at in (np.arange(i, j) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            own = size[pick[at]]
            windows, mins = solve(raw[ranges(begin[pick[at]], own)], np.concatenate(([0], np.cumsum(own))), least[at], length)
            where = np.repeat(np.arange(len(at)), windows)
            starts = np.flatnonzero(np.concatenate(([True], (mins[1:] != mins[:-1]) | (where[1:] != where[:-1]))))
            lengths = np.diff(np.append(starts, len(mins)))
            pieces.append((at, np.bincount(where[starts], minlength=len(at)), lengths, mins[starts]))
        index = np.concatenate([x[0] for x in pieces])
        counts, run_len, run_min = (np.concatenate([x[i] for x in pieces]) for i in (1, 2, 3))
        run_at = np.empty(n, np.int64)
        run_at[index] = np.cumsum(counts) - counts
        run_n[index] = counts
        lowest = np.empty(n, np.int64)
        lowest[index] = np.minimum.reduceat(run_min, np.cumsum(counts) - counts)
        out, at = [], 0
        for shard, x in zip(shards, parts, strict=True):
            own = string_of[at : at + len(x[0])]
            at += len(x[0])
            tell = lowest[own] < x[2] + x[3]
            own = own[tell]
            if len(own):
                all_runs = ranges(run_at[own], run_n[own])
                out.append((shard, Blob.pack(x[0][tell], run_n[own].astype(np.int32), run_len[all_runs].astype(np.int32), run_min[all_runs])))
        return _rows({"shard": pa.int32(), "blob": pa.binary()}, out)

    return run


def covered(block: Block, told: tuple[np.ndarray, ...], powers: Powers, length: int, seed: int) -> np.ndarray:
    """Which symbols of a block lie in a window that a smaller doc_id has."""
    names, first_run, run_n, run_len, run_min = told
    s = segments(block, length, seed)
    mark = np.zeros(len(block.symbols) + 1, np.int64)
    if len(s.key) and len(names):
        at, ok = find(names, powers.names(block.symbols, s.begin, s.windows + length - 1, seed))
        hit = np.flatnonzero(ok)
        if len(hit):
            at = at[hit]
            runs = ranges(first_run[at], run_n[at])
            owner = np.repeat(hit, run_n[at])
            size = np.where(run_len[runs] < 0, s.windows[owner], run_len[runs])
            before = np.cumsum(size) - size
            head = np.repeat(before[np.cumsum(run_n[at]) - run_n[at]], run_n[at])
            begin = s.begin[owner] + before - head
            gone = run_min[runs] < block.ids[s.doc[owner]]
            begin, size = begin[gone], size[gone]
            mark += np.bincount(begin, minlength=len(mark))
            mark -= np.bincount(begin + size + length - 1, minlength=len(mark))
    return np.cumsum(mark)[:-1] > 0


def _answer(encode: Encode, finish, names: list[str], kinds: list[pa.DataType], length: int, seed: int):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        parts = [Blob.unpack(x, U, np.int32, np.int32, np.int64) for x in told.column("blob").to_pylist()] or [[np.zeros(0, k) for k in (U, np.int32, np.int32, np.int64)]]
        name, run_n, run_len, run_min = (np.concatenate(x) for x in zip(*parts, strict=True))
        run_n, run_len = run_n.astype(np.int64), run_len.astype(np.int64)
        order = np.argsort(name)
        first_run = np.cumsum(run_n) - run_n
        table = (name[order], first_run[order], run_n[order], run_len, run_min)
        powers, out = Powers(), []
        for block in encode(*documents(rows.column("blob").to_pylist())) if rows.num_rows else ():
            out += finish(block, covered(block, table, powers, length, seed))
        return _rows(dict(zip(names, kinds, strict=True)), out)

    return run


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def least_holders(docs: DataFrame, encode: Encode, solve: Solve, finish, schema: str, names: list[str], kinds: list[pa.DataType], length: int, seed: int) -> DataFrame:
    """docs: doc_id long, text string. finish(block, mask) gives rows of schema for a block's documents."""
    # A shard sends each bucket a row at most, so their product must stay small beside the data.
    shards, buckets = shard_count(docs, 2), shard_count(docs, 1)
    dealt = deal(docs, shards)
    by_bucket = "bucket int, shard int, blob binary"
    asked = dealt.groupBy("shard").applyInArrow(_ask(encode, length, seed, buckets), by_bucket)
    shared = asked.groupBy("bucket").applyInArrow(_shared, "shard int, blob binary")
    sent = dealt.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(_send(encode, length, seed, buckets), by_bucket)
    told = sent.groupBy("bucket").applyInArrow(_solve(solve, length), "shard int, blob binary")
    return dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_answer(encode, finish, names, kinds, length, seed), schema)
