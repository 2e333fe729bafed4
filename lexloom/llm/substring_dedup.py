"""Substring dedup with compressed FM-indexes: words in a 13-word window that a smaller doc_id also has go.

`lexloom.llm.repeats` brings strings of words that can share a window to one shard of the index. A shard is an
FM-index: the Burrows-Wheeler transform of its strings, kept as a wavelet tree in the shape of a code by frequencies, so compressed to about
the entropy of its words. The strings are streamed against it by backward search, all positions at a time, which gives for each
position the interval of suffixes that begin with the same 13 words: the matching statistics, cut at the
threshold. The least doc_id over the interval is what is told back; a longer match is a run of such positions, and its interval in the document is reported whole. As no longer match is asked for, suffixes are ordered by
their first 16 words only; intervals of shorter patterns are the same.

Defined results: words are runs without white space (space and \\t to \\r), unchanged; a null text has none. Windows never
cross rows. Rows with the same doc_id don't remove from each other; rows with a null doc_id count as one document smaller than any
other. Extra columns are not carried. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.common import NO_ID
from lexloom.llm.repeats import Block, Powers, least_holders, ranges, spans_of
from lexloom.llm.suffix_dedup import BYTES

LENGTH = 13
SEED = 6
#: Bytes of text that are looked at together; a longer document is a block of its own.
CHARS = 1_000_000
BLANK = 0x20
IS_SPACE = np.isin(np.arange(256), [BLANK, *range(0x09, 0x0E)])


def encode_words(ids: list[int], texts: list[bytes]) -> Iterator[Block]:
    """Documents in blocks of about CHARS characters; raw has each word and a blank behind it.

    All on bytes: no white space of the rule occurs within a UTF-8 sequence. A word's hash is that of its bytes.
    """
    powers = Powers()
    held: list[bytes] = []
    own: list[int] = []
    size = 0

    def block() -> Block:
        every = np.frombuffer(b" ".join(held) + b" ", np.uint8)
        space = IS_SPACE[every]
        behind = np.concatenate(([False], ~space[:-1]))
        last = space & behind
        doc_ends = np.cumsum([len(x) + 1 for x in held])
        ends = np.cumsum(last)[doc_ends - 1].astype(np.int64)
        raw = np.where(space, np.uint8(BLANK), every)[~space | last]
        at = np.concatenate(([0], np.flatnonzero(raw == BLANK) + 1)).astype(np.int64)
        symbols = powers.stretches(BYTES[raw], at[:-1], np.diff(at) - 1)
        return Block(symbols, np.concatenate(([0], ends[:-1])), ends, np.array(own, np.int64), raw, at)

    for doc_id, text in zip(ids, texts, strict=True):
        held.append(text)
        own.append(doc_id)
        size += len(held[-1])
        if size >= CHARS:
            yield block()
            held, own, size = [], [], 0
    if held:
        yield block()


def bounded_suffixes(symbols: np.ndarray, upto: int) -> np.ndarray:
    """Suffixes ordered by their first `upto` symbols (a power of two), by prefix doubling."""
    n = len(symbols)
    rank, step = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while step < upto:
        second = np.zeros(n, np.int64)
        second[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        new = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (new[1:] != new[:-1]).astype(np.int64))))
        step *= 2
    return order


class Wavelet:
    """A wavelet tree whose shape follows the frequencies: a symbol with a share p of the sequence has a code of ceil(log2(1 / p)) bits.

    So the bits that are kept are less than one for each symbol over the entropy of the sequence, and frequent symbols are
    found in few steps. A level holds the packed bits of all its nodes, one after another, with counts per 64 bits.
    """

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = len(symbols)
        count = np.bincount(symbols, minlength=sigma + 1)
        used = np.flatnonzero(count)
        self.length = np.zeros(sigma + 1, np.int32)
        self.length[used] = np.maximum(1, np.ceil(np.log2(n / count[used]) - 1e-9))
        width = int(self.length.max())
        order = used[np.argsort(self.length[used], kind="stable")]
        size = np.int64(1) << (width - self.length[order]).astype(np.int64)
        # Codes at the top of `width` bits, shorter ones first, so none begins another.
        code = np.zeros(sigma + 1, np.int64)
        code[order] = np.cumsum(size) - size
        self.levels = []
        rest, lengths = code[symbols], self.length[symbols]
        for level in range(width):
            stay = lengths > level
            rest, lengths = rest[stay], lengths[stay]
            bit = rest >> (width - 1 - level) & 1
            n = len(rest)
            packed = np.zeros(n // 64 + 1, np.uint64)
            packed.view(np.uint8)[: (n + 7) // 8] = np.packbits(bit.astype(np.uint8), bitorder="little")
            counts = np.zeros(len(packed), np.int32)
            np.cumsum(np.bitwise_count(packed[:-1]), out=counts[1:])
            prefix = rest >> (width - level)
            first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            mine = np.flatnonzero(self.length > level)
            start, before = np.zeros(sigma + 1, np.int32), np.zeros(sigma + 1, np.int32)
            start[mine] = first[np.searchsorted(prefix[first], code[mine] >> (width - level))]
            ones = np.concatenate(([0], np.cumsum(bit)))
            before[mine] = ones[start[mine]]
            self.levels.append((packed, counts, start, before, (code >> (width - 1 - level) & 1).astype(bool)))
            # Within each node zeros go before ones.
            node = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
            begin = first[node]
            seen = ones[:-1] - ones[begin]
            zeros = np.diff(np.append(first, n)) - (ones[np.append(first[1:], n)] - ones[first])
            place = begin + np.where(bit == 1, zeros[node] + seen, np.arange(n) - begin - seen)
            moved, sizes = np.empty_like(rest), np.empty_like(lengths)
            moved[place], sizes[place] = rest, lengths
            rest, lengths = moved, sizes

    def bits(self) -> int:
        return 64 * sum(len(x[0]) for x in self.levels)

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often symbol stands before low and before high."""
        out = np.concatenate([low, high]).astype(np.int32)
        n, length = len(symbol), self.length[symbol]
        at, both, c = np.arange(2 * n), out, np.concatenate([symbol, symbol])
        left = np.concatenate([length, length])
        for level, (packed, counts, start, before, one) in enumerate(self.levels):
            stay = left > level
            if not stay.all():
                out[at] = both
                at, both, c, left = at[stay], both[stay], c[stay], left[stay]
                if not len(at):
                    break
            where = start[c] + both
            word = where >> 6
            mask = (np.uint64(1) << (where & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(packed[word] & mask).astype(np.int32) - before[c]
            both = np.where(one[c], ones, both - ones)
        out[at] = both
        absent = np.concatenate([length, length]) == 0
        out[absent] = 0
        return out[:n], out[n:]


class FMIndex:
    """Over symbols from 1 on; 0 ends a string."""

    def __init__(self, symbols: np.ndarray, sigma: int, upto: int):
        self.suffixes = bounded_suffixes(symbols, upto)
        self.wavelet = Wavelet(symbols[self.suffixes - 1], sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma + 1)))).astype(np.int64)

    def intervals(self, symbols: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of suffixes that begin like the text at each place, by backward search."""
        last = symbols[at + length - 1]
        low, high = self.before[last], self.before[last + 1]
        for j in range(length - 2, -1, -1):
            c = symbols[at + j]
            a, b = self.wavelet.ranks(c, low, high)
            low, high = self.before[c] + a, self.before[c] + b
        return low, high


def least_over(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value in each interval low .. high - 1, from a table of powers of two."""
    levels, size = [values], 1
    longest = int((high - low).max(initial=1))
    while size * 2 <= longest:
        x = levels[-1]
        levels.append(np.minimum(x[:-size], x[size:]))
        size *= 2
    width = high - low
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(low), np.int64)
    for i, x in enumerate(levels):
        own = np.flatnonzero(level == i)
        if len(own):
            out[own] = np.minimum(x[low[own]], x[high[own] - (1 << i)])
    return out


def solve(raw: np.ndarray, cuts: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each string, and for each window the least doc_id of all strings that hold it."""
    words = raw.tobytes().split(b" ")[:-1]
    ends = np.searchsorted(np.flatnonzero(raw == BLANK) + 1, cuts[1:], "right")
    sizes = np.diff(np.concatenate(([0], ends)))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int64, len(words))
    # A 0 behind each string.
    place = np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)
    symbols = np.zeros(len(ids) + len(sizes), np.int64)
    symbols[place] = ids
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    string = np.repeat(np.arange(len(sizes)), sizes + 1)
    index = FMIndex(symbols, len(number), 16)
    windows = np.maximum(sizes - length + 1, 0)
    at = ranges(starts, windows)
    low, high = index.intervals(symbols, at, length)
    return windows, least_over(least[string[index.suffixes]], low, high)


def _finish(block: Block, mask: np.ndarray) -> list[tuple]:
    rows = []
    for doc_id, i, j in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist(), strict=True):
        own = mask[i:j]
        spans = spans_of(own) if own.any() else []
        edges = [0, *(x for s in spans for x in s), j - i]
        parts = [block.raw[block.at[i + a] : block.at[i + b]].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]
        kept = b"".join(parts)[:-1].decode("utf-8", "surrogatepass")
        rows.append((None if doc_id == NO_ID else doc_id, j - i, [{"begin": a, "end": b} for a, b in spans], kept))
    return rows


def dedup_words(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, spans (removed words, as begin and end), kept (the remaining words, joined by a space)."""
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    schema = "doc_id long, n_words long, spans array<struct<begin:long,end:long>>, kept string"
    return least_holders(docs, encode_words, solve, _finish, schema, ["doc_id", "n_words", "spans", "kept"], [pa.int64(), pa.int64(), pa.list_(span), pa.string()], length, seed)
