"""Suffix arrays over word ids, and the runs of repeated n-grams in them.

A block is some megabytes of text. Its words are cut out of the bytes by a table of classes, numbered by a dictionary and
ordered by prefix doubling: ranks by one word give ranks by two, these by four, until the longest n-gram that is asked for is told apart.
Neighbours in this order that have k words in common form the LCP intervals of length k: one for each distinct n-gram, however often it
occurs, and all its occurrences are a slice of the suffix array.

Long texts come in pieces that begin with the last words of the piece before; an n-gram belongs to the piece in which it ends, so
each is counted once and no text is held as arrays as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Classes of bytes. A stop ends the run of words, a gap only the word.
WORD, GAP, STOP = 0, 1, 2
#: Bytes of a text that are looked at together.
PIECE = 4 << 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = np.uint64(0x9E3779B97F4A7C15)


def classes(gaps: bytes, stops: bytes = b"") -> np.ndarray:
    """A class for each byte; gaps and stops are ASCII, so no UTF-8 sequence is cut."""
    out = np.zeros(256, np.uint8)
    out[list(gaps)], out[list(stops)] = GAP, STOP
    return out


def pieces(text: bytes, kinds: np.ndarray, longest: int, size: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """(words that were in the piece before, bytes). Cuts are made at gaps or stops; what is between two of them stays whole."""
    apart = bytes(np.flatnonzero(kinds != WORD).tolist())
    stops = bytes(np.flatnonzero(kinds == STOP).tolist())
    plain = bytes(range(256)).translate(bytes.maketrans(apart, b" " * len(apart)))
    at, before = 0, b""
    while len(text) - at > size:
        end = at + size
        while end < len(text) and kinds[text[end]] == WORD:
            end += 1
        part = before + text[at:end]
        yield _count(before, plain), part
        tail = part[max(part.rfind(s) for s in (stops[i : i + 1] for i in range(len(stops)))) + 1 :] if stops else part
        # A cut at a stop needs nothing from before, as the stop comes first in the next piece.
        words = [w for w in tail.translate(plain).split(b" ") if w][-(longest - 1) :] if longest > 1 else []
        before, at = b" ".join(words) + b" " if words else b"", end
        before = before.replace(b" ", bytes([int(np.flatnonzero(kinds == GAP)[0])]))
    yield _count(before, plain), before + text[at:]


def _count(before: bytes, plain: bytes) -> int:
    return sum(1 for w in before.translate(plain).split(b" ") if w)


@dataclass
class Words:
    """Words of a block in order. ids: into words (an Arrow array); piece: of each word; room: words from here to the end of its run, itself counted; old: words at the
    head of the piece that were counted before, as seen from here (0 if none)."""

    ids: np.ndarray
    words: pa.Array
    piece: np.ndarray
    room: np.ndarray
    old: np.ndarray


def words_of(parts: list[tuple[int, bytes]], kinds: np.ndarray) -> Words:
    """Words of pieces (words known from before, bytes), in lower case."""
    raw = np.frombuffer(b"\n".join(x for _, x in parts).translate(LOWER) + b"\n", np.uint8)
    kind = kinds[raw]
    piece_ends = np.cumsum(np.array([len(x) + 1 for _, x in parts], np.int64))
    kind[piece_ends - 1] = STOP
    inside = kind == WORD
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    listed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    coded = listed.dictionary_encode()
    piece = np.searchsorted(piece_ends, starts, side="right")
    # A run ends where a stop stands before the next word.
    stops_before = np.cumsum(kind == STOP)
    last = np.ones(n, bool)
    if n:
        last[:-1] = stops_before[starts[1:]] != stops_before[starts[:-1]]
    at_last = np.flatnonzero(last)
    room = at_last[np.searchsorted(at_last, np.arange(n))] - np.arange(n) + 1
    first = np.searchsorted(piece, np.arange(len(parts)))
    known = np.array([k for k, _ in parts], np.int64)
    old = np.maximum(known[piece] - (np.arange(n) - first[piece]), 0)
    return Words(coded.indices.to_numpy().astype(np.int64), coded.dictionary, piece, room, old)


@dataclass
class Runs:
    """LCP intervals of length k: the first occurrence in the order, the slice of the suffix array, and how many occurrences in it count."""

    k: int
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    count: np.ndarray


class SuffixArray:
    def __init__(self, w: Words, longest: int):
        self.w, self.longest = w, longest
        n = len(w.ids)
        rank, length = w.ids + 1, 1
        self.order = np.argsort(rank, kind="stable") if longest == 1 else np.zeros(0, np.int64)
        while length < longest and n:
            # Ranks by `length` words, and those behind them where the run of words goes on.
            second = np.zeros(n, np.int64)
            second[: n - length] = rank[length:] if length < n else 0
            second[w.room <= length] = 0
            both = rank * (int(rank.max()) + 1) + second
            self.order = np.argsort(both)
            ordered = both[self.order]
            new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(new)
            length *= 2
        # Words that neighbours in the order have in common, up to `longest`.
        self.lcp = np.zeros(n, np.int8)
        if n > 1:
            a, b = self.order[1:], self.order[:-1]
            same = np.ones(n - 1, bool)
            for k in range(longest):
                at = np.minimum(a + k, n - 1), np.minimum(b + k, n - 1)
                same &= (w.room[a] > k) & (w.room[b] > k) & (w.ids[at[0]] == w.ids[at[1]])
                self.lcp[1:] += same

    def counts_here(self, k: int) -> np.ndarray:
        """Of each position, whether an n-gram of k words begins there and ends behind what was counted before."""
        return (self.w.room >= k) & (self.w.old < k)

    def runs(self, k: int, known: bool = False) -> Runs:
        """LCP intervals of length k; with `known` also those that occur only where they were counted before."""
        n = len(self.order)
        none = np.zeros(0, np.int64)
        if not n:
            return Runs(k, none, none, none, none)
        begin = np.flatnonzero(self.lcp < k)
        end = np.append(begin[1:], n)
        count = np.add.reduceat(self.counts_here(k)[self.order].astype(np.int64), begin)
        keep = (self.w.room >= k)[self.order[begin]] if known else count > 0
        begin, end = begin[keep], end[keep]
        return Runs(k, self.order[begin], begin, end, count[keep])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= ODD
    x ^= x >> np.uint64(29)
    return x
