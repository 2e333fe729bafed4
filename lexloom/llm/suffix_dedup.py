"""Suffix-array dedup by prefix-free parsing: bytes in a 50-byte string that a smaller doc_id also has go.

`lexloom.llm.repeats` brings strings that can share a window to one bucket. There a rolling hash over four bytes
sets triggers, which cut the strings into phrases that overlap by a trigger. The distinct phrases are the
dictionary, the sequence of their ranks is the parse. No suffix of a phrase that is longer than a trigger is a prefix of
another, so the order of all suffixes of the text is the order of (suffix of the phrase, suffix of the parse behind it): the
suffix array of the dictionary and that of the parse, combined. Neighbours in this order with 50 equal bytes
form the class of a repeated string.

Defined results: a null text is empty. Matches never cross rows. Rows with the same doc_id don't remove from each other;
rows with a null doc_id count as one document smaller than any other. Texts under 50 bytes stay. Extra columns are not carried. No rows in,
no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.common import NO_ID
from lexloom.llm.repeats import BLOCK, Block, Powers, least_holders, mix, ranges, spans_of

LENGTH = 50
SEED = 20
TRIGGER = 4
#: One four-byte string in so many is a trigger.
EVERY = 16
BYTES = mix(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def encode_bytes(ids: list[int], texts: list[bytes]) -> Iterator[Block]:
    """Documents in blocks of about BLOCK bytes."""
    held: list[bytes] = []
    own: list[int] = []
    size = 0

    def block() -> Block:
        sizes = np.array([len(x) for x in held], np.int64)
        raw = np.frombuffer(b"".join(held), np.uint8)
        ends = np.cumsum(sizes)
        return Block(BYTES[raw], ends - sizes, ends, np.array(own, np.int64), raw)

    for doc_id, text in zip(ids, texts, strict=True):
        held.append(text)
        own.append(doc_id)
        size += len(held[-1])
        if size >= BLOCK:
            yield block()
            held, own, size = [], [], 0
    if held:
        yield block()


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the place in sorted order at which its group begins, and the group's size."""
    order = np.argsort(key)
    ranked = key[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    sizes = np.diff(np.append(first, len(key)))
    rank, size = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    rank[order], size[order] = np.repeat(first, sizes), np.repeat(sizes, sizes)
    return rank, size


def bounded_ranks(rank: np.ndarray, size: np.ndarray, left: np.ndarray, step: int, upto: int) -> np.ndarray:
    """Prefix doubling: ranks by the first `step` symbols become ranks by the first `upto`. left: symbols up to the string's end.

    Strings end for good: what would lie beyond the end is less than anything. Groups of one need no more work.
    """
    rank = rank.copy()
    while step < upto:
        at = np.flatnonzero((size > 1) & (left > step))
        if not len(at):
            break
        second = rank[at + step] + 1
        order = np.lexsort((second, rank[at]))
        a, b = rank[at][order], second[order]
        outer = np.concatenate(([True], a[1:] != a[:-1]))
        inner = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        i = np.arange(len(at))
        begin = np.maximum.accumulate(np.where(inner, i, 0))
        moved = a + begin - np.maximum.accumulate(np.where(outer, i, 0))
        sizes = np.diff(np.append(np.flatnonzero(inner), len(at)))
        rank[at[order]] = moved
        size[at[order]] = np.repeat(sizes, sizes)
        step *= 2
    return rank


def dictionary_ranks(raw: np.ndarray, left: np.ndarray, upto: int) -> np.ndarray:
    """Ranks of all suffixes of the dictionary, each ending with its phrase, by their first `upto` bytes."""
    key = np.zeros(len(raw), np.uint64)
    for j in range(7):
        byte = np.zeros(len(raw), np.uint64)
        byte[: len(raw) - j] = raw[j:]
        byte[left <= j] = 0
        key |= byte << np.uint64(56 - 8 * j)
    key |= np.minimum(left, 7).astype(np.uint64)
    rank, size = _grouped(key)
    return bounded_ranks(rank, size, left, 7, upto)


def solve(raw: np.ndarray, cuts: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each string, and for each window the least doc_id of all strings that hold it."""
    n, sizes = len(raw), np.diff(cuts)
    string = np.repeat(np.arange(len(sizes)), sizes)
    ends = cuts[1:][string]
    # Phrases begin with a string or a trigger and end behind the next trigger, or with the string.
    four = np.zeros(n, np.uint64)
    for j in range(TRIGGER):
        four[: n - j] |= raw[j:].astype(np.uint64) << np.uint64(8 * j)
    trigger = ((mix(four * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(17)) % np.uint64(EVERY) == 0) & (np.arange(n) + TRIGGER <= ends)
    trigger[cuts[:-1]] = True
    begin = np.flatnonzero(trigger)
    following = np.append(begin[1:], n)
    last = np.append(string[begin][1:] != string[begin][:-1], True)
    stop = np.where(last, ends[begin], np.minimum(following + TRIGGER, ends[begin]))
    # The dictionary: each phrase once.
    name = Powers().stretches(BYTES[raw], begin, stop - begin)
    _, pick, phrase = np.unique(name, return_index=True, return_inverse=True)
    word_size = (stop - begin)[pick]
    word_at = np.cumsum(word_size) - word_size
    letters = raw[ranges(begin[pick], word_size)]
    if not np.array_equal(word_size[phrase], stop - begin) or not np.array_equal(letters[ranges(word_at[phrase], stop - begin)], raw[ranges(begin, stop - begin)]):
        raise ValueError("two phrases have the same 64-bit name")
    left = np.repeat(word_at + word_size, word_size) - np.arange(len(letters))
    suffix = dictionary_ranks(letters, left, length)
    # The parse, ordered by the ranks of whole phrases; a phrase brings a byte or more, so `length` phrases are enough.
    tail = np.searchsorted(begin, cuts[1:], "left")[string[begin]] - np.arange(len(begin))
    parse_rank, parse_size = _grouped(suffix[word_at[phrase]])
    parse = bounded_ranks(parse_rank, parse_size, tail, 1, length)
    # Corpus order: suffix of the phrase, then the parse behind it.
    windows = np.maximum(sizes - length + 1, 0)
    at = ranges(cuts[:-1], windows)
    held = np.searchsorted(begin, at, "right") - 1
    own = suffix[word_at[phrase[held]] + at - begin[held]]
    beyond = np.where(last[held], 0, np.append(parse, 0)[held + 1] + 1)
    order = np.argsort((own.astype(np.uint64) << np.uint64(32)) | beyond.astype(np.uint64), kind="stable")
    place = at[order]
    eight = np.zeros(n, np.uint64)
    for j in range(8):
        eight[: n - j] |= raw[j:].astype(np.uint64) << np.uint64(8 * j)
    differ = np.zeros(max(len(place) - 1, 0), bool)
    for j in [*range(0, length - 7, 8), length - 8]:
        x = eight[place + j]
        differ |= x[1:] != x[:-1]
    first = np.flatnonzero(np.concatenate(([True], differ)))
    low = np.minimum.reduceat(least[string[place]], first)
    out = np.empty(len(place), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(first, len(place))))
    return windows, out


def _finish(block: Block, mask: np.ndarray) -> list[tuple]:
    rows = []
    for doc_id, i, j in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist(), strict=True):
        own = mask[i:j]
        spans = spans_of(own) if own.any() else []
        kept = block.raw[i:j][~own] if spans else block.raw[i:j]
        rows.append((None if doc_id == NO_ID else doc_id, j - i, [{"begin": a, "end": b} for a, b in spans], kept.tobytes()))
    return rows


def dedup_bytes(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, spans (removed, as begin and end), kept (the remaining bytes)."""
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    schema = "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"
    return least_holders(docs, encode_bytes, solve, _finish, schema, ["doc_id", "n_bytes", "spans", "kept"], [pa.int64(), pa.int64(), pa.list_(span), pa.binary()], length, seed)
