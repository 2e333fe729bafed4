"""Best-fit packing of tokenised documents into sequences of a fixed length.

The lengths of all pieces form a histogram of at most `capacity` rows, whatever the corpus. Over it stands the
configuration linear program: choose how often to use each multiset of lengths that fits a sequence, so that
every piece is covered and the number of sequences is least. It is solved by multiplicative weights: each
length has a price; a knapsack dynamic program values configurations at these prices; the price of each length is multiplied
by a factor that falls with how much of it the configurations near the greatest value cover; and again. Scaled prices solve the dual program, so
the value of all pieces at any round's prices is a number of sequences that no packing is below. The fractional
solution, the mean of the last rounds, is rounded to configurations drawn from it in proportion; what rounding leaves or runs short of
is placed by best fit.

The plan is a table of (length, rank) ranges, bounded by the capacity and the number of pricing rounds. A piece finds its
place from its length and its rank among the pieces of that length; ranks come from counts per task, so no
length is gathered in one place.

Defined results: a null or empty text is one piece holding the end id alone. A null doc_id stays null. Repeated rows are packed once per
row. Extra columns are not carried. No rows in, no rows out.
"""

from __future__ import annotations

import json
import math
import re
import sys
import types
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import few_rows, id_and_text, save

CAPACITY = 2048
#: Words encoded in a worker's table; when it is full it becomes the old one, from which words in use are taken over.
CACHE_WORDS = 700_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank_in_task long"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def worker_state(name: str) -> types.ModuleType:
    """Something that outlives a task in its worker process, for caches only."""
    return sys.modules.setdefault(name, types.ModuleType(name))


def _lean(tokenizer):
    """The tokenizer for words of lower-case letters alone: they need no normalizer, and splitting at blanks is all that splitting by letters does to them."""
    from tokenizers import Tokenizer, pre_tokenizers

    steps = (json.loads(tokenizer.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [x["type"] for x in steps] != ["Split", "ByteLevel"] or "[\\p{L}]+" not in steps[0]["pattern"].get("Regex", "") or steps[1]["use_regex"]:
        return tokenizer
    own = Tokenizer.from_str(tokenizer.to_str())
    own.normalizer = None
    own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return own


class Words(dict):
    """Encoded words in two generations. A word in neither counts as a miss, is noted, and encodes to nothing until it is learned."""

    def __init__(self, *args):
        super().__init__(*args)
        self.old: dict[str, bytes] = {}
        self.late: set[str] = set()
        self.misses = 0

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            self.misses += 1
            self.late.add(word)
            return b""
        self[word] = found
        return found

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


class WordEncoder:
    """Encodes text word by word; right for vocabularies whose pre-tokenizer drops white space, as checked against the library in the tests."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lean = _lean(self.tokenizer)
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.words, self.cores = Words(), Words()
        self.marks: dict[str, bytes] = {"": b""}
        # Letters, then marks that can't join them in one token: lower-casing keeps the length of these letters.
        self.plain = re.compile(f"(?m)^(?:([{LETTERS}]+)([.,;:!?*%&#$]*)|(.+))$")

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Words are taken apart in one pass; lower-casing the whole list changes no line breaks, and plain letters keep their number."""
        found = self.plain.findall("\n".join(words).lower())
        cores = [core for core, _, _ in found]
        new = [core for core in dict.fromkeys(cores) if core and core not in self.cores and core not in self.cores.old]
        if new:
            ids = np.array(self.lean.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(cuts) == len(new):
                raw, ends = ids.tobytes(), cuts.tolist()
                self.cores.update(zip(new, [raw[begin:end] for begin, end in zip([0, *ends], ends, strict=False)], strict=True))
            else:
                self.cores.update((core, self.encode(core)) for core in new)
        for mark in {mark for _, mark, _ in found}:
            if mark not in self.marks:
                self.marks[mark] = self.encode(mark)
        known, marks = self.cores, self.marks
        self.words.update((word, known[core] + marks[mark] if mark else known[core] if core else self.encode(word)) for word, (core, mark, _) in zip(words, found, strict=True))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """A few texts at a time, so that what is split stays small."""
        words = self.words
        get = words.__getitem__
        for at in range(0, len(texts), 200):
            split = [text.split() for text in texts[at : at + 200]]
            if len(words) > CACHE_WORDS:
                words.turn()
                self.cores.turn()
            found, late = [], []
            for i, ws in enumerate(split):
                before = words.misses
                found.append(b"".join(map(get, ws)))
                if words.misses > before:
                    late.append(i)
            if late:
                new = list(words.late)
                words.late.clear()
                self.learn(new)
                for i in late:
                    found[i] = b"".join(map(get, split[i]))
            yield from found


def encoder(path: str) -> WordEncoder:
    state = worker_state("_lexloom_encoders")
    if not hasattr(state, "by_path"):
        state.by_path = {}
    if path not in state.by_path:
        state.by_path[path] = WordEncoder(path)
    return state.by_path[path]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in few_rows(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode_all(batch.column(1).to_pylist()), strict=True):
                ids += b"\0\0\0\0"
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank_in_task"])

    return run


def knapsack(values: np.ndarray, lengths: np.ndarray, room: int) -> np.ndarray:
    """For each room up to this, the greatest value of lengths within it, each any number of times; lengths ascend."""
    best = np.zeros(room + 1)
    fits = np.searchsorted(lengths, np.arange(room + 1), "right")
    for c in range(int(lengths[0]), room + 1):
        n = fits[c]
        best[c] = max(best[c - 1], (best[c - lengths[:n]] + values[:n]).max())
    return best


class Program:
    """A fractional solution of the configuration program, as the mean of rounds.

    A round prices configurations by a knapsack: `best` value for each room at the round's prices. It then uses all
    configurations of nearly the greatest value: pieces are chosen one after another, a length by how many pieces
    have it and by exp(-what the choice loses against the best / heat). Then the price of each length is multiplied by
    a factor that falls with how much of its demand these cover. Scaled by the best configuration, each round's prices solve the
    dual program, so their value is a number of sequences that no packing is below.
    """

    def __init__(self, n: np.ndarray, lengths: np.ndarray, capacity: int, rate: float, rounds: int, heat: float, cold: float):
        self.n, self.lengths, self.capacity = n, lengths, capacity
        self.fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
        self.bound, self.rounds, self.covered = 0.0, [], np.zeros(len(n))
        price = lengths / capacity
        for i in range(rounds):
            best = knapsack(price, lengths, capacity)
            price, best = price / best[capacity], best / best[capacity]
            self.bound = max(self.bound, float(n @ price))
            self.heat = heat * (cold / heat) ** min(1.0, max(0.0, 3 * i / rounds - 1))
            share = self.usage(price, best) * (n @ price) / n
            if i >= rounds * 2 // 3:
                self.rounds.append((price, best))
                self.covered += share
            price = price * np.exp(rate / (1 + i / 10) * np.clip(1 - share, -2, 1))
        self.covered /= len(self.rounds)

    def chances(self, price: np.ndarray, best: np.ndarray, room: int) -> np.ndarray:
        """How likely each length that fits is the next piece."""
        k = self.fits[room]
        x = self.n[:k] * np.exp((price[:k] + best[room - self.lengths[:k]] - best[room]) / self.heat)
        return x / x.sum()

    def usage(self, price: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Pieces of each length in a sequence of the round, on the average: what flows from the whole room down."""
        flow, used = np.zeros(self.capacity + 1), np.zeros(len(self.n))
        flow[self.capacity] = 1
        for room in range(self.capacity, int(self.lengths[0]) - 1, -1):
            if flow[room] > 1e-12:
                part = flow[room] * self.chances(price, best, room)
                used[: len(part)] += part
                flow[room - self.lengths[: len(part)]] += part
        return used

    def draw(self, rng: np.random.Generator, some: int) -> list[list[int]]:
        """Configurations, as places in lengths, in turn from all rounds."""
        out: list[list[int]] = [[] for _ in range(some)]
        for r, (price, best) in enumerate(self.rounds):
            own = np.arange(r, some, len(self.rounds))
            room = np.full(len(own), self.capacity)
            while len(own):
                stay = []
                for c in np.unique(room).tolist():
                    at = np.flatnonzero(room == c)
                    if not self.fits[c]:
                        continue
                    picks = np.searchsorted(np.cumsum(self.chances(price, best, c)), rng.random(len(at)) * (1 - 1e-12))
                    for i, pick in zip(own[at].tolist(), picks.tolist(), strict=True):
                        out[i].append(pick)
                    room[at] -= self.lengths[picks]
                    stay.append(at)
                stay = np.sort(np.concatenate(stay)) if stay else np.zeros(0, np.int64)
                own, room = own[stay], room[stay]
        return out


def plan(counts: dict[int, int], capacity: int, rate: float = 0.3, rounds: int = 60, heat: float = 0.05, cold: float = 0.0001, part: float = 0.95, most: int = 20_000) -> tuple[list[tuple[dict[int, int], int]], int]:
    """(length -> copies, sequences that hold just this) for all pieces counted, and a number of sequences that no packing is below.

    rate: how strongly prices answer to what is covered. rounds: pricing rounds. heat: how near the best value
    configurations are, in sequences, in the first rounds; cold: in the last. part: of the sequences, those rounded from
    the solution; the rest takes what rounding leaves. most: configurations that the solution is rounded to.
    """
    out: list[tuple[dict[int, int], int]] = []
    full = counts.get(capacity, 0)
    if full:
        out.append(({capacity: 1}, full))
    lengths = np.array(sorted(k for k, n in counts.items() if n and k < capacity), np.int64)
    if not len(lengths):
        return out, full
    size = lengths.tolist()
    left = [counts[k] for k in size]
    solution = Program(np.array(left, float), lengths, capacity, rate, rounds, heat, cold)
    total = math.ceil(solution.bound - 1e-6)
    some = min(most, int(total * part))
    # Rounded by running totals; where a length runs out, the rest of the configuration stays.
    cuts = [int(total * part) * i // max(some, 1) for i in range(some + 1)]
    for picks, times in zip(solution.draw(np.random.default_rng(1), some), np.diff(cuts).tolist(), strict=True):
        config = Counter(picks)
        while times > 0:
            own = {i: min(c, left[i]) for i, c in config.items() if left[i]}
            if not own:
                break
            now = min(times, *(left[i] // c for i, c in own.items()))
            for i, c in own.items():
                left[i] -= c * now
            out.append(({size[i]: c for i, c in own.items()}, now))
            times -= now
    return best_fit(out, {k: n for k, n in zip(size, left, strict=True) if n}, capacity), full + total


def best_fit(begun: list[tuple[dict[int, int], int]], left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The sequences begun and new ones with the pieces left: longest first, each where it leaves least room; equal sequences together."""
    holes: dict[int, list[tuple[dict[int, int], int]]] = {}
    for config, times in begun:
        holes.setdefault(capacity - sum(k * c for k, c in config.items()), []).append((config, times))
    some_room = np.zeros(capacity + 1, bool)
    some_room[list(holes)] = True
    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            at = np.flatnonzero(some_room[k:])
            if len(at):
                room = k + int(at[0])
                config, times = holes[room].pop()
                some_room[room] = bool(holes[room])
            else:
                room, config, times = capacity, {}, -(-n // (capacity // k))
            copies = max(1, min(room // k, n // times))
            some = min(times, n // copies)
            if times > some and config:
                holes.setdefault(room, []).append((config, times - some))
                some_room[room] = True
            rest = room - k * copies
            holes.setdefault(rest, []).append((config | {k: config.get(k, 0) + copies}, some))
            some_room[rest] = True
            n -= copies * some
    return [x for _, group in sorted(holes.items()) for x in group]


def slots(chosen: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan as ranges: pieces of a length from rank `first` on go, `copies` to a sequence, from sequence and offset on."""
    rows, used, sequence = [], {}, 0
    for config, times in chosen:
        offset = 0
        for length, copies in sorted(config.items(), reverse=True):
            first = used.get(length, 0)
            rows.append((length, first, copies, sequence, offset))
            used[length] = first + copies * times
            offset += length * copies
        sequence += times
    rows.sort()
    names = ("length", "first", "copies", "sequence", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def _place(table: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table["length"].astype(np.float64) * 2.0**40 + table["first"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length * 2.0**40 + rank, "right") - 1
            within = rank - table["first"][at]
            copies = table["copies"][at]
            sequence = table["sequence"][at] + within // copies
            offset = table["offset"][at] + (within % copies) * length
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = save(spark, id_and_text(docs).mapInArrow(_pieces(tokenizer, capacity), PIECES), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = pieces.join(by_task.drop("n"), ["length", "task"]).withColumn("_rank", F.col("_base") + F.col("rank_in_task"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(_place(slots(plan(counts, capacity)[0])), out)
