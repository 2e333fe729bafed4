"""The nearest vectors of many queries, exactly, in blocks of vectors and queries that meet by key.

Products of single-precision matrices tell which pairs can be among a query's best in a block: each that isn't below the k-th best by more than such a product can err. Those are scored again
as `ranking.cosine` does, term by term in doubles, and rounded as Spark rounds. Equal vectors of a block are one with its k smallest ids, so copies cost no more than their reading.

Vectors of another length than the query's, or with a null, have a null score and come last. A vector that isn't finite, or too large or small for single precision, is scored with every query.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

#: Groups of vectors whose best product bounds the k-th best, vectors in each, and pairs that are scored at once.
GROUP, PAIRS = 64, 1 << 18


def rounded(x: np.ndarray) -> np.ndarray:
    """Six places, halves away from zero in the shortest decimal form, as Spark's round."""
    y = np.abs(x) * 1e6
    with np.errstate(invalid="ignore"):
        out = np.copysign(np.floor(y + 0.5), x)
        near = np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-4)
    for i in near.tolist():
        out[i] = float(Decimal(repr(float(x[i]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return out / 1e6 + 0.0


def _lists(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix in doubles) for each length of list; rows with a null are in none."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):  # no chunk
        return []
    offsets = lists.offsets.to_numpy()
    size = np.diff(offsets)
    values = lists.values
    bad = np.zeros(len(values) + 1, np.int64)
    if values.null_count:
        bad[1:] = np.cumsum(values.is_null().to_numpy(zero_copy_only=False))
    good = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    flat = values.fill_null(0).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == n))
        out.append((rows, flat[offsets[rows][:, None] + np.arange(n)]))
    return out


def _norm(x: np.ndarray) -> np.ndarray:
    """Lengths in doubles, summed in order; 1 for 0."""
    found = np.empty(len(x))
    step = max(1, PAIRS * GROUP // max(1, x.shape[1]) // 4)
    with np.errstate(all="ignore"):
        for i in range(0, len(x), step):
            part = x[i : i + step].astype(np.float64)
            found[i : i + step] = np.sqrt(np.add.accumulate(part * part, axis=1)[:, -1]) if x.shape[1] else 0.0
    return np.where(found == 0, 1.0, found)


class Block:
    """Distinct vectors of one length with their k smallest ids."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int):
        vectors = np.ascontiguousarray(vectors + vectors.dtype.type(0))  # one zero
        keys = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel() if vectors.shape[1] else np.zeros(len(vectors), np.int8)
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        order = np.lexsort((ids, of))
        new = np.flatnonzero(np.diff(of[order], prepend=-1))
        place = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
        kept = order[place < k]
        self.ids = ids[kept]
        self.begin = np.searchsorted(of[kept], np.arange(len(first) + 1))
        self.norm = _norm(self.vectors)
        self.odd = _odd(self.vectors, self.norm)
        self.even = np.flatnonzero(~self.odd)
        self.groups = -(-len(self.even) // GROUP) if len(self.even) >= 4 * GROUP * k else len(self.even)
        self.unit = _unit(self.vectors[self.even], self.norm[self.even])
        whole = self.groups * (-(-len(self.even) // self.groups)) if self.groups else 0
        self.columns = np.zeros((self.unit.shape[1], whole), np.float32)
        self.columns[:, : len(self.even)] = self.unit.T


def _odd(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return ~((norm > 1e-30) & (norm < 1e30) & np.isfinite(x).all(axis=1))


def _unit(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (x / norm[:, None]).astype(np.float32) if x.dtype != np.float32 else x / norm[:, None].astype(np.float32)


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: scores down, NaN before all, ids up."""
    order = np.lexsort((ids, np.where(np.isnan(score), -np.inf, -score), ~np.isnan(score), q))
    new = np.flatnonzero(np.diff(q[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    kept = order[place < k]
    return q[kept], score[kept], ids[kept]


def _near(b: Block, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place in b.even) of all pairs that may be among a query's k best."""
    n, groups = len(b.even), b.groups
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = unit @ b.columns
    s[:, n:] = -np.inf
    s = s.reshape(len(unit), -1, groups)  # a group's vectors stand `groups` apart
    most = s.max(axis=1)
    if groups <= k:
        return np.repeat(np.arange(len(unit)), n), np.tile(np.arange(n), len(unit))
    error = (unit.shape[1] + 16) * 2.0**-22 + 2e-6
    least = np.partition(most, groups - k, axis=1)[:, groups - k] - np.float32(error)
    q, g = np.nonzero(most >= least[:, None])
    if s.shape[1] == 1:
        return q, g
    found = []
    for i in range(0, len(q), PAIRS // 4):
        own_q, own_g = q[i : i + PAIRS // 4], g[i : i + PAIRS // 4]
        pair, place = np.nonzero(s[own_q, :, own_g] >= least[own_q, None])
        found.append((own_q[pair], place * groups + own_g[pair]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def nearest(b: Block, queries: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id): the k best of each query in a block."""
    norm = _norm(queries)
    odd = _odd(queries, norm)
    out = []

    def scored(q: np.ndarray, v: np.ndarray) -> None:
        held = []
        for i in range(0, len(q), PAIRS):
            own_q, own_v = q[i : i + PAIRS], v[i : i + PAIRS]
            with np.errstate(all="ignore"):
                dot = np.add.accumulate(b.vectors[own_v].astype(np.float64) * queries[own_q], axis=1)[:, -1] if queries.shape[1] else np.zeros(len(own_q))
                score = rounded(dot / (norm[own_q] * b.norm[own_v]))
            many = b.begin[own_v + 1] - b.begin[own_v]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(b.begin[own_v], many)
            held = [_best(*(np.concatenate(x) for x in zip(*held, (np.repeat(own_q, many), np.repeat(score, many), b.ids[at]), strict=True)), k)]
        out.extend(held)

    even = np.flatnonzero(~odd)
    always = np.flatnonzero(b.odd)
    for i in range(0, len(even), step):
        own = even[i : i + step]
        q, v = _near(b, _unit(queries[own], norm[own]), k)
        q, v = own[q], b.even[v]
        if len(always):
            q, v = np.concatenate((q, np.repeat(own, len(always)))), np.concatenate((v, np.tile(always, len(own))))
            order = np.argsort(q, kind="stable")
            q, v = q[order], v[order]
        scored(q, v)
    for one in np.flatnonzero(odd).tolist():
        scored(np.full(len(b.vectors), one), np.arange(len(b.vectors)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def matched(k: int, step: int):
    """A function of a block of vectors (vec_id, embedding) and one of queries (query_id, embedding) that gives (query_id, vec_id, score)."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids = vectors["vec_id"].to_numpy()
        blocks = {x.shape[1]: (rows, x) for rows, x in _lists(vectors["embedding"])}
        found = []
        unlike = np.ones(len(queries), bool)
        last = np.sort(ids)[:k]  # of queries with a null
        for rows, q in _lists(queries["embedding"]):
            unlike[rows] = False
            at, x = blocks.get(q.shape[1], (np.zeros(0, np.int64), np.zeros((0, q.shape[1]))))
            if len(at):
                own, score, vec = nearest(Block(x, ids[at], k), q.astype(np.float64), k, step)
                found.append((rows[own], score, vec, np.zeros(len(own), bool)))
            rest = np.sort(np.delete(ids, at))[:k]
            found.append((np.repeat(rows, len(rest)), np.zeros(len(rows) * len(rest)), np.tile(rest, len(rows)), np.ones(len(rows) * len(rest), bool)))
        rows = np.flatnonzero(unlike)
        found.append((np.repeat(rows, len(last)), np.zeros(len(rows) * len(last)), np.tile(last, len(rows)), np.ones(len(rows) * len(last), bool)))
        at, score, vec, null = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": queries["query_id"].take(pa.array(at)), "vec_id": pa.array(vec), "score": pa.array(score, mask=null)})

    return run
