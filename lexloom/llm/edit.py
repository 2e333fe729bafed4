"""Edit distances over words, bit-parallel after Myers, with Python integers as bit vectors of any width."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def best_in(pattern: Sequence[Hashable], text: Sequence[Hashable], most: int) -> tuple[int, int] | None:
    """Least edit distance of the whole pattern to any stretch of text, and where that stretch ends; None if over most."""
    m = len(pattern)
    if not m:
        return None
    where: dict[Hashable, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(xh | up))
        minus = up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(xv | plus)), plus & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


def start_of(pattern: Sequence[Hashable], text: Sequence[Hashable], end: int, distance: int) -> int:
    """Where the shortest stretch of text begins that ends at `end` and is at this (least) distance from the whole pattern."""
    m = len(pattern)
    where: dict[Hashable, int] = {}
    for i, c in enumerate(reversed(pattern)):
        where[c] = where.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for n in range(0, min(end, m + distance) + 1):
        if score == distance:
            return end - n
        if n == end:
            break
        eq = where.get(text[end - 1 - n], 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(xh | up))
        minus = up & xh
        score += bool(plus & top) - bool(minus & top)
        # Every word of the stretch counts, so the first row rises.
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(xv | plus)), plus & xv
    return max(0, end - m)


def banded(a: Sequence[Hashable], b: Sequence[Hashable], most: int) -> int | None:
    """Edit distance of a and b if it is at most `most`, else None. Only the band of diagonals that such a distance can touch is held."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > most:
        return None
    begin = 0
    while begin < n and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < n - begin and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    a, b = a[begin : n - end], b[begin : m - end]
    n, m = len(a), len(b)
    if not n:
        return m if m <= most else None
    # Column j of the band holds rows j - most .. j + most of the matrix of b (rows) by a (columns), lowest row first.
    width = 2 * most + 1
    mask, middle = (1 << width) - 1, most
    where: dict[Hashable, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | (1 << (i + most))
    # Vertical differences of column 0: rows at and above 0 don't exist and count as falling, so that nothing is cheaper outside.
    up = mask & ~((1 << (middle + 1)) - 1)
    down = 0
    score = 0
    for j, c in enumerate(a):
        # Bit k of this column is row j + 1 - most + k, so row i (from 0) of b is bit i - j + most.
        eq = (where.get(c, 0) >> j) & mask
        up, down = up >> 1 | 1 << (width - 1), down >> 1
        diagonal = (((eq & up) + up) ^ up) & mask | eq | down
        plus = down | (mask & ~(diagonal | up))
        minus = diagonal & up
        if not diagonal >> middle & 1:
            score += 1
        if score > 2 * most + 1:
            return None
        # To the differences down this column, from those along it.
        up, down = _turn(plus, minus, diagonal, mask)
    at = most
    for i in range(m - n):
        bit = 1 << (at + 1 + i)
        score += bool(up & bit) - bool(down & bit)
    return score if score <= most else None


def _turn(plus: int, minus: int, diagonal: int, mask: int) -> tuple[int, int]:
    plus, minus = (plus << 1) & mask, (minus << 1) & mask
    return minus | (mask & ~(diagonal | plus)), plus & diagonal
