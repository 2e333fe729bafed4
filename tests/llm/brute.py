"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
SPACE = " \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def key(d):
    return (d is not None, d or 0)


def suffix(docs, n=50):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if w not in first or key(d) < key(first[w]):
                first[w] = d
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if key(first[b[i : i + n]]) < key(d):
                gone[i : i + n] = [True] * n
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def windows(docs, n=13):
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, ws in split:
        for i in range(len(ws) - n + 1):
            w = tuple(ws[i : i + n])
            if w not in first or key(d) < key(first[w]):
                first[w] = d
    out = []
    for d, ws in split:
        gone = [False] * len(ws)
        for i in range(len(ws) - n + 1):
            if key(first[tuple(ws[i : i + n])]) < key(d):
                gone[i : i + n] = [True] * n
        out.append((d, len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone) if not g))))
    return out


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def line_dedup(docs):
    held = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            held.setdefault(lower(line.strip(SPACE)), set()).add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := lower(x.strip(SPACE))) >= 20 and len(held[k]) >= 3 and d != max(held[k], key=key))]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def statistics(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def base_scores(docs):
    out, known = [], Counter()
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10 == 0
    split = [(d, [*WORD.findall(lower(t or "")), "\n"]) for d, t in docs]
    for d, ws in split:
        if not held(d):
            known.update(ws)
    n, v = sum(known.values()), len(known)
    for d, ws in split:
        out.append((d, held(d), len(ws), sum(known[w] > 0 for w in ws), n, sum(math.log10((known[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def classes(docs, tokens, similarity=0.8):
    own = [tokens(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = own[i], own[j]
            if (docs[i][1] or "") == (docs[j][1] or "") or (a or b) and distance(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(root(i), []).append(d)
    return [(d, min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(docs)]


def tree_scores(docs, depth=3, least_gain=3.0):
    """Of a suffix tree that is all in one place; logs in steps of 1/1024 bit."""
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10 == 0
    split = [(d, [""] * depth + [*WORD.findall(lower(t or "")), "\n"]) for d, t in docs]
    after = {}
    for d, ws in split:
        if not held(d):
            for i in range(depth, len(ws)):
                for k in range(depth + 1):
                    after.setdefault(tuple(ws[i - k : i]), Counter())[ws[i]] += 1
    root = after.get((), Counter())
    once = max(sum(n == 1 for n in root.values()), 1)
    steps = lambda p: min(round(-math.log2(p) * 1024), 65534)
    kept = {}

    def code(context, symbol):
        if not context:
            return steps((root[symbol] or 1) / (root.total() + once))
        below = code(context[1:], symbol)
        own = after.get(context)
        if not own or own.total() < 2:
            return below
        if context not in kept:
            share = {x: 2 ** (-code(context[1:], x) / 1024) for x in own}
            kept[context] = sum(n * math.log(n / own.total()) - (n - 1) * math.log(share[x]) for x, n in own.items()) > least_gain
        if not kept[context]:
            return below
        return steps((own[symbol] + len(own) * 2 ** (-below / 1024)) / (own.total() + len(own)))

    return [(d, len(ws) - depth, sum(code(tuple(ws[i - depth : i]), ws[i]) for i in range(depth, len(ws))) * -math.log10(2) / 1024) for d, ws in split]
