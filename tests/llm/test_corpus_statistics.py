"""Importance resampling, WARC archives and collocations."""

import gzip
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import collocations, common, importance, warc, word_runs

from .brute import lower
from .test_dedup import prose

# Word runs


def grams(texts, kinds, longest, size):
    """Counts of n-grams by way of the suffix array, with texts cut into pieces."""
    parts = [p for t in texts for p in word_runs.pieces(t.encode(), kinds, longest, size)]
    w = word_runs.words_of(parts, kinds)
    array, words, found = word_runs.SuffixArray(w, longest), w.words.to_pylist(), Counter()
    for k in range(1, longest + 1):
        runs = array.runs(k)
        for first, begin, end, n in zip(runs.first, runs.begin, runs.end, runs.count):
            key = b" ".join(words[i] for i in w.ids[first : first + k])
            assert key not in found
            found[key] = int(n)
            assert {tuple(w.ids[p : p + k]) for p in array.order[begin:end]} == {tuple(w.ids[first : first + k])}
    return found


@pytest.mark.parametrize("longest", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("size", [1, 7, 40, 1 << 20])
def test_runs_are_all_ngrams_however_texts_are_cut(longest, size):
    rng = random.Random(longest)
    texts = ["", " ", ".", "A.b", "x" * 100, *("".join(rng.choice(["a", "B", "ab", "é", " ", " ", "\t", ".", "\n", ", "]) for _ in range(rng.randrange(120))) for _ in range(20))]
    want = Counter()
    for t in texts:
        for piece in re.split("[.,;:!?\n-\r]", lower(t)):
            ws = [x for x in re.split("[ \t]", piece) if x]
            want.update(" ".join(ws[i : i + k]).encode() for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    assert grams(texts, collocations.KINDS, longest, size) == want


def test_crc_of_parts():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(20)), rng.randbytes(rng.choice([0, 1, 5, 70, 5000]))
        moved = importance._moved(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]
        assert int(moved) ^ zlib.crc32(b) == zlib.crc32(a + b)


# Importance resampling

OP11_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_resample(docs, target, percent=25, least=20):
    def features(t):
        w = OP11_WORD.findall(lower(t or ""))
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    own = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for x in own for b in x[2]), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + 10000)) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for d, n, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for i, x in enumerate(fit[: len(fit) * percent // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("block", [1, 3000, 1 << 22])
def test_resampling_is_the_plain_one(spark, monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    docs = [(i, prose(i, 1 + i % 60)) for i in range(80)] + [(None, prose(3, 30)), (None, None), (90, None), (91, ""), (92, "\x00 -- "), (93, "x" * 3000), (7, prose(7, 40)), (7, prose(7, 40)), (94, "Ünï çödé " * 30), (95, prose(95, 4000))]
    target = [prose(500 + i, 40) for i in range(10)] + [None, ""]
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, bucket string, weight int").repartition(3)
    found = importance.resample(d, spark.createDataFrame([(t,) for t in target], "text string"))
    got = sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    want = plain_resample(docs, target)
    # Rows alike in id and score may change places.
    assert got == want


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none.select("text")).collect() == []
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert [r["rank"] for r in importance.resample(some, none.select("text"), percent=100).collect()] == [1]


def test_texts_cut_into_pieces_weigh_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 300)) for i in range(12)], "doc_id long, text string")
    whole = sorted(map(tuple, importance.resample(docs, docs.limit(3).select("text")).collect()), key=repr)
    cut = word_runs.pieces
    monkeypatch.setattr(importance, "pieces", lambda text, kinds, longest: cut(text, kinds, longest, 50))
    gains = importance.gains_of(np.arange(10000), np.arange(10000)[::-1])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([prose(1, 200).encode(), prose(2, 100).encode()])], ["doc_id", "text"])
    told = [x.to_pylist() for x in importance._weigh(gains, 2)(iter([batch]))]
    monkeypatch.setattr(importance, "BLOCK", 60)
    assert [r for x in importance._weigh(gains, 2)(iter([batch])) for r in x.to_pylist()] == [r for x in told for r in x]
    monkeypatch.undo()
    assert [r for x in importance._weigh(gains, 2)(iter([batch])) for r in x.to_pylist()] == [r for x in told for r in x]
    assert len(whole) == 12


def test_ranks_over_all_tasks(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i * 37 % 101, i) for i in range(300)], "x long, y long").repartition(5)
    got = {(r.x, r.y): r.place for r in common.ranked(rows, [F.desc("x"), F.asc("y")], "place").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda z: z[1])] == sorted(got, key=lambda k: (-k[0], k[1]))
    assert sorted(got.values()) == list(range(1, 301))
    assert common.ranked(rows.limit(0), [F.desc("x")], "place").collect() == []


# WARC


def plain_archive(pages):
    first = {}
    for p, _, html in pages:
        h = html or ""
        if p is not None:
            first[h] = min(p, first.get(h, p))
    out = []
    for p, _, html in pages:
        b = (html or "").encode()
        f = first.get(html or "")
        again = len(b) >= 100 and f is not None and p != f
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


PAGES = [(i, f"https://a.example/{i}", prose(i % 7, 40)) for i in range(60)] + [
    (100, None, None), (101, "http://x/ü y\r\nEvil: 1", ""), (102, "", "é" * 50), (103, "u", "é" * 50), (104, "u", "y" * 99), (105, "u", "y" * 99), (None, "u", "n" * 200), (None, "v", "n" * 200),
    (None, "w", prose(1, 40)), (5, "again", prose(5, 40)), (106, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08" * 40), (107, "u", prose(9, 30_000)),
]


@pytest.mark.parametrize("split", [64 << 20, 5000, 301])
def test_archives_round_trip(spark, split):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, _first int").repartition(3)
    found = warc.round_trip(pages, split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, found.collect()), key=repr) == plain_archive(PAGES)


def test_archives_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_revisits_get_their_payload(spark, tmp_path):
    own = [p for p in PAGES if p[0] is not None and p[1] != "again"]
    warc.write_pages(spark.createDataFrame(own, "page_id long, url string, html string"), f"file:{tmp_path}/a")
    found = {r.record_id: bytes(r.payload).decode() for r in warc.restored(warc.read_archive(spark, f"{tmp_path}/a")).collect()}
    assert found == {f"<urn:page:{p}>": html or "" for p, _, html in own}
    names = os.listdir(tmp_path / "a")
    assert names and all(n.endswith(".warc.gz") for n in names)
    # Any gzip reader can read it, and headers hold no line of the page's.
    text = b"".join(gzip.open(tmp_path / "a" / n).read() for n in names)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and b"\r\nEvil:" not in text
    # More records are added beside those of before.
    warc.write_pages(spark.createDataFrame([(999, "u", "z")], "page_id long, url string, html string"), f"{tmp_path}/a")
    assert warc.read_archive(spark, f"{tmp_path}/a").filter("record_type <> 'warcinfo'").count() == len(own) + 1


def archive(bodies, level):
    return [warc.member(warc.record_bytes("response", f"<urn:page:{i}>", "http://x", "2020-01-01T00:00:00Z", b, len(b), hashlib.sha256(b).hexdigest(), None), level) for i, b in enumerate(bodies)]


@pytest.mark.parametrize("level", [0, 6])
def test_members_are_owned_once_by_any_ranges(tmp_path, level):
    """An archive inside a payload, stored as it is, has members of its own, which no range may take for records."""
    rng = random.Random(level)
    inner = b"".join(archive([rng.randbytes(700) for _ in range(9)], 0))
    bodies = [inner if i % 3 == 1 else rng.randbytes(50) + b"\x1f\x8b\x08\x00" * 5 for i in range(12)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(archive(bodies, level)))
    size = path.stat().st_size
    for split in (size, 5000, 997, 64):
        reader = warc.WarcReader({"path": str(path), "splitBytes": str(split)})
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [r["record_id"] for r in rows] == [f"<urn:page:{i}>" for i in range(12)]
        assert [r["payload"] for r in rows] == bodies


def test_magic_across_two_windows(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "WINDOW", 256)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(archive([bytes([i]) * (i * 31) for i in range(40)], 6)))
    for split in (97, 256, 300):
        reader = warc.WarcReader({"path": str(path), "splitBytes": str(split)})
        assert [r["payload"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [bytes([i]) * (i * 31) for i in range(40)]


@pytest.mark.parametrize("harm", ["cut", "byte", "digest", "junk"])
def test_damaged_archives_are_errors(tmp_path, harm):
    parts = archive([b"a" * 300, b"b" * 300, b"c" * 300], 6)
    if harm == "cut":
        parts[2] = parts[2][:-9]
    if harm == "byte":
        parts[1] = parts[1][:40] + bytes([parts[1][40] ^ 255]) + parts[1][41:]
    if harm == "digest":
        parts[1] = warc.member(warc.record_bytes("response", "x", "u", "d", b"b", 1, "0" * 64, None), 6)
    if harm == "junk":
        parts.insert(1, b"junk")
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(parts))
    reader = warc.WarcReader({"path": str(path)})
    with pytest.raises((ValueError, zlib.error)):
        [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_other_writers_records():
    sha1 = "sha1:" + warc.base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    data = f"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <a>\r\nWARC-Target-URI: http://x\r\n /y\r\nWARC-Payload-Digest: {sha1}\r\ncontent-type: application/http; msgtype=response\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200\r\nA: 1\r\n\r\n"[:-5].encode()
    head, _, _ = data.partition(b"\r\n\r\n")
    block = b"HTTP/1.1 200\r\nA: 1\r\n\r\nbody"
    data = head.replace(b"Content-Length: 21", b"Content-Length: %d" % len(block)) + b"\r\n\r\n" + block + b"\r\n\r\n"
    row = warc.parsed(data, "p", 0)
    assert row[1] == "response" and row[2] == "http://x /y" and row[4] == b"body" and row[5] == 4 and row[6] == sha1


# Collocations


def plain_collocations(docs, least, top, longest=4):
    counts, words = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und" if lang is None else lang
        words[lang] += 0
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            ws = [x for x in re.split("[ \t]", piece) if x]
            words[lang] += len(ws)
            counts.update((lang, tuple(ws[i : i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    f = {k: n for k, n in counts.items() if n >= least}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        score, _, le, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        longer = [n for (g, q), n in f.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * n >= 80 * a for n in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), le, r))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], words[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top]))


@pytest.mark.parametrize("top", [5, 2000])
@pytest.mark.parametrize("size", [64, 1 << 20])
def test_collocations_are_the_plain_ones(spark, monkeypatch, top, size):
    monkeypatch.setattr(collocations, "HOT_PARTS", 3)
    cut = word_runs.pieces
    monkeypatch.setattr(collocations, "pieces", lambda text, kinds, longest: cut(text, kinds, longest, size))
    rng = random.Random(5)
    phrases = ["New York City", "of the", "in the end of", "Ünder çover", "a a a a a", "lo\x1frem"]
    some = lambda: "".join(rng.choice([rng.choice(phrases), rng.choice("abcdefgh"), "the", "x y"]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "?"]) for _ in range(60))
    docs = [(rng.choice(["en", "en", "en", "de", None, "und", 'q"\n\\n']), some()) for _ in range(60)] + [("en", None), (None, ""), ("fr", "one word"), ("de", "a" * 2000), *[("en", "copied words here in the end of the line")] * 12]
    d = spark.createDataFrame([(lang, t, 1, "x") for lang, t in docs], "lang string, text string, n int, phrase string").repartition(3)
    found = collocations.collocations(d, least=5, top=top)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())
    assert got == plain_collocations(docs, 5, top)
    assert got


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).collect() == []


def test_products_beyond_64_bits(spark):
    big = 10**16
    counts = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, size int, n long")
    row = collocations.scored(counts).collect()[0]
    assert (row.l, row.r, row.score) == (3 * big, big, 2_000_000 * (big - 1) // (4 * big))
