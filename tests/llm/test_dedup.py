"""Exact operators against brute force, on made-up and on generated inputs, with the edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import edit, line_dedup, near_dup, queries, substring_dedup, suffix_dedup
from lexloom.llm.common import table

from ..conftest import SF
from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept string"


def frame(spark, docs):
    """With null columns and columns whose names clash with those of results."""
    return spark.createDataFrame([(d, t, None, None, None, "x", "y") for d, t in docs], SCHEMA)


def prose(seed, n_words, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(vocabulary)) for _ in range(n_words))


PASSAGE = prose(1, 60)
EDGES = [
    (1, None), (2, ""), (3, "short"), (4, PASSAGE), (5, PASSAGE), (6, prose(2, 30) + " " + PASSAGE + " " + prose(3, 30)), (7, PASSAGE[10:400]),
    (8, "a" * 300), (9, "a" * 120 + "b" + "a" * 60), (10, "é" * 80), (11, "x y " * 40), (12, prose(4, 30000)), (13, prose(4, 30000)[5000:9000]),
    (None, PASSAGE), (None, prose(5, 40)), (14, PASSAGE), (14, PASSAGE + " tail"), (15, " \t\r\n\x0b\x0c "), (16, "w " * 400), (17, "w " * 30),
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def suffix_rows(spark, docs):
    found = suffix_dedup.dedup_bytes(frame(spark, docs))
    return rows(found.select("doc_id", "n_bytes", *queries._removed(), F.sha2("kept", 256)))


def word_rows(spark, docs):
    found = substring_dedup.dedup_words(frame(spark, docs))
    return rows(found.select("doc_id", "n_words", queries._removed()[0], F.sha2("kept", 256)))


def line_rows(spark, docs):
    return rows(line_dedup.dedup_lines(frame(spark, docs)).select("doc_id", "_ld_lines", "_ld_dropped", F.sha2("text", 256)))


def test_suffix_edges(spark):
    assert suffix_rows(spark, EDGES) == sorted(brute.suffix(EDGES), key=repr)


def test_substring_edges(spark):
    assert word_rows(spark, EDGES) == sorted(brute.windows(EDGES), key=repr)


def test_empty_tables(spark):
    none = frame(spark, EDGES).limit(0)
    assert suffix_dedup.dedup_bytes(none).collect() == substring_dedup.dedup_words(none).collect() == line_dedup.dedup_lines(none).collect() == near_dup.classes(none).collect() == []


def test_whole_tables(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert rows(queries.op2_suffix_array_dedup(spark, SF)) == sorted(brute.suffix(docs), key=repr)
    assert rows(queries.op9_substring_dedup(spark, SF)) == sorted(brute.windows(docs), key=repr)
    assert rows(queries.op8_line_dedup(spark, SF)) == sorted(brute.line_dedup(docs), key=repr)


def test_nothing_goes_unless_the_solver_finds_it(spark, monkeypatch):
    """With a solver that knows no repeats, none is removed: neither step decides by hashes."""
    from lexloom.llm import repeats

    def silent(solve):
        def run(raw, cuts, least, length):
            windows, mins = solve(raw, cuts, least, length)
            return windows, np.full(len(mins), np.iinfo(np.int64).max)

        return run

    for encode, solver, finish, args in ((suffix_dedup.encode_bytes, suffix_dedup.solve, suffix_dedup._finish, (50, 20)), (substring_dedup.encode_words, substring_dedup.solve, substring_dedup._finish, (13, 6))):
        held = []
        monkeypatch.setattr(repeats, "covered", lambda block, told, powers, length, seed, own=repeats.covered, held=held: held.append(own(block, told, powers, length, seed)) or held[-1])
        ids, texts = [d or 0 for d, _ in EDGES], [(t or "").encode() for _, t in EDGES]
        shard = pa.table({"shard": pa.array([0], pa.int32()), "blob": pa.array([repeats.Blob.pack(np.array(ids, np.int64), np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8))])})
        asked = repeats._ask(encode, *args, 1)(shard)
        sent = repeats._send(encode, *args, 1)(shard, repeats._shared(asked))
        for how, want in ((solver, True), (silent(solver), False)):
            held.clear()
            told = repeats._solve(how, args[0])(sent)
            repeats._answer(encode, lambda *_: [], ["x"], [pa.int64()], *args)(shard, told)
            assert any(m.any() for m in held) == want
        monkeypatch.undo()


def test_strings_with_the_same_name_are_compared():
    from lexloom.llm import repeats

    raw = np.frombuffer(b"abcabcabdab", np.uint8)
    begin, size = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 2])
    assert repeats.same_bytes(raw, begin, size, np.array([True, True, True])).tolist() == [True, False, False]
    assert repeats.same_bytes(raw, begin, size, np.array([False, True, False])).tolist() == [False, False, False]


def _cut(strings):
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in strings])))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=10, max_size=60), min_size=1, max_size=8), st.randoms())
def test_parsing_orders_like_brute_force(texts, rng):
    strings = [t.encode() for t in texts]
    raw, cuts = _cut(strings)
    least = np.array([rng.randrange(9) for _ in strings], np.int64)
    _, found = suffix_dedup.solve(raw, cuts, least, 10)
    best = {}
    for s, d in zip(strings, least.tolist(), strict=True):
        for i in range(len(s) - 9):
            best[s[i : i + 10]] = min(d, best.get(s[i : i + 10], 99))
    assert found.tolist() == [best[s[i : i + 10]] for s in strings for i in range(len(s) - 9)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=5, max_size=30), min_size=1, max_size=8), st.randoms())
def test_backward_search_like_brute_force(texts, rng):
    strings = [(" ".join(t) + " ").encode() for t in texts]
    raw, cuts = _cut(strings)
    least = np.array([rng.randrange(9) for _ in strings], np.int64)
    windows, found = substring_dedup.solve(raw, cuts, least, 5)
    best = {}
    for t, d in zip(texts, least.tolist(), strict=True):
        for i in range(len(t) - 4):
            best[tuple(t[i : i + 5])] = min(d, best.get(tuple(t[i : i + 5]), 99))
    assert windows.tolist() == [len(t) - 4 for t in texts]
    assert found.tolist() == [best[tuple(t[i : i + 5])] for t in texts for i in range(len(t) - 4)]


@pytest.mark.parametrize("kind", ["even", "skew", "one", "two"])
def test_wavelet_ranks(kind):
    rng = np.random.default_rng(1)
    x = {"even": rng.integers(0, 37, 1000), "skew": np.minimum(rng.geometric(0.3, 1000), 36), "one": np.full(100, 5), "two": np.array([3] * 99 + [1])}[kind]
    w = substring_dedup.Wavelet(x, 37)
    c, low, high = rng.integers(0, 38, 200), rng.integers(0, len(x) + 1, 200), rng.integers(0, len(x) + 1, 200)
    a, b = w.ranks(c, low, high)
    assert a.tolist() == [int((x[:i] == s).sum()) for s, i in zip(c, low, strict=True)]
    assert b.tolist() == [int((x[:i] == s).sum()) for s, i in zip(c, high, strict=True)]


def test_wavelet_is_compressed():
    """Less than one bit for each symbol over the entropy, but for what fills up each level's last word."""
    x = np.minimum(np.random.default_rng(2).zipf(1.5, 50_000), 3_000)
    p = np.bincount(x) / len(x)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    w = substring_dedup.Wavelet(x, 3_000)
    assert w.bits() <= len(x) * (entropy + 1) + 128 * len(w.levels) < 0.6 * len(x) * 12


LINE = "This Line is long enough"
LINES = [
    (1, None), (2, ""), (3, LINE), (4, f"  {LINE.upper()}\t\nown line of the fourth one"), (5, f"{LINE}\n{LINE}\nx"), (6, "short\nshort"), (7, "short"), (8, "short"),
    (9, "É" * 19), (10, "É" * 19), (11, "É" * 19), (12, "É" * 20), (13, "É" * 20), (14, "É" * 20), (15, "é" * 20), (None, LINE), (None, LINE), (16, "twice is not enough here"), (17, "twice is not enough here\n"), (17, LINE), (18, "\r\n\x0b"),
]


def test_line_edges(spark):
    assert line_rows(spark, LINES) == sorted(brute.line_dedup(LINES), key=repr)


def test_line_dedup_keeps_columns(spark):
    found = line_dedup.dedup_lines(frame(spark, LINES))
    assert found.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "spans", "kept"]
    assert {r.kept for r in found.collect()} == {"y"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 8))
def test_banded_distance(a, b, most):
    d = brute.distance(a, b)
    assert edit.banded(a, b, most) == (d if d <= most else None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), max_size=20))
def test_best_place(pattern, text):
    d = min(brute.distance(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert edit.best_in(pattern, text, 99)[0] == d


def changed(text, every, seed):
    words, rng = text.split(), random.Random(seed)
    for i in range(seed % every, len(words), every):
        words[i] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def near_docs():
    base, other = prose(11, 200), prose(12, 150)
    docs = [(1, base), (2, base), (3, base.upper() + "!"), (4, changed(base, 25, 1)), (5, changed(base, 12, 2)), (6, changed(base, 3, 3)), (7, other), (8, other + " " + prose(13, 20)), (9, prose(14, 200)), (10, None), (11, ""), (12, "..."), (13, "..."), (14, "one two"), (15, "one two"), (None, other), (16, prose(15, 15000)), (17, changed(prose(15, 15000), 50, 4)), (18, "one three"), (19, other + " " + prose(16, 90)), (1, prose(17, 50))]
    return docs


def test_near_classes(spark):
    docs = near_docs()
    small = [x for x in docs if x[0] not in (16, 17)]
    result = near_dup.classes(frame(spark, docs)).collect()
    by = {}
    for r in result:
        by.setdefault(r.doc_id, set()).add(r.class_id)
    want = {}
    for d, c in brute.classes(small, near_dup.tokens):
        want.setdefault(d, set()).add(c)
    assert {d: c for d, c in by.items() if d not in (16, 17)} == want
    assert by[16] == by[17] == {16}
    assert len(result) == len(docs)


def test_one_of_each_class_stays(spark):
    docs = near_docs()
    kept = near_dup.drop_near(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "kept"]
    ids = sorted(r.doc_id for r in kept.collect())
    classes = {r.class_id for r in near_dup.classes(frame(spark, docs)).collect()}
    assert set(ids) == classes and len(ids) == len(classes)


def test_near_dedup_on_whole_table(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    words = {t: near_dup.tokens(t) for _, t in docs}
    found = {r.doc_id: r.class_id for r in queries.op7_minhash_near_dedup(spark, SF).collect()}
    up = {d: d for d, _ in docs}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (d, t) in enumerate(docs):
        for e, u in docs[:i]:
            a, b = words[t], words[u]
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and len(set(a) & set(b)) >= 0.3 * len(set(a)) and edit.banded(a, b, most) is not None:
                up[max(root(d), root(e))] = min(root(d), root(e))
    assert found == {d: root(d) for d, _ in docs}


def test_near_copies_among_strangers_with_a_passage(spark):
    """All share a long passage, so unlike texts lead the buckets in which near copies meet."""
    own = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    passage = own("shared", 237)
    docs = [(i, f"{passage} {own(f's{i}x', 63)}") for i in range(60)]
    for i in range(100, 108):
        text = own(f"p{i}x", 63)
        docs += [(i, f"{passage} {text}"), (i + 100, f"{passage} {changed(text, 4, i)}")]
    words = [near_dup.tokens(t) for _, t in docs]
    assert all(edit.banded(a, b, 60) is None for i, a in enumerate(words[:60]) for b in words[:i])
    found = {r.doc_id: r.class_id for r in near_dup.classes(frame(spark, docs)).collect()}
    assert found == {d: d - 100 if d >= 200 else d for d, _ in docs}


def test_word_counts_bound_distances():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    [counted] = near_dup._counted([pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts]), pa.array(texts)], ["node", "text"])])
    counts = dict(zip(texts, counted.column(1).to_pylist(), strict=True))
    every = sorted(set(texts))
    row = lambda t, leads: {"node": t.encode(), "n_words": len(t.rstrip("\0").split()), "label": t.encode(), "counts": counts[t], "sketch": [7, 9], "bucket": 7, "leads": leads}
    every = [t.ljust(16, "\0")[:16] for t in every if len(t) <= 16]
    counts = {t: counts[t.rstrip("\0")] for t in every}
    kept = near_dup._may_link(0.5)(pa.Table.from_pylist([row(t, x) for t in every for x in (True, False)]))
    left = {(a, b) for a, p in zip(kept.column(0).to_pylist(), kept.column(1).to_pylist(), strict=True) for b in near_dup._split(p)}
    assert not near_dup._may_link(0.5)(pa.Table.from_pylist([{**row(t, x), "bucket": 9} for t in every for x in (True, False)])).num_rows
    assert len(left) < len(every) * (len(every) - 1) / 2
    for a in every:
        for b in every:
            x, y = a.strip("\0").split(), b.strip("\0").split()
            if a < b and brute.distance(x, y) <= int(0.5 * max(len(x), len(y)) + 1e-9):
                assert (a.encode(), b.encode()) in left


def test_recall_at_the_limit():
    """Spread substitutions, up to a fifth of all words."""
    rng, seeds, table_ = random.Random(5), near_dup.seeds_of(near_dup.ORDERS), near_dup.WordHashes()
    hashes = lambda words: np.array([table_[w] for w in words], np.uint64)
    make = lambda words: set(near_dup.sketch(hashes(words), seeds, near_dup.K, near_dup.SAMPLE, near_dup.PICKS).tolist())
    for n in (60, 150, 500):
        found = 0
        for _ in range(100):
            a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            b = list(a)
            for i in rng.sample(range(n), n // 5):
                b[i] = f"z{rng.randrange(10**9)}"
            found += bool(make(a) & make(b))
        assert found >= 90


def test_one_row_of_equal_ones_stays(spark):
    base = prose(11, 200)
    docs = [(1, base), (1, base), (1, base), (2, changed(base, 25, 1)), (3, prose(12, 50)), (None, "x"), (None, "x")]
    kept = near_dup.drop_near(frame(spark, docs))
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(1, base), (3, prose(12, 50))]
    assert kept.count() == 3


def test_links_are_counted(spark):
    base = prose(11, 200)
    docs = [(1, base), (2, changed(base, 25, 1)), (3, prose(12, 50)), (4, base)]
    found = {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in near_dup.classes(frame(spark, docs)).collect()}
    assert found == {1: (1, 3, 1), 2: (1, 3, 1), 3: (3, 1, 0), 4: (1, 3, 1)}


def test_hot_groups_are_dealt(spark, monkeypatch):
    docs = [(i, t) for i, t in enumerate([PASSAGE] * 40 + [changed(prose(11, 200), 30, i) for i in range(30)] + [prose(100 + i, 40) for i in range(10)])]
    want = rows(near_dup.classes(frame(spark, docs)).drop("n_links"))
    monkeypatch.setattr(near_dup, "HOT_ROWS", 5)
    monkeypatch.setattr(near_dup, "BLOCK_NODES", 4)
    monkeypatch.setattr(near_dup, "TILE_NODES", 3)
    assert rows(near_dup.classes(frame(spark, docs)).drop("n_links")) == want


def test_repeated_kmers_are_labelled():
    h = np.array([1, 2, 3, 1, 2, 3, 1, 2], np.uint64)
    once, twice = near_dup.kmers(h[:5], 2), near_dup.kmers(h, 2)
    assert set(once.tolist()) <= set(twice.tolist())
    assert len(set(twice.tolist())) == len(twice)


@pytest.mark.parametrize("n", [2, 700])
def test_large_groups_of_copies(spark, n):
    """Many copies cost one string; counts stay right."""
    docs = [(i, PASSAGE) for i in range(n)]
    found = suffix_rows(spark, docs)
    assert [r[2] for r in sorted(found)] == [0] + [len(PASSAGE)] * (n - 1)
    assert {r.class_id for r in near_dup.classes(frame(spark, docs)).collect()} == {0}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n", min_size=0, max_size=200), min_size=1, max_size=6))
def test_generated_texts(spark, texts):
    docs = list(enumerate(texts))
    assert suffix_rows(spark, docs) == sorted(brute.suffix(docs), key=repr)
    assert word_rows(spark, docs) == sorted(brute.windows(docs), key=repr)


def joined_rows(spark, run):
    """How many rows all joins made that run starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    found = run()
    total, every = 0, store.executionsList()
    for i in range(before, every.size()):
        at = every.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for metric in (node.metrics().apply(j) for j in range(node.metrics().size() if "Join" in node.name() else 0)):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return found, total


def test_components_do_not_go_over_all_edges_in_each_round(spark):
    """Layers of nodes in a row, each node linked to all of the next layer: many edges and a long way from end to end."""
    names = list(range(600))
    random.Random(3).shuffle(names)
    edges = [(names[20 * i + j], names[20 * i + 20 + k]) for i in range(29) for j in range(20) for k in range(20)]
    frame_of = spark.createDataFrame([(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in [*edges, (700, 701), (703, 702), (702, 701), (800, 801)]], "a binary, b binary")
    found, rows_made = joined_rows(spark, lambda: near_dup.components(spark, frame_of).collect())
    found = {int.from_bytes(r.node, "big"): int.from_bytes(r.label, "big") for r in found}
    assert found == dict.fromkeys(names, 0) | dict.fromkeys((700, 701, 702, 703), 700) | {800: 800, 801: 800}
    assert rows_made <= 4 * len(edges)
