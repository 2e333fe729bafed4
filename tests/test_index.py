"""Trigram trees and the index in segments: never another answer than a scan's."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import grams as G
from lexloom.operators import index, search, segments
from lexloom.operators.search import SearchSpec
from lexloom.plans import ranking_queries


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Trees

ATOMS = st.sampled_from(["a", "b", "c", "ab", "bca", ".", "[ab]", "[^a]", "[a-c]", "[a-z]", "\\w", "\\.", "\\b", "^", "$", "(?=ab)", "(?:abc|bc)"])
PATTERNS = st.recursive(
    ATOMS,
    lambda p: st.one_of(
        st.builds("({})".format, p), st.builds("(?:{}|{})".format, p, p), st.builds("(?:{}){}".format, p, st.sampled_from(["*", "+", "?", "{2}", "{0,2}", "{1,3}", "+?"])), st.builds("{}{}".format, p, p), st.builds("{}{}{}".format, p, p, p)
    ),
    max_leaves=12,
)


@settings(max_examples=400, deadline=None)
@given(PATTERNS, st.text("abcABCx. ", max_size=14), st.booleans())
def test_a_tree_is_never_stricter_than_its_pattern(pattern, text, fold):
    tree = G.of_regex(pattern, fold)
    if re.search(pattern, text, re.I if fold else 0):
        assert G.holds(tree, lambda g: g in G.folded(text))


@pytest.mark.parametrize(
    "pattern, has, lacks",
    [
        ("(foo|ba[rz])qux", ["xfooquxx", "BARQUX", "bazqux"], ["foo qux", "baqux", "fooqu", "bar", ""]),
        ("foo.*bar", ["foo and bar"], ["foo", "bar"]),
        ("(abc)+de", ["abcde"], ["abc", "cde"]),
        ("a?bcd", ["bcd"], ["bc"]),
        ("[Ll]icen[cs]e(d under)?", ["License"], ["lichen", "licen"]),
        ("x(yz|yw)v", ["xyzv"], ["xyv"]),
        ("ab{3}c", ["abbbc"], ["abbc"]),
        (r"a\.htm", ["a.html"], ["a_html"]),
    ],
)
def test_what_trees_ask_for(pattern, has, lacks):
    tree = G.of_regex(pattern)
    assert tree != G.ANY
    for text in has:
        assert G.holds(tree, lambda g: g in G.folded(text))
    for text in lacks:
        assert not G.holds(tree, lambda g: g in G.folded(text))


@pytest.mark.parametrize("pattern", ["ab", "a.b", "(abc)?", "abc|x", "[a-z]{9}", r"\Qabc\E", "(?x)a b c", "[a&&[b]]bcdef", r"\x{41}bcd", r"\0101bc", "abc{", r"\p{L}+", r"(a)\12345", "(abc", "abc|"])
def test_what_isnt_known_asks_for_nothing(pattern):
    assert G.of_regex(pattern) == G.ANY


def test_folding():
    assert G.of_regex("straße") != G.ANY and G.grams_in(G.of_regex("straße", True)) == {"str", "tra"}
    assert G.grams_in(G.of_regex("skiing", True, True)) == {"iin", "ing"}
    assert G.grams_in(G.of_regex("(?iu)skiing")) == {"iin", "ing"}
    assert G.grams_in(G.of_literal("a\nbcd")) == {"bcd"}
    assert G.holds(G.of_literal("ΟΔΟΣ"), lambda g: g in G.folded("ΟΔΟΣΑ"))


def test_the_rarest_part_is_asked_first():
    tree = G.all_of(["abc", G.some_of(["xyz", "uvw"])])
    assert G.cheapest(tree, {"abc": 5, "xyz": 1, "uvw": 2}) == (3, frozenset(["xyz", "uvw"]))
    assert G.cheapest(tree, {"abc": 2, "xyz": 1, "uvw": 2}) == (2, frozenset(["abc"]))


# Index

TEXTS = [
    "The License\nsecond line", "no match here", "LICENSE\r\nlicense text", "", "\n\n", None, "ab", "caféé licenſe", "x" * 50 + "needle" + "y" * 50, "a needle\nand another needle", "ΟΔΟΣΑ ΟΔΟΣ", "Kilo gram", "𝒳𝒴𝒵 tail", "foo\nqux fooqux", "barqux\tbazqux",
]
SPECS = [
    SearchSpec(["license"], fixed=True), SearchSpec(["license"], fixed=True, ignore_case=True), SearchSpec(["needle", "zzz"], fixed=True), SearchSpec(["(foo|ba[rz])qux"]), SearchSpec(["[Ll]icense", "needle$"]), SearchSpec(["ΟΔΟΣ"], fixed=True),
    SearchSpec(["kilo"], fixed=True, ignore_case=True), SearchSpec(["kilo gram"], ignore_case=True, unicode=True), SearchSpec(["𝒳𝒴𝒵"], fixed=True), SearchSpec(["ab"], fixed=True), SearchSpec(["needle"], invert=True), SearchSpec(["needle"], max_count=1), SearchSpec(["e.l"]), SearchSpec(["qux"], word=True),
    SearchSpec(["nothing at all"], fixed=True), SearchSpec(["license", "e"]), SearchSpec(["(?i)LICEN[CS]E"]),
]


def frame(spark, texts, first=0):
    rows = [(i + first, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, tri string, bucket int").repartition(3)


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    docs = frame(spark, TEXTS).unionByName(spark.createDataFrame([(None, "license of nobody", "x", 1), (0, "again needle", "x", 1)], "doc_id long, text string, tri string, bucket int")).cache()
    return docs, segments.build(docs, str(tmp_path_factory.mktemp("index")), "s1")


@pytest.mark.parametrize("spec", SPECS, ids=str)
@pytest.mark.parametrize("few, direct", [(100_000, 1000), (100_000, 0), (0, 0)])
def test_index_gives_the_rows_of_a_scan(base, monkeypatch, spec, few, direct):
    monkeypatch.setattr(segments, "FEW", few)
    monkeypatch.setattr(segments, "DIRECT", direct)
    docs, index = base
    assert got(index.search(docs, spec)) == got(search.search(docs, spec))


def plain(docs):
    out = {}
    for r in docs.collect():
        if r.doc_id is not None and r.text is not None:
            for line in r.text.split("\n"):
                for g in {line.lower().replace("ς", "σ")[i : i + 3] for i in range(len(line) - 2)}:
                    out[g, r.doc_id] = out.get((g, r.doc_id), 0) + 1
    return sorted(((g, d, n) for (g, d), n in out.items()), key=repr)


def test_postings_are_all_trigrams(base, spark):
    docs, index = base
    assert got(index.postings()) == plain(docs)
    assert got(index.counts()) == got(spark.createDataFrame(plain(docs), "tri string, d long, n long").groupBy("tri").agg(F.count("*"), F.sum("n")))


@pytest.mark.parametrize("block, chars, pairs", [(2, 8, 10), (1024, 1 << 20, 40), (3, 5, 1 << 22)])
def test_blocks_of_any_size_hold_the_same(spark, tmp_path, monkeypatch, block, chars, pairs):
    for name, n in (("BLOCK_DOCS", block), ("CHARS", chars), ("PAIRS", pairs)):
        monkeypatch.setattr(segments, name, n)
    docs = frame(spark, [t for t in TEXTS if t is None or max(map(len, t.split("\n"))) < 20])
    index = segments.build(docs, str(tmp_path))
    found = [(r.tri, r.doc_id) for r in index.postings().collect()]
    assert set(found) == {(g, d) for g, d, _ in plain(docs)}
    blocks = index.blocks().collect()
    assert all(r.docs == sorted(r.docs) and r.first == r.docs[0] and r.last == r.docs[-1] and len(r.docs) == r.n_docs <= block and sum(r.lines) == r.n_lines for r in blocks)


def test_refresh_writes_what_changed_and_equals_a_full_build(spark, tmp_path, monkeypatch):
    texts = [f"document {i} on topic {i % 7} with words {'abcdefgh'[i % 5:]}" for i in range(300)]
    first = segments.build(frame(spark, texts), str(tmp_path / "a"), "s1")
    later = [t if i % 100 else t + " edited now" for i, t in enumerate(texts) if i % 150 != 7]
    ids = [i for i in range(len(texts)) if i % 150 != 7]
    now = spark.createDataFrame([*zip(ids, later), (900, "brand new text"), (901, None)], "doc_id long, text string")
    index = first.refresh(now, "s2")
    assert index.manifest.did == {"reused": 295, "added": 1, "modified": 3, "removed": 2}
    assert [s.docs for s in index.manifest.segments] == [300, 4] and index.manifest.segments[0].dead == 5
    full = segments.build(now, str(tmp_path / "b"))
    assert got(index.postings()) == got(full.postings()) and got(index.counts()) == got(full.counts())
    assert got(index.documents().drop("seg")) == got(full.documents().drop("seg"))
    for spec in (SearchSpec(["edited now"], fixed=True), SearchSpec(["topic [36] "]), SearchSpec(["brand new", "document 7 "], fixed=True)):
        assert got(index.search(now, spec)) == got(search.search(now, spec))
    # Postings that were written: those of 4 documents, beside those of 300.
    size = lambda s: index.blocks(segments=[s]).agg(F.sum("n_docs")).first()[0]
    assert size(index.manifest.segments[1]) < size(index.manifest.segments[0]) / 50
    # An older reader still sees its own version, and can't write over the newer one.
    assert got(first.search(frame(spark, texts), SearchSpec(["edited", "topic 3 "], fixed=True))) == got(search.search(frame(spark, texts), SearchSpec(["edited", "topic 3 "], fixed=True)))
    with pytest.raises(ValueError, match="version 2, not 1"):
        first.refresh(now)
    # Tombstones of a step that was never committed count for nothing.
    first.documents().write.parquet(str(tmp_path / "a" / "tombstones" / "lost"))
    assert segments.Index(spark, str(tmp_path / "a")).documents().count() == 299
    monkeypatch.setattr(segments, "RANGE_DOCS", 50)
    one = index.compact(most=1)
    assert len(one.manifest.segments) == 1 and one.manifest.segments[0].dead == 0 and one.manifest.segments[0].docs == 299
    assert got(one.postings()) == got(full.postings()) and got(one.documents().drop("seg")) == got(full.documents().drop("seg"))
    assert one.compact() is one


def test_an_edited_document_can_come_back(spark, tmp_path):
    v1 = spark.createDataFrame([(1, "first words"), (2, "other words")], "doc_id long, text string")
    v2 = spark.createDataFrame([(1, "second words"), (2, "other words")], "doc_id long, text string")
    index = segments.build(v1, str(tmp_path)).refresh(v2).refresh(v1)
    spec = SearchSpec(["first", "second"], fixed=True)
    assert got(index.search(v1, spec)) == got(search.search(v1, spec)) == [(1, 1, "first words")]
    gone = index.refresh(v1.limit(0))
    assert gone.manifest.segments == [] and gone.postings().collect() == [] and gone.candidates(G.of_literal("words")).collect() == []


def test_nothing_is_indexed(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = segments.build(none, str(tmp_path))
    assert index.postings().collect() == [] and index.search(none, SearchSpec(["abc"], fixed=True)).collect() == []
    assert index.refresh(frame(spark, ["abcd"]).select("doc_id", "text")).manifest.did["added"] == 1


def test_another_format_is_refused(spark, tmp_path):
    segments.build(frame(spark, ["abcd"]), str(tmp_path))
    spark.createDataFrame([('{"format": 99, "version": 7, "segments": [], "source": "", "did": {}}',)], "value string").write.mode("append").text(f"{tmp_path}/manifest")
    with pytest.raises(ValueError, match="format 99"):
        segments.Index(spark, str(tmp_path))


def test_a_query_sees_what_was_added_to_the_files(spark, tmp_path):
    """The index of a table that changed within the session is brought up to it before it answers."""
    rows = lambda first, *texts: spark.createDataFrame([(first + i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    path = f"{tmp_path}/documents.parquet"
    rows(0, "a License", "nothing").write.parquet(path)
    assert got(ranking_queries.flt12(spark, str(tmp_path))) == [(0, 1, "a License")]
    rows(10, "the License again", "nothing").write.mode("append").parquet(path)
    assert got(ranking_queries.flt12(spark, str(tmp_path))) == [(0, 1, "a License"), (10, 1, "the License again")]
    rows(5, "License only").write.mode("overwrite").parquet(path)
    assert got(ranking_queries.flt12(spark, str(tmp_path))) == [(5, 1, "License only")]
    assert got(ranking_queries.idx2(spark, str(tmp_path))) == [(5, 1)]


def test_blocks_outside_the_candidates_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_DOCS", 16)
    monkeypatch.setattr(segments, "DIRECT", 0)
    index = segments.build(frame(spark, [f"common words {'needle' if i == 500 else i}" for i in range(600)]).coalesce(1), str(tmp_path))
    found = index.candidates(G.of_literal("common words needle"))
    assert got(found) == [(500,)]
    assert segments.ranges_of([5, 1, 9, 9, 100], 2) == [(1, 9), (100, 100)] and segments.ranges_of([], 4) == []


def test_pairs_are_gathered_within_a_batch(monkeypatch):
    """A batch with many times the pairs gives blocks on its way; the parts of a long document are counted as one."""
    import pyarrow as pa

    monkeypatch.setattr(segments, "PAIRS", 200)
    monkeypatch.setattr(segments, "CHARS", 100)
    texts = [f"some text {i} of no use\nabc {i * 7}" for i in range(60)] + ["the same words again and again\n" * 40] + ["abcd"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    made = list(segments._build(iter([batch])))
    assert len(made) > 5 and all(sum(len(x) for x in b["docs"].to_pylist()) < 200 + 600 for b in map(pa.Table.from_batches, [[m] for m in made]))
    found = {}
    for b in made:
        for r in b.to_pylist():
            for doc, n in zip(r["docs"], r["lines"], strict=True):
                assert (r["tri"], doc) not in found
                found[r["tri"], doc] = n
    want = {}
    for i, t in enumerate(texts):
        for line in t.split("\n"):
            for g in {line[j : j + 3] for j in range(len(line) - 2)}:
                want[g, i] = want.get((g, i), 0) + 1
    assert found == want


@pytest.mark.parametrize("size", [8, 1 << 20])
def test_trigram_counts_are_those_of_the_strings(spark, monkeypatch, size):
    """A table of one partition is dealt to all cores."""
    from lexloom.functions.text import trigrams
    from lexloom.operators.search import lines

    monkeypatch.setattr(index, "COUNT_BYTES", size)
    texts = ["", None, "ab", "abc", "abcabcABC\n\nxyz\n", "\n\nab\nÉÈé é\U0001f600\U0001f601\U0001f600\U0001f601\U0001f600", "a" * 50 + "\r\n" + "".join(map(chr, range(0x4E00, 0x5600))), "ΑΣ\nΑΣΑ ΟΔΥΣΣΕΥΣ İİİ", "tail\n\n"]
    d = spark.createDataFrame(list(enumerate([*texts, texts[4]])), "doc_id long, text string").coalesce(1)
    want = lines(d).select("doc_id", "line_no", F.size(trigrams(F.col("line"))).cast("long").alias("n")).filter("n > 0")
    found = index.trigram_counts(d)
    assert sorted(found.collect()) == sorted(want.collect())
    assert found.rdd.getNumPartitions() == 4 and found.dtypes == want.dtypes
