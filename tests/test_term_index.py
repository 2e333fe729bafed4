"""Term postings against scores from texts."""

import random

import pytest

from lexloom.operators import ranking, term_index

WORDS = ["the", "of", "a", "rare", "theCamel", "snake_case", "x-y", "Zürich", "42"]
QUERIES = ["the rare camel", "of", "case zzz", "zzz", "", "the of a rare 42 y rich"]


def got(df):
    return [tuple(r) for r in df.collect()]


def units(spark, n=400, seed=1):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choices(WORDS, [40, 30, 20, 1, 2, 2, 2, 1, 1], k=rng.randrange(30)))
    rows = [(i // 3, i % 3, text(), 0.5) for i in range(n)] + [(900, 0, None, 0.5), (901, 0, "", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, chunk_no int, text string, score double").repartition(3)


@pytest.fixture(scope="module", params=[(4, 50), (128, 2_000_000)], ids=str)
def built(request, spark, tmp_path_factory):
    patch = pytest.MonkeyPatch()
    patch.setattr(term_index, "BLOCK", request.param[0])
    patch.setattr(term_index, "TEXT_BYTES", request.param[1])
    own = units(spark).cache()
    yield own, term_index.build(own, ["doc_id", "chunk_no"], str(tmp_path_factory.mktemp("terms")))
    patch.undo()


@pytest.mark.parametrize("query", QUERIES)
def test_scores_are_those_of_the_texts(built, query):
    own, index = built
    want = sorted(got(ranking.bm25(own, query, ["doc_id", "chunk_no"]))) if query else []
    assert sorted(got(index.bm25(query))) == want if query else True


@pytest.mark.parametrize("query", QUERIES[:4] + QUERIES[5:])
@pytest.mark.parametrize("k", [1, 10, 1000])
def test_the_best_are_the_best_of_all(built, query, k):
    own, index = built
    found, read = index.top(query, k, own)
    assert got(found) == got(ranking.top(ranking.bm25(own, query, ["doc_id", "chunk_no"]), k, ["doc_id", "chunk_no"]))
    assert read["read"] <= read["blocks"]


def test_most_blocks_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(term_index, "BLOCK", 16)
    rows = [(i, "common " * (1 + i % 5) + "filler " * (i % 40) + ("rare" if i % 500 == 7 else "")) for i in range(3000)]
    own = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    index = term_index.build(own, ["doc_id"], str(tmp_path))
    found, read = index.top("common rare", 5, own)
    assert got(found) == got(ranking.top(ranking.bm25(own, "common rare", ["doc_id"]), 5, ["doc_id"]))
    assert read["read"] < read["blocks"] / 4


def test_terms_are_split_alike(spark):
    from pyspark.sql import functions as F

    from lexloom.functions.text import split_terms

    texts = ["aBcD eF", "HTTPServer2Go 2x 2X a_B-c aB aB", "snake_case-x", "Ünï ZÜrich", "", "a1B2", "x" * 50 + "Y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_terms(F.col("t")).alias("s")).collect()
    words, term, unit, n, size = term_index.counted_terms([t.encode() for t in texts])
    found = {(texts[u], words[t]): int(k) for t, u, k in zip(term, unit, n)}
    assert found == {(r.t, w): r.s.count(w) for r in rows for w in r.s}
    assert size.tolist() == [len(next(r.s for r in rows if r.t == t)) for t in texts]


def test_no_units(spark, tmp_path):
    none = units(spark).limit(0)
    index = term_index.build(none, ["doc_id", "chunk_no"], str(tmp_path))
    assert got(index.bm25("the")) == [] and got(index.top("the", 3, none)[0]) == []
