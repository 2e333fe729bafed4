"""Line rules, predicates, counts and context on small frames, and metamorphic relations."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import context, index, search
from lexloom.operators.search import SearchSpec
from lexloom.plans.base import table

from .conftest import SF


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_lines(spark):
    found = got(search.lines(docs(spark, "", "\n", "a\r\nb", "a\n", "a\n\n", None)))
    assert found == [(1, 1, ""), (2, 1, "a\r"), (2, 2, "b"), (3, 1, "a"), (4, 1, "a"), (4, 2, "")]


def test_word_groups_alternatives(spark):
    d = docs(spark, "cat dog\ncatdog\nbob cat.")
    assert [r[1] for r in got(search.search(d, SearchSpec(["cat|bob"], word=True)))] == [1, 3]


def test_whole_line_takes_carriage_return(spark):
    assert [r[1] for r in got(search.search(docs(spark, "ab\r\nabc\nab"), SearchSpec(["ab"], line_regexp=True)))] == [1, 3]


def test_fixed_with_word_keeps_both(spark):
    assert [r[1] for r in got(search.search(docs(spark, "a.b\nxa.bx\naxb"), SearchSpec(["a.b"], fixed=True, word=True)))] == [1]


def test_smart_case(spark):
    d = docs(spark, "The\nthe")
    assert len(got(search.search(d, SearchSpec(["the"], smart_case=True)))) == 2
    assert len(got(search.search(d, SearchSpec(["The"], smart_case=True)))) == 1


def test_unicode_classes(spark):
    d = docs(spark, "café x")
    assert not got(search.search(d, SearchSpec([r"caf\w\b"])))
    assert got(search.search(d, SearchSpec([r"caf\w\b"], unicode=True)))


def test_invert_is_the_complement(spark):
    d = table(spark, SF, "documents")
    hits, rest = search.search(d, SearchSpec(["tion"])).count(), search.search(d, SearchSpec(["tion"], invert=True)).count()
    assert hits + rest == search.lines(d).count()


def test_counts_agree(spark):
    d = table(spark, SF, "documents")
    spec = SearchSpec(["the"], fixed=True)
    n = search.search(d, spec).count()
    assert search.count_lines(d, spec).agg(F.sum("n")).first()[0] == n
    assert search.count_with_zero(d, spec).agg(F.sum("n")).first()[0] == n
    assert search.stats(d, spec).first()["lines_matched"] == n
    assert search.count_matches(d, "the").agg(F.sum("n")).first()[0] >= n


def test_files_with_and_without_partition(spark):
    d = table(spark, SF, "documents")
    spec = SearchSpec(["the"], fixed=True)
    assert search.docs_with(d, spec).count() + search.docs_without(d, spec).count() == d.count()


def test_max_count(spark):
    d = docs(spark, "a\na\na", "a")
    assert [search.search(d, SearchSpec(["a"], max_count=n)).count() for n in (0, 1, 2, 9)] == [0, 2, 3, 4]


def test_context_does_not_repeat_lines(spark):
    d = docs(spark, "x\na\nx\na\nx\nx\nx\na")
    found = [r[1] for r in got(context.with_context(d, SearchSpec(["a"], before=1, after=1)))]
    assert found == [1, 2, 3, 4, 5, 7, 8]
    groups = [r[-1] for r in got(context.context_groups(d, SearchSpec(["a"], before=1, after=1)))]
    assert groups == [0, 0, 0, 0, 0, 1, 1]


def test_context_with_max_count_keeps_lines_after(spark):
    d = docs(spark, "a\nx\na\nx")
    assert [r[1] for r in got(context.with_context(d, SearchSpec(["a"], after=1, max_count=1)))] == [1, 2]


def test_context_holds_all_matches(spark):
    d = table(spark, SF, "documents")
    spec = SearchSpec(["tion"], before=2, after=2)
    assert context.with_context(d, spec).filter("matched").count() == search.search(d, spec).count()


def test_eventually(spark):
    d = docs(spark, "A\nA\nB\nA", "AB", "A\nAB\nB")
    assert got(context.eventually(d, SearchSpec(["A"]), SearchSpec(["B"]))) == [(0, 1, 3), (0, 2, 3), (2, 1, 2), (2, 2, 3)]


@pytest.mark.parametrize("n", [0, 1, 29, 30, 31, 55, 56, 80])
def test_chunks_follow_the_loop(spark, n):
    d = docs(spark, "".join(f"l{i}\n" for i in range(n)))
    want, start = [], 0
    while start < n:
        want.append((start + 1, min(start + 30, n)))
        if start + 30 >= n:
            break
        start += 25
    assert [(r.start_line, r.end_line) for r in context.chunks(d).orderBy("chunk_no").collect()] == want


def test_rows_of_chunks_do_not_carry_all_lines(spark):
    """What goes beside the rows that are made is the id alone."""
    plan = context.chunks(docs(spark, "a\nb\n"))._jdf.queryExecution().executedPlan().toString()
    made = [x for x in plan.split("\n") if "Generate" in x]
    assert len(made) == 1 and re.search(r", \[doc_id#\d+L?\], false, \[", made[0])
    assert context.chunks(docs(spark, None, "")).count() == 0


def test_byte_columns_count_bytes(spark):
    found = search.occurrences(docs(spark, "éxaxa"), "xa").orderBy("byte_column").collect()
    assert [r.byte_column for r in found] == [3, 5]


def test_submatches_and_replace(spark):
    d = docs(spark, "ab ab")
    one = search.submatches(d, "ab").first()["submatches"]
    assert [(m["match"], m["start"], m["end"]) for m in one] == [("ab", 0, 2), ("ab", 3, 5)]
    assert search.replace_in_lines(d, "(a)(b)", "$2$1").first()["replaced"] == "ba ba"


def test_stop_on_nonmatch(spark):
    assert [r[1] for r in got(search.stop_on_nonmatch(docs(spark, "x\na\na\nx\na"), SearchSpec(["a"])))] == [2, 3]


def test_invalid_regex_raises(spark):
    with pytest.raises(ValueError, match="invalid"):
        search.check_regex(spark, "(")


def test_broad_scan_is_refused():
    with pytest.raises(ValueError, match="implicit root"):
        search.refuse_broad(1501)
    search.refuse_broad(1501, explicit=True)


@pytest.mark.parametrize("pattern", ["abc", "ab+c", "a?bcd", "x(abc)?y", "[abc]defg", r"a\.bcd", "ab{2}cde", r"\bfoo\b", "a.*needle", "(?i)abc", "a|bcd", "[]x]abc", r"\w+tion"])
def test_required_literal_is_in_every_match(pattern):
    literal = T.required_literal(pattern)
    for text in ("abc", "abbc", "bcd", "abcd", "xy", "xabcy", "adefg", "a.bcd", "abbcde", "foo", "a needle", "ABC", "]abc", "xabc", "nation", "abbb c"):
        if re.search(pattern, text) and literal:
            assert literal in text


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abn\n\r é", max_size=20), min_size=1, max_size=5), st.sampled_from(["ab", "a b", "éa", "aba", "n"]))
def test_index_plan_is_the_scan_plan(spark, texts, literal):
    d = docs(spark, *texts)
    spec = SearchSpec([literal], fixed=True)
    assert got(index.index_search(d, index.build(d), spec)) == got(search.search(d, spec))


def test_index_falls_back(spark):
    assert index.usable(SearchSpec(["ab"], fixed=True)) is None
    assert index.usable(SearchSpec(["éabc"], fixed=True, ignore_case=True)) is None
    assert index.usable(SearchSpec(["abcd"], fixed=True, invert=True)) is None
    assert index.usable(SearchSpec(["a.c"])) is None


def test_index_is_saved_and_versioned(spark, tmp_path):
    d = docs(spark, "hello world", "other")
    postings = index.build(d)
    index.save_index(postings, str(tmp_path))
    assert got(index.load_index(spark, str(tmp_path))) == got(postings)
    spark.createDataFrame([('{"format": 0}',)], "value string").coalesce(1).write.mode("overwrite").text(f"{tmp_path}/meta")
    with pytest.raises(ValueError, match="format 0"):
        index.load_index(spark, str(tmp_path))


def test_filter_and_columns_reach_the_scan(spark):
    d = table(spark, SF, "documents")
    plan = search.search(d, SearchSpec(["License"], fixed=True))._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,License)" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_linear_engine_refuses_look_around(spark):
    from lexloom.operators.linear import search_linear

    d = docs(spark, "foo\nbar")
    assert got(search_linear(d, "fo+")) == [(0, 1, "foo")]
    with pytest.raises(Exception, match=r"(?i)invalid|perl|\(\?="):
        search_linear(d, "a(?=b)")
