"""Many patterns at once against one after another."""

import random

import pytest

from lexloom.operators import many, rules


def plain(docs, patterns):
    out = set()
    for d, t in docs:
        if t:
            for i, line in enumerate((t[:-1] if t.endswith("\n") else t).split("\n")):
                out |= {(d, i + 1, k) for k, p in enumerate(patterns) if p in line}
    return out


DOCS = [(1, "abcabc\nxyz\n\nabc"), (2, None), (3, ""), (4, "\n\n"), (5, "é日本 abc\r\nlast"), (None, "nobody abc"), (7, "a" * 300), (8, "xyz" * 100 + "\n" + "b" * 250 + "needle in a long line" + "c" * 250)] + [
    (20 + i, "".join(random.Random(i).choices("ab xy\n", k=400))) for i in range(20)
]
PATTERNS = ["abc", "abc", "x", "xyz", "é日", "a" * 7, "a" * 300, "a" * 301, "needle in a long line", "", "a\nb", "last", "\r", "zzzz", *("".join(random.Random(100 + i).choices("ab xy", k=1 + i % 9)) for i in range(200))]


@pytest.mark.parametrize("text, pairs, block", [(1 << 20, 1 << 18, 8 << 20), (64, 7, 40), (1, 1000, 300)])
def test_all_lines_of_all_patterns(spark, monkeypatch, text, pairs, block):
    for name, n in (("TEXT_BYTES", text), ("PAIRS", pairs), ("PATTERN_BYTES", block)):
        monkeypatch.setattr(many, name, n)
    patterns = PATTERNS if block > 1000 else PATTERNS[:40]
    d = spark.createDataFrame([(*x, "p", 1) for x in DOCS], "doc_id long, text string, pattern string, pattern_id int").repartition(3)
    found = [tuple(r) for r in many.match_many(d, patterns).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(DOCS, patterns)


def test_the_sample_changes_no_row(spark, monkeypatch):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    monkeypatch.setattr(many, "SAMPLE", 0)
    assert {tuple(r) for r in many.match_many(d, PATTERNS).collect()} == plain(DOCS, PATTERNS)


def test_nothing_to_look_for_or_in(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert many.match_many(d, []).collect() == [] and many.match_many(d.limit(0), ["a"]).collect() == []


def test_hundreds_of_rules_match_as_one_by_one(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    made = tuple(rules.Rule(f"r{i}", (rf"{'ab xy'[i % 5]}{'xyab'[i % 4]}+b",) if i % 7 else (r"[xy]{3}", "needle"), "low") for i in range(60)) + (rules.Rule("any", (r"^\w",), "low"),)
    key = lambda df: sorted({(r.rule_id, r.severity, r.doc_id, r.line_no, r.line) for r in df.collect() if r.doc_id is not None})
    want = key(rules.match_rules(d, made))
    assert key(many.match_rules(d, made)) == want and want
