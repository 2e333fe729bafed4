"""Lexers, heads of definitions, caller paths, interval joins, sweeps and claims with timers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import graph, ranking, sweep
from lexloom.streaming import streams


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CODE = {
    "go": ('package a\n/* token\n token() */ var x = token(1) // token\ny := `raw token\nstill "token" raw` + token\nz := "a \\" token" + \'"\' + f(token)\n', [(3, True), (5, False), (6, False)]),
    "python": ("x = '''token\ntoken''' ; token()\n# token\ny = \"it's\" + token  # 'token\nz = 'a\\'token'\n", [(2, True), (4, False)]),
    "php": ("<?php\n$a = 'token\ntoken'; token();\n# token\n$h = <<<EOT\ntoken\n  EOT . token;\n/* token */ #[token]\n", [(3, True), (7, False), (8, False)]),
    "rust": ("/* a /* token */ token */ token!();\nlet s = r#\"token \" token\"#; let t: &'token str = token;\nlet m = \"line\ntoken\"; let c = '\"'; token();\n", [(1, False), (2, False), (4, True)]),
    "javascript": ("let a = `token\n${token} token`; token();\n// token\nlet b = 'x' /* token\n*/ + token\n", [(2, True), (5, False)]),
    "java": ('String s = """\n token " token\n """ + token;\nchar c = \'"\'; token(); // "\n', [(3, False), (4, True)]),
    "cpp": ('auto s = R"x(token )" token)x" + token;\nint a = 1; /* token', [(1, False)]),
    "csharp": ('var s = @"a""token\ntoken" + token;\n', [(2, False)]),
    "c": ('#define A "token\nint token = 1;\n', [(2, False)]),
}


@pytest.mark.parametrize("language", sorted(CODE))
def test_references_in_code_only(spark, language):
    text, want = CODE[language]
    files = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "tokens only", "x")], "doc_id long, text string, line string")
    assert [(r.line_no, r.is_call) for r in graph.code_references(files, "token", language).orderBy("line_no").collect()] == want
    shown = files.select("text", graph.masked(F.col("text"), language).alias("m")).filter("text is not null").collect()
    assert all(len(r.m) == len(r.text) and [len(x) for x in r.m.split("\n")] == [len(x) for x in r.text.split("\n")] for r in shown)


def test_long_texts_need_no_stack(spark):
    long = '"' + "a\\n" * 200_000 + '" /*' + "b\n" * 200_000 + "*/ token()"
    files = spark.createDataFrame([(1, long)], "doc_id long, text string")
    for language in graph.LEXEMES:
        found = graph.code_references(files, "token", language).count()
        assert found == 1 or language == "python"  # where two slashes and a star are no comment


def test_rust_heads(spark):
    source = """use std::io;
pub(in crate::a) use ::b::c::{d, e};
extern crate serde;
pub const unsafe extern "C" fn f1(a: u8) {}
    pub(crate) async fn r#try(&self) {}
default fn g() {}
macro_rules! mine {
pub unsafe auto trait T {}
union U { a: u8 }
pub ( super ) struct S;
let fn_ptr = 1;
// fn no() {}
public fn not_rust() {}"""
    rows = spark.createDataFrame([(i + 1, x) for i, x in enumerate(source.split("\n"))], "line_no int, line string")
    assert [(r.line_no, r.kind, r.name) for r in graph.extract(rows, "rust").orderBy("line_no").collect()] == [
        (1, "import", "std::io"), (2, "import", "b::c"), (3, "import", "serde"), (4, "function", "f1"), (5, "function", "r#try"), (6, "function", "g"), (7, "function", "mine"), (8, "class", "T"), (9, "class", "U"), (10, "class", "S"),
    ]


def test_caller_paths_end_in_cycles_and_tell_what_they_leave_out(spark):
    calls = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("e", "d"), ("a", "a"), ("b", "a"), (None, "a")], "caller string, callee string")
    rows = {(r.depth, tuple(r.path)): r.found for r in graph.caller_paths(calls.filter("caller is not null"), "a", 3, 10).collect()}
    assert rows == {(1, ("a", "b")): 2, (1, ("a", "c")): 2, (2, ("a", "b", "c")): 2, (2, ("a", "c", "d")): 2, (3, ("a", "b", "c", "d")): 2, (3, ("a", "c", "d", "e")): 2}
    few = [(r.depth, tuple(r.path), r.found) for r in graph.caller_paths(calls.filter("caller is not null"), "a", 2, 1).orderBy("depth").collect()]
    assert few == [(1, ("a", "b"), 2), (2, ("a", "b", "c"), 1)]
    assert graph.caller_paths(calls.limit(0), "a", 2).collect() == []


@pytest.mark.parametrize("width", [1, 7, 32])
def test_points_meet_their_intervals(spark, width):
    rng = random.Random(width)
    points = [(rng.randrange(3), rng.randrange(-20, 100), i) for i in range(200)] + [(None, 5, 900), (1, None, 901)]
    spans = [(rng.randrange(4), a, a + rng.randrange(-3, 60), j) for j in range(60) for a in [rng.randrange(-20, 100)]] + [(2, 3, 3, 99), (None, 0, 9, 98)]
    p = spark.createDataFrame(points, "k long, at long, i long")
    s = spark.createDataFrame(spans, "k long, a long, b long, j long")
    want = sorted((i, j) for k, at, i in points for k2, a, b, j in spans if k is not None and at is not None and k == k2 and a <= at <= b)
    assert sorted((r.i, r.j) for r in ranking.inside(p, s, "k", "at", "a", "b", width).collect()) == want


def test_a_long_document_spreads_over_its_bins(spark):
    """Lines by chunks of one document: rows in proportion to the lines, and no task with all of them."""
    lines = spark.range(200_000).select(F.lit(1).alias("doc_id"), (F.col("id") + 1).alias("line_no"))
    chunks = spark.range(8_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 25 + 1).alias("start_line"), (F.col("id") * 25 + 30).alias("end_line"), (F.col("id") % 7).cast("double").alias("score"))
    found = ranking.inside(lines, chunks, "doc_id", "line_no", "start_line", "end_line")
    assert found.count() == 8_000 * 30 - 5
    assert ranking.rerank_lines(lines, chunks).count() == 200_000
    sizes = [r["count"] for r in found.repartition(8, "doc_id", F.floor(F.col("line_no") / ranking.BIN)).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / 8


T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_most_at_once(spark):
    rows = [(1, at(1)), (1, at(1.5)), (2, at(2)), (3, at(3.5)), (4, at(23.5)), (5, at(23.75)), (6, at(25)), (None, at(1)), (7, None), (8, at(47)), (1, at(1))]
    events = spark.createDataFrame(rows, "user long, ts timestamp_ntz")
    spans = sweep.sessions(events, "user", "ts", "1 hour")
    assert [(r.user, r.n) for r in spans.orderBy("user", "begin").collect()] == [(1, 3), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (8, 1)]
    # The session of 8 ends at midnight and leaves no third day; 4 and 5 go on into the second.
    assert got(sweep.most_at_once(spans)) == [(T0, 2), (at(24), 2)]
    assert sweep.most_at_once(spans.limit(0)).collect() == []


def test_one_ends_before_another_begins(spark):
    spans = spark.createDataFrame([(at(0), at(2)), (at(2), at(3)), (at(2), at(2)), (at(2.5), at(26))], "begin timestamp_ntz, end timestamp_ntz")
    assert got(sweep.most_at_once(spans)) == [(T0, 2), (at(24), 1)]


def claim(c, kind, hour, ttl=5, agent=1):
    return (c, agent, kind, at(hour), at(hour + ttl))


def drained(spark, tmp_path, files, late="0 seconds"):
    """Each file is a batch of its own."""
    schema = "claim_id long, agent_id long, kind string, at timestamp, expires_at timestamp"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.drain(streams.claim_ends(stream, late), f"{tmp_path}/out", f"{tmp_path}/state")
    return sorted((r.claim_id, r.change, (r["at"] - T0).total_seconds() / 3600) for r in spark.read.schema(streams.CLAIM_ENDS).parquet(f"{tmp_path}/out").collect())


def test_a_claim_ends_without_an_event(spark, tmp_path):
    batches = [[claim(1, "submit", 0), claim(2, "submit", 0), claim(3, "submit", 1, ttl=100)], [claim(2, "submit", 4), claim(9, "submit", 20, ttl=100)], [claim(8, "submit", 21, ttl=100)]]
    assert drained(spark, tmp_path, batches) == [(1, "expired", 5.0), (2, "expired", 9.0)]


def test_renewals_releases_and_gaps(spark, tmp_path):
    batch = [claim(1, "submit", 0), claim(1, "submit", 4), claim(1, "release", 8), claim(1, "release", 9), claim(2, "submit", 0), claim(2, "submit", 7), claim(3, "release", 1), claim(4, "submit", 2), claim(4, "release", 9), claim(5, "submit", 10), claim(5, "submit", 10)]
    assert drained(spark, tmp_path, [batch]) == [(1, "released", 8.0), (2, "expired", 5.0), (4, "expired", 7.0)]


def test_nothing_has_expired_before_the_watermark(spark, tmp_path):
    assert drained(spark, tmp_path, [[claim(1, "submit", 0), claim(2, "submit", 6, ttl=100)]], late="2 hours") == []


FILES = [
    "main.py", "src/a.py", "src/vendor/lib/package.json", "src/vendor/lib/x.py", "src/vendor/lib/y.py", "src/vendor/lib/deep/third_party/z.py", "src/vendor/loose.py", "deep/er/third_party/q.py", "deep/er/third_party/more/third_party/r.py",
    "pkg/pyproject.toml", "pkg/p.py", "pkg/q.py", "used/pyproject.toml", "used/u.py", "used/v.py",
    "tools/skills/one/SKILL.md", "tools/skills/one/run.py", "tools/skills/two/skill.md", "tools/skills/three/run.py", "lib/skills/one/SKILL.md", "lib/skills/one/__init__.py", "own/skills/one/SKILL.md", "own/skills/one/run.py", "bare/skills/a.py", ".claude/hooks/h.py", "lonely/go.mod",
]
IMPORTS = [("pkg/p.py", "pkg/q.py"), ("pkg/p.py", "src/a.py"), ("used/u.py", "used/v.py"), ("main.py", "used/v.py"), ("src/a.py", "src/vendor/lib/x.py"), ("main.py", "own/skills/one/run.py"), ("tools/skills/one/run.py", "tools/skills/three/run.py")]


def test_vendored_subtrees_at_any_depth(spark):
    from lexloom.operators import vendored

    files = spark.createDataFrame([(f, 1) for f in FILES], "path string, dir int")
    found = {r["dir"]: (r.files, r.reasons) for r in vendored.vendored_subtrees(files, spark.createDataFrame(IMPORTS, "src string, dst string")).collect()}
    assert found == {
        "src/vendor/lib": (4, ["manifest:package.json", "name:vendor"]), "deep/er/third_party": (2, ["name:third_party", "vendor-name"]), "pkg": (3, ["manifest:pyproject.toml", "island"]),
        "tools/skills": (4, ["island", "name:skills", "skills"]), ".claude": (1, ["tool-config"]),
    }
    assert vendored.vendored_subtrees(files.limit(0), spark.createDataFrame([], "src string, dst string")).collect() == []


def test_edit_plans(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("t", "a"), ("t2", "c"), ("d", "a"), ("x", "y"), ("z", "t2")], "src string, dst string")
    files = spark.createDataFrame([(f, f.startswith("t")) for f in "a b c d t t2 x y".split()], "file string, is_test boolean")
    scores = spark.createDataFrame([("d", 9.0), ("b", 1.0)], "file string, score double")
    want = [("dependent", 1, "d", 1, 9.0, 3), ("dependent", 2, "b", 1, 1.0, 3), ("primary", 1, "a", 0, 0.0, 1), ("test", 1, "t", 1, 0.0, 2), ("test", 2, "t2", 3, 0.0, 2)]
    assert got(graph.edit_plan(edges, files, scores, "a", 3, 2)) == want
    assert graph.edit_plan(edges, files, scores, "nowhere").collect() == []
