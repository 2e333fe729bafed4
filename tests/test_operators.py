"""Ranking, rules, graphs, changes, structure, streams, sources and sinks on small frames."""

import base64
import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexloom.functions.decode import decoded
from lexloom.operators import changes, classify, graph, inventory, ranking, rules, structural, versions
from lexloom.operators.limits import within_budget
from lexloom.plans import registry
from lexloom.sources import files, sinks
from lexloom.streaming import streams

from .conftest import SF


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_bm25_against_a_loop(spark):
    import math
    import re
    from collections import Counter

    texts = ["the fooBar runs", "bar bar the", "nothing", "foo_bar-baz Bar", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = dict(got(ranking.bm25(d, "fooBar bar", ["id"])))
    terms = [[t.lower() for t in re.findall("[A-Za-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", x).replace("_", " "))] for x in texts]
    mean = sum(map(len, terms)) / len(terms)
    want = {}
    for i, own in enumerate(terms):
        tf = Counter(own)
        s = sum(math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(own) / mean)) for w in ("foo", "bar") if tf[w] and (df := sum(w in t for t in terms)))
        if s:
            want[i] = round(s, 6)
    assert found == want


def test_fusion(spark):
    leg = lambda rows: spark.createDataFrame(rows, "id long, score double")
    a, b = leg([(1, 3.0), (2, 2.0), (3, 2.0)]), leg([(3, 9.0)])
    assert dict(got(ranking.fuse([a, b], ["id"]))) == {1: round(1 / 61, 8), 2: round(1 / 62, 8), 3: round(1 / 61, 8)}
    assert dict(got(ranking.fuse([a, b], ["id"], combine="sum")))[3] == round(1 / 63 + 1 / 61, 8)


def test_zero_vectors_score_zero(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert dict(got(ranking.dense(v, [3.0, 4.0]))) == {1: 0.0, 2: 1.0}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id long, item string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "z")], "query_id long, item string")
    one, two = ranking.metrics(ranked, relevant, 2).orderBy("query_id").collect()
    assert (one.recall, one.precision, one.mrr) == (0.5, 0.5, 0.5)
    assert (two.recall, two.ndcg, two.mrr) == (1.0, 1.0, 0.0)


def test_budget_is_a_prefix(spark):
    r = spark.createDataFrame([(1, 5), (2, 5), (3, 1)], "id long, size int")
    assert [x.id for x in within_budget(r, F.col("size"), 9, [F.col("id")]).collect()] == [1]


def test_pagerank_against_a_loop(spark):
    nodes = list(range(8))
    back = {0: {1, 2, 3}, 1: {4}, 4: {5, 6}}
    seeds = [0, 1]
    p = {n: 0.5 if n in seeds else 0.0 for n in nodes}
    rank = dict(p)
    for _ in range(12):
        new = {n: 0.15 * p[n] for n in nodes}
        for n in nodes:
            for m in back.get(n, ()):
                new[m] += 0.85 * rank[n] / len(back[n])
            if n not in back:
                for s in seeds:
                    new[s] += 0.85 * rank[n] / 2
        rank = new
    edges = spark.createDataFrame([(n, m) for n, ms in back.items() for m in ms], "node long, importer long")
    found = dict(got(graph.personalized_pagerank(spark.range(8).toDF("node"), edges, seeds)))
    assert found == {n: round(r, 6) for n, r in rank.items() if r > 0}


def test_blast_radius_and_centrality(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (4, 3)], "src long, dst long")
    seed = spark.createDataFrame([(1,)], "file long")
    assert got(graph.blast_radius(edges, seed, 2)) == [(1, 0), (2, 1), (3, 2)]
    scores = dict(got(graph.centrality(spark.range(1, 5).toDF("file"), edges, spark.createDataFrame([(1, 99)], "file long, n long"))))
    assert scores == {1: 1 + 1 + 25.0, 2: 2.0, 3: 3.0, 4: 1.0}


def test_scope_needs_a_margin(spark):
    scores = spark.createDataFrame([("a", 3.0), ("b", 2.0)], "dir string, score double")
    assert got(graph.suggested_scope(scores)) == [("a", 3.0)]
    assert got(graph.suggested_scope(scores, 1.6)) == []
    assert got(graph.suggested_scope(scores.filter("dir = 'b'"))) == [("b", 2.0)]


def test_references_skip_strings_and_comments(spark):
    lines = spark.createDataFrame([(1, 'x = foo(1)'), (2, 'y = "foo"'), (3, "# foo"), (4, "a.foo"), (5, "food")], "line_no int, line string")
    assert [(r.line_no, r.is_call) for r in graph.references(lines, "foo").orderBy("line_no").collect()] == [(1, True), (4, False)]


@pytest.mark.parametrize(("language", "line", "want"), [
    ("javascript", "import {a} from './b'", ("import", "./b")), ("typescript", "export class Foo {", ("class", "Foo")), ("go", "func (s *T) Run(x int) {", ("function", "Run")),
    ("java", "public class Foo {", ("class", "Foo")), ("c", '#include "a.h"', ("import", "a.h")), ("php", "use A\\B;", ("import", "A\\B")), ("csharp", "using System.IO;", ("import", "System.IO")),
])
def test_line_extractors(spark, language, line, want):
    found = graph.extract(spark.createDataFrame([(1, line)], "line_no int, line string"), language)
    assert want in [(r.kind, r.name) for r in found.collect()]


def test_rules(spark):
    assert all(r.ok for pack in rules.PACKS for r in rules.test_rules(spark, rules.pack(pack)).collect())
    with pytest.raises(KeyError, match="no rule pack"):
        rules.pack("nope")
    d = spark.createDataFrame([(1, 'token = "abc"\nx # lint-ignore: hardcoded-token\ntoken = "abc"'), (2, None)], "doc_id long, text string")
    hits = rules.match_rules(d, rules.pack("secrets-basic"))
    assert [(r.rule_id, r.line_no) for r in hits.orderBy("line_no").collect()] == [("hardcoded-token", 1), ("hardcoded-token", 3)]
    assert got(rules.inline_ignored(d, hits)) == [("hardcoded-token", 1, 3)]
    report = json.loads(rules.sarif(rules.findings(hits)))
    assert report["version"] == "2.1.0" and report["runs"][0]["results"][0]["ruleId"] == "hardcoded-token"
    assert rules.gate(rules.findings(hits)).first()["passed"]


def test_suppression_wildcards(spark):
    found = spark.createDataFrame([("f", "r", 1, 1), ("f", "r", 2, 5), ("g", "r", 1, 1)], "fingerprint string, rule_id string, doc_id long, line_no int")
    given = spark.createDataFrame([("f", None, 2, None)], "fingerprint string, rule_id string, file long, line int")
    assert [r.doc_id for r in rules.unsuppressed(found, given).orderBy("fingerprint").collect()] == [1, 1]


def test_changes(spark):
    a = spark.createDataFrame([("x", 1, 5), ("y", 1, 5), ("z", 1, 5)], "path string, mtime long, size long")
    b = spark.createDataFrame([("x", 1, 5), ("y", 2, 5), ("w", 1, 1)], "path string, mtime long, size long")
    assert got(changes.changeset(a, b)) == [("w", "added"), ("y", "modified"), ("z", "removed")]


def test_digests_and_chains(spark):
    good = spark.createDataFrame([("a",)], "body string").withColumn("digest", F.sha2("body", 256))
    assert changes.verified(good, "body", "digest").count() == 1
    with pytest.raises(PySparkException, match="digest mismatch"):
        changes.verified(good.withColumn("body", F.lit("b")), "body", "digest").collect()
    chain = spark.createDataFrame([("c", 1, "d1", None), ("c", 2, "d2", "d1"), ("c", 3, "d3", "x")], "chain string, seq long, digest string, prev string")
    assert got(changes.chain_breaks(chain)) == [("c", 3)]


def test_json_diff(spark):
    side = lambda x: spark.createDataFrame([(1, json.dumps(x))], "id long, json string")
    found = got(changes.json_diff(side({"a": 1, "b": {"c": 2, "d": 3}}), side({"a": 1, "b": {"c": 4}, "e": "x"})))
    assert found == [(1, "b.c", "changed", "2", "4"), (1, "b.d", "removed", "3", None), (1, "e", "added", None, "x")]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "v")
    first = versions.create(spark.range(3), root)
    versions.create(spark.range(5), root)
    assert versions.current(spark, root).count() == 5
    versions.undo(spark, root, first)
    assert versions.current(spark, root).count() == 3
    with pytest.raises(ValueError, match="no version"):
        versions.undo(spark, root, "nope")


CODE = "import os\nfrom a.b import c\n\nclass K:\n    def f(self, x: int) -> K:\n        return eval(x, y=1) + eval(x)\n"


def code(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_ast_patterns(spark):
    d = code(spark, CODE, "def broken(:", "﻿eval(1)")
    assert [r.text for r in structural.ast_search(d, "eval($X)").orderBy("doc_id").collect()] == ["eval(x)", "eval(1)"]
    assert [r.multi["A"] for r in structural.ast_search(d, "eval($$$A)").orderBy("doc_id", "start").collect()] == [["x", "y=1"], ["x"], ["1"]]
    same = structural.ast_search(code(spark, "a == a\na == b"), "$X == $X").collect()
    assert [r.text for r in same] == ["a == a"]
    assert [r.single["S"] for r in structural.ast_search(code(spark, 'f("k")\nf(k)'), 'f("$S")').collect()] == ["k"]
    with pytest.raises(ValueError, match="not a pattern"):
        structural.compile_pattern("def (")


def test_rewrites(spark):
    d = code(spark, "é = eval(a)\nb = eval(c)\n")
    edits = structural.plan_rewrites(structural.ast_search(d, "eval($X)"), "safe($X)")
    new = structural.apply_edits(d, edits)
    assert new.first()["text"] == "é = safe(a)\nb = safe(c)\n"
    assert "-é = eval(a)" in new.first()["diff"]
    assert structural.verify_edits(d, new, edits).first()["ok"]
    rows = [(1, 0, 5, "x"), (1, 3, 6, "x"), (1, 5, 9, "x"), (2, 0, 1, "x"), (2, 1, 2, "x")]
    e = spark.createDataFrame(rows, "doc_id long, start long, end long, replacement string")
    assert got(structural.overlapping_files(e)) == [(1,)]
    assert [(r[0], r[1]) for r in got(structural.accepted_edits(e))] == [(1, 0), (1, 5), (2, 0), (2, 1)]


def test_symbols(spark):
    d = code(spark, CODE, "def broken(:")
    assert [(r.kind, r.name) for r in structural.python_symbols(d).collect()] == [("import", "os"), ("import", "a.b"), ("class", "K"), ("function", "f")]
    assert [r.kind for r in structural.python_references(d, "K").collect()] == ["type"]
    assert structural.node_types(d).filter("node_type = 'Call'").count() == 2
    chunks = structural.structural_chunks(code(spark, CODE, "(" + "\n" * 40), 40)
    per = chunks.groupBy("doc_id").agg(F.max("end_line").alias("last")).orderBy("doc_id").collect()
    assert [r["last"] for r in per] == [6, 40]
    assert structural.token_search(code(spark, "f(g(1, 2), [3]); f()"), "f($A, $B)").count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\n")
    (tmp_path / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe bad")
    with gzip.open(tmp_path / "d.txt.gz", "wb") as f:
        f.write(b"zipped\n")
    scan = files.scan(spark, str(tmp_path))
    assert scan.count() == 4
    read = {r.path.rsplit("/", 1)[-1]: r for r in files.documents(scan.filter("name like '%.txt' or name like '%.bin'")).collect()}
    assert set(read) == {"a.txt", "c.txt"}
    assert read["a.txt"].text == "x\r\ny\n"
    assert base64.b64decode(read["c.txt"].raw_base64) == b"\xff\xfe bad"
    assert [r.line for r in files.read_lines(spark, str(tmp_path / "a.txt")).collect()] == ["x\r", "y"]
    assert [r.line for r in files.read_lines(spark, str(tmp_path / "d.txt.gz")).collect()] == ["zipped"]


def test_ignore_rules(spark):
    paths = spark.createDataFrame([("a.log",), ("keep/a.log",), ("build/x",), ("src/build/y",), ("src/b.txt",)], "path string")
    found = dict(got(files.ignored(paths, [("", "*.log", False), ("keep", "*.log", True), ("", "build/", False), ("src", "/b.txt", False)])))
    assert found == {"a.log": True, "keep/a.log": False, "build/x": True, "src/build/y": True, "src/b.txt": True}


def test_inventory_classes(spark):
    d = spark.createDataFrame([("src/test_a.py",), ("a.test.ts",), ("tests/x.md",), ("b.md",), ("c.toml",), ("d",), ("main.py",)], "path string")
    found = {r.path: (r.l, r.c) for r in d.select("path", inventory.language_of(F.col("path")).alias("l"), inventory.category_of(F.col("path")).alias("c")).collect()}
    assert [found[x][1] for x in ("src/test_a.py", "a.test.ts", "tests/x.md", "b.md", "c.toml", "d", "main.py")] == ["test", "test", "test", "doc", "config", "other", "code"]
    assert found["d"][0] == "other" and found["main.py"][0] == "python"
    assert graph.entry_points(d).count() == 1


def test_decode():
    secret = base64.b64encode(b"hello world!").decode()
    assert decoded(f"x%20y {secret}") == "x y  [DECODED_B64: hello world!] "
    assert decoded("a+b") == "a+b"


def test_classify(spark):
    d = spark.createDataFrame([("Fatal thing",), ("slow",), ("trace me",), ("debug",), ("hello",)], "line string")
    assert [r.label for r in classify.classify(d).collect()] == ["error", "warn", "trace", "debug", "info"]
    assert classify.rendered(classify.classify(d), 0.9).first()["shown"] == "[error 0.950] Fatal thing"
    assert [r.truncated for r in classify.budgeted(d, 2, ["line"]).collect()] == [True, True]


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([(1, 2, 'a "q", b')], "doc_id long, line_no int, line string")
    assert json.loads(sinks.envelope(m, "a"))["total_matches"] == 1
    empty = m.limit(0)
    assert json.loads(sinks.envelope(empty, "a"))["matches"] == []
    sinks.ndjson(empty, str(tmp_path / "n"), "a")
    assert [json.loads(r[0])["type"] for r in spark.read.text(str(tmp_path / "n")).collect()] == ["summary"]
    sinks.csv(m, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert (back.file, back.line_number, back.text) == ("1", "2", 'a "q", b')
    sinks.tsv(m, str(tmp_path / "t"))
    assert m.select(sinks.grep_text(F.col("doc_id"), F.col("line_no"), F.col("line")).alias("s")).first()["s"] == '1:2:a "q", b'
    assert "n1 --> n2" in sinks.mermaid(spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert "| doc_id |" in sinks.markdown(m)


def test_streams_equal_batches(spark, tmp_path):
    stream = streams.read_table(spark, SF, "events")
    streams.drain(streams.counts(stream, "1 hour"), str(tmp_path / "o"), str(tmp_path / "s"))
    streamed = spark.read.parquet(str(tmp_path / "o"))
    batch = streams.counts(spark.read.parquet(f"{SF}/events.parquet"), "1 hour")
    assert streamed.count() > 0
    assert streamed.exceptAll(batch).isEmpty()  # open windows are not there yet
    streams.drain(streams.without_repeats(stream), str(tmp_path / "o2"), str(tmp_path / "s2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_snapshot_stream(spark, tmp_path):
    src = tmp_path / "in"
    schema = "path string, mtime long, size long"
    spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("a", 2, 6), ("b", 3, None)], schema).coalesce(1).write.parquet(str(src))
    streams.drain(streams.changes(spark.readStream.schema(schema).parquet(str(src))), str(tmp_path / "o"), str(tmp_path / "s"))
    assert got(spark.read.parquet(str(tmp_path / "o"))) == [("a", "added"), ("a", "modified"), ("b", "added"), ("b", "removed")]


def test_request_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("1", "range", '{"n": 3}'), ("2", "nope", "{}")], "id string, command string, args string").coalesce(1).write.json(str(src))
    requests = spark.readStream.schema("id string, command string, args string").json(str(src))
    streams.serve(requests, {"range": lambda s, a: s.range(a["n"])}, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out/id=1")).count() == 3
    assert "unknown command" in spark.read.json(str(tmp_path / "out/id=2")).first()["error"]


def test_structural_packs(spark):
    scan = lambda pack, language, text: sorted({(r.rule_id, r.line_no) for r in structural.scan_structural(code(spark, text), structural.structural_rules(pack, language), language).collect()})
    assert scan("auth", "python", 'x = 1\njwt.encode(p, "k")\njwt.encode(p, k)\njwt.encode(p, "k", algorithm="H")') == [("python-jwt-encode-hardcoded-secret", 2), ("python-jwt-encode-hardcoded-secret-options", 2), ("python-jwt-encode-hardcoded-secret-options", 4)]
    assert scan("subprocess", "python", "subprocess.run(c, shell=True)\nsubprocess.run(c)") == [("python-subprocess-run-shell-true", 1)]
    assert scan("subprocess", "javascript", 'child_process.exec(f(a, b));\nspawn("sh", ["-c", x]);') == [("javascript-child-process-exec", 1), ("javascript-exec", 1), ("javascript-spawn-sh", 2)]
    assert scan("auth", "rust", 'let jwt_secret = "abc";\nlet jwt_secret = env();') == [("rust-hardcoded-jwt-secret", 1)]
    assert scan("tls", "typescript", "{ rejectUnauthorized: false }") == [("typescript-reject-unauthorized-false", 1)]
    assert len(structural.structural_rules("deserialization", "python")) == 8
    for pack in ("auth", "crypto", "secrets", "deserialization", "subprocess", "tls"):
        for _, _, pattern in structural.structural_rules(pack, "python"):
            structural.compile_pattern(pattern)


def test_islands_and_capsule_take_every_line(spark, tmp_path):
    """Imports count whatever the line number and quantity of the row that holds them."""
    dirs = {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3}
    edges = {(1, 3), (2, 1), (4, 3), (5, 6), (6, 5)}
    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("supplier", list(dirs.items()), "s_suppkey long, s_nationkey int")
    write("orders", [(i, 4) for i in range(3)], "o_orderkey long, o_custkey long")
    write("lineitem", [(s, d - 1, i % 3 + 2, 7.0) for i, (s, d) in enumerate(sorted(edges) * 2)], "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double")
    islands = {str(x) for x in dirs.values() if all((dirs[a] == x) == (dirs[b] == x) for a, b in edges)}
    assert {(r.dir, r.reason) for r in registry.QUERIES["q_grf14_vendored"](spark, str(tmp_path)).collect()} == {(x, "island") for x in islands} == {("3", "island")}
    fan = {f: sum(b == f for _, b in edges) for f in dirs}
    score = {f: (min(fan[f], 12) + sum(a == f for a, _ in edges) + (3 if f == 4 else 0)) * (0.25 if x == 3 else 1.0) for f, x in dirs.items()}
    assert {tuple(r) for r in registry.QUERIES["q_grf16_capsule"](spark, str(tmp_path)).collect()} == {(f, x, score[f], fan[f]) for f, x in dirs.items()}
