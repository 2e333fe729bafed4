"""Module resolution, types, limits and other operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import decode
from lexloom.operators import graph, limits, resolve, search, structural
from lexloom.operators.search import SearchSpec
from lexloom.sources import files, sinks

FILES = [
    "app/main.py", "app/util.py", "app/sub/__init__.py", "app/sub/deep.py", "app/sub/other.py", "src/lib/core.py", "lib.py",
    "web/index.ts", "web/a.ts", "web/b/index.js", "web/shared/c.tsx", "crate/src/main.rs", "crate/src/net.rs", "crate/src/net/tcp.rs", "crate/src/fs/mod.rs", "crate/src/fs/walk.rs",
    "go/cmd/main.go", "go/pkg/z.go", "go/pkg/a.go", "go/pkg/a_test.go", "c/x.c", "c/x.h", "c/include/y.h", "c/sub/z.h",
]
CASES = [
    ("app/main.py", "python", "app.util", None, "app/util.py"), ("app/main.py", "python", ".util", None, "app/util.py"), ("app/main.py", "python", ".", "util", "app/util.py"), ("app/main.py", "python", "app.sub", None, "app/sub/__init__.py"),
    ("app/main.py", "python", "app.sub", "deep", "app/sub/deep.py"), ("app/main.py", "python", "app.sub", "name", "app/sub/__init__.py"), ("app/sub/deep.py", "python", "..util", None, "app/util.py"), ("app/sub/deep.py", "python", "...lib", None, "lib.py"),
    ("app/sub/deep.py", "python", "....lib", None, None), ("app/main.py", "python", "lib.core", None, "src/lib/core.py"), ("app/main.py", "python", "util", None, "app/util.py"), ("app/main.py", "python", "os.path", None, None),
    ("web/index.ts", "typescript", "./a", None, "web/a.ts"), ("web/index.ts", "typescript", "./b", None, "web/b/index.js"), ("web/b/index.js", "javascript", "../a.ts", None, "web/a.ts"), ("web/index.ts", "typescript", "@s/c", None, "web/shared/c.tsx"),
    ("web/index.ts", "typescript", "react", None, None), ("web/index.ts", "typescript", "../../x", None, None), ("web/index.ts", "typescript", "web/a", None, "web/a.ts"),
    ("crate/src/main.rs", "rust", "crate::net::tcp", None, "crate/src/net/tcp.rs"), ("crate/src/main.rs", "rust", "crate::net::tcp::Conn", None, "crate/src/net/tcp.rs"), ("crate/src/main.rs", "rust", "crate::fs", None, "crate/src/fs/mod.rs"),
    ("crate/src/fs/mod.rs", "rust", "self::walk", None, "crate/src/fs/walk.rs"), ("crate/src/net/tcp.rs", "rust", "super::Item", None, None), ("crate/src/main.rs", "rust", "std::io", None, None),
    ("go/cmd/main.go", "go", "example.org/m/pkg", None, "go/pkg/a.go"), ("go/cmd/main.go", "go", "fmt", None, None), ("go/cmd/main.go", "go", "example.org/mother", None, None),
    ("c/x.c", "c", "x.h", None, "c/x.h"), ("c/x.c", "c", "y.h", None, "c/include/y.h"), ("c/x.c", "c", "sub/../sub/z.h", None, "c/sub/z.h"), ("c/x.c", "c", "stdio.h", None, None),
]


def test_resolution(spark):
    imports = spark.createDataFrame([c[:4] for c in CASES], "src string, language string, module string, name string")
    found = resolve.resolve(imports, spark.createDataFrame([(f,) for f in FILES], "file string"), {"@s/": "web/shared/"}, "", {"example.org/m": "go"}, ("c/include",))
    got = {(r.src, r.module, r.name): r.dst for r in found.collect()}
    for src, _, module, name, want in CASES:
        assert got.get((src, module, name)) == want, (src, module, name)


def test_candidates_are_not_sorted(spark):
    """They are many times the files; a task holds its files and lets candidates pass."""
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        imports = spark.createDataFrame([c[:4] for c in CASES], "src string, language string, module string, name string")
        found = resolve.resolve(imports, spark.createDataFrame([(f,) for f in FILES], "file string"), {"@s/": "web/shared/"}, "", {"example.org/m": "go"}, ("c/include",))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin [_path" in plan and "SortMergeJoin [_path" not in plan
        assert found.count() == sum(c[4] is not None for c in CASES)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_names_and_their_surroundings(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "use foo", "b", "food", "foo()"], 1)], "doc_id long, line_no int, line string")
    found = {r.line_no: r.context for r in resolve.references_with_context(lines, "foo", 1).collect()}
    assert found == {2: "a\nuse foo\nb", 5: "food\nfoo()"}


@pytest.mark.parametrize(("line", "want"), [
    ("a%20b+c", "a b+c"), ("x aGVsbG8gd29ybGQh y", "x  [DECODED_B64: hello world!]  y"), ("aGVsbG8gd29ybA", "aGVsbG8gd29ybA"), ("aGVsbG8gd29ybGQhIQ==", " [DECODED_B64: hello world!!] "),
    (decode.encoded("tab\there, line\nend"), " [DECODED_B64: tab\there, line\nend] "), (decode.encoded("grüße an alle hier"), decode.encoded("grüße an alle hier")), (decode.encoded("\x00\x01 binary text here"), decode.encoded("\x00\x01 binary text here")), ("", ""), ("====", "===="),
])
def test_decoding(line, want):
    assert decode.decoded(line) == want


@pytest.mark.parametrize("sizes", [[0.25] * 40, [5.0, 1.0], [0.0] * 5 + [1.0] * 5, [1.5, 0.5, 1.0, 9.0, 0.1]])
def test_budget_keeps_all_that_fits(spark, sizes):
    d = spark.createDataFrame(list(enumerate(sizes)), "i long, x double").repartition(5)
    got = sorted(r.i for r in limits.within_budget(d, F.col("x"), 3, [F.col("i")]).collect())
    want, used = [], 0.0
    for i, x in enumerate(sizes):
        used += x
        if used > 3:
            break
        want.append(i)
    assert got == want


def test_scores_of_lines_without_the_name_are_nothing(spark):
    d = spark.createDataFrame([("rank it", False), ("rank it", True), ("ranking", False), ("none", False)], "line string, test boolean")
    assert [r.s for r in d.select(graph.symbol_score(F.col("line"), "rank", F.col("test")).alias("s")).collect()] == [4, 3, 3, 0]


def test_scans_say_what_they_left_out(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}.txt").write_text("x")
    found = files.scan(spark, str(tmp_path), budget=3).collect()
    assert len(found) == 3 and all(r.result_incomplete and "3 files" in r.incomplete_reason for r in found)
    assert not any(r.result_incomplete for r in files.scan(spark, str(tmp_path), budget=5).collect())
    with pytest.raises(ValueError, match="implicit root"):
        files.scan_guarded(spark, str(tmp_path), ceiling=4)
    assert files.scan_guarded(spark, str(tmp_path), explicit=True, ceiling=4).count() == 5
    assert [r.name for r in files.ordered(files.scan(spark, str(tmp_path)), "path", True).collect()] == [f"f{i}.txt" for i in (4, 3, 2, 1, 0)]
    with pytest.raises(ValueError, match="accessed"):
        files.ordered(files.scan(spark, str(tmp_path)), "accessed")


def test_ignore_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in ((".gitignore", "# note\n*.log\n\nbuild/\n"), (".ignore", "!keep.log\n"), ("a/.gitignore", "!x.log\n*.txt\n"), ("a/.rgignore", "!y.txt\n")):
        (tmp_path / name).write_text(text)
    rules = files.ignore_rules(spark, str(tmp_path))
    assert rules == [("", "*.log", False), ("", "build/", False), ("a", "x.log", True), ("a", "*.txt", False), ("", "keep.log", True), ("a", "y.txt", True)]
    paths = ["b.log", "keep.log", "a/x.log", "a/z.log", "a/y.txt", "a/q.txt", "q.txt", "build/o", "a/keep.log"]
    found = {r.path: r.ignored for r in files.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
    assert [p for p in paths if found[p]] == ["b.log", "a/z.log", "a/q.txt", "build/o"]


def test_types():
    with pytest.raises(ValueError, match="name:glob"):
        files.TypeTable(add=["x"])
    with pytest.raises(ValueError, match="no type"):
        files.TypeTable(add=["x:include:nothing"])
    assert "py: *.py, *.pyi" in files.TypeTable().listed()


def test_pictures_say_what_they_left_out(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    assert "incomplete" in sinks.mermaid(d, 3) and "incomplete" not in sinks.mermaid(d, 5)
    assert "first 3 rows" in sinks.markdown(d, 3) and "first" not in sinks.markdown(d, 5)


def test_start_lines_of_equal_matches(spark):
    d = spark.createDataFrame([(1, "x\na\nb\nq\na\nb\n")], "doc_id long, text string")
    assert [(r.nth, r.start_line, r.breaks) for r in search.multiline(d, "(?s)a\nb").collect()] == [(0, 2, 1), (1, 5, 1)]


def test_searches_refuse_bad_patterns(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="invalid"):
        search.search(d, SearchSpec(["a("]))
    assert search.search(d, SearchSpec(["a("], fixed=True)).count() == 0


@pytest.mark.parametrize("text", ["İx KELVIN K", "ſtop", "Straße STRASSE", "ERROR error", "Kelvin \u212a"])
@pytest.mark.parametrize("pattern", ["error", "k", "stop", "strasse", "kelvin"])
def test_folded_prefilter_loses_nothing(spark, text, pattern):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for fixed, unicode in ((True, False), (False, False), (False, True)):
        spec = SearchSpec([pattern], fixed=fixed, ignore_case=True, unicode=unicode)
        assert search.search(d, spec).count() == search.lines(d).filter(search.predicate(spec, F.col("line"))).count()


def test_tree_queries(spark):
    code = spark.createDataFrame([(1, "class A:\n    def f(self):\n        return g(1)\n"), (2, "def f(:\n"), (3, "def h():\n    pass\n")], "doc_id long, text string")
    q = lambda x: [(r.doc_id, r.line, dict(r.captures)) for r in structural.tree_query(code, x).orderBy("doc_id", "line").collect()]
    assert q("(FunctionDef name: $n)") == [(1, 2, {"n": "f"}), (3, 1, {"n": "h"})]
    assert q("(FunctionDef (Call))") == [(1, 2, {})] and q("(ClassDef (Return (Call func: $f)))") == [(1, 1, {"f": "g"})]
    assert q("(FunctionDef body: (Pass))") == [(3, 1, {})] and q("(_ name: h)") == [(3, 1, {})]
    for bad in ("(", "x", "(A b:", "(A))"):
        with pytest.raises(ValueError, match="tree query"):
            structural.compile_query(bad)


def test_equal_metavariables_whatever_the_spaces(spark):
    d = spark.createDataFrame([(1, "f(a[0], a[ 0 ])"), (2, "f('a b', 'ab')"), (3, "f(a, b)")], "doc_id long, text string")
    assert [r.doc_id for r in structural.ast_search(d, "f($X, $X)").collect()] == [1]


def test_ranks_over_all_tasks(spark):
    from lexloom.operators.ranking import fuse

    legs = [spark.createDataFrame([(i, float((i * 7) % 13)) for i in range(60)], "id long, score double").repartition(6) for _ in range(2)]
    assert sorted(fuse(legs, ["id"]).collect()) == sorted(fuse(legs, ["id"], depth=100).collect())


def test_hot_symbols_meet_all_others(spark, monkeypatch):
    from lexloom.operators import changes, shared

    claims = spark.createDataFrame([(i, i % 2, ["hot", f"s{i % 3}"]) for i in range(20)], "claim_id long, agent_id long, symbols array<string>")
    want = sorted(changes.claim_overlaps(claims).collect())
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    assert sorted(changes.claim_overlaps(claims).collect()) == want


def test_pairs_of_claims_get_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    from lexloom.operators import changes, shared

    claims = spark.createDataFrame([(i, i % 2, ["hot", f"s{i % 3}"]) for i in range(60)], "claim_id long, agent_id long, symbols array<string>")
    want = sorted(changes.claim_overlaps(claims).collect())
    monkeypatch.setattr(shared, "PAIRS", 100, raising=False)
    found = changes.claim_overlaps(claims)
    assert sorted(found.collect()) == want and len(want) == 900
    assert found.rdd.getNumPartitions() >= 60 * 60 / 2 / 100


def test_answers_go_by_use():
    from lexloom.streaming.streams import Answers

    a = Answers(2)
    for key in ("x", "y", "x", "z", "x", "y"):
        a.get(key, "f", lambda key=key: [key])
    assert (a.hits, a.misses) == (2, 4)


def test_many_queries_in_blocks(spark):
    from lexloom.operators.ranking import dense_many

    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 7), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding").filter("vec_id < 9")
    assert sorted(dense_many(vectors, queries, 3, 4).collect()) == sorted(dense_many(vectors, queries, 3).collect())


def test_signatures_of_the_standard():
    """The first and third test vectors of RFC 8032, 7.1."""
    from lexloom.operators import receipts

    for key, public, message, signature in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
    ):
        key, public, message, signature = map(bytes.fromhex, (key, public, message, signature))
        assert receipts.public_key(key) == public and receipts.sign(key, message) == signature
        assert receipts.verify(public, message, signature)
        assert not receipts.verify(public, message + b"x", signature) and not receipts.verify(public, message, signature[:-1] + b"\xff")
        assert not receipts.verify(public, message, b"") and not receipts.verify(b"\xff" * 32, message, signature)


def test_policy_tells_all_reasons(spark, tmp_path):
    from lexloom.operators import rules

    found = spark.createDataFrame([("a", "low", 1)], "rule_id string, severity string, matches long")
    ok, checks = rules.policy(found, {"lint": "true", "gone": "no-such-command"}, str(tmp_path))
    assert not ok and [(n, p) for n, p, _ in checks] == [("rules", True), ("lint", True), ("gone", False)]
    assert rules.policy(found, {}, str(tmp_path))[0] and not rules.policy(found, {}, str(tmp_path), worst="low")[0]


def test_many_candidates_give_the_same(spark, monkeypatch):
    from lexloom.operators import index

    d = spark.createDataFrame([(i, f"a needle {i}\nno\nneedle" if i % 3 else "needles and pins\nx") for i in range(30)], "doc_id long, text string")
    found = [sorted(index.index_search(d, index.build(d), SearchSpec(["needle"], fixed=True, word=True)).collect())]
    monkeypatch.setattr(index, "FEW", 5)
    found.append(sorted(index.index_search(d, index.build(d), SearchSpec(["needle"], fixed=True, word=True)).collect()))
    assert found[0] == found[1] == sorted(search.search(d, SearchSpec(["needle"], fixed=True, word=True)).collect())


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lexloom.operators.shared import shared_dir

    make = lambda master, folder: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: folder), getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(make("spark://host:7077", None))
    assert shared_dir(make("spark://host:7077", "s3://b/c/")) == "s3://b/c"


def test_claims_of_many_symbols_or_rows_overlap_alike(spark, monkeypatch):
    from itertools import product

    from lexloom.operators import changes, shared

    rows = [(i, i % 3, [f"s{(i * j) % 7}" for j in range(i % 5)] + ["s1", None]) for i in range(24)]
    rows += [(3, 1, ["s1", "s2"]), (3, 1, ["s2"]), (4, 9, ["s0"]), (40, 0, [f"s{j}" for j in range(90)]), (41, 1, [f"s{j}" for j in range(3, 80)]), (42, None, ["s1"]), (None, 2, ["s1"]), (43, 2, None), (44, 2, [])]
    want = {}
    for (i, x, xs), (j, y, ys) in product(rows, rows):
        if None not in (i, j, x, y) and i < j and x != y:
            want.setdefault((i, j), []).extend({s for s in xs or [] if s} & {s for s in ys or [] if s})
    want = sorted((i, j, len(both), min(both)) for (i, j), both in want.items() if both)
    claims = spark.createDataFrame(rows, "claim_id long, agent_id long, symbols array<string>")
    assert sorted(map(tuple, changes.claim_overlaps(claims).collect())) == want
    monkeypatch.setattr(changes, "FEW_SYMBOLS", 2)
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    assert sorted(map(tuple, changes.claim_overlaps(claims).collect())) == want


def test_pairs_of_claims_are_not_moved(spark):
    from lexloom.operators import changes

    claims = spark.createDataFrame([(i, i % 2, ["hot", f"s{i % 3}"]) for i in range(60)], "claim_id long, agent_id long, symbols array<string>")
    found = changes.claim_overlaps(claims)
    assert found.count() == 900
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 2
