"""Queries of inventories, rules, graphs, changes, ledgers, structure, streams and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import changes, classify, graph, inventory, many, receipts, resolve, rules, structural, sweep, vendored
from lexloom.operators.limits import within_budget
from lexloom.operators.search import SearchSpec, lines, search
from lexloom.operators.shared import new_path
from lexloom.plans.base import LINES, ORACLE_SQL, query, table
from lexloom.plans.search_queries import docs
from lexloom.sources import sinks
from lexloom.streaming import streams

def _path():
    return F.regexp_extract("url", "//[^/]+/([^?#]*)", 1)


PATH_SQL = "regexp_extract(url, '//[^/]+/([^?#]*)', 1)"


# Inventories


@query("q_agg7_inventory", """SELECT 'lang' AS dimension, lang AS value, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, count(*), sum(strlen(text))::BIGINT FROM documents GROUP BY source
UNION ALL SELECT 'total', '', count(*), sum(strlen(text))::BIGINT FROM documents""")  # fmt: skip
def agg7(spark, sf_dir):
    files = docs(spark, sf_dir).select("lang", "source", F.octet_length("text").alias("size"))
    return inventory.inventory(files, ["lang", "source"])


@query("q_agg7_largest", "SELECT doc_id, strlen(text)::INTEGER AS size FROM documents ORDER BY size DESC, doc_id LIMIT 10")
def agg7_largest(spark, sf_dir):
    return inventory.largest(docs(spark, sf_dir).select("doc_id", F.octet_length("text").alias("size")), "doc_id")


_MENTIONS = "m AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{6,}')) AS mention FROM documents)"
_NAMES = "f AS (SELECT DISTINCT regexp_replace(list_extract(string_split(u, '/'), -1), '[?#].*$', '') AS name FROM (SELECT unnest(regexp_extract_all(html, 'href=\"/[^\"]*')) AS u FROM pages))"


def _names(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/[^"]*'), F.lit(0))).alias("u"))
    return links.select(F.regexp_replace(F.element_at(F.split("u", "/"), -1), "[?#].*$", "").alias("name")).distinct()


@query("q_agg8_docs_coverage", f"WITH {_MENTIONS}, {_NAMES} SELECT name, name IN (SELECT mention FROM m) AS covered FROM f")
def agg8(spark, sf_dir):
    return inventory.coverage(_names(spark, sf_dir), inventory.mentions(docs(spark, sf_dir), "[a-z]{6,}"), "name")


@query("q_agg9_stale_references", f"WITH {_MENTIONS}, {_NAMES} SELECT mention FROM m WHERE mention NOT IN (SELECT name FROM f)")
def agg9(spark, sf_dir):
    return inventory.stale_references(inventory.mentions(docs(spark, sf_dir), "[a-z]{6,}"), _names(spark, sf_dir), "name")


# Rules

CORPUS_RULES = (
    rules.Rule("token-literal", (r"\btoken = \"[0-9a-f]{16,}\"",), "high", invalid=('token = "0123456789abcdef01"',), valid=('token = ""',)),
    rules.Rule("mail-address", (r"[a-z]+[.][0-9]+@mail[0-9]+[.]example[.]com", r"[a-z]+@example[.]org"), "medium", invalid=("ab.1@mail2.example.com",), valid=("ab at example",)),
    rules.Rule("insult", (r"\bstupid\b", r"\bworthless\b"), "low", invalid=("a stupid thing",), valid=("stupidity",)),
)
_RULES_SQL = " UNION ALL ".join(
    f"SELECT '{r.id}' AS rule_id, '{r.severity}' AS severity, doc_id, line_no, line FROM lines WHERE " + " OR ".join(f"regexp_matches(line, '{p}')" for p in r.patterns) for r in CORPUS_RULES
)
MATCHED = f"{LINES}, hits AS ({_RULES_SQL})"
_PRINT = """sha256('{"file": "' || doc_id || '", "rule_id": "' || rule_id || '", "snippet": "' || trim(line) || '"}')"""


def _hits(spark, sf_dir):
    return rules.match_rules(docs(spark, sf_dir), CORPUS_RULES)


@query("q_rul1_pack_rules", f"WITH {LINES} SELECT '{{0}}' AS rule_id, doc_id, line_no FROM lines WHERE regexp_matches(line, '\\btoken\\s*=\\s*[\"''][^\"'']+[\"'']')".replace("{0}", "hardcoded-token"))
def rul1(spark, sf_dir):
    return rules.match_rules(docs(spark, sf_dir), rules.pack("secrets")).select("rule_id", "doc_id", "line_no")


@query("q_rul2_scan", f"WITH {MATCHED} SELECT rule_id, severity, doc_id, line_no, line FROM hits")
def rul2(spark, sf_dir):
    return _hits(spark, sf_dir)


_WORD_RULES = "SELECT DISTINCT regexp_extract(text, '[a-z]{7,}') AS w FROM documents WHERE doc_id < 400 AND regexp_extract(text, '[a-z]{7,}') <> ''"


@query("q_rul2_many_rules", f"WITH {LINES}, r AS ({_WORD_RULES}) SELECT 'word-' || w AS rule_id, doc_id, line_no, line FROM lines JOIN r ON contains(line, w) WHERE regexp_matches(line, '[^a-z]' || w || '[a-z]?[^a-z]')")
def rul2_many(spark, sf_dir):
    """Up to 400 rules, each for a long word of the first documents, over all lines of all documents."""
    own = docs(spark, sf_dir)
    words = own.filter("doc_id < 400").select(F.regexp_extract("text", "[a-z]{7,}", 0).alias("w")).filter("w <> ''").distinct()
    made = tuple(rules.Rule(f"word-{r['w']}", (f"[^a-z]{r['w']}[a-z]?[^a-z]",), "low") for r in words.collect())  # 400 at most
    return many.match_rules(own, made).select("rule_id", "doc_id", "line_no", "line")


@query("q_agg11_findings", f"WITH {MATCHED}, t AS (SELECT rule_id, severity, count(*) AS matches, count(DISTINCT doc_id) AS files FROM hits GROUP BY ALL), e AS (SELECT rule_id, doc_id FROM (SELECT DISTINCT rule_id, doc_id FROM hits) QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY doc_id) <= 3) SELECT t.*, list(doc_id ORDER BY doc_id) AS evidence FROM t JOIN e USING (rule_id) GROUP BY ALL")
def agg11(spark, sf_dir):
    return rules.findings(_hits(spark, sf_dir))


@query("q_rul3_any_of", f"WITH {MATCHED} SELECT DISTINCT doc_id, line_no FROM hits WHERE rule_id = 'insult'")
def rul3(spark, sf_dir):
    return rules.match_rules(docs(spark, sf_dir), CORPUS_RULES[2:]).select("doc_id", "line_no").distinct()


@query("q_rul4_rule_tests", " UNION ALL ".join(f"SELECT '{r.id}' AS rule_id, '{kind}' AS kind, '{s}' AS snippet, ({' OR '.join(f'''regexp_matches('{s}', '{p}')''' for p in r.patterns)}) = {str(kind == 'invalid').lower()} AS ok" for r in CORPUS_RULES for kind, ss in (("valid", r.valid), ("invalid", r.invalid)) for s in ss))
def rul4(spark, sf_dir):
    return rules.test_rules(spark, CORPUS_RULES)


_BASELINE = f"{MATCHED}, p AS (SELECT DISTINCT {_PRINT} AS fingerprint, doc_id FROM hits), now AS (SELECT fingerprint FROM p WHERE doc_id % 3 <> 0), base AS (SELECT fingerprint FROM p WHERE doc_id % 4 <> 0)"


def _versions(spark, sf_dir):
    """Findings of two versions of the corpus: one without every third document, one without every fourth."""
    found = rules.with_fingerprint(_hits(spark, sf_dir))
    return found.filter("doc_id % 3 <> 0"), found.filter("doc_id % 4 <> 0")


@query("q_rul5_baseline", f"WITH {_BASELINE} SELECT coalesce(now.fingerprint, base.fingerprint) AS fingerprint, CASE WHEN base.fingerprint IS NULL THEN 'new' WHEN now.fingerprint IS NULL THEN 'resolved' ELSE 'existing' END AS status FROM (SELECT DISTINCT * FROM now) now FULL JOIN (SELECT DISTINCT * FROM base) base ON now.fingerprint = base.fingerprint")
def rul5(spark, sf_dir):
    return rules.status(*_versions(spark, sf_dir))


@query("q_jn5_new_findings", f"WITH {_BASELINE} SELECT DISTINCT fingerprint FROM now WHERE fingerprint NOT IN (SELECT fingerprint FROM base)")
def jn5(spark, sf_dir):
    now, base = _versions(spark, sf_dir)
    return now.select("fingerprint").distinct().join(base.select("fingerprint"), "fingerprint", "left_anti")


@query("q_set3_resolved", f"WITH {_BASELINE} SELECT DISTINCT fingerprint FROM base EXCEPT SELECT fingerprint FROM now")
def set3(spark, sf_dir):
    now, base = _versions(spark, sf_dir)
    return base.select("fingerprint").subtract(now.select("fingerprint"))


@query("q_jn6_suppressions", f"""WITH {MATCHED}, p AS (SELECT *, {_PRINT} AS fingerprint FROM hits), s AS (SELECT fingerprint, CASE WHEN doc_id % 2 = 0 THEN rule_id END AS rule_id, NULL::BIGINT AS file, CASE WHEN doc_id % 5 = 0 THEN line_no + 1 END AS line FROM p)
SELECT rule_id, doc_id, line_no FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.fingerprint = p.fingerprint AND (s.rule_id IS NULL OR s.rule_id = p.rule_id) AND (s.file IS NULL OR s.file = p.doc_id) AND (s.line IS NULL OR s.line = p.line_no))""")
def jn6(spark, sf_dir):
    found = rules.with_fingerprint(_hits(spark, sf_dir))
    given = found.select("fingerprint", F.expr("if(doc_id % 2 = 0, rule_id, null)").alias("rule_id"), F.lit(None).cast("long").alias("file"), F.expr("if(doc_id % 5 = 0, line_no + 1, null)").alias("line"))
    return rules.unsuppressed(found, given).select("rule_id", "doc_id", "line_no")


@query("q_fn12_inline_ignore", f"""WITH {MATCHED}, k AS (SELECT doc_id, line_no, regexp_extract(line, 'note:\\s*([A-Za-z0-9_*, -]+)', 1) AS note FROM lines)
SELECT DISTINCT rule_id, h.doc_id, h.line_no FROM hits h JOIN k ON k.doc_id = h.doc_id AND h.line_no IN (k.line_no, k.line_no + 1) WHERE note <> '' AND list_has_any(string_split_regex(trim(note), '\\s*,\\s*'), ['*', rule_id])""")
def fn12(spark, sf_dir):
    return rules.inline_ignored(docs(spark, sf_dir), _hits(spark, sf_dir), "note")


@query("q_rul6_sarif")
def rul6(spark, sf_dir):
    return spark.createDataFrame([(rules.sarif(rules.findings(_hits(spark, sf_dir))),)], "sarif string")


@query("q_rul7_gate", f"WITH {MATCHED} SELECT count(*) FILTER (WHERE severity = 'high') = 0 AS passed, count(*) AS matches FROM hits")
def rul7(spark, sf_dir):
    return rules.gate(rules.findings(_hits(spark, sf_dir)))


@query("q_rul7_policy", f"WITH {MATCHED} SELECT * FROM (SELECT 'lint' AS name, true AS passed UNION ALL SELECT 'rules', (SELECT count(*) FILTER (WHERE severity = 'high') = 0 FROM hits) UNION ALL SELECT 'test', false UNION ALL SELECT 'slow', false)")
def rul7_policy(spark, sf_dir):
    """The rules and three commands: one that passes, one that fails, one that is stopped."""
    commands = {"lint": "true", "test": "false", "slow": "sleep 5"}
    _, checks = rules.policy(rules.findings(_hits(spark, sf_dir)), commands, "/", seconds=0.3)
    return spark.createDataFrame([(name, ok) for name, ok, _ in checks], "name string, passed boolean")


# Graphs: orders stand for files, parts for modules, suppliers for directories.

EDGES_SQL = "edges AS (SELECT DISTINCT l_suppkey AS src, (l_partkey % 97 + 1)::BIGINT AS dst FROM lineitem WHERE l_suppkey <> l_partkey % 97 + 1)"


def _edges(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 97 + 1).alias("dst"))
    return found.filter("src <> dst").distinct()


@query("q_grf8_importers", f"WITH {EDGES_SQL} SELECT DISTINCT src AS file, 'importer' AS side FROM edges WHERE dst = 5 UNION ALL SELECT DISTINCT dst, 'imported' FROM edges WHERE src = 5")
def grf8(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.importers(e, 5).withColumn("side", F.lit("importer")).unionByName(graph.imported(e, 5).withColumn("side", F.lit("imported")))


@query("q_grf10_blast_radius", f"WITH RECURSIVE {EDGES_SQL}, r(file, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT src, depth + 1 FROM r JOIN edges ON dst = file WHERE depth < 3) SELECT file, min(depth)::INTEGER AS depth FROM r GROUP BY file")
def grf10(spark, sf_dir):
    seeds = spark.range(5, 6).select(F.col("id").alias("file"))
    return graph.blast_radius(_edges(spark, sf_dir), seeds, 3)


def _paths_sql(seed: int, max_depth: int, most: int) -> str:
    parts = [EDGES_SQL, f"k0 AS (SELECT [{seed}]::BIGINT[] AS path)"]
    for d in range(1, max_depth + 1):
        parts.append(f"s{d} AS (SELECT list_append(path, src) AS path FROM k{d - 1} JOIN edges ON dst = path[-1] WHERE NOT list_contains(path, src))")
        parts.append(f"k{d} AS (SELECT path, (SELECT count(*) FROM s{d}) AS found FROM s{d} ORDER BY path LIMIT {most})")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {d} AS depth, path, found FROM k{d}" for d in range(1, max_depth + 1))


@query("q_grf10_caller_paths", _paths_sql(5, 3, 200))
def grf10_paths(spark, sf_dir):
    """A tree of callers with a budget a level, which tells what it leaves out."""
    calls = _edges(spark, sf_dir).select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    return graph.caller_paths(calls, 5, 3, 200)


def _pagerank_sql(iterations: int = 12) -> str:
    steps = [f"{EDGES_SQL}, nodes AS (SELECT s_suppkey AS node FROM supplier), b AS (SELECT dst AS node, src AS importer FROM edges WHERE dst IN (SELECT node FROM nodes)), o AS (SELECT node, count(*) AS n FROM b GROUP BY node)"]
    steps.append("r0 AS (SELECT node, coalesce(n, 0) AS n, CASE WHEN node IN (1, 2) THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS p, CASE WHEN node IN (1, 2) THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS rank FROM nodes LEFT JOIN o USING (node))")
    for i in range(1, iterations + 1):
        q = f"r{i - 1}"
        steps.append(f"f{i} AS (SELECT importer AS node, sum(0.85 * rank / n) AS inflow FROM {q} JOIN b USING (node) WHERE n > 0 GROUP BY importer), s{i} AS (SELECT coalesce(sum(rank) FILTER (WHERE n = 0), 0) AS spill FROM {q})")
        steps.append(f"r{i} AS MATERIALIZED (SELECT node, n, p, 0.15 * p + coalesce(inflow, 0) + 0.85 * spill * p AS rank FROM {q} LEFT JOIN f{i} USING (node), s{i})")
    return f"WITH {', '.join(steps)} SELECT node, round(rank, 6) AS rank FROM r{iterations} WHERE rank > 0"


@query("q_grf11_pagerank", _pagerank_sql())
def grf11(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    back = _edges(spark, sf_dir).select(F.col("dst").alias("node"), F.col("src").alias("importer")).join(nodes, "node", "left_semi")
    return graph.personalized_pagerank(nodes, back, [1, 2])


_CENTRAL_SQL = f"""WITH {EDGES_SQL}, a AS (SELECT dst AS file, count(*) AS a FROM edges GROUP BY ALL), b AS (SELECT src AS file, count(*) AS b FROM edges GROUP BY ALL), c AS (SELECT o_custkey AS file, count(*) AS c FROM orders GROUP BY ALL),
central AS (SELECT s_suppkey AS file, s_nationkey AS dir, ((least(coalesce(a, 0), 12) + coalesce(b, 0) + least(coalesce(c, 0), 25))::DOUBLE * CASE WHEN s_nationkey = 3 THEN 0.25 ELSE 1.0 END)::DOUBLE AS score FROM supplier s LEFT JOIN a ON a.file = s_suppkey LEFT JOIN b ON b.file = s_suppkey LEFT JOIN c ON c.file = s_suppkey)"""


def _central(spark, sf_dir, edges=None):
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").alias("dir"))
    symbols = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.count("*").alias("n"))
    vendored = nodes.filter("dir = 3").select("file", F.lit(True).alias("v"))
    plain = graph.centrality(nodes.select("file"), _edges(spark, sf_dir) if edges is None else edges, symbols)
    scored = plain.join(vendored, "file", "left").select("file", (F.col("score") * F.when(F.col("v"), 0.25).otherwise(1.0)).alias("score"))
    return scored.join(nodes, "file")


@query("q_grf12_centrality", f"{_CENTRAL_SQL} SELECT file, score FROM central ORDER BY score DESC, file LIMIT 20")
def grf12(spark, sf_dir):
    return _central(spark, sf_dir).select("file", "score").orderBy(F.desc("score"), "file").limit(20)


_PLAN_SQL = _CENTRAL_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, rec(file, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT src, depth + 1 FROM rec JOIN edges ON dst = file WHERE depth < 2),
m AS (SELECT file, min(depth)::INTEGER AS depth FROM rec GROUP BY file), w AS (SELECT m.file, depth, score, CASE WHEN depth = 0 THEN 'primary' WHEN dir % 5 = 0 THEN 'test' ELSE 'dependent' END AS role FROM m JOIN central USING (file))
SELECT role, rank::INTEGER AS rank, file, depth, score, found FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY depth, score DESC, file) AS rank, count(*) OVER (PARTITION BY role) AS found FROM w) WHERE rank <= 15"""


@query("q_grf16_edit_plan", _PLAN_SQL)
def grf16_edit_plan(spark, sf_dir):
    """Suppliers stand for files; those of every fifth nation are tests."""
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), (F.col("s_nationkey") % 5 == 0).alias("is_test"))
    return graph.edit_plan(_edges(spark, sf_dir), files, _central(spark, sf_dir).select("file", "score"), 5, 2, 15)


@query("q_grf13_scope", f"{_CENTRAL_SQL}, d AS (SELECT dir, sum(score) AS score, row_number() OVER (ORDER BY sum(score) DESC, dir) AS r FROM central GROUP BY dir) SELECT x.dir, x.score FROM d x LEFT JOIN d y ON y.r = 2 WHERE x.r = 1 AND (y.score IS NULL OR x.score >= 1.01 * y.score)")
def grf13(spark, sf_dir):
    return graph.suggested_scope(_central(spark, sf_dir), 1.01)


@query("q_grf14_vendored", f"""WITH {EDGES_SQL}, ends AS (SELECT a.s_nationkey AS sd, b.s_nationkey AS dd FROM edges JOIN supplier a ON a.s_suppkey = src JOIN supplier b ON b.s_suppkey = dst WHERE a.s_nationkey <> b.s_nationkey),
c AS (SELECT dir, count(*) AS crossing FROM (SELECT sd AS dir FROM ends UNION ALL SELECT dd FROM ends) GROUP BY dir)
SELECT s_nationkey::VARCHAR AS dir, count(*) AS files, coalesce(any_value(crossing), 0) AS crossing, 'island' AS reason FROM supplier LEFT JOIN c ON dir = s_nationkey GROUP BY s_nationkey HAVING count(*) >= 2 AND coalesce(any_value(crossing), 0) = 0""")
def grf14(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").cast("string").alias("dir"))
    return graph.vendored_trees(files, _edges(spark, sf_dir))


# A tree of files by part: brands as packages, some with a vendored library, a collection of skills or a manifest of their own.
_TREE = """CASE p_partkey % 9 WHEN 0 THEN 'src/b' || p_size || '/m' || p_partkey || '.py' WHEN 1 THEN 'src/b' || p_size || '/vendor/lib/f' || p_partkey || '.py' WHEN 2 THEN 'src/b' || p_size || '/vendor/lib/package.json'
WHEN 3 THEN 'tools/' || p_size || '/skills/s' || p_partkey || '/SKILL.md' WHEN 4 THEN 'tools/' || p_size || '/skills/s' || (p_partkey - 1) || '/run.py' WHEN 5 THEN 'apps/a' || p_size || '/x/third_party/z' || p_partkey || '.py'
WHEN 6 THEN 'apps/a' || p_size || '/Cargo.toml' WHEN 7 THEN 'apps/a' || p_size || '/src/l' || p_partkey || '.rs' ELSE 'apps/a' || p_size || '/src/k' || p_partkey || '.rs' END"""
_VENDORED_SQL = f"""WITH f AS (SELECT p_partkey AS k, {_TREE} AS path FROM part), files AS (SELECT DISTINCT path FROM f),
edges AS (SELECT DISTINCT a.path AS src, b.path AS dst FROM lineitem l JOIN f a ON a.k = l.l_partkey JOIN f b ON b.k = l.l_partkey - 1 WHERE a.path <> b.path),
ups AS (SELECT path, string_split(path, '/') AS ps FROM files), d AS (SELECT path, ps, n, array_to_string(ps[1:n], '/') AS dir FROM ups, range(1, 12) r(n) WHERE n < len(ps)),
per AS (SELECT dir, count(*) AS files, min(CASE WHEN n = len(ps) - 1 AND ps[-1] IN {vendored.MANIFESTS} THEN ps[-1] END) AS manifest,
  coalesce(bool_or(n = len(ps) - 1 AND ps[-1] = '__init__.py'), false) AS package, coalesce(bool_or(n = len(ps) - 1 AND lower(ps[-1]) = 'skill.md'), false) AS skill FROM d GROUP BY dir),
x AS (SELECT e.*, per.dir, starts_with(src, dir || '/') AS s, starts_with(dst, dir || '/') AS t FROM edges e JOIN (SELECT dir FROM per) per ON starts_with(dst, dir || '/')),
im AS (SELECT dir, count(*) FILTER (WHERE NOT s) AS imported, count(*) FILTER (WHERE s) AS internal FROM x GROUP BY dir),
ch AS (SELECT regexp_replace(dir, '/[^/]*$', '') AS dir, count(*) AS children, count(*) FILTER (WHERE skill) AS skills, count(*) FILTER (WHERE package) AS packages FROM per WHERE contains(dir, '/') GROUP BY 1),
s AS (SELECT per.dir, files, manifest, coalesce(imported, 0) = 0 AND coalesce(internal, 0) > 0 AS island, list_sort(list_filter(['vendor', 'third_party', 'skills', 'external_repos', '_vendored', 'node_modules'], lambda v: list_contains(string_split(lower(per.dir), '/'), v))) AS named,
  string_split(lower(per.dir), '/')[-1] IN ('.claude') AS tool, string_split(lower(per.dir), '/')[-1] IN ('third_party', '_vendored') AS vendor,
  string_split(lower(per.dir), '/')[-1] = 'skills' AND coalesce(imported, 0) = 0 AND NOT package AND coalesce(children, 0) > 0 AND coalesce(packages, 0) = 0 AND coalesce(skills, 0) >= 0.6 * coalesce(children, 0) AS skills
  FROM per LEFT JOIN im USING (dir) LEFT JOIN ch USING (dir)),
g AS (SELECT * FROM s WHERE manifest IS NOT NULL OR tool OR vendor OR skills), o AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g u WHERE starts_with(g.dir, u.dir || '/')))
SELECT dir, files, list_filter([CASE WHEN manifest IS NOT NULL THEN 'manifest:' || manifest END, CASE WHEN island THEN 'island' END, CASE WHEN len(named) > 0 THEN 'name:' || named[1] END, CASE WHEN tool THEN 'tool-config' END, CASE WHEN vendor THEN 'vendor-name' END, CASE WHEN skills THEN 'skills' END], lambda v: v IS NOT NULL) AS reasons
FROM o WHERE island OR len(named) > 0 OR tool OR vendor OR skills"""


@query("q_grf14_subtrees", _VENDORED_SQL)
def grf14_subtrees(spark, sf_dir):
    """Vendored subtrees of any depth, the outermost of each chain once."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr(_TREE).alias("path"))
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_partkey") - 1).alias("k2")).distinct()
    edges = pairs.join(part.withColumnRenamed("path", "src"), "k").join(part.select(F.col("k").alias("k2"), F.col("path").alias("dst")), "k2").select("src", "dst").filter("src <> dst").distinct()
    return vendored.vendored_subtrees(part.select("path").distinct(), edges)


@query("q_grf15_entry_points", f"SELECT page_id, {PATH_SQL} AS path FROM pages WHERE list_extract(string_split({PATH_SQL}, '/'), -1) IN ('25', '474.html', '519')")
def grf15(spark, sf_dir):
    return graph.entry_points(table(spark, sf_dir, "pages").select("page_id", _path().alias("path")), names=("25", "474.html", "519"))


@query("q_grf17_confidence", "SELECT doc_id, least(CASE WHEN lang = 'de' OR source = 'src1' THEN 0.55 WHEN n_chars > 5000 THEN 0.72 ELSE 0.9 END, CASE WHEN n_chars > 5000 THEN 0.94 ELSE 1.0 END, CASE WHEN n_chars < 100 THEN 0.55 ELSE 1.0 END)::DOUBLE AS confidence FROM documents")
def grf17(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", graph.confidence(F.col("lang") != "de", F.col("source") != "src1", F.col("n_chars") > 5000, F.when(F.col("n_chars") < 100, 0).otherwise(1)).alias("confidence"))


@query("q_grf18_manifest")
def grf18(spark, sf_dir):
    return graph.manifest_digest(docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("d")), "doc_id", "d")


@query("q_grf18_stale_files", "SELECT doc_id::VARCHAR AS path, 'modified' AS change FROM documents WHERE n_chars <> length(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END")
def grf18_stale(spark, sf_dir):
    recorded = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("mtime"), F.col("n_chars").alias("size"))
    current = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("mtime"), (F.length("text") + F.expr("if(doc_id % 7 = 0, 1, 0)")).cast("long").alias("size"))
    return changes.changeset(recorded, current)


_REFS_SQL = f"WITH {LINES}, c AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '\"[^\"]*\"', '\"\"', 'g'), '(//|#).*$', '') AS clean FROM lines) SELECT doc_id, line_no, regexp_matches(clean, '(\\b|\\.|::)token\\s*\\(') AS is_call FROM c WHERE regexp_matches(clean, '\\btoken\\b')"


@query("q_grf4_references", _REFS_SQL)
def grf4(spark, sf_dir):
    return graph.references(lines(docs(spark, sf_dir)), "token").select("doc_id", "line_no", "is_call")


# Full stops stand for quotes and commas for raw quotes, so that strings end and begin on other lines.
_CODE_SQL = "translate(text, '.,', '\"`')"
_BLANK_SQL = """array_to_string(list_transform(regexp_extract_all({0}, '"[^"\\n]*"?|`[^`]*`?|//[^\\n]*|[^"`/]+|/'), lambda x: CASE WHEN x[1] IN ('"', '`') OR x[1:2] = '//' THEN regexp_replace(x, '[^\\n]', ' ', 'g') ELSE x END), '')"""


@query("q_grf4_code_references", f"WITH {LINES.replace('FROM documents', f'FROM (SELECT doc_id, lang, source, {_BLANK_SQL.format(_CODE_SQL)} AS text FROM documents)')} SELECT doc_id, line_no, regexp_matches(line, '(\\b|\\.|::)the\\s*\\(') AS is_call FROM lines WHERE regexp_matches(line, '\\bthe\\b')")
def grf4_code(spark, sf_dir):
    """Lines with a word outside of strings that go on over lines."""
    code = docs(spark, sf_dir).select("doc_id", F.translate("text", ".,", '"`').alias("text"))
    return graph.code_references(code, "the", "go")


@query("q_grf9_callers", "WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z_]+)\\([^)]*\\);', 1)) AS name FROM pages) SELECT name, count(*) AS n, count(DISTINCT page_id) AS files FROM s GROUP BY name")
def grf9(spark, sf_dir):
    calls = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"([A-Za-z_]+)\([^)]*\);"), F.lit(1))).alias("name"))
    return calls.groupBy("name", "page_id").agg(F.count("*").alias("n")).groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("files"))


@query("q_jn9_symbols_references", f"WITH {LINES}, s AS (SELECT DISTINCT p_brand AS name FROM part), w AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z]+')) AS name FROM lines), d AS (SELECT lower(regexp_extract(line, '^([A-Z][a-z]{{3,}})', 1)) AS name, min(doc_id) AS doc_id FROM lines WHERE regexp_matches(line, '^[A-Z][a-z]{{3,}}') GROUP BY ALL) SELECT d.name, d.doc_id AS defined_in, count(*) AS n FROM d JOIN w ON w.name = d.name GROUP BY ALL")
def jn9(spark, sf_dir):
    own = lines(docs(spark, sf_dir))
    defined = own.select(F.lower(F.regexp_extract("line", "^([A-Z][a-z]{3,})", 1)).alias("name"), "doc_id").filter("name <> ''").groupBy("name").agg(F.min("doc_id").alias("defined_in"))
    used = own.select(F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z]+"), F.lit(0))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return defined.join(used, "name")


@query("q_grf2_js_symbols", f"WITH {LINES.replace('FROM documents', 'FROM (SELECT page_id AS doc_id, url AS lang, url AS source, html AS text FROM pages)')} SELECT doc_id, line_no, 'function' AS kind, regexp_extract(line, '^\\s*(?:export\\s+)?(?:default\\s+)?(?:async\\s+)?function\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM lines WHERE regexp_matches(line, '^\\s*(?:export\\s+)?(?:default\\s+)?(?:async\\s+)?function\\s+([A-Za-z_][A-Za-z0-9_]*)')")
def grf2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return graph.extract(lines(pages), "javascript")


@query("q_jn4_stem_resolution", f"""WITH f AS (SELECT {PATH_SQL} AS file FROM pages), st AS (SELECT regexp_replace(list_extract(string_split(file, '/'), -1), '^(.+)\\.[^.]*$', '\\1') AS stem, min(file) AS dst FROM f GROUP BY ALL),
i AS (SELECT {PATH_SQL} AS src, 'pages/' || (page_id % 300)::VARCHAR AS module FROM pages) SELECT DISTINCT src, coalesce(a.dst, b.dst) AS dst FROM i LEFT JOIN st a ON a.stem = module LEFT JOIN st b ON b.stem = list_extract(string_split_regex(module, '[./]'), -1) WHERE coalesce(a.dst, b.dst) <> src""")
def jn4(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    imports = pages.select(_path().alias("src"), F.concat(F.lit("pages/"), (F.col("page_id") % 300).cast("string")).alias("module"))
    return graph.resolve_by_stem(imports, pages.select(_path().alias("file")))


# Changes and ledgers: events stand for claims.

_SNAPSHOTS = "a AS (SELECT doc_id::VARCHAR AS path, 1 AS mtime, n_chars AS size FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS mtime, n_chars AS size FROM documents WHERE doc_id % 6 <> 0)"
_CHANGES = f"WITH {_SNAPSHOTS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.mtime <> b.mtime OR a.size <> b.size"


def _snapshots(spark, sf_dir):
    """Two states of one table of files."""
    d = docs(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"))
    a = d.filter("doc_id % 5 <> 0").select("path", F.lit(1).alias("mtime"), "size")
    return a, d.filter("doc_id % 6 <> 0").select("path", F.expr("if(doc_id % 7 = 0, 2, 1)").alias("mtime"), "size")


@query("q_jn7_snapshot_diff", _CHANGES)
def jn7(spark, sf_dir):
    return changes.changeset(*_snapshots(spark, sf_dir))


@query("q_str4_changeset", f"SELECT change, count(*) AS n FROM ({_CHANGES}) GROUP BY change")
def str4(spark, sf_dir):
    return changes.changeset(*_snapshots(spark, sf_dir)).groupBy("change").agg(F.count("*").alias("n"))


@query("q_str5_refresh", f"WITH {_SNAPSHOTS} SELECT path, mtime, size FROM b")
def str5(spark, sf_dir):
    a, b = _snapshots(spark, sf_dir)
    found = changes.changeset(a, b)
    return changes.refreshed(a, found, b.join(found.filter("change <> 'removed'"), "path", "left_semi"), "path")


_EVENTS = "e AS (SELECT user_id AS claim_id, (user_id % 7) AS agent_id, CASE WHEN event_type = 'purchase' THEN 'release' ELSE 'submit' END AS kind, ts, ts + INTERVAL 3 DAY AS expires_at, event_id FROM events)"


def _claims(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "release").otherwise("submit")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("claim_id"), (F.col("user_id") % 7).alias("agent_id"), kind.alias("kind"), F.col("ts").alias("at"), F.expr("ts + interval 3 day").alias("expires_at"))


@query("q_str6_live_claims", f"WITH {_EVENTS}, n AS (SELECT max(ts) - INTERVAL 1 DAY AS t FROM e), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY ts DESC, kind DESC) = 1) SELECT claim_id, agent_id, kind, ts AS \"at\", expires_at FROM l, n WHERE kind <> 'release' AND expires_at > t")
def str6(spark, sf_dir):
    events = _claims(spark, sf_dir)
    now = events.agg(F.expr("max(at) - interval 1 day")).first()[0]
    return changes.live_claims(events, F.lit(now))


_ENDS_SQL = f"""WITH {_EVENTS}, d AS (SELECT DISTINCT claim_id, agent_id, kind, ts, expires_at FROM e),
o AS (SELECT *, lead(ts) OVER w AS nxt, lag(kind) OVER w AS pk, lag(expires_at) OVER w AS px, (SELECT max(ts) FROM e) AS wm FROM d WINDOW w AS (PARTITION BY claim_id ORDER BY ts, kind))
SELECT claim_id, agent_id, 'expired' AS change, expires_at AS "at" FROM o WHERE kind = 'submit' AND (nxt > expires_at OR nxt IS NULL AND epoch_ms(expires_at) < epoch_ms(wm))
UNION ALL SELECT claim_id, agent_id, 'released', ts FROM o WHERE kind = 'release' AND pk = 'submit' AND px >= ts"""


@query("q_str6_claim_ends", _ENDS_SQL)
def str6_ends(spark, sf_dir):
    """Claims that were released or that a timer ended, from a drained stream."""
    kind = F.when(F.col("event_type") == "purchase", "release").otherwise("submit")
    events = streams.read_table(spark, sf_dir, "events").select(F.col("user_id").alias("claim_id"), (F.col("user_id") % 7).alias("agent_id"), kind.alias("kind"), F.col("ts").alias("at"), F.expr("ts + interval 3 day").alias("expires_at"))
    return _drained(spark, streams.claim_ends(events)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("q_jn8_claim_overlap", "WITH c AS (SELECT DISTINCT o_orderkey AS claim_id, o_custkey % 5 AS agent_id, l_partkey AS symbol FROM orders JOIN lineitem ON l_orderkey = o_orderkey ) SELECT a.claim_id AS a_id, b.claim_id AS b_id, count(*) AS n_shared, min(a.symbol) AS first_shared FROM c a JOIN c b ON a.symbol = b.symbol AND a.claim_id < b.claim_id AND a.agent_id <> b.agent_id GROUP BY ALL")
def jn8(spark, sf_dir):
    held = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    claims = held.groupBy(F.col("o_orderkey").alias("claim_id"), (F.col("o_custkey") % 5).alias("agent_id")).agg(F.collect_set("l_partkey").alias("symbols"))
    return changes.claim_overlaps(claims)


@query("q_str7_fresh_findings", "SELECT l_orderkey * 10 + l_linenumber AS finding_id, l_partkey AS symbol, coalesce(l_suppkey % 3 = p_size % 3, false) AS fresh FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def str7(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_id"), F.col("l_partkey").alias("symbol"), (F.col("l_suppkey") % 3).cast("int").alias("revision"))
    return changes.fresh_findings(found, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), (F.col("p_size") % 3).cast("int").alias("revision")))


@query("q_str9_chain", "WITH e AS (SELECT user_id AS chain, event_id AS seq, sha256(event_id::VARCHAR) AS digest, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE lag(sha256(event_id::VARCHAR)) OVER (PARTITION BY user_id ORDER BY event_id) END AS prev FROM events) SELECT chain, seq FROM e WHERE prev IS DISTINCT FROM lag(digest) OVER (PARTITION BY chain ORDER BY seq)".replace("SELECT chain, seq FROM e WHERE prev IS DISTINCT FROM lag(digest) OVER (PARTITION BY chain ORDER BY seq)", "SELECT chain, seq FROM e QUALIFY prev IS DISTINCT FROM lag(digest) OVER (PARTITION BY chain ORDER BY seq)"))
def str9(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("digest"))
    before = F.lag("digest").over(Window.partitionBy("chain").orderBy("seq"))
    return changes.chain_breaks(e.withColumn("prev", F.when(F.col("seq") % 11 == 0, "x").otherwise(before)))


_KEY = bytes(range(32))


@query("q_str9_signatures", "SELECT s_suppkey, s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS valid FROM supplier")
def str9_signatures(spark, sf_dir):
    """Signed receipts, some changed since and some without their signature."""
    made = receipts.signed(table(spark, sf_dir, "supplier"), ["s_suppkey", "s_name", "s_acctbal"], _KEY)
    changed = made.withColumn("s_name", F.when(F.col("s_suppkey") % 5 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    changed = changed.withColumn("signature", F.when(F.col("s_suppkey") % 7 != 0, F.col("signature")))
    return receipts.checked(changed, ["s_suppkey", "s_name", "s_acctbal"], receipts.public_key(_KEY)).select("s_suppkey", "valid")


@query("q_str10_manifest_diff", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 9 = 1 THEN 'removed' ELSE 'modified' END AS change FROM documents WHERE doc_id % 9 = 1 OR doc_id % 10 = 2")
def str10_diff(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    after = d.filter("doc_id % 9 <> 1").withColumn("content", F.when(F.col("doc_id") % 10 == 2, F.concat("content", F.lit(b"x"))).otherwise(F.col("content")))
    return receipts.manifest_diff(receipts.manifest(d), receipts.manifest(after))


@query("q_str10_bundle", f"WITH {LINES}, f AS (SELECT DISTINCT doc_id FROM lines WHERE contains(line, 'License')) SELECT d.doc_id::VARCHAR AS path, sha256(d.text) AS digest, strlen(d.text)::BIGINT AS size, CASE WHEN f.doc_id IS NULL THEN []::VARCHAR[] ELSE ['license'] END AS rules, coalesce(s_suppkey % 2 = 0, false) AS receipt_valid FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN supplier ON s_suppkey = d.doc_id")
def str10_bundle(spark, sf_dir):
    d = docs(spark, sf_dir)
    files = receipts.manifest(d.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content")))
    found = search(d, SearchSpec(["License"], fixed=True)).select(F.col("doc_id").cast("string").alias("path"), F.lit("license").alias("rule_id"))
    good = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), (F.col("s_suppkey") % 2 == 0).alias("valid"))
    return receipts.bundle(files, found, good)


@query("q_str10_verified_bodies", "SELECT doc_id, sha256(text) AS digest FROM documents")
def str10(spark, sf_dir):
    return changes.verified(docs(spark, sf_dir).select("doc_id", "text", F.sha2("text", 256).alias("digest")), "text", "digest").select("doc_id", "digest")


@query("q_set5_json_diff", """WITH p AS (SELECT event_id AS id, json_extract_string(props, '$.' || k) AS value, k AS path FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events))
SELECT id, path, 'removed' AS change, value AS before, NULL::VARCHAR AS after FROM p WHERE id % 3 = 0 UNION ALL SELECT event_id, 'extra.n', 'added', NULL, '1' FROM events WHERE event_id % 3 = 0""")
def set5(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("json"))
    return changes.json_diff(e, e.withColumn("json", F.when(F.col("id") % 3 == 0, '{"extra": {"n": 1}}').otherwise(F.col("json"))))


@query("q_str8_checkpoints", "SELECT doc_id, n_chars FROM documents")
def str8(spark, sf_dir):
    from lexloom.operators import versions

    root = new_path(spark, "versions")
    d = docs(spark, sf_dir).select("doc_id", "n_chars")
    first = versions.create(d, root, "first")
    versions.create(d.filter("n_chars > 100"), root, "second")
    versions.undo(spark, root, first)
    return versions.current(spark, root)


# Classification

_LABEL = "CASE WHEN regexp_matches(lower(text), '\\b(error|fail(ed|ure)?|fatal|exception)\\b') THEN 'error' WHEN regexp_matches(lower(text), '\\b(warn(ing)?|degraded|slow)\\b') THEN 'warn' WHEN regexp_matches(lower(text), '\\btrace\\b') THEN 'trace' WHEN regexp_matches(lower(text), '\\bdebug\\b') THEN 'debug' ELSE 'info' END"


def _logs(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("line"))


@query("q_cls1_classify", f"SELECT label, count(*) AS n FROM (SELECT {_LABEL} AS label FROM conversations) GROUP BY label")
def cls1(spark, sf_dir):
    return classify.classify(_logs(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@query("q_cls2_rendered", f"SELECT conv_id, turn, '[' || label || ' ' || CASE label WHEN 'error' THEN '0.950' WHEN 'warn' THEN '0.850' ELSE '0.800' END || '] ' || text AS shown FROM (SELECT *, {_LABEL} AS label FROM conversations)")
def cls2(spark, sf_dir):
    return classify.rendered(classify.classify(_logs(spark, sf_dir)), 0.5).select("conv_id", "turn", "shown")


@query("q_cls3_budget", f"SELECT conv_id, turn, label, (SELECT count(*) FROM conversations) > 100 AS truncated FROM (SELECT *, {_LABEL} AS label FROM conversations ORDER BY conv_id, turn LIMIT 100)")
def cls3(spark, sf_dir):
    return classify.classify(classify.budgeted(_logs(spark, sf_dir), 100, ["conv_id", "turn"])).select("conv_id", "turn", "label", "truncated")


# Structure: documents that are code are few, so code is made of the parts table, in six variants: a match, none but in a string and a
# comment, a match in a match, a syntax error, several matches beside names that only look alike, and names without calls.

_VARIANTS = (
    'import os\ndef f{n}(a):\n    x = eval(a)\n    return os.path.join("{brand}", x, a)\n',
    "import sys\nclass C{n}:\n    def g(self):\n        return 'eval(a)'  # eval(b)\n",
    "def f{n}(a, b):\n    return eval(eval(a) + b)\n",
    "def f{n}(:\n    eval(a)\n",
    "é = eval( a )\nfor i in range(3):\n    print(eval(i), other.eval(i))\n",
    "from pkg.mod{n} import thing as t\nasync def h{n}():\n    await t(eval)\n",
)


def _code(spark, sf_dir, variants=_VARIANTS):
    part = table(spark, sf_dir, "part")
    text = F.lit(None).cast("string")
    for i, v in enumerate(variants):
        pieces = [F.col("p_partkey").cast("string") if x == "{n}" else F.col("p_brand") if x == "{brand}" else F.lit(x) for x in _pieces(v)]
        text = F.when(F.col("p_partkey") % len(variants) == i, F.concat(*pieces)).otherwise(text)
    return part.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def _pieces(variant):
    import re

    return [x for x in re.split(r"(\{n\}|\{brand\})", variant) if x]


def _filled(text):
    """A variant as an SQL expression."""
    names = {"{n}": "p_partkey::VARCHAR", "{brand}": "p_brand"}
    return " || ".join(names.get(x) or "'" + x.replace("'", "''") + "'" for x in _pieces(text)) or "''"


def _by_variant(columns, rows, k=len(_VARIANTS)):
    """SQL with a row for each part of a variant: rows are (variant, values)."""
    one = lambda v: _filled(v) if isinstance(v, str) else str(v)
    return " UNION ALL ".join(f"SELECT p_partkey AS doc_id, {', '.join(f'{one(v)} AS {c}' for c, v in zip(columns, values, strict=True))} FROM part WHERE p_partkey % {k} = {i}" if columns else f"SELECT p_partkey AS doc_id FROM part WHERE p_partkey % {k} = {i}" for i, *values in rows)


_EVALS = [(0, 3, "eval(a)"), (2, 2, "eval(eval(a) + b)"), (2, 2, "eval(a)"), (4, 1, "eval( a )"), (4, 3, "eval(i)")]


@query("q_ast1_search", _by_variant(["line", "text"], _EVALS))
def ast1(spark, sf_dir):
    return structural.ast_search(_code(spark, sf_dir), "eval($X)").select("doc_id", "line", "text")


@query("q_rul1_structural_pack", _by_variant(["rule_id", "severity", "line_no"], [(i, "python-auth-eval", "high", n) for i, n, _ in _EVALS]))
def rul1_structural(spark, sf_dir):
    found = structural.scan_structural(_code(spark, sf_dir), structural.structural_rules("auth", "python"), "python")
    return found.filter("rule_id = 'python-auth-eval'").select("doc_id", "rule_id", "severity", "line_no")


@query("q_ast2_prefilter", "SELECT p_partkey AS doc_id FROM part")
def ast2(spark, sf_dir):
    return _code(spark, sf_dir).filter(F.col("text").contains(structural.literal_of("eval($X)"))).select("doc_id")


@query("q_ast3_metavariables", _by_variant(["first", "n_rest"], [(0, '"{brand}"', 2)]))
def ast3(spark, sf_dir):
    found = structural.ast_search(_code(spark, sf_dir), "os.path.join($A, $$$REST)")
    return found.select("doc_id", F.col("single")["A"].alias("first"), F.size(F.col("multi")["REST"]).alias("n_rest"))


@query("q_ast3_same_metavariable", _by_variant(["line"], [(1, 2), (3, 1)], 4))
def ast3_same(spark, sf_dir):
    """Equal metavariables must match equal code."""
    variants = ("x = f(a{n}, b{n})\n", "y = 1\nx = f(a{n}, a{n})\n", "x = g(a, a)\n", "x = f(b[{n}], b[ {n} ])\n")
    return structural.ast_search(_code(spark, sf_dir, variants), "f($X, $X)").select("doc_id", "line")


@query("q_ast5_rewrite_plan", _by_variant(["replacement"], [(0, "literal_eval(a)"), (2, "literal_eval(eval(a) + b)"), (2, "literal_eval(a)"), (4, "literal_eval(a)"), (4, "literal_eval(i)")]))
def ast5(spark, sf_dir):
    return structural.plan_rewrites(structural.ast_search(_code(spark, sf_dir), "eval($X)"), "literal_eval($X)").select("doc_id", "replacement")


def _edits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey").cast("long")
    return li.select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.lit("x").alias("replacement"))


@query("q_ast6_overlaps", "WITH e AS (SELECT l_orderkey AS doc_id, l_partkey AS s, l_partkey + l_quantity::BIGINT AS e FROM lineitem) SELECT DISTINCT doc_id FROM e QUALIFY max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s")
def ast6(spark, sf_dir):
    return structural.overlapping_files(_edits(spark, sf_dir))


@query("q_ast6_accepted")
def ast6_accepted(spark, sf_dir):
    return structural.accepted_edits(_edits(spark, sf_dir))


_REWRITTEN = [(0, _VARIANTS[0].replace("eval(a)", "literal_eval(a)")), (2, _VARIANTS[2].replace("eval(eval(a) + b)", "literal_eval(eval(a) + b)")), (4, _VARIANTS[4].replace(" eval( a )", " literal_eval(a)").replace("(eval(i)", "(literal_eval(i)"))]


@query("q_ast7_apply", _by_variant(["text"], _REWRITTEN))
def ast7(spark, sf_dir):
    """Of two edits that overlap the earlier stays: the outer call."""
    code = _code(spark, sf_dir)
    edits = structural.plan_rewrites(structural.ast_search(code, "eval($X)"), "literal_eval($X)")
    return structural.apply_edits(code, structural.accepted_edits(edits)).select("doc_id", "text")


@query("q_ast8_verify", _by_variant(["ok"], [(0, 1), (2, 0), (4, 1)]).replace("1 AS ok", "true AS ok").replace("0 AS ok", "false AS ok"))
def ast8(spark, sf_dir):
    """One variant's files were changed since they were rewritten."""
    code = _code(spark, sf_dir)
    edits = structural.accepted_edits(structural.plan_rewrites(structural.ast_search(code, "eval($X)"), "literal_eval($X)"))
    after = structural.apply_edits(code, edits).withColumn("text", F.when(F.col("doc_id") % 6 == 2, F.concat("text", F.lit("# late"))).otherwise(F.col("text")))
    return structural.verify_edits(code, after, edits)


@query("q_ast9_node_types", "SELECT doc_id, node_type, count(*) AS n FROM (" + _by_variant(["node_type"], [(0, "Call")] * 2 + [(2, "Call")] * 2 + [(4, "Call")] * 5 + [(5, "Call"), (0, "FunctionDef"), (1, "FunctionDef"), (2, "FunctionDef"), (1, "ClassDef"), (5, "AsyncFunctionDef"), (0, "Import"), (1, "Import"), (5, "ImportFrom"), (4, "For")]) + ") GROUP BY ALL")
def ast9(spark, sf_dir):
    found = structural.node_types(_code(spark, sf_dir)).filter(F.col("node_type").isin("Call", "FunctionDef", "AsyncFunctionDef", "ClassDef", "Import", "ImportFrom", "For"))
    return found.groupBy("doc_id", "node_type").agg(F.count("*").alias("n"))


@query("q_ast9_tree_query", _by_variant(["line", "capture"], [(0, 2, "f{n}"), (1, 3, "g"), (2, 1, "f{n}")]))
def ast9_tree(spark, sf_dir):
    return structural.tree_query(_code(spark, sf_dir), "(FunctionDef name: $name)").select("doc_id", "line", F.col("captures")["name"].alias("capture"))


@query("q_ast9_nested_tree_query", _by_variant(["line"], [(0, 3), (2, 2), (2, 2), (4, 1), (4, 3)]))
def ast9_nested(spark, sf_dir):
    """Calls of a plain name `eval`, in any file that parses."""
    return structural.tree_query(_code(spark, sf_dir), "(Call func: (Name id: eval))").select("doc_id", "line")


@query("q_ast10_selector", _by_variant(["line"], [(i, n) for i, n, _ in _EVALS]))
def ast10(spark, sf_dir):
    return structural.ast_search(_code(spark, sf_dir), "eval($X)", "Call").select("doc_id", "line")


@query("q_ast10_strictness", _by_variant(["line"], [(0, 1), (1, 1)], 3))
def ast10_strict(spark, sf_dir):
    """Tokens, not characters: spaces and comments between them don't count, other tokens do."""
    code = _code(spark, sf_dir, ("use(a{n}, b)\n", "use( a{n},  # x\n  b )\n", "use(a{n}, b, c)\n"))
    return structural.ast_search(code, "use($A, b)").select("doc_id", "line")


@query("q_ast_tokens", _by_variant([], [(0,)]))
def ast_tokens(spark, sf_dir):
    return structural.token_search(_code(spark, sf_dir), "join($$$ARGS)").select("doc_id")


@query("q_win6_structural_chunks", _by_variant(["chunk_no", "start_line", "end_line"], [(i, 0, 1, v.count("\n")) for i, v in enumerate(_VARIANTS)]))
def win6(spark, sf_dir):
    return structural.structural_chunks(_code(spark, sf_dir))


_LONG = "x = '{n}" + "a" * 700 + "'\n"


@query("q_win6_split_chunks", _by_variant(["chunk_no", "start_line", "end_line"], [(0, 0, 1, 1), (0, 1, 2, 2), (1, 0, 1, 2), (1, 1, 3, 3)], 2))
def win6_split(spark, sf_dir):
    """Neighbours are merged up to the budget, and no further."""
    return structural.structural_chunks(_code(spark, sf_dir, (_LONG * 2, "y = 1\n" + _LONG * 2)))


@query("q_grf1_python_symbols", _by_variant(["kind", "name", "line"], [(0, "import", "os", 1), (0, "function", "f{n}", 2), (1, "import", "sys", 1), (1, "class", "C{n}", 2), (1, "function", "g", 3), (2, "function", "f{n}", 1), (5, "import", "pkg.mod{n}", 1), (5, "function", "h{n}", 2)]))
def grf1(spark, sf_dir):
    return structural.python_symbols(_code(spark, sf_dir))


@query("q_fn16_reference_kinds", _by_variant(["line", "kind"], [(0, 3, "call"), (2, 2, "call"), (2, 2, "call"), (4, 1, "call"), (4, 3, "call"), (4, 3, "call"), (5, 3, "value")]))
def fn16(spark, sf_dir):
    return structural.python_references(_code(spark, sf_dir), "eval")


_SOURCES = {
    "rust": ("use std::io;\npub fn f{n}(a: u8) {}\n", "struct S{n} { a: u8 }\nimpl S{n} {\n    pub(crate) async fn g(&self) {}\n}\n", "// fn no{n}() {}\nlet x = 1;\n"),
    "go": ('package a\nimport "fmt"\nfunc F{n}() {}\n', "type T{n} struct {}\nfunc (t *T{n}) M() {}\n", "// func no{n}() {}\nvar x = 1\n"),
    "javascript": ('import {a, b} from "./m{n}";\nexport async function f{n}() {}\n', "class C{n} {}\nconst g = async (x) => x;\nconst h = 3;\n", "const m = require('m{n}');\n// function no() {}\n"),
    "typescript": ("import 'side{n}';\nexport interface I{n} {}\n", "export const f{n} = (a: number): number => a;\nlet k: string = 'x';\n", "export * from './all{n}';\ntype T = string;\n"),
    "java": ("import java.util.List;\npublic final class C{n} {}\n", "interface I{n} {}\n", "// class no{n} {}\n"),
    "php": ("use A\\B{n};\nfunction f{n}() {}\n", "final class C{n} {}\n", "$x = 1; // {n}\n"),
    "csharp": ("using System;\npublic class C{n} {}\n", "internal enum E{n} {}\n", "var x = {n};\n"),
    "c": ('#include "a{n}.h"\nint f{n}(int a) {\n', "struct S{n} {\n", "x = {n};\n"),
}
_SOURCE_SYMBOLS = {
    "rust": [(0, 1, "import", "std::io"), (0, 2, "function", "f{n}"), (1, 1, "class", "S{n}"), (1, 3, "function", "g")],
    "go": [(0, 2, "import", "fmt"), (0, 3, "function", "F{n}"), (1, 1, "class", "T{n}"), (1, 2, "function", "M")],
    "javascript": [(0, 1, "import", "./m{n}"), (0, 2, "function", "f{n}"), (1, 1, "class", "C{n}"), (1, 2, "function", "g"), (2, 1, "import", "m{n}")],
    "typescript": [(0, 1, "import", "side{n}"), (0, 2, "class", "I{n}"), (1, 1, "function", "f{n}"), (2, 1, "import", "./all{n}"), (2, 2, "class", "T")],
    "java": [(0, 1, "import", "java.util.List"), (0, 2, "class", "C{n}"), (1, 1, "class", "I{n}")],
    "php": [(0, 1, "import", "A\\B{n}"), (0, 2, "function", "f{n}"), (1, 1, "class", "C{n}")],
    "csharp": [(0, 1, "import", "System"), (0, 2, "class", "C{n}"), (1, 1, "class", "E{n}")],
    "c": [(0, 1, "import", "a{n}.h"), (0, 2, "function", "f{n}"), (1, 1, "class", "S{n}")],
}


@query("q_grf3_line_symbols", " UNION ALL ".join(_by_variant(["language", "line_no", "kind", "name"], [(i, k, *rest) for i, *rest in rows], 3) for k, rows in _SOURCE_SYMBOLS.items()))
def grf3(spark, sf_dir):
    out = None
    for language, variants in _SOURCES.items():
        found = graph.extract(lines(_code(spark, sf_dir, variants)), language).withColumn("language", F.lit(language))
        out = found if out is None else out.unionByName(found)
    return out


@query("q_grf5_languages", "SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'cpp' END AS language FROM part")
def grf5(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".py", ".tsx", ".hpp", ".zig")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), graph.language_of_file(F.concat(F.lit("a/b"), suffix)).alias("language"))


@query("q_grf6_definitions", "SELECT p_partkey AS doc_id, 'function' AS kind, 3 AS line FROM part WHERE p_partkey % 6 = 1")
def grf6(spark, sf_dir):
    return resolve.definitions(structural.python_symbols(_code(spark, sf_dir)), "g").select("doc_id", "kind", "line")


@query("q_grf6_context", f"WITH {LINES} SELECT a.doc_id, a.line_no, string_agg(b.line, chr(10) ORDER BY b.line_no) AS context FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 1 AND a.line_no + 1 WHERE regexp_matches(a.line, '\\bLicense\\b') GROUP BY ALL")
def grf6_context(spark, sf_dir):
    return resolve.references_with_context(lines(docs(spark, sf_dir)), "License", 1)


#: Files are made of parts, and imports of order lines: a part's file imports another's, in the language of the importer.
_FILE = "CASE p_partkey % 5 WHEN 0 THEN 'py/pkg' || p_size || '/mod' || p_partkey || '.py' WHEN 1 THEN 'web/' || p_size || '/m' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.ts' ELSE '/index.js' END WHEN 2 THEN 'crate/src/a' || p_size || '/m' || p_partkey || '.rs' WHEN 3 THEN 'go/p' || p_partkey || '/main.go' ELSE 'inc/h' || p_partkey || '.h' END"
_LANGUAGE = "CASE {0} % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'rust' WHEN 3 THEN 'go' ELSE 'c' END"
_MODULE = "CASE {0} % 5 WHEN 0 THEN 'pkg' || {1} || '.mod' || {2} WHEN 1 THEN '@/' || {1} || '/m' || {2} WHEN 2 THEN 'crate::a' || {1} || '::m' || {2} || '::Item' WHEN 3 THEN 'example.org/x/p' || {2} ELSE 'h' || {2} || '.h' END"
_PAIRS = "SELECT DISTINCT a.p_partkey AS a, a.p_size AS a_size, b.p_partkey AS b, b.p_size AS b_size FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey WHERE a.p_partkey % 5 = b.p_partkey % 5"


@query("q_grf7_resolution", f"""WITH f AS (SELECT p_partkey AS k, {_FILE} AS file FROM part), p AS ({_PAIRS})
SELECT DISTINCT x.file AS src, {_MODULE.format('b', "CASE WHEN b % 7 = 0 THEN 999 ELSE b_size END", 'b')} AS module, y.file AS dst FROM p JOIN f x ON x.k = a JOIN f y ON y.k = b WHERE a <> b AND (b % 7 <> 0 OR b % 5 IN (3, 4))""")
def grf7(spark, sf_dir):
    """Every seventh import names a directory that isn't there (packages of Go and headers of C are found without it)."""
    part = table(spark, sf_dir, "part")
    files = part.select(F.col("p_partkey").alias("k"), F.expr(_FILE.replace("p_size", "p_size")).alias("file"))
    own = part.select("p_partkey", "p_size")
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().join(own.select(F.col("p_partkey").alias("a")), F.col("l_partkey") == F.col("a"))
    pairs = pairs.join(own.select(F.col("p_partkey").alias("b"), F.col("p_size").alias("b_size")), F.col("l_suppkey") == F.col("b")).filter("a % 5 = b % 5").select("a", "b", "b_size")
    asked = pairs.join(files, F.col("k") == F.col("a")).select(F.col("file").alias("src"), F.expr(_LANGUAGE.format("a")).alias("language"), F.expr(_MODULE.format("b", "if(b % 7 = 0, 999, b_size)", "b")).alias("module"), F.lit(None).cast("string").alias("name"))
    found = resolve.resolve(asked, files.select("file"), aliases={"@/": "web/"}, go_modules={"example.org/x": "go"}, includes=("inc",))
    return found.select("src", "module", "dst").distinct()


@query("q_grf16_capsule", f"{_CENTRAL_SQL} SELECT central.file, dir, score, coalesce(a.a, 0) AS importers FROM central LEFT JOIN a ON a.file = central.file ORDER BY score DESC, central.file LIMIT 10")
def grf16(spark, sf_dir):
    """The tabular part of an orientation: central files with their directory, importers and confidence."""
    edges = _edges(spark, sf_dir)
    top = _central(spark, sf_dir, edges).orderBy(F.desc("score"), "file").limit(10)
    fan = edges.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("importers"))
    return top.join(fan, "file", "left").select("file", "dir", "score", F.coalesce("importers", F.lit(0)).alias("importers"))


@query("q_grf16_context_pack", f"{_CENTRAL_SQL}, r AS (SELECT file, score, sum(dir + 1) OVER (ORDER BY score DESC, file ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM central) SELECT file, score, used FROM r WHERE used <= 200")
def grf16_pack(spark, sf_dir):
    """The most central files that fit a budget; a file's size here is its directory's number and one."""
    found = within_budget(_central(spark, sf_dir), F.col("dir") + 1, 200, [F.desc("score"), F.col("file")])
    return found.select("file", "score", F.col("used").cast("long").alias("used"))


@query("q_grf16_codemap", f"WITH {EDGES_SQL}, i AS (SELECT src AS file, count(*) AS imports, min(dst) AS first_import FROM edges GROUP BY ALL), b AS (SELECT dst AS file, count(*) AS importers FROM edges GROUP BY ALL), s AS (SELECT o_custkey AS file, count(*) AS symbols FROM orders GROUP BY ALL) SELECT s_suppkey AS file, coalesce(imports, 0) AS imports, first_import, coalesce(importers, 0) AS importers, coalesce(symbols, 0) AS symbols FROM supplier LEFT JOIN i ON i.file = s_suppkey LEFT JOIN b ON b.file = s_suppkey LEFT JOIN s ON s.file = s_suppkey")
def grf16_codemap(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"))
    symbols = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.count("*").alias("symbols"))
    return graph.codemap(files, _edges(spark, sf_dir), symbols)


@query("q_str3_answers", "SELECT * FROM (VALUES (1, 'miss'), (2, 'hit'), (3, 'miss'), (4, 'miss')) v(asked, found)")
def str3(spark, sf_dir):
    """The same request twice, another one, and the first again after the corpus has changed."""
    files = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("mtime"), F.col("n_chars").alias("size"))
    before, after = streams.fingerprint(files), streams.fingerprint(files.withColumn("mtime", F.when(F.col("path") == "7", 2).otherwise(1)))
    answers, out = streams.Answers(), []
    for i, (request, state) in enumerate([("count License", before), ("count License", before), ("count the", before), ("count License", after)], 1):
        misses = answers.misses
        answers.get(request, state, lambda: [request])  # noqa: B023
        out.append((i, "miss" if answers.misses > misses else "hit"))
    return spark.createDataFrame(out, "asked int, found string")


# Streams, drained: the same rows as in batch.


def _drained(spark, stream, mode="append"):
    at = new_path(spark, "stream")
    streams.drain(stream, f"{at}/out", f"{at}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("q_str1_match_stream", f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE contains(line, 'License')")
def str1(spark, sf_dir):
    return _drained(spark, streams.match_stream(streams.read_table(spark, sf_dir, "documents"), SearchSpec(["License"], fixed=True)))


_COUNTS = "SELECT time_bucket(INTERVAL {0}, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query("q_str11_tumbling", _COUNTS.format("1 HOUR"))
def str11(spark, sf_dir):
    return streams.counts(table(spark, sf_dir, "events"), "1 hour")


@query("q_str11_sliding", "SELECT b - INTERVAL 30 MINUTE * k AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) AS b, unnest([0, 1]) AS k FROM events) GROUP BY ALL")
def str11_sliding(spark, sf_dir):
    return streams.counts(table(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query("q_str11_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def str11_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "2 hours")


# What a drained stream has told: windows and sessions that the watermark, an hour behind the last event, has passed.
_MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"


@query("q_str11_tumbling_stream", f"SELECT * FROM ({_COUNTS.format('1 HOUR')}) WHERE window_start + INTERVAL 1 HOUR <= {_MARK}")
def str11_stream(spark, sf_dir):
    return _drained(spark, streams.counts(streams.read_table(spark, sf_dir, "events"), "1 hour"))


@query("q_str11_sessions_stream", f"SELECT * FROM ({{0}}) WHERE session_end <= {_MARK}".replace("{0}", ORACLE_SQL["q_str11_sessions"]))
def str11_sessions_stream(spark, sf_dir):
    return _drained(spark, streams.sessions(streams.read_table(spark, sf_dir, "events"), "2 hours"))


@query("q_agg12_demand", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS worst FROM events GROUP BY event_type")
def agg12(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("worst"))


_AT_ONCE_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), s AS (SELECT min(ts) AS a, max(ts) + INTERVAL 2 HOUR AS b FROM k GROUP BY user_id, k),
d AS (SELECT DISTINCT unnest(generate_series(date_trunc('day', a), date_trunc('day', b - INTERVAL 1 MICROSECOND), INTERVAL 1 DAY)) AS t FROM s),
p AS (SELECT a AS t, 1 AS n FROM s UNION ALL SELECT b, -1 FROM s UNION ALL SELECT t, 0 FROM d), r AS (SELECT t, sum(n) OVER (ORDER BY t, n ROWS UNBOUNDED PRECEDING) AS o FROM p)
SELECT date_trunc('day', t)::TIMESTAMP AS day, max(o)::BIGINT AS most FROM r WHERE date_trunc('day', t) IN (SELECT t FROM d) GROUP BY ALL"""


@query("q_agg12_at_once", _AT_ONCE_SQL)
def agg12_at_once(spark, sf_dir):
    """The greatest number of different clients at once, a day."""
    return sweep.most_at_once(sweep.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "2 hours"))


# Sinks


@query("q_snk5_grep_text", f"WITH {LINES} SELECT doc_id || ':' || line_no || ':' || line AS shown FROM lines WHERE contains(line, 'License')")
def snk5(spark, sf_dir):
    found = search(docs(spark, sf_dir), SearchSpec(["License"], fixed=True))
    return found.select(sinks.grep_text(F.col("doc_id"), F.col("line_no"), F.col("line")).alias("shown"))


@query("q_snk1_envelope")
def snk1(spark, sf_dir):
    found = search(docs(spark, sf_dir), SearchSpec(["License"], fixed=True))
    return spark.createDataFrame([(sinks.envelope(found, "License"),)], "json string")


def _matches(spark, sf_dir):
    return search(docs(spark, sf_dir), SearchSpec(["License"], fixed=True)).select("doc_id", "line_no", "line")


@query("q_snk2_ndjson", f"WITH {LINES} SELECT 'match' AS type, count(*) AS n FROM lines WHERE contains(line, 'License') HAVING count(*) > 0 UNION ALL SELECT 'summary', 1")
def snk2(spark, sf_dir):
    path = new_path(spark, "ndjson")
    sinks.ndjson(_matches(spark, sf_dir), path, "License")
    return spark.read.schema("type string").json(path).groupBy("type").agg(F.count("*").alias("n"))


_FOUND_SQL = f"WITH {LINES} SELECT doc_id AS {{}}, line_no AS {{}}, line AS {{}} FROM lines WHERE contains(line, 'License')"


@query("q_snk3_csv", _FOUND_SQL.format("file", "line_number", "text"))
def snk3(spark, sf_dir):
    path = new_path(spark, "csv")
    sinks.csv(_matches(spark, sf_dir), path)
    return spark.read.option("header", True).option("escape", '"').schema("file long, line_number int, text string").csv(path)


@query("q_snk4_tsv", _FOUND_SQL.format("doc_id", "line_no", "line"))
def snk4(spark, sf_dir):
    path = new_path(spark, "tsv")
    sinks.tsv(_matches(spark, sf_dir), path)
    return spark.read.option("header", True).option("sep", "\t").schema("doc_id long, line_no int, line string").csv(path)


@query("q_snk6_mermaid", f"WITH {EDGES_SQL}, t AS (SELECT src, dst FROM edges ORDER BY src, dst LIMIT 500) SELECT 'graph TD' || chr(10) || string_agg('  n' || src || ' --> n' || dst, chr(10) ORDER BY src, dst) || CASE WHEN (SELECT count(*) FROM edges) > 500 THEN chr(10) || '  %% incomplete: shows the first 500 edges' ELSE '' END AS graph FROM t")
def snk6(spark, sf_dir):
    return spark.createDataFrame([(sinks.mermaid(_edges(spark, sf_dir)),)], "graph string")


@query("q_str2_requests", f"WITH {LINES} SELECT 1 AS id, count(*) AS n, NULL AS error FROM lines WHERE contains(line, 'License') UNION ALL SELECT 2, count(*), NULL FROM lines WHERE contains(line, 'the') UNION ALL SELECT 3, 0, 'unknown command: fly'")
def str2(spark, sf_dir):
    """Three requests in a directory of JSON, answered by the loop."""
    at = new_path(spark, "requests")
    asked = [(1, "count", '{"pattern": "License"}'), (2, "count", '{"pattern": "the"}'), (3, "fly", None)]
    spark.createDataFrame(asked, "id int, command string, args string").coalesce(1).write.json(f"{at}/in")
    count = lambda s, args: search(docs(s, sf_dir), SearchSpec([args["pattern"]], fixed=True)).agg(F.count("*").alias("n"))
    streams.serve(spark.readStream.schema("id int, command string, args string").json(f"{at}/in"), {"count": count}, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema("id int, n long, error string").json(f"{at}/out").withColumn("n", F.coalesce("n", F.lit(0)))


@query("q_cls4_query_kind", "SELECT * FROM (VALUES ('classify the failures', 'NLP'), ('ERROR.*timeout', 'FAST'), ('Detect anomalies', 'NLP'), ('', 'FAST')) v(query, kind)")
def cls4(spark, sf_dir):
    asked = ["classify the failures", "ERROR.*timeout", "Detect anomalies", ""]
    return spark.createDataFrame([(q, classify.query_kind(q)) for q in asked], "query string, kind string")
