"""Symbol and import graphs: edges, traversal, rank, centrality."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.search import lines as split_into_lines
from lexloom.operators.shared import checkpointed

FAN_IN_CAP, SYMBOL_CAP = 12, 25
# Names of entry points.
ENTRY_NAMES = (
    "main.py", "__main__.py", "cli.py", "app.py", "server.py", "main.ts", "index.ts", "index.js", "main.js", "app.ts", "main.tsx", "app.tsx", "cli.tsx", "index.tsx", "main.rs", "lib.rs",
)


def resolve_by_stem(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): imports (src, module) of files (file) whose stem is the module or its last part; the first file wins."""
    stems = files.select(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?<=.)\.[^.]*$", "").alias("stem"), "file").groupBy("stem").agg(F.min("file").alias("dst"))
    last = F.element_at(F.split("module", r"[./]"), -1)
    both = imports.join(stems.select(F.col("stem").alias("module"), F.col("dst").alias("_whole")), "module", "left")
    both = both.withColumn("_last", last).join(stems.select(F.col("stem").alias("_last"), F.col("dst").alias("_part")), "_last", "left")
    return both.select("src", F.coalesce("_whole", "_part").alias("dst")).filter("dst is not null and dst <> src").distinct()


def importers(edges: DataFrame, file: str | int) -> DataFrame:
    return edges.filter(F.col("dst") == file).select(F.col("src").alias("file")).distinct()


def imported(edges: DataFrame, file: str | int) -> DataFrame:
    return edges.filter(F.col("src") == file).select(F.col("dst").alias("file")).distinct()


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(file, depth): files that reach a seed through imports, by the least number of steps. Each step joins the frontier alone; the frontier is cut from its lineage."""
    found = seeds.select("file", F.lit(0).alias("depth")).distinct()
    frontier = found
    back = edges.select(F.col("dst").alias("file"), F.col("src").alias("next"))
    for depth in range(1, max_depth + 1):
        step = frontier.join(back, "file").select(F.col("next").alias("file")).distinct().join(found.select("file"), "file", "left_anti")
        frontier = checkpointed(step.select("file", F.lit(depth).alias("depth"))) if depth > 1 else step.select("file", F.lit(depth).alias("depth"))
        found = found.unionByName(frontier)
    return found


def caller_paths(calls: DataFrame, seed: str | int, max_depth: int = 3, most: int = 200) -> DataFrame:
    """(depth, path, found): how a symbol is reached, each path from it to a caller of a caller; a path never comes back to what is on it.

    calls: caller, callee. A level keeps its first `most` paths, in order, by a top-k, and only these are followed; `found` is how many the level had, so that what is left out is told.
    """
    back = calls.select(F.col("callee").alias("_at"), F.col("caller").alias("_next")).distinct()
    level = calls.sparkSession.range(1).select(F.array(F.lit(seed).cast(calls.schema["caller"].dataType)).alias("path"))
    out: DataFrame | None = None
    for depth in range(1, max_depth + 1):
        step = level.withColumn("_at", F.element_at("path", -1)).join(back, "_at").filter(~F.array_contains("path", F.col("_next")))
        step = step.select(F.array_append("path", F.col("_next")).alias("path"))
        level = checkpointed(step.orderBy("path").limit(most))
        shown = level.crossJoin(F.broadcast(step.agg(F.count("*").alias("found")))).select(F.lit(depth).alias("depth"), "path", "found")  # one row
        out = shown if out is None else out.unionByName(shown)
    return out


def personalized_pagerank(nodes: DataFrame, back: DataFrame, seeds: list, alpha: float = 0.85, iterations: int = 12) -> DataFrame:
    """(node, rank) with rank > 0. nodes: node; back: (node, importer). Rank flows to importers; what has none flows to the seeds."""
    own = list(dict.fromkeys(seeds))
    seed = F.col("node").isin(own)
    weight = 1.0 / max(1, len(own))
    out = back.groupBy("node").agg(F.count("*").alias("n"))
    base = nodes.join(out, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"), F.when(seed, weight).otherwise(0.0).alias("p"))
    base = checkpointed(base)
    ranks = base.select("node", "n", "p", F.col("p").alias("rank"))
    for i in range(iterations):
        flow = ranks.filter("n > 0 and rank > 0").join(back, "node").groupBy(F.col("importer").alias("node")).agg(F.sum(alpha * F.col("rank") / F.col("n")).alias("in"))
        spill = ranks.agg(F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("rank"))), F.lit(0.0)).alias("spill"))
        ranks = base.join(flow, "node", "left").crossJoin(F.broadcast(spill))  # one row
        ranks = ranks.select("node", "n", "p", (((1 - alpha) * F.col("p")) + F.coalesce("in", F.lit(0.0)) + alpha * F.col("spill") * F.col("p")).alias("rank"))
        if i % 4 == 3:
            ranks = checkpointed(ranks)
    return ranks.filter("rank > 0").select("node", F.round("rank", 6).alias("rank"))


def centrality(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, vendored: Column | None = None) -> DataFrame:
    """(file, score): capped importers, plus imports, plus capped symbols; less in vendored trees. edges: src, dst; symbols: file, n."""
    fan_in = edges.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("a"))
    fan_out = edges.groupBy(F.col("src").alias("file")).agg(F.count("*").alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = nodes.join(fan_in, "file", "left").join(fan_out, "file", "left").join(symbols.withColumnRenamed("n", "c"), "file", "left")
    score = (F.least(zero("a"), F.lit(FAN_IN_CAP)) + zero("b") + F.least(zero("c"), F.lit(SYMBOL_CAP))).cast("double")
    return joined.select("file", (score * F.when(vendored, 0.25).otherwise(1.0) if vendored is not None else score).alias("score"))


def codemap(files: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row for each file: how many it imports and the first of them, its importers, its symbols. symbols: file, symbols."""
    out = edges.groupBy(F.col("src").alias("file")).agg(F.count("*").alias("imports"), F.min("dst").alias("first_import"))
    back = edges.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("importers"))
    every = files.join(out, "file", "left").join(back, "file", "left").join(symbols, "file", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return every.select("file", zero("imports"), "first_import", zero("importers"), zero("symbols"))


def edit_plan(edges: DataFrame, files: DataFrame, scores: DataFrame, primary: str | int, max_depth: int = 3, most: int = 20) -> DataFrame:
    """(role, rank, file, depth, score, found): what a change of a file asks for. The file itself; the files that reach it through imports, nearest first, then by score; and the tests among them, which are to be run.

    edges: src, dst; files: file, is_test; scores: file, score. A role shows its first `most` files, by a top-k; `found` is how many it has, so that what is left out is told. A file that isn't there has no plan.
    """
    reached = blast_radius(edges, files.filter(F.col("file") == primary).select("file"), max_depth)
    known = reached.join(files, "file").join(scores, "file", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    role = F.when(F.col("depth") == 0, "primary").when(F.coalesce("is_test", F.lit(False)), "test").otherwise("dependent")
    known = checkpointed(known.select(role.alias("role"), "file", "depth", "score"))
    order = [F.col("depth"), F.desc("score"), F.col("file")]
    out: DataFrame | None = None
    for name in ("primary", "dependent", "test"):
        own = known.filter(F.col("role") == name)
        shown = own.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.partitionBy("role").orderBy(*order)))  # of `most` rows
        shown = shown.crossJoin(F.broadcast(own.agg(F.count("*").alias("found"))))  # one row
        out = shown if out is None else out.unionByName(shown)
    return out.select("role", "rank", "file", "depth", "score", "found")


def suggested_scope(scores: DataFrame, least: float = 1.5) -> DataFrame:
    """The directory with the highest sum, if it has `least` times that of the next: zero or one row. scores: dir, score."""
    two = scores.groupBy("dir").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "dir").limit(2)
    packed = two.agg(F.sort_array(F.collect_list(F.struct("score", "dir")), asc=False).alias("t"))
    first = packed.select(F.col("t")[0].alias("a"), F.get("t", F.lit(1)).alias("b"))
    return first.filter(F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a.score") >= least * F.col("b.score")))).select("a.dir", "a.score")


def vendored_trees(files: DataFrame, edges: DataFrame, names: tuple[str, ...] = ("vendor", "third_party", "node_modules"), least_files: int = 2) -> DataFrame:
    """Top directories with such a name, or that no file outside imports and that import nothing outside: dir, files, crossing, reason. files: file, dir."""
    d = files.select("file", "dir")
    ends = edges.join(d.select(F.col("file").alias("src"), F.col("dir").alias("sd")), "src").join(d.select(F.col("file").alias("dst"), F.col("dir").alias("dd")), "dst").filter("sd <> dd")
    crossing = ends.select(F.explode(F.array("sd", "dd")).alias("dir")).groupBy("dir").agg(F.count("*").alias("crossing"))
    own = d.groupBy("dir").agg(F.count("*").alias("files")).join(crossing, "dir", "left").withColumn("crossing", F.coalesce("crossing", F.lit(0)))
    reason = F.when(F.col("dir").isin(*names), "name").when((F.col("crossing") == 0) & (F.col("files") >= least_files), "island")
    return own.withColumn("reason", reason).filter("reason is not null")


def entry_points(paths: DataFrame, path: str = "path", names: tuple[str, ...] = ENTRY_NAMES) -> DataFrame:
    return paths.filter(F.element_at(F.split(path, "/"), -1).isin(*names))


def symbol_score(line: Column, name: str, in_test: Column) -> Column:
    """0 without a mention; 3 for one, 1 more at word boundaries, 1 less in tests."""
    whole = line.rlike(rf"\b{re.escape(name)}\b").cast("int")
    return F.when(line.contains(name), F.lit(3) + whole - in_test.cast("int")).otherwise(0).cast("int")


def confidence(primary: Column, rendered: Column, truncated: Column, snippets: Column) -> Column:
    """0.9, 0.72 if truncated, 0.55 if the primary file is missing; caps for omissions and for no snippets; below 0.75 is a question."""
    start = F.when(~primary | ~rendered, 0.55).when(truncated, 0.72).otherwise(0.9)
    return F.least(start, F.when(truncated, 0.94).otherwise(1.0), F.when(snippets == 0, 0.55).otherwise(1.0))


# Strings and comments by language, as a lexer meets them from left to right over all lines of a file: what begins first counts, and what isn't closed goes on to the end of the line or of the file.
# Loops are possessive, so that long texts need no stack.
_BLOCK, _TO_LINE_END = r"/\*[\s\S]*?(?:\*/|\z)", r"//[^\n]*+"
_QUOTED = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+(?:"|(?=\n)|\z)'
_SINGLE = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+(?:'|(?=\n)|\z)"
_TICKS = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+(?:`|\z)"
_NESTED = r"/\*(?:[^/*]++|/(?!\*)|\*(?!/)|/\*(?:[^/*]++|/(?!\*)|\*(?!/)|/\*[\s\S]*?\*/)*+\*/)*+(?:\*/|\z)"
_C_LIKE = (_BLOCK, _TO_LINE_END, _QUOTED, _SINGLE)
LEXEMES: dict[str, tuple[str, ...]] = {
    "python": (r"(?:\"{3}[\s\S]*?(?:\"{3}|\z)|'{3}[\s\S]*?(?:'{3}|\z))", r"#[^\n]*+", _QUOTED, _SINGLE),
    "javascript": (_BLOCK, _TO_LINE_END, _QUOTED, _SINGLE, _TICKS),
    "typescript": (_BLOCK, _TO_LINE_END, _QUOTED, _SINGLE, _TICKS),
    "go": (_BLOCK, _TO_LINE_END, _QUOTED, _SINGLE, r"`[^`]*+(?:`|\z)"),
    # A quote may begin a lifetime; it is a character only where it is closed behind one.
    "rust": (_NESTED, _TO_LINE_END, r'\bb?r(?<h>#*+)"[\s\S]*?(?:"\k<h>|\z)', r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\z)', r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,9})'"),
    "php": (_BLOCK, _TO_LINE_END, r"#(?!\[)[^\n]*+", r"""<<<[ \t]*+(?<q>["']?)(?<w>\w++)\k<q>\n[\s\S]*?(?:\n[ \t]*+\k<w>\b|\z)""", r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\z)', r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+(?:'|\z)"),
    "java": (r'\"{3}[\s\S]*?(?:\"{3}|\z)', *_C_LIKE),
    "csharp": (r'[@$]{1,2}"[^"]*+(?:""[^"]*+)*+(?:"|\z)', *_C_LIKE),
    "c": _C_LIKE,
    "cpp": (r'\bR"(?<d>\w{0,16})\([\s\S]*?(?:\)\k<d>"|\z)', *_C_LIKE),
}


def masked(text: Column, language: str) -> Column:
    """A file's text with all but the line breaks of its strings and comments blank: the same lines, the same columns."""
    return blanked(text, LEXEMES[language])


def blanked(text: Column, lexemes: tuple[str, ...]) -> Column:
    """The text with what these patterns match, from left to right, blank. Lexemes and what is between them are cut apart in one pass, so a state is carried over all lines."""
    either = "|".join(f"(?:{x})" for x in lexemes)
    mark = "\x00"
    # A mark before and behind each lexeme; texts don't hold it, or lose it here.
    cut = F.split(F.regexp_replace(F.translate(text, mark, " "), either, f"{mark}$0{mark}"), mark, -1)
    return F.array_join(F.transform(cut, lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, r"[^\n]", " ")).otherwise(x)), "")


def code_references(files: DataFrame, symbol: str, language: str, text: str = "text") -> DataFrame:
    """(doc_id, line_no, is_call): lines on which a symbol stands in the code of a file, not in its strings and comments. files: doc_id and text."""
    name = re.escape(symbol)
    own = files.filter(F.col(text).contains(symbol)).select("doc_id", masked(F.col(text), language).alias("text"))
    found = split_into_lines(own).filter(F.col("line").rlike(rf"\b{name}\b"))
    return found.select("doc_id", "line_no", F.col("line").rlike(rf"(\b|\.|::){name}\s*\(").alias("is_call"))


def references(lines: DataFrame, symbol: str) -> DataFrame:
    """Lines that mention a symbol, with whether they call it. Strings in double quotes and comments to the line's end don't count."""
    clean = F.regexp_replace(F.regexp_replace("line", r'"[^"]*"', '""'), r"(//|#).*$", "")
    name = re.escape(symbol)
    found = lines.withColumn("_clean", clean).filter(F.col("_clean").rlike(rf"\b{name}\b"))
    return found.withColumn("is_call", F.col("_clean").rlike(rf"(\b|\.|::){name}\s*\(")).drop("_clean")


# Parts of JavaScript and TypeScript grammar, as regular expressions.
_JS_NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
_JS_STRING = r"""["']([^"'\n]+)["']"""
_JS_EXPORT = r"^\s*(?:export\s+(?:default\s+)?)?(?:declare\s+)?"
_JS_TYPE = r"(?:\s*:[^=;]+)?"
_JS_PARAMETERS = rf"(?:\([^()]*\)|{_JS_NAME})"

# Parts of Rust's grammar: visibility, what may stand before `fn`, identifiers (raw ones, too).
_RS_NAME = r"(?:r#)?[\p{L}_][\p{L}\p{N}_]*"
_RS_VISIBILITY = r"(?:pub\b\s*(?:\(\s*(?:crate|self|super|in\s[^)]*)\s*\)\s*)?)?"
_RS_QUALIFIERS = r"(?:(?:default|const|async|safe|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*"

#: Heads of definitions and imports by language, line by line: (kind, pattern with the name as group 1). Heuristic, for languages without a parser here.
EXTRACTORS: dict[str, tuple[tuple[str, str], ...]] = {
    "javascript": (
        ("import", rf"^\s*import\b(?:[^\"'()]*\bfrom\b)?\s*{_JS_STRING}"),
        ("import", rf"^\s*export\b\s*(?:type\s+)?[*{{][^\"']*\bfrom\b\s*{_JS_STRING}"),
        ("import", rf"\b(?:require|import)\s*\(\s*{_JS_STRING}\s*\)"),
        ("function", rf"{_JS_EXPORT}(?:async\s+)?function\b\s*\*?\s*({_JS_NAME})"),
        ("function", rf"{_JS_EXPORT}(?:const|let|var)\s+({_JS_NAME}){_JS_TYPE}\s*=\s*(?:async\b\s*)?(?:function\b|{_JS_PARAMETERS}{_JS_TYPE}\s*=>)"),
        ("class", rf"{_JS_EXPORT}(?:abstract\s+)?class\s+({_JS_NAME})"),
    ),
    "rust": (
        ("import", rf"^\s*{_RS_VISIBILITY}use\s+(?:::)?({_RS_NAME}(?:::{_RS_NAME})*)"),
        ("import", rf"^\s*{_RS_VISIBILITY}extern\s+crate\s+({_RS_NAME})"),
        ("function", rf"^\s*{_RS_VISIBILITY}{_RS_QUALIFIERS}fn\s+({_RS_NAME})"),
        ("function", rf"^\s*macro_rules!\s*({_RS_NAME})"),
        ("class", rf"^\s*{_RS_VISIBILITY}(?:unsafe\s+)?(?:auto\s+)?(?:struct|enum|union|trait)\s+({_RS_NAME})"),
    ),
    "go": (("import", r'^\s*(?:import\s+)?(?:[A-Za-z_.]+\s+)?"([^"]+)"\s*$'), ("function", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)"), ("class", r"^type\s+([A-Za-z_][A-Za-z0-9_]*)\s+(?:struct|interface)")),
    "java": (("import", r"^\s*import\s+(?:static\s+)?([A-Za-z0-9_.]+)"), ("class", r"^\s*(?:public|protected|private|abstract|final|static|\s)*(?:class|interface|enum|record)\s+([A-Za-z_][A-Za-z0-9_]*)")),
    "php": (("import", r"^\s*use\s+([A-Za-z0-9_\\]+)"), ("function", r"^\s*(?:public|protected|private|static|\s)*function\s+([A-Za-z_][A-Za-z0-9_]*)"), ("class", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+([A-Za-z_][A-Za-z0-9_]*)")),
    "csharp": (("import", r"^\s*using\s+([A-Za-z0-9_.]+)\s*;"), ("class", r"^\s*(?:public|internal|protected|private|abstract|sealed|static|partial|\s)*(?:class|interface|struct|record|enum)\s+([A-Za-z_][A-Za-z0-9_]*)")),
    "c": (("import", r'^\s*#\s*include\s*[<"]([^>"]+)[>"]'), ("class", r"^\s*(?:typedef\s+)?(?:struct|union|enum|class)\s+([A-Za-z_][A-Za-z0-9_]*)"), ("function", r"^[A-Za-z_][A-Za-z0-9_ *]*\s[*]?([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*$")),
}
EXTRACTORS |= {"typescript": (*EXTRACTORS["javascript"], ("class", rf"{_JS_EXPORT}(?:interface|type|enum|namespace)\s+({_JS_NAME})")), "cpp": EXTRACTORS["c"]}
#: Language of a file by its suffix.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "java": "java", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp"}


def language_of_file(path: Column) -> Column:
    """Null for a suffix that isn't known."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[suffix]


def extract(lines: DataFrame, language: str) -> DataFrame:
    """Imports and definitions by line: the columns of lines, kind, name."""
    found = [F.when(F.regexp_extract("line", p, 1) != "", F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", p, 1).alias("name"))) for kind, p in EXTRACTORS[language]]
    return lines.withColumn("_f", F.explode(F.array_compact(F.array(*found)))).select(*[c for c in lines.columns if c != "line"], "_f.kind", "_f.name")


def manifest_digest(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """One digest for a table of (key, digest): of the digests of 256 buckets, each of its sorted rows, so no task holds them all."""
    entry = F.concat_ws("\t", F.col(key).cast("string"), digest)
    own = rows.select(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(256)).alias("b"), entry.alias("e"))
    parts = own.groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("e")), "\n"), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"), F.count("*").alias("buckets"))


