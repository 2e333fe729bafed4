"""Queries of search, projection, counting and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import context, many, search
from lexloom.operators.search import SearchSpec
from lexloom.plans.base import LINES, query, table

PATTERNS = ("tion", "license", "%%%", "stupid")
SEQUENCE = SearchSpec(["ing"]), SearchSpec(["tion"])


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _lines_sql(select: str, where: str = "") -> str:
    return f"WITH {LINES} SELECT {select} FROM lines {'WHERE ' + where if where else ''}"


def _search(name: str, spec: SearchSpec, condition: str, flags: str = "") -> None:
    @query(name, _lines_sql("doc_id, line_no, line", condition))
    def run(spark, sf_dir, spec=spec):
        return search.search(docs(spark, sf_dir), spec)


@query("q_src3_lines", _lines_sql("doc_id, line_no, line"))
def src3(spark, sf_dir):
    return search.lines(docs(spark, sf_dir))


@query("q_src6_globs", "SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents WHERE regexp_matches(source || '/' || lang || '/' || doc_id || '.txt', '^src1.*\\.txt$') AND NOT (source || '/' || lang || '/' || doc_id || '.txt' LIKE '%/de/%')")
def src6(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path"))
    return found.filter(search.path_filter(F.col("path"), ["src1*.txt", "!*/de/*"]))


@query("q_src7_types", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr') AND source NOT IN ('src0')")
def src7(spark, sf_dir):
    return docs(spark, sf_dir).filter(F.col("lang").isin("en", "fr") & ~F.col("source").isin("src0")).select("doc_id", "lang")


PAGE_PATH = "regexp_extract(url, '//[^/]+/([^?#]*)', 1)"


@query("q_src8_hidden_depth", f"SELECT page_id, {PAGE_PATH} AS path FROM pages WHERE NOT regexp_matches({PAGE_PATH}, '(^|/)\\.') AND len(string_split({PAGE_PATH}, '/')) <= 2")
def src8(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//[^/]+/([^?#]*)", 1).alias("path"))
    return found.filter(~F.col("path").rlike(r"(^|/)\.") & (F.size(F.split("path", "/")) <= 2))


@query("q_src10_generated_dirs", f"SELECT page_id FROM pages WHERE len(list_intersect(string_split({PAGE_PATH}, '/'), ['fr', 'build', 'dist', 'target', 'venv', 'node_modules'])) = 0")
def src10(spark, sf_dir):
    from lexloom.sources.files import outside_dirs

    found = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//[^/]+/([^?#]*)", 1).alias("path"))
    return found.filter(outside_dirs(F.col("path"), ["fr", "build", "dist", "target", "venv", "node_modules"])).select("page_id")


@query("q_src11_max_size", "SELECT doc_id, strlen(text)::INTEGER AS n_bytes FROM documents WHERE strlen(text) <= 1000")
def src11(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.octet_length("text").alias("n_bytes")).filter("n_bytes <= 1000")


@query("q_src14_files", "SELECT DISTINCT source || '/' || doc_id AS path FROM documents")
def src14(spark, sf_dir):
    return docs(spark, sf_dir).select(F.concat_ws("/", "source", "doc_id").alias("path")).distinct()


@query("q_src16_no_paths", _lines_sql("doc_id, line_no, line", "false"))
def src16(spark, sf_dir):
    return search.search(docs(spark, sf_dir).limit(0), SearchSpec(["the"]))


_search("q_flt1_fixed", SearchSpec(["tion of"], fixed=True), "contains(line, 'tion of')")
_search("q_flt2_regex", SearchSpec(["th[ae]t? (of|and)"]), "regexp_matches(line, 'th[ae]t? (of|and)')")
_search("q_flt3_ignore_case", SearchSpec(["THE of"], fixed=True, ignore_case=True), "contains(lower(line), 'the of')")
_search("q_flt4_smart_case", SearchSpec(["this and"], smart_case=True), "regexp_matches(line, 'this and', 'i')")
_search("q_flt5_word", SearchSpec(["worthless|stupid"], word=True), r"regexp_matches(line, '\b(?:worthless|stupid)\b')")
_search("q_flt6_whole_line", SearchSpec(["Released under the [A-Z]+ License[.]"], line_regexp=True), r"regexp_matches(line, '^(?:Released under the [A-Z]+ License[.])\r?$')")
_search("q_flt7_invert", SearchSpec(["e"], invert=True, fixed=True), "NOT contains(line, 'e')")
_search("q_flt8_or", SearchSpec(["stupid", "worthless [a-z]+"]), "regexp_matches(line, 'stupid') OR regexp_matches(line, 'worthless [a-z]+')")
_search("q_win4_max_count", SearchSpec(["the"], max_count=2), "contains(line, 'the') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 2")

_values = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PATTERNS))


@query("q_flt9_multi_pattern", f"WITH {LINES}, p(pattern_id, pattern_text) AS (VALUES {_values}) SELECT doc_id, line_no, pattern_id, pattern_text FROM lines JOIN p ON contains(line, pattern_text)")
def flt9(spark, sf_dir):
    return search.multi_pattern(docs(spark, sf_dir), PATTERNS)


_PIECES_SQL = "SELECT DISTINCT substring(text, 1 + 37 * k, 6 + 2 * k) AS pattern_text FROM documents, range(5) r(k) WHERE length(text) >= 6 + 39 * k AND doc_id < 1000"


@query("q_flt9_many_patterns", f"WITH {LINES}, p AS (SELECT pattern_text FROM ({_PIECES_SQL}) WHERE NOT contains(pattern_text, chr(10))) SELECT doc_id, line_no, pattern_text FROM lines JOIN p ON contains(line, pattern_text)")
def flt9_many(spark, sf_dir):
    """Up to 5,000 pieces of the first thousand documents, looked for in all lines of all documents."""
    own = docs(spark, sf_dir)
    pieces = own.filter("doc_id < 1000").select("text", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).filter("length(text) >= 6 + 39 * k")
    patterns = sorted({r[0] for r in pieces.select(F.expr("substring(text, 1 + 37 * k, 6 + 2 * k)")).collect()})  # 5,000 at most
    known = spark.createDataFrame([*enumerate(patterns)], "pattern_id long, pattern_text string")
    return many.match_many(own, patterns).join(F.broadcast(known), "pattern_id").select("doc_id", "line_no", "pattern_text")


@query("q_flt14_lookaround")
def flt14(spark, sf_dir):
    return search.search(docs(spark, sf_dir), SearchSpec([r"(?<=the )\b(\w+)\b(?= \1)"]))


_BREAKS = "length({0}) - length(replace({0}, chr(10), ''))"


@query("q_flt13_combined", f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '(?i)\\b(the|of)\\b') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 2")
def flt13(spark, sf_dir):
    return search.search(docs(spark, sf_dir), SearchSpec(["the", "of"], ignore_case=True, word=True, max_count=2))


@query("q_flt20_neutral_flags", _lines_sql("doc_id, line_no, line", "contains(line, 'License')"))
def flt20(spark, sf_dir):
    return search.search(docs(spark, sf_dir), SearchSpec(["License"], fixed=True, ignored={"threads": 4, "mmap": True, "line_buffered": True, "color": "never"}))


@query("q_flt15_multiline", rf"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?s)License.{{0,40}}\n[A-Z]') AS ms, string_split_regex(text, '(?s)License.{{0,40}}\n[A-Z]') AS ps FROM documents),
e AS (SELECT doc_id, ms, ps, unnest(ms) AS match, generate_subscripts(ms, 1) AS i FROM m), b AS (SELECT doc_id, i, match, array_to_string(ps[1 : i], '') || array_to_string(ms[1 : i - 1], '') AS before FROM e)
SELECT doc_id, (i - 1)::INTEGER AS nth, match, (1 + {_BREAKS.format('before')})::INTEGER AS start_line, ({_BREAKS.format('match')})::INTEGER AS breaks FROM b""")
def flt15(spark, sf_dir):
    return search.multiline(docs(spark, sf_dir), r"(?s)License.{0,40}\n[A-Z]")


@query("q_flt16_records", r"WITH r AS (SELECT doc_id, string_split_regex(text, '\r?\n') AS rs FROM documents) SELECT doc_id, unnest(rs) AS record, (generate_subscripts(rs, 1) - 1)::INTEGER AS record_no FROM r")
def flt16(spark, sf_dir):
    return search.records(docs(spark, sf_dir), "\r?\n")


@query("q_flt17_exists", _lines_sql("count(*) > 0 AS found", "contains(line, 'stupid')"))
def flt17(spark, sf_dir):
    return search.any_match(docs(spark, sf_dir), SearchSpec(["stupid"], fixed=True))


@query("q_flt19_stop_on_nonmatch", f"""WITH {LINES}, h AS (SELECT *, contains(line, 'the') AS hit FROM lines),
s AS (SELECT *, max(hit::INT) OVER w AS seen FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
e AS (SELECT *, max(CASE WHEN seen = 1 AND NOT hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS ended FROM s)
SELECT doc_id, line_no FROM e WHERE hit AND ended = 0""")  # fmt: skip
def flt19(spark, sf_dir):
    return search.stop_on_nonmatch(docs(spark, sf_dir), SearchSpec(["the"], fixed=True))


@query("q_prj1_only_matching", f"WITH {LINES}, m AS (SELECT doc_id, line_no, regexp_extract_all(line, '[a-z]+tion[a-z]*') AS ms FROM lines) SELECT doc_id, line_no, unnest(ms) AS match, (generate_subscripts(ms, 1) - 1)::INTEGER AS nth FROM m")
def prj1(spark, sf_dir):
    return search.only_matching(docs(spark, sf_dir), "[a-z]+tion[a-z]*")


@query("q_prj2_replace", _lines_sql(r"doc_id, line_no, regexp_replace(line, '(the) ([a-z]+)', '\2-\1', 'g') AS replaced", "regexp_matches(line, '(the) ([a-z]+)')"))
def prj2(spark, sf_dir):
    return search.replace_in_lines(docs(spark, sf_dir), "(the) ([a-z]+)", "$2-$1")


@query("q_prj3_replace_docs", r"SELECT doc_id, regexp_replace(text, 'stupid|worthless', '[removed]', 'g') AS text FROM documents")
def prj3(spark, sf_dir):
    return search.replace_in_docs(docs(spark, sf_dir).select("doc_id", "text"), "stupid|worthless", "[removed]")


_OCCURRENCES = f"""WITH {LINES}, p AS (SELECT doc_id, line_no, string_split(line, 'tion') AS ps FROM lines WHERE contains(line, 'tion')),
o AS (SELECT doc_id, line_no, ps, unnest(range(1, len(ps))) AS i FROM p),
c AS (SELECT doc_id, line_no, (strlen(array_to_string(ps[:i], 'tion')) + 1)::INTEGER AS byte_column FROM o)"""


@query("q_prj4_columns", f"{_OCCURRENCES} SELECT doc_id, line_no, byte_column FROM c")
def prj4(spark, sf_dir):
    return search.occurrences(docs(spark, sf_dir), "tion")


@query("q_prj5_byte_offset", f"WITH {LINES}, o AS (SELECT doc_id, line_no, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM lines) SELECT doc_id, line_no, byte_offset FROM o WHERE contains(line, 'tion')")
def prj5(spark, sf_dir):
    return search.byte_offsets(docs(spark, sf_dir), SearchSpec(["tion"], fixed=True))


@query("q_prj6_trim_columns", _lines_sql(r"doc_id, line_no, CASE WHEN strlen(regexp_replace(line, '^[ \t]+', '')) > 120 THEN '[Omitted long matching line]' ELSE regexp_replace(line, '^[ \t]+', '') END AS shown", "contains(line, 'the')"))
def prj6(spark, sf_dir):
    return search.trimmed(docs(spark, sf_dir), SearchSpec(["the"], fixed=True), 120)


@query("q_prj7_submatches")
def prj7(spark, sf_dir):
    return search.submatches(docs(spark, sf_dir), "tion")


@query("q_prj8_passthru", _lines_sql("doc_id, line_no, contains(line, 'tion') AS matched"))
def prj8(spark, sf_dir):
    return search.passthru(docs(spark, sf_dir), SearchSpec(["tion"], fixed=True))


_CONTEXT = f"""WITH {LINES}, m AS (SELECT doc_id, line_no, line, contains(line, 'stupid') AS matched FROM lines),
n AS (SELECT *, max(matched) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM m)"""
_AROUND = SearchSpec(["stupid"], fixed=True, before=1, after=2)


@query("q_win1_context", f"{_CONTEXT} SELECT doc_id, line_no, line, matched FROM n WHERE near")
def win1(spark, sf_dir):
    return context.with_context(docs(spark, sf_dir), _AROUND)


@query("q_win2_context_groups", f"""{_CONTEXT}, g AS (SELECT doc_id, line_no, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) > 1 THEN 1 ELSE 0 END AS gap FROM n WHERE near)
SELECT doc_id, line_no, sum(gap) OVER (PARTITION BY doc_id ORDER BY line_no)::INTEGER AS group_no FROM g""")
def win2(spark, sf_dir):
    return context.context_groups(docs(spark, sf_dir), _AROUND).select("doc_id", "line_no", "group_no")


_SEQUENCES = f"""WITH {LINES}, a AS (SELECT doc_id, line_no, contains(line, 'ing') AS first, min(CASE WHEN contains(line, 'tion') THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS then_line FROM lines),
s AS (SELECT doc_id, line_no AS first_line, then_line FROM a WHERE first AND then_line IS NOT NULL)"""


@query("q_win3_eventually", f"{_SEQUENCES} SELECT * FROM s")
def win3(spark, sf_dir):
    return context.eventually(docs(spark, sf_dir), *SEQUENCE)


@query("q_jn10_next_match", f"{_SEQUENCES} SELECT doc_id, first_line, then_line FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY first_line) <= 3")
def jn10(spark, sf_dir):
    return context.eventually(docs(spark, sf_dir), *SEQUENCE, max_count=3)


CHUNKS = f"""{LINES}, chunk_starts AS (SELECT doc_id, ls, unnest(range(0, greatest(0, ceil((len(ls) - 8) / 6.0))::INTEGER + 1)) AS i FROM doc_lines WHERE len(ls) > 0),
chunks AS (SELECT doc_id, i::INTEGER AS chunk_no, (i * 6 + 1)::INTEGER AS start_line, least(i * 6 + 8, len(ls))::INTEGER AS end_line, array_to_string(ls[i * 6 + 1 : i * 6 + 8], chr(10)) AS text FROM chunk_starts)"""


@query("q_win5_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_no, start_line, end_line, text FROM chunks")
def win5(spark, sf_dir):
    return context.chunks(docs(spark, sf_dir), 8, 2)


@query("q_agg1_count_lines", _lines_sql("doc_id, count(*) AS n", "contains(line, 'the') GROUP BY doc_id"))
def agg1(spark, sf_dir):
    return search.count_lines(docs(spark, sf_dir), SearchSpec(["the"], fixed=True))


@query("q_agg2_count_matches", _lines_sql("doc_id, sum(len(regexp_extract_all(line, 'th[aei]')))::BIGINT AS n", "true GROUP BY doc_id HAVING sum(len(regexp_extract_all(line, 'th[aei]'))) > 0"))
def agg2(spark, sf_dir):
    return search.count_matches(docs(spark, sf_dir), "th[aei]")


@query("q_agg3_include_zero", f"WITH {LINES} SELECT d.doc_id, count(l.line) AS n FROM documents d LEFT JOIN (SELECT * FROM lines WHERE contains(line, 'stupid')) l ON d.doc_id = l.doc_id GROUP BY d.doc_id")
def agg3(spark, sf_dir):
    return search.count_with_zero(docs(spark, sf_dir), SearchSpec(["stupid"], fixed=True))


@query("q_agg4_files_with", _lines_sql("DISTINCT doc_id", "contains(line, 'stupid')"))
def agg4(spark, sf_dir):
    return search.docs_with(docs(spark, sf_dir), SearchSpec(["stupid"], fixed=True))


@query("q_agg5_files_without", f"WITH {LINES} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lines WHERE contains(line, 'the'))")
def agg5(spark, sf_dir):
    return search.docs_without(docs(spark, sf_dir), SearchSpec(["the"], fixed=True))


@query("q_agg6_stats", f"""WITH {LINES}, p AS (SELECT doc_id, count(*) FILTER (WHERE contains(line, 'the')) AS hits, count(*) AS n, sum(strlen(line) + 1) AS b FROM lines GROUP BY doc_id)
SELECT count(*) AS docs_searched, count(*) FILTER (WHERE hits > 0) AS docs_matched, sum(hits)::BIGINT AS lines_matched, sum(n)::BIGINT AS lines_searched, sum(b)::BIGINT AS bytes_searched FROM p""")
def agg6(spark, sf_dir):
    return search.stats(docs(spark, sf_dir), SearchSpec(["the"], fixed=True))


@query("q_srt2_path_order", _lines_sql("doc_id, line_no", "contains(line, 'License') ORDER BY doc_id, line_no"))
def srt2(spark, sf_dir):
    return search.search(docs(spark, sf_dir), SearchSpec(["License"], fixed=True)).select("doc_id", "line_no").orderBy("doc_id", "line_no")


@query("q_srt1_size_order", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id")
def srt1(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id")


@query("q_top2_result_caps", f"""WITH {LINES}, m AS (SELECT doc_id, line_no, dense_rank() OVER (ORDER BY doc_id) AS f FROM lines WHERE contains(line, 'the'))
SELECT doc_id, line_no FROM m WHERE f <= 15 ORDER BY doc_id, line_no LIMIT 150""")
def top2(spark, sf_dir):
    from lexloom.operators.limits import capped

    return capped(search.search(docs(spark, sf_dir), SearchSpec(["the"], fixed=True)).select("doc_id", "line_no"), 15, 150)


@query("q_fn13_byte_column", _lines_sql("doc_id, line_no, (strlen(line[1 : instr(line, 'tion') - 1]) + 1)::INTEGER AS byte_column", "contains(line, 'tion')"))
def fn13(spark, sf_dir):
    found = search.search(docs(spark, sf_dir), SearchSpec(["tion"], fixed=True))
    return found.select("doc_id", "line_no", search.first_byte_column(F.col("line"), "tion").alias("byte_column"))


@query("q_set1_union_spans", _lines_sql("DISTINCT doc_id, line_no", "contains(line, 'stupid') OR contains(line, 'worthless')"))
def set1(spark, sf_dir):
    d = docs(spark, sf_dir)
    both = [search.search(d, SearchSpec([p], fixed=True)).select("doc_id", "line_no") for p in ("stupid", "worthless")]
    return both[0].unionByName(both[1]).distinct()


@query("q_set2_first_seen", _lines_sql("line, doc_id, line_no", "line <> '' QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) = 1"))
def set2(spark, sf_dir):
    first = F.min(F.struct("doc_id", "line_no")).alias("at")
    found = search.lines(docs(spark, sf_dir)).filter("line <> ''").groupBy("line").agg(first)
    return found.select("line", "at.doc_id", "at.line_no")


@query("q_set4_intersect", f"WITH {LINES} SELECT line FROM lines WHERE lang = 'en' INTERSECT SELECT line FROM lines WHERE lang = 'de'")
def set4(spark, sf_dir):
    own = search.lines(docs(spark, sf_dir), "lang")
    return own.filter("lang = 'en'").select("line").intersect(own.filter("lang = 'de'").select("line"))


@query("q_src12_binary", "SELECT doc_id, contains(text, chr(0)) AS \"binary\" FROM documents")
def src12(spark, sf_dir):
    from lexloom.sources.files import is_binary

    return docs(spark, sf_dir).select("doc_id", is_binary(F.encode("text", "utf-8")).alias("binary"))


@query("q_src1_scan")
def src1(spark, sf_dir):
    from lexloom.sources.files import scan

    return scan(spark, sf_dir).select("name", "length")


@query("q_src9_ignore_rules", "SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, NOT (source = 'src1' AND lang = 'en') AND (source LIKE 'src1%' OR suffix(doc_id::VARCHAR, '9')) AS ignored FROM documents")
def src9(spark, sf_dir):
    from lexloom.sources.files import ignored

    paths = docs(spark, sf_dir).select(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path"))
    return ignored(paths, [("", "src1*/", False), ("src1/en", "*.txt", True), ("", "*9.txt", False)])


@query("q_flt_linear_engine", _lines_sql("doc_id, line_no", r"regexp_matches(line, '(?:th|in)+g [a-z]+tion\b')"))
def flt_linear(spark, sf_dir):
    from lexloom.operators.linear import search_linear

    return search_linear(docs(spark, sf_dir), r"(?:th|in)+g [a-z]+tion\b").select("doc_id", "line_no")




@query("q_src13_broad_refusal", "SELECT (SELECT count(*) FROM documents) > 100 AS refused, false AS refused_explicit")
def src13(spark, sf_dir):
    """An implicit root with as many files as the table has documents."""
    n = docs(spark, sf_dir).count()

    def refused(explicit):
        try:
            search.refuse_broad(n, 100, explicit)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(refused(False), refused(True))], "refused boolean, refused_explicit boolean")


@query("q_flt18_invalid_regex", "SELECT * FROM (VALUES ('a(b', true), ('[z-a]', true), ('*x', true), ('a[b]', false)) v(pattern, refused)")
def flt18(spark, sf_dir):
    def refused(pattern):
        try:
            search.search(docs(spark, sf_dir), SearchSpec([pattern]))
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(p, refused(p)) for p in ("a(b", "[z-a]", "*x", "a[b]")], "pattern string, refused boolean")


@query("q_src15_compressed", "SELECT lang, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents GROUP BY lang")
def src15(spark, sf_dir):
    """The texts of each language written as compressed files, and read again as lines."""
    from lexloom.operators.shared import new_path
    from lexloom.sources.files import read_lines

    path = new_path(spark, "compressed")
    docs(spark, sf_dir).select("lang", "text").write.partitionBy("lang").option("compression", "gzip").text(path)
    found = read_lines(spark, f"{path}/*/*.gz")
    return found.groupBy(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang")).agg(F.count("*").alias("n_lines"))


@query("q_src5_text_lines", "SELECT lang, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY lang")
def src5(spark, sf_dir):
    """The texts of each language written as plain files, and read again as lines; the breaks between lines are put back into the sum."""
    from lexloom.operators.shared import new_path
    from lexloom.sources.files import read_lines

    path = new_path(spark, "plain")
    docs(spark, sf_dir).select("lang", "text").write.partitionBy("lang").text(path)
    found = read_lines(spark, f"{path}/*/*.txt")
    n = docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
    lines_ = found.groupBy(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang")).agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("bytes"))
    return lines_.join(n, "lang").select("lang", "n_lines", (F.col("bytes") + F.col("n_lines") - F.col("n")).alias("n_bytes"))


@query("q_src17_types", "SELECT page_id, regexp_matches(p, '(\\.html?|\\.tmpl)$') AS is_html, regexp_matches(p, '\\.(js|html?|tmpl)$') AS is_web FROM (SELECT page_id, regexp_extract(url, '//[^/]+/([^?#]*)', 1) AS p FROM pages)")
def src17(spark, sf_dir):
    from lexloom.sources.files import TypeTable

    types = TypeTable(add=["html:*.tmpl", "web:include:html", "web:*.js"], clear=["js"])
    path = F.regexp_extract("url", "//[^/]+/([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", types.has(path, "html").alias("is_html"), types.has(path, "web").alias("is_web"))


@query("q_src17_type_list", "SELECT * FROM (VALUES ('go: *.go'), ('proto: *.pb, *.proto'), ('py: *.pyi')) v(entry)")
def src17_list(spark, sf_dir):
    from lexloom.sources.files import TypeTable

    types = TypeTable(add=["proto:*.proto", "proto:*.pb", "py:*.pyi"], clear=["py"])
    return spark.createDataFrame([(x,) for x in types.listed() if x.split(":")[0] in ("go", "proto", "py")], "entry string")


@query("q_srt1_files")
def srt1_files(spark, sf_dir):
    from lexloom.sources.files import ordered, scan

    return ordered(scan(spark, sf_dir), "modified").select("name", "length")
