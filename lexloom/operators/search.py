"""Line search: predicates, projections, counts and limits."""

from __future__ import annotations

import fnmatch
import functools
import operator
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import byte_column, regex_quote, required_literal, split_lines


@dataclass(frozen=True)
class SearchSpec:
    """What to look for. Patterns are an OR. A fixed string with word or line_regexp is quoted and bounded, no flag is dropped."""

    patterns: Sequence[str]
    fixed: bool = False
    ignore_case: bool = False
    smart_case: bool = False
    word: bool = False
    line_regexp: bool = False
    invert: bool = False
    before: int = 0
    after: int = 0
    max_count: int | None = None
    unicode: bool = False
    #: Flags that never change the rows, accepted and not used: threads, mmap, colour and the like.
    ignored: dict = field(default_factory=dict)

    @property
    def folds(self) -> bool:
        return self.ignore_case or (self.smart_case and not any(c.isupper() for p in self.patterns for c in p))


def _regex(pattern: str, spec: SearchSpec) -> str:
    body = regex_quote(pattern) if spec.fixed else pattern
    if spec.word:
        body = rf"\b(?:{body})\b"
    if spec.line_regexp:
        body = rf"^(?:{body})\r?$"
    flags = ("i" if spec.folds else "") + ("U" if spec.unicode else "")
    return f"(?{flags}){body}" if flags else body


def predicate(spec: SearchSpec, column: Column) -> Column:
    """Whether a line matches; never null."""

    def one(pattern: str) -> Column:
        if spec.fixed and not (spec.word or spec.line_regexp):
            return F.lower(column).contains(pattern.lower()) if spec.folds else column.contains(pattern)
        literal = None if spec.folds else required_literal(pattern) if not spec.fixed else pattern
        found = column.rlike(_regex(pattern, spec))
        return column.contains(literal) & found if literal and len(literal) > 1 else found

    found = F.coalesce(functools.reduce(operator.or_, map(one, spec.patterns), F.lit(False)), F.lit(False))
    return ~found if spec.invert else found


def prefilter(spec: SearchSpec, text: Column) -> Column | None:
    """What whole documents must hold to have a matching line; the optimizer can't derive this through the split into lines."""
    if spec.invert:
        return None
    literals = [p if spec.fixed else required_literal(p) for p in spec.patterns]
    if not literals or any(not x or "\n" in x or (spec.folds and not x.isascii()) for x in literals):
        return None
    if spec.folds:
        # With Unicode folding two letters beyond ASCII match k and s, and one of them is its own lower case.
        if spec.unicode and any(c in "kKsS" for x in literals for c in x):
            return None
        text, literals = F.lower(text), [x.lower() for x in literals]
    return functools.reduce(operator.or_, (text.contains(x) for x in literals))


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, columns to keep, line_no from 1, line."""
    found = docs.filter(F.col("text").isNotNull()).select("doc_id", *keep, F.posexplode(split_lines(F.col("text"))).alias("_at", "line"))
    return found.select("doc_id", *keep, (F.col("_at") + 1).cast("int").alias("line_no"), "line")


def search(docs: DataFrame, spec: SearchSpec, *keep: str) -> DataFrame:
    """Matching lines; with max_count the first of each document."""
    for pattern in () if spec.fixed else spec.patterns:
        check_regex(docs.sparkSession, pattern)
    early = prefilter(spec, F.col("text"))
    found = lines(docs.filter(early) if early is not None else docs, *keep).filter(predicate(spec, F.col("line")))
    if spec.max_count is not None:
        order = Window.partitionBy("doc_id").orderBy("line_no")
        found = found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= spec.max_count).drop("_rank")
    return found


def count_lines(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Matching lines of documents that have any."""
    return search(docs, spec).groupBy("doc_id").agg(F.count("*").alias("n"))


def count_with_zero(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Matching lines of every document, without a shuffle: counted in the row."""
    n = F.size(F.filter(split_lines(F.coalesce("text", F.lit(""))), lambda x: predicate(spec, x)))
    return docs.select("doc_id", n.cast("long").alias("n"))


def count_matches(docs: DataFrame, pattern: str) -> DataFrame:
    """Occurrences, not lines."""
    found = F.regexp_count(F.col("line"), F.lit(pattern)).cast("long")
    return lines(docs).groupBy("doc_id").agg(F.sum(found).alias("n")).filter("n > 0")


def docs_with(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    return docs.filter(F.exists(split_lines(F.coalesce("text", F.lit(""))), lambda x: predicate(spec, x))).select("doc_id")


def docs_without(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Documents without lines are without a match, too."""
    return docs.filter(~F.exists(split_lines(F.coalesce("text", F.lit(""))), lambda x: predicate(spec, x))).select("doc_id")


def any_match(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """One row: whether anything matches. The limit ends the scan early."""
    return search(docs, spec).limit(1).agg((F.count("*") > 0).alias("found"))


def stats(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    own = lines(docs).withColumn("_hit", predicate(spec, F.col("line")))
    per = own.groupBy("doc_id").agg(F.count_if("_hit").alias("hits"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    return per.agg(
        F.count("*").alias("docs_searched"), F.count_if(F.col("hits") > 0).alias("docs_matched"), F.sum("hits").alias("lines_matched"), F.sum("n").alias("lines_searched"), F.sum("bytes").alias("bytes_searched")
    )


def multi_pattern(docs: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """A row for each line and distinct fixed pattern in it. Patterns are literals in the plan, so nothing is joined."""
    known = list(dict.fromkeys(patterns))
    hits = F.array_compact(F.array(*[F.when(F.col("line").contains(p), F.struct(F.lit(i).alias("pattern_id"), F.lit(p).alias("pattern_text"))) for i, p in enumerate(known)]))
    early = functools.reduce(operator.or_, (F.col("text").contains(p) for p in known))
    found = lines(docs.filter(early)).select("doc_id", "line_no", F.explode(hits).alias("hit"))
    return found.select("doc_id", "line_no", "hit.pattern_id", "hit.pattern_text")


def only_matching(docs: DataFrame, pattern: str) -> DataFrame:
    literal = required_literal(pattern)
    docs = docs.filter(F.col("text").contains(literal)) if literal else docs
    return lines(docs).select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("nth", "match"))


def replace_in_lines(docs: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Matching lines as they print with replacements; $1 names a group."""
    return lines(docs).filter(F.col("line").rlike(pattern)).select("doc_id", "line_no", F.regexp_replace("line", pattern, replacement).alias("replaced"))


def replace_in_docs(docs: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """A new version of the documents; nothing is written in place."""
    return docs.withColumn("text", F.regexp_replace("text", pattern, replacement))


def occurrences(docs: DataFrame, literal: str) -> DataFrame:
    """A row for each occurrence of a fixed string, with its byte column."""
    parts = F.split("line", regex_quote(literal), -1)
    own = lines(docs.filter(F.col("text").contains(literal))).filter(F.col("line").contains(literal)).withColumn("_parts", parts)
    before = F.transform(F.sequence(F.lit(1), F.size("_parts") - 1), lambda i: F.concat_ws(literal, F.slice("_parts", 1, i)))
    own = own.select("doc_id", "line_no", F.explode(before).alias("_before"))
    return own.select("doc_id", "line_no", (F.octet_length("_before") + 1).cast("int").alias("byte_column"))


def submatches(docs: DataFrame, literal: str) -> DataFrame:
    """Matching lines with an array of (match, start, end) in bytes."""
    found = occurrences(docs, literal)
    size = len(literal.encode())
    one = F.struct(F.lit(literal).alias("match"), (F.col("byte_column") - 1).alias("start"), (F.col("byte_column") - 1 + size).alias("end"))
    return found.groupBy("doc_id", "line_no").agg(F.sort_array(F.collect_list(one)).alias("submatches"))


def byte_offsets(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Matching lines with the byte offset at which they begin."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    early = prefilter(spec, F.col("text"))
    own = lines(docs.filter(early) if early is not None else docs).withColumn("byte_offset", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)))
    return own.filter(predicate(spec, F.col("line"))).select("doc_id", "line_no", "byte_offset")


def trimmed(docs: DataFrame, spec: SearchSpec, max_columns: int) -> DataFrame:
    """Leading blanks cut; a longer line shows that it is omitted."""
    shown = F.regexp_replace("line", r"^[ \t]+", "")
    return search(docs, spec).select("doc_id", "line_no", F.when(F.octet_length(shown) > max_columns, "[Omitted long matching line]").otherwise(shown).alias("shown"))


def passthru(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    return lines(docs).select("doc_id", "line_no", predicate(spec, F.col("line")).alias("matched"))


def _locate(part: Column, text: Column, begin: Column) -> Column:
    return F.call_function("locate", part, text, begin)


def multiline(docs: DataFrame, pattern: str) -> DataFrame:
    """Matches over whole texts, with the line on which each begins and its line breaks.

    Behind each match what is left is looked through for the next one's first place, so equal matches keep their own lines.
    """
    found = docs.filter(F.col("text").rlike(pattern)).withColumn("_m", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    # Each match is the first place of its text behind the match before: (next character, starts).
    none = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("starts"))
    step = lambda s, m: F.struct((_locate(m, F.col("text"), s["next"]) + F.greatest(F.length(m), F.lit(1))).alias("next"), F.concat(s["starts"], F.array(_locate(m, F.col("text"), s["next"]))).alias("starts"))
    found = found.withColumn("_s", F.aggregate("_m", none, step, lambda s: s["starts"]))
    found = found.select("doc_id", "text", F.posexplode(F.arrays_zip("_m", "_s")).alias("nth", "x"))
    start = F.regexp_count(F.substring(F.col("text"), F.lit(1), F.col("x._s") - 1), F.lit("\n")) + 1
    return found.select("doc_id", "nth", F.col("x._m").alias("match"), start.cast("int").alias("start_line"), F.regexp_count("x._m", F.lit("\n")).alias("breaks"))


def records(docs: DataFrame, separator: str) -> DataFrame:
    """Records by another separator, a regular expression: CRLF or NUL."""
    return docs.select("doc_id", F.posexplode(F.split("text", separator, -1)).alias("record_no", "record"))


def stop_on_nonmatch(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Matching lines up to the first line without a match behind the first with one."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = lines(docs).withColumn("_hit", predicate(spec, F.col("line")))
    own = own.withColumn("_seen", F.max("_hit").over(w)).withColumn("_ended", F.max(F.col("_seen") & ~F.col("_hit")).over(w))
    return own.filter(F.col("_hit") & ~F.col("_ended")).select("doc_id", "line_no")


def check_regex(spark: SparkSession, pattern: str) -> None:
    """An invalid pattern is an error before anything is planned, never a search without matches."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as error:
        raise ValueError(f"invalid regular expression: {pattern}") from error


def glob_regex(glob: str) -> str:
    return fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$")


def path_filter(path: Column, globs: Sequence[str]) -> Column:
    """`!` excludes; if there are others, one of them must match the whole path or the name."""
    name = F.element_at(F.split(path, "/"), -1)
    hit = lambda g: path.rlike(glob_regex(g)) | name.rlike(glob_regex(g))
    keep = [hit(g) for g in globs if not g.startswith("!")]
    drop = [hit(g[1:]) for g in globs if g.startswith("!")]
    found = functools.reduce(operator.or_, keep) if keep else F.lit(True)
    return found & ~functools.reduce(operator.or_, drop) if drop else found


def refuse_broad(n_files: int, ceiling: int = 1500, explicit: bool = False) -> None:
    """An implicit root with too many files is refused before anything runs."""
    if n_files > ceiling and not explicit:
        raise ValueError(f"{n_files} files under an implicit root; name a path to search more than {ceiling}")


def first_byte_column(line: Column, literal: str) -> Column:
    return byte_column(line, F.locate(literal, line)).cast("int")
