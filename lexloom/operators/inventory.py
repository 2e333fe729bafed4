"""Inventories of a corpus, coverage of files by documents and the inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages and categories by suffix.
LANGUAGE_BY_SUFFIX = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "java": "java", "php": "php",
    "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby", "sh": "shell", "md": "markdown", "rst": "restructuredtext",
    "html": "html", "css": "css", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "sql": "sql", "txt": "text",
}
CODE_SUFFIXES = ("py", "js", "jsx", "ts", "tsx", "rs", "go", "java", "php", "cs", "c", "h", "cpp", "cc", "hpp", "rb", "sh", "sql", "css")
DOC_SUFFIXES = ("md", "rst", "txt", "html", "adoc")
CONFIG_SUFFIXES = ("json", "toml", "yaml", "yml", "cfg", "ini")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\.([^.]+)$", 1))


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_SUFFIX.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix(path)), F.lit("other"))


def is_test(path: Column) -> Column:
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    return name.rlike(r"^test[_.]|\.(test|spec)\.|_test(\.[^.]*)?$") | low.rlike(r"(^|/)(tests?|__tests__)/")


def category_of(path: Column) -> Column:
    """Exclusive; a test's role outranks its suffix."""
    s = suffix(path)
    return F.when(is_test(path), "test").when(s.isin(*CODE_SUFFIXES), "code").when(s.isin(*DOC_SUFFIXES), "doc").when(s.isin(*CONFIG_SUFFIXES), "config").otherwise("other")


def inventory(files: DataFrame, dims: list[str]) -> DataFrame:
    """Counts and bytes by each dimension and in total, in one aggregation over grouping sets: dimension, value, n, bytes. files: dims and size."""
    sets = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims] + [F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value"))]
    return files.select("size", F.explode(F.array(*sets)).alias("k")).groupBy("k.dimension", "k.value").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def largest(files: DataFrame, name: str, k: int = 10) -> DataFrame:
    return files.select(name, "size").orderBy(F.desc("size"), name).limit(k)


def mentions(docs: DataFrame, pattern: str) -> DataFrame:
    """Distinct tokens of documents that look like file names. A token is extracted once, so coverage is an equi join and not a scan of documents for each file."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("mention")).distinct()


def coverage(files: DataFrame, mentioned: DataFrame, key: str) -> DataFrame:
    """Each file and whether a document mentions it."""
    return files.join(mentioned.select(F.col("mention").alias(key), F.lit(True).alias("_m")), key, "left").select(*files.columns, F.coalesce("_m", F.lit(False)).alias("covered"))


def stale_references(mentioned: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Mentions of what isn't there."""
    return mentioned.join(files.select(F.col(key).alias("mention")).distinct(), "mention", "left_anti")
