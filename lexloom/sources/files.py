"""Files as rows: scans, ignore rules, encodings, binary detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.search import glob_regex, refuse_broad

# Names of directories with generated files.
GENERATED_DIRS = ("__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "build", "coverage", "dist", "node_modules", "target", "venv")
BINARY_PREFIX = 65536


def scan(spark: SparkSession, root: str, glob: str | None = None, budget: int | None = None) -> DataFrame:
    """path, name, modificationTime, length and content of all files under a root; content is read only where it is used. Read errors raise."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(root).withColumn("name", F.element_at(F.split("path", "/"), -1))
    if budget is None:
        return found
    # One row beyond the budget tells whether files were left out; each row says so.
    kept = found.select("path").orderBy("path").limit(budget + 1)
    more = kept.agg((F.count("*") > budget).alias("result_incomplete"))
    first = kept.orderBy("path").limit(budget)
    reason = F.when(F.col("result_incomplete"), F.lit(f"scan stopped at {budget} files"))
    return found.join(F.broadcast(first) if budget <= 500_000 else first, "path", "left_semi").crossJoin(F.broadcast(more)).withColumn("incomplete_reason", reason)  # one row


def scan_guarded(spark: SparkSession, root: str, explicit: bool = False, ceiling: int = 1500, **how) -> DataFrame:
    """A scan that refuses an implicit root with too many files before anything is read."""
    found = scan(spark, root, **how)
    refuse_broad(found.select("path").limit(ceiling + 1).count(), ceiling, explicit)
    return found


class TypeTable:
    """File types by name as globs, and the changes a caller makes: add, clear, list."""

    # Names of types and their globs, as search tools have them.
    BASE = {
        "c": ("*.c", "*.h"), "cpp": ("*.cc", "*.cpp", "*.cxx", "*.hh", "*.hpp", "*.hxx"), "csharp": ("*.cs",), "css": ("*.css", "*.scss"), "go": ("*.go",), "html": ("*.htm", "*.html"), "java": ("*.java",),
        "js": ("*.cjs", "*.js", "*.jsx", "*.mjs"), "json": ("*.json",), "log": ("*.log",), "md": ("*.markdown", "*.md"), "php": ("*.php",), "py": ("*.py", "*.pyi"), "rust": ("*.rs",), "sh": ("*.bash", "*.sh"),
        "sql": ("*.sql",), "toml": ("*.toml",), "ts": ("*.cts", "*.mts", "*.ts", "*.tsx"), "txt": ("*.txt",), "xml": ("*.xml",), "yaml": ("*.yaml", "*.yml"),
    }

    def __init__(self, add: Sequence[str] = (), clear: Sequence[str] = ()):
        """add: `name:glob`, or `name:include:other,other`; clear: names whose globs go first."""
        self.globs = {k: v for k, v in self.BASE.items() if k not in clear}
        for entry in add:
            name, _, glob = entry.partition(":")
            if not name or not glob:
                raise ValueError(f"a type is added as name:glob, not {entry}")
            if glob.startswith("include:"):
                new = [g for other in glob[8:].split(",") for g in self._of(other)]
            else:
                new = [glob]
            self.globs[name] = tuple(dict.fromkeys((*self.globs.get(name, ()), *new)))

    def _of(self, name: str) -> tuple[str, ...]:
        if name not in self.globs:
            raise ValueError(f"no type named {name}")
        return self.globs[name]

    def listed(self) -> list[str]:
        return [f"{name}: {', '.join(sorted(globs))}" for name, globs in sorted(self.globs.items())]

    def has(self, path: Column, *names: str) -> Column:
        """Whether a path's name is of one of these types."""
        name = F.element_at(F.split(path, "/"), -1)
        found = F.lit(False)
        for glob in dict.fromkeys(g for n in names for g in self._of(n)):
            found = found | name.rlike(glob_regex(glob))
        return found


def ordered(files: DataFrame, by: str, reverse: bool = False) -> DataFrame:
    """Scanned files by path, modified or size. Spark doesn't know when files were accessed or created, so these are refused."""
    columns = {"path": "path", "modified": "modificationTime", "size": "length"}
    if by not in columns:
        raise ValueError(f"files can be sorted by {', '.join(columns)}, not by {by}")
    key = F.col(columns[by])
    return files.orderBy(key.desc() if reverse else key.asc(), "path")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and line of text files, compressed ones by suffix; \\n alone ends a line, so \\r stays."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def documents(files: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """Scanned files as documents; text that isn't valid in UTF-8 keeps its bytes in base64."""
    content = F.col("content")
    text = F.decode(content, encoding) if encoding.upper() != "UTF-8" else F.try_validate_utf8(content.cast("string"))
    return files.filter(~is_binary(content)).select("path", text.alias("text"), F.when(text.isNull(), F.base64(content)).alias("raw_base64"), "length")


def is_binary(content: Column, prefix: int = BINARY_PREFIX) -> Column:
    """A NUL byte in the prefix."""
    return F.coalesce(F.position(F.lit(b"\0"), F.substring(content, 1, prefix)) > 0, F.lit(False))


def outside_dirs(path: Column, names: Sequence[str] = GENERATED_DIRS) -> Column:
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


#: Files with ignore rules; in one directory the later family wins.
IGNORE_FILES = (".gitignore", ".ignore", ".rgignore")


def ignore_rules(spark: SparkSession, root: str, families: Sequence[str] = IGNORE_FILES, max_depth: int = 64) -> list[tuple[str, str, bool]]:
    """The rules of all ignore files under a root, for `ignored`.

    Spark's readers pass over names that begin with a dot, so these few files are found level by level and read by the driver, through Hadoop's file system.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base, found = root.rstrip("/"), []
    for depth in range(max_depth + 1):
        level = f"{base}{'/*' * depth}"
        names = jvm.org.apache.hadoop.fs.Path(f"{level}/{{{','.join(families)}}}")
        system = names.getFileSystem(conf)
        for status in system.globStatus(names) or ():
            stream = system.open(status.getPath())
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            parts = status.getPath().toString().split("/")
            found.append((families.index(parts[-1]), "/".join(parts[len(parts) - 1 - depth : -1]), text))
        if not any(x.isDirectory() for x in system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{level}/*")) or ()):
            break
    rules = []
    for _, directory, text in sorted(found):
        for line in text.splitlines():
            body = line.rstrip()
            if not body or body.startswith("#"):
                continue
            negated = body.startswith("!")
            body = body[1:] if negated or body.startswith(("\\#", "\\!")) else body
            rules.append((directory, body, negated))
    return rules


def ignored(paths: DataFrame, rules: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """path and ignored, by rules (directory of the ignore file, pattern, negated) in file order: the deepest opinion wins, then the last.

    Rules are few and become expressions; nothing is joined.
    """
    path = F.col("path")
    opinions = []
    for number, (directory, pattern, negated) in enumerate(rules):
        base = f"{directory}/" if directory else ""
        body = pattern.rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/")
        relative = F.substring(path, len(base) + 1, 1 << 20)
        piece = glob_regex(body).removeprefix("(?s:").rstrip("$").removesuffix(")").replace(".*", "[^/]*")
        tail = "/.*" if pattern.endswith("/") else "(/.*)?"
        hit = path.startswith(base) & relative.rlike(f"^{'' if anchored else '(.*/)?'}(?:{piece}){tail}$")
        depth = directory.count("/") + 1 if directory else 0
        opinions.append(F.when(hit, F.struct(F.lit(depth).alias("depth"), F.lit(number).alias("number"), F.lit(not negated).alias("ignored"))))
    last = F.array_max(F.array_compact(F.array(*opinions)))
    return paths.select("path", F.coalesce(last["ignored"], F.lit(False)).alias("ignored"))
