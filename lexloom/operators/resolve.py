"""Module resolution: which file an import means, as a join of candidate paths with the paths that exist.

Every language turns an import into an ordered list of paths that would satisfy it; the first that exists wins. All is
done with column expressions and one equi-join on the path, so it scales with the number of imports.

* Python: a leading dot for the package of the file and one more for each package above; else from the roots (the top,
  `src`, and every directory above the file, the shortest first). A module is `a/b.py` or `a/b/__init__.py`; a name that is
  imported from it may be a module of its own, which comes first.
* JavaScript and TypeScript: `./` and `../` from the file's directory, a path alias of the configuration (`prefix -> directory`), or
  the base directory; with each suffix, then as a directory with an index file.
* Rust: `crate::` from the crate's root, `self::` and `super::` from the module's directory; `a.rs` or `a/mod.rs`, and
  the parent of an item's path if the path itself is no file.
* Go: the module's path as a prefix gives a directory; its first file stands for the package.
* C and C++: from the file's directory, then from each include directory.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JS_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def joined(base: Column, rest: Column) -> Column:
    return F.when((base == "") | (rest == ""), F.concat(base, rest)).otherwise(F.concat(base, F.lit("/"), rest))


def normal(path: Column) -> Column:
    """Without `.` and `..`; null if it leaves the top."""
    step = lambda done, part: F.when(part.isin(".", ""), done).when(part == "..", F.when(F.size(done) == 0, F.array(F.lit("\0"))).otherwise(F.slice(done, 1, F.size(done) - 1))).otherwise(F.concat(done, F.array(part)))
    found = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(~found.contains("\0"), found)


def ancestors(directory: Column) -> Column:
    """All directories above and the directory itself, the shortest first; the top is ''."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _under(bases: Column, tails: Sequence[Column]) -> Column:
    return F.flatten(F.transform(bases, lambda b: F.array(*[joined(b, t) for t in tails])))


def python_paths(src: Column, module: Column, name: Column) -> Column:
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    path = F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/")
    home = F.filter(F.split(parent(src), "/"), lambda x: x != "")
    package = F.when(F.size(home) >= dots - 1, F.array_join(F.slice(home, 1, F.greatest(F.size(home) - dots + 1, F.lit(0))), "/"))
    bases = F.when(dots > 0, F.array(package)).otherwise(F.array_distinct(F.concat(F.array(F.lit(""), F.lit("src")), ancestors(parent(src)))))
    whole = joined(path, F.coalesce(name, F.lit("")))
    tails = [F.concat(whole, F.lit(".py")), joined(whole, F.lit("__init__.py")), F.concat(path, F.lit(".py")), joined(path, F.lit("__init__.py"))]
    return _under(bases, tails)


def js_paths(src: Column, module: Column, aliases: Mapping[str, str], base: str) -> Column:
    target = F.when(module.startswith("."), joined(parent(src), module))
    for prefix, directory in sorted(aliases.items(), key=lambda x: -len(x[0])):
        target = target.when(module.startswith(prefix), F.concat(F.lit(directory), F.substring(module, len(prefix) + 1, 1 << 20)))
    target = normal(target.otherwise(joined(F.lit(base), module)))
    return F.concat(F.array(target), F.array(*[F.concat(target, F.lit(x)) for x in JS_SUFFIXES]))


def rust_paths(src: Column, module: Column) -> Column:
    """The crate's root is the nearest `src` directory above; else the top."""
    root = F.regexp_extract(src, "^((?:.*/)?src)/", 1)
    file = F.element_at(F.split(src, "/"), -1)
    own = F.when(file.isin("mod.rs", "lib.rs", "main.rs"), parent(src)).otherwise(F.regexp_replace(src, r"\.rs$", ""))
    base = F.when(module.startswith("super::"), parent(own)).when(module.startswith("self::"), own).otherwise(root)
    path = F.regexp_replace(F.regexp_replace(module, "^(crate|self|super)::", ""), "::", "/")
    tails = [F.concat(path, F.lit(".rs")), joined(path, F.lit("mod.rs"))]
    above = parent(path)
    tails += [F.when(above != "", F.concat(above, F.lit(".rs"))), F.when(above != "", joined(above, F.lit("mod.rs")))]
    return F.array_compact(_under(F.array(base), tails))


def go_paths(module: Column, modules: Mapping[str, str]) -> Column:
    """Directories, each marked by a slash at its end."""
    found = F.lit(None).cast("string")
    for prefix, directory in sorted(modules.items(), key=lambda x: len(x[0])):
        rest = F.substring(module, len(prefix) + 2, 1 << 20)
        found = F.when((module == prefix) | module.startswith(f"{prefix}/"), F.concat(joined(F.lit(directory), rest), F.lit("/"))).otherwise(found)
    return F.array_compact(F.array(found))


def c_paths(src: Column, module: Column, includes: Sequence[str]) -> Column:
    return F.array_compact(F.array(normal(joined(parent(src), module)), *[normal(joined(F.lit(d), module)) for d in includes]))


def resolve(imports: DataFrame, files: DataFrame, aliases: Mapping[str, str] | None = None, base: str = "", go_modules: Mapping[str, str] | None = None, includes: Sequence[str] = ("", "include")) -> DataFrame:
    """(src, module, name, dst) for imports (src, language, module, name or null) that mean one of files (file). A file is never its own import."""
    src, module, name, language = (F.col(c) for c in ("src", "module", "name", "language"))
    js = js_paths(src, module, aliases or {}, base)
    paths = F.when(language == "python", python_paths(src, module, name)).when(language.isin("javascript", "typescript"), js)
    paths = paths.when(language == "rust", rust_paths(src, module)).when(language == "go", go_paths(module, go_modules or {})).when(language.isin("c", "cpp"), c_paths(src, module, includes))
    asked = imports.select("src", "language", "module", "name", F.posexplode(F.coalesce(paths, F.array().cast("array<string>"))).alias("_at", "_path")).filter("_path is not null")
    packages = files.filter(F.col("file").endswith(".go") & ~F.col("file").endswith("_test.go")).groupBy(F.concat(parent(F.col("file")), F.lit("/")).alias("_path")).agg(F.min("file").alias("dst"))
    known = files.select(F.col("file").alias("_path"), F.col("file").alias("dst")).unionByName(packages)
    first = Window.partitionBy("src", "language", "module", "name").orderBy("_at")
    # Candidates are many times the files and mostly mean none: they stream past the files of their task and are not sorted.
    found = asked.join(known.hint("shuffle_hash"), "_path").filter("dst <> src").withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
    return found.select("src", "module", "name", "dst")


def definitions(symbols: DataFrame, name: str) -> DataFrame:
    """Where a name is defined: rows of symbols (doc_id, kind, name, ...) that are no imports."""
    return symbols.filter((F.col("name") == name) & (F.col("kind") != "import"))


def references_with_context(lines: DataFrame, name: str, around: int = 2) -> DataFrame:
    """Lines that mention a name as a whole word, each with the lines around it. lines: doc_id, line_no, line."""
    import re

    hit = lines.filter(F.col("line").rlike(rf"\b{re.escape(name)}\b")).select("doc_id", F.col("line_no").alias("hit_line"), F.explode(F.sequence(F.col("line_no") - around, F.col("line_no") + around)).alias("line_no"))
    near = hit.join(lines.select("doc_id", "line_no", "line"), ["doc_id", "line_no"])
    packed = near.groupBy("doc_id", "hit_line").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("c"))
    return packed.select("doc_id", F.col("hit_line").alias("line_no"), F.array_join(F.transform("c", lambda x: x["line"]), "\n").alias("context"))
