"""Vendored subtrees at any depth of a tree of files: what a ranking should weigh less."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.shared import checkpointed

# Names that tell a vendored tree alone, names of tools' own folders, names that count beside a manifest, manifests of packages and of skills.
VENDOR_NAMES = ("third_party", "_vendored")
TOOL_NAMES = (".claude",)
NAME_PRIOR = ("vendor", "third_party", "skills", "external_repos", "_vendored", "node_modules")
MANIFESTS = (".git", "Cargo.toml", "build.gradle", "composer.json", "deno.json", "go.mod", "package.json", "pom.xml", "pyproject.toml", "settings.gradle")
SKILL_MANIFEST, SKILL_NAME, SKILL_SHARE = "skill.md", "skills", 0.6


def folders(path: Column) -> Column:
    """All folders above a file, from the outermost on; none for a file at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def signals(files: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each folder: files below it, its manifest, whether it has an __init__.py, imports into it from outside and within it, and of its child folders how many there are, how many hold a skill and how many are packages.

    files: path; edges: src, dst. Each file tells its folders, each import the folders of one of its ends only; all are summed per task before they are moved.
    """
    own = files.select(F.explode(folders(F.col("path"))).alias("dir"), "path", F.size(folders(F.col("path"))).alias("_n"))
    at = F.size(F.split("dir", "/")) == F.col("_n")  # the file lies in the folder itself
    name = _name(F.col("path"))
    per = own.groupBy("dir").agg(
        F.count("*").alias("files"), F.min(F.when(at & name.isin(*MANIFESTS), name)).alias("manifest"), F.max(at & (name == "__init__.py")).alias("package"), F.max(at & (F.lower(name) == SKILL_MANIFEST)).alias("skill")
    )
    a, b = folders(F.col("src")), folders(F.col("dst"))
    ends = edges.filter("src <> dst")
    into = ends.select(F.explode(F.array_except(b, a)).alias("dir")).groupBy("dir").agg(F.count("*").alias("imported"))
    within = ends.select(F.explode(F.array_intersect(b, a)).alias("dir")).groupBy("dir").agg(F.count("*").alias("internal"))
    children = per.filter(F.col("dir").contains("/")).select(F.regexp_replace("dir", "/[^/]*$", "").alias("dir"), "skill", "package")
    children = children.groupBy("dir").agg(F.count("*").alias("children"), F.count_if("skill").alias("skills"), F.count_if("package").alias("packages"))
    found = per.drop("skill").join(into, "dir", "left").join(within, "dir", "left").join(children, "dir", "left")
    return found.fillna(0, ["imported", "internal", "children", "skills", "packages"])


def vendored_subtrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(dir, files, reasons) of the outermost vendored folders, each once.

    A folder is one by its name; by the shape of a collection of skills, which nothing outside imports; or with a manifest of its own where it is an island (files that import one another, and none from outside) or
    has a telling name on its path. A folder below another with any of these signs is not looked at.
    """
    s = signals(files, edges)
    base, parts = F.lower(_name(F.col("dir"))), F.split(F.lower("dir"), "/")
    named = F.array_sort(F.array_intersect(parts, F.array(*[F.lit(x) for x in NAME_PRIOR])))
    skills = (base == SKILL_NAME) & (F.col("imported") == 0) & ~F.col("package") & (F.col("children") > 0) & (F.col("packages") == 0) & (F.col("skills") >= F.lit(SKILL_SHARE) * F.col("children"))
    s = s.select("dir", "files", "manifest", ((F.col("imported") == 0) & (F.col("internal") > 0)).alias("island"), named.alias("named"), base.isin(*TOOL_NAMES).alias("tool"), base.isin(*VENDOR_NAMES).alias("vendor"), skills.alias("skills"))
    # Few folders, met twice.
    signed = checkpointed(s.filter(F.col("manifest").isNotNull() | F.col("tool") | F.col("vendor") | F.col("skills")))
    # What lies below another folder of these: a folder tells those above it, and they are met by name.
    above = signed.select("dir", F.explode(folders(F.col("dir"))).alias("_up")).join(signed.select(F.col("dir").alias("_up")), "_up", "left_semi").select("dir").distinct()
    outer = signed.join(above, "dir", "left_anti")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("manifest").isNotNull(), F.concat(F.lit("manifest:"), "manifest")), F.when(F.col("island"), F.lit("island")), F.when(F.size("named") > 0, F.concat(F.lit("name:"), F.element_at("named", 1))),
            F.when(F.col("tool"), F.lit("tool-config")), F.when(F.col("vendor"), F.lit("vendor-name")), F.when(F.col("skills"), F.lit("skills")),
        )
    )
    return outer.filter(F.col("island") | (F.size("named") > 0) | F.col("tool") | F.col("vendor") | F.col("skills")).select("dir", "files", reasons.alias("reasons"))
