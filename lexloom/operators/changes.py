"""Snapshots, changesets, ledgers and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.shared import met, written


def changeset(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (added, removed, modified) between snapshots (path, mtime, size)."""
    a, b = before.alias("a"), after.alias("b")
    joined = a.join(b, "path", "full_outer")
    same = F.col("a.mtime").eqNullSafe(F.col("b.mtime")) & F.col("a.size").eqNullSafe(F.col("b.size"))
    change = F.when(F.col("a.size").isNull(), "added").when(F.col("b.size").isNull(), "removed").when(~same, "modified")
    return joined.select("path", change.alias("change")).filter("change is not null")


def refreshed(old: DataFrame, changes: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old that did not change, and the new ones."""
    return old.join(changes, key, "left_anti").unionByName(new)


def live_claims(events: DataFrame, now: Column) -> DataFrame:
    """The latest event of each claim, if it isn't a release and hasn't expired. events: claim_id, agent_id, kind, at, expires_at."""
    last = events.groupBy("claim_id").agg(F.max_by(F.struct("agent_id", "kind", "at", "expires_at"), F.struct("at", "kind")).alias("e"))
    return last.select("claim_id", "e.*").filter((F.col("kind") != "release") & (F.col("expires_at") > now))


#: A claim of no more symbols than this takes them along to each of them.
FEW_SYMBOLS = 64


def claim_overlaps(claims: DataFrame) -> DataFrame:
    """Pairs of claims of different agents with what both hold: a_id, b_id, n_shared, first_shared. Symbols are joined, so only pairs that share one meet. There are many more pairs than
    claims, so pairs are not moved: a claim takes all its symbols along, and a pair is told, and counted, where its least shared symbol is. Only pairs with a claim of very many symbols,
    or of several rows, are brought together.
    """
    symbols = F.array_sort(F.array_distinct(F.filter("symbols", lambda x: x.isNotNull())))
    claims = written(claims.filter("claim_id is not null and agent_id is not null").select("claim_id", "agent_id", symbols.alias("symbols")), "claims")
    several = written(claims.groupBy("claim_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("claim_id", F.lit(True).alias("_several")), "several")
    claims = claims.withColumn("_several", F.lit(False)) if several.isEmpty() else claims.join(several, "claim_id", "left")
    claims = claims.withColumn("apart", F.coalesce("_several", F.lit(False)) | (F.size("symbols") > FEW_SYMBOLS)).drop("_several")
    pairs, _ = _held_by_both(claims.filter("not apart").select("claim_id", "agent_id", "symbols", F.explode("symbols").alias("symbol")), "symbols")
    pairs = pairs.select("a_id", "b_id", "symbol", F.array_intersect("a_symbols", "b_symbols").alias("both")).filter(F.get("both", F.lit(0)) == F.col("symbol"))
    told = pairs.select("a_id", "b_id", F.size("both").cast("long").alias("n_shared"), F.col("symbol").alias("first_shared"))
    if claims.filter("apart").isEmpty():
        return told
    pairs, tasks = _held_by_both(claims.select("claim_id", "agent_id", "apart", F.explode("symbols").alias("symbol")), "apart")
    moved = pairs.filter("a_apart or b_apart").select("a_id", "b_id", "symbol").repartition(tasks, "a_id", "b_id")
    return told.union(moved.groupBy("a_id", "b_id").agg(F.count("*").alias("n_shared"), F.min("symbol").alias("first_shared")))


def _held_by_both(own: DataFrame, more: str) -> tuple[DataFrame, int]:
    """Pairs of rows (claim_id, agent_id, symbol, more) of a symbol, with the lesser claim's columns as a_ and the other's as b_, and a number of tasks for them."""
    a, b, keys, tasks = met(own, "symbol", "claim_id")
    a = a.select(*keys, F.col("claim_id").alias("a_id"), F.col("agent_id").alias("a_agent"), F.col(more).alias(f"a_{more}"))
    b = b.select(*keys, F.col("claim_id").alias("b_id"), F.col("agent_id").alias("b_agent"), F.col(more).alias(f"b_{more}"))
    return a.join(b, keys).filter((F.col("a_id") < F.col("b_id")) & (F.col("a_agent") != F.col("b_agent"))), tasks


def fresh_findings(findings: DataFrame, revisions: DataFrame) -> DataFrame:
    """Findings with whether their revision is still the current one. findings: finding_id, symbol, revision; revisions: symbol, revision."""
    now = revisions.select("symbol", F.col("revision").alias("_now"))
    return findings.join(now, "symbol", "left").select("finding_id", "symbol", F.col("revision").eqNullSafe(F.col("_now")).alias("fresh"))


def verified(rows: DataFrame, body: str, digest: str) -> DataFrame:
    """Rows whose digest is that of their body; any other raises."""
    ok = F.sha2(F.col(body), 256) == F.col(digest)
    return rows.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("digest mismatch: "), F.col(digest))).cast("boolean")))


def chain_breaks(entries: DataFrame) -> DataFrame:
    """Entries (chain, seq, digest, prev) whose prev isn't the digest before."""
    order = Window.partitionBy("chain").orderBy("seq")
    before = F.lag("digest").over(order)
    return entries.withColumn("_before", before).filter(~F.col("prev").eqNullSafe(F.col("_before"))).select("chain", "seq")


def json_diff(a: DataFrame, b: DataFrame, key: str = "id", column: str = "json") -> DataFrame:
    """Fields added, removed and changed between JSON objects with the same key, nested fields by path."""
    flat = lambda d: _flatten(d.select(key, F.col(column).alias("_json")), key)
    x, y = flat(a).alias("x"), flat(b).alias("y")
    joined = x.join(y, [key, "path"], "full_outer")
    change = F.when(F.col("x.value").isNull(), "added").when(F.col("y.value").isNull(), "removed").when(F.col("x.value") != F.col("y.value"), "changed")
    return joined.select(key, "path", change.alias("change"), F.col("x.value").alias("before"), F.col("y.value").alias("after")).filter("change is not null")


def _flatten(docs: DataFrame, key: str, depth: int = 6) -> DataFrame:
    """Leaves of JSON objects as (key, path, value), objects to a fixed depth; deeper ones and arrays are leaves."""
    level = docs.select(key, F.lit("").alias("path"), F.col("_json").alias("value"))
    out: DataFrame | None = None
    for _ in range(depth):
        fields = level.select(key, F.col("path").alias("_up"), F.explode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("f"))
        fields = fields.select(key, F.concat(F.when(F.col("_up") == "", "").otherwise(F.concat("_up", F.lit("."))), F.col("f.key")).alias("path"), F.coalesce("f.value", F.lit("null")).alias("value"))
        deeper = F.col("value").startswith("{")
        leaves = fields.filter(~deeper)
        out = leaves if out is None else out.unionByName(leaves)
        level = fields.filter(deeper)
    return out.unionByName(level)
