"""Ranked retrieval: BM25, vectors, fusion, late interaction, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import split_terms
from lexloom.operators import nearest
from lexloom.operators.shared import running

K1, B = 1.5, 0.75


def terms_of(query: str) -> list[str]:
    import re

    spaced = re.sub("([a-z0-9])([A-Z])", r"\1 \2", query).replace("_", " ").replace("-", " ")
    return [t.lower() for t in re.findall("[A-Za-z0-9]+", spaced)]


def _is(word: str):
    """A function of one argument: Spark passes an index to lambdas of two."""
    return lambda t: t == F.lit(word)


def _dot_with(vector: Column):
    return lambda t: F.aggregate(F.zip_with(t, vector, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def bm25(chunks: DataFrame, query: str, id_cols: Sequence[str], text: str = "text") -> DataFrame:
    """id columns and score of chunks that have a query term. Term counts are taken in the row; only statistics of the query's few terms are joined.

    score = sum over distinct query terms of ln(1 + (n - df + .5) / (df + .5)) * tf * 2.5 / (tf + 1.5 * (.25 + .75 * length / mean length)).
    """
    words = list(dict.fromkeys(terms_of(query)))
    # Terms are split once: what a lambda binds isn't computed again, and nothing is merged through an explode.
    found = F.transform(F.array(split_terms(F.col(text))), lambda t: F.struct(F.size(t).alias("len"), F.filter(t, lambda x: x.isin(*words)).alias("hits")))
    own = chunks.select(*id_cols, F.explode(found).alias("_t")).select(*id_cols, F.col("_t.len").alias("_len"), F.col("_t.hits").alias("_hits"))
    own = own.select(*id_cols, "_len", F.array(*[F.size(F.filter("_hits", _is(w))) for w in words]).alias("_tf"))
    stats = own.agg(
        F.count("*").alias("_n"), F.avg("_len").alias("_avg"), F.array(*[F.count_if(F.col("_tf")[i] > 0) for i in range(len(words))]).alias("_df")
    )
    own = own.filter(F.exists("_tf", lambda n: n > 0)).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col("_tf")[i].cast("double"), F.col("_df")[i].cast("double")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))).otherwise(0.0)
    return own.select(*id_cols, F.round(score, 6).alias("score")).filter("score > 0")


def top(ranked: DataFrame, k: int, ids: Sequence[str], score: str = "score") -> DataFrame:
    """The k best, ties by id: a distributed top-k."""
    return ranked.orderBy(F.desc(score), *ids).limit(k)


#: Lines of a bin of the interval join.
BIN = 32


def inside(points: DataFrame, intervals: DataFrame, key: str, point: str, start: str, end: str, width: int = BIN) -> DataFrame:
    """points with each interval of their key that holds them: the columns of points, and those of intervals besides the key.

    An interval is told to the bins that it covers and a point to its own, so the join is one of equal keys (key and bin) and a long document spreads over its bins; no point meets
    an interval of another bin. Null points are in no interval.
    """
    named = points.select("*", F.floor(F.col(point) / width).alias("_bin"))
    covered = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    spread = intervals.filter(F.col(start) <= F.col(end)).select("*", F.explode(covered).alias("_bin"))
    return named.join(spread, [key, "_bin"]).filter(F.col(point).between(F.col(start), F.col(end))).drop("_bin")


def rerank_lines(matches: DataFrame, scored: DataFrame) -> DataFrame:
    """Matching lines with the best score of the chunks that contain them, 0 if none. scored: doc_id, start_line, end_line, score."""
    own = matches.select("doc_id", "line_no")
    best = inside(own, scored.select("doc_id", "start_line", "end_line", "score"), "doc_id", "line_no", "start_line", "end_line").groupBy("doc_id", "line_no").agg(F.max("score").alias("score"))
    return own.distinct().join(best, ["doc_id", "line_no"], "left").select("doc_id", "line_no", F.coalesce("score", F.lit(0.0)).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in doubles; a vector of length zero counts as one of length 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    unit = lambda x: F.when(norm(x) == 0, 1.0).otherwise(norm(x))
    return dot(a, b) / (unit(a) * unit(b))


def dense(vectors: DataFrame, query: Sequence[float], id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and cosine score to one query vector, a literal in the plan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(cosine(F.col(column), q), 6).alias("score"))


#: Rows of a block of vectors and of one of queries.
VECTORS, QUERIES = 1 << 17, 1 << 15


def dense_many(vectors: DataFrame, queries: DataFrame, k: int, block: int = 128) -> DataFrame:
    """The k nearest of every query (query_id, embedding): blocks of vectors meet blocks of queries, `block` queries at a time, each gives its k best, and those are ranked."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n, asked = vectors.count(), queries.count()
    v_blocks = max(1, -(-n // VECTORS), min(cores, -(-n // (VECTORS >> 6))))
    q_blocks = max(1, -(-asked // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    none = F.lit(-(1 << 63) + 1).cast("long")  # null ids come first
    left = vectors.select(F.coalesce(F.col("vec_id").cast("long"), none).alias("vec_id"), "embedding", dealt("vec_id", v_blocks).alias("_v"), every(q_blocks).alias("_q"))
    right = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding", dealt("query_id", q_blocks).alias("_q"), every(v_blocks).alias("_v"))
    hits = left.groupBy("_v", "_q").cogroup(right.groupBy("_v", "_q")).applyInArrow(nearest.matched(k, block), "query_id long, vec_id long, score double")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select(F.nullif("vec_id", none).alias("vec_id"), "query_id", "score", "rank")


def fuse(legs: Sequence[DataFrame], ids: Sequence[str], k: int = 60, weights: Sequence[float] | None = None, combine: str = "max", depth: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of legs (ids, score): weight / (k + rank), combined by max or sum.

    depth: how far down a leg ranks matter. Without it all rows of a leg are ranked, over all tasks.
    """
    out: DataFrame | None = None
    for leg, weight in zip(legs, weights or [1.0] * len(legs), strict=True):
        order = [F.desc("score"), *ids]
        if depth:
            own, rank = top(leg, depth, ids), F.row_number().over(Window.orderBy(*order))  # a top-k
        else:
            own, rank = running(leg, order, F.lit(1), "_rank"), F.col("_rank")
        own = own.select(*ids, (F.lit(float(weight)) / (k + rank)).alias("part"))
        out = own if out is None else out.unionByName(own)
    combined = F.max("part") if combine == "max" else F.sum("part")
    return out.groupBy(*ids).agg(F.round(combined, 8).alias("score"))


def path_channel(paths: DataFrame, query: str, id_col: str, path: str = "path") -> DataFrame:
    """How many distinct query terms the path's stem has."""
    words = F.array(*[F.lit(w) for w in dict.fromkeys(terms_of(query))])
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    hits = F.size(F.array_intersect(words, split_terms(name)))
    return paths.select(id_col, hits.cast("double").alias("score")).filter("score > 0")


def max_sim(head: DataFrame, query_tokens: Sequence[Sequence[float]], id_col: str, column: str = "tokens") -> DataFrame:
    """Late interaction over the head of a ranking: for each query token the best token of the text, summed. column: array of vectors."""
    total = F.lit(0.0)
    for q in query_tokens:
        vector = F.array(*[F.lit(float(x)) for x in q])
        total = total + F.array_max(F.transform(column, _dot_with(vector)))
    return head.select(id_col, F.round(total, 6).alias("score"))


def metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: recall, precision, reciprocal rank and nDCG at k. ranked: query_id, item, rank; relevant: query_id, item. Queries come from ranked; without relevant items recall and nDCG are 1."""
    hits = ranked.filter(F.col("rank") <= k).join(relevant.withColumn("_rel", F.lit(1)), ["query_id", "item"], "left")
    return _measures(hits, relevant.groupBy("query_id").agg(F.count("*").alias("wanted")), k)


def metrics_by_label(ranked: DataFrame, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """`metrics` where the items of a query's label are relevant to it: they are counted by label, and only ranked ones meet their queries. queries: query_id, label; items: item, label."""
    own = ranked.filter(F.col("rank") <= k).join(items.select("item", F.col("label").alias("_has")), "item", "left").join(queries.select("query_id", F.col("label").alias("_asks")), "query_id")
    hits = own.withColumn("_rel", F.when(F.col("_has") == F.col("_asks"), 1))
    return _measures(hits, queries.join(items.groupBy("label").agg(F.count("*").alias("wanted")), "label").select("query_id", "wanted"), k)


def _measures(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """hits: query_id, rank, _rel (1 or null); wanted: query_id, wanted."""
    gain = F.when(F.col("_rel") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = hits.groupBy("query_id").agg(F.count("_rel").alias("hits"), F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    joined = per.join(wanted, "query_id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("wanted", F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    recall = F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("hits") / F.col("wanted"))
    precision = F.col("hits") / F.lit(k)
    return joined.select(
        "query_id",
        F.round(recall, 6).alias("recall"),
        F.round(precision, 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("dcg") / ideal), 6).alias("ndcg"),
        F.round(F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0), 6).alias("f1"),
    )
