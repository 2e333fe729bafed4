"""Quality rules: plain statistics of a text, base limits on them, and robust multivariate outliers.

Everything is DataFrame functions. For each language and source, each language, and all rows, a minimum covariance
determinant estimate is found by concentration steps: from a first estimate, keep the three quarters of rows that lie
nearest, take their mean and covariance, and repeat. Of two starts (medians and
interquartile ranges; the moments of all rows) the one with the least determinant after two steps goes on until its determinant stays. An estimate is put together with that of the
next larger group, which weighs as 60 rows, so that groups of any size are judged alike. A row is rejected if the Mahalanobis
distance of its transformed statistics is beyond a chi-square quantile.

Defined results: a null text has no words and fails the base limits. Null languages and sources are groups of
their own, apart from empty ones. Repeated rows are judged alike. Estimates use rows that pass the base limits. Extra columns stay in `keep_good`.
No rows in, no rows out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import save

SPACE_SQL = "' \\t\\n\\u000B\\u000C\\r'"
SPLIT = "[\\\\x20\\\\x09-\\\\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("_x0", "_x1", "_x2", "_x3", "_x4")
#: Least standard deviation of each feature: differences below it are never unusual, and it keeps covariances regular.
LEAST_SD = (0.35, 0.08, 0.1, 0.15, 0.15)
KEEP = 0.75
#: Steps from every start, after which only the one with the least determinant goes on.
FIRST_STEPS = 2
#: Steps in all, and the change of the logarithm of a determinant at which an estimate has settled.
STEPS = 30
SETTLED = 1e-3
#: Rows that the estimate of the larger group counts as, in that of a smaller one.
PRIOR = 60.0


def chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma by its series."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    i = 0
    while term > 1e-16 * total:
        i += 1
        term *= h / (a + i)
        total += term
    return total * math.exp(-h + a * math.log(h) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def with_stats(docs: DataFrame) -> DataFrame:
    """docs with the five statistics. Windows of eight words are compared by hashes chained from word hashes, each made once."""
    d = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    d = d.withColumn("_words", F.expr(f"split(trim(BOTH {SPACE_SQL} FROM _text), '{SPLIT}')"))
    d = d.withColumn("_words", F.expr("if(size(_words) = 1 and _words[0] = '', slice(_words, 1, 0), _words)"))
    d = d.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.expr("length(array_join(_words, ''))").cast("long"))
    d = d.withColumn("n_symbols", F.expr("length(regexp_replace(_text, '[^#*$%&|<>]+', ''))").cast("long"))
    d = d.withColumn("_lines", F.expr(f"filter(split(_text, '\\n'), x -> trim(BOTH {SPACE_SQL} FROM x) != '')"))
    d = d.withColumn("n_dup_lines", F.expr("size(_lines) - size(array_distinct(_lines))").cast("long"))
    d = d.withColumn("_h1", F.expr("if(size(_words) < 9, array(), transform(_words, x -> xxhash64(x)))"))
    d = d.withColumn("_h2", F.expr("zip_with(_h1, slice(_h1, 2, greatest(size(_h1), 1)), (a, b) -> xxhash64(a, b))"))
    d = d.withColumn("_h4", F.expr("zip_with(_h2, slice(_h2, 3, greatest(size(_h2), 1)), (a, b) -> xxhash64(a, b))"))
    d = d.withColumn("_h8", F.expr("zip_with(_h4, slice(_h4, 5, greatest(size(_h4), 1)), (a, b) -> xxhash64(a, b))"))
    d = d.withColumn("_h8", F.expr("slice(_h8, 1, greatest(size(_h8) - 7, 0))"))
    d = d.withColumn("_sorted", F.expr("if(size(array_distinct(_h8)) = size(_h8), null, array_sort(transform(_h8, (h, i) -> struct(h as h, i as i))))"))
    d = d.withColumn("_at", F.expr("transform(filter(transform(_sorted, (s, j) -> struct(s.i as i, s.h = get(_sorted, j - 1).h or s.h = get(_sorted, j + 1).h as twice)), x -> x.twice), x -> x.i)"))
    d = d.withColumn("_at", F.expr("array_sort(_at)"))
    d = d.withColumn("_cover", F.expr("zip_with(_at, slice(_at, 2, size(_at)), (a, b) -> least(8, coalesce(b - a, 8)))"))
    d = d.withColumn("n_repeat_words", F.expr("coalesce(aggregate(_cover, 0L, (s, x) -> s + x), 0L)"))
    return d.drop("_text", "_words", "_lines", "_h1", "_h2", "_h4", "_h8", "_sorted", "_at", "_cover")


def with_features(d: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    d = d.withColumn("_x0", F.log(n)).withColumn("_x1", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n))
    return (
        d.withColumn("_x2", F.sqrt(F.col("n_symbols") / n))
        .withColumn("_x3", F.sqrt(F.col("n_dup_lines") / (F.col("n_dup_lines") + F.lit(5.0) + n / 50)))
        .withColumn("_x4", F.sqrt(F.col("n_repeat_words") / n))
    )


#: Groups whose estimates are broadcast (about 250 bytes each); of more, each is copied to several tasks.
BROADCAST_GROUPS = 40_000
SALTS = 16


def _beside(rows: DataFrame, found: DataFrame, few: bool, how: str = "inner", on: tuple[str, ...] = ("_group",)) -> DataFrame:
    """rows with what their group has in the small table found. Rows of a group are not brought together: a group may be most of a corpus."""
    if few:
        return rows.join(F.broadcast(found), list(on), how)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int"))
    copies = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def _keys() -> list:
    """Names of a row's groups: all rows, its language, its language and source. Lengths keep names apart, whatever they hold."""
    part = lambda x: F.when(F.col(x).isNull(), "-").otherwise(F.concat(F.length(x).cast("string"), F.lit(":"), F.col(x)))
    return [F.lit("0"), F.concat(F.lit("1"), part("_lang")), F.concat(F.lit("2"), part("_lang"), part("_source"))]


def _members(rows: DataFrame) -> DataFrame:
    """Rows that pass the base limits, once for each of their groups."""
    return rows.filter("not base_failed").select(F.explode(F.array(*_keys())).alias("_group"), *FEATURES)


def _with_distance(rows: DataFrame) -> DataFrame:
    """Forward substitution, one column at a time so that no expression repeats another."""
    for i, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(f"_m{i}")
        for j in range(i):
            rest = rest - F.col(f"_l{i}{j}") * F.col(f"_z{j}")
        rows = rows.withColumn(f"_z{i}", rest / F.col(f"_l{i}{i}"))
    total = F.lit(0.0)
    for i in range(len(FEATURES)):
        total = total + F.col(f"_z{i}") * F.col(f"_z{i}")
    return rows.withColumn("_d2", total).drop(*[f"_z{i}" for i in range(len(FEATURES))])


def _cholesky(found: DataFrame) -> DataFrame:
    """Columns _lij of the Cholesky factor from _vij, after the floor on each deviation."""
    p = len(FEATURES)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"_v{i}{j}") + (F.lit(LEAST_SD[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            found = found.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(rest, F.lit(LEAST_SD[i] ** 2 / 4))) if i == j else rest / F.col(f"_l{j}{j}"))
    return found.drop(*[f"_v{i}{j}" for i in range(p) for j in range(i + 1)])


TRIANGLE = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
MEANS = [f"_m{i}" for i in range(len(FEATURES))]
COVARIANCES = [f"_v{i}{j}" for i, j in TRIANGLE]


def _with_factor(found: DataFrame) -> DataFrame:
    """found with the Cholesky factor of its covariances and the logarithm of their determinant."""
    for x in COVARIANCES:
        found = found.withColumn(f"_kept{x}", F.col(x))
    factors = _cholesky(found)
    det = F.lit(0.0)
    for i in range(len(FEATURES)):
        det = det + F.log(f"_l{i}{i}")
    return factors.withColumn("_det", 2 * det).withColumnsRenamed({f"_kept{x}": x for x in COVARIANCES})


def _moments() -> list:
    return [F.avg(x).alias(m) for x, m in zip(FEATURES, MEANS, strict=True)] + [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"_v{i}{j}") for i, j in TRIANGLE]


def _starts(members: DataFrame) -> DataFrame:
    """Two first estimates for each group: medians and interquartile ranges, and the moments of all rows."""
    quarters = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"_q{i}") for i, x in enumerate(FEATURES)]
    found = members.groupBy("_group").agg(F.count("*").alias("_n"), *quarters, *_moments())
    spread = {(i, j): F.pow((F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]) / 1.349, F.lit(2)) if i == j else F.lit(0.0) for i, j in TRIANGLE}
    robust = [F.col(f"_q{i}")[1].alias(m) for i, m in enumerate(MEANS)] + [spread[i, j].alias(f"_v{i}{j}") for i, j in TRIANGLE]
    return found.select("_group", F.lit(0).alias("_start"), "_n", *robust).unionByName(found.select("_group", F.lit(1).alias("_start"), "_n", *MEANS, *COVARIANCES))


def mcd(members: DataFrame) -> DataFrame:
    """A row for each group: the means and covariances of the part of its rows with the least determinant, found by
    concentration steps from each start, then from the best of them until the determinant stays; sums are taken before anything is shuffled.
    """
    spark, p = members.sparkSession, len(FEATURES)
    # The covariance of the nearest part of a normal sample is too small by this factor.
    factor = KEEP / chi2_cdf(chi2_quantile(KEEP, p), p + 2)
    open_ = save(spark, _with_factor(_starts(members)), "mcd")
    few = open_.count() <= 2 * BROADCAST_GROUPS
    settled = []
    for step in range(STEPS):
        near = _with_distance(_beside(members, open_.select("_group", "_start", F.col("_det").alias("_before"), *MEANS, *[f"_l{i}{j}" for i, j in TRIANGLE]), few))
        near = near.select("_group", "_start", "_before", "_d2", *FEATURES)
        limit = near.groupBy("_group", "_start").agg(F.percentile_approx("_d2", F.lit(KEEP), 2000).alias("_limit"))
        near = _beside(near, limit, few, on=("_group", "_start")).filter("_d2 <= _limit")
        found = near.groupBy("_group", "_start").agg(F.count("*").alias("_n"), F.max("_before").alias("_before"), *_moments())
        found = found.select("_group", "_start", "_n", "_before", *MEANS, *[(F.lit(factor) * F.col(x)).alias(x) for x in COVARIANCES])
        found = save(spark, _with_factor(found), "mcd")
        if step + 1 < FIRST_STEPS:
            open_ = found
            continue
        if step + 1 == FIRST_STEPS:
            best = found.groupBy("_group").agg(F.min(F.struct(F.round("_det", 7), "_start")).alias("x")).select("_group", "x._start")
            found = save(spark, found.join(best, ["_group", "_start"]), "mcd")
        stays = (F.abs(F.col("_det") - F.col("_before")) <= SETTLED) | F.lit(step + 1 == STEPS)
        settled.append(found.filter(stays))
        open_ = found.filter(~stays)
        if open_.isEmpty():
            break
    every = settled[0]
    for x in settled[1:]:
        every = every.unionByName(x)
    return every.select("_group", "_n", *MEANS, *COVARIANCES)


def _pooled(own: DataFrame, parent: DataFrame) -> DataFrame:
    """own's estimates (if any) put together with the parent's, which counts as PRIOR rows. Both have _group and _up's group."""
    renamed = parent.select(F.col("_group").alias("_up"), *[F.col(x).alias(f"_p{x}") for x in (*MEANS, *COVARIANCES)])
    both = own.join(renamed, "_up")
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("double")
    mine = lambda x: F.coalesce(F.col(x), F.col(f"_p{x}"))
    means = [((n * mine(x) + PRIOR * F.col(f"_p{x}")) / (n + PRIOR)).alias(x) for x in MEANS]
    gap = lambda i: mine(f"_m{i}") - F.col(f"_p_m{i}")
    spread = [((n * mine(f"_v{i}{j}") + PRIOR * F.col(f"_p_v{i}{j}")) / (n + PRIOR) + n * PRIOR / (n + PRIOR) / (n + PRIOR) * gap(i) * gap(j)).alias(f"_v{i}{j}") for i, j in TRIANGLE]
    return both.select("_group", *means, *spread)


def estimates(rows: DataFrame) -> DataFrame:
    """Center and Cholesky factor for each language and source: its own minimum covariance determinant, put together with its language's, and that with that of all rows."""
    spark = rows.sparkSession
    found = save(spark, mcd(_members(rows)), "mcd")
    groups = save(spark, rows.select(*[k.alias(f"_k{i}") for i, k in enumerate(_keys())]).distinct(), "groups")
    none = [F.lit(0.0).alias(x) for x in (*MEANS, *COVARIANCES)]
    # Without any row that passes, estimates are 0; the floors on deviations are left.
    base = groups.select(F.col("_k0").alias("_group")).distinct().join(found, "_group", "left")
    base = base.select("_group", *[F.coalesce(F.col(x), n).alias(x) for x, n in zip((*MEANS, *COVARIANCES), none, strict=True)])
    for i in (1, 2):
        own = groups.select(F.col(f"_k{i}").alias("_group"), F.col(f"_k{i - 1}").alias("_up")).distinct().join(found, "_group", "left")
        base = save(spark, _pooled(own, base), "pooled")
    return save(spark, _with_factor(base.withColumn("_start", F.lit(0))).select("_group", *MEANS, *[f"_l{i}{j}" for i, j in TRIANGLE]), "estimates")


def judge(docs: DataFrame, beyond: float = 1e-6) -> DataFrame:
    """doc_id, a hash of the row's text, the statistics, base_failed, distance (squared) and kept.

    beyond: the share of a normal sample that may lie outside; sample statistics have longer tails than normal
    ones, so it is small and what it rejects is far out. The statistics are written once; every later step reads that small table.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"), F.xxhash64("text").alias("_text_hash"))
    d = with_stats(d).drop("text")
    d = d.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    rows = save(spark, with_features(d), "statistics")
    found = estimates(rows)
    judged = _with_distance(_beside(rows.withColumn("_group", _keys()[2]), found, found.count() <= BROADCAST_GROUPS, "left"))
    limit = chi2_quantile(1 - beyond, len(FEATURES))
    kept = F.expr("not base_failed") & (F.coalesce(F.col("_d2"), F.lit(0.0)) <= limit)
    return judged.select("doc_id", "_text_hash", "_lang", "_source", *STATS, "base_failed", F.col("_d2").alias("distance"), kept.alias("kept"))


def keep_good(docs: DataFrame, beyond: float = 1e-6) -> DataFrame:
    """The documents that are kept, with their columns; names that begin with "_qr_" are reserved."""
    good = judge(docs, beyond).filter("kept").select(F.col("doc_id").alias("_qr_id"), F.col("_text_hash").alias("_qr_hash"), F.col("_lang").alias("_qr_lang"), F.col("_source").alias("_qr_source")).distinct()
    pairs = {"_qr_id": F.col("doc_id").cast("long"), "_qr_lang": F.col("lang").cast("string"), "_qr_source": F.col("source").cast("string")}
    same = F.xxhash64("text") == F.col("_qr_hash")
    for name, own in pairs.items():
        same = same & own.eqNullSafe(F.col(name))
    return docs.join(good, same, "left_semi")
