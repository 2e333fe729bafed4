"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import collocations, decontaminate, html_main, importance, licenses, line_dedup, lm_score, near_dup, packing, quality, substring_dedup, suffix_dedup, warc
from lexloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_texts(table(spark, sf_dir, "pages"))


def _removed() -> list:
    return [F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.begin)").alias("n_removed"), F.size("spans").cast("long").alias("n_spans")]


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", *_removed(), F.sha2("kept", 256).alias("kept_sha256"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "n_links")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc_id").cast("long"), F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", _removed()[0], F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality.STATS, "base_failed", "kept")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_warc_archives": op12_warc_archives,
    "op13_phrase_collocations": op13_phrase_collocations,
}

OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), h AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, (h.key IS NOT NULL AND k.doc_id <> h.last) AS gone FROM k LEFT JOIN h ON k.key = h.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP2_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
g AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS gram FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM b)),
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram HAVING count(*) > 1),
hit AS (SELECT g.doc_id, g.i FROM g JOIN f USING (gram) WHERE f.first < g.doc_id),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY doc_id, run),
p AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM r UNION ALL SELECT b.doc_id, coalesce(max(z), 0), any_value(n) FROM b LEFT JOIN r USING (doc_id) GROUP BY b.doc_id),
t AS (SELECT p.doc_id, string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept FROM p JOIN b USING (doc_id) GROUP BY p.doc_id),
c AS (SELECT doc_id, sum(z - a)::BIGINT AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT b.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM b JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP9_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM w),
g AS (SELECT doc_id, p, n, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS gram FROM e),
f AS (SELECT gram, min(doc_id) AS first FROM g WHERE p <= n - 12 GROUP BY gram HAVING count(*) > 1),
h AS (SELECT g.doc_id, g.p, g.word, (f.gram IS NOT NULL AND g.p <= g.n - 12 AND f.first < g.doc_id)::INT AS hit FROM g LEFT JOIN f ON g.gram = f.gram),
c AS (SELECT doc_id, p, word, max(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, count(*) FILTER (WHERE gone = 1)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id) GROUP BY w.doc_id, ws
"""

OP11_SQL = r"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), src AS (
  SELECT 0 AS side, doc_id AS nr, doc_id, text FROM documents UNION ALL SELECT 1, NULL, NULL, text FROM benchmark
), ws AS (
  SELECT side, nr, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM src
), f AS (
  SELECT side, nr, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM ws
), c AS (SELECT side, nr, feature, count(*) AS n FROM f GROUP BY ALL
), u AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM c)
), b AS (
  SELECT feature, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, length(h) // 2), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 10000 AS bucket FROM u, tab
), k AS (
  SELECT r.bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM range(10000) r(bucket) LEFT JOIN (SELECT * FROM c JOIN b USING (feature)) x ON x.bucket = r.bucket GROUP BY r.bucket
), g AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM k
), d AS (
  SELECT nr, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM c JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY nr
), p AS (
  SELECT ws.doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, sha256('7:' || ws.doc_id)[1:8] AS h FROM ws LEFT JOIN d USING (nr) WHERE side = 0
), q AS (
  SELECT *, weight + floor(-1000 * ln(-ln((list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', h[i]) - 1), lambda a, x: 16 * a + x) + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM p
), o AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE words >= 20) OVER () AS fit FROM q
)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank FROM o
"""

OP12_SQL = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS g, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages
)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to FROM d
"""

OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM w, range(1, 5) r(size)
), f AS (
  SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30
), t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, size, phrase, n AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rp FROM f, range(1, 4) r(k) WHERE k < size
), s AS (
  SELECT c.lang, c.size, c.phrase, a, k, l.n AS l, r.n AS r, (2000000::HUGEINT * a) // (l.n + r.n) AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = lp JOIN f r ON r.lang = c.lang AND r.phrase = rp
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), o AS (
  SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.lang = b.lang AND x.size > b.size AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') AND 100::HUGEINT * x.n >= 80::HUGEINT * b.a)
)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n::BIGINT AS n, score::BIGINT AS score
FROM o JOIN t ON t.lang = o.lang QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.oracle_sql(),
    "op2_suffix_array_dedup": OP2_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_warc_archives": OP12_SQL,
    "op13_phrase_collocations": OP13_SQL,
}
