"""Licence scans: Dice coefficient over word bigrams between normalised text and licence templates.

Units are the whole text of a document, each of its lines, and runs of lines. For a template, a run is as many lines in a row as
there are (blank ones aside) of whose bigrams half or more are the template's, or which lie alone between two such lines. Text
is normalised to lower-case runs of a-z and 0-9. DataFrame functions only, one pass, no join and no shuffle.

A unit with a distinct bigrams can only reach a coefficient t with a template of b if it shares t / (2 - t) * b of them. So two
bounds prune: a document without any of a few words, which together are in so many bigrams of every template that none can be reached without
them (or, for the words of long templates, a document shorter than these allow) is left at once; and of the others, a template stays only if the document's bigrams
are enough and hold that share of its own.

Defined results: a null or empty text matches nothing, nor does a unit of fewer than two words. Of several templates
for the same lines the highest coefficient wins, then the name. A line or run that is all of a document's text gives its whole-text match
only. Rows with the same doc_id give their rows each. Extra columns are not carried. No rows in, no rows out.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
WORDS = "split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ')), ' ')"
GRAMS = "if(size({0}) < 2, cast(array() as array<bigint>), array_distinct(zip_with(slice({0}, 1, greatest(size({0}) - 1, 0)), slice({0}, 2, greatest(size({0}) - 1, 0)), (p, q) -> xxhash64(concat_ws(' ', p, q)))))"


def normalised(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


#: Words of any text, which are no use as markers.
COMMON = frozenset("a all an and any are as at be but by do for from have if in is it its may no not of on or other so such that the this to use we with you your".split())
#: Templates of more bigrams are looked for in texts that are long enough only.
LONG = 500


@lru_cache(maxsize=None)
def marker_words(threshold: float, long: bool) -> tuple[str, ...]:
    """A few words, found greedily, so that of each template (short ones or long ones) more bigrams have one of them than a match may miss. Long words are rarer in other texts and come first."""
    found: list[str] = []
    left = []
    for _, _, text in TEMPLATES:
        grams = bigrams(normalised(text))
        if (len(grams) > LONG) == long:
            left.append(({tuple(g.split()) for g in grams}, int(len(grams) - threshold / (2 - threshold) * len(grams)) + 1))
    while left:
        score: Counter[str] = Counter()
        for grams, need in left:
            for w, n in Counter(w for g in grams for w in set(g)).items():
                score[w] += min(1.0, n / need) * (0.01 if w.isdigit() or w in COMMON else min(len(w), 9) ** 2)
        found.append(max(sorted(score), key=score.__getitem__))
        left = [(rest, need - (len(grams) - len(rest))) for grams, need in left for rest in [{g for g in grams if found[-1] not in g}]]
        left = [(grams, need) for grams, need in left if need > 0]
    return tuple(sorted(found))


def _template_sql(long: bool) -> str:
    """One array without columns or lambdas in it, which the optimizer folds to a literal."""
    rows = []
    for name, _, text in sorted(TEMPLATES):
        grams = sorted(bigrams(normalised(text)))
        if (len(grams) > LONG) == long:
            rows.append(f"named_struct('license', '{name}', 'grams', array({', '.join(f"xxhash64('{x}')" for x in grams)}))")
    return f"array({', '.join(rows)})"


def _any_template_sql() -> str:
    """The bigrams of all short templates."""
    grams = sorted({g for _, _, text in TEMPLATES for own in [bigrams(normalised(text))] if len(own) <= LONG for g in own})
    return f"array({', '.join(f"xxhash64('{x}')" for x in grams)})"


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line (from 0; -1 for the whole text), n_lines, license, dice, for each unit that reaches the threshold."""
    share = threshold / (2 - threshold)
    has = lambda long: F.lower("text").rlike(f"(?<![a-z0-9])({'|'.join(marker_words(threshold, long))})(?![a-z0-9])")
    # So many bigrams need so many words, each of a character and a blank at least.
    least = min((2 * share * len(g) for _, _, t in TEMPLATES if len(g := bigrams(normalised(t))) > LONG), default=0)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(has(False) | (F.length("text") >= least) & has(True))
    # What follows a Generate is computed for rows that are left, and not computed again.
    d = d.select("doc_id", "text", F.explode(F.expr(f"filter(array({WORDS.format('text')}), w -> size(w) > 1)")).alias("words"))
    d = d.select("doc_id", "text", F.explode(F.expr(f"array({GRAMS.format('words')})")).alias("grams"))
    # A document shares no more with a short template than with all of them together.
    d = d.withColumn("common", F.expr(f"array_intersect(grams, {_any_template_sql()})"))
    near = "filter(transform(filter({t}, t -> size(t.grams) * {s}D <= size({g}) + 1e-9D), t -> named_struct('license', t.license, 'grams', t.grams, 'same', size(array_intersect({g}, t.grams)))), t -> t.same >= size(t.grams) * {s}D - 1e-9D)"
    both = f"concat({near.format(t=_template_sql(False), g='common', s=share)}, {near.format(t=_template_sql(True), g='grams', s=share)})"
    d = d.select("doc_id", "text", F.size("grams").alias("a"), F.explode(F.expr(f"filter(array({both}), x -> size(x) > 0)")).alias("near"))
    d = d.withColumn("lines", F.expr(f"filter(transform(split(text, '\\n'), (x, i) -> named_struct('i', i, 'words', {WORDS.format('x')})), x -> x.words[0] != '')"))
    d = d.withColumn("held", F.expr(f"transform(lines, x -> {GRAMS.format('x.words')})")).withColumn("n", F.size("lines"))
    edge = "filter(transform(t.own, (x, j) -> if(x and not coalesce(get(t.own, j {} 1), false), j, -1)), j -> j >= 0)"
    steps = {
        "hits": "transform(held, g -> size(array_intersect(g, t.grams)))",
        "like": "transform(t.hits, (h, j) -> size(held[j]) >= 1 and 2 * h >= size(held[j]))",
        "own": "transform(t.like, (x, j) -> x or (coalesce(get(t.like, j - 1), false) and coalesce(get(t.like, j + 1), false)))",
        "runs": f"filter(zip_with({edge.format('-')}, {edge.format('+')}, (p, q) -> named_struct('s', p, 'e', q)), r -> r.e > r.s and r.e - r.s + 1 < n)",
        "inner": f"transform(t.runs, r -> {GRAMS.format('flatten(transform(slice(lines, r.s + 1, r.e - r.s + 1), y -> y.words))')})",
    }
    fields = ["license", "grams", "same"]
    for name, expression in steps.items():
        kept = ", ".join(f"'{f}', t.{f}" for f in fields)
        d = d.withColumn("near", F.expr(f"transform(near, t -> named_struct({kept}, '{name}', {expression}))"))
        fields.append(name)
    unit = "named_struct('line', {line}, 'n_lines', {n}, 'miss', -round(2.0D * {same} / ({a} + size(t.grams)), 6), 'license', t.license)"
    whole = unit.format(line="-1", n="size(split(text, '\\n'))", same="t.same", a="a")
    single = unit.format(line="lines[j].i", n="1", same="h", a="size(held[j])")
    run = unit.format(line="lines[r.s].i", n="lines[r.e].i - lines[r.s].i + 1", same="size(array_intersect(t.inner[j], t.grams))", a="size(t.inner[j])")
    units = f"concat(array({whole}), if(n > 1, transform(t.hits, (h, j) -> {single}), array()), transform(t.runs, (r, j) -> {run}))"
    d = d.select("doc_id", F.expr(f"array_sort(filter(flatten(transform(near, t -> {units})), u -> -u.miss >= {threshold}D))").alias("units"))
    d = d.select("doc_id", F.explode(F.expr("filter(units, (u, i) -> i = 0 or get(units, i - 1).line != u.line or get(units, i - 1).n_lines != u.n_lines)")).alias("u"))
    return d.select("doc_id", "u.line", "u.n_lines", "u.license", (-F.col("u.miss")).alias("dice"))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    values = ", ".join("('{}', '{}')".format(name, " ".join(normalised(text))) for name, _, text in sorted(TEMPLATES))
    return f"""
WITH t AS (SELECT license, row_number() OVER () AS tid, string_split(w, ' ') AS words FROM (VALUES {values}) v(license, w)),
tg AS (SELECT DISTINCT tid, license, words[i] || ' ' || words[i + 1] AS gram FROM (SELECT *, unnest(range(1, len(words))) AS i FROM t)),
tn AS (SELECT tid, license, count(*) AS b FROM tg GROUP BY ALL),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS raw FROM documents),
w AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS j, count(*) OVER (PARTITION BY doc_id) AS n, words
  FROM (SELECT doc_id, line, string_split(trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM l) WHERE words[1] <> ''
),
g AS (SELECT DISTINCT doc_id, j, words[i] || ' ' || words[i + 1] AS gram FROM (SELECT *, unnest(range(1, len(words))) AS i FROM w)),
size AS (SELECT doc_id, j, count(*) AS a FROM g GROUP BY ALL),
hit AS (SELECT doc_id, j, tid, count(*) AS same FROM g JOIN tg USING (gram) GROUP BY ALL),
fl AS (SELECT doc_id, tid, j FROM hit JOIN size USING (doc_id, j) WHERE 2 * same >= a),
own AS (
  SELECT doc_id, tid, j FROM fl UNION
  SELECT x.doc_id, x.tid, x.j + 1 FROM fl x JOIN fl y ON x.doc_id = y.doc_id AND x.tid = y.tid AND y.j = x.j + 2
),
runs AS (
  SELECT doc_id, tid, min(j) AS s, max(j) AS e FROM (SELECT *, j - row_number() OVER (PARTITION BY doc_id, tid ORDER BY j) AS island FROM own) GROUP BY doc_id, tid, island HAVING count(*) > 1
),
u AS (
  SELECT doc_id, NULL::BIGINT AS tid, -1 AS line, len(string_split(text, chr(10))) AS n_lines, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM documents
  UNION ALL SELECT doc_id, NULL, line, 1, words FROM w WHERE n > 1
  UNION ALL SELECT r.doc_id, r.tid, min(w.line), max(w.line) - min(w.line) + 1, flatten(list(w.words ORDER BY w.j)) FROM runs r JOIN w ON w.doc_id = r.doc_id AND w.j BETWEEN r.s AND r.e GROUP BY r.doc_id, r.tid, r.s, r.e HAVING count(*) < any_value(w.n)
),
k AS (SELECT *, row_number() OVER () AS uid FROM u),
ug AS (SELECT DISTINCT uid, words[i] || ' ' || words[i + 1] AS gram FROM (SELECT uid, words, unnest(range(1, len(words))) AS i FROM k)),
un AS (SELECT uid, count(*) AS a FROM ug GROUP BY uid),
s AS (SELECT uid, tg.tid, license, count(*) AS same FROM ug JOIN tg USING (gram) GROUP BY ALL),
d AS (SELECT k.doc_id, k.line, k.n_lines, s.license, round(2.0 * same::DOUBLE / (a + b), 6) AS dice FROM s JOIN un USING (uid) JOIN tn USING (tid) JOIN k USING (uid) WHERE k.tid IS NULL OR k.tid = s.tid)
SELECT doc_id, line::INTEGER AS line, n_lines::INTEGER AS n_lines, license, dice FROM d WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, line, n_lines ORDER BY dice DESC, license) = 1
"""
