"""License scans, HTML, decontamination, packing, scoring, quality rules and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import decontaminate, html_main, license_texts, licenses, line_dedup, lm_score, near_dup, packing, quality, queries
from lexloom.llm.common import table

from ..conftest import SF
from . import brute
from .test_dedup import frame, prose, rows


# License scans


def test_license_units(spark):
    mit = next(t for n, form, t in license_texts.TEMPLATES if n == "MIT" and form == "text")
    docs = [(1, None), (2, ""), (3, mit), (4, "x\nReleased under the MIT License.\ny"), (5, "Licensed under CC BY-NC 4.0."), (6, "license"), (7, prose(1, 5000)), (8, mit.upper().replace(" ", "\n")), (8, "nothing here")]
    found = {(r.doc_id, r.line): (r.license, r.dice) for r in licenses.scan(frame(spark, docs)).collect()}
    assert found[3, -1] == ("MIT", 1.0) and found[8, -1] == ("MIT", 1.0)
    assert found[4, 1] == ("MIT", 1.0) and found[5, -1] == ("CC-BY-NC-4.0", 1.0)
    assert {k[0] for k in found} == {3, 4, 5, 8}
    assert licenses.scan(frame(spark, docs).limit(0)).collect() == []


def plain_licenses(text, threshold=0.8):
    """{(line, n_lines): (license, dice)}"""
    templates = [(n, licenses.bigrams(licenses.normalised(t))) for n, _, t in license_texts.TEMPLATES]
    lines = [(i, w) for i, x in enumerate((text or "").split("\n")) if (w := licenses.normalised(x))]
    found = {}

    def score(key, words, name, t):
        own = licenses.bigrams(words)
        if own and (dice := round(2 * len(own & t) / (len(own) + len(t)), 6)) >= threshold:
            found.setdefault(key, []).append((-dice, name))

    for name, t in templates:
        score((-1, len((text or "").split("\n"))), [w for _, x in lines for w in x], name, t)
        if len(lines) > 1:
            for i, x in lines:
                score((i, 1), x, name, t)
        like = [bool(g := licenses.bigrams(x)) and 2 * len(g & t) >= len(g) for _, x in lines]
        own = [x or 0 < j < len(like) - 1 and like[j - 1] and like[j + 1] for j, x in enumerate(like)]
        for j, x in enumerate(own):
            if x and (j == 0 or not own[j - 1]):
                e = j
                while e + 1 < len(own) and own[e + 1]:
                    e += 1
                if e > j and e - j + 1 < len(lines):
                    score((lines[j][0], lines[e][0] - lines[j][0] + 1), [w for _, x in lines[j : e + 1] for w in x], name, t)
    return {k: (min(v)[1], -min(v)[0]) for k, v in found.items()}


def test_license_headers_in_files(spark):
    """Wrapped headers above code, two licences after each other, blank lines, a foreign line between, full texts."""
    import textwrap

    of = lambda name, form: next(t for n, f, t in license_texts.TEMPLATES if (n, f) == (name, form))
    wrap = lambda text, width, mark="# ": "\n".join(mark + x if x else mark.strip() for p in text.split("\n") for x in [*textwrap.wrap(p, width), ""])
    code = "\n".join(f"value_{i} = compute(value_{i - 1}, {i})" for i in range(300))
    rng = random.Random(5)
    texts = [t for _, _, t in license_texts.TEMPLATES]
    docs = [(1, f"{wrap(of('MIT', 'text'), 60)}\n{code}"), (2, f"{code}\n\n{wrap(of('Apache-2.0', 'header'), 40, ' * ')}\n\n{wrap(of('Zlib', 'text'), 70)}\n{code}"), (3, of("GPL-3.0", "full")), (4, f"{code}\n{of('MPL-2.0', 'full')}\n{code}"),
            (5, wrap(of("ISC", "text"), 50).replace("# THE SOFTWARE", "# something else entirely here\n# THE SOFTWARE")), (6, code), (7, None), (8, "Released under the MIT License.\n" + code), (9, code + "\nLicensed under\nCC BY 4.0."), (10, "MIT License")]
    docs += [(100 + i, " ".join(w for w in t.split() if rng.random() > 0.1)) for i, t in enumerate(texts)]
    docs += [(200 + i, code[:500] + "\n" + "\n".join(textwrap.wrap(" ".join(w for w in t.split() if rng.random() > 0.1), 80)) + "\n" + code[:500]) for i, t in enumerate(texts)]
    found = {}
    for r in licenses.scan(frame(spark, docs)).collect():
        found.setdefault(r.doc_id, {})[r.line, r.n_lines] = (r.license, r.dice)
    for i, text in docs:
        assert found.get(i, {}) == plain_licenses(text), i
    assert any(v[0] == "MIT" for v in found[1].values()) and {"Apache-2.0", "Zlib"} <= {v[0] for v in found[2].values()}
    assert found[3][-1, len(docs[2][1].split("\n"))] == ("GPL-3.0", 1.0) and any(v == ("MPL-2.0", 1.0) for v in found[4].values())


# HTML


def text(page, template=(), running=()):
    root = html_main.parse(page)
    html_main.prepare(root)
    return html_main.text_of(root, set(template), set(running))


@pytest.mark.parametrize(("page", "want"), [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<p>a &amp; b&nbsp;c  d</p>", "a & b c d"), ("<p>a<br>b</p>", "a b"), ("<p>un<b>closed<p>next", "unclosed\nnext"),
    ("<script>x<p>no</p></script>yes", "yes"), ("<style>p{}</style><!-- <p>no --><p>yes", "yes"), ("<p>1 < 2 and a<b</p>", "1 < 2 and a"), ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<nav>n</nav><article><h1>T</h1><p>x</p></article><footer>f</footer>", "T\nx"), ("<div class='cookie-banner'>c</div><div><p>x</p></div>", "x"),
    ("<article><p>x</p><div class=\"comments\"><p>no</p></div><form><p>no</p></form></article>", "x"), ("<p>x</p><p hidden>no</p><p style='display: none'>no</p>", "x"), ("<p>cut off <a href=\"", "cut off"),
    ("<p>&#233;&eacute;&#x41;</p>", "ééA"), ("<div role=navigation>no</div><main><p>x</p></main>", "x"), ("<p>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep"),
])
def test_html_cases(page, want):
    assert text(page) == want


def test_templates_go_and_articles_stay(spark):
    page = lambda i, body: f"<html><body><div class='x{i}'><span>Home page of the site</span></div><div><p>Own text number {i} with words.</p>{body}</div><div><p>All rights are reserved here</p></div></body></html>"
    rows_ = [(i, f"http://h.example/{i}", page(i, "")) for i in range(8)] + [(100 + i, f"http://other{i}.example/", page(i, "")) for i in range(2)] + [(200, None, None), (201, "nonsense", "<p>x</p>"), (201, "nonsense", "<p>x</p>")]
    found = html_main.main_texts(spark.createDataFrame(rows_, "page_id long, url string, html string").withColumn("text", F.lit("clash")))
    got = {r.page_id: r.text for r in found.collect()}
    assert found.count() == len(rows_)
    assert all(got[i] == f"Own text number {i} with words." for i in range(8))
    assert "Home page of the site" in got[100]
    assert got[200] == "" and got[201] == "x"
    assert html_main.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_copies_of_a_page_are_no_template(spark):
    same = "<html><body><div><p>The same article everywhere.</p></div></body></html>"
    d = spark.createDataFrame([(i, "http://h.example/x", same) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in html_main.main_texts(d).collect()} == {"The same article everywhere."}


def made_pages(hosts=3, n=12):
    """Pages without article, main or telling class names; menus, notices and footers differ from page to page."""
    rng, rows_ = random.Random(3), []
    say = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    for h in range(hosts):
        for i in range(n):
            menu = "".join(f"<li><a href='/{say(1)}'>{say(1)}</a></li>" for _ in range(rng.randrange(3, 7)))
            story = [say(rng.randrange(20, 60)) for _ in range(rng.randrange(2, 6))]
            body = f"<div class=x1><ul>{menu}</ul></div><div class=y2>{say(4)}</div><div class=z><h1>{story[0]}</h1>{''.join(f'<p>{p}</p>' for p in story[1:])}</div><div class=q>Company {h} {say(3)}</div>"
            rows_.append((100 * h + i, f"http://h{h}.example/{i}", f"<html><head><title>{say(3)}</title></head><body>{body}<p>All rights of host {h} are reserved</p></body></html>", "\n".join(story)))
    return rows_


def test_templates_are_found_by_recurrence_alone(spark):
    rows_ = made_pages()
    d = spark.createDataFrame([r[:3] for r in rows_], "page_id long, url string, html string")
    for lists in (True, False):
        assert {r.page_id: r.text for r in html_main.main_texts(d, lists).collect()} == {i: t for i, _, _, t in rows_}


def test_recurring_subtrees_like_a_plain_count(spark):
    rows_ = [*made_pages(2, 6), *[(900 + i, "http://h0.example/copy", made_pages(2, 6)[0][2], "") for i in range(9)]]
    pages, held = {}, {}
    for _, url, page, _ in rows_:
        root = html_main.parse(page)
        html_main.prepare(root)
        pages.setdefault(html_main.host_of(url), {})[root.digest] = html_main.subtrees(root), root.total
    for host, own in pages.items():
        for found, total in own.values():
            for key, size in found.items():
                held.setdefault((host, *key), []).append(size / total)
    want = set()
    for (host, digest, kind), shares in held.items():
        n, total = len(shares), len(pages[host])
        if kind == html_main.RUNNING_EQUAL:
            ok = n >= html_main.TEXT_MIN_PAGES and n >= html_main.TEXT_MIN_SHARE * total
        elif kind == html_main.SHAPE:
            ok = n >= html_main.SHAPE_MIN_PAGES and n >= html_main.SHAPE_MIN_SHARE * total and sum(shares) / n <= html_main.SHAPE_MAX_TEXT
        else:
            ok = n >= html_main.MIN_PAGES and n >= html_main.MIN_SHARE * total
        if ok:
            want.add((host, digest, kind))
    d = spark.createDataFrame([r[:3] for r in rows_], "page_id long, url string, html string")
    assert {(r.host, bytes(r.digest), r.kind) for r in html_main.recurring(d).collect()} == want
    assert want


def test_recurrence_does_the_work_on_the_table(spark):
    """Without the lists of names, pages of hosts with enough pages lose the same; without recurrence none does."""
    sf = SF.replace("0.001", "0.01")
    whole = {r.page_id: (html_main.host_of(r.url), r.text) for r in queries.op3_html_extraction(spark, sf).collect()}
    alone = {r.page_id: r.text for r in html_main.main_texts(table(spark, sf, "pages"), lists=False).collect()}
    of = Counter(h for h, _ in whole.values())
    large = [i for i, (h, _) in whole.items() if of[h] >= 8]
    assert len(large) > 50
    assert sum(alone[i] == whole[i][1] for i in large) >= 0.95 * len(large)


def test_salted_join_gives_the_same(spark, monkeypatch):
    sf = SF.replace("0.001", "0.01")
    d = table(spark, sf, "pages")
    want = rows(html_main.main_texts(d, lists=False))
    assert html_main.recurring(d.select("url", "html")).count() > 50
    monkeypatch.setattr(html_main, "BROADCAST_DIGESTS", -1)
    assert rows(html_main.main_texts(d, lists=False)) == want
    assert rows(queries.op3_html_extraction(spark, sf)) == rows(html_main.main_texts(d))


def test_a_story_in_several_articles():
    part = lambda t: f"<article><p>{t}</p></article>"
    assert text(f"<body><nav>n</nav><div>{part('one two three')}{part('four five six')}</div></body>") == "one two three\nfour five six"
    assert text(f"<main><p>{'long text ' * 20}</p><aside>{part('teaser')}</aside></main>") == ("long text " * 20).strip()


def test_articles_of_the_table(spark):
    import html
    import re

    pages = table(spark, SF, "pages").collect()
    found = {r.page_id: r.text for r in queries.op3_html_extraction(spark, SF).collect()}
    for p in pages:
        body = p.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split("</?p>|</?h1>", body)]
        assert found[p.page_id] == "\n".join(b for b in blocks if b)


# Decontamination


def brute_leaks(docs, items, rate=decontaminate.RATE):
    from lexloom.llm.edit import best_in

    return {(d, i) for d, t in docs for i, x in items if (w := decontaminate.tokens(x)) and best_in(w, decontaminate.tokens(t), int(rate * len(w)))}


def test_leaks(spark):
    item, short = prose(20, 40), "alpha beta gamma"
    w = item.split()
    edited = " ".join([*w[:5], "zz", *w[6:20], *w[22:30], "new", "new2", *w[30:]])
    broken = " ".join(x if i % 4 else "zz" for i, x in enumerate(w))
    docs = [(1, None), (2, ""), (3, item), (4, f"{prose(21, 50)} {item.upper().replace(' ', ', ')} {prose(22, 50)}"), (5, f"a {edited} b"), (6, broken), (7, short), (8, prose(23, 20000) + " " + item), (9, item[: len(item) // 2]), (3, "other"), (None, item), (10, (item + " ") * 50)]
    items = [(1, item), (2, short), (3, None), (4, ""), (5, "..."), (6, prose(24, 30)), (2, short), (None, short)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(frame(spark, docs), bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute_leaks(docs, [x for x in items if x[1]])
    small = decontaminate.leaks(frame(spark, docs), bench, block_chars=10)
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in found.collect()}
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append(decontaminate.tokens(t))
    for r in found.collect():
        words_ = [decontaminate.tokens(t) for i, t in items if i == r.item_id]
        assert any(brute.distance(x, t[r.start_word : r.end_word]) == r.distance for x in words_ for t in texts[r.doc_id])
    assert sorted(r.text or "" for r in decontaminate.drop_leaked(frame(spark, docs), bench, block_chars=10).collect()) == sorted(r.text or "" for r in decontaminate.drop_leaked(frame(spark, docs), bench).collect())
    kept = decontaminate.drop_leaked(frame(spark, docs), bench)
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for d, t in docs if not brute_leaks([(d, t)], [x for x in items if x[1]]))
    assert kept.columns == frame(spark, docs).columns
    assert decontaminate.leaks(frame(spark, docs).limit(0), bench).collect() == decontaminate.leaks(frame(spark, docs), bench.limit(0)).collect() == []
    assert decontaminate.drop_leaked(frame(spark, docs), bench.limit(0)).count() == len(docs)


def test_leaks_of_the_table(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert {(r.doc_id, r.item_id) for r in queries.op4_benchmark_decontamination(spark, SF).collect()} == brute_leaks(docs, items)


# Packing


def check_packing(found, docs, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d, p, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for p, s in enumerate(range(0, len(ids), capacity))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        placed.sort()
        at = 0
        for offset, length in placed:
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_whole_table(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    found = queries.op5_best_fit_packing(spark, SF).collect()
    n = check_packing(found, docs, 2048)
    assert n <= math.ceil(sum(r.length for r in found) / 2048 * 1.02) + 1


def test_packing_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n "), (4, "It's <|endoftext|> á İ ß Σας x" * 3), (5, "word's 12 naïve…!?,. 漢字   é" * 5), (6, prose(30, 4000)), (7, "a"), (7, "a"), (8, "don't. DON'T! A.B.C. x_y z-1 ... é. Éa, ÿ"), (9, "x'll y'S '' '.")]
    found = packing.pack(frame(spark, docs), queries.tokenizer_path(), 64).collect()
    check_packing(found, docs, 64)
    assert packing.pack(frame(spark, docs).limit(0), queries.tokenizer_path()).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plans_cover_and_fit(seed):
    rng = random.Random(seed)
    capacity = 200
    counts = Counter(min(capacity, 1 + int(rng.expovariate(1 / 60))) for _ in range(3000))
    chosen, bound = packing.plan(dict(counts), capacity)
    placed = Counter()
    for config, times in chosen:
        assert sum(k * n for k, n in config.items()) <= capacity
        for k, n in config.items():
            placed[k] += n * times
    assert placed == counts
    volume = sum(k * n for k, n in counts.items()) / capacity
    assert math.ceil(volume) <= bound <= sum(t for _, t in chosen) <= bound * 1.02


@pytest.mark.parametrize(("counts", "best"), [
    ({}, 0), ({100: 3}, 3), ({60: 10}, 10), ({51: 7}, 7), ({50: 7}, 4), ({34: 10, 66: 4}, 7), ({60: 20, 20: 10}, 20), ({70: 1000, 31: 500}, 1334), ({1: 1}, 1), ({1: 101}, 2), ({40: 30, 35: 30, 25: 30}, 30),
])
def test_plans_against_known_optima(counts, best):
    chosen, bound = packing.plan(counts, 100)
    assert bound <= best
    assert sum(t for _, t in chosen) <= best + max(1, best // 50)


def test_prices_find_what_volume_does_not():
    """Long pieces need a sequence each, so short ones are worth nothing: only the dual's prices show it."""
    rng = random.Random(1)
    counts = Counter(rng.randrange(110, 130) if rng.random() < 0.7 else rng.randrange(20, 40) for _ in range(20_000))
    long = sum(n for k, n in counts.items() if k > 100)
    chosen, bound = packing.plan(dict(counts), 200)
    assert sum(t for _, t in chosen) == long
    assert sum(k * n for k, n in counts.items()) / 200 < 0.85 * long < bound <= long


def test_prices_matter():
    rng = random.Random(2)
    counts = Counter(1 + int(rng.expovariate(1 / 60)) % 199 for _ in range(20_000))
    n = [sum(t for _, t in packing.plan(dict(counts), 200, rate=rate)[0]) for rate in (0.0, 0.3)]
    assert n[1] < n[0]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.floats(0, 5)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(12, 30))
def test_knapsack(items, room):
    items.sort()
    best = packing.knapsack(np.array([v for _, v in items]), np.array([k for k, _ in items]), room)
    want = [0.0] * (room + 1)
    for c in range(1, room + 1):
        want[c] = max([want[c - 1], *(want[c - k] + v for k, v in items if k <= c)])
    assert np.allclose(best, want)


def test_words_are_encoded_as_texts_are():
    own = packing.WordEncoder(queries.tokenizer_path())
    texts = ["Hello, World! it's  42\tfoo.bar", "naïve ÉCOLE. ß x", "<|startoftext|> a<|endoftext|>b", ""]
    for text_, raw in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == own.tokenizer.encode(text_, add_special_tokens=False).ids


def test_words_outlive_a_full_table(monkeypatch):
    """Tables that are turned over again and again give the same ids."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    own, rng = packing.WordEncoder(queries.tokenizer_path()), random.Random(8)
    texts = [" ".join(f"{rng.choice(['alpha', 'beta', 'gamma'])}{rng.choice(['', ',', '.', '!x'])} w{rng.randrange(200)}" for _ in range(rng.randrange(8))) for _ in range(900)]
    for text_, raw in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == own.tokenizer.encode(text_, add_special_tokens=False).ids


# LM scoring


def test_base_scores(spark):
    docs = [(1, None), (2, ""), (3, "The the THE É É"), (4, "a b a b"), (None, "a b"), (5, prose(40, 3000)), (5, "x y z"), *[(100 + i, prose(41 + i % 3, 40)) for i in range(40)]]
    found = lm_score.score(frame(spark, docs)).collect()
    want = brute.base_scores(docs)
    key = lambda r: repr(r[:5]) + f"{r[5]:.6f}"
    for a, b in zip(sorted((tuple(r)[:6] for r in found), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(r.score <= 1e-9 for r in found)
    assert lm_score.score(frame(spark, docs).limit(0)).collect() == []


def test_only_held_out(spark):
    d = next(i for i in range(1000) if lm_score.held_out(i))
    r = lm_score.score(frame(spark, [(d, "a b")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) == (True, 3, 0, 0, 0.0)


def test_contexts_help_on_held_out_text(spark):
    rng = random.Random(7)
    after = {f"k{i}": [f"v{i}a", f"v{i}b"] for i in range(6)}
    make = lambda: " ".join(w for _ in range(60) for k in [rng.choice(sorted(after))] for w in (k, rng.choice(after[k])))
    found = lm_score.score(frame(spark, [(i, make()) for i in range(60)])).filter("held_out")
    n, base, own = found.agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert own / n > base / n + 0.3


def tree_docs():
    """A few very common words and pairs, rare ones, repeats, and texts that occur twice."""
    rng = random.Random(17)
    word = lambda: "the" if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.7))}"
    docs = [(i, " ".join("of the" if rng.random() < 0.1 else word() for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(1000 + i, docs[i][1]) for i in range(20)]
    return [*docs, (2000, None), (2001, "THE The the"), (2002, "never seen before"), (2001, "of the of the of"), (None, "of the")]


def test_scores_like_a_plain_suffix_tree(spark):
    docs = tree_docs()
    found = sorted(((r.doc_id, r.n_tokens, r.score) for r in lm_score.score(frame(spark, docs)).collect()), key=repr)
    for a, b in zip(found, sorted(brute.tree_scores(docs), key=repr), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9, abs_tol=1e-9)


def test_scores_do_not_depend_on_how_work_is_dealt(spark, monkeypatch):
    docs, key = tree_docs(), "spark.sql.shuffle.partitions"
    want = [(r, c) for r, c, in sorted(((d, s) for d, _, s in brute.tree_scores(docs)), key=repr)]
    monkeypatch.setattr(lm_score, "PART", 500)
    try:
        for n in (1, 7, 211):
            spark.conf.set(key, str(n))
            found = sorted(((r.doc_id, r.score) for r in lm_score.score(frame(spark, docs).repartition(n)).collect()), key=repr)
            assert [d for d, _ in found] == [d for d, _ in want]
            assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for (_, a), (_, b) in zip(found, want, strict=True))
    finally:
        spark.conf.set(key, "4")


def test_texts_that_occur_twice_are_expected(spark):
    docs = [(i, " ".join(f"x{random.Random(i * 1000 + j).randrange(10**6)}" for j in range(80))) for i in range(40)]
    train = [i for i in range(100, 140) if not lm_score.held_out(i)][:2]
    docs += [(i, docs[0][1]) for i in train]
    found = {r.doc_id: r.score / r.n_tokens for r in lm_score.score(frame(spark, docs)).collect()}
    assert min(found[i] for i in train) > max(v for i, v in found.items() if i not in (0, *train)) + 1


def test_scores_of_the_table_beat_the_base(spark):
    found = queries.op6_lm_scoring(spark, SF).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert found[1] > found[0]


# Quality rules


def quality_docs():
    rng = random.Random(9)
    good = [(i, "\n".join(prose(100 * i + j, 30 + rng.randrange(60), 3000) for j in range(1 + rng.randrange(6)))) for i in range(200)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in prose(5000 + i, 100).split())) for i in range(5)]
    bad = [(2000, None), (2001, ""), (2002, "too short"), (2003, "spam and eggs " * 100), (2004, "|" * 500)]
    return good, junk, bad


def test_statistics_and_verdicts(spark):
    good, junk, bad = quality_docs()
    d = spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", 0, 1.0) for i, t in good + junk + bad], "doc_id long, text string, lang string, source string, n_chars long, n_words double")
    found = {r.doc_id: r for r in quality.judge(d).collect()}
    for i, t in good + junk + bad:
        r, s = found[i], brute.statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 20 or 100 * s[4] > 30 * s[0])
    assert all(found[i].kept for i, _ in good)
    assert not any(found[i].kept for i, _ in junk + bad)
    kept = quality.keep_good(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in found.items() if r.kept)
    assert quality.judge(d.limit(0)).collect() == []


@pytest.mark.parametrize("t", ["a b c d e f g h " * 3, "x\nx\n\n \nx", "w " * 50, "a b c d e f g h i " + "a b c d e f g h", "\t#*$ %&|<>\r\n", "p q r s t u v w x y p q r s t u v w z q r s t u v w x y", "é ü " * 40])
def test_statistics_cases(spark, t):
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    assert tuple(quality.with_stats(d).select(*quality.STATS).first()) == brute.statistics(t)


def plain_verdicts(rows, beyond=1e-6):
    """kept, by numpy: rows are (lang, source, statistics, base_failed)."""
    p, sd = 5, np.array(quality.LEAST_SD)

    def factor(v):
        low = np.zeros((p, p))
        for i in range(p):
            for j in range(i + 1):
                rest = v[i, j] + (sd[i] ** 2 if i == j else 0) - low[i, :j] @ low[j, :j]
                low[i, j] = math.sqrt(max(rest, sd[i] ** 2 / 4)) if i == j else rest / low[j, j]
        return low

    def distances(x, m, v):
        z = np.linalg.solve(factor(v), (x - m).T)
        return (z**2).sum(axis=0)

    def step(x, m, v, before, c):
        d = distances(x, m, v)
        near = x[d <= np.sort(d)[max(math.ceil(quality.KEEP * len(d)) - 1, 0)]]
        v = c * np.cov(near.T, bias=True).reshape(p, p)
        return 2 * np.log(np.diag(factor(v))).sum(), before, len(near), near.mean(axis=0), v

    def least(x):
        if not len(x):
            return 0, np.zeros(p), np.zeros((p, p))
        rank = lambda y, q: np.sort(y, axis=0)[max(math.ceil(q * len(y)) - 1, 0)]
        c = quality.KEEP / quality.chi2_cdf(quality.chi2_quantile(quality.KEEP, p), p + 2)
        found = []
        for m, v in ((rank(x, 0.5), np.diag(((rank(x, 0.75) - rank(x, 0.25)) / 1.349) ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True))):
            det = before = 2 * np.log(np.diag(factor(v))).sum()
            for _ in range(quality.FIRST_STEPS):
                det, before, n, m, v = step(x, m, v, det, c)
            found.append((det, before, n, m, v))
        det, before, n, m, v = min(found, key=lambda f: round(f[0], 7))
        for _ in range(quality.STEPS - quality.FIRST_STEPS):
            if abs(det - before) <= quality.SETTLED:
                break
            det, before, n, m, v = step(x, m, v, det, c)
        return n, m, v

    def pooled(own, parent):
        (n, m, v), (pm, pv), k = own, parent, quality.PRIOR
        return (n * m + k * pm) / (n + k), (n * v + k * pv) / (n + k) + n * k / (n + k) ** 2 * np.outer(m - pm, m - pm)

    x = np.array([[math.log(max(s[0], 1)), math.log(max(s[1], 1) / max(s[0], 1)), math.sqrt(s[2] / max(s[0], 1)), math.sqrt(s[3] / (s[3] + 5 + max(s[0], 1) / 50)), math.sqrt(s[4] / max(s[0], 1))] for _, _, s, _ in rows])
    good = np.array([not f for *_, f in rows])
    of = lambda *want: x[[i for i, r in enumerate(rows) if good[i] and r[: len(want)] == want]]
    top = least(of())[1:]
    out = []
    cache = {}
    for i, (lang, source, _, failed) in enumerate(rows):
        if (lang, source) not in cache:
            cache[lang, source] = pooled(least(of(lang, source)), pooled(least(of(lang)), top))
        out.append(not failed and distances(x[i : i + 1], *cache[lang, source])[0] <= quality.chi2_quantile(1 - beyond, p))
    return out


def test_verdicts_of_the_table_like_plain_ones(spark):
    docs = table(spark, SF, "documents").collect()
    found = {r.doc_id: r.kept for r in queries.op10_quality_rules(spark, SF).collect()}
    rows_ = [(r.lang, r.source, s, s[0] < 20 or 100 * s[4] > 30 * s[0]) for r in docs for s in [brute.statistics(r.text)]]
    assert [found[r.doc_id] for r in docs] == plain_verdicts(rows_)


def test_groups_of_any_size_and_name(spark):
    """One row, few rows, empty and null names: groups of their own, judged as the plain version does."""
    good, junk, _ = quality_docs()
    langs = ["", None, "-", "1:x", "en"]
    docs = [(i, t, langs[i % 5], langs[i % 3] if i % 7 else None, 0) for i, t in good + junk] + [(5000, good[0][1], "solo", "solo", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.kept for r in quality.judge(d).collect()}
    rows_ = [(r[2], r[3], s, s[0] < 20 or 100 * s[4] > 30 * s[0]) for r in docs for s in [brute.statistics(r[1])]]
    assert [found[r[0]] for r in docs] == plain_verdicts(rows_)
    assert not any(found[i] for i, _ in junk)


def test_clashing_columns_stay(spark):
    good, junk, _ = quality_docs()
    names = ["_id", "_text_hash", "_lang", "_source", "_group", "_x0", "kept", "n_words", "_nd", "_ld"]
    d = spark.createDataFrame([(i, t, "en", "s", 0, *names) for i, t in good + junk], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    kept = quality.keep_good(d)
    assert kept.columns == d.columns and kept.count() == len(good)
    assert [r[5:] for r in kept.limit(2).collect()] == [tuple(names)] * 2
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, SF).columns == d.columns


def test_rejections_are_of_rows_not_ids(spark):
    good, junk, _ = quality_docs()
    d = spark.createDataFrame([(7, t, "en", "s", 0) for _, t in good + junk], "doc_id long, text string, lang string, source string, n_chars long")
    assert quality.keep_good(d).count() == len(good)


def test_salted_estimates_give_the_same(spark, monkeypatch):
    want = rows(queries.op10_quality_rules(spark, SF))
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", -1)
    assert rows(queries.op10_quality_rules(spark, SF)) == want


def test_chi_square():
    assert math.isclose(quality.chi2_cdf(quality.chi2_quantile(0.9, 5), 5), 0.9, abs_tol=1e-9)
    assert math.isclose(quality.chi2_quantile(0.95, 1), 3.841459, abs_tol=1e-5)


# Pipeline


def test_pipeline_is_its_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    whole = table(spark, SF, "documents")
    kept = {r.doc_id for r in queries.op10_quality_rules(spark, SF).filter("kept").collect()}
    docs = {r.doc_id: r.text for r in whole.collect() if r.doc_id in kept}
    held = {}
    for d, t in docs.items():
        for line in t.split("\n"):
            held.setdefault(brute.lower(line.strip(brute.SPACE)), set()).add(d)
    docs = {d: "\n".join(x for x in t.split("\n") if not (len(k := brute.lower(x.strip(brute.SPACE))) >= 20 and len(held[k]) >= 3 and d != max(held[k]))) for d, t in docs.items()}
    frame_ = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    near = {r.doc_id for r in near_dup.classes(frame_).collect() if r.doc_id == r.class_id}
    docs = {d: t for d, t in docs.items() if d in near}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    leaked = {d for d, _ in brute_leaks(docs.items(), items)}
    docs = {d: t for d, t in docs.items() if d not in leaked}
    check_packing(corpus_pipeline.run(spark, SF).collect(), list(docs.items()), 2048)


def test_stages_keep_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_native_operators_run_no_python(spark):
    for plan in (licenses.scan(table(spark, SF, "documents")), quality.with_stats(table(spark, SF, "documents"))):
        assert not {"Python", "Arrow", "Pandas"} & set(plan._jdf.queryExecution().executedPlan().toString().split())
        assert "InArrow" not in plan._jdf.queryExecution().executedPlan().toString()
    assert line_dedup.MIN_DOCS == 3
