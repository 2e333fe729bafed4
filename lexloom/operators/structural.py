"""Structural search and rewriting of Python source on the standard parser, a file at a time in Arrow batches.

Patterns are Python with metavariables: `$X` matches one expression or statement, `$$$X` any number of arguments, elements
or statements. Equal metavariables must match equal code. Other languages need grammars that are not here; for them `token_search` matches
a bracket-aware pattern of tokens.
"""

from __future__ import annotations

import ast
import difflib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.segments import spread

META = re.compile(r"\$\$\$([A-Z_][A-Z0-9_]*)|\$([A-Z_][A-Z0-9_]*)")
MANY, ONE = "__many_", "__one_"


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    line: int
    single: dict[str, str]
    multi: dict[str, list[str]]


def compile_pattern(pattern: str) -> ast.AST:
    source = META.sub(lambda m: f"{MANY}{m[1]}" if m[1] else f"{ONE}{m[2]}", pattern)
    try:
        tree = ast.parse(source)
    except SyntaxError as error:
        raise ValueError(f"not a pattern: {pattern}") from error
    if len(tree.body) != 1:
        raise ValueError("a pattern is one expression or statement")
    only = tree.body[0]
    return only.value if isinstance(only, ast.Expr) else only


def literal_of(pattern: str) -> str | None:
    """The longest name in a pattern that every match must hold, to sort files out before they are parsed."""
    names = re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", META.sub(" ", pattern))
    return max(names, key=len, default=None)


class Source:
    """Text with its tree and byte offsets."""

    def __init__(self, text: str):
        text = text.removeprefix("﻿")
        self.raw = text.encode("utf-8", "surrogatepass")
        self.tree = ast.parse(text)
        self.starts = [0]
        for line in self.raw.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def text(self, node: ast.AST) -> str:
        a, b = self.span(node)
        return self.raw[a:b].decode("utf-8", "surrogatepass")


def _name(node: object, prefix: str) -> str | None:
    if isinstance(node, ast.Expr):
        node = node.value
    if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value.startswith(prefix):
        return node.value[len(prefix) :]
    name = node.id if isinstance(node, ast.Name) else node.arg if isinstance(node, ast.arg) else None
    return name[len(prefix) :] if name and name.startswith(prefix) else None


def _equal(a: str, b: str) -> bool:
    """The same code, whatever the spaces in it."""
    if a == b or a.split() != b.split() and "".join(a.split()) != "".join(b.split()):
        return a == b
    try:
        return ast.dump(ast.parse(a.strip())) == ast.dump(ast.parse(b.strip()))
    except SyntaxError:
        return False


def _same(p: object, n: object, source: Source, single: dict[str, str], multi: dict[str, list[str]]) -> bool:
    if isinstance(p, ast.AST):
        if (name := _name(p, ONE)) is not None:
            if isinstance(p, ast.Constant):  # "$X" in quotes is a string literal with any content
                if not (isinstance(n, ast.Constant) and isinstance(n.value, str)):
                    return False
                text = n.value
            elif not isinstance(n, ast.AST) or not hasattr(n, "lineno"):
                return False
            else:
                text = source.text(n)
            return _equal(single.setdefault(name, text), text)
        if type(p) is not type(n):
            return False
        skip = ("ctx", "type_comment", "kind")
        return all(_same(getattr(p, f, None), getattr(n, f, None), source, single, multi) for f in p._fields if f not in skip)
    if isinstance(p, list):
        return isinstance(n, list) and _lists(p, n, source, single, multi)
    return p == n


def _lists(p: list, n: list, source: Source, single: dict[str, str], multi: dict[str, list[str]]) -> bool:
    if not p:
        return not n
    if isinstance(p[0], ast.AST) and (name := _name(p[0], MANY)) is not None:
        for k in range(len(n), -1, -1):
            s, m = dict(single), dict(multi)
            texts = [source.text(x) for x in n[:k] if hasattr(x, "lineno")]
            if m.setdefault(name, texts) == texts and _lists(p[1:], n[k:], source, s, m):
                single.update(s)
                multi.update(m)
                return True
        return False
    return bool(n) and _same(p[0], n[0], source, single, multi) and _lists(p[1:], n[1:], source, single, multi)


def _call_with_keywords(p: ast.AST, n: ast.AST, source: Source, single: dict, multi: dict) -> bool:
    """A trailing $$$ARGS of a call takes keyword arguments too."""
    if isinstance(p, ast.Call) and isinstance(n, ast.Call) and p.args and not p.keywords and n.keywords and (name := _name(p.args[-1], MANY)) is not None:
        fixed = p.args[:-1]
        if not _same(p.func, n.func, source, single, multi) or not _lists(fixed, n.args[: len(fixed)], source, single, multi):
            return False
        multi[name] = [source.text(x) for x in [*n.args[len(fixed) :], *n.keywords]]
        return True
    return _same(p, n, source, single, multi)


def find(source: Source, pattern: ast.AST, selector: str | None = None) -> list[Match]:
    return find_all(source, [pattern], selector)[0]


def find_all(source: Source, patterns: list[ast.AST], selector: str | None = None) -> list[list[Match]]:
    """Matches of each pattern: one walk over the tree, where a node meets the patterns of its type only."""
    out: list[dict[tuple[int, int], Match]] = [{} for _ in patterns]
    heads = [_head(p) for p in patterns]
    anywhere = [i for i, h in enumerate(heads) if h is None]
    by_type: dict[type, list[int]] = {}
    for node in ast.walk(source.tree):
        if not hasattr(node, "lineno") or selector and type(node).__name__ != selector:
            continue
        if (own := by_type.get(type(node))) is None:
            own = by_type[type(node)] = sorted(anywhere + [i for i, h in enumerate(heads) if h is type(node)])
        for i in own:
            single: dict[str, str] = {}
            multi: dict[str, list[str]] = {}
            if _call_with_keywords(patterns[i], node, source, single, multi):
                a, b = source.span(node)
                out[i][a, b] = Match(a, b, node.lineno, single, multi)
    return [sorted(found.values(), key=lambda m: (m.start, m.end)) for found in out]


def _head(pattern: ast.AST) -> type | None:
    """The type that every match has; None if any may be one."""
    return None if _name(pattern, ONE) is not None else type(pattern)


def _dealt(docs: DataFrame) -> DataFrame:
    """doc_id and text over all cores: a small file is one task's, and parsing is far dearer than moving it."""
    return spread(docs.select(F.col("doc_id").cast("long"), "text"))


MATCHES = "doc_id long, start long, end long, line int, text string, single map<string,string>, multi map<string,array<string>>"


def _per_file(make: Callable[[int, str], list[tuple]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for r in make(i, t)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def ast_search(docs: DataFrame, pattern: str, selector: str | None = None) -> DataFrame:
    """Matches of a structural pattern; files that don't parse have none. docs: doc_id, text."""
    tree, literal = compile_pattern(pattern), literal_of(pattern)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("line", pa.int32()), ("text", pa.string()), ("single", pa.map_(pa.string(), pa.string())), ("multi", pa.map_(pa.string(), pa.list_(pa.string())))])

    def make(doc_id: int, text: str) -> list[tuple]:
        try:
            source = Source(text)
        except (SyntaxError, ValueError):
            return []
        return [(doc_id, m.start, m.end, m.line, source.raw[m.start : m.end].decode(), list(m.single.items()), list(m.multi.items())) for m in find(source, tree, selector)]

    own = _dealt(docs)
    return (own.filter(F.col("text").contains(literal)) if literal else own).mapInArrow(_per_file(make, schema), MATCHES)


def node_types(docs: DataFrame) -> DataFrame:
    """(doc_id, node_type, start, end, line) of every node, to be filtered by type."""
    schema = pa.schema([("doc_id", pa.int64()), ("node_type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("line", pa.int32())])

    def make(doc_id: int, text: str) -> list[tuple]:
        try:
            source = Source(text)
        except (SyntaxError, ValueError):
            return []
        return [(doc_id, type(n).__name__, *source.span(n), n.lineno) for n in ast.walk(source.tree) if hasattr(n, "lineno")]

    return _dealt(docs).mapInArrow(_per_file(make, schema), "doc_id long, node_type string, start long, end long, line int")


def compile_query(query: str) -> tuple:
    """A tree query `(Type field: value ...)`: a value is a query, `$name` (captured), `_` (anything) or a word that the field must equal. Nested queries without a field may lie anywhere below."""
    tokens = re.findall(r"[()]|[A-Za-z_$*][\w$*]*:?", query)
    if "".join(tokens) != re.sub(r"\s+", "", query):
        raise ValueError(f"not a tree query: {query}")
    at = 0

    def one() -> tuple:
        nonlocal at
        if at >= len(tokens) or tokens[at] != "(" or at + 1 >= len(tokens):
            raise ValueError(f"not a tree query: {query}")
        kind, fields, below = tokens[at + 1], [], []
        at += 2
        while at < len(tokens) and tokens[at] != ")":
            if tokens[at].endswith(":"):
                name = tokens[at][:-1]
                at += 1
                if at >= len(tokens) or tokens[at] == ")":
                    raise ValueError(f"not a tree query: {query}")
                if tokens[at] == "(":
                    fields.append((name, one()))
                else:
                    fields.append((name, tokens[at]))
                    at += 1
            else:
                below.append(one())
        if at >= len(tokens):
            raise ValueError(f"not a tree query: {query}")
        at += 1
        return kind, tuple(fields), tuple(below)

    found = one()
    if at != len(tokens):
        raise ValueError(f"not a tree query: {query}")
    return found


def _fits(query: tuple, node: object, source: Source, captures: dict[str, str]) -> bool:
    kind, fields, below = query
    if not isinstance(node, ast.AST) or kind != "_" and type(node).__name__ != kind:
        return False
    for name, want in fields:
        value = getattr(node, name, None)
        if value is None:
            return False
        if isinstance(want, tuple):
            if not any(_fits(want, x, source, captures) for x in (value if isinstance(value, list) else [value])):
                return False
        elif want.startswith("$"):
            captures[want[1:]] = value if isinstance(value, str) else ast.unparse(value) if isinstance(value, ast.AST) else str(value)
        elif want != "_" and str(value) != want:
            return False
    return all(any(x is not node and _fits(b, x, source, captures) for x in ast.walk(node)) for b in below)


def tree_query(docs: DataFrame, query: str) -> DataFrame:
    """(doc_id, line, node_type, captures) of the nodes that fit a tree query. Files that don't parse have none."""
    wanted = compile_query(query)
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("node_type", pa.string()), ("captures", pa.map_(pa.string(), pa.string()))])

    def make(doc_id: int, text: str) -> list[tuple]:
        try:
            source = Source(text)
        except (SyntaxError, ValueError):
            return []
        out = []
        for node in ast.walk(source.tree):
            captures: dict[str, str] = {}
            if _fits(wanted, node, source, captures):
                out.append((doc_id, getattr(node, "lineno", 1), type(node).__name__, list(captures.items())))
        return sorted(out, key=lambda r: r[1])

    return _dealt(docs).mapInArrow(_per_file(make, schema), "doc_id long, line int, node_type string, captures map<string,string>")


def plan_rewrites(matches: DataFrame, template: str) -> DataFrame:
    """Edits (doc_id, start, end, replacement) from matches; $X and $$$X in the template stand for what they matched."""
    out = F.lit("")
    at = 0
    for m in META.finditer(template):
        value = F.array_join(F.coalesce(F.try_element_at("multi", F.lit(m[1])), F.array().cast("array<string>")), ", ") if m[1] else F.coalesce(F.try_element_at("single", F.lit(m[2])), F.lit(""))
        out = F.concat(out, F.lit(template[at : m.start()]), value)
        at = m.end()
    return matches.select("doc_id", "start", "end", F.concat(out, F.lit(template[at:])).alias("replacement"))


def overlapping_files(edits: DataFrame) -> DataFrame:
    """Files with edits that overlap, which a batch rejects as a whole."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("start", "end")
    return edits.withColumn("_end", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("_end") > F.col("start")).select("doc_id").distinct()


def accepted_edits(edits: DataFrame) -> DataFrame:
    """Edits of a file in order, each that overlaps an accepted one left out: sequential in a file, so a task goes through its files in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, last = object(), -1
        for batch in batches:
            kept = []
            for i, (doc_id, start, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if doc_id != file:
                    file, last = doc_id, -1
                if start >= last:
                    kept.append(i)
                    last = end
            yield batch.take(pa.array(kept, pa.int64()))

    own = edits.select(*[F.col(c).cast("long").alias(c) for c in ("doc_id", "start", "end")], "replacement").repartition("doc_id")
    return own.sortWithinPartitions("doc_id", "start", "end", "replacement").mapInArrow(run, "doc_id long, start long, end long, replacement string")


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """A new version of the files that have edits: doc_id, text, diff. Edits must not overlap."""
    packed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("edits"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(packed, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, diffs = [], [], []
            for doc_id, text, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                parts, at = [], 0
                for e in own:
                    parts += [raw[at : e["start"]], e["replacement"].encode()]
                    at = e["end"]
                new = b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")
                ids.append(doc_id)
                texts.append(new)
                diffs.append("".join(difflib.unified_diff(text.splitlines(True), new.splitlines(True), f"a/{doc_id}", f"b/{doc_id}")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(diffs, pa.string())], ["doc_id", "text", "diff"])

    return joined.mapInArrow(run, "doc_id long, text string, diff string")


def verify_edits(before: DataFrame, after: DataFrame, edits: DataFrame) -> DataFrame:
    """Each edited file and whether its new text is the old one with the edits."""
    want = apply_edits(before, edits).select("doc_id", F.col("text").alias("_want"))
    return after.select("doc_id", "text").join(want, "doc_id").select("doc_id", (F.col("text") == F.col("_want")).alias("ok"))


def structural_chunks(docs: DataFrame, budget: int = 1200) -> DataFrame:
    """(doc_id, chunk_no, start_line, end_line) along top-level definitions, small neighbours merged up to a budget of characters without white space; what doesn't parse is one chunk per 30 lines."""
    schema = pa.schema([("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32())])

    def pieces(body: list[ast.stmt], lines: list[str], first: int, last: int) -> list[tuple[int, int]]:
        starts = [first] + [min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) for n in body[1:]]
        out = []
        for node, a, b in zip(body, starts, [*(s - 1 for s in starts[1:]), last], strict=True):
            inner = getattr(node, "body", None)
            if size(lines, a, b) > budget and isinstance(inner, list) and len(inner) > 1:
                out += pieces(inner, lines, a, b)
            else:
                out.append((a, b))
        return out

    def size(lines: list[str], a: int, b: int) -> int:
        return sum(len("".join(x.split())) for x in lines[a - 1 : b])

    def make(doc_id: int, text: str) -> list[tuple]:
        lines = text.split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        try:
            body = ast.parse(text).body
            found = pieces(body, lines, 1, len(lines)) if body else [(1, len(lines))]
        except (SyntaxError, ValueError):
            found = [(i + 1, min(i + 30, len(lines))) for i in range(0, len(lines), 30)]
        merged: list[list[int]] = []
        for a, b in found:
            if b < a:
                continue
            if merged and size(lines, merged[-1][0], b) <= budget:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        return [(doc_id, i, a, b) for i, (a, b) in enumerate(merged)]

    return _dealt(docs).mapInArrow(_per_file(make, schema), "doc_id long, chunk_no int, start_line int, end_line int")


def python_symbols(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, name, line): imports and definitions at any depth. Files that don't parse have none."""
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int32())])

    def make(doc_id: int, text: str) -> list[tuple]:
        try:
            tree = ast.parse(text.removeprefix("﻿"))
        except (SyntaxError, ValueError):
            return []
        out = []
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                out += [(doc_id, "import", a.name, n.lineno) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out.append((doc_id, "import", "." * n.level + (n.module or ""), n.lineno))
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((doc_id, "function", n.name, n.lineno))
            elif isinstance(n, ast.ClassDef):
                out.append((doc_id, "class", n.name, n.lineno))
        return sorted(out, key=lambda r: r[3])

    return _dealt(docs).mapInArrow(_per_file(make, schema), "doc_id long, kind string, name string, line int")


def python_references(docs: DataFrame, symbol: str) -> DataFrame:
    """(doc_id, line, kind) of a name's uses: call, type, field or value."""
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("kind", pa.string())])

    def make(doc_id: int, text: str) -> list[tuple]:
        try:
            tree = ast.parse(text.removeprefix("﻿"))
        except (SyntaxError, ValueError):
            return []
        called, typed = set(), set()
        for n in ast.walk(tree):
            if isinstance(n, ast.Call):
                called.add(id(n.func))
            for part in (getattr(n, "annotation", None), getattr(n, "returns", None)):
                if part is not None:
                    typed |= {id(x) for x in ast.walk(part)}
        out = []
        for n in ast.walk(tree):
            if isinstance(n, ast.Name) and n.id == symbol or isinstance(n, ast.Attribute) and n.attr == symbol:
                out.append((doc_id, n.lineno, "call" if id(n) in called else "type" if id(n) in typed else "field" if isinstance(n, ast.Attribute) else "value"))
        return sorted(out, key=lambda r: r[1])

    return _dealt(docs).filter(F.col("text").contains(symbol)).mapInArrow(_per_file(make, schema), "doc_id long, line int, kind string")


TOKEN = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*|\d+(?:\.\d+)?|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\S")
PAIRS = {"(": ")", "[": "]", "{": "}"}


def _group(tokens: list[str], at: int) -> int | None:
    """Behind the bracketed group that begins at `at`."""
    depth = 0
    for j in range(at, len(tokens)):
        depth += (tokens[j] in PAIRS) - (tokens[j] in PAIRS.values())
        if depth == 0:
            return j + 1
    return None


def _units(tokens: list[str], at: int) -> list[int]:
    """Where an expression from `at` on can end, the longest first: a token or group, then calls, indexes and fields."""
    if at >= len(tokens) or tokens[at] in PAIRS.values():
        return []
    end = _group(tokens, at) if tokens[at] in PAIRS else at + 1
    ends = []
    while end is not None:
        ends.append(end)
        if end < len(tokens) and tokens[end] in ("(", "["):
            end = _group(tokens, end)
        elif end + 1 < len(tokens) and tokens[end] == ".":
            end += 2
        else:
            break
    return ends[::-1]


def token_match(pattern: list[str], tokens: list[str], at: int) -> int | None:
    """Where a match of the token pattern from `at` on ends. $X is an expression, $$$X any balanced stretch."""
    if not pattern:
        return at
    if pattern[0].startswith("$$$"):
        j: int | None = at
        while j is not None:
            if (end := token_match(pattern[1:], tokens, j)) is not None:
                return end
            if j >= len(tokens) or tokens[j] in PAIRS.values():
                return None
            j = _group(tokens, j) if tokens[j] in PAIRS else j + 1
        return None
    if pattern[0] == "$STRING":
        return token_match(pattern[1:], tokens, at + 1) if at < len(tokens) and tokens[at][0] in "\"'`" else None
    if pattern[0].startswith("$"):
        return next((end for j in _units(tokens, at) if (end := token_match(pattern[1:], tokens, j)) is not None), None)
    return token_match(pattern[1:], tokens, at + 1) if at < len(tokens) and tokens[at] == pattern[0] else None


def token_search(docs: DataFrame, pattern: str) -> DataFrame:
    """Matches of a pattern of tokens in any language: doc_id, start, end (characters)."""
    own = TOKEN.findall(pattern)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def make(doc_id: int, text: str) -> list[tuple]:
        spans = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]
        tokens = [s[0] for s in spans]
        ends = ((i, token_match(own, tokens, i)) for i in range(len(tokens)) if own[0].startswith("$") or tokens[i] == own[0])
        return [(doc_id, spans[i][1], spans[e - 1][2]) for i, e in ends if e is not None and e > i]

    return _dealt(docs).mapInArrow(_per_file(make, schema), "doc_id long, start long, end long")


def structural_rules(pack: str, language: str) -> list[tuple[str, str, str]]:
    """(id, severity, pattern) of a pack for a language."""
    from lexloom.operators.rule_table import STRUCTURAL_RULES

    return [(f"{language}-{name}", severity, pattern) for p, languages, name, severity, pattern in STRUCTURAL_RULES if p == pack and language in languages]


def _token_pattern(pattern: str) -> list[str]:
    """Tokens of a pattern; a quoted metavariable stands for any string literal."""
    return ["$STRING" if META.fullmatch(t[1:-1]) and t[0] in "\"'" else t.removeprefix("$$") if t.startswith("$$$$") else t for t in TOKEN.findall(pattern)]


def scan_structural(docs: DataFrame, rules: list[tuple[str, str, str]], language: str) -> DataFrame:
    """(doc_id, rule_id, severity, line) of structural rules; a file is parsed, or cut into tokens, once for all of them. Findings can be rolled up as those of line rules."""
    schema = pa.schema([("doc_id", pa.int64()), ("rule_id", pa.string()), ("severity", pa.string()), ("line_no", pa.int32()), ("line", pa.string())])
    literals = [x for _, _, p in rules if (x := literal_of(p))]
    trees = [(i, s, compile_pattern(p)) for i, s, p in rules] if language == "python" else []
    patterns = [(i, s, _token_pattern(p)) for i, s, p in rules]

    def python(doc_id: int, text: str) -> list[tuple]:
        try:
            source = Source(text)
        except (SyntaxError, ValueError):
            return []
        lines = text.split("\n")
        found = find_all(source, [p for _, _, p in trees])
        return [(doc_id, i, s, m.line, lines[m.line - 1]) for (i, s, _), own in zip(trees, found, strict=True) for m in own]

    def tokens(doc_id: int, text: str) -> list[tuple]:
        spans = [(m[0], m.start()) for m in TOKEN.finditer(text)]
        own = [t for t, _ in spans]
        lines, out = text.split("\n"), []
        for i, s, pattern in patterns:
            for at in range(len(own)):
                if (pattern[0].startswith("$") or own[at] == pattern[0]) and token_match(pattern, own, at) is not None:
                    line = text.count("\n", 0, spans[at][1])
                    out.append((doc_id, i, s, line + 1, lines[line]))
        return out

    own = _dealt(docs)
    if len(literals) == len(rules):
        hit = F.lit(False)
        for x in sorted(set(literals)):
            hit = hit | F.col("text").contains(x)
        own = own.filter(hit)
    return own.mapInArrow(_per_file(python if language == "python" else tokens, schema), "doc_id long, rule_id string, severity string, line_no int, line string")
