"""Text functions, all of them built-in expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the log-level heuristic.
ERROR_PATTERN = r"\b(error|fail(ed|ure)?|fatal|exception)\b"
WARN_PATTERN = r"\b(warn(ing)?|degraded|slow)\b"


def split_lines(text: Column) -> Column:
    """Lines end at \\n only and keep a trailing \\r; one trailing empty element is dropped; empty text has none."""
    parts = F.split(text, "\n", -1)
    return F.when(text == "", F.slice(parts, 1, 0)).when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_terms(text: Column) -> Column:
    """Camel case, underscores and hyphens apart; runs of ASCII letters and digits; lower case."""
    spaced = F.translate(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), f"_-{UPPER}", f"  {LOWER}")
    return F.regexp_extract_all(spaced, F.lit("[a-z0-9]+"), F.lit(0))


def term_overlap(query_terms: Column, text_terms: Column) -> Column:
    """How many query terms, repeats counted, the text has."""
    return F.size(F.filter(query_terms, lambda t: F.array_contains(text_terms, t)))


def trigrams(line: Column) -> Column:
    """Distinct lower-case trigrams of characters. Characters are split once: taking substrings would read the line anew for each."""
    chars = F.split(F.lower(line), "")
    count = F.length(F.lower(line))
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), count), lambda a, b: F.concat(a, b))
    grams = F.zip_with(pairs, F.slice(chars, F.lit(3), count), lambda ab, c: F.concat(ab, c))
    return F.when(count >= 3, F.array_distinct(F.slice(grams, F.lit(1), count - 2))).otherwise(F.array().cast("array<string>"))


def byte_column(line: Column, at: Column) -> Column:
    """The 1-based UTF-8 byte column of the 1-based character position `at`."""
    return F.octet_length(F.substring(line, F.lit(1), at - 1)) + 1


def log_level(line: Column) -> Column:
    """error, warn or info with a confidence."""
    low = F.lower(line)
    return F.when(low.rlike(ERROR_PATTERN), level("error", 0.95)).when(low.rlike(WARN_PATTERN), level("warn", 0.85)).otherwise(level("info", 0.80))


def log_level_full(line: Column) -> Column:
    """The same with trace and debug, as the classify command has it."""
    low = F.lower(line)
    found = F.when(low.rlike(ERROR_PATTERN), level("error", 0.95)).when(low.rlike(WARN_PATTERN), level("warn", 0.85))
    return found.when(low.rlike(r"\btrace\b"), level("trace", 0.80)).when(low.rlike(r"\bdebug\b"), level("debug", 0.80)).otherwise(level("info", 0.80))


def level(label: str, confidence: float) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))


def snippet(text: Column, limit: int) -> Column:
    """White space squeezed, cut at limit characters, and whether it was cut."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    return F.struct(F.substring(flat, 1, limit).alias("snippet"), (F.length(flat) > limit).alias("truncated"))


def fallback_tokens(line: Column) -> Column:
    """Ids of the first 128 characters when no tokenizer is there; an empty line is [0]."""
    ids = F.transform(F.split(F.substring(line, 1, 128), ""), lambda c: F.greatest(F.lit(1), F.ascii(c) % 30522))
    return F.when(line == "", F.array(F.lit(0))).otherwise(ids)


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def top_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit("."))


def canonical_json(**fields: Column) -> Column:
    """Keys in order, with the separators ', ' and ': ' of canonical digests; string values."""
    parts = [F.concat(F.lit(f'"{k}": "'), fields[k].cast("string"), F.lit('"')) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def required_literal(pattern: str) -> str | None:
    """The longest literal that every match of a regular expression holds, or None if that can't be told safely.

    Only top-level runs of plain characters count; an alternation, a group or a flag gives None for what it touches.
    """
    if "|" in pattern or "(?" in pattern:
        return None
    best, run, depth, i = "", "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        nxt = pattern[i + 1] if i + 1 < len(pattern) else ""
        if c == "[":
            end = i + 2
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            best, run, i = max(best, run, key=len), "", end + 1
            continue
        if c == "\\" and nxt and not nxt.isalnum() and depth == 0:
            c, i = nxt, i + 1
            nxt = pattern[i + 1] if i + 1 < len(pattern) else ""
            plain = True
        else:
            plain = c not in "\\^$.*+?{}()[]"
        if plain and depth == 0:
            if nxt in ("*", "?", "{"):
                best, run = max(best, run, key=len), ""
            elif nxt == "+":
                best, run = max(best, run + c, key=len), ""
            else:
                run += c
        else:
            best, run = max(best, run, key=len), ""
            depth += (c == "(") - (c == ")")
            if c == "\\":
                i += 1
            elif c == "{":
                i = pattern.find("}", i) if "}" in pattern[i:] else i
        i += 1
    best = max(best, run, key=len)
    return best or None


def regex_quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)
