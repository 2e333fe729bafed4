"""Rule packs over lines: matches, findings, baselines, suppressions, export."""

from __future__ import annotations

import functools
import json
import operator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import canonical_json, required_literal
from lexloom.operators.search import lines


@dataclass(frozen=True)
class Rule:
    """A line matches if any of the patterns does; `valid` and `invalid` are snippets for its own test."""

    id: str
    patterns: tuple[str, ...]
    severity: str = "medium"
    message: str = ""
    language: str = "any"
    valid: tuple[str, ...] = ()
    invalid: tuple[str, ...] = ()


# Patterns of the regular-expression rules for secrets, and calls that the packs name.
# Patterns of assigned tokens and passwords.
TOKEN_ASSIGNED = r"""\btoken\s*=\s*["'][^"']+["']"""
PASSWORD_ASSIGNED = r"""\bpassword\s*=\s*["'][^"']+["']"""
PROVIDER_TOKEN = r"\bsk_(?:live|test)_[A-Za-z0-9_=-]{8,}\b"
NAMED_KEY = r"\b[A-Za-z_][A-Za-z0-9_]*(?:api_key|API_KEY|access_token|ACCESS_TOKEN)\s*=\s*['\"][^'\"\s]{8,}['\"]"
DANGEROUS_CALLS = {
    "auth": ("eval", "exec"),
    "crypto": ("hashlib.md5", "hashlib.sha1"),
    "deserialization": ("pickle.loads", "pickle.load", "yaml.load", "marshal.loads"),
    "subprocess": ("os.system", "os.popen", "subprocess.getoutput"),
    "tls": ("ssl._create_unverified_context",),
}

PACKS: dict[str, tuple[Rule, ...]] = {
    "secrets": (
        Rule("hardcoded-provider-token", (PROVIDER_TOKEN,), "high", "Avoid hardcoding provider tokens.", invalid=("key = 'sk_live_abcdefgh1'",), valid=("key = load()",)),
        Rule("hardcoded-named-api-key", (NAMED_KEY,), "high", "Avoid hardcoding named keys.", invalid=("my_api_key = 'abcdefgh1'",), valid=("my_api_key = env('K')",)),
        Rule("hardcoded-token", (TOKEN_ASSIGNED,), "medium", "Avoid hardcoding tokens.", invalid=('token = "x"',), valid=("token = x",)),
        Rule("hardcoded-password", (PASSWORD_ASSIGNED,), "medium", "Avoid hardcoding passwords.", invalid=("password = 'x'",), valid=("password = ask()",)),
    ),
} | {
    pack: tuple(Rule(f"{pack}-{call.replace('.', '-').strip('_')}", (rf"(?:^|[^A-Za-z0-9_.]){call.replace('.', '[.]')}[(]",), "high", f"Don't call {call} with untrusted input.", "python", (f"my_{call.split('.')[-1]}(x)",), (f"{call}(x)",)) for call in calls)
    for pack, calls in DANGEROUS_CALLS.items()
}
ALIASES = {"auth-safe": "auth", "crypto-safe": "crypto", "secrets-basic": "secrets", "deserialization-safe": "deserialization", "subprocess-safe": "subprocess", "tls-safe": "tls"}


def pack(name: str, language: str | None = None) -> tuple[Rule, ...]:
    found = PACKS.get(ALIASES.get(name, name))
    if found is None:
        raise KeyError(f"no rule pack {name}; there are {', '.join(sorted(PACKS))}")
    return tuple(r for r in found if language is None or r.language in ("any", language))


def match_rules(docs: DataFrame, rules: tuple[Rule, ...], *keep: str) -> DataFrame:
    """A row for each line and rule: rule_id, severity, doc_id, line_no, line. Rules are expressions of the plan; lines are tested where they are read."""

    def hit(rule: Rule):
        return functools.reduce(operator.or_, (F.col("line").rlike(p) for p in rule.patterns))

    literals = [required_literal(p) for r in rules for p in r.patterns]
    if literals and all(literals):
        docs = docs.filter(functools.reduce(operator.or_, (F.col("text").contains(x) for x in dict.fromkeys(literals))))
    found = F.array_compact(F.array(*[F.when(hit(r), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in rules]))
    own = lines(docs, *keep).select("doc_id", *keep, "line_no", "line", F.explode(found).alias("r"))
    return own.select("r.rule_id", "r.severity", "doc_id", *keep, "line_no", "line")


def findings(matches: DataFrame, evidence: int = 3) -> DataFrame:
    """One row per rule: matches, files, and the first lines as evidence. Counts per document come first, so a rule that matches everywhere is no hot key."""
    first = F.min_by("line", "line_no").alias("snippet")
    per = matches.groupBy("rule_id", "severity", "doc_id").agg(F.count("*").alias("n"), first)
    totals = per.groupBy("rule_id", "severity").agg(F.sum("n").alias("matches"), F.count("*").alias("files"))
    ranked = per.withColumn("_r", F.row_number().over(Window.partitionBy("rule_id").orderBy("doc_id"))).filter(F.col("_r") <= evidence)
    shown = ranked.groupBy("rule_id").agg(F.sort_array(F.collect_list("doc_id")).alias("evidence"))
    return totals.join(shown, "rule_id")


def with_fingerprint(matches: DataFrame) -> DataFrame:
    return matches.withColumn("fingerprint", F.sha2(canonical_json(rule_id=F.col("rule_id"), file=F.col("doc_id"), snippet=F.trim("line")), 256))


def status(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """fingerprint and status: existing, new or resolved."""
    a = found.select("fingerprint").distinct().withColumn("_now", F.lit(True))
    b = baseline.select("fingerprint").distinct().withColumn("_before", F.lit(True))
    both = a.join(b, "fingerprint", "full_outer")
    return both.select("fingerprint", F.when(F.col("_now") & F.col("_before"), "existing").when(F.col("_now"), "new").otherwise("resolved").alias("status"))


def unsuppressed(found: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings that no suppression covers; rule, file and line of a suppression are wild where null."""
    s = suppressions.alias("s")
    f = found.alias("f")
    wild = lambda a, b: F.col(f"s.{a}").isNull() | (F.col(f"s.{a}") == F.col(f"f.{b}"))
    return f.join(s, (F.col("f.fingerprint") == F.col("s.fingerprint")) & wild("rule_id", "rule_id") & wild("file", "doc_id") & wild("line", "line_no"), "left_anti")


def inline_ignored(docs: DataFrame, matches: DataFrame, marker: str = "lint-ignore") -> DataFrame:
    """Matches on a line that has `marker: rule, rule` or `marker: *`, or below one."""
    note = F.regexp_extract("line", rf"{marker}:\s*([A-Za-z0-9_*, -]+)", 1)
    marks = lines(docs.filter(F.col("text").contains(marker))).select("doc_id", "line_no", note.alias("note")).filter("note <> ''")
    marks = marks.select("doc_id", F.explode(F.array(F.col("line_no"), F.col("line_no") + 1)).alias("line_no"), F.explode(F.split(F.trim("note"), r"\s*,\s*")).alias("rule"))
    joined = matches.join(marks, ["doc_id", "line_no"]).filter((F.col("rule") == "*") | (F.col("rule") == F.col("rule_id")))
    return joined.select("rule_id", "doc_id", "line_no").distinct()


def test_rules(spark, rules: tuple[Rule, ...]) -> DataFrame:
    """rule_id, kind, snippet and whether the rule does what its snippet expects."""
    rows = [(r.id, kind, s, kind == "invalid", list(r.patterns)) for r in rules for kind, snippets in (("valid", r.valid), ("invalid", r.invalid)) for s in snippets]
    own = spark.createDataFrame(rows, "rule_id string, kind string, snippet string, expected boolean, patterns array<string>")
    matched = F.exists("patterns", lambda p: F.rlike("snippet", p))
    return own.select("rule_id", "kind", "snippet", (matched == F.col("expected")).alias("ok"))


def sarif(found: DataFrame, tool: str = "lexloom") -> str:
    """SARIF 2.1.0 of findings (rule_id, severity, matches, files, evidence): one row per rule, so it is bounded by the rules."""
    level = {"high": "error", "medium": "warning", "low": "note"}
    rows = found.orderBy("rule_id").collect()
    results = [
        {"ruleId": r["rule_id"], "level": level.get(r["severity"], "warning"), "message": {"text": f"{r['matches']} matches in {r['files']} files"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": str(e)}}} for e in r["evidence"]]}
        for r in rows
    ]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": r["rule_id"]} for r in rows]}}, "results": results}]})


def gate(found: DataFrame, worst: str = "high") -> DataFrame:
    """One row: whether no finding is of the severity that blocks."""
    return found.agg((F.count_if(F.col("severity") == worst) == 0).alias("passed"), F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"))


def run_commands(commands: dict[str, str], folder: str, seconds: float = 300.0) -> list[tuple[str, int | None, str]]:
    """(name, exit code or None if it ran too long, last lines) of lint and test commands, one after another in a folder of the driver."""
    import shlex
    import subprocess

    out = []
    for name, command in commands.items():
        try:
            done = subprocess.run(shlex.split(command), cwd=folder, capture_output=True, text=True, timeout=seconds, check=False)
            out.append((name, done.returncode, "\n".join((done.stdout + done.stderr).splitlines()[-20:])))
        except subprocess.TimeoutExpired:
            out.append((name, None, f"stopped after {seconds} s"))
        except OSError as error:
            out.append((name, 127, str(error)))
    return out


def policy(found: DataFrame, commands: dict[str, str], folder: str, worst: str = "high", seconds: float = 300.0) -> tuple[bool, list[tuple[str, bool, str]]]:
    """Whether a change may be applied, and each check (name, passed, why): the rules first, then lint and test commands. All are run, so that all reasons are told."""
    scan = gate(found, worst).first()
    checks = [("rules", scan["passed"], "" if scan["passed"] else f"findings of severity {worst}")]
    for name, code, text in run_commands(commands, folder, seconds):
        checks.append((name, code == 0, "" if code == 0 else text if code is None else f"exit code {code}: {text}"))
    return all(ok for _, ok, _ in checks), checks
