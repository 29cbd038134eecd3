"""Security scan: rules as arrays of matches found in one pass over the files, interval dedupe, suppressions, redaction, gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import text as tf
from weirflow.operators import kernels, sweep

MOST_FINDINGS = 500
#: Entropy, in bits a character, and length from which a value assigned to a key is a secret.
SECRET_ENTROPY, SECRET_LENGTH = 3.5, 20
DIRECTIVE = "weirflow"

# The shapes each rule looks for.
_ASSIGNED = rf"(?i){tf.SECRET_KEYS}\s*[:=]\s*['\"]([^'\"\s]{{{SECRET_LENGTH},}})['\"]"
_SQL_CALL = r"(?i)\b(?:execute|executemany|spark\.sql|read_sql|run_query)\s*\("
_SHELL = (
    r"\bos\.system\s*\(",
    r"\bsubprocess\.(?:run|call|Popen|check_output|check_call)\s*\([^)]*\bshell\s*=\s*True",
    r"\bsubprocess\.(?:run|call|Popen)\s*\(\s*(?!['\"\[\{])",
)
_CONNECTION = (
    r"\bjdbc:[^'\"\s]{8,}",
    r"\b(?:postgres(?:ql)?|mysql|mssql|mongodb(?:\+srv)?)://[^'\"\s@:/?#]+:[^'\"\s@:/?#]+@",
    r"(?i)\b(?:dsn|connect_string|conn_string|url|uri)\s*[:=]\s*['\"][^'\"]*(?:password|pwd)[^'\"]*['\"]",
)
_PLAINTEXT = (
    r"(?i)\bCREATE\s+(?:USER|ROLE|LOGIN)\b[^;]*\bIDENTIFIED\s+BY\s+['\"][^'\"]+['\"]",
    r"(?i)\bGRANT\b[^;]*\bIDENTIFIED\s+BY\s+['\"][^'\"]+['\"]",
)
# String literals, and the signs of a query put together from strings.
_LITERAL = r"f?[\"'](?:\\.|[^\"'\\])*[\"']"
_F_STRING = r"\bf[\"']"
_PUT_TOGETHER = r"\.format\s*\(|\+|%\s*[srdx]"
# How a rule is switched off, and for how many characters an argument list without an end is read.
_OFF = r"(?:--|#)\s*{}:off(-all)?(\s+[\w,\- ]+)?"
_OPEN_ARGUMENTS = 300
HINTS = {
    "SEC-001": "hardcoded secret; read it from the environment or a secret manager",
    "SEC-002": "SQL built from strings; pass parameters instead",
    "SEC-003": "shell or variable command; pass a list of arguments",
    "SEC-004": "credentials in a connection string; use a secret manager",
    "SEC-005": "plaintext credential in SQL; use a secret manager or hashed authentication",
}


_MATCH = "array<struct<severity:string,start:int,end:int,found:string>>"


def occurrences(text: Column, pattern: str, severity: str) -> Column:
    """array<struct<severity, start, end, found>> of the matches, offsets in code points: gaps and matches add up to the text."""
    none = F.array().cast(_MATCH)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    zipped = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))
    span = lambda acc, x: F.struct(F.lit(severity).alias("severity"), (acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + F.length(x["h"])).alias("end"), x["h"].alias("found"))
    placed = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["g"] + F.length(x["h"])).alias("at"), F.array_append(acc["out"], span(acc, x)).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), placed).otherwise(none)


def _any(severity: str, *patterns: str) -> Callable[[Column], Column]:
    return lambda text: F.concat(*(occurrences(text, p, severity) for p in patterns))


def _secrets(text: Column) -> Column:
    """SEC-001: known prefixes are critical, long values of high entropy assigned to a key are high."""
    assigned = F.filter(occurrences(text, _ASSIGNED, "high"), lambda m: tf.entropy(F.regexp_extract(m["found"], _ASSIGNED, 1)) >= SECRET_ENTROPY)
    return F.concat(occurrences(text, tf.SECRET_PREFIX, "critical"), assigned)


def _interpolated(text: Column) -> Column:
    """SEC-002: a query call whose arguments, up to the first `)`, hold an f-string, .format, + or a % conversion."""

    def arguments(m: Column) -> Column:
        rest = F.substring(text, m["end"] + 1, F.length(text))
        close = F.instr(rest, ")")
        return F.when(close > 0, F.substring(rest, F.lit(1), close - 1)).otherwise(F.substring(rest, 1, _OPEN_ARGUMENTS))

    unsafe = lambda m: arguments(m).rlike(_F_STRING) | F.regexp_replace(arguments(m), _LITERAL, '""').rlike(_PUT_TOGETHER)
    grown = lambda m: F.struct(m["severity"].alias("severity"), m["start"].alias("start"), (m["end"] + F.length(arguments(m))).cast("int").alias("end"), m["found"].alias("found"))
    return F.transform(F.filter(occurrences(text, _SQL_CALL, "high"), unsafe), grown)


#: Rule id to (matches of a text, SQL files only), in order.
RULES: dict[str, tuple[Callable[[Column], Column], bool]] = {
    "SEC-001": (_secrets, False),
    "SEC-002": (_interpolated, False),
    "SEC-003": (_any("high", *_SHELL), False),
    "SEC-004": (_any("medium", *_CONNECTION), False),
    "SEC-005": (_any("medium", *_PLAINTEXT), True),
}


def matches(files: DataFrame, rules: list[str] | None = None, catalog: dict | None = None) -> DataFrame:
    """Raw matches of the enabled rules over (path, ext, content), all found in one pass; a disabled rule costs nothing.

    `catalog` adds or replaces rules of a pack: rule id to (content column -> array of matches, SQL files only).
    """
    catalog = RULES | (catalog or {})
    unknown = set(rules or []) - set(catalog)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    text = F.col("content")
    none = F.array().cast(_MATCH.replace("severity", "rule_id:string,severity"))

    def of(name: str) -> Column:
        scan_text, sql_only = catalog[name]
        one = F.transform(scan_text(text), lambda m: F.struct(F.lit(name).alias("rule_id"), *(m[c].alias(c) for c in ("severity", "start", "end", "found"))))
        return F.when(F.col("ext") == "sql", one).otherwise(none) if sql_only else one

    found = [of(name) for name in catalog if not rules or name in rules]
    return files.withColumn("m", F.explode(F.concat(*found))).select(*(F.col(c) for c in files.columns), "m.rule_id", "m.severity", "m.start", "m.end", "m.found")


def secrets(files: DataFrame) -> DataFrame:
    return matches(files, ["SEC-001"])


def dedupe(found: DataFrame, keys: tuple[str, ...] = ("path", "rule_id")) -> DataFrame:
    """Overlapping spans of a file and rule: earlier or as severe ones win, a more severe one takes the place of what it overlaps."""
    return sweep.disjoint(found, keys, ["start", "end"], rank())


def suppressed(directive: str = DIRECTIVE) -> Column:
    """Whether the line of a match (content, start, rule_id) switches its rule off, or its file switches off all."""
    shape = _OFF.format(directive)
    line = tf.line_text("content", "start")
    ids = F.split(F.trim(F.regexp_extract(line, shape, 2)), r"[\s,]+")
    whole = _OFF.format(directive).replace("(-all)?", "-all")
    return F.when(F.instr("content", f"{directive}:off") > 0, F.array_contains(ids, F.col("rule_id")) | F.col("content").rlike(whole)).otherwise(False)


def scan(files: DataFrame, rules: list[str] | None = None, directive: str = DIRECTIVE, catalog: dict | None = None) -> DataFrame:
    """Findings of (path, ext, content): deduped, with line and column, redacted snippet, hint and status.

    Everything that needs the text is worked out beside it, so texts are read once and only matches are shuffled.
    """
    status = F.when(suppressed(directive), "suppressed").otherwise("open")
    found = matches(files, rules, catalog).withColumns({"line": tf.line_of("content", "start").cast("int"), "col": tf.column_of("content", "start").cast("int"), "snippet_redacted": tf.redact(tf.line_text("content", "start")), "status": status})
    kept = dedupe(found.select("path", "rule_id", "severity", "start", "end", "line", "col", "snippet_redacted", "status"))
    hint = F.element_at(F.create_map(*(F.lit(x) for kv in HINTS.items() for x in kv)), F.col("rule_id"))
    return kept.select("rule_id", "severity", "path", "line", "col", F.struct("start", "end").alias("span"), "snippet_redacted", hint.alias("hint"), "status")


def rank(severity: str = "severity"):
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in kernels.SEVERITY.items() for x in kv)), F.col(severity)), F.lit(0))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(rank() >= kernels.SEVERITY.get(severity, 0))


def gate(findings: DataFrame, severity: str) -> DataFrame:
    """One row (failed): whether an open finding is as severe as asked; `none` never fails."""
    if severity == "none":
        return findings.agg(F.lit(False).alias("failed"))
    return findings.agg(F.coalesce(F.bool_or((F.col("status") == "open") & (rank() >= kernels.SEVERITY[severity])), F.lit(False)).alias("failed"))


def histogram(findings: DataFrame) -> DataFrame:
    """One row of counts: critical, high, medium, low of the open ones, and suppressed."""
    open_ = F.col("status") == "open"
    return findings.agg(*(F.count_if(open_ & (F.col("severity") == s)).alias(s) for s in kernels.SEVERITY), F.count_if(~open_).alias("suppressed"))


def open_by_rule(findings: DataFrame, run: str = "run") -> DataFrame:
    """(severity, rule_id, n) of the open findings of the latest run, the most severe and then the most frequent first."""
    latest = findings.agg(F.max(run).alias(run))  # one row
    counted = findings.join(F.broadcast(latest), run).where("status = 'open'").groupBy("severity", "rule_id").agg(F.count("*").alias("n"))
    return counted.orderBy(rank().desc(), F.col("n").desc(), "rule_id")


def new_since(now: DataFrame, baseline: DataFrame, keys: tuple[str, ...] = ("rule_id", "path", "line", "col")) -> DataFrame:
    return now.where("status = 'open'").join(baseline.where("status = 'open'"), list(keys), "left_anti")
