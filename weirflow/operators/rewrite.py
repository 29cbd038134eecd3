"""Rewrite rules over SQL text: candidates, overlap resolution, security overlay, plans, application."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions import text as tf
from weirflow.operators import history, security, sweep
from weirflow.operators.tokens import Token, closing, tokenize

TIERS = {"safe": 0, "suggested": 1, "risky": 2}
MOST_CANDIDATES = 500
PLAN_SCHEMA = "weirflow.plan.v1"

# Statements with side effects, and words that are never identifiers.
SIDE_EFFECTS = re.compile(r"\b(insert|update|delete|merge|truncate|drop|alter|grant|revoke|call)\b", re.I)
KEYWORDS = frozenset(
    "ALL AND ANY AS ASC BETWEEN BY CASE CAST COUNT CREATE CROSS CURRENT DESC DISTINCT ELSE END EXCEPT EXISTS EXTRACT FALSE FETCH FIRST FOLLOWING FROM FULL GROUP HAVING IN INNER INTERSECT INTERVAL INTO IS JOIN LAST LATERAL LEFT LIKE LIMIT MATERIALIZED MAX MIN MINUS NATURAL NOT NULL NULLS OFFSET ON OR ORDER OUTER OVER PARTITION PRECEDING QUALIFY RANGE RECURSIVE REPLACE RIGHT ROW ROWS SELECT SET SUM TABLE TEMP TEMPORARY THEN TRUE UNBOUNDED UNION USING VALUES VIEW WHEN WHERE WINDOW WITH AVG COALESCE".split()
)
_ENDS = ("FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "MINUS", "QUALIFY", "WINDOW", "FETCH")
_SETS = ("UNION", "INTERSECT", "EXCEPT", "MINUS")


class Edit(NamedTuple):
    rule_id: str
    tier: str
    start: int
    end: int
    before: str
    after: str
    reason: str


class Cte(NamedTuple):
    name: str
    first: int  # places of the name, the opening and the closing bracket
    open: int
    close: int


def _edit(text: str, rule: str, start: int, end: int, after: str, reason: str) -> Edit:
    return Edit(rule, RULES[rule][0], start, end, text[start:end], after, reason)


def ctes(toks: list[Token]) -> tuple[int, list[Cte]]:
    """Place of the leading WITH (-1 without one) and its definitions."""
    at = next((i for i, t in enumerate(toks) if t.is_("WITH") and t.depth == 0), -1)
    out: list[Cte] = []
    i = at + 1 + (at >= 0 and at + 1 < len(toks) and toks[at + 1].is_("RECURSIVE"))
    while at >= 0 and i + 1 < len(toks) and toks[i].kind in ("word", "quoted"):
        k = i + 1
        while k < len(toks) and toks[k].is_("AS", "NOT", "MATERIALIZED"):
            k += 1
        end = closing(toks, k) if k < len(toks) and toks[k].value == "(" else None
        if end is None:
            break
        out.append(Cte(toks[i].value.strip('"`'), i, k, end))
        i = end + 1
        if i >= len(toks) or toks[i].value != ",":
            break
        i += 1
    return at, out


def _uses(toks: list[Token], name: str, skip: range = range(0)) -> list[int]:
    return [i for i, t in enumerate(toks) if i not in skip and t.kind == "word" and t.value.lower() == name.lower()]


def _first_select(toks: list[Token]) -> int | None:
    return next((i for i, t in enumerate(toks) if t.is_("SELECT") and t.depth == 0), None)


def _until_unmatched(toks: list[Token]) -> Iterator[Token]:
    """The tokens up to a semicolon, or a bracket that closes none of theirs."""
    opened = 0
    for t in toks:
        opened += (t.value in ("(", "[")) - (t.value in (")", "]"))
        if opened < 0 or t.value == ";":
            return
        yield t


def _items(toks: list[Token]) -> list[list[Token]]:
    """Items of the first SELECT at depth 0."""
    at = _first_select(toks)
    out: list[list[Token]] = [[]]
    for t in _until_unmatched(toks[at + 1 :] if at is not None else []):
        if t.depth == 0 and t.is_(*_ENDS):
            break
        if t.depth == 0 and t.value == ",":
            out.append([])
        elif not (t.is_("ALL", "DISTINCT") and not out[-1] and len(out) == 1):
            out[-1].append(t)
    return [x for x in out if x]


def _from_items(toks: list[Token]) -> list[list[Token]]:
    """Relations of the first FROM at depth 0: comma or JOIN separated, without their conditions."""
    at = next((i for i, t in enumerate(toks) if t.is_("FROM") and t.depth == 0), None)
    out: list[list[Token]] = [[]]
    on = False
    for t in _until_unmatched(toks[at + 1 :] if at is not None else []):
        if t.depth == 0:
            if t.is_(*_ENDS[1:]):
                break
            if t.value == "," or t.is_("JOIN"):
                out.append([])
                on = False
                continue
            if t.is_("ON", "USING"):
                on = True
            if t.is_("INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "NATURAL"):
                on = True
                continue
        if not on:
            out[-1].append(t)
    return [x for x in out if x]


def _target(item: list[Token]) -> str | None:
    if item[0].kind == "template":
        m = re.search(r"\bref\s*\(\s*['\"]([^'\"]+)['\"]", item[0].value)
        return m.group(1).lower() if m else None
    return item[0].value.strip('"`').lower() if item[0].kind in ("word", "quoted") else None


def _alias(item: list[Token]) -> tuple[Token, Token | None] | None:
    """(alias, AS) of a plain relation."""
    if len(item) >= 3 and item[-2].is_("AS") and item[-1].kind == "word" and item[-1].depth == 0:
        return item[-1], item[-2]
    if len(item) == 2 and item[0].kind in ("word", "quoted", "template") and item[1].kind == "word" and item[1].value.upper() not in KEYWORDS:
        return item[1], None
    return None


def _named(toks: list[Token], name: str, skip: range) -> bool:
    """Whether a token outside `skip` names it: a word, a quoted identifier, or a word inside a template."""
    wanted = name.lower()
    for i, t in enumerate(toks):
        if i in skip:
            continue
        if t.kind == "quoted" and t.value[1:-1].lower() == wanted:
            return True
        if t.kind == "word" and t.value.lower() == wanted:
            return True
        if t.kind == "template" and wanted in (w.lower() for w in re.findall(r"[^\W\d]\w*", t.value)):
            return True
    return False


def dead_ctes(text: str, toks: list[Token], schemas: dict[str, list[str]]) -> Iterator[Edit]:
    at, found = ctes(toks)
    for n, c in enumerate(found):
        if _named(toks, c.name, range(c.first, c.close + 1)) or SIDE_EFFECTS.search(text[toks[c.open].start : toks[c.close].end]):
            continue
        if len(found) == 1:
            span = toks[at].start, toks[c.close].end
        elif n + 1 < len(found):
            span = toks[c.first].start, toks[found[n + 1].first].start
        else:
            span = toks[found[n - 1].close].end, toks[c.close].end
        yield _edit(text, "REF-001", *span, "", f"CTE {c.name} is never read")


def repeated_items(text: str, toks: list[Token], schemas: dict[str, list[str]]) -> Iterator[Edit]:
    seen: set[tuple[str, str]] = set()
    items = _items(toks)
    for n, item in enumerate(items):
        named = len(item) > 2 and item[-2].is_("AS")
        expr, alias = (item[:-2], item[-1].value.lower()) if named else (item, "")
        key = " ".join(text[expr[0].start : expr[-1].end].split()).lower(), alias
        if key in seen and n:
            yield _edit(text, "REF-002", items[n - 1][-1].end, item[-1].end, "", "column is selected twice")
        seen.add(key)


def single_use_ctes(text: str, toks: list[Token], schemas: dict[str, list[str]]) -> Iterator[Edit]:
    for c in ctes(toks)[1]:
        own = range(c.first, c.close + 1)
        body = toks[c.open + 1 : c.close]
        uses = _uses(toks, c.name, own)
        raw = text[toks[c.open].start : toks[c.close].end]
        quoted = any(t.kind == "quoted" and t.value.strip('"`').lower() == c.name.lower() for t in toks)
        blocked = any(t.is_("LIMIT", "UNION") for t in body) or any(a.is_("ORDER") and b.is_("BY") for a, b in zip(body, body[1:], strict=False))
        if len(uses) == 1 and not blocked and not quoted and not _uses(body, c.name) and not SIDE_EFFECTS.search(raw):
            yield _edit(text, "REF-003", toks[uses[0]].start, toks[uses[0]].end, raw, f"CTE {c.name} is read once")


def lower_names(text: str, toks: list[Token], schemas: dict[str, list[str]]) -> Iterator[Edit]:
    names = [t for t in toks if t.kind == "word" and t.value.upper() not in KEYWORDS and t.value != t.value.lower()]
    if names:
        start, end = names[0].start, names[-1].end
        out, at = [], start
        for t in names:
            out += [text[at : t.start], t.value.lower()]
            at = t.end
        yield _edit(text, "REF-004", start, end, "".join(out), "identifiers are not lower case")


def expand_stars(text: str, toks: list[Token], schemas: dict[str, list[str]]) -> Iterator[Edit]:
    relations = _from_items(toks)
    for item in _items(toks):
        if item[-1].value != "*" or len(item) not in (1, 3):
            continue
        owner = item[0].value if len(item) == 3 else None
        if owner is None and len(relations) != 1:
            continue
        known = None
        for r in relations:
            named = _alias(r)
            if owner is None or owner.lower() in ((named[0].value.lower() if named else None), _target(r)):
                known = schemas.get(_target(r) or "")
                break
        if known:
            lead = f"{owner}." if owner else ""
            end = item[-1].end
            while end < len(text) and text[end] in " \t":
                end += 1
            yield _edit(text, "REF-005", item[0].start, end if owner is None else item[-1].end, ", ".join(lead + c for c in sorted(known)), "star hides the columns")


def dead_aliases(text: str, toks: list[Token], schemas: dict[str, list[str]]) -> Iterator[Edit]:
    for r in _from_items(toks):
        named = _alias(r)
        if named and len(_uses(toks, named[0].value)) == 1:
            start = r[-3].end if named[1] else named[0].start
            yield _edit(text, "REF-006", start, named[0].end, "", f"alias {named[0].value} is never used")


def subquery_sorts(text: str, toks: list[Token], schemas: dict[str, list[str]]) -> Iterator[Edit]:
    if SIDE_EFFECTS.search(text):
        return
    for i, t in enumerate(toks):
        end = closing(toks, i) if t.value == "(" else None
        if end is None or i + 1 >= end or not toks[i + 1].is_("SELECT", "WITH"):
            continue
        body = range(i + 1, end)
        level = t.depth + 1
        here = [k for k in body if toks[k].depth == level]
        sort = next((k for k in here if toks[k].is_("ORDER") and k + 1 < end and toks[k + 1].is_("BY")), None)
        if sort is None or any(toks[k].is_(*_SETS) for k in here) or any(toks[k].kind == "template" for k in body):
            continue
        if any(toks[k].is_("LIMIT", "OFFSET", "FETCH", "FOR", "ROWS", "WINDOW", "QUALIFY") for k in here if k > sort):
            continue
        yield _edit(text, "REF-007", toks[sort - 1].end, toks[end].start, "", "sorting a subquery has no effect")


Rule = Callable[[str, list[Token], dict[str, list[str]]], Iterable[Edit]]
#: Rule id to (tier, function); plug-ins are added by `weirflow.operators.plugins`.
RULES: dict[str, tuple[str, Rule]] = {
    "REF-001": ("safe", dead_ctes),
    "REF-002": ("safe", repeated_items),
    "REF-003": ("suggested", single_use_ctes),
    "REF-004": ("safe", lower_names),
    "REF-005": ("risky", expand_stars),
    "REF-006": ("safe", dead_aliases),
    "REF-007": ("suggested", subquery_sorts),
}


def choose(rule_ids: list[str] | None, most_tier: str = "risky", rules: dict | None = None) -> dict[str, tuple[str, Rule]]:
    rules = RULES if rules is None else rules
    unknown = set(rule_ids or []) - set(rules)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    return {k: v for k, v in rules.items() if (not rule_ids or k in rule_ids) and TIERS[v[0]] <= TIERS[most_tier]}


def analyse_text(text: str, schemas: dict[str, list[str]] | None = None, rules: dict | None = None) -> list[Edit]:
    toks = tokenize(text)
    return [e for _, f in (rules or RULES).values() for e in f(text, toks, schemas or {})]


_CANDIDATE = "path string, stage string, rule_id string, tier string, start int, end int, before string, after string, reason string"


def candidates(stages: DataFrame, rule_ids: list[str] | None = None, most_tier: str = "risky", rules: dict | None = None) -> DataFrame:
    """Every edit the rules propose for (path, name, raw, columns). Rules above the tier are not run.

    A file meets the schemas of the stages it reads by joins on its references, so no table of all schemas is sent around.
    """
    chosen = choose(rule_ids, most_tier, rules)
    named = stages.groupBy(F.col("name").alias("ref")).agg(F.max_by("columns", "path").alias("columns"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("raw"), F.lit(r"[\p{L}_][\p{L}\p{N}_]*"), 0))
    if "REF-005" in chosen or rules is not None:
        stars = stages.where(F.col("raw").contains("*")).select("path", F.explode(words).alias("ref")).join(named, "ref")
        known = stars.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("ref", "columns"))).alias("known"))
        rows = stages.join(known, "path", "left").select("path", "name", "raw", "known")
    else:
        rows = stages.select("path", "name", "raw", F.lit(None).cast("map<string,array<string>>").alias("known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, name, raw, known in zip(pdf["path"], pdf["name"], pdf["raw"], pdf["known"], strict=True):
                schemas = {k: list(v) for k, v in (dict(known) if known is not None else {}).items()}
                out += [(path, name, *e) for e in analyse_text(raw or "", schemas, chosen)]
            yield pd.DataFrame(out, columns=["path", "stage", "rule_id", "tier", "start", "end", "before", "after", "reason"])

    return rows.mapInPandas(run, _CANDIDATE)


def table_function(rules: dict[str, tuple[str, Rule]] | None = None):
    """The rules as a Python table function, (raw) to rows of (rule_id, tier, start, end, before, after, reason).

    Register it with `spark.udtf.register(name, ...)` and join it laterally: `from files, lateral name(files.raw)`.
    """
    chosen = rules or RULES

    @F.udtf(returnType="rule_id string, tier string, start int, end int, before string, after string, reason string")
    class Rules:
        def eval(self, raw: str):
            yield from (tuple(e) for e in analyse_text(raw or "", {}, chosen))

    return Rules


def disjoint(found: DataFrame) -> DataFrame:
    """Candidates without overlaps in a file: in order of start, length and rule the first wins."""
    return sweep.disjoint(found, ("path",), ["start", F.col("end") - F.col("start"), "rule_id"])


def overlay(found: DataFrame, findings: DataFrame, allow: bool = False) -> DataFrame:
    """`found` with blocked and security_note: an edit over an open finding of high severity is blocked, over others noted."""
    spans = findings.select(F.col("path").alias("_fp"), F.col("span.start").alias("fs"), F.col("span.end").alias("fe"), F.col("rule_id").alias("finding"), "severity", "status")
    serious = (F.col("status") == "open") & F.col("severity").isin("high", "critical")
    hit = found.join(spans, (F.col("path") == F.col("_fp")) & (F.col("start") < F.col("fe")) & (F.col("fs") < F.col("end")), "left").drop("_fp")
    grouped = hit.groupBy(*found.columns).agg(F.coalesce(F.bool_or(serious), F.lit(False)).alias("serious"), F.array_join(F.array_sort(F.collect_set("finding")), ",").alias("notes"))
    return grouped.withColumns({"blocked": F.col("serious") & F.lit(not allow), "security_note": F.when(F.col("notes") != "", F.concat(F.lit("overlaps "), "notes"))}).drop("serious", "notes")


def plan(found: DataFrame) -> DataFrame:
    """Numbered plan items, c0, c1, ... in order of path, start and rule, with their hashes; no task sees all of them."""
    body = tf.canonical_json([F.col(c) for c in ("after", "before", "end", "path", "reason", "rule_id", "stage", "start", "tier")])
    placed = history.numbered(found, ["path", "start", "rule_id"]).withColumn("ordinal", F.substring("change_id", 2, 20).cast("int"))
    return placed.withColumns({"item_hash": tf.sha256_hex(body), "rule_version": F.lit(1)})


def plan_hash(items: DataFrame, root: str, pipeline_fingerprint: str, most_tier: str) -> DataFrame:
    hashes = F.array_sort(F.collect_list(F.struct("ordinal", "item_hash")))
    return items.agg(tf.sha256_hex(F.concat_ws("\n", F.lit(PLAN_SCHEMA), F.lit(root), F.lit(pipeline_fingerprint), F.lit(most_tier), F.transform(hashes, lambda h: h["item_hash"]))).alias("plan_hash"))


def apply(files: DataFrame, items: DataFrame) -> DataFrame:
    """(path, raw, rewritten, edits, status) of the files that items touch: all of a file's items or none.

    Edits go from the last to the first. A file is `stale` if some span no longer holds its text, `noop` if nothing changes.
    """
    edits = items.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end", "before", "after")), asc=False).alias("edits"))
    joined = files.select("path", "raw").join(edits, "path")
    sound = F.forall("edits", lambda e: F.substring(F.col("raw"), e["start"] + 1, e["end"] - e["start"]) == e["before"])
    text = F.aggregate("edits", F.col("raw"), lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["after"], F.substring(t, e["end"] + 1, F.length(t))))
    done = joined.withColumn("ok", sound).withColumn("rewritten", F.when(F.col("ok"), text).otherwise(F.col("raw")))
    status = F.when(~F.col("ok"), "stale").when(F.col("rewritten") == F.col("raw"), "noop").otherwise("applied")
    return done.select("path", "raw", "rewritten", F.size("edits").alias("edits"), status.alias("status"))



def file_diffs(applied: DataFrame) -> DataFrame:
    """(path, status, diff) of `apply`'s rows: what a dry run shows; unchanged and stale files have an empty diff."""

    @F.pandas_udf("string")
    def unified(paths: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        diffs = ("".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), f"a/{p}", f"b/{p}")) for p, a, b in zip(paths, before, after, strict=True))
        return pd.Series(list(diffs), dtype=object)

    return applied.select("path", "status", unified("path", "raw", "rewritten").alias("diff"))


def verify(stages: DataFrame, findings: DataFrame, severity: str = "medium", rule_ids: list[str] | None = None, most_tier: str = "suggested", baseline: DataFrame | None = None) -> DataFrame:
    """(problem, path, rule_id) after an application: candidates that remain, and open findings as severe as asked.

    With a baseline only findings that it lacks are problems; the other direction is `security.new_since(baseline, findings)`.
    """
    left = disjoint(candidates(stages, rule_ids, most_tier)).select(F.lit("candidate").alias("problem"), "path", "rule_id")
    found = security.at_least(findings.where("status = 'open'"), severity)
    found = found if baseline is None else security.new_since(found, baseline)
    return left.union(found.select(F.lit("finding").alias("problem"), "path", "rule_id"))


def merge_suggestions(planned: DataFrame, accepted: DataFrame, findings: DataFrame, most_tier: str = "risky", allow: bool = False) -> DataFrame:
    """Plan candidates and accepted suggestions together, without overlaps, with the overlay of findings."""
    own = planned.select("path", "stage", "rule_id", "tier", "start", "end", "before", "after", "reason")
    extra = accepted.select("path", F.col("path").alias("stage"), "rule_id", "tier", "start", "end", "before", "after", F.col("rationale").alias("reason"))
    allowed = [t for t, rank in TIERS.items() if rank <= TIERS[most_tier]]
    return overlay(disjoint(own.unionByName(extra.where(F.col("tier").isin(allowed)))), findings, allow)


def write_plan(items: DataFrame, path: str, digest: str) -> None:
    """A plan as one JSON file; it is an ordered list of bounded size."""
    rows = [r.asDict(recursive=True) for r in items.orderBy("ordinal").collect()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"schema": PLAN_SCHEMA, "v": 1, "plan_hash": digest, "items": rows}, f, sort_keys=True, ensure_ascii=False, indent=1)


def read_plan(spark, path: str) -> tuple[DataFrame, str]:
    with open(path, encoding="utf-8") as f:
        body = json.load(f)
    if body.get("schema") != PLAN_SCHEMA or body.get("v") != 1:
        raise ValueError(f"not a plan of schema {PLAN_SCHEMA}")
    shape = f"{_CANDIDATE}, blocked boolean, security_note string, ordinal int, change_id string, item_hash string, rule_version int"
    names = [x.split()[0] for x in shape.split(", ")]
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in body["items"]], shape), body["plan_hash"]
