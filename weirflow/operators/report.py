"""Reports and JSON envelopes as one-row DataFrames."""

from __future__ import annotations

import json
import subprocess
from datetime import datetime, timezone
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TITLE = "# Schema drift report"


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def _lines(df: DataFrame, lines, order: list[str], name: str) -> DataFrame:
    """One row: the array of all lines in order. A report is one text, so its lines meet in one place."""
    each = df.select(F.struct(*order).alias("o"), lines.alias("l"))
    return each.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"])).alias(name))


def summary(stages: DataFrame, edges: DataFrame, missing: DataFrame, drifts: DataFrame) -> DataFrame:
    """One row: stages, edges, missing, drifts, breaking."""
    found = drifts.agg(F.count("*").alias("drifts"), F.count_if("breaking").alias("breaking"))
    return _count(stages, "stages").join(_count(edges, "edges")).join(_count(missing, "missing")).join(found)


def markdown(stages: DataFrame, edges: DataFrame, missing: DataFrame, drifts: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """One row (report): counts, cycles, unresolved references, drifts."""
    item = lambda label, c: F.transform(c, lambda x: F.concat(F.lit(f"- {label}: `"), x, F.lit("`")))
    of_drift = F.concat(
        F.array(F.concat(F.lit("### "), "producer", F.lit(" -> "), "consumer", F.when(F.col("breaking"), " [BREAKING]").otherwise(" [warning]"))),
        item("removed", F.col("removed")),
        F.transform("renamed", lambda r: F.concat(F.lit("- renamed: `"), r["old"], F.lit("` -> `"), r["new"], F.lit("`"))),
        item("added (non-breaking)", F.col("added")),
    )
    rows = summary(stages, edges, missing, drifts)
    rows = rows.join(_lines(missing, F.array(F.concat(F.lit("- `"), "consumer", F.lit("` references missing stage `"), "ref", F.lit("`"))), ["consumer", "ref"], "m")).join(_lines(drifts, of_drift, ["producer", "consumer"], "d"))
    if cycles is None:
        rows = rows.withColumn("c", F.array().cast("array<string>"))
    else:
        rows = rows.join(_lines(cycles, F.array(F.concat(F.lit("  - "), F.array_join("walk", " -> "))), ["place"], "c"))
    line = lambda label, c: F.concat(F.lit(f"- {label}: "), c)
    text = lambda c: F.col(c).cast("string")
    empty = F.array().cast("array<string>")
    head = F.array(F.lit(TITLE), F.lit(""), line("stages", text("stages")), line("edges", text("edges")), line("missing refs", text("missing")), line("drifts", F.concat(text("drifts"), F.lit(" ("), text("breaking"), F.lit(" breaking)"))))
    walks = F.when(F.size("c") > 0, F.concat(F.array(line("cycles", F.size("c").cast("string"))), F.col("c"))).otherwise(empty)
    gone = F.when(F.size("m") > 0, F.concat(F.array(F.lit(""), F.lit("## Unresolved refs")), F.col("m"))).otherwise(empty)
    tail = F.concat(F.array(F.lit(""), F.lit("## Drifts")), F.when(F.size("d") > 0, F.col("d")).otherwise(F.array(F.lit("None detected."))), F.array(F.lit("")))
    return rows.select(F.array_join(F.concat(head, walks, gone, tail), "\n").alias("report"))


def text(stages: DataFrame, edges: DataFrame, missing: DataFrame, drifts: DataFrame) -> DataFrame:
    """One row (report): a line of counts and a line per drift."""
    named = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    renamed = F.transform("renamed", lambda r: F.concat(r["old"], F.lit("->"), r["new"]))
    each = F.array(F.concat(F.lit("  "), "producer", F.lit(" -> "), "consumer", F.lit(": "), F.concat_ws("; ", named("removed", F.col("removed")), named("renamed", renamed), named("added", F.col("added")))))
    rows = summary(stages, edges, missing, drifts).join(_lines(drifts, each, ["producer", "consumer"], "d"))
    head = F.format_string("stages=%d edges=%d missing_refs=%d drifts=%d breaking=%d", "stages", "edges", "missing", "drifts", "breaking")
    return rows.select(F.array_join(F.concat(F.array(head), F.col("d")), "\n").alias("report"))


def envelope(kind: str, body: DataFrame) -> DataFrame:
    """One row (json): {"items": [...], "schema": "weirflow.<kind>.v1", "v": 1}, items in order of their JSON."""
    items = body.select(F.to_json(F.struct(*sorted(body.columns)), {"ignoreNullFields": "false"}).alias("j")).agg(F.array_sort(F.collect_list("j")).alias("j"))
    return items.select(F.concat(F.lit('{"items":['), F.array_join("j", ","), F.lit(f'],"schema":"weirflow.{kind}.v1","v":1}}')).alias("json"))


def repo_id(root: str) -> str | None:
    """The short commit id of a project under git; None where there is none, or git does not answer in five seconds."""
    try:
        said = subprocess.run(["git", "-C", root, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=5, env={"PATH": "/usr/local/bin:/usr/bin:/bin"})
    except (OSError, subprocess.TimeoutExpired):
        return None
    return said.stdout.strip() or None if said.returncode == 0 else None


def checked_at() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def artifact(out: TextIO, kind: str, head: dict, lists: dict[str, DataFrame]) -> None:
    """Write a JSON object of `head` and the rows of each list, in their order, to `out`.

    Rows are fetched a partition at a time, so the driver never holds a list whole.
    """
    fields = {"schema": f"weirflow.{kind}.v1", "version": 1} | head
    out.write("{" + ",".join(f"{json.dumps(k)}:{json.dumps(v, ensure_ascii=False)}" for k, v in fields.items()))
    for name, rows in lists.items():
        out.write(f",{json.dumps(name)}:[")
        each = rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("j"))
        for i, row in enumerate(each.toLocalIterator()):
            out.write("," * bool(i) + row.j)
        out.write("]")
    out.write("}\n")
