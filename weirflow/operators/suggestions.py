"""Suggestions of a language model as rewrite candidates: a pluggable client, validation as DataFrame predicates."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_CONFIDENCE = 0.7
MOST = 50
FIELDS = "path string, start int, end int, before string, after string, confidence double, rationale string"


class Unavailable(Exception):
    """The model's server could not be asked, or said nothing."""


def http_client(url: str, model: str, timeout: float = 60.0, field: str = "response") -> Callable[[str], str]:
    """A client for `request`: posts {model, prompt, stream, format} as JSON to `url` and returns the answer's text `field`."""

    def ask(text: str) -> str:
        body = json.dumps({"model": model, "prompt": text, "stream": False, "format": "json"}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
                said = json.load(answer).get(field)
        except (OSError, ValueError, AttributeError) as error:
            raise Unavailable(f"{url}: {error}") from error
        if not isinstance(said, str) or not said.strip():
            raise Unavailable(f"{url}: an empty answer")
        return said

    return ask


def prompt(stages: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row (prompt): the files in order of path, and spans that must not be touched."""
    files = stages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "raw"))), lambda s: F.concat(F.lit("--- "), s["path"], F.lit("\n"), s["raw"])), "\n").alias("files"))
    head = "Suggest safe SQL rewrites as a JSON array of objects with path, start, end, before, after, confidence and rationale."
    if findings is None:
        return files.select(F.concat(F.lit(head + "\n"), "files").alias("prompt"))
    guarded = findings.agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s:%d-%d", "path", "span.start", "span.end"))), "\n").alias("spans"))
    return files.join(guarded).select(F.concat(F.lit(head + "\nDo not touch:\n"), "spans", F.lit("\n"), "files").alias("prompt"))


def request(client: Callable[[str], str], text: str, wait: float = 1.0) -> list[dict]:
    """Ask once, and once more if the answer is not JSON. A client that fails at once is an error of the caller's."""
    for turn in range(2):
        answer = client(text).strip()
        try:
            found = json.loads(answer)
        except ValueError:
            if not turn:
                time.sleep(wait)
            continue
        found = found.get("suggestions", []) if isinstance(found, dict) else found
        return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []
    return []


def validate(suggested: DataFrame, files: DataFrame, planned: DataFrame, least: float = LEAST_CONFIDENCE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of suggestions (`FIELDS`, ordinal). A rejected row has the first reason that holds.

    Accepted ones are numbered LLM-1, LLM-2, ... in order, `most` at the most: the cap is the operator's feature.
    """
    known = files.select("path", "raw")
    same = planned.select("before", "after", F.lit(True).alias("_dup")).distinct()
    rows = suggested.join(known, "path", "left").join(same, ["before", "after"], "left")
    missing = F.lit(False)
    for c in ("path", "start", "end", "before", "after", "confidence"):
        missing = missing | F.col(c).isNull()
    reason = (
        F.when(missing, "field missing or of the wrong type")
        .when(F.col("before") == F.col("after"), "changes nothing")
        .when(~F.col("confidence").between(0, 1), "confidence out of range")
        .when(F.col("confidence") < least, "confidence too low")
        .when(F.col("raw").isNull(), "unknown path")
        .when((F.col("start") < 0) | (F.col("end") > F.length("raw")) | (F.col("start") >= F.col("end")), "span out of bounds")
        .when(F.substring("raw", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("before"), "text differs")
        .when(F.col("_dup"), "already planned")
    )
    judged = rows.withColumn("reason", reason)
    good = judged.where("reason is null")
    first = good.orderBy("ordinal").limit(most)  # so the window below sees `most` rows at the most
    accepted = first.withColumn("n", F.row_number().over(Window.orderBy("ordinal"))).select("path", "start", "end", "before", "after", F.round("confidence", 3).alias("confidence"), "rationale", F.concat(F.lit("LLM-"), F.col("n").cast("string")).alias("rule_id"), F.lit("risky").alias("tier"), F.lit(1).alias("rule_version"))
    over = good.join(first.select("ordinal"), "ordinal", "left_anti").withColumn("reason", F.lit("over the cap")).select("ordinal", "path", "reason")
    return accepted, judged.where("reason is not null").select("ordinal", "path", "reason").union(over)
