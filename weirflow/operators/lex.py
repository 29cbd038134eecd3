"""SQL text to token rows: one regular expression whose alternatives cover every character, then running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEXEMES = "|".join(
    [
        r"--[^\n]*",
        r"/\*(?s:.*?)\*/",
        r"\{\{|\}\}|\{%|%\}|\{#|#\}",
        r"'[^'\n]*+(?:''[^'\n]*+)*+'",
        r'"[^"\n]*+"',
        r"`[^`\n]*+`",
        r"[0-9][0-9._]*+",
        r"[\p{L}_][\p{L}\p{N}_]*+",
        r"<=|>=|<>|!=|\|\||::|->|:=|==",
        r"\s++",
        r"(?s:.)",
    ]
)
#: One-character operators; any other single character is an error.
OPERATORS = r"^[-+*/%=<>(),.;:\[\]|&!?@^~]$"


def tokens(files: DataFrame, key: str = "path", text: str = "raw") -> DataFrame:
    """(key, pos, kind, value, start, end, byte_start, byte_end, line, col) of every piece, spaces and comments too.

    The pieces of a file add up to its text. Lone quotes, an open comment and characters outside the language are kind ERROR.
    """
    v = F.col("value")
    kind = (
        F.when(v.startswith("--") | (v.startswith("/*") & (F.length(v) > 3)), "COMMENT")
        .when(v.isin("{{", "{%", "{#"), "TEMPLATE_OPEN")
        .when(v.isin("}}", "%}", "#}"), "TEMPLATE_CLOSE")
        .when(v.rlike(r"^\s"), "SPACE")
        .when(v.rlike(r"^'.*'$") & (F.length(v) > 1), "STRING")
        .when(v.rlike('^".*"$|^`.*`$') & (F.length(v) > 1), "QUOTED_IDENT")
        .when(v.rlike("^[0-9]"), "NUMBER")
        .when(v.rlike(r"^[\p{L}_]"), "WORD")
        .when((F.length(v) == 2) | v.rlike(OPERATORS), "OP")
        .otherwise("ERROR")
    )
    running = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    breaks = F.length(v) - F.length(F.replace(v, F.lit("\n")))
    pieces = files.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(LEXEMES), 0)).alias("pos", "value")).withColumn("kind", kind)
    placed = pieces.withColumns({"end": F.sum(F.length(v)).over(running), "byte_end": F.sum(F.octet_length(v)).over(running), "_lines": F.sum(breaks).over(running)})
    placed = placed.withColumns({"start": F.col("end") - F.length(v), "byte_start": F.col("byte_end") - F.octet_length(v), "line": F.col("_lines") - breaks + 1})
    last_break = F.max(F.when(breaks > 0, F.col("end") - F.length(F.substring_index(v, "\n", -1)))).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("col", F.col("start") - F.coalesce(last_break, F.lit(0)) + 1).select(key, "pos", "kind", "value", "start", "end", "byte_start", "byte_end", "line", "col")


def significant(toks: DataFrame, key: str = "path") -> DataFrame:
    """Tokens without spaces and comments, with `depth` (parentheses and brackets, never under 0), `inside` a template, and `idx`."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("value")
    step = F.when(v.isin("(", "["), 1).when(v.isin(")", "]"), -1).otherwise(0)
    opened = F.sum(F.when(F.col("kind") == "TEMPLATE_OPEN", 1).otherwise(0)).over(order)
    closed = F.sum(F.when(F.col("kind") == "TEMPLATE_CLOSE", 1).otherwise(0)).over(order)
    kept = toks.where("kind not in ('SPACE', 'COMMENT')").withColumns({"_cum": F.sum(step).over(order), "inside": (opened > closed) | (F.col("kind") == "TEMPLATE_CLOSE"), "_step": step})
    low = F.least(F.lit(0), F.min("_cum").over(order))
    after = F.col("_cum") - low
    kept = kept.withColumn("_after", after)
    before = F.coalesce(F.lag("_after").over(Window.partitionBy(key).orderBy("pos")), F.lit(0))
    after = F.col("_after")
    # An opener stands at the depth outside it, a closer too; a closer without an opener is unmatched.
    return kept.withColumns({"unmatched": (F.col("_step") < 0) & (before == 0), "depth": F.when(F.col("_step") > 0, after - 1).otherwise(after), "idx": F.row_number().over(Window.partitionBy(key).orderBy("pos")), "region": opened}).drop("_cum", "_step", "_after")
