"""Schema drift of each lineage edge: set differences in Catalyst, rename assignment as an Arrow-batched kernel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators import kernels

THRESHOLD = 0.75
_OUT = "removed array<string>, renamed array<struct<old:string,new:string>>"


def detect(edges: DataFrame, schemas: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(producer, consumer, added, removed, renamed, breaking) of edges whose schemas differ.

    `schemas` is (name, columns). Producers without columns, and sources, tell nothing. Only edges with an expected column
    missing go to the rename kernel.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")

    @F.pandas_udf(_OUT)
    def assign(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for produced, expected in batches:
            got = [kernels.renames(list(p), list(e), threshold) for p, e in zip(produced, expected, strict=True)]
            yield pd.DataFrame({"removed": [g[1] for g in got], "renamed": [[{"old": a, "new": b} for a, b in g[2]] for g in got]})

    side = lambda n: schemas.select(F.col("name").alias(n), F.col("columns").alias(f"{n}_columns"))
    pairs = edges.join(side("producer"), "producer").join(side("consumer"), "consumer").where(F.size("producer_columns") > 0)
    pairs = pairs.withColumns({"added": F.filter("producer_columns", lambda c: ~F.array_contains("consumer_columns", c)), "lost": F.filter("consumer_columns", lambda c: ~F.array_contains("producer_columns", c))})
    same = pairs.where(F.size("lost") == 0).withColumns({"removed": F.array().cast("array<string>"), "renamed": F.array().cast("array<struct<old:string,new:string>>")})
    lost = pairs.where(F.size("lost") > 0).withColumn("_x", assign("producer_columns", "consumer_columns")).withColumns({"removed": F.col("_x.removed"), "renamed": F.col("_x.renamed")}).drop("_x")
    out = same.unionByName(lost).withColumn("breaking", (F.size("removed") > 0) | (F.size("renamed") > 0))
    return out.where(F.col("breaking") | (F.size("added") > 0)).select("producer", "consumer", "added", "removed", "renamed", "breaking")


def unified_diff(drifts: DataFrame) -> DataFrame:
    """`drifts` with `diff`, a unified schema diff."""
    signed = lambda c, sign: F.transform(c, lambda x: F.concat(F.lit(sign), x))
    minus, plus = F.size("removed") + F.size("renamed"), F.size("renamed") + F.size("added")
    lines = F.concat(
        F.array(F.concat(F.lit("--- a/"), "producer", F.lit(" (schema)")), F.concat(F.lit("+++ b/"), "consumer", F.lit(" (expected)")), F.concat(F.lit("@@ -1,"), minus.cast("string"), F.lit(" +1,"), plus.cast("string"), F.lit(" @@"))),
        signed("removed", "-"),
        F.flatten(F.transform("renamed", lambda r: F.array(F.concat(F.lit("-"), r["old"]), F.concat(F.lit("+"), r["new"])))),
        signed("added", "+"),
        F.array(F.lit("")),
    )
    return drifts.withColumn("diff", F.array_join(lines, "\n"))


def version_chain(rows: DataFrame, stage: str, by: str, digest: str) -> DataFrame:
    """(stage, by, version, parent_version, changed): each stage's snapshots numbered in order, and whether the digest moved."""
    w = Window.partitionBy(stage).orderBy(by)
    linked = rows.select(stage, by, F.row_number().over(w).cast("long").alias("version"), F.lag(digest).over(w).alias("_old"), F.col(digest).alias("_now"))
    return linked.withColumn("parent_version", F.lag("version").over(w)).select(stage, by, "version", "parent_version", (~F.col("_old").eqNullSafe(F.col("_now"))).alias("changed"))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Changes between consecutive snapshots (stage, version, column, data_type, nullable): added, removed, retyped, nullability.

    A removal, a retyping and a column that becomes nullable are breaking; an unknown type (null) is no change.
    """
    versions = snapshots.select("stage", "version").distinct().withColumn("parent", F.lag("version").over(Window.partitionBy("stage").orderBy("version"))).where("parent is not null")
    now = snapshots.join(versions, ["stage", "version"]).select("stage", "version", "parent", "column", "data_type", "nullable")
    old = versions.join(snapshots.select("stage", F.col("version").alias("parent"), "column", F.col("data_type").alias("old_type"), F.col("nullable").alias("old_nullable")), ["stage", "parent"])
    both = now.withColumn("_n", F.lit(1)).join(old.withColumn("_o", F.lit(1)), ["stage", "version", "parent", "column"], "full")
    change = (
        F.when(F.col("_o").isNull(), "added")
        .when(F.col("_n").isNull(), "removed")
        .when(F.col("data_type") != F.col("old_type"), "retyped")
        .when(F.col("nullable") & ~F.col("old_nullable"), "nullable")
        .when(~F.col("nullable") & F.col("old_nullable"), "required")
    )
    return both.withColumn("change", change).where("change is not null").select("stage", "version", "parent", "column", "change", F.col("change").isin("removed", "retyped", "nullable").alias("breaking"))
