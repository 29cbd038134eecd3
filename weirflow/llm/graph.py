"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.storage import drop, materialise

#: Edges, of long ids, that one task solves (8 MB of them); more are solved by rounds over the whole cluster.
TASK_EDGES = 1 << 19


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each node's larger (or smaller) neighbours at its smallest neighbour, itself included."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v): roots are hung on their smallest neighbouring root until none is left to hang."""
    ends = [np.stack([np.asarray(x.column(0)), np.asarray(x.column(1))]) for x in batches]
    nodes, at = np.unique(np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Nodes may be of any ordered type. Null ends and self loops are ignored; no edges give no rows. Each round is
    written to the shared folder, so lineage stays short and lost executors cost one round at most. A graph of long ids with
    `TASK_EDGES` edges at most is solved by one task, as every round costs the driver some ten shuffles to plan and run.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(now, "cc")
    if all(f.dataType == T.LongType() for f in now.schema) and now.count() <= TASK_EDGES:
        out = materialise(now.coalesce(1).mapInArrow(_solved, "node long, component long"), "cc")
        drop(now)
        return out
    state = None
    while True:
        # The fingerprint of the edge list tells when a round changed nothing.
        old, now = now, materialise(_star(_star(now, True), False), "cc")
        drop(old)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(after) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = tuple(after)


def merged(labels: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of the edges that `labels` are the components of and of `links` together; only components are joined anew."""
    name = labels.select(F.col("node").alias("u"), F.col("component").alias("x"))
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).join(name, "u", "left").join(name.toDF("v", "y"), "v", "left")
    over = components(ends.select(F.coalesce("x", "u").alias("u"), F.coalesce("y", "v").alias("v")), "u", "v").toDF("from", "to")
    new = over.join(labels, F.col("from") == F.col("node"), "left_anti").select(F.col("from").alias("node"), F.col("from").alias("component"))
    every = labels.select("node", "component").union(new).join(over, F.col("component") == F.col("from"), "left")
    return materialise(every.select("node", F.coalesce("to", "component").alias("component")), "cc")
