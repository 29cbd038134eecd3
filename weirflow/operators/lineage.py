"""Lineage: edges by joins, missing references by anti joins, reachability by iterated joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow import session
from weirflow.operators import kernels


def one_per_name(stages: DataFrame) -> DataFrame:
    """Of stages with one name the last by path."""
    last = Window.partitionBy("name").orderBy(F.col("path").desc())
    return stages.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def one_per_pair(refs: DataFrame) -> DataFrame:
    """(producer, consumer, kind) of (producer, consumer, ordinal, kind): each pair once with the kind of its first reference."""
    return refs.groupBy("producer", "consumer").agg(F.min_by("kind", "ordinal").alias("kind"))


def resolve(refs: DataFrame, stages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, missing) of refs (consumer, ordinal, name, kind) against stages (name): self references are neither.

    An edge is (producer, consumer, kind), each pair once with the kind of its first reference.
    """
    names = stages.select(F.col("name").alias("producer")).distinct()
    wanted = refs.withColumnRenamed("name", "producer").where("producer <> consumer")
    edges = one_per_pair(wanted.join(names, "producer"))
    missing = wanted.join(names, "producer", "left_anti").select("consumer", F.col("producer").alias("ref"))
    return edges, missing


def resolve_sources(sources: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, missing) of sources (consumer, source, table) against the catalog of `source.table` names."""
    wanted = sources.select("consumer", F.concat_ws(".", "source", "table").alias("name"))
    known = wanted.join(catalog.select("name").distinct(), "name", "left_semi")
    edges = known.select(F.col("name").alias("producer"), "consumer", F.lit("source").alias("kind")).distinct()
    return edges, wanted.join(catalog, "name", "left_anti").select("consumer", F.col("name").alias("ref"))


def build(refs: DataFrame, sources: DataFrame, stages: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All edges and missing references; a pair that is both keeps the kind `ref`."""
    a, b = resolve(refs, stages)
    c, d = resolve_sources(sources, catalog)
    both = a.withColumn("_o", F.lit(0)).unionByName(c.withColumn("_o", F.lit(1)))
    return both.groupBy("producer", "consumer").agg(F.min_by("kind", "_o").alias("kind")), b.unionByName(d)


def downstream(edges: DataFrame, start: DataFrame, most_depth: int = 32) -> DataFrame:
    """(node, depth): every node reachable from `start` (node), with the least depth under `most_depth`; start itself at 0.

    Each turn joins only the newest nodes and drops those seen, so cycles end; it stops when a turn adds none.
    """
    session.checkpoints(edges.sparkSession)
    seen = start.select("node", F.lit(0).alias("depth")).distinct()
    fresh = seen
    for depth in range(1, most_depth):
        after = fresh.join(edges, fresh["node"] == edges["producer"]).select(F.col("consumer").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        fresh = after.withColumn("depth", F.lit(depth)).checkpoint()
        if fresh.isEmpty():
            break
        seen = seen.union(fresh)
    return seen


def affected(edges: DataFrame, start: DataFrame, drifts: DataFrame, most_depth: int = 32) -> DataFrame:
    """(depth, producer, consumer, breaking): the edges downstream of `start` (node), and whether a breaking drift lies on each.

    The depth is the least number of steps to the edge's consumer over that edge.
    """
    reached = downstream(edges, start, most_depth)
    along = edges.select("producer", "consumer").distinct().join(reached, F.col("producer") == F.col("node")).select((F.col("depth") + 1).alias("depth"), "producer", "consumer")
    found = drifts.groupBy("producer", "consumer").agg(F.bool_or("breaking").alias("breaking"))
    return along.join(found, ["producer", "consumer"], "left").select("depth", "producer", "consumer", F.coalesce("breaking", F.lit(False)).alias("breaking"))


def shortest_route(edges: DataFrame, source: str, target: str, most_depth: int = 32) -> DataFrame:
    """(route, depth): a shortest route, of several the first in order of its names."""
    spark = edges.sparkSession
    session.checkpoints(spark)
    fresh = spark.createDataFrame([(source, source, [source])], "node string, route string, seen array<string>")
    known = fresh.select("node")
    for depth in range(most_depth + 1):
        hit = fresh.where(F.col("node") == target).agg(F.min("route").alias("route")).where("route is not null")
        if not hit.isEmpty():
            return hit.select("route", F.lit(depth).alias("depth"))
        after = fresh.join(edges, fresh["node"] == edges["producer"]).select(F.col("consumer").alias("node"), F.concat_ws(" -> ", "route", "consumer").alias("route"), "seen")
        after = after.join(known, "node", "left_anti").groupBy("node").agg(F.min(F.struct("route", "seen")).alias("x")).select("node", "x.route", F.array_append("x.seen", F.col("node")).alias("seen"))
        fresh = after.checkpoint()
        if fresh.isEmpty():
            break
        known = known.union(fresh.select("node"))
    return spark.createDataFrame([], "route string, depth int")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, producers, consumers), each sorted."""
    down = edges.groupBy(F.col("producer").alias("node")).agg(F.array_sort(F.collect_set("consumer")).alias("consumers"))
    up = edges.groupBy(F.col("consumer").alias("node")).agg(F.array_sort(F.collect_set("producer")).alias("producers"))
    none = F.array().cast("array<string>")
    return down.join(up, "node", "full").select("node", F.coalesce("producers", none).alias("producers"), F.coalesce("consumers", none).alias("consumers"))


def kind_of(edges: DataFrame, pairs: DataFrame, default: str = "ref") -> DataFrame:
    """`pairs` (producer, consumer) with the kind of their edge, or `default` where there is none."""
    known = edges.select("producer", "consumer", "kind").dropDuplicates(["producer", "consumer"])
    return pairs.join(known, ["producer", "consumer"], "left").withColumn("kind", F.coalesce("kind", F.lit(default)))


def _by_run(nodes: DataFrame, edges: DataFrame, visit: Callable[[list[str], list[tuple[str, str]]], list], shape: str, schema: pa.Schema) -> DataFrame:
    """What `visit` makes of each run's (nodes in order of `ordinal`, edges), numbered by `place`.

    A run's graph, the stages of one project, meets in one task; runs are read one after another from rows sorted by run, so a
    task holds one graph at a time.
    """
    rows = nodes.select("run_id", "ordinal", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"))
    rows = rows.union(edges.select("run_id", F.lit(None), "producer", "consumer"))
    dealt = rows.repartition("run_id").sortWithinPartitions("run_id", F.col("b").isNotNull(), "ordinal", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list, list]] = []

        def made(done: list) -> pa.RecordBatch:
            found = [(r, i, x) for r, n, e in done for i, x in enumerate(visit(n, e))]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], schema.field(k).type) for k in range(3)], schema=schema)

        for batch in batches:
            for r, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not held or held[-1][0] != r:
                    held.append((r, [], []))
                if b is None:
                    held[-1][1].append(a)
                else:
                    held[-1][2].append((a, b))
            if len(held) > 1:
                yield made(held[:-1])
                del held[:-1]
        if held:
            yield made(held)

    return dealt.mapInArrow(run, shape)


def order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_id, place, node) of each run's topological order."""
    schema = pa.schema([("run_id", pa.int64()), ("place", pa.int32()), ("node", pa.string())])
    return _by_run(nodes.withColumn("ordinal", F.col("node")), edges, kernels.topological, "run_id long, place int, node string", schema)


def cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_id, place, walk) of the closed walks of each run, nodes visited in order of `ordinal`."""
    schema = pa.schema([("run_id", pa.int64()), ("place", pa.int32()), ("walk", pa.list_(pa.string()))])
    return _by_run(nodes, edges, kernels.cycles, "run_id long, place int, walk array<string>", schema)
