"""Known graphs, schema differences, reports."""

from __future__ import annotations

from hypothesis import given
from hypothesis import strategies as st

from weirflow.operators import drift, kernels, lineage


def test_known_graphs():
    assert kernels.topological(["d", "c", "b", "a"], [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]) == ["a", "b", "c", "d"]
    assert kernels.cycles(["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")]) == [["a", "b", "c", "a"]]
    assert kernels.topological(["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")]) == ["a", "b", "c"]


@given(st.sets(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=20))
def test_order_respects_edges(pairs):
    edges = [(f"n{a}", f"n{b}") for a, b in pairs if a < b]
    order = kernels.topological([f"n{i}" for i in range(9)], edges)
    assert sorted(order) == [f"n{i}" for i in range(9)]
    assert all(order.index(a) < order.index(b) for a, b in edges)


def test_renames():
    assert kernels.renames(["id", "user_email_v2"], ["id", "user_email"], 0.75) == (["user_email_v2"], [], [("user_email", "user_email_v2")])
    assert kernels.renames(["id", "name"], ["id", "name", "email"], 0.75) == ([], ["email"], [])
    assert kernels.renames(["orderid"], ["order_identifier"], 0.75)[1] == ["order_identifier"]


def _kept_one_by_one(spans):
    """Each span against all kept ones, in order: the rule itself, quadratic."""
    kept = []
    for start, end, rank in sorted(spans, key=lambda s: (s[0], s[1], -s[2])):
        clash = [k for k in kept if k[0] < end and start < k[1]]
        if all(k[2] < rank for k in clash):
            kept = [k for k in kept if k not in clash] + [(start, end, rank)]
    return sorted(kept)


def test_findings_dedupe(spark):
    from weirflow.operators import rewrite, security

    rows = [("a", "R", 0, 10, "high"), ("a", "R", 4, 8, "critical"), ("a", "R", 20, 25, "low"), ("a", "S", 5, 9, "low")]
    found = security.dedupe(spark.createDataFrame(rows, "path string, rule_id string, start int, end int, severity string"))
    assert {tuple(r) for r in found.collect()} == {rows[1], rows[2], rows[3]}
    edits = spark.createDataFrame([("a", 0, 5, "x"), ("a", 3, 8, "x"), ("a", 8, 9, "x"), (None, 1, 2, "x")], "path string, start int, end int, rule_id string")
    assert {(r.start, r.end) for r in rewrite.disjoint(edits).collect()} == {(0, 5), (8, 9), (1, 2)}
    assert rewrite.disjoint(edits.limit(0)).count() == 0


def test_sweep_against_the_rule_itself(spark):
    """Overlaps at random in many small groups and in one that holds half of the rows and spans many Arrow batches."""
    import random

    from weirflow.operators import security

    rng = random.Random(4)
    rank = {"critical": 4, "high": 3, "medium": 2, "low": 1}
    rows = []
    for i in range(6000):
        start = rng.randrange(3000)
        rows.append(("hot" if i % 2 else f"p{rng.randrange(40)}", "R", start, start + rng.randrange(1, 30), rng.choice(list(rank))))
    rows = sorted(set(rows))
    frame = spark.createDataFrame(rows, "path string, rule_id string, start int, end int, severity string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = security.dedupe(frame).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for path in {r[0] for r in rows}:
        want = _kept_one_by_one([(r[2], r[3], rank[r[4]]) for r in rows if r[0] == path])
        assert sorted((r.start, r.end, rank[r.severity]) for r in got if r.path == path) == want


def test_drift_and_lineage(spark):
    schemas = spark.createDataFrame([("p", ["id", "name", "email"]), ("c", ["id", "name"]), ("empty", [])], "name string, columns array<string>")
    edges = spark.createDataFrame([("p", "c"), ("empty", "c")], "producer string, consumer string")
    rows = drift.unified_diff(drift.detect(edges, schemas)).collect()
    assert [(r.producer, r.added, r.removed, r.breaking) for r in rows] == [("p", ["email"], [], False)]
    assert rows[0]["diff"] == "--- a/p (schema)\n+++ b/c (expected)\n@@ -1,0 +1,1 @@\n+email\n"
    refs = spark.createDataFrame([("b", 0, "a", "ref"), ("b", 1, "a", "bare"), ("b", 2, "b", "ref"), ("b", 3, "gone", "ref")], "consumer string, ordinal int, name string, kind string")
    found, missing = lineage.resolve(refs, spark.createDataFrame([("a",), ("b",)], "name string"))
    assert [tuple(r) for r in found.collect()] == [("a", "b", "ref")]
    assert [tuple(r) for r in missing.collect()] == [("b", "gone")]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "producer string, consumer string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in lineage.downstream(edges, start).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert tuple(lineage.shortest_route(edges, "a", "d").first()) == ("a -> b -> c -> d", 3)
