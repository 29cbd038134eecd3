"""A rewrite session from plan to done."""

from __future__ import annotations

import pytest

from weirflow.operators import flow, rewrite, sessions
from weirflow.sources import files
from weirflow.sources.store import Store


def test_session(spark, tmp_path):
    root = tmp_path / "models"
    root.mkdir()
    (root / "a.sql").write_text("select ID from T")
    store = Store(spark, f"file://{tmp_path}/store")
    raw = files.project(spark, str(root))
    stages = raw.selectExpr("path", "'a' as name", "raw", "array('id') as columns")
    none = spark.createDataFrame([], "rule_id string, severity string, path string, line int, col int, span struct<start:int,end:int>, status string")
    items = rewrite.plan(rewrite.overlay(rewrite.disjoint(rewrite.candidates(stages, ["REF-004"])), none))
    plan = str(tmp_path / "plan.json")
    digest = flow.plan(store, "s", items, str(root), "sha256:x", "safe", plan)
    with pytest.raises(sessions.TransitionError):
        flow.apply(store, "s", raw, str(root), plan)
    flow.approve(store, "s")
    assert [r.status for r in flow.apply(store, "s", raw, str(root), plan).collect()] == ["applied"]
    assert (root / "a.sql").read_text() == "select id from t" and (root / "a.sql.orig").read_text() == "select ID from T"
    assert {r.state: r.n for r in flow.item_states(store, digest).collect()} == {"applied": 1}
    after = files.project(spark, str(root)).selectExpr("path", "'a' as name", "raw", "array('id') as columns")
    assert flow.verify(store, "s", rewrite.verify(after, none, rule_ids=["REF-004"]))
    assert sessions.state(store, "s") == "done"
    assert [r.status for r in flow.apply(store, "s", raw, str(root), plan).collect()] == ["noop"]
    other = rewrite.plan(rewrite.overlay(rewrite.candidates(stages, ["REF-002"]), none))
    rewrite.write_plan(other, plan, "sha256:other")
    with pytest.raises(ValueError, match="not the session"):
        flow.apply(store, "s", raw, str(root), plan)


def test_command_line_session(spark, tmp_path):
    from weirflow import cli

    root = tmp_path / "m"
    root.mkdir()
    (root / "a.sql").write_text("select ID from T")
    common = ["--store", f"file://{tmp_path}/st", "--session", "s"]
    plan = ["--plan", str(tmp_path / "p.json")]
    assert cli.main(["plan", str(root), *common, *plan, "--max-risk", "safe"]) == 0
    assert cli.main(["apply", str(root), *common, *plan]) == 2
    assert cli.main(["approve", str(root), *common]) == 0
    assert cli.main(["apply", str(root), *common, *plan]) == 0
    assert (root / "a.sql").read_text() == "select id from t"
    assert cli.main(["verify", str(root), *common]) == 0
    assert cli.main(["audit", str(root), "--store", f"file://{tmp_path}/st"]) == 0
    assert cli.main(["approve", str(root), "--session", "s"]) == 2
