"""History tables, sessions, suggestions, plug-ins, the command line and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weirflow import cli
from weirflow.operators import plugins, report, rewrite, sessions, suggestions
from weirflow.sources.store import Store
from weirflow.streaming import events


def test_store_and_sessions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.read("runs").isEmpty() and store.next_run() == 1
    assert sessions.state(store, "s") == "start"
    sessions.move(store, "s", "parsed", "PARSE", args="token = 'abcdefgh12345'")
    sessions.move(store, "s", "analyzed", "ANALYZE")
    assert sessions.state(store, "s") == "analyzed"
    with pytest.raises(sessions.TransitionError):
        sessions.move(store, "s", "done", "X")
    assert [r.action for r in store.audit_log("s").collect()] == ["ANALYZE", "PARSE"]
    assert "abcdefgh" not in store.audit_log("s").collect()[1].args
    assert sessions.moves(spark).count() == sum(map(len, sessions.MOVES.values()))


def test_suggestions(spark):
    files = spark.createDataFrame([("a.sql", "select a from t")], "path string, raw string")
    rows = [(i, "a.sql", *r) for i, r in enumerate([(7, 8, "a", "b", 0.9, ""), (7, 8, "a", "a", 0.9, ""), (7, 8, "a", "c", 0.2, ""), (7, 99, "a", "c", 0.9, ""), (7, 8, "x", "c", 0.9, ""), (7, 8, "a", "z", 0.9, ""), (7, 8, None, "z", 0.9, "")])]
    suggested = spark.createDataFrame(rows, f"ordinal int, {suggestions.FIELDS}")
    planned = spark.createDataFrame([("a", "z")], "before string, after string")
    good, bad = suggestions.validate(suggested, files, planned)
    assert [(r.rule_id, r.after) for r in good.collect()] == [("LLM-1", "b")]
    assert {r.ordinal for r in bad.collect()} == {1, 2, 3, 4, 5, 6}
    answers = iter(["nonsense", '[{"path": "a"}]'])
    assert suggestions.request(lambda p: next(answers), "x", wait=0) == [{"path": "a"}]
    assert "select a" in suggestions.prompt(files).first().prompt


def test_plugins(tmp_path):
    (tmp_path / "a.py").write_text("class R:\n id='P-1'; version=1; tier='safe'; description='d'\n def analyze(self, text, toks, schemas):\n  yield 0, 1, 'X', 'r'\nRULE = R()\nDUP = R()\n")
    (tmp_path / "b.py").write_text("raise ValueError('no')\n")
    said = []
    rules = plugins.load(str(tmp_path), said.append)
    assert list(rules)[-1] == "P-1" and len(said) == 2
    assert rewrite.analyse_text("abc", {}, {"P-1": rules["P-1"]})[0].after == "X"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "staging").mkdir()
    (tmp_path / "staging/stg.sql").write_text("select id, name from raw_orders")
    (tmp_path / "fct.sql").write_text("select id, name, email from {{ ref('stg') }}")
    assert cli.main(["drift", str(tmp_path), "--store", f"file://{tmp_path}/s", "--markdown"]) == 1
    out = capsys.readouterr().out
    assert "- removed: `email`" in out and "references missing stage `raw_orders`" in out
    assert cli.main(["history", str(tmp_path), "--store", f"file://{tmp_path}/s"]) == 0
    assert cli.main(["lineage", str(tmp_path)]) == 0
    assert "stg\tfct\tref" in capsys.readouterr().out
    (tmp_path / "x.py").write_text("os.system(a)\n")
    assert cli.main(["scan", str(tmp_path)]) == 1
    assert cli.main(["scan", str(tmp_path), "--fail-on-severity", "none"]) == 0
    assert cli.main(["drift", str(tmp_path / "none")]) == 2
    (tmp_path / "bad.sql").write_text("select 'open")
    assert cli.main(["parse", str(tmp_path)]) == 2


def test_report_and_envelope(spark):
    drifts = spark.createDataFrame([("p", "c", ["x"], ["y"], [("a", "b")], True)], "producer string, consumer string, added array<string>, removed array<string>, renamed array<struct<old:string,new:string>>, breaking boolean")
    edges = spark.createDataFrame([("p", "c")], "producer string, consumer string")
    missing = spark.createDataFrame([], "consumer string, ref string")
    got = report.text(edges, edges, missing, drifts).first().report
    assert got == "stages=1 edges=1 missing_refs=0 drifts=1 breaking=1\n  p -> c: removed: y; renamed: a->b; added: x"
    assert report.envelope("edges", edges).first().json == '{"items":[{"consumer":"c","producer":"p"}],"schema":"weirflow.edges.v1","v":1}'


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "error", 1.0), (1, "2024-01-01 00:00:00", 1, "error", 1.0), (2, "2024-01-01 00:10:00", 1, "error", 2.0)], "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, df, mode in (("deduped", events.once(events.read(spark, str(tmp_path / "in"), rows.schema)), "append"), ("tripped", events.breaker(events.read(spark, str(tmp_path / "in"), rows.schema), limit=3), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("deduped").count() == 2
    assert spark.table("tripped").first().open
    assert events.windowed(rows).count() == 1
