"""Commands beyond the basic ones, their artifacts and errors; parsers by extension; store upkeep."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weirflow import cli
from weirflow.operators import dialects, flow, history, parse, rewrite
from weirflow.sources import files
from weirflow.sources.store import Store


def test_gate_and_artifacts(spark, tmp_path, capsys):
    root = tmp_path / "m"
    root.mkdir()
    (root / "stg.sql").write_text("with base as (select id from raw) select id, name from base")
    (root / "fct.sql").write_text("select id, email from {{ ref('stg') }}")
    arts = ["--artifacts-dir", str(tmp_path / "out")]
    assert cli.main([str(root), "--json", *arts]) == 1
    said = json.loads(capsys.readouterr().out)
    assert said["schema"] == "weirflow.drift.v1" and said["gate"] == "failed" and said["counts"]["breaking"] == 1
    assert json.loads((tmp_path / "out/report.json").read_text()) == said
    assert cli.main(["diff", str(root)]) == 1 and "-email" in capsys.readouterr().out
    assert cli.main(["inspect", str(root), "--json"]) == 0
    shown = {s["name"]: s for s in json.loads(capsys.readouterr().out)["stages"]}
    assert shown["stg"]["ctes"] == [{"name": "base"}] and shown["fct"]["spans"][0]["byte_start"] == 7
    assert cli.main(["lineage", str(root)]) == 0
    out = capsys.readouterr().out
    assert "stg\tfct\tref" in out and out.index("# order") > out.index("# missing")
    assert cli.main(["nonsense"]) == 2
    (root / "x.py").write_text("os.system(a)\nos.system(b)\n")
    assert cli.main(["scan", str(root), "--max-findings", "1", *arts]) == 5
    assert json.loads((tmp_path / "out/error.json").read_text())["code"] == "resource_limit"
    assert cli.main(["scan", str(root), "--severity", "critical"]) == 0
    assert cli.main(["parse", str(root), "--max-stages", "1"]) == 5
    with pytest.raises(SystemExit) as left:
        cli.main(["--version"])
    assert left.value.code == 0


def test_dry_run_session_and_export(spark, tmp_path, capsys):
    root, store = tmp_path / "m", f"file://{tmp_path}/st"
    root.mkdir()
    (root / "a.sql").write_text("select ID from T")
    plan = ["--store", store, "--session", "s", "--plan", str(tmp_path / "p.json")]
    assert cli.main(["plan", str(root), *plan, "--max-risk", "safe"]) == 0
    capsys.readouterr()
    assert cli.main(["dry-run", str(root), *plan, "--json", "--artifacts-dir", str(tmp_path / "out")]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["summary"]["will_apply"] == 1 and "+select id from t" in said["items"][0]["diff"]
    assert (root / "a.sql").read_text() == "select ID from T" and (tmp_path / "out/diffs/a.sql.diff").exists()
    assert cli.main(["session", str(root), "--store", store, "--session", "s", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["state"] == "planned"
    assert cli.main(["audit", str(root), "--store", store, "--since", "1"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert cli.main(["audit", str(root), "--store", store, "--since", "2999-01-01"]) == 0
    assert capsys.readouterr().out == ""
    assert cli.main(["export", str(root), "--store", store, "--out", f"file://{tmp_path}/ex"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/ex/audit").count() == 3
    assert cli.main(["plan", str(root), *plan, "--no-persist"]) == 2


def test_unparsable_results_are_not_written(spark):
    rows = spark.createDataFrame([("a.sql", "select 1 x", "select ' x", 1, "applied"), ("b.sql", "select 1", "select 2", 1, "applied")], "path string, raw string, rewritten string, edits int, status string")
    got = {r.path: (r.status, r.rewritten) for r in flow.sound(rows).collect()}
    assert got == {"a.sql": ("unparsable", "select 1 x"), "b.sql": ("applied", "select 2")}


def test_parsers_by_extension(spark):
    class Upper(dialects.SqlParser):
        def stages(self, found):
            return parse.stages(found.withColumn("raw", F.regexp_replace("raw", "^PICK", "SELECT")))

    dialects.register("HQL", Upper())
    try:
        with pytest.raises(ValueError, match="has a parser"):
            dialects.register("hql", Upper())
        with pytest.raises(ValueError, match="protocol"):
            dialects.register("x", object())
        mixed = spark.createDataFrame([("a.sql", "SELECT x FROM t"), ("b.hql", "PICK y FROM t"), ("c.txt", "SELECT z FROM t")], "path string, raw string")
        assert {(r.path, r.columns[0].name) for r in dialects.stages(mixed).collect()} == {("a.sql", "x"), ("b.hql", "y")}
    finally:
        del dialects.PARSERS["hql"]


def test_bytes_outside_utf8(spark, tmp_path):
    (tmp_path / "a.sql").write_bytes(b"select '\xff' as a")
    assert files.project(spark, str(tmp_path)).first().raw == "select '�' as a"


def test_store_migration(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/st")
    spark.createDataFrame([(1, "r")], "run_id long, root string").write.parquet(f"{store.folder}/runs")
    assert store.migrate() == 1 and store.migrate() == 0
    assert store.read("runs").first().asDict() == {"run_id": 1, "root": "r", "checked_at": None, "stages": None, "drifts": None, "breaking": None}
    assert history.kpis(store.read("runs"), store.read("scans"), store.read("drifts")).first().runs == 1


def test_a_cte_in_a_template_or_in_quotes_is_read():
    rule = {"REF-001": rewrite.RULES["REF-001"]}
    for raw in ("with base as (select 1) select {{ star(base) }} from t", 'with base as (select 1) select 1 from "BASE"', "with base as (select 1) select 1 from {{ base }}"):
        assert rewrite.analyse_text(raw, {}, rule) == []
    assert len(rewrite.analyse_text("with base as (select {{ base }}) select 'base' from t", {}, rule)) == 1


def test_example_plugin_packs_and_table_function(spark):
    from pathlib import Path

    from weirflow.operators import plugins, security

    said = []
    rules = plugins.load(str(Path(__file__).parents[1] / "examples/plugins"), said.append)
    assert not said and rewrite.analyse_text("select 1;", {}, {"EX-001": rules["EX-001"]})[0].before == ";"
    spark.udtf.register("rewrite_rules", rewrite.table_function({"REF-002": rewrite.RULES["REF-002"]}))
    spark.createDataFrame([("a", "select sku, n, sku from bins"), ("b", "select sku from bins")], "path string, raw string").createOrReplaceTempView("udtf_files")
    got = spark.sql("select path, rule_id, before from udtf_files, lateral rewrite_rules(raw)").collect()
    assert [tuple(r) for r in got] == [("a", "REF-002", ", sku")]

    class Point:
        def __init__(self, name, rules):
            self.name, self.rules = name, rules

        def load(self):
            return dict(self.rules)

    todo = {"PACK-1": (lambda text: security.occurrences(text, "TODO", "low"), False), "SEC-001": None}
    packs = plugins.packs(said.append, [Point("a", todo), Point("b", 7)])
    assert list(packs) == ["PACK-1"] and len(said) == 2
    files_ = spark.createDataFrame([("x.py", "py", "a = 1\n# TODO later")], "path string, ext string, content string")
    found = security.scan(files_, ["PACK-1"], catalog=packs).first()
    assert (found.rule_id, found.line, found.col, found.hint) == ("PACK-1", 2, 3, None)


def test_http_client():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from weirflow.operators import suggestions

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"response": json.dumps([{"path": asked["prompt"]}]) if asked["prompt"] else ""}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = suggestions.http_client(f"http://127.0.0.1:{server.server_port}/api", "m", 5)
    assert suggestions.request(client, "a.sql") == [{"path": "a.sql"}]
    with pytest.raises(suggestions.Unavailable):
        client("")
    server.shutdown()
    with pytest.raises(suggestions.Unavailable):
        suggestions.http_client("http://127.0.0.1:9/api", "m", 1)("x")


def test_restore_point(spark, tmp_path, capsys):
    root, store = tmp_path / "m", f"file://{tmp_path}/st"
    (root / "sub").mkdir(parents=True)
    (root / "sub/a.sql").write_text("select ID from T")
    common = ["--store", store, "--session", "s"]
    plan = ["--plan", str(tmp_path / "p.json")]
    assert cli.main(["restore", str(root), *common]) == 2
    assert cli.main(["plan", str(root), *common, *plan, "--max-risk", "safe"]) == 0
    assert cli.main(["approve", str(root), *common]) == 0
    assert cli.main(["apply", str(root), *common, *plan]) == 0
    assert (root / "sub/a.sql").read_text() == "select id from t"
    capsys.readouterr()
    assert cli.main(["restore", str(root), *common]) == 0
    assert capsys.readouterr().out == "sub/a.sql\n" and (root / "sub/a.sql").read_text() == "select ID from T"


def test_run_events(spark):
    log = spark.createDataFrame([(1, 0, "snapshot_ok", "READY"), (1, 1, "dispatch", "RUNNING"), (1, 2, "all_succeeded", "SUCCEEDED"), (1, 3, "resume", "RUNNING"), (2, 0, "dispatch", "RUNNING")], "run long, n int, event string, after string")
    got = {(r.run, r.n): r.valid for r in history.check_events(log, history.RUN_MOVES, "CREATED", "run", ["n"]).collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 2): True, (1, 3): False, (2, 0): False}
