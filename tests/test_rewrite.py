"""Before and after of each rewrite rule and guard, and plans on DataFrames."""

from __future__ import annotations

import pytest

from weirflow.operators import rewrite


def edits(rule, raw, schemas=None):
    return rewrite.analyse_text(raw, schemas or {}, {rule: rewrite.RULES[rule]})


def rewritten(rule, raw, schemas=None):
    for e in sorted(edits(rule, raw, schemas), key=lambda e: -e.start):
        assert raw[e.start : e.end] == e.before
        raw = raw[: e.start] + e.after + raw[e.end :]
    return raw


@pytest.mark.parametrize(
    ("rule", "raw", "after"),
    [
        ("REF-001", "with spare as (select 9 as n), kept as (select sku from bins) select sku from kept", "with kept as (select sku from bins) select sku from kept"),
        ("REF-001", "with first_one as (select sku from bins), last_one as (select 3) select sku from first_one", "with first_one as (select sku from bins) select sku from first_one"),
        ("REF-001", "with lonely as (select 7 as n)\nselect count(*) from bins", "\nselect count(*) from bins"),
        ("REF-001", "with shelf as (select sku from bins) select s.sku from shelf s", None),
        ("REF-001", "with gone as (delete from bins returning sku) select current_date", None),
        ("REF-002", "select sku, weight, colour, weight from bins", "select sku, weight, colour from bins"),
        ("REF-002", "select weight, weight as heft from bins", None),
        ("REF-002", "select upper( sku ) as s, price, UPPER( SKU ) as s from bins", "select upper( sku ) as s, price from bins"),
        ("REF-003", "with shelf as (select sku from bins where n > 2) select sku from shelf", "with shelf as (select sku from bins where n > 2) select sku from (select sku from bins where n > 2)"),
        ("REF-003", "with shelf as (select sku from bins) select 1 from shelf l, shelf r where l.sku < r.sku", None),
        ("REF-003", "with recursive up as (select sku from up) select sku from up", None),
        ("REF-003", "with top as (select sku from bins order by n desc) select sku from top", None),
        ("REF-003", "with few as (select sku from bins limit 4) select sku from few", None),
        ("REF-004", "select Sku, bins.Weight from Bins", "select sku, bins.weight from bins"),
        ("REF-004", "select {{ ref('Shelf') }}.Sku, 'Red' from Shelf", "select {{ ref('Shelf') }}.sku, 'Red' from shelf"),
        ("REF-004", "SELECT sku FROM bins", None),
        ("REF-006", "select sku from bins shelf where n = 1", "select sku from bins  where n = 1"),
        ("REF-006", "select sku from bins as shelf", "select sku from bins"),
        ("REF-006", "select shelf.sku from bins shelf", None),
        ("REF-007", "select count(*) from (select sku from bins order by weight desc, sku) listed", "select count(*) from (select sku from bins) listed"),
        ("REF-007", "with listed as (select sku from bins order by 1) select sku from listed", "with listed as (select sku from bins) select sku from listed"),
        ("REF-007", "select sku from bins where sku not in (select sku from lost order by found_at -- newest\n)", "select sku from bins where sku not in (select sku from lost)"),
        ("REF-007", "select count(*) from (select sku from bins order by weight fetch first 3 rows only) heavy", None),
        ("REF-007", "select count(*) from (select sku from bins order by weight offset 10) light", None),
        ("REF-007", "select count(*) from (select sku from bins intersect select sku from lost order by 1) both", None),
        ("REF-007", "select rank() over (partition by colour order by weight) from bins", None),
        ("REF-007", "select sku, weight from bins order by weight", None),
        ("REF-007", "select count(*) from (select sku from {{ source('wh', 'bins') }} order by sku) listed", None),
        ("REF-007", "update bins set n = 0 where sku in (select sku from lost order by sku)", None),
        ("REF-007", "select 1 from (select sku from bins where n in (select n from lost order by n) order by sku) q", "select 1 from (select sku from bins where n in (select n from lost)) q"),
    ],
)
def test_rule(rule, raw, after):
    assert rewritten(rule, raw) == (raw if after is None else after)
    assert (after is None) == (not edits(rule, raw))


def test_star_expansion():
    assert [(e.before, e.after) for e in edits("REF-005", "select * from bins", {"bins": ["weight", "sku"]})] == [("* ", "sku, weight")]
    assert rewritten("REF-005", "select shelf.* from bins as shelf", {"bins": ["sku"]}) == "select shelf.sku from bins as shelf"
    assert not edits("REF-005", "select * from nowhere", {"bins": ["sku"]})
    assert not edits("REF-005", "select * from bins join lost using (sku)", {"bins": ["sku"], "lost": ["sku"]})


def test_tiers_and_unknown_rules():
    assert set(rewrite.choose(None, "safe")) == {"REF-001", "REF-002", "REF-004", "REF-006"}
    with pytest.raises(ValueError, match="unknown"):
        rewrite.choose(["REF-999"])


def test_plan_and_apply(spark):
    raw = "select ID, name, id from T x"
    stages = spark.createDataFrame([("a.sql", "a", raw, ["id"])], "path string, name string, raw string, columns array<string>")
    found = rewrite.disjoint(rewrite.candidates(stages, most_tier="safe"))
    findings = spark.createDataFrame([("a.sql", (0, 3), "SEC-001", "critical", "open")], "path string, span struct<start:int,end:int>, rule_id string, severity string, status string")
    laid = rewrite.overlay(found, findings)
    assert laid.where("blocked").count() == 0
    items = rewrite.plan(laid)
    assert [r.change_id for r in items.orderBy("ordinal").collect()] == [f"c{i}" for i in range(items.count())]
    done = rewrite.apply(stages, items).first()
    assert done.status == "applied"
    again = rewrite.apply(stages.withColumn("raw", rewrite.F.lit("changed")), items).first()
    assert again.status == "stale" and again.rewritten == "changed"
    blocked = rewrite.overlay(found, findings.withColumn("span", rewrite.F.expr("named_struct('start', 0, 'end', 100)")))
    assert blocked.where("not blocked").count() == 0
    assert rewrite.overlay(found, findings.withColumn("span", rewrite.F.expr("named_struct('start', 0, 'end', 100)")), allow=True).where("blocked").count() == 0


def test_verify_diff_and_plan_files(spark, tmp_path):
    raw = "select ID, id from T"
    stages = spark.createDataFrame([("a.sql", "a", raw, ["id"])], "path string, name string, raw string, columns array<string>")
    none = spark.createDataFrame([], "rule_id string, severity string, path string, line int, col int, span struct<start:int,end:int>, status string")
    items = rewrite.plan(rewrite.overlay(rewrite.disjoint(rewrite.candidates(stages, ["REF-004"])), none))
    digest = rewrite.plan_hash(items, "root", "sha256:x", "safe").first().plan_hash
    rewrite.write_plan(items, str(tmp_path / "plan.json"), digest)
    again, same = rewrite.read_plan(spark, str(tmp_path / "plan.json"))
    assert same == digest and [r.item_hash for r in again.collect()] == [r.item_hash for r in items.collect()]
    done = rewrite.apply(stages, again)
    assert "+select id, id from t" in rewrite.file_diffs(done).first()["diff"]
    after = stages.drop("raw").join(done.select("path", done.rewritten.alias("raw")), "path")
    assert {r.rule_id for r in rewrite.verify(stages, none, most_tier="safe").collect()} <= {"REF-002", "REF-004"}
    assert {r.rule_id for r in rewrite.verify(after, none, rule_ids=["REF-004"]).collect()} == set()
    bad = spark.createDataFrame([("SEC-003", "high", "a.sql", 1, 1, (0, 5), "open")], none.schema)
    assert [r.problem for r in rewrite.verify(after, bad, rule_ids=["REF-004"]).collect()] == ["finding"]
    assert rewrite.verify(after, bad, rule_ids=["REF-004"], baseline=bad).count() == 0
    accepted = spark.createDataFrame([("a.sql", 0, 6, "select", "SELECT", 0.9, "r", "LLM-1", "risky")], "path string, start int, end int, before string, after string, confidence double, rationale string, rule_id string, tier string")
    assert {r.rule_id for r in rewrite.merge_suggestions(items, accepted, none).collect()} == {"REF-004", "LLM-1"}


def test_orchestration(spark):
    from weirflow.operators import history

    files = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, content string")
    assert history.snapshot_fingerprint(files).first() == history.snapshot_fingerprint(files.repartition(3)).first()
    rows = spark.range(100)
    assert [r.id for r in history.sample(rows, "id", "s", 5).collect()] == [r.id for r in history.sample(rows.repartition(7), "id", "s", 5).collect()]
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "9")], "path string, hash string")
    want = spark.createDataFrame([("a", "1", "x"), ("b", "0", "2"), ("c", "0", "1"), ("d", "0", "1")], "path string, old_hash string, new_hash string")
    assert {tuple(r) for r in history.compare_and_set(now, want).collect()} == {("a", "applied"), ("b", "noop"), ("c", "conflict"), ("d", "missing")}
    failed = spark.sql("select 1 as attempt, timestamp '2024-01-01 00:00:00' as failed_at union all select 3, timestamp '2024-01-01 00:00:00'")
    again, dead = history.retry_schedule(failed)
    assert str(again.first().retry_after) == "2024-01-01 00:00:02" and dead.count() == 1


def test_numbering_of_a_whole_table_without_one_task(spark):
    from weirflow.operators import history

    rows = spark.range(4000).selectExpr("id", "if(id % 50 = 0, null, id * 7919 % 13) as day").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = history.numbered(rows, ["day", "id"]).checkpoint()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(((r.day is not None, r.day or 0, r.id) for r in rows.collect()))
    assert {r.id: r.change_id for r in got.collect()} == {x[2]: f"c{i}" for i, x in enumerate(want)}
    assert got.select("change_id").distinct().count() == 4000
    ranges = history.numbered(rows, ["day", "id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(day" not in ranges and "_range" in ranges
