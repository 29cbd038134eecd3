"""Positions, columns, references and diagnostics of small SQL files."""

from __future__ import annotations

import pytest

from weirflow.operators import lex, parse

STG = "SELECT\n    order_id,\n    customer_id,\n    o.amount AS amount,\n    status\nFROM raw_orders o\n"


def files(spark, **raw):
    return spark.createDataFrame([(f"{k}.sql", v) for k, v in raw.items()], "path string, raw string")


def test_pieces_add_up(spark):
    text = "SELECT 'it''s', \"Q\" /* c\nd */ FROM {{ ref('x') }} -- é\n WHERE a->>b <> 😀"
    toks = lex.tokens(files(spark, a=text)).orderBy("pos").collect()
    assert "".join(t.value for t in toks) == text
    assert all(text[t.start : t.end] == t.value for t in toks)
    assert toks[-1].byte_end == len(text.encode())


def test_columns_and_spans(spark):
    rows = parse.projection_columns(files(spark, stg=STG)).orderBy("ordinal").collect()
    assert [(r.name, r.alias, r.source_expr, r.byte_start, r.byte_end) for r in rows] == [("order_id", None, "order_id", 11, 19), ("customer_id", None, "customer_id", 25, 36), ("amount", "amount", "o.amount AS amount", 42, 60), ("status", None, "status", 66, 72)]


@pytest.mark.parametrize(
    ("text", "columns", "names"),
    [
        ("WITH cte AS (SELECT id FROM a)\nSELECT id, name FROM cte", ["id", "name"], ["a", "cte"]),
        ("SELECT id FROM a UNION ALL SELECT id FROM b", ["id"], ["a", "b"]),
        ("SELECT x FROM (SELECT x FROM t) s", ["x"], ["t"]),
        ("SELECT EXTRACT(YEAR FROM ts) AS year FROM events", ["year"], ["events"]),
        ('SELECT "OrderId", `created_at` FROM raw', ["orderid", "created_at"], ["raw"]),
        ("SELECT amount * 0.2, amount * 0.8 AS fee FROM raw", ["fee"], ["raw"]),
        ("SELECT a.*, a.id FROM t a", ["id"], ["t"]),
        ("SELECT id FROM {{ ref('Stg') }} JOIN {{ ref(\"b\") }} USING (id)", ["id"], ["stg", "b"]),
    ],
)
def test_shapes(spark, text, columns, names):
    f = files(spark, m=text)
    assert [r.name for r in parse.projection_columns(f).where("name is not null").orderBy("ordinal").collect()] == columns
    assert [r.name for r in parse.refs(f).unionByName(parse.bare_refs(f)).orderBy("ordinal").collect()] == names


def test_diagnostics(spark):
    f = files(spark, e="SELECT 'open FROM t", n="INSERT INTO x VALUES (1)", s="SELECT * FROM t", h="{{ var('x') }} SELECT a FROM t", ok="SELECT a FROM t")
    got = {(r.path, r.kind, r.reason.split()[0]) for r in parse.diagnostics(f).collect()}
    assert got == {("e.sql", "error", "unexpected"), ("n.sql", "warning", "no"), ("s.sql", "warning", "SELECT"), ("h.sql", "warning", "unknown_template_region")}


def test_fingerprint_ignores_layout(spark):
    a = parse.stages(files(spark, stg=STG)).first()
    b = parse.stages(files(spark, stg=STG.replace("\n    ", " "))).first()
    c = parse.stages(files(spark, stg=STG.replace("status", "state"))).first()
    assert a.fingerprint == b.fingerprint != c.fingerprint
    assert [x.name for x in a.refs] == ["raw_orders"]
    assert parse.stages(files(spark, m="CREATE OR REPLACE MATERIALIZED VIEW s.mv_name AS SELECT id FROM x")).first().name == "mv_name"


def test_calls_hidden_in_strings_and_comments(spark):
    f = files(
        spark,
        a="select '--' as a, x from {{ ref('Orders') }}",
        b="select 'ref(\"q\")' as a from t",
        c="-- ref('no')\nselect /* source('a', 'b') */ 1 from {{ source( 'Raw' , /* ) */ \"Items\" ) }} -- {{ ref('z') }}",
        d="select ref(pkg, 'Two', 'three') from {{ ref('two') }} join my_ref('x') on true",
        e="select '{{ var(1) }}' as a from {{ ref ('five', v=2) }}",
    )
    assert {(r.path, r.name) for r in parse.refs(f).collect()} == {("a.sql", "orders"), ("d.sql", "two"), ("e.sql", "five")}
    assert [(r.path, r.source, r.table) for r in parse.sources(f).collect()] == [("c.sql", "raw", "items")]
    hints = {r.path: r.h for r in f.select("path", parse.template_hint("raw").alias("h")).collect()}
    assert not any(hints.values())
    made = f.where("path = 'a.sql'").select(parse.create_name(parse.F.lit("select 'create table no' as x; create view Dw.\"Yes\" as select 1")).alias("n")).first().n
    assert made == "yes"


def test_ctes_and_fingerprints(spark):
    raw = "WITH a AS (SELECT 1 AS x), \"B\" AS NOT MATERIALIZED (WITH inner_one AS (SELECT f(2), 3 AS y) SELECT y FROM inner_one), c (SELECT 1) SELECT x, g(1), h FROM a, b WHERE z IN (SELECT 1)"
    f = files(spark, m=raw, plain="SELECT x, g(1), h FROM a, b", again=raw.replace(" ", "\n"))
    assert [r.name for r in parse.ctes(f).where("path = 'm.sql'").orderBy("ordinal").collect()] == ["a", "inner_one", "b"]
    got = {r.path: r for r in parse.stages(f.where("path <> 'again.sql'").union(f.where("path = 'again.sql'").withColumn("path", parse.F.lit("dir/m.sql")))).collect()}
    assert got["m.sql"].fingerprint == got["dir/m.sql"].fingerprint != got["plain.sql"].fingerprint
    assert [c.name for c in got["m.sql"].ctes] == ["a", "inner_one", "b"] and got["plain.sql"].ctes == []
    whole = parse.pipeline_fingerprint(parse.stages(f)).first().fingerprint
    assert whole == parse.pipeline_fingerprint(parse.stages(f.repartition(3))).first().fingerprint and whole.startswith("sha256:")
