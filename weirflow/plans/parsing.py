"""Parser queries over SQL text generated from the driver tables; the oracle computes the answers from the pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators import lex, parse
from weirflow.plans.registry import query

# One model per part: a CTE, aliases, an expression without a name, a template, a comment and a quoted string.
_TEXT = """'WITH base AS (SELECT a, b FROM raw_' || (p_partkey % 7) || ')' || chr(10) || 'SELECT id, t.c' || (p_partkey % 5) || ' AS v' || (p_partkey % 11) || ', amount * ' || (p_partkey % 3) || ' AS Fee, t.price, price + 1' || chr(10) || 'FROM {{ ref(''stg_' || (p_partkey % 50) || ''') }} t -- ' || p_brand || chr(10) || 'WHERE x = ''it''''s, (ok'' AND y IN (1, 2)'"""
_FILES = f"(select 'm' || p_partkey || '.sql' as path, p_partkey as k, p_brand as brand, {_TEXT} as raw from part)"
_PIECE = r"--[^\n]*|/\*(?s:.*?)\*/|\{\{|\}\}|\{%|%\}|\{#|#\}|''[^''\n]*(?:''''[^''\n]*)*''|\"[^\"\n]*\"|`[^`\n]*`|[0-9][0-9._]*|[\p{L}_][\p{L}\p{N}_]*|<=|>=|<>|!=|\|\||::|->|:=|==|\s+|(?s:.)"


def _files(t):
    return t.part.select(F.expr(_TEXT).alias("raw"), F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".sql")).alias("path"))


@query(f"select piece as value, count(*) as n from (select unnest(regexp_extract_all(raw, '{_PIECE}')) as piece from {_FILES}) group by piece")
def lex_token_counts(t):
    return lex.tokens(_files(t)).groupBy("value").agg(F.count("*").alias("n"))


@query(f"select path, length(raw) as chars, octet_length(encode(raw)) as bytes, length(raw) - length(replace(raw, chr(10), '')) + 1 as lines from {_FILES}")
def lex_positions(t):
    return lex.tokens(_files(t)).groupBy("path").agg(F.max("end").alias("chars"), F.max("byte_end").alias("bytes"), F.max("line").alias("lines"))


@query(
    f"""select path, unnest([0, 1, 2, 3, 4])::bigint as ordinal, unnest(['id', 'v' || (k % 11), 'fee', 'price', null]) as name,
        unnest(['id', 't.c' || (k % 5) || ' AS v' || (k % 11), 'amount * ' || (k % 3) || ' AS Fee', 't.price', 'price + 1']) as source_expr, unnest([null, 'v' || (k % 11), 'fee', null, null]) as alias from {_FILES}"""
)
def projection_columns(t):
    return parse.projection_columns(_files(t)).select("path", "ordinal", "name", "source_expr", "alias")


@query(f"select path, 'stg_' || (k % 50) as name, 'ref' as kind from {_FILES}")
def ref_source_extract(t):
    return parse.refs(_files(t)).select("path", "name", "kind")


@query("select 'c' || c_custkey as path, 'raw' as source, 't' || (c_nationkey % 4) as \"table\" from customer")
def source_extract(t):
    made = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.expr("concat('select id from {{ source(\"RAW\", ''T', c_nationkey % 4, ''') }} union all select id from {{source( ''raw'' , ''t', c_nationkey % 4, ''')}}')").alias("raw"))
    return parse.sources(made).select("path", "source", "table")


@query("select 's' || s_suppkey as path, case when s_suppkey % 3 = 0 then 'mv_' || s_suppkey when s_suppkey % 3 = 1 then 't_' || s_suppkey end as created from supplier")
def create_name(t):
    text = F.expr("case s_suppkey % 3 when 0 then concat('-- create table no\\nCREATE OR REPLACE MATERIALIZED VIEW Dw.\"MV_', s_suppkey, '\" AS select 1') when 1 then concat('create temp table t_', s_suppkey, ' as select 1') else 'select 1' end")
    return t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), parse.create_name(text).alias("created"))


@query("select 's' || s_suppkey as path, unnest(case when s_nationkey % 3 = 0 then ['raw_' || s_nationkey] when s_nationkey % 3 = 1 then ['inner_' || s_nationkey, 'cte'] else ['events'] end) as name from supplier")
def bare_from_refs(t):
    text = F.expr("case s_nationkey % 3 when 0 then concat('select a from Raw_', s_nationkey, ' r join other o on r.id = o.id') when 1 then concat('with cte as (select x from inner_', s_nationkey, ') select x from cte') else 'select extract(year from ts) as y from events where d in (select 1 from a.b)' end")
    return parse.bare_refs(t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), text.alias("raw"))).select("path", "name")


@query("select n_nationkey, n_nationkey % 4 in (0, 2) as hint from nation")
def template_hint_flag(t):
    text = F.expr("case n_nationkey % 4 when 0 then '{{ var(\"x\") }} select 1' when 1 then '{{ config(a=1) }} {# if x #} select {{ ref(\"a\") }}' when 2 then '{% if a %} select 1 {% endif %}' else 'select f(1)' end")
    return t.nation.select("n_nationkey", parse.template_hint(text).alias("hint"))


@query("select kind, count(*) as n from (select case s_suppkey % 4 when 0 then 'error' when 1 then 'warning' when 2 then 'warning' end as kind from supplier) where kind is not null group by kind")
def diagnostics_by_kind(t):
    text = F.expr("case s_suppkey % 4 when 0 then 'SELECT ''open FROM t' when 1 then 'INSERT INTO x VALUES (1)' when 2 then 'SELECT * FROM t' else 'SELECT a FROM t' end")
    files = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), text.alias("raw"))
    return parse.diagnostics(files).groupBy("kind").agg(F.count("*").alias("n"))


@query("select * from (values ('raw', 'orders'), ('raw', 'items'), ('crm', 'people')) as t(source, \"table\")")
def sources_yml_catalog(t):
    from weirflow.sources.files import catalog_rows

    lines = t.spark.sql("select 'sources.yml' as path, * from values (1, 'sources:'), (2, '  - name: RAW'), (3, '    tables:'), (4, '      - name: orders'), (5, '      - name: \"items\"'), (6, '  - name: crm'), (7, '    tables:'), (8, '      - name: people') as t(n, line)")
    return catalog_rows(lines).select("source", "table")


_STAGE = """'{"columns":[{"alias":null,"name":"id","source_expr":"id"},{"alias":"v' || (k % 11) || '","name":"v' || (k % 11) || '","source_expr":"t.c' || (k % 5) || ' AS v' || (k % 11) || '"},{"alias":"fee","name":"fee","source_expr":"amount * ' || (k % 3) || ' AS Fee"},{"alias":null,"name":"price","source_expr":"t.price"}],"create_name":null,"ctes":[{"name":"base"}],"fingerprint":"","kind":"model","name":"m' || k || '","refs":[{"kind":"ref","name":"stg_' || (k % 50) || '"}],"schema":"weirflow.stage.v1","sources":[],"v":1}'"""


@query(f"select path, 'm' || k as name, 'base' as ctes, 'sha256:' || sha256({_STAGE}) as fingerprint from {_FILES}")
def stage_fingerprints(t):
    return parse.stages(_files(t)).select("path", "name", F.array_join(F.transform("ctes", lambda c: c["name"]), ",").alias("ctes"), "fingerprint")


@query(f"select 'sha256:' || sha256('[' || string_agg('\"' || f || '\"', ',' order by f) || ']') as fingerprint from (select 'sha256:' || sha256({_STAGE}) as f from {_FILES})")
def pipeline_fingerprint(t):
    return parse.pipeline_fingerprint(parse.stages(_files(t)))


@query("select 's' || s_suppkey as path, unnest(case s_suppkey % 3 when 0 then ['orders_' || s_suppkey] when 1 then ['two'] else [] end) as name from supplier")
def refs_outside_strings(t):
    """Calls are looked for outside strings and comments, and what looks like a comment inside a string is none."""
    text = F.expr("case s_suppkey % 3 when 0 then concat('select ''--'' as a from {{ ref(\"Orders_', s_suppkey, '\") }}') when 1 then 'select ''ref(\"q\")'' as a /* ref(''r'') */ from {{ ref( pkg, ''Two'', ''three'') }} -- ref(''s'')' else 'select ''{{ ref(\"q\") }}'' as a from t' end")
    return parse.refs(t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), text.alias("raw"))).select("path", "name")


@query("select kind, sum(n)::bigint as n from (select count(*) as rows from part), (values ('WORD', 28), ('OP', 17), ('NUMBER', 4), ('STRING', 2), ('TEMPLATE_OPEN', 1), ('TEMPLATE_CLOSE', 1), ('COMMENT', 1)) as k(kind, each), lateral (select rows * each as n) group by kind")
def lex_kinds(t):
    """Kinds of the pieces of one known text, counted by hand; spaces apart."""
    return lex.tokens(_files(t)).where("kind <> 'SPACE'").groupBy("kind").agg(F.count("*").alias("n"))
