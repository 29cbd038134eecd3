"""Security and rewriting queries over documents and over text generated from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.functions import text as tf
from weirflow.operators import rewrite, security
from weirflow.plans.registry import query

_KEYS = r"(?:password|passwd|api[_-]?key|token|secret|client[_-]?secret)"
_ENTROPY = "-list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: len(list_filter(string_split(v, ''), lambda d: d = c)) / length(v) * log2(len(list_filter(string_split(v, ''), lambda d: d = c)) / length(v))))"


def _documents(t):
    return t.documents.select(F.col("doc_id").alias("path"), F.lit("py").alias("ext"), "doc_id", F.col("text").alias("content"))


@query(rf"select doc_id, length(v) as n, round({_ENTROPY}, 6) as entropy from (select doc_id, unnest(regexp_extract_all(text, '(?i){_KEYS}\s*[:=]\s*[''\x22]([^''\x22\s]{{20,}})[''\x22]', 1)) as v from documents) where {_ENTROPY} >= 3.5")
def secret_entropy_scan(t):
    found = security.secrets(_documents(t)).where("severity = 'high'")
    value = F.regexp_extract("found", security._ASSIGNED, 1)
    return found.select("doc_id", F.length(value).cast("long").alias("n"), F.round(tf.entropy(value), 6).alias("entropy"))


_PREFIX = tf.SECRET_PREFIX
_REDACTED = rf"regexp_replace(regexp_replace(text, '{_PREFIX}', '<redacted>', 'g'), '(?i)({_KEYS})\s*[:=]\s*[''\x22]?[^''\x22\s,;)]{{6,}}[''\x22]?', '\1=<redacted>', 'g')"


@query(f"select doc_id, length({_REDACTED}) as n, md5({_REDACTED}) as h from documents")
def redact_documents(t):
    clean = tf.redact("text")
    return t.documents.select("doc_id", F.length(clean).cast("long").alias("n"), F.md5(clean).alias("h"))


@query("select doc_id, pos, length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')) + 1 as line, pos - coalesce(length(substr(text, 1, pos)) - nullif(position(chr(10) in reverse(substr(text, 1, pos))), 0) + 1, 0) + 1 as col from (select doc_id, text, length(text) // 2 as pos from documents where text is not null)")
def line_col_from_offset(t):
    at = F.floor(F.length("text") / 2)
    return t.documents.where("text is not null").select("doc_id", at.alias("pos"), tf.line_of("text", at).cast("long").alias("line"), tf.column_of("text", at).cast("long").alias("col"))


_CODE = """case p_partkey % 8
  when 0 then 'cur.execute(f"select ' || p_name || '")'
  when 1 then 'x = 1' || chr(10) || 'os.system(cmd)'
  when 2 then 'url = "jdbc:postgresql://h/' || p_partkey || '"'
  when 3 then 'subprocess.run(["ls"])'
  when 4 then 'subprocess.run(cmd, shell=True)'
  when 5 then 'CREATE USER u IDENTIFIED BY ''p' || p_partkey || ''';'
  when 6 then 'cur.execute("select ? where a = %s", (1,))'
  else 'os.system(a)  # weirflow:off SEC-003' end"""


def _code(t):
    return t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_partkey") % 8 == 5, "sql").otherwise("py").alias("ext"), F.expr(_CODE).alias("content"))


@query("select 'p' || p_partkey as path, 1 as line, (1 + length('cur.'))::int as col from part where p_partkey % 8 = 0")
def sql_interpolation(t):
    return security.scan(_code(t), ["SEC-002"]).select("path", "line", "col")


@query("select 'p' || p_partkey as path, case when p_partkey % 8 = 1 then 2 else 1 end as line, case when p_partkey % 8 = 7 then 'suppressed' else 'open' end as status from part where p_partkey % 8 in (1, 4, 7)")
def unsafe_subprocess(t):
    return security.scan(_code(t), ["SEC-003"]).select("path", "line", "status")


@query("select 'p' || p_partkey as path, 7 as start, (7 + length('jdbc:postgresql://h/' || p_partkey))::int as \"end\" from part where p_partkey % 8 = 2")
def conn_string(t):
    return security.scan(_code(t), ["SEC-004"]).select("path", "span.start", "span.end")


@query("select 'p' || p_partkey as path, 'CREATE USER u IDENTIFIED BY ''p' || p_partkey || ''';' as snippet from part where p_partkey % 8 = 5")
def plaintext_auth(t):
    return security.scan(_code(t), ["SEC-005"]).select("path", F.col("snippet_redacted").alias("snippet"))


@query("select rule_id, status, count(*) as n from (select case p_partkey % 8 when 0 then 'SEC-002' when 2 then 'SEC-004' when 5 then 'SEC-005' else 'SEC-003' end as rule_id, case when p_partkey % 8 = 7 then 'suppressed' else 'open' end as status from part where p_partkey % 8 not in (3, 6)) group by all")
def suppression_join(t):
    return security.scan(_code(t)).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


@query("select c_nationkey::bigint as path, count(*) as n from (select c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) as r, count(*) over (partition by c_nationkey) as k from customer) where r % 2 = 1 group by c_nationkey")
def finding_overlap_dedupe(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    spans = t.customer.select(F.col("c_nationkey").cast("long").alias("path"), F.lit("R").alias("rule_id"), (n * 10).alias("start"), (n * 10 + 15).alias("end"), F.lit("high").alias("severity"))
    return security.dedupe(spans).groupBy("path").agg(F.count("*").alias("n"))


@query("select 'p' || p_partkey as path, 'critical' as severity, 10 as col, 9 as start, (9 + 25 + length(p_partkey::varchar))::int as \"end\", 'token=<redacted>' as snippet_redacted from part")
def secret_prefix_wins(t):
    """A long value assigned to a key is found twice, by its entropy and by its prefix: the more severe span stays."""
    content = F.concat(F.lit('token = "sk-aB3dE5gH7jK9mN1pQ2sT4v'), F.col("p_partkey").cast("string"), F.lit('"'))
    found = security.scan(t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.lit("py").alias("ext"), content.alias("content")), ["SEC-001"])
    return found.select("path", "severity", "col", "span.start", "span.end", "snippet_redacted")


_SPANS = "(select l_orderkey as path, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey % 25) as n, l_linenumber * 10 as \"start\", l_linenumber * 10 + 4 + l_partkey % 25 as \"end\" from lineitem)"


@query(f"with recursive s as materialized {_SPANS}, r(path, n, \"start\", \"end\", reach, kept) as (select path, n, \"start\", \"end\", \"end\", true from s where n = 1 union all select s.path, s.n, s.\"start\", s.\"end\", case when s.\"start\" >= reach then s.\"end\" else reach end, s.\"start\" >= reach from r join s on s.path = r.path and s.n = r.n + 1) select path, \"start\", \"end\" from r where kept")
def candidate_self_overlap(t):
    """Spans that really overlap, in many files: the first of each run of overlaps stays."""
    at = F.col("l_linenumber") * 10
    spans = t.lineitem.select(F.col("l_orderkey").alias("path"), at.alias("start"), (at + 4 + F.col("l_partkey") % 25).alias("end"), F.lit("R").alias("rule_id"))
    return rewrite.disjoint(spans).select("path", "start", "end")


@query("select count(*) as n, count(*) filter (blocked) as blocked, count(*) filter (note) as noted from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, bool_or(l_partkey % 3 = 0 and o_orderkey is not null) as blocked, bool_or(o_orderkey is not null) as note from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem) left join orders on l_orderkey = o_orderkey and l_linenumber * 10 < o_custkey % 60 + 5 and o_custkey % 60 < l_linenumber * 10 + 8 group by 1, 2, 3, 4)".replace("l_partkey % 3 = 0", "o_custkey % 2 = 0"))
def candidate_overlap_join(t):
    found = t.lineitem.select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 8).alias("end"), "l_partkey", "l_suppkey").distinct()
    at = (F.col("o_custkey") % 60).cast("int")
    findings = t.orders.select(F.col("o_orderkey").alias("path"), F.struct(at.alias("start"), (at + 5).alias("end")).alias("span"), F.lit("SEC-001").alias("rule_id"), F.when(F.col("o_custkey") % 2 == 0, "high").otherwise("low").alias("severity"), F.lit("open").alias("status"))
    return rewrite.overlay(found, findings).agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked"), F.count_if(F.col("security_note").isNotNull()).alias("noted"))


_MODEL = "'select ID, name, id from T_' || c_nationkey || ' x'"


def _stages(t):
    return t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("name"), F.expr(_MODEL).alias("raw"), F.array(F.lit("id")).alias("columns"))


@query("select 'c' || c_custkey as path, 15 as start, 19 as \"end\", ', id' as before from customer")
def dup_projection_rows(t):
    return rewrite.candidates(_stages(t), ["REF-002"]).select("path", "start", "end", "before")


@query("select rule_id, count(*) as n from (select unnest(['REF-002', 'REF-004', 'REF-006']) as rule_id from customer) group by rule_id")
def rewrite_candidates_by_rule(t):
    return rewrite.candidates(_stages(t), most_tier="safe").groupBy("rule_id").agg(F.count("*").alias("n"))


@query("select 'c' || c_custkey as path, 'select id, name, id from t_' || c_nationkey || ' x' as rewritten, 'applied' as status from customer")
def apply_edits(t):
    stages = _stages(t)
    return rewrite.apply(stages, rewrite.disjoint(rewrite.candidates(stages, ["REF-004"]))).select("path", "rewritten", "status")


def _edits(t, rule, raw, columns="array('id')"):
    stages = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("name"), F.expr(raw).alias("raw"), F.expr(columns).alias("columns"))
    return rewrite.candidates(stages, [rule]).select("path", "start", "end", "before", "after")


_DEAD = "case c_custkey % 4 when 0 then 'WITH dead_' || c_nationkey || ' AS (select 1), keep AS (select 2) select 3 from keep' when 1 then 'WITH base AS (select 1) select {{ star(base) }} from t' when 2 then 'WITH base AS (select 1) select 2 from \"Base\"' else 'WITH gone AS (delete from t) select 1' end"


@query("select 'c' || c_custkey as path, 5 as start, (5 + length(dead))::int as \"end\", dead as before, '' as after from (select c_custkey, 'dead_' || c_nationkey || ' AS (select 1), ' as dead from customer where c_custkey % 4 = 0)")
def dead_cte_edits(t):
    """REF-001 takes only what nothing reads: neither a template nor a quoted name, and without side effects."""
    return _edits(t, "REF-001", _DEAD)


@query("select 'c' || c_custkey as path, (length(head) + 15)::int as start, (length(head) + 17)::int as \"end\", 't1' as before, body as after from (select c_custkey, '(select a from raw_' || c_nationkey || ')' as body, 'WITH t1 AS (select a from raw_' || c_nationkey || ')' as head from customer where c_custkey % 2 = 0)")
def single_use_cte_edits(t):
    """REF-003 puts a CTE that is read once in its place."""
    return _edits(t, "REF-003", "case c_custkey % 2 when 0 then 'WITH t1 AS (select a from raw_' || c_nationkey || ') select a from t1' else 'WITH t1 AS (select a from t limit 3) select a from t1' end")


@query("select 'c' || c_custkey as path, 7 as start, 9 as \"end\", '* ' as before, 'c' || c_nationkey || ', id' as after from customer where c_custkey % 3 <> 0")
def star_edits(t):
    """REF-005 lists the columns of the stage read; an unknown stage keeps its star."""
    return _edits(t, "REF-005", "case when c_custkey % 3 = 0 then 'select * from ghost' else 'select * from m' || c_custkey end", "array('id', concat('c', c_nationkey))")


@query("select 'c' || c_custkey as path, (22 + length(c_nationkey::varchar))::int as start, (27 + length(c_nationkey::varchar))::int as \"end\", ' AS o' as before, '' as after from customer where c_custkey % 2 = 1")
def dead_alias_edits(t):
    """REF-006 drops an alias that nothing uses."""
    return _edits(t, "REF-006", "case c_custkey % 2 when 1 then 'select id from orders_' || c_nationkey || ' AS o' else 'select o.id from orders o' end")


@query("select 'c' || c_custkey as path, (30 + length(c_nationkey::varchar))::int as start, (41 + length(c_nationkey::varchar))::int as \"end\", ' order by b' as before, '' as after from customer where c_custkey % 5 < 3")
def subquery_sort_edits(t):
    """REF-007 drops the sorting of a subquery, but not with a limit."""
    return _edits(t, "REF-007", "case when c_custkey % 5 < 3 then 'select a from (select b from t' || c_nationkey || ' order by b) x' else 'select a from (select b from t order by b limit 5) x' end")
