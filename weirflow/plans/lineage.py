"""Lineage queries over foreign keys as edges, and over generated references."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators import lineage
from weirflow.plans.registry import query

_FK = """(select 'region:' || n_regionkey as producer, 'nation:' || n_nationkey as consumer, 'ref' as kind from nation
  union all select 'nation:' || c_nationkey, 'customer:' || c_custkey, 'ref' from customer
  union all select 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'source' from supplier
  union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'ref' from orders
  union all select 'order:' || l_orderkey, 'line:' || l_orderkey || '.' || l_linenumber, 'ref' from lineitem
  union all select 'supplier:' || l_suppkey, 'line:' || l_orderkey || '.' || l_linenumber, 'source' from lineitem)"""


def _edges(t):
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edge = lambda df, a, b, kind="ref": df.select(name(*a).alias("producer"), name(*b).alias("consumer"), F.lit(kind).alias("kind"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey", F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("line"))
    return (
        edge(t.nation, ("region:", "n_regionkey"), ("nation:", "n_nationkey"))
        .union(edge(t.customer, ("nation:", "c_nationkey"), ("customer:", "c_custkey")))
        .union(edge(t.supplier, ("nation:", "s_nationkey"), ("supplier:", "s_suppkey"), "source"))
        .union(edge(t.orders, ("customer:", "o_custkey"), ("order:", "o_orderkey")))
        .union(edge(lines, ("order:", "l_orderkey"), ("line:", "line")))
        .union(edge(lines, ("supplier:", "l_suppkey"), ("line:", "line"), "source"))
    )


@query(f"select consumer, count(distinct producer) as n from {_FK} group by consumer")
def fan_in(t):
    return lineage.neighbours(_edges(t)).select(F.col("node").alias("consumer"), F.size("producers").cast("long").alias("n")).where("n > 0")


@query(f"select producer, count(distinct consumer) as n from {_FK} group by producer")
def fan_out(t):
    return lineage.neighbours(_edges(t)).select(F.col("node").alias("producer"), F.size("consumers").cast("long").alias("n")).where("n > 0")


@query(f"with recursive e as materialized {_FK}, w(node, depth) as (select 'region:1', 0 union all select consumer, depth + 1 from w join e on producer = node where depth < 31) select node, min(depth)::int as depth from w group by node")
def downstream_closure(t):
    return lineage.downstream(_edges(t), t.spark.range(1).select(F.lit("region:1").alias("node")))


@query(f"with recursive e as materialized {_FK}, w(node, depth) as (select 'region:1', 0 union all select consumer, depth + 1 from w join e on producer = node where depth < 31), r as (select node, min(depth) as depth from w group by node) select distinct r.depth + 1 as depth, producer, consumer, coalesce(consumer like 'order:%7' and producer like 'customer:%', false) as breaking from r join e on producer = node")
def breaks_downstream(t):
    """What breaks if region 1 changes; edges into orders whose key ends in 7 have a breaking drift, some others a harmless one."""
    edges = _edges(t)
    drifts = edges.where("producer like 'customer:%' and consumer like 'order:%'").select("producer", "consumer", F.col("consumer").endswith("7").alias("breaking"))
    return lineage.affected(edges, t.spark.range(1).select(F.lit("region:1").alias("node")), drifts.where("breaking or consumer like '%3'"))


@query(f"with recursive e as materialized {_FK}, w(node, route, depth) as (select 'region:1', 'region:1', 0 union all select consumer, route || ' -> ' || consumer, depth + 1 from w join e on producer = node where depth < 31) select min(route) as route, depth::int as depth from w where node = (select 'order:' || min(o_orderkey) from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey = 1) group by depth order by depth limit 1")
def shortest_route(t):
    start = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).where("n_regionkey = 1").agg(F.min("o_orderkey")).first()[0]
    return lineage.shortest_route(_edges(t), "region:1", f"order:{start}")


def _refs(t):
    """Each order refers to two stages, some of them missing, some to itself."""
    base = t.orders.select(F.concat(F.lit("m"), (F.col("o_orderkey") % 500).cast("string")).alias("consumer"), F.concat(F.lit("m"), (F.col("o_custkey") % 700).cast("string")).alias("name"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderkey") % 2 == 0, "ref").otherwise("bare").alias("kind"))
    return base, base.select(F.col("consumer").alias("name")).distinct()


_REFS = "(select 'm' || (o_orderkey % 500) as consumer, 'm' || (o_custkey % 700) as name, o_orderkey as ordinal, case when o_orderkey % 2 = 0 then 'ref' else 'bare' end as kind from orders)"


@query(f"with r as {_REFS} select name as producer, consumer, arg_min(kind, ordinal) as kind from r where name <> consumer and name in (select consumer from r) group by name, consumer")
def resolve_refs_inner(t):
    return lineage.resolve(*_refs(t))[0]


@query(f"with r as {_REFS} select consumer, name as ref from r where name <> consumer and name not in (select consumer from r)")
def missing_refs_anti(t):
    return lineage.resolve(*_refs(t))[1]


@query("select 'raw.' || n_name as producer, 'c' || c_custkey as consumer, 'source' as kind from customer join nation on c_nationkey = n_nationkey where n_regionkey <> 2")
def resolve_sources_semi(t):
    named = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # nation has 25 rows at any scale
    wanted = named.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("consumer"), F.lit("raw").alias("source"), F.col("n_name").alias("table"))
    catalog = t.nation.where("n_regionkey <> 2").select(F.concat(F.lit("raw."), "n_name").alias("name"))
    return lineage.resolve_sources(wanted, catalog)[0]


def _runs(t):
    """A graph for each customer, who has orders, which have lines: (run_id, producer, consumer) and (run_id, node)."""
    name = lambda kind, c: F.concat(F.lit(kind), F.lpad(F.col(c).cast("string"), 12, "0"))
    run = F.col("o_custkey").cast("long").alias("run_id")
    first = t.orders.select(run, name("a", "o_custkey").alias("producer"), name("b", "o_orderkey").alias("consumer"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(name("c", "l_orderkey"), F.lit("."), F.col("l_linenumber").cast("string")).alias("consumer"))
    second = t.orders.select("o_custkey", "o_orderkey").join(lines, "o_orderkey").select(run, name("b", "o_orderkey").alias("producer"), "consumer")
    edges = first.union(second)
    return edges, edges.select("run_id", F.col("producer").alias("node")).union(edges.select("run_id", "consumer")).distinct()


_PAD = "lpad({}::varchar, 12, '0')"
_RUN_EDGES = f"""(select o_custkey::bigint as run_id, 'a' || {_PAD.format('o_custkey')} as producer, 'b' || {_PAD.format('o_orderkey')} as consumer from orders
  union all select o_custkey::bigint, 'b' || {_PAD.format('o_orderkey')}, 'c' || {_PAD.format('o_orderkey')} || '.' || l_linenumber from orders join lineitem on o_orderkey = l_orderkey)"""


@query(f"with e as {_RUN_EDGES}, n as (select run_id, producer as node from e union select run_id, consumer from e) select run_id, (row_number() over (partition by run_id order by node) - 1)::int as place, node from n")
def topo_order(t):
    """The graph is a forest whose names sort by level and then by producer, so its first-in first-out order is that of the names."""
    edges, nodes = _runs(t)
    return lineage.order(edges, nodes)


@query(f"with e as {_RUN_EDGES} select run_id, 0 as place, producer || '>' || min(consumer) || '>' || producer as walk from e where producer like 'a%' group by run_id, producer")
def cycles(t):
    """Each customer's graph with one edge more, from the first order back to the customer."""
    edges, nodes = _runs(t)
    back = edges.where("producer like 'a%'").groupBy("run_id", F.col("producer").alias("top")).agg(F.min("consumer").alias("leaf")).select("run_id", F.col("leaf").alias("producer"), F.col("top").alias("consumer"))
    walks = lineage.cycles(edges.union(back), nodes.withColumn("ordinal", F.col("node")))
    return walks.withColumn("walk", F.array_join("walk", ">"))


@query(f"with r as {_REFS} select consumer, name as producer, arg_min(kind, ordinal) as kind from r group by consumer, name")
def edge_dedupe_first_kind(t):
    return lineage.one_per_pair(_refs(t)[0].withColumnRenamed("name", "producer"))
