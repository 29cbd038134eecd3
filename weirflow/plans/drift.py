"""Schema drift queries on the fixed column names of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators import drift
from weirflow.plans.registry import query

# Producers and consumers with their columns; the rename scores were worked out with the same kernel by hand.
_SCHEMAS = """values
  ('orders', array('o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderdate')),
  ('fct_orders', array('o_orderkey', 'o_cust_key', 'o_totalprice')),
  ('customer', array('c_custkey', 'c_name', 'c_acctbal')),
  ('dim_customer', array('c_custkey', 'c_name', 'email')),
  ('nation', array('n_nationkey', 'n_name')),
  ('dim_nation', array('n_nationkey', 'n_name')) as t(name, columns)"""
_EDGES = "values ('orders', 'fct_orders'), ('customer', 'dim_customer'), ('nation', 'dim_nation') as t(producer, consumer)"


def _found(t):
    return drift.detect(t.spark.sql(f"select * from {_EDGES}"), t.spark.sql(f"select * from {_SCHEMAS}"))


@query("select * from (values ('orders', 'fct_orders', 'o_custkey,o_orderdate', '', 'o_cust_key>o_custkey', true), ('customer', 'dim_customer', 'c_acctbal', 'email', '', true)) as t(producer, consumer, added, removed, renamed, breaking)")
def rename_best_match(t):
    return _found(t).select("producer", "consumer", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), F.array_join(F.transform("renamed", lambda r: F.concat(r["old"], F.lit(">"), r["new"])), ",").alias("renamed"), "breaking")


@query("select consumer, string_agg(line, chr(10) order by n) || chr(10) as diff from (values ('fct_orders', 0, '--- a/orders (schema)'), ('fct_orders', 1, '+++ b/fct_orders (expected)'), ('fct_orders', 2, '@@ -1,1 +1,3 @@'), ('fct_orders', 3, '-o_cust_key'), ('fct_orders', 4, '+o_custkey'), ('fct_orders', 5, '+o_custkey'), ('fct_orders', 6, '+o_orderdate'), ('dim_customer', 0, '--- a/customer (schema)'), ('dim_customer', 1, '+++ b/dim_customer (expected)'), ('dim_customer', 2, '@@ -1,1 +1,1 @@'), ('dim_customer', 3, '-email'), ('dim_customer', 4, '+c_acctbal')) as t(consumer, n, line) group by consumer")
def drift_unified_diff(t):
    return drift.unified_diff(_found(t)).select("consumer", "diff")


@query("select 'p' || (o_orderkey % 100) as producer, 'c' || o_orderkey as consumer, list_transform(range(0, (o_orderkey % 100 % 4 + 1)::bigint), lambda i: 'col' || i)[(o_orderkey % 3 + 1)::bigint + 1:] as added, list_transform(range((o_orderkey % 100 % 4 + 1)::bigint, (o_orderkey % 3 + 1)::bigint), lambda i: 'col' || i) as removed, 0 as n_renamed, o_orderkey % 3 > o_orderkey % 100 % 4 as breaking from orders where o_orderkey % 3 <> o_orderkey % 100 % 4")
def schema_set_diff(t):
    names = lambda n: F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.concat(F.lit("col"), i.cast("string")))
    k = F.col("o_orderkey")
    edges = t.orders.select(F.concat(F.lit("p"), (k % 100).cast("string")).alias("producer"), F.concat(F.lit("c"), k.cast("string")).alias("consumer"))
    producers = t.orders.select((k % 100).alias("p")).distinct().select(F.concat(F.lit("p"), F.col("p").cast("string")).alias("name"), names(F.col("p") % 4).alias("columns"))
    consumers = t.orders.select(F.concat(F.lit("c"), k.cast("string")).alias("name"), names(k % 3).alias("columns"))
    return drift.detect(edges, producers.union(consumers)).select("producer", "consumer", "added", "removed", F.size("renamed").alias("n_renamed"), "breaking")


@query("select 'p' || o_orderkey as producer, 'c' || o_orderkey as consumer, 'amount_' || (o_orderkey % 7) as added, case when o_orderkey % 2 = 0 then '' else 'zz' end as removed, 'amount>amount_' || (o_orderkey % 7) as renamed from orders")
def renames_of_edges(t):
    """Each order is an edge whose producer renamed a column, and half of them lost one as well."""
    k = F.col("o_orderkey").cast("string")
    name = lambda kind: F.concat(F.lit(kind), k)
    edges = t.orders.select(name("p").alias("producer"), name("c").alias("consumer"))
    producers = t.orders.select(name("p").alias("name"), F.array(F.lit("id"), F.concat(F.lit("amount_"), (F.col("o_orderkey") % 7).cast("string"))).alias("columns"))
    consumers = t.orders.select(name("c").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("id"), F.lit("amount"))).otherwise(F.array(F.lit("id"), F.lit("amount"), F.lit("zz"))).alias("columns"))
    found = drift.detect(edges, producers.union(consumers))
    return found.select("producer", "consumer", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), F.array_join(F.transform("renamed", lambda r: F.concat(r["old"], F.lit(">"), r["new"])), ",").alias("renamed"))


@query("select * from (values ('s', 2, 1, 'b', 'retyped', true), ('s', 2, 1, 'c', 'added', false), ('s', 3, 2, 'a', 'removed', true), ('s', 3, 2, 'c', 'nullable', true)) as t(stage, version, parent, \"column\", change, breaking)")
def snapshot_changes(t):
    rows = t.spark.sql("select * from values ('s', 1, 'a', 'int', false), ('s', 1, 'b', 'int', false), ('s', 2, 'a', 'int', false), ('s', 2, 'b', 'long', false), ('s', 2, 'c', 'int', false), ('s', 3, 'b', 'long', false), ('s', 3, 'c', 'int', true) as t(stage, version, column, data_type, nullable)")
    return drift.snapshot_changes(rows)
