"""Run history, audit and metrics queries; `events` stands for the run log (user_id = pipeline, value = milliseconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators import drift, flow, history, rewrite, security, sessions
from weirflow.plans.registry import Tables, query

_SEVERITY = "case event_type when 'error' then 'critical' when 'purchase' then 'high' when 'signup' then 'medium' else 'low' end"
_STATUS = "case when event_type = 'view' then 'suppressed' else 'open' end"


def _findings(t: Tables) -> DataFrame:
    return t.events.select(F.to_date("ts").alias("run"), F.expr(_SEVERITY).alias("severity"), F.expr(_STATUS).alias("status"), F.concat(F.lit("SEC-00"), (F.col("user_id") % 5 + 1).cast("string")).alias("rule_id"), F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string")).alias("path"), (F.col("user_id") % 9).cast("long").alias("line"), F.lit(1).alias("col"))


_FINDINGS = f"(select cast(ts as date) as run, {_SEVERITY} as severity, {_STATUS} as status, 'SEC-00' || (user_id % 5 + 1) as rule_id, 'f' || (event_id % 40) as path, user_id % 9 as line, 1 as col from events)"


@query(f"select count(*) filter (status = 'open' and severity = 'critical') as critical, count(*) filter (status = 'open' and severity = 'high') as high, count(*) filter (status = 'open' and severity = 'medium') as medium, count(*) filter (status = 'open' and severity = 'low') as low, count(*) filter (status <> 'open') as suppressed from {_FINDINGS}")
def severity_histogram(t):
    return security.histogram(_findings(t))


@query(f"select bool_or(status = 'open' and severity in ('critical', 'high')) as failed from {_FINDINGS}")
def gate_boolean(t):
    return security.gate(_findings(t), "high")


@query(f"select severity, count(*) as n from {_FINDINGS} where severity in ('critical', 'high', 'medium') group by severity")
def severity_report_filter(t):
    return security.at_least(_findings(t), "medium").groupBy("severity").agg(F.count("*").alias("n"))


@query(f"with f as {_FINDINGS} select severity, rule_id, count(*) as n from f where run = (select max(run) from f) and status = 'open' group by severity, rule_id")
def top_open_findings(t):
    return security.open_by_rule(_findings(t))


@query(f"with f as {_FINDINGS} select distinct rule_id, path, line from f a where run >= date '2024-01-01' + 0 and run = (select max(run) from f) and status = 'open' and not exists (select 1 from f b where b.run < (select max(run) from f) and b.status = 'open' and a.rule_id = b.rule_id and a.path = b.path and a.line = b.line and a.col = b.col)".replace("run >= date '2024-01-01' + 0 and ", ""))
def new_vs_baseline_anti(t):
    f = _findings(t)
    latest = f.agg(F.max("run")).first()[0]
    return security.new_since(f.where(F.col("run") == F.lit(latest)), f.where(F.col("run") < F.lit(latest))).select("rule_id", "path", "line").distinct()


@query("select event_id, user_id, event_type from events order by event_id desc limit 10")
def recent_runs_topk(t):
    return history.recent(t.events.select("event_id", "user_id", "event_type"), "event_id")


@query("select event_id, event_type from events where user_id = 7 order by event_id desc limit 100")
def audit_filter_topk(t):
    return history.log_of(t.events, "event_id", "user_id", 7).select("event_id", "event_type")


@query("select event_id, event_type from events where ts >= timestamp '2024-01-10 00:00:00' order by event_id desc limit 100")
def audit_since(t):
    return history.log_of(t.events, "event_id", since=F.to_timestamp(F.lit("2024-01-10 00:00:00"))).select("event_id", "event_type")


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as ts from events where event_type = 'purchase' group by user_id")
def latest_success_per_pipeline(t):
    return history.latest(t.events.where("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts")


@query("select o_orderkey, sum(case when l_linestatus = 'F' then 1 else 0 end)::bigint as done, sum(case when l_linestatus = 'O' then 1 else 0 end)::bigint as open from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey having done > 0 and open > 0")
def resumable_runs_having(t):
    return history.partly_done(t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus"), "o_orderkey"), "o_orderkey", F.col("l_linestatus") == "F", F.col("l_linestatus") == "O")


@query("select o_orderkey, o_orderdate from orders where o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' and o_orderkey % 4 < 3 and o_orderdate <= timestamp '1996-01-01 00:00:00'")
def due_retries(t):
    return history.due(t.orders.withColumns({"state": F.col("o_orderstatus"), "retryable": F.col("o_orderpriority") != "1-URGENT", "attempt": F.col("o_orderkey") % 4, "most": F.lit(3), "after": F.col("o_orderdate")}), F.to_timestamp(F.lit("1996-01-01 00:00:00")), failed="F").select("o_orderkey", "o_orderdate")


@query("select o_orderkey, string_agg(l_partkey || ':' || l_linenumber, ',' order by l_partkey, l_linenumber) as found from (select * from orders order by o_orderkey desc limit 200) left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def edge_drift_history(t):
    """The newest 200 orders as runs, with their lines as what was found."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    listed = history.found_of(t.orders.select("o_orderkey"), lines, "o_orderkey", "o_orderkey", 200)
    return listed.select("o_orderkey", F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["l_partkey"].cast("string"), x["l_linenumber"].cast("string"))), ",").alias("found"))


@query("select l_partkey, count(distinct l_suppkey) as variants from lineitem group by l_partkey having count(distinct l_suppkey) > 1")
def determinism_violations(t):
    return history.violations(t.lineitem, "l_partkey", "l_suppkey").withColumnRenamed("n", "variants")


@query("select event_type, max(value) as p95, max(cnt) as n from (select event_type, value, row_number() over (partition by event_type order by value) as rn, count(*) over (partition by event_type) as cnt from events) where rn <= greatest(1, floor(0.95 * cnt)) group by event_type")
def p95_latency(t):
    return history.nearest_rank(t.events, "event_type", "value", 0.95)


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(count(*) filter (value > 50) / count(*), 6) as over_rate from events group by event_type")
def metric_rates(t):
    found = history.rates(t.events, "event_type", "value", F.col("value") > 50)
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "over_rate")))


@query("select event_id, user_id, ts from events where event_type = 'error'")
def dead_letters(t):
    return history.dead(t.events, F.col("event_type") == "error", "ts", "event_id").select("event_id", "user_id", "ts")


@query("select distinct l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' and l_returnflag = 'R'")
def plan_item_guard(t):
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return flow.already_applied(t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber"), done, ["l_orderkey"])


@query("select o_orderkey, 'c' || (row_number() over (order by o_orderdate, o_orderkey) - 1) as change_id from orders")
def change_numbering(t):
    return history.numbered(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "change_id")


_STATE = "case event_type when 'signup' then 'start' when 'view' then 'parsed' when 'click' then 'analyzed' when 'purchase' then 'planned' else 'aborted' end"
_MOVES = "(values ('start', 'parsed'), ('start', 'aborted'), ('parsed', 'analyzed'), ('parsed', 'aborted'), ('analyzed', 'planned'), ('analyzed', 'aborted'), ('planned', 'aborted'), ('aborted', 'start')) as allowed(a, b)"


@query(f"select event_id, before, state, (before = state or exists (select 1 from {_MOVES} where a = before and b = state)) as valid from (select *, lag(state) over (partition by user_id order by ts, event_id) as before from (select *, {_STATE} as state from events)) where before is not null")
def fsm_transition_check(t):
    """Events as the audit log of sessions, against the moves of the session state machine."""
    log = t.events.withColumn("state", F.expr(_STATE))
    return history.check_transitions(log, "user_id", ["ts", "event_id"], "state", sessions.moves(t.spark)).select("event_id", "before", "state", "valid")


@query("select stage, day, version, parent_version, changed from (select *, lag(h) over w is distinct from h as changed, lag(version) over w as parent_version from (select user_id as stage, cast(cast(ts as date) as varchar) as day, count(*) % 7 as h, row_number() over (partition by user_id order by cast(cast(ts as date) as varchar)) as version from events group by 1, 2) window w as (partition by stage order by day))")
def snapshot_version_chain(t):
    days = t.events.groupBy(F.col("user_id").alias("stage"), F.to_date("ts").cast("string").alias("day")).agg((F.count("*") % 7).alias("h"))
    return drift.version_chain(days, "stage", "day", "h")


@query("select event_id, user_id, event_type from events")
def event_dedupe(t):
    return history.once(t.events.unionByName(t.events), "event_id").select("event_id", "user_id", "event_type")


_ITEM = """'{"after":"","before":", id","end":19,"path":"c' || c_custkey || '","reason":"column is selected twice","rule_id":"REF-002","stage":"m' || c_custkey || '","start":15,"tier":"safe"}'"""


@query(f"select 'c' || c_custkey as path, 'c' || (row_number() over (order by 'c' || c_custkey) - 1) as change_id, 'sha256:' || sha256({_ITEM}) as item_hash from customer")
def item_hash(t):
    """A plan of one edit a file: its numbers and hashes."""
    from weirflow.plans.security import _stages

    return rewrite.plan(rewrite.candidates(_stages(t), ["REF-002"])).select("path", "change_id", "item_hash")


@query("select state, count(*) as n from (select case o_orderstatus when 'F' then 'applied' when 'O' then 'pending' else 'skipped' end as state from orders) group by state")
def plan_item_states(t):
    return flow.states(t.orders.select(F.expr("case o_orderstatus when 'F' then 'applied' when 'O' then 'pending' else 'skipped' end").alias("state")))


@query("select doc_id from documents where doc_id % 3 = 0 or text is null")
def incremental_changed_files(t):
    now = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return history.changed(now, t.documents, "doc_id", "text").select("doc_id")


@query("select (select count(*) from orders) as runs, (select avg((o_orderstatus = 'F')::int) from orders) as clean_share, (select avg((o_orderkey % 3)::double) from orders) as mean_drifts, (select avg((l_returnflag = 'R')::int) from lineitem) as breaking_share, (select count(*) from events where event_type <> 'view') as open_findings, (select avg((event_type = 'view')::int) from events) as suppressed_share")
def kpi_set(t):
    runs = t.orders.select(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("breaking"), (F.col("o_orderkey") % 3).alias("drifts"))
    return history.kpis(runs, _findings(t), t.lineitem.select((F.col("l_returnflag") == "R").alias("breaking")))


_EVENT = "case event_type when 'signup' then 'start' when 'view' then 'complete' when 'click' then 'fail_retryable' when 'purchase' then 'retry_ok' else 'interrupt' end"
_AFTER = "case event_type when 'signup' then 'RUNNING' when 'view' then 'SUCCEEDED' when 'click' then 'FAILED' when 'purchase' then 'RUNNING' else 'INTERRUPTED' end"


@query(f"select user_id, ts, event_id, event, before, after, ((before = 'PENDING' and event = 'start') or (before = 'RUNNING' and event in ('complete', 'fail_retryable', 'interrupt')) or (before in ('FAILED', 'INTERRUPTED') and event = 'retry_ok')) as valid from (select user_id, ts, event_id, event, after, coalesce(lag(after) over (partition by user_id order by ts, event_id), 'PENDING') as before from (select *, {_EVENT} as event, {_AFTER} as after from events))")
def stage_event_check(t):
    """Events as the log of stages: is each the move that the stage's state machine makes?"""
    log = t.events.select("user_id", "ts", "event_id", F.expr(_EVENT).alias("event"), F.expr(_AFTER).alias("after"))
    return history.check_events(log, history.STAGE_MOVES, "PENDING", "user_id", ["ts", "event_id"])
