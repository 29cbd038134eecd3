"""Queries on run history: latest rows, due retries, nearest-rank percentiles, transitions, incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow import session


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key; a partial aggregate, no sort."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*by)).alias("_r")).select("_r.*")


def partly_done(rows: DataFrame, key: str, done: Column, open_: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count_if(done).alias("done"), F.count_if(open_).alias("open")).where("done > 0 and open > 0")


def due(rows: DataFrame, now: Column, failed: str = "FAILED") -> DataFrame:
    """Rows (state, retryable, attempt, most, after) that may be tried again, the longest due first."""
    return rows.where((F.col("state") == failed) & F.col("retryable") & (F.col("attempt") < F.col("most")) & (F.col("after") <= now)).orderBy("after")


def violations(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def nearest_rank(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, p95, n): the value at rank max(1, floor(share * n)) of each key, found from value counts, so no key is sorted whole."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_c"))
    total = counts.groupBy(key).agg(F.sum("_c").alias("n"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy(value))
    ranked = counts.withColumn("_upto", upto).join(total, key)
    wanted = F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n")))
    return ranked.where(F.col("_upto") >= wanted).groupBy(key).agg(F.min(value).alias("p95"), F.max("n").alias("n"))


def recent(rows: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The newest `n` rows: a top-k, whose limit is its feature."""
    return rows.orderBy(F.col(by).desc()).limit(n)


def log_of(rows: DataFrame, by: str, key: str | None = None, value: object = None, n: int = 100, since: Column | None = None, at: str = "ts") -> DataFrame:
    """The newest `n` rows of a log, of one `key` value and from `since` on if these are given."""
    if key is not None:
        rows = rows.where(F.col(key) == F.lit(value))
    if since is not None:
        rows = rows.where(F.col(at) >= since)
    return recent(rows, by, n)


def found_of(runs: DataFrame, found: DataFrame, key: str = "run_id", by: str = "run_id", n: int | None = None) -> DataFrame:
    """`runs`, newest first, with the sorted list of what each found (empty where nothing), the newest `n` if given."""
    newest = runs if n is None else recent(runs, by, n)
    listed = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*(c for c in found.columns if c != key)))).alias("found"))
    return newest.join(listed, key, "left").orderBy(F.col(by).desc())


def dead(rows: DataFrame, gone: Column, *by: str) -> DataFrame:
    """What was given up on, the oldest first."""
    return rows.where(gone).orderBy(*by)


def rates(rows: DataFrame, key: str, value: str, over: Column) -> DataFrame:
    """(key, p50, p95, over_rate): interpolated percentiles of `value`, exact, and the share of rows that are `over`."""
    share = lambda p: F.percentile(value, F.lit(p))
    return rows.groupBy(key).agg(share(0.5).alias("p50"), share(0.95).alias("p95"), (F.count_if(over) / F.count("*")).alias("over_rate"))


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """`rows` with change ids c0, c1, ... in one global order: ranges are numbered apart, then moved by the counts of the ranges before."""
    session.checkpoints(rows.sparkSession)
    # Written once: the ranges must be the same when they are counted and when they are numbered.
    ranged = rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row a range: the only rows that meet in one task.
    offsets = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1 + F.col("_before")
    return ranged.join(F.broadcast(offsets), "_range").withColumn("change_id", F.concat(F.lit("c"), place.cast("string"))).select(*rows.columns, "change_id")


def check_transitions(log: DataFrame, key: str, by: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Each row but the first of a key with the state before it and whether the move, or staying, is allowed."""
    moves = log.withColumn("before", F.lag(state).over(Window.partitionBy(key).orderBy(*by))).where("before is not null")
    ok = allowed.select(F.col("a").alias("before"), F.col("b").alias(state), F.lit(True).alias("_ok")).distinct()
    return moves.join(ok, ["before", state], "left").withColumn("valid", F.coalesce("_ok", F.lit(False)) | (F.col("before") == F.col(state))).drop("_ok")


# The moves of a run and of a stage, as state and event to the next state.
RUN_MOVES = {
    ("CREATED", "snapshot_ok"): "READY",
    ("CREATED", "snapshot_failed"): "FAILED",
    ("READY", "dispatch"): "RUNNING",
    ("RUNNING", "stage_fatal"): "FAILED",
    ("RUNNING", "all_succeeded"): "SUCCEEDED",
    ("RUNNING", "interrupt"): "SUSPENDED",
    ("RUNNING", "budget_exhausted"): "ABORTED",
    ("RUNNING", "abort"): "ABORTED",
    ("SUSPENDED", "resume"): "RUNNING",
    ("SUSPENDED", "abort"): "ABORTED",
}
STAGE_MOVES = {
    ("PENDING", "start"): "RUNNING",
    ("PENDING", "skip"): "SKIPPED",
    ("PENDING", "block"): "BLOCKED",
    ("RUNNING", "complete"): "SUCCEEDED",
    ("RUNNING", "fail_retryable"): "FAILED",
    ("RUNNING", "fail_fatal"): "FAILED",
    ("RUNNING", "interrupt"): "INTERRUPTED",
    ("FAILED", "retry_ok"): "RUNNING",
    ("INTERRUPTED", "retry_ok"): "RUNNING",
}


def check_events(log: DataFrame, moves: dict[tuple[str, str], str], first: str, key: str, by: list[str]) -> DataFrame:
    """(key, by..., event, before, after, valid) of a log of events with the state after each: is it the move from the state before?

    The state before the first event of a key is `first`. The moves are a small table of constants.
    """
    table = log.sparkSession.createDataFrame([(a, e, b) for (a, e), b in moves.items()], "before string, event string, _to string")
    seen = log.withColumn("before", F.coalesce(F.lag("after").over(Window.partitionBy(key).orderBy(*by)), F.lit(first)))
    joined = seen.join(F.broadcast(table), ["before", "event"], "left")
    return joined.select(key, *by, "event", "before", "after", F.coalesce(F.col("_to") == F.col("after"), F.lit(False)).alias("valid"))


def once(rows: DataFrame, key: str) -> DataFrame:
    return rows.dropDuplicates([key])


def changed(now: DataFrame, cached: DataFrame, key: str, content: str) -> DataFrame:
    """Rows whose content hash is not the cached one; texts are hashed before the shuffle."""
    hashed = lambda df: df.select(key, F.sha2(content, 256).alias("_h"))
    return hashed(now).join(hashed(cached), [key, "_h"], "left_anti").select(key)


def snapshot_fingerprint(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row (fingerprint) over the sorted (path, SHA-256) pairs of an input; only hashes meet in one place."""
    hashed = files.select(F.struct(F.col(path).alias("p"), F.sha2(F.col(content).cast("binary"), 256).alias("h")).alias("x"))
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws(" ", x["p"], x["h"]))
    return hashed.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(lines, "\n"), 256)).alias("fingerprint"))


def sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The same `n` rows for a seed however the rows are dealt: a sampling operator, so the limit is its feature."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def compare_and_set(now: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, status) of edits (path, old_hash, new_hash) against files (path, hash): applied, noop, conflict or missing."""
    joined = wanted.join(now, "path", "left")
    status = F.when(F.col("hash").isNull(), "missing").when(F.col("hash") == F.col("new_hash"), "noop").when(F.col("hash") == F.col("old_hash"), "applied").otherwise("conflict")
    return joined.select("path", status.alias("status"))


def retry_schedule(failures: DataFrame, base_seconds: float = 1.0, most_seconds: float = 60.0, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(to retry with `retry_after`, dead letters) of failures (attempt, failed_at): the wait doubles up to a bound."""
    wait = F.least(F.lit(most_seconds), F.lit(base_seconds) * F.pow(F.lit(2.0), F.col("attempt")))
    again = failures.where(F.col("attempt") < attempts).withColumn("retry_after", F.timestamp_seconds(F.unix_micros("failed_at") / 1e6 + wait))
    return again, failures.where(F.col("attempt") >= attempts)


def kpis(runs: DataFrame, findings: DataFrame, drifts: DataFrame) -> DataFrame:
    """One row of figures over the history: runs, clean_share, mean_drifts, breaking_share, open_findings, suppressed_share.

    Shares of nothing are null. Each input is reduced to one row before they meet.
    """
    a = runs.agg(F.count("*").alias("runs"), F.avg((F.col("breaking") == 0).cast("double")).alias("clean_share"), F.avg("drifts").alias("mean_drifts"))
    b = drifts.agg(F.avg(F.col("breaking").cast("double")).alias("breaking_share"))
    c = findings.agg(F.count_if(F.col("status") == "open").alias("open_findings"), F.avg((F.col("status") == "suppressed").cast("double")).alias("suppressed_share"))
    return a.join(b).join(c)
