"""The rewrite session: plan, approve, apply, verify, each step checked against the session's state and audited."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators import parse, rewrite, sessions
from weirflow.sources.store import Store


#: Restore points, by plan, beside the project.
RESTORE = ".weirflow/restore"


def _remember(store: Store, session_id: str, state: str, plan_hash: str) -> None:
    row = store.spark.range(1).select(F.lit(session_id).alias("session_id"), F.lit(state).alias("state"), F.lit(plan_hash).alias("plan_hash"), F.current_timestamp().alias("updated_at"))
    store.append("sessions", row)


def known_hash(store: Store, session_id: str) -> str | None:
    row = store.latest("sessions", "session_id").where(F.col("session_id") == session_id).first()
    return row.plan_hash if row else None


def plan(store: Store, session_id: str, items: DataFrame, root: str, fingerprint: str, most_tier: str, path: str) -> str:
    """Write the plan file, append its items, and bring the session to `planned`; returns the plan's hash."""
    if sessions.state(store, session_id) == "start":
        sessions.move(store, session_id, "parsed", "PARSE", args=root)
        sessions.move(store, session_id, "analyzed", "ANALYZE")
    digest = rewrite.plan_hash(items, root, fingerprint, most_tier).first().plan_hash
    sessions.move(store, session_id, "planned", "PLAN", args=path, result=digest)
    rewrite.write_plan(items, path, digest)
    shaped = items.withColumns({"plan_id": F.lit(digest), "span": F.struct("start", "end"), "state": F.when(F.col("blocked"), "blocked").otherwise("pending"), "updated_at": F.current_timestamp()})
    store.append("plan_items", shaped)
    _remember(store, session_id, "planned", digest)
    return digest


def sound(applied: DataFrame) -> DataFrame:
    """`rewrite.apply`'s rows; a file whose new text has a lexical error keeps its text and is `unparsable`."""
    fresh = applied.where("status = 'applied'").select("path", F.col("rewritten").alias("raw"))
    broken = parse.diagnostics(fresh).where("kind = 'error'").select("path", F.lit(True).alias("_broken"))
    joined = applied.join(broken, "path", "left")
    bad = F.coalesce("_broken", F.lit(False))
    return joined.withColumns({"rewritten": F.when(bad, F.col("raw")).otherwise(F.col("rewritten")), "status": F.when(bad, "unparsable").otherwise(F.col("status"))}).drop("_broken")


def dry_run(files: DataFrame, items: DataFrame) -> DataFrame:
    """(item_hash, rule_id, stage, path, status, diff) of a plan's items: will_apply, noop, blocked or errors; nothing is written."""
    done = sound(rewrite.apply(files, items.where("not blocked")))
    shown = items.join(rewrite.file_diffs(done), "path", "left")
    status = F.when(F.col("blocked"), "blocked").when(F.col("status") == "applied", "will_apply").when(F.col("status") == "noop", "noop").otherwise("errors")
    return shown.select("item_hash", "rule_id", "stage", "path", status.alias("status"), F.coalesce("diff", F.lit("")).alias("diff"), "ordinal").orderBy("ordinal").drop("ordinal")


def approve(store: Store, session_id: str) -> None:
    sessions.move(store, session_id, "approved", "APPROVE")


def apply(store: Store, session_id: str, files: DataFrame, root: str, path: str, out: str | None = None) -> DataFrame:
    """Apply the session's plan, in place with `.orig` backups or into `out`; a plan of another hash is refused.

    Applying again when the session is done changes nothing, and items whose hash this plan has applied are passed over. A file
    that would not parse after its edits is left as it is. Returns (path, status).
    """
    items, digest = rewrite.read_plan(store.spark, path)
    if digest != known_hash(store, session_id):
        raise ValueError("the plan is not the session's")
    if sessions.state(store, session_id) == "done":
        return items.select("path").distinct().withColumn("status", F.lit("noop"))
    sessions.check(sessions.state(store, session_id), "applied")
    # Fetched now, as the table they are in is written to below; they are no more than the plan, which was read here.
    before = [r.item_hash for r in store.items(digest).where("state = 'applied'").select("item_hash").distinct().collect()]
    items = items.where(~F.col("item_hash").isin(before))
    done = sound(rewrite.apply(files, items.where("not blocked"))).cache()
    kept = Path(root) / RESTORE / digest.rpartition(":")[2][:16]
    for row in done.where("status = 'applied'").toLocalIterator():
        source = Path(root) / row.path
        if not out:
            _remember_file(kept, row.path, row.raw)
        target = Path(out) / row.path if out else source
        target.parent.mkdir(parents=True, exist_ok=True)
        if not out:
            source.with_name(source.name + ".orig").write_text(row.raw, encoding="utf-8")
        fresh = target.with_name(target.name + ".new")
        fresh.write_text(row.rewritten, encoding="utf-8")
        os.replace(fresh, target)
    counts = {r.status: r["count"] for r in done.groupBy("status").count().collect()}
    state = F.when(F.col("status") == "applied", "applied").when(F.col("status") == "noop", "noop").otherwise("skipped")
    store.append("plan_items", items.join(done.select("path", "status"), "path").withColumns({"plan_id": F.lit(digest), "span": F.struct("start", "end"), "state": state, "updated_at": F.current_timestamp()}))
    sessions.move(store, session_id, "applied", "APPLY", args=path, result=str(counts))
    return done.select("path", "status")


def _remember_file(kept: Path, path: str, raw: str) -> None:
    """Keep a file as it was before its first edit by this plan, and name it in the restore point's manifest."""
    listed = kept / "manifest.json"
    known = json.loads(listed.read_text(encoding="utf-8")) if listed.exists() else {}
    if path not in known:
        target = kept / "files" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(raw, encoding="utf-8")
        known[path] = hashlib.sha256(raw.encode()).hexdigest()
        fresh = kept / "manifest.new"
        fresh.write_text(json.dumps(known, sort_keys=True), encoding="utf-8")
        os.replace(fresh, listed)


def restore(store: Store, session_id: str, root: str) -> list[str]:
    """Put back every file that the session's plan edited in place, in reverse order, and abort the session; returns their paths.

    A kept file that no longer has its noted hash is refused before anything is written.
    """
    digest = known_hash(store, session_id) or ""
    kept = Path(root) / RESTORE / digest.rpartition(":")[2][:16]
    listed = kept / "manifest.json"
    if not digest or not listed.exists():
        raise ValueError("the session has no restore point")
    known = json.loads(listed.read_text(encoding="utf-8"))
    texts = {p: (kept / "files" / p).read_text(encoding="utf-8") for p in sorted(known, reverse=True)}
    for path, raw in texts.items():
        if hashlib.sha256(raw.encode()).hexdigest() != known[path]:
            raise ValueError(f"the kept text of {path} has changed")
    for path, raw in texts.items():
        fresh = Path(root) / (path + ".new")
        fresh.write_text(raw, encoding="utf-8")
        os.replace(fresh, Path(root) / path)
    sessions.move(store, session_id, "aborted", "RESTORE", args=root, result=str(len(texts)))
    return list(texts)


def verify(store: Store, session_id: str, problems: DataFrame) -> bool:
    """Without problems the session is verified and done; with some it goes back to `approved`."""
    clean = problems.isEmpty()
    if clean:
        sessions.move(store, session_id, "verified", "VERIFY")
        sessions.move(store, session_id, "done", "CLOSE")
    else:
        sessions.move(store, session_id, "approved", "VERIFY", result="problems remain", exit_code=1)
    return clean


def states(items: DataFrame) -> DataFrame:
    """(state, n) of plan items."""
    return items.groupBy("state").agg(F.count("*").alias("n"))


def item_states(store: Store, plan_id: str) -> DataFrame:
    return states(store.items(plan_id))


def already_applied(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The items, each once, whose `keys` are among those of work that is done."""
    return items.join(done.select(*keys).distinct(), keys, "left_semi").distinct()
