"""The session state machine; the audit table is the state: one appended row per move."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions import text as tf
from weirflow.sources.store import Store

# States and the moves between them; staying is always allowed.
MOVES = {
    "start": ("parsed", "aborted"),
    "parsed": ("analyzed", "aborted"),
    "analyzed": ("planned", "aborted"),
    "planned": ("approved", "planned", "aborted"),
    "approved": ("applied", "approved", "aborted"),
    "applied": ("verified", "approved", "aborted"),
    "verified": ("done", "aborted"),
    "done": (),
    "aborted": ("start",),
}


class TransitionError(Exception):
    pass


def moves(spark) -> DataFrame:
    """(a, b) of the allowed moves."""
    return spark.createDataFrame([(a, b) for a, to in MOVES.items() for b in to], "a string, b string")


def check(state: str, target: str) -> str:
    if state not in MOVES or target not in MOVES:
        raise ValueError(f"unknown session state {state!r} or {target!r}")
    if state != target and target not in MOVES[state]:
        raise TransitionError(f"cannot move a session from {state!r} to {target!r}")
    return target


def state(store: Store, session_id: str) -> str:
    """The state the last audit row left; a session without rows is at its start."""
    last = store.read("audit").where((F.col("session_id") == session_id) & F.col("to_state").isNotNull()).agg(F.max_by("to_state", "audit_id")).first()[0]
    return last or "start"


def move(store: Store, session_id: str, target: str, action: str, args: str = "", result: str = "", exit_code: int = 0, actor: str = "cli") -> str:
    """Check the move and append its audit row; arguments are redacted."""
    before = state(store, session_id)
    check(before, target)
    # By the clock, so that two writers get different numbers, but never before a row that is there.
    number = max((store.read("audit").agg(F.max("audit_id")).first()[0] or 0) + 1, time.time_ns() // 1000)
    row = store.spark.range(1).select(
        F.lit(number).alias("audit_id"),
        F.lit(session_id).alias("session_id"),
        F.current_timestamp().alias("ts"),
        F.lit(actor).alias("actor"),
        F.lit(action).alias("action"),
        F.lit(before).alias("from_state"),
        F.lit(target).alias("to_state"),
        tf.redact(F.lit(args)).alias("args"),
        F.lit(result).alias("result"),
        F.lit(exit_code).alias("exit_code"),
    )
    store.append("audit", row)
    return target
