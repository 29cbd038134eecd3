"""Extensions on event streams: exactly-once rows, windowed counts with late data, failure streaks per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def once(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once; state is dropped behind the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, ts: str = "ts", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per window; rows later than the watermark are left out, as the output mode asks."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, size), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def breaker(events: DataFrame, limit: int = 5, failure: str = "error") -> DataFrame:
    """(user_id, streak, open): a key's circuit opens after `limit` failures in a row; state is one number a key."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            streak = streak + 1 if kind == failure else 0
        state.update((streak,))
        yield pd.DataFrame({"user_id": [key[0]], "streak": [streak], "open": [streak >= limit]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, streak int, open boolean", "streak int", "update", GroupStateTimeout.NoTimeout)
