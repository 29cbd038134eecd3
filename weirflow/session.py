"""Session settings the library expects: UTC, adaptive execution, skew handling, and the folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def create(name: str = "weirflow", master: str | None = None, shared: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings; `shared` is a folder that driver and executors reach, for checkpoints."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | extra)
    spark = (builder.master(master) if master else builder).getOrCreate()
    if shared:
        spark.sparkContext.setCheckpointDir(shared)
    return spark


def checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder: `spark.checkpoint.dir`, or what the context was given; in local mode with neither, a new temporary one.

    On a cluster without one this refuses, because a machine's own folder is lost with the machine.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("no shared folder for checkpoints: set spark.checkpoint.dir to one that driver and executors reach")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="weirflow-"))
    return sc.getCheckpointDir()
