"""Run history as append-only Parquet tables; current state is the latest row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.operators import history

# The tables and their columns.
SCHEMAS = {
    "runs": "run_id long, root string, checked_at timestamp, stages long, drifts long, breaking long",
    "stages": "run_id long, name string, path string, refs array<string>, columns array<string>",
    "lineage_edges": "run_id long, producer string, consumer string, kind string",
    "drifts": "run_id long, producer string, consumer string, added array<string>, removed array<string>, renamed array<struct<old:string,new:string>>, breaking boolean",
    "scans": "run_id long, rule_id string, severity string, path string, line int, col int, span struct<start:int,end:int>, snippet_redacted string, hint string, status string",
    "sessions": "session_id string, run_id long, state string, plan_hash string, max_risk string, updated_at timestamp",
    "plan_items": "plan_id string, change_id string, ordinal int, rule_id string, tier string, stage string, path string, span struct<start:int,end:int>, before string, after string, item_hash string, state string, updated_at timestamp",
    "audit": "audit_id long, session_id string, ts timestamp, actor string, action string, from_state string, to_state string, args string, result string, exit_code int",
}


class Store:
    """Tables under one folder. Appends never rewrite; a reader sees missing tables as empty ones."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, table: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        if not there:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).option("mergeSchema", "true").parquet(f"{self.folder}/{table}")

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], SCHEMAS[table]).schema
        have = set(rows.columns)
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))

    def append(self, table: str, rows: DataFrame) -> None:
        self._shaped(table, rows).write.mode("append").parquet(f"{self.folder}/{table}")

    def next_run(self) -> int:
        return (self.read("runs").agg(F.max("run_id")).first()[0] or 0) + 1

    def latest(self, table: str, *keys: str, by: str = "updated_at") -> DataFrame:
        newest = Window.partitionBy(*keys).orderBy(F.col(by).desc())
        return self.read(table).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")

    def recent_runs(self, n: int = 10) -> DataFrame:
        return history.recent(self.read("runs"), "run_id", n)

    def audit_log(self, session_id: str | None = None, n: int = 100, since: Column | None = None) -> DataFrame:
        return history.log_of(self.read("audit"), "audit_id", session_id and "session_id", session_id, n, since)

    def drift_history(self, n: int | None = None) -> DataFrame:
        return history.found_of(self.read("runs"), self.read("drifts").select("run_id", "producer", "consumer", "breaking"), n=n)

    def items(self, plan_id: str) -> DataFrame:
        """A plan's items as they stand, in order of the text of their change ids (c10 before c2)."""
        return self.latest("plan_items", "plan_id", "change_id").where(F.col("plan_id") == plan_id).orderBy("change_id")

    def export(self, folder: str) -> None:
        """One way out for analytics: the tables of runs, findings, drifts and audit as Parquet files of the present schema."""
        for table in ("runs", "scans", "drifts", "lineage_edges", "audit"):
            self.read(table).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{table}")

    def migrate(self) -> int:
        """Rewrite tables that an older version wrote without some of today's columns; returns how many there were.

        A table is written anew beside the old one and then takes its place, so a stop halfway leaves one of the two whole.
        """
        done = 0
        fs_of = lambda p: p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for table, shape in SCHEMAS.items():
            where = lambda suffix="", table=table: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}{suffix}")
            if not fs_of(where()).exists(where()):
                continue
            have = self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{table}")
            wanted = self.spark.createDataFrame([], shape).schema
            if set(wanted.names) <= set(have.columns):
                continue
            self._shaped(table, have).write.mode("overwrite").parquet(f"{self.folder}/{table}.new")
            fs_of(where()).delete(where(), True)
            fs_of(where()).rename(where(".new"), where())
            done += 1
        return done
