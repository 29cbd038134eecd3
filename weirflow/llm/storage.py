"""Scratch tables in the folder the cluster shares, and size estimates from the plan."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and the Python worker at once.
ARROW_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, in case they were started without it; keep Arrow batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_weirflow_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="weirflow-")) / "weirflow.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted((root / "weirflow").rglob("*.py")):
            z.write(source, source.relative_to(root))
    sc.addPyFile(str(target))
    sc._weirflow_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or what `setCheckpointDir` was given; in local mode with neither, a temporary folder becomes it.

    On a cluster a folder that all machines share must be named: a machine's own folder would lose tables.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("no shared folder: set spark.checkpoint.dir to one that driver and executors reach")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weirflow-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weirflow/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weirflow_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table behind a materialised DataFrame that nothing reads any more."""
    spark, path = df.sparkSession, df._weirflow_path
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of `df`; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_each: int, least: int = 32) -> int:
    """As many buckets as hold about `bytes_each` each, at any size of `df`; only the type of a bucket number bounds it."""
    return int(min(1 << 30, max(least, plan_bytes(df) // bytes_each)))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, behind as many underscores as it takes to clash with no column of `df`."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


#: Keys with more rows than this, and more than a HOT_KEYS-th of all, are joined by broadcast: there are HOT_KEYS of them at most.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str], count: str) -> DataFrame:
    """`rows` left-joined with `classes`, which has one row a key and in `count` the number of `rows` of that key.

    Rows of hot keys, of which there are few by their definition, get theirs from a broadcast and are never dealt by key, so a
    key that holds a third of all rows is no heavier than another.
    """
    total = classes.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(HOT_ROWS, total // HOT_KEYS)
    few = F.broadcast(classes.where(hot))
    there = rows.join(few, keys, "inner")
    others = rows.join(few.select(*keys), keys, "left_anti").join(classes.where(~hot), keys, "left")
    return there.unionByName(others)


def possibly(df: DataFrame, key: Column, ids: DataFrame, id_col: str, name: str, max_bits: int = 1 << 26) -> DataFrame:
    """`df` with the column `name`: false where `key` is surely not in `ids`, by a bitmap of bounded size.

    The bitmap has 16 bits an id, at most `max_bits` (8 MB at the default), so it can be broadcast at any size of
    `ids`; beyond that it only says true more often.
    """
    n = ids.count()
    size = 1 << 10
    while size < min(max_bits, 16 * n):
        size *= 2
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    place = lambda c: F.floor(slot(c) / 64).cast("long")
    bit = lambda c: F.pmod(slot(c), F.lit(64)).cast("int")
    word, bits = unused(df, "word", "bits")
    bitmap = (
        ids.select(place(F.col(id_col)).alias(word), F.expr("1L").alias("one"), bit(F.col(id_col)).alias("bit"))
        .groupBy(word)
        .agg(F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("bit"))).alias(bits))
    )
    flagged = df.withColumn(word, place(key)).join(F.broadcast(bitmap), word, "left")
    has = F.call_function("shiftrightunsigned", F.col(bits), bit(key)).bitwiseAND(F.lit(1).cast("long")) == 1
    return flagged.withColumn(name, F.coalesce(has, F.lit(False))).drop(word, bits)


def keep_possible(df: DataFrame, key: str, ids: DataFrame, id_col: str, negate: bool = False) -> DataFrame:
    """Rows of `df` whose key may be in `ids`, see `possibly`; an exact join must follow. Negated: the others."""
    (name,) = unused(df, "maybe")
    flagged = possibly(df, F.col(key), ids, id_col, name)
    return flagged.where(~F.col(name) if negate else F.col(name)).drop(name)
