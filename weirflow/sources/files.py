"""File corpora as DataFrames: SQL projects, code to scan, and source catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a security scan reads and skips.
SCAN_EXTENSIONS = ("sql", "py", "sh", "bash")
SKIPPED_FOLDERS = (".git", ".venv", "venv", "__pycache__", "node_modules", ".dbt")
MOST_BYTES = 1_000_000


def _relative(root: str):
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    return F.regexp_replace(F.substring(path, len(root.rstrip("/")) + 1, 1 << 20), "^/+", "")


def project(spark: SparkSession, root: str, pattern: str = "*.[sS][qQ][lL]") -> DataFrame:
    """(path, raw) of every SQL file under `root`; bytes that are not UTF-8 become U+FFFD. Sort by path where order matters."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select(_relative(root).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))


def scan_corpus(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """((path, ext, content), (path, length)): files to scan, and those left out for their size. Content is read for the former only."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("rel", _relative(root))
    ext = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))
    folders = "|".join(x.replace(".", r"\.") for x in SKIPPED_FOLDERS)
    wanted = found.withColumn("ext", ext).where(F.col("ext").isin(*SCAN_EXTENSIONS) & ~F.col("rel").rlike(rf"(?:^|/)(?:{folders})/"))
    small = wanted.where(F.col("length") <= most_bytes).select(F.col("rel").alias("path"), "ext", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return small, wanted.where(F.col("length") > most_bytes).select(F.col("rel").alias("path"), "length")


def catalog_rows(lines: DataFrame, order: str = "n", file: str = "path") -> DataFrame:
    """(file, source, table) from the lines (file, n, line) of source catalogs.

    A `- name:` indented by five or more names a table of the source named last before it.
    """
    found = lines.select(file, order, F.length(F.regexp_extract("line", r"^(\s*)- name:", 1)).alias("indent"), F.lower(F.regexp_replace(F.regexp_extract("line", r"^\s*- name:\s*(.+?)\s*$", 1), "^['\"]|['\"]$", "")).alias("name")).where("name <> ''")
    before = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = found.withColumn("source", F.last(F.when(F.col("indent") < 5, F.col("name")), ignorenulls=True).over(before))
    return filled.where("indent >= 5 and source is not null").select(file, "source", F.col("name").alias("table"))


def source_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Distinct `source.table` names of every sources.yml under `root`."""
    whole = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "sources.y*ml").text(root).withColumn("path", F.col("_metadata.file_path"))
    lines = whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return catalog_rows(lines).select(F.concat_ws(".", "source", "table").alias("name")).distinct()
