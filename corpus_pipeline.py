"""Training-corpus pipeline: quality classifier, near-duplicate join, decontamination, PII, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import decontaminate, ngram_join, pieces, pii, quality, storage
from weirflow.llm.queries import TOKENIZERS


def _side(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    storage.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of the documents at hand."""
    weights = quality.fit(docs, _side(spark, sf_dir, "labels"))
    return quality.kept(docs, weights)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; rows of a null id stay."""
    storage.ship(spark)
    dropped = ngram_join.jaccard_components(docs).where("component_id is not null and doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    dropped = storage.materialise(dropped, "pipeline-dropped")
    possible = storage.keep_possible(docs.where("doc_id is not null"), "doc_id", dropped, "doc_id", negate=True)
    maybe = storage.keep_possible(docs.where("doc_id is not null"), "doc_id", dropped, "doc_id")
    once = maybe.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    return possible.unionByName(once).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, _side(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids, parity_diff) of each document."""
    storage.ship(spark)
    out = pieces.token_rows(docs, f"{TOKENIZERS}/piece_bpe_32k.model", with_text=False)
    return out.drop("n_chars")


STAGES = [
    ("quality", keep_good),
    ("near-duplicates", keep_one_of_group),
    ("decontamination", drop_contaminated),
    ("personal-data", redact_personal),
    ("tokens", tokenise),
]

#: The trained classifier is not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _side(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = storage.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            storage.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
