"""The thin queries of this subpackage: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from weirflow.llm import storage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    storage.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where the public tokenizer files are; a parameter of the environment, not of the repository.
TOKENIZERS = os.environ.get("WEIRFLOW_TOKENIZERS", "/opt/tokenizers")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm import warc

    folder = storage.scratch_path(spark, "warc")
    index = warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_records(index, folder).drop("url")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.pieces import token_rows

    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = token_rows(docs.withColumn("text_sha256", F.sha2("text", 256)), f"{TOKENIZERS}/piece_bpe_32k.model")
    decoded = F.sha2("decoded", 256)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("round_trip"), "parity_diff")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm import pii

    found = pii.spans(_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == pii.KINDS.index(k) + 1)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.span_text("base"), 256).alias("base_sha256"), pii.span_text("all_spans").alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.substring_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def _rest(modulus: int, rest: int):
    """Whether the CRC of the id, as text, leaves `rest`."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == rest


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~_rest(5, 0))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", _rest(5, 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.col("toxic_evidence").alias("evidence"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.spots import compare_in_order

    return compare_in_order(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm import quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(docs, _table(spark, sf_dir, "labels"), ~_rest(3, 1))
    out = quality.scored(docs, weights)
    return out.select("doc_id", _rest(3, 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


URL_RULES = "values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block') as t(host, path, action)"


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.url_rules import judge

    return judge(_table(spark, sf_dir, "pages"), spark.sql(f"select * from {URL_RULES}"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL



_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op1_warc": """
      with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
      m as (select *, count(*) over w as n, min(page_id) over w as least from p window w as (partition by hex)),
      b as (select *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
              ((position(upper(substr(hex, 1 + (5 * i) // 4, 1)) in '0123456789ABCDEF') - 1) * 16
               + greatest(position(upper(substr(hex, 2 + (5 * i) // 4, 1)) in '0123456789ABCDEF') - 1, 0)) // (1 << (3 - (5 * i) % 4)) % 32 as int), 1)) as digits from m)
      select page_id, octet_length(encode(html)) as payload_bytes, array_to_string(digits, '') as payload_digest,
             case when n > 1 and least is not null and page_id is distinct from least then 'revisit' else 'response' end as record_type,
             case when n > 1 and least is not null and page_id is distinct from least then least end as refers_to
      from b""",
    "op5_substring_dedup": r"""
      with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
      win as (select doc_id, i, sha1(array_to_string(ws[i:i + 49], ' ')) as h from (select *, unnest(range(1, len(ws) - 48)) as i from w)),
      first as (select h, min(doc_id) as least from win group by h),
      hit as (select doc_id, i from win join first using (h) where least < doc_id),
      gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from hit),
      word as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
      kept as (select word.doc_id, string_agg(word, ' ' order by p) as text, count(*) as n from word anti join gone using (doc_id, p) group by 1)
      select w.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from w left join kept using (doc_id)""",
    "op7_ngram_jaccard": rf"""
      with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as ws from documents),
      s as materialized (select distinct doc_id, sha1(array_to_string(sh, ' ') || len(sh)) as h from (select doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) when len(ws) > 0 then [ws] else [] end) as sh from w)),
      size as materialized (select doc_id, count(*) as n from s group by 1),
      pair as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b using (h) where a.doc_id < b.doc_id group by 1, 2),
      link as materialized (select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
      both_ways as materialized (select a, b from link union all select b, a from link),
      reach(id, c) as (select doc_id, doc_id from documents union select b, c from reach join both_ways on a = id where b > c)
      select w.doc_id, coalesce(n, 0) as n_shingles, least from w left join size using (doc_id) join (select id as doc_id, min(c) as least from reach group by 1) using (doc_id)""".replace("n_shingles, least from w", "n_shingles, least as component_id from w"),
    "op10_url_filters": f"""
      with rest as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
      cut as (select page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) as raw_host from rest),
      part as (select row_number() over () as row, page_id, {_LOWER.format("raw_host")} as host, regexp_extract(substr(rest, length(raw_host) + 1), '^([^?#]*)', 1) as path from cut),
      rules as (select * from ({URL_RULES.replace(" as t", ") as t").replace("values", "values", 1)}),
      fits as (select row, arg_max(rules.host || rules.path, length(rules.host || rules.path)) as rule, arg_max(action, length(rules.host || rules.path)) as action
               from part join rules on (part.host = rules.host or ends_with(part.host, '.' || rules.host)) and starts_with(part.path, rules.path) group by row)
      select page_id, host, path, rule, coalesce(action, 'allow') as verdict from part left join fits using (row)""",
}
