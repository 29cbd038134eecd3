"""URL allow and block rules by a sort-merge range join, in DataFrame operations alone.

A rule (host, path) becomes an interval of canonical keys: its host with the labels reversed, then all paths from its own
up to its own followed by the byte FF, which UTF-8 never holds. A URL is a point under each of the few host suffixes
that are as short as the rules' hosts. Points and interval ends of one reversed host are sorted together; as a host's path
prefixes are nested or apart, the active rules form a stack, and the sweep carries its top: a start pushes its rule, an end
gives back the rule below. The longest rule over a URL's suffixes wins.

A host with many points is dealt over as many sweeps as its count asks for; each gets a copy of that host's interval ends.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm import storage

#: Points of one reversed host that a sweep should have, and how many times the interval ends it gets a copy of.
SWEEP_ROWS, SWEEP_TIMES = 1 << 10, 4


def split_url(url):
    """(host, path) columns: host from the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; path up to `?` or `#`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(labels):
    return F.array_join(F.reverse(labels), ".")


def _events(rules: DataFrame) -> DataFrame:
    """(key, pos, kind, active): where the innermost rule of a reversed host changes, and to which."""
    clean = rules.where("host is not null and path is not null and host <> ''").groupBy(F.lower("host").alias("host"), "path").agg(F.max("action").alias("action"))
    per_host = clean.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "action"))).alias("rules"))
    stacked = per_host.select(
        _reversed(F.split("host", "\\.")).alias("key"),
        F.explode(
            F.expr("""
            aggregate(rules,
              named_struct('stack', cast(array() as array<struct<path:string,action:string>>),
                           'seen', cast(array() as array<struct<rule:struct<path:string,action:string>,below:struct<path:string,action:string>>>)),
              (acc, r) -> named_struct(
                'stack', concat(filter(acc.stack, s -> startswith(r.path, s.path)), array(r)),
                'seen', concat(acc.seen, array(named_struct('rule', r, 'below', try_element_at(filter(acc.stack, s -> startswith(r.path, s.path)), -1))))),
              acc -> acc.seen)""")
        ).alias("e"),
        "host",
    )
    full = lambda c: F.when(F.col(c).isNotNull(), F.concat("host", F.col(f"{c}.path")))
    top = lambda c: F.struct(full(c).alias("rule"), F.col(f"{c}.action").alias("action"), F.length("host").alias("host_length"))
    start = stacked.select("key", F.col("e.rule.path").cast("binary").alias("pos"), F.lit(1).alias("kind"), top("e.rule").alias("active"))
    end = stacked.select("key", F.concat(F.col("e.rule.path").cast("binary"), F.unhex(F.lit("FF"))).alias("pos"), F.lit(0).alias("kind"), top("e.below").alias("active"))
    return start.union(end)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict).

    `rules` is (host, path, action). Of equal rules `block` wins; of rules of equal length the one with the longer host. A URL
    without `://`, or null, has an empty host and path and the default verdict. Pages keep null and repeated ids.
    """
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    events = storage.materialise(_events(rules), "url-events")
    labels = F.split("host", "\\.")
    deepest = rules.agg(F.max(F.size(F.split("host", "\\.")))).first()[0] or 0
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest))), lambda n: _reversed(F.slice("labels", -n, n)))
    points = (
        urls.where("host <> ''")
        .groupBy("host", "path")
        .agg(F.count("*").alias("_n"))
        .withColumn("labels", labels)
        .select("host", "path", F.explode(suffixes if deepest else F.array().cast("array<string>")).alias("key"))
    )
    # Copies of interval ends stay under a share of the points, whatever the number of rules.
    counted = points.groupBy("key").agg(F.count("*").alias("n")).join(events.groupBy("key").agg(F.count("*").alias("ends")), "key")
    each = F.greatest(F.lit(SWEEP_ROWS), F.col("ends") * SWEEP_TIMES)
    sweeps = storage.materialise(counted.select("key", "n", (F.floor(F.col("n") / each) + 1).alias("sweeps")), "url-sweeps")
    points = storage.with_class(points, sweeps, ["key"], "n").where("n is not null")
    top_type = events.schema["active"].dataType.simpleString()
    points = points.select("key", F.col("path").cast("binary").alias("pos"), F.lit(2).alias("kind"), F.lit(None).cast(top_type).alias("active"), "host", "path", F.pmod(F.xxhash64("host", "path"), F.col("sweeps")).alias("salt"))
    dealt = events.join(sweeps.select("key", "sweeps"), "key").withColumns({"host": F.lit(None).cast("string"), "path": F.lit(None).cast("string"), "salt": F.explode(F.sequence(F.lit(0).cast("long"), F.col("sweeps") - 1))}).drop("sweeps")
    sweep = Window.partitionBy("key", "salt").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = points.unionByName(dealt).withColumn("active", F.last("active", ignorenulls=True).over(sweep)).where("kind = 2 and active.rule is not null")
    best = swept.groupBy("host", "path").agg(F.max_by(F.struct("active.rule", "active.action"), F.struct(F.length("active.rule"), F.col("active.host_length"))).alias("top"))
    judged = urls.where("host <> ''").join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.action", F.lit(default)).alias("verdict"))
    # URLs without a host fit no rule, and would all share one key.
    return judged.union(urls.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string"), F.lit(default)))
