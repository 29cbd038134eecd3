"""Token rows to the output columns, names, references and diagnostics of each SQL file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions import text as tf
from weirflow.operators import lex

# Keywords that end a projection.
CLAUSE_END = "FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT MINUS QUALIFY WINDOW FETCH".split()
#: Before a parenthesis these make its inside a place for FROM names.
GROUP_LEADS = "FROM JOIN AS INNER LEFT RIGHT FULL CROSS OUTER ON USING".split()
NOT_TABLES = ["select", "values", "dual"]
# Pieces of SQL text that hide what is in them: comments, then strings and quoted identifiers.
_COMMENT = r"--[^\n]*+|/\*(?s:.*?)\*/"
_STRING = r"'[^'\n]*+(?:''[^'\n]*+)*+'"
_NAME = r'"[^"\n]*+"|`[^`\n]*+`'
_GAP = rf"(?:\s|{_COMMENT})*+"


def _projection(sig: DataFrame, key: str) -> DataFrame:
    """Tokens of the last SELECT at depth 0, with their projection segment."""
    upper = F.upper("value")
    whole = Window.partitionBy(key)
    running = whole.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    is_select = (F.col("kind") == "WORD") & (upper == "SELECT") & (F.col("depth") == 0) & ~F.col("inside")
    after = sig.withColumn("main", F.max(F.when(is_select, F.col("idx"))).over(whole)).where("idx > main and not inside")
    stops = (F.col("depth") == 0) & (((F.col("kind") == "WORD") & upper.isin(CLAUSE_END)) | (F.col("value") == ";") | F.col("unmatched"))
    ended = after.withColumn("_stop", F.max(stops.cast("int")).over(running)).where("_stop = 0")
    lead = (upper.isin("ALL", "DISTINCT")) & (F.col("idx") <= F.col("main") + 2)
    comma = (F.col("value") == ",") & (F.col("depth") == 0)
    return ended.where(~lead).withColumns({"seg": F.sum(comma.cast("int")).over(running), "_comma": comma}).where("not _comma")


def projection_columns(files: DataFrame, key: str = "path", text: str = "raw") -> DataFrame:
    """(key, ordinal, name, source_expr, alias, byte_start, byte_end, star) of each item of the main projection.

    `name` is null for a star and for an expression without a name; names are lower-cased. An alias counts at depth 0 only.
    """
    sig = lex.significant(lex.tokens(files, key, text), key)
    items = _projection(sig, key).groupBy(key, "seg").agg(F.sort_array(F.collect_list(F.struct("idx", "kind", "value", "start", "end", "byte_start", "byte_end", "depth"))).alias("t"))
    n, last = F.size("t"), F.element_at("t", -1)
    named = lambda x: x["kind"].isin("WORD", "QUOTED_IDENT")
    places = F.filter(F.sequence(F.lit(1), n), lambda i: (F.upper(F.element_at("t", i)["value"]) == "AS") & (F.element_at("t", i)["depth"] == F.element_at("t", 1)["depth"]) & (F.element_at("t", i)["kind"] == "WORD"))
    alias_at = F.try_element_at(F.col("t"), F.try_element_at(places, F.lit(-1)) + 1)
    alias = F.when(named(alias_at), F.lower(tf.unquote(alias_at["value"])))
    star = (last["value"] == "*") & ((n == 1) | (F.try_element_at(F.col("t"), F.lit(-2))["value"] == "."))
    name = (
        F.when(star, F.lit(None))
        .when(alias.isNotNull(), alias)
        .when((n == 1) & named(last), F.lower(tf.unquote(last["value"])))
        .when((n == 3) & (F.try_element_at(F.col("t"), F.lit(2))["value"] == ".") & named(last), F.lower(tf.unquote(last["value"])))
    )
    found = items.select(key, F.col("seg").alias("ordinal"), name.alias("name"), F.when(~star, alias).alias("alias"), star.alias("star"), F.element_at("t", 1)["start"].alias("_s"), last["end"].alias("_e"), F.element_at("t", 1)["byte_start"].alias("byte_start"), last["byte_end"].alias("byte_end"))
    joined = found.join(files.select(key, text), key)
    return joined.withColumn("source_expr", F.substring(F.col(text), F.col("_s").cast("int") + 1, (F.col("_e") - F.col("_s")).cast("int"))).select(key, "ordinal", "name", "source_expr", "alias", "byte_start", "byte_end", "star")


def _bare(text):
    """The text without comments and string literals; quoted identifiers stay."""
    return F.regexp_replace(tf.col(text), rf"({_NAME})|{_STRING}|{_COMMENT}", "$1 ")


def create_name(text):
    """The last part of the name in CREATE [OR REPLACE] [TEMP] [MATERIALIZED] TABLE|VIEW, lower-cased; null without one."""
    made = F.regexp_extract(_bare(text), r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(?:MATERIALIZED\s+)?(?:TABLE|VIEW)\s+((?:[\w\"`]+\s*\.\s*)*[\w\"`]+)", 1)
    return F.when(made != "", F.lower(tf.unquote(F.trim(F.element_at(F.split(made, r"\."), -1)))))


def _calls(name: str, text):
    """array<array<string>>: the quoted arguments, lower-cased, of each call of `name`, in order.

    Comments, strings and quoted identifiers are passed over whole, so what only looks like a call inside them is none; a call
    inside the arguments of another is one too.
    """
    inside = rf"((?:[^)'\"`\-/]++|{_STRING}|{_NAME}|{_COMMENT}|[-/])*+\))"
    found = F.regexp_extract_all(text, F.lit(rf"(?i){_COMMENT}|{_STRING}|{_NAME}|(?<![\p{{L}}\p{{N}}_]){name}{_GAP}\((?={inside})"), 1)
    arguments = lambda c: F.transform(F.regexp_extract_all(F.regexp_replace(c, rf"({_STRING}|{_NAME})|{_COMMENT}", "$1 "), F.lit(rf"{_STRING}|{_NAME}"), 0), lambda a: F.lower(tf.unquote(a)))
    return F.transform(F.filter(found, lambda c: c != ""), arguments)


def refs(files: DataFrame, key: str = "path", text: str = "raw") -> DataFrame:
    """(key, ordinal, name, kind) of ref() calls anywhere in a file, by their first argument, each name once, in order."""
    each = files.select(key, F.posexplode(_calls("ref", F.col(text))).alias("pos", "args")).where(F.size("args") > 0)
    first = each.select(key, F.element_at("args", 1).alias("name"), "pos").groupBy(key, "name").agg(F.min("pos").alias("pos"))
    return first.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).alias("ordinal"), "name", F.lit("ref").alias("kind"))


def sources(files: DataFrame, key: str = "path", text: str = "raw") -> DataFrame:
    """(key, ordinal, source, table) of source() calls with two or more arguments, each pair once, in order."""
    each = files.select(key, F.posexplode(_calls("source", F.col(text))).alias("pos", "args")).where(F.size("args") > 1)
    pairs = each.select(key, F.element_at("args", 1).alias("source"), F.element_at("args", 2).alias("table"), "pos")
    first = pairs.groupBy(key, "source", "table").agg(F.min("pos").alias("pos"))
    return first.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).alias("ordinal"), "source", "table")


def ctes(files: DataFrame, key: str = "path", text: str = "raw") -> DataFrame:
    """(key, ordinal, name) of the main query's CTEs, and of those in their bodies, which come before their owner.

    A definition is a name after the leading WITH [RECURSIVE] (at depth 0 or right at the start of a body), or after a comma
    that follows another definition, and has AS [NOT] [MATERIALIZED] and a body in parentheses.
    """
    sig = lex.significant(lex.tokens(files, key, text), key)
    w = Window.partitionBy(key).orderBy("idx")
    word = lambda n: F.when(F.lead("kind", n).over(w) == "WORD", F.upper(F.lead("value", n).over(w))) if n else F.upper("value")
    back = lambda n: F.coalesce(F.upper(F.lag("value", n).over(w)), F.lit(""))
    at = lambda n: F.coalesce(F.lead("value", n).over(w), F.lit(""))
    seen = sig.withColumns({"b1": back(1), "b2": back(2), "b3": back(3), "a1": at(1), "a2": at(2), "a3": at(3), "a4": at(4), "w1": word(1), "w2": word(2), "w3": word(3)})
    # How many tokens after the name its opening parenthesis is.
    opens = (
        F.when(F.col("a1") == "(", 1)
        .when((F.col("w1") == "AS") & (F.col("a2") == "("), 2)
        .when((F.col("w1") == "AS") & (F.col("w2") == "MATERIALIZED") & (F.col("a3") == "("), 3)
        .when((F.col("w1") == "AS") & (F.col("w2") == "NOT") & (F.col("w3") == "MATERIALIZED") & (F.col("a4") == "("), 4)
    )
    lead = (F.col("b1") == "WITH") & ((F.col("depth") == 0) | (F.col("b2") == "("))
    lead = lead | ((F.col("b1") == "RECURSIVE") & (F.col("b2") == "WITH") & ((F.col("depth") == 0) | (F.col("b3") == "(")))
    follows = (F.col("b1") == ",") & (F.col("b2") == ")") & (F.col("w1") == "AS")
    found = seen.where(F.col("kind").isin("WORD", "QUOTED_IDENT") & ~F.col("inside") & (lead | follows) & opens.isNotNull())
    closers = sig.where("value = ')'").select(F.col(key).alias("k2"), F.col("depth").alias("d2"), F.col("idx").alias("i2"))
    ended = found.join(closers, (F.col(key) == F.col("k2")) & (F.col("depth") == F.col("d2")) & (F.col("i2") > F.col("idx")), "left")
    placed = ended.groupBy(key, "idx", "value").agg(F.coalesce(F.min("i2"), F.lit(1 << 30)).alias("close"))
    order = Window.partitionBy(key).orderBy("close", F.col("idx").desc())
    return placed.select(key, (F.row_number().over(order) - 1).alias("ordinal"), F.lower(tf.unquote("value")).alias("name"))


def bare_refs(files: DataFrame, key: str = "path", text: str = "raw") -> DataFrame:
    """(key, ordinal, name, kind) of the names right after FROM, in files without a ref() call.

    A FROM inside parentheses counts if the nearest opener follows one of `GROUP_LEADS` (so EXTRACT(x FROM y) does not). Dotted
    names and template targets are skipped.
    """
    plain = files.join(refs(files, key, text).select(key).distinct(), key, "left_anti")
    sig = lex.significant(lex.tokens(plain, key, text), key)
    w = Window.partitionBy(key).orderBy("idx")
    near = sig.withColumns({"before": F.upper(F.lag("value").over(w)), "name": F.lead("value").over(w), "name_kind": F.lead("kind").over(w), "then": F.lead("value", 2).over(w)})
    levels = near.withColumn("_opens", F.when(F.col("value") == "(", F.col("before").isin(GROUP_LEADS)))
    # The nearest opener of a token at depth d stands at depth d - 1.
    openers = levels.where("_opens is not null").select(F.col(key).alias("k2"), F.col("depth").alias("d2"), F.col("idx").alias("i2"), F.col("_opens").alias("leads"))
    froms = levels.where("kind = 'WORD' and upper(value) = 'FROM' and not inside")
    enclosed = froms.join(openers, (F.col(key) == F.col("k2")) & (F.col("depth") - 1 == F.col("d2")) & (F.col("i2") < F.col("idx")), "left").groupBy(key, "idx", "depth", "name", "name_kind", "then").agg(F.max_by("leads", "i2").alias("ok"))
    name = F.lower(tf.unquote(F.col("name")))
    good = enclosed.where(((F.col("depth") == 0) | F.coalesce("ok", F.lit(False))) & F.col("name_kind").isin("WORD", "QUOTED_IDENT") & (F.coalesce("then", F.lit("")) != ".")).withColumn("name", name).where(~F.col("name").isin(NOT_TABLES))
    first = good.groupBy(key, "name").agg(F.min("idx").alias("pos"))
    return first.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).alias("ordinal"), "name", F.lit("bare").alias("kind"))


def template_hint(text):
    """Whether a {{ }} or {% %} region calls something other than ref, source or config, or holds a control word."""
    regions = F.regexp_extract_all(_bare(text), F.lit(r"\{\{(?s:.*?)\}\}|\{%(?s:.*?)%\}"), 0)
    odd = lambda r: F.size(F.filter(F.regexp_extract_all(r, F.lit(r"([A-Za-z_]\w*)\s*\("), 1), lambda c: ~F.lower(c).isin("ref", "source", "config"))) > 0
    control = lambda r: r.rlike(r"(?i)\{%-?\s*(?:if|for|macro|set|endif|endfor|else|elif|endmacro|call|block)\b")
    return F.exists(regions, lambda r: odd(r) | control(r))


def diagnostics(files: DataFrame, key: str = "path", text: str = "raw") -> DataFrame:
    """(key, line, col, reason, kind): the first lexical error of a file, else warnings on a star, no SELECT or unknown templates."""
    toks = lex.tokens(files, key, text)
    bad = toks.where("kind = 'ERROR'").groupBy(key).agg(F.min_by(F.struct("line", "col", "value"), "pos").alias("t")).select(key, "t.line", "t.col", F.concat(F.lit("unexpected or unterminated "), F.col("t.value")).alias("reason"), F.lit("error").alias("kind"))
    sound = toks.join(bad.select(key), key, "left_anti").where("kind not in ('SPACE', 'COMMENT')")
    first = sound.groupBy(key).agg(F.min_by(F.struct("line", "col"), "pos").alias("t"), F.max((F.col("kind") == "WORD") & (F.upper("value") == "SELECT")).alias("selects"))
    none = first.where("not selects").select(key, "t.line", "t.col", F.lit("no SELECT found").alias("reason"), F.lit("warning").alias("kind"))
    hints = files.where(template_hint(F.col(text))).select(key).join(first, key).select(key, "t.line", "t.col", F.lit("unknown_template_region").alias("reason"), F.lit("warning").alias("kind"))
    stars = projection_columns(files, key, text).where("star").select(key).distinct().join(first, key).select(key, "t.line", "t.col", F.lit("SELECT * asserts no columns").alias("reason"), F.lit("warning").alias("kind"))
    return bad.union(none).union(hints).union(stars.join(bad.select(key), key, "left_anti"))


def stages(files: DataFrame, schema_name: str = "weirflow.stage.v1", key: str = "path", text: str = "raw") -> DataFrame:
    """One row per file: path, name, columns, refs, sources, ctes, create_name, dialect_hints, fingerprint.

    The fingerprint is the SHA-256 of the canonical JSON without positions, paths and hints; it stays when only layout changes.
    """
    listed = lambda df, *fields: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ordinal", *fields))).alias("x"))
    cols = listed(projection_columns(files, key, text).where("name is not null"), "alias", "name", "source_expr").select(key, F.transform("x", lambda c: F.struct(c["alias"].alias("alias"), c["name"].alias("name"), c["source_expr"].alias("source_expr"))).alias("columns"))
    found = refs(files, key, text).unionByName(bare_refs(files, key, text))
    refs_ = listed(found, "kind", "name").select(key, F.transform("x", lambda c: F.struct(c["kind"].alias("kind"), c["name"].alias("name"))).alias("refs"))
    srcs = listed(sources(files, key, text), "source", "table").select(key, F.transform("x", lambda c: F.struct(c["source"].alias("source"), c["table"].alias("table"))).alias("sources"))
    ctes_ = listed(ctes(files, key, text), "name").select(key, F.transform("x", lambda c: F.struct(c["name"].alias("name"))).alias("ctes"))
    hints = F.when(template_hint(F.col(text)), F.array(F.lit("unknown_template_region"))).otherwise(F.array().cast("array<string>"))
    made = create_name(F.col(text))
    stem = F.lower(F.regexp_extract(key, r"([^/]+?)(?:\.[^./]*)?$", 1))
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    rows = (
        files.withColumns({"create_name": made, "name": F.coalesce(made, stem), "dialect_hints": hints})
        .join(cols, key, "left")
        .join(refs_, key, "left")
        .join(srcs, key, "left")
        .join(ctes_, key, "left")
        .select(key, text, "name", "create_name", "dialect_hints", empty("ctes", "array<struct<name:string>>"), empty("columns", "array<struct<alias:string,name:string,source_expr:string>>"), empty("refs", "array<struct<kind:string,name:string>>"), empty("sources", "array<struct<source:string,table:string>>"))
    )
    body = tf.canonical_json([F.col("columns"), F.col("create_name"), F.col("ctes"), F.lit("").alias("fingerprint"), F.lit("model").alias("kind"), F.col("name"), F.col("refs"), F.lit(schema_name).alias("schema"), F.col("sources"), F.lit(1).alias("v")])
    return rows.withColumn("fingerprint", tf.sha256_hex(body))


def pipeline_fingerprint(stages: DataFrame) -> DataFrame:
    """One row (fingerprint): the SHA-256 of the JSON list of the stages' fingerprints, sorted.

    Only hashes of one project's stages meet in one place, and a project has a bounded number of stages.
    """
    listed = F.transform(F.array_sort(F.collect_list("fingerprint")), lambda f: F.concat(F.lit('"'), f, F.lit('"')))
    return stages.agg(tf.sha256_hex(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))).alias("fingerprint"))
