"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame and SQL operations alone.

Base kinds are found with regular expressions whose runs are possessive and start at run starts only, so they stay linear on
long runs; offsets come from the lengths of the gaps between matches. The entities found are seeds. Their lexical patterns are
the word or the two words left or right of them, and the word left together with the shape of the entity. Patterns and
instances form a graph, scored in turns: a pattern of a kind is as good as the share of its instances known to be of that kind
(with a least number of them), an instance as good as its best left and its best right pattern together (noisy or). Candidates
are tokens with many digits or an @, digits spaced apart, and addresses spelt out ("name at host dot org"); those that reach
`CONFIDENCE` become known instances and seeds of the next turn, and their occurrences are added to the spans. Turns end when one
adds nothing. Only (pattern, instance) pairs are iterated on, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm import storage

KINDS = ("email", "ip", "card", "phone")
LEAST_SUPPORT = 3
CONFIDENCE = 0.8
LEAST_DIGITS = 5

# The base patterns. A run starts where none of its characters precedes, or where the last match ended.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# What may be an unseen identifier, with a hint: a token with a digit or an @, digits spaced apart, an address spelt out.
_NAME, _AT, _DOT = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+", r"(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)", r"(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)"
CANDIDATES = {
    "token": (r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", "[0-9@]"),
    "apart": (r"(?<![\w+.-])\(?[0-9]{2,6}+\)?(?:[\x20./-]\(?[0-9]{2,6}+\)?)++(?!\w)", r"[0-9]{2}\)?[\x20./-]\(?[0-9]{2}"),
    "spelt": (rf"(?<![A-Za-z0-9]){_NAME}{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+)++", rf"{_AT}[A-Za-z0-9-]{{1,63}}+{_DOT}[A-Za-z0-9-]"),
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    d = F.reverse(_digits(c))
    one = lambda i: F.substring(d, i, F.lit(1)).cast("int") * (2 - F.pmod(i, F.lit(2)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + one(i) - F.when(one(i) > 9, 9).otherwise(0))
    return F.pmod(total, F.lit(10)) == 0


def _passes() -> Column:
    n = F.length(_digits(F.col("match")))
    return (
        F.when(F.col("kind") == "ip", F.col("match").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(F.col("kind") == "card", n.between(16, 19) & F.when(n.between(16, 19), _luhn(F.col("match"))).otherwise(False))
        .when(F.col("kind") == "phone", n.between(8, 15))
        .otherwise(True)
    )


def _word(c: Column, left: bool) -> Column:
    """The nearest word of a gap, lower-cased and without punctuation; empty where the gap has none."""
    return F.lower(F.regexp_replace(F.regexp_extract(c, r"(\S++)\s*+$" if left else r"^\s*+(\S++)", 1), r"^\p{Punct}+|\p{Punct}+$", ""))


def _two(c: Column, left: bool) -> Column:
    """The two nearest words of a gap, lower-cased; empty where it has fewer."""
    return F.lower(F.regexp_replace(F.regexp_extract(c, r"(\S++\s++\S++)\s*+$" if left else r"^\s*+(\S++\s++\S++)", 1), r"\s+", " "))


def _tail(c: Column) -> Column:
    """Enough of a gap's end to hold its last word; longer words are contexts by their ends."""
    return F.substring(c, F.greatest(F.lit(1), F.length(c) - 63), F.lit(64))


def _found(kind: str, pattern: str, hint: str) -> Column:
    """array<struct<kind, gap, match, left, right, before, after>> of the matches in `text`; the latter are two words each."""
    text = F.col("text")
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    ends = F.transform(gaps, lambda g: F.struct(F.length(g).alias("n"), _word(_tail(g), True).alias("l"), _word(F.substring(g, 1, 64), False).alias("r"), _two(_tail(g), True).alias("ll"), _two(F.substring(g, 1, 64), False).alias("rr")))
    each = F.zip_with(
        F.arrays_zip(F.slice(ends, 1, F.size(ends) - 1).alias("a"), F.slice(ends, 2, F.size(ends) - 1).alias("b")),
        hits,
        lambda g, m: F.struct(F.lit(kind).alias("kind"), g["a"]["n"].alias("gap"), m.alias("match"), g["a"]["l"].alias("left"), g["b"]["r"].alias("right"), g["a"]["ll"].alias("before"), g["b"]["rr"].alias("after")),
    )
    empty = F.array().cast("array<struct<kind:string,gap:int,match:string,left:string,right:string,before:string,after:string>>")
    return F.when(text.rlike(hint), each).otherwise(empty)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, matches with offsets): rows are (rid, doc_id, digest); matches hold base kinds that pass, and candidates."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = F.concat(*(_found(k, PATTERNS[k], _HINT[k]) for k in KINDS), *(_found(k, *shape) for k, shape in CANDIDATES.items()))
    rows = storage.materialise(texts.select("rid", "doc_id", F.xxhash64("text").alias("digest"), found.alias("found")), "pii-rows")
    running = Window.partitionBy("rid", "kind").orderBy("i")
    each = rows.where(F.size("found") > 0).select("rid", F.posexplode("found").alias("i", "m")).select("rid", "i", "m.*")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(running)).withColumn("start", F.col("end") - F.length("match"))
    return rows.select("rid", "doc_id", "digest"), storage.materialise(placed.where(_passes()).select("rid", "kind", "start", "end", "match", "left", "right", "before", "after"), "pii-matches")


def _edges(found: DataFrame, instance: str) -> DataFrame:
    """(instance, side, pattern) of each occurrence: the words beside it, and the left one with the instance's shape."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(instance, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[0-9]", "9")
    pattern = lambda side, mark, *words: F.struct(F.lit(side).alias("side"), F.when(F.length(words[0]) > 0, F.concat_ws(" ", F.lit(mark), *words)).alias("pattern"))
    each = F.array(pattern("l", "l:", F.col("left")), pattern("r", "r:", F.col("right")), pattern("l", "ll:", F.col("before")), pattern("r", "rr:", F.col("after")), pattern("l", "ls:", F.col("left"), shape))
    return found.select(F.col(instance).alias("instance"), F.explode(each).alias("e")).select("instance", "e.side", "e.pattern").where("pattern is not null")


def _bootstrap(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, instance) of the instances that the pattern graph adds to `known`, turn after turn until one adds none."""
    edges = storage.materialise(edges.distinct(), "pii-edges")
    known = storage.materialise(known.distinct(), "pii-known")
    size = storage.materialise(edges.groupBy("pattern").agg(F.count("*").alias("n")), "pii-patterns")
    added = known.limit(0)
    while True:
        hits = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("hits")).where(F.col("hits") >= LEAST_SUPPORT)
        good = hits.join(size, "pattern").withColumn("trust", F.col("hits") / F.col("n")).where(F.col("trust") >= CONFIDENCE / 2).select("pattern", "kind", "trust")
        sides = edges.join(good, "pattern").groupBy("instance", "kind", "side").agg(F.max("trust").alias("trust"))
        score = sides.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("trust")))))).alias("score"))
        best = score.where(F.col("score") >= CONFIDENCE).groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        fresh = storage.materialise(best.join(known.select("instance").distinct(), "instance", "left_anti").select("kind", "instance"), "pii-fresh")
        if fresh.isEmpty():
            return added
        added, known = added.union(fresh), known.unionByName(fresh)


def _candidates(matches: DataFrame) -> DataFrame:
    """Candidate occurrences (rid, start, end, instance and its contexts) that overlap no base span.

    Base spans and candidates of a text are put in order once; a candidate is free if no base span that starts before its end
    ends after its start.
    """
    lead = F.length(F.regexp_extract("match", r"^([(\[<\"']*)", 1))
    core = F.regexp_extract("match", r"^[(\[<\"']*(.*?)[.,;:!?)\]>\"']*$", 1)
    token = F.col("kind") == "token"
    shaped = matches.where(~F.col("kind").isin(*KINDS)).select("rid", F.when(token, F.col("start") + lead).otherwise(F.col("start")).alias("start"), F.when(token, core).otherwise(F.col("match")).alias("instance"), "left", "right", "before", "after")
    wanted = (F.length(_digits(F.col("instance"))) >= LEAST_DIGITS) | F.col("instance").rlike(rf"@|{_AT}")
    free = shaped.where(wanted).dropDuplicates(["rid", "start", "instance"]).withColumns({"end": F.col("start") + F.length("instance"), "base": F.lit(False)})
    base = matches.where(F.col("kind").isin(*KINDS)).select("rid", "start", F.lit(None).cast("string").alias("instance"), *(F.lit(None).cast("string").alias(c) for c in ("left", "right", "before", "after")), "end", F.lit(True).alias("base"))
    in_order = Window.partitionBy("rid").orderBy("start", F.col("base").desc())
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(in_order.rowsBetween(0, Window.unboundedFollowing))
    placed = free.unionByName(base).withColumns({"reach": reach, "following": following}).where("not base")
    return placed.where("coalesce(reach <= start, true) and coalesce(following >= end, true)").drop("base", "reach", "following")


def held_out_recall(docs: DataFrame, share: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, hidden, found): every `share`-th distinct seed is hidden from the bootstrap, which then looks for it by its contexts."""
    matches = _scan(docs, id_col, text_col)[1]
    base = matches.where(F.col("kind").isin(*KINDS))
    seeds = base.select("kind", F.col("match").alias("instance")).distinct().withColumn("hidden", F.pmod(F.xxhash64("instance"), F.lit(share)) == 0)
    added = _bootstrap(_edges(base, "match").union(_edges(_candidates(matches), "instance")), seeds.where("not hidden").drop("hidden"))
    hidden = seeds.where("hidden").join(added.withColumn("back", F.lit(1)), ["kind", "instance"], "left")
    return hidden.groupBy("kind").agg(F.count("*").alias("hidden"), F.count("back").alias("found"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (rid, doc_id, digest, base, all_spans); spans are array<struct<rank, start, end>>, sorted.

    Offsets are code points, ends exclusive; rank is the kind's place in `KINDS`. Null and empty texts have no spans; null
    and repeated ids keep their rows. `digest` is the text's xxhash64, to find a row's text again.
    """
    rows, matches = _scan(docs, id_col, text_col)
    base = matches.where(F.col("kind").isin(*KINDS))
    free = storage.materialise(_candidates(matches), "pii-candidates")
    added = _bootstrap(_edges(base, "match").union(_edges(free, "instance")), base.select("kind", F.col("match").alias("instance")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    one = lambda is_base: F.struct(rank.alias("rank"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(is_base).alias("base")).alias("s")
    # An added span that lies in another, which begins earlier or is longer, says nothing new.
    wider = Window.partitionBy("rid").orderBy("start", F.col("end").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    more = free.join(added, "instance").withColumn("cover", F.max("end").over(wider)).where("coalesce(cover < end, true)")
    each = base.select("rid", one(True)).union(more.select("rid", one(False)))
    per_row = each.groupBy("rid").agg(F.sort_array(F.collect_list("s")).alias("found"))
    joined = rows.join(per_row, "rid", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<rank:int,start:int,end:int,base:boolean>>")))
    return joined.select("rid", "doc_id", "digest", F.filter("found", lambda s: s["base"]).alias("base"), F.col("found").alias("all_spans"))


def span_text(c: str) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of a piece of text that `redact` cuts from; spans of long texts are then found without reading from the start.
PIECE = 4096


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with each span of its text replaced by `<kind>`; overlapping spans are replaced once.

    Null and empty texts stay as they are; null and repeated ids keep their rows, each with its own text; other columns, whatever
    their names, are passed on. An empty table gives no rows.
    """
    found = spans(docs, id_col, text_col).where(F.size("all_spans") > 0).groupBy("doc_id", "digest").agg(F.first("all_spans").alias("spans"))
    text, key, digest, pieces, of_id, of_digest, listed = storage.unused(docs, "text", "id", "digest", "pieces", "id2", "digest2", "spans")
    names = ", ".join(f"'<{k}>'" for k in KINDS)
    in_order = f"array_sort({listed}, (x, y) -> case when x.start < y.start or x.start = y.start and x.end > y.end then -1 when x.start = y.start and x.end = y.end then 0 else 1 end)"
    # The text from a to b, out of the pieces that hold it.
    part = lambda a, b: f"""if({a} div {PIECE} = {b} div {PIECE}, coalesce(substring(try_element_at({pieces}, cast({a} div {PIECE} + 1 as int)), cast({a} % {PIECE} + 1 as int), cast({b} - {a} as int)), ''),
      concat(substring(element_at({pieces}, cast({a} div {PIECE} + 1 as int)), cast({a} % {PIECE} + 1 as int)), array_join(slice({pieces}, cast({a} div {PIECE} + 2 as int), cast({b} div {PIECE} - {a} div {PIECE} - 1 as int)), ''),
        coalesce(substring(try_element_at({pieces}, cast({b} div {PIECE} + 1 as int)), 1, cast({b} % {PIECE} as int)), '')))"""  # noqa: E731
    rewritten = F.expr(f"""
      aggregate({in_order}, named_struct('pos', 0, 'out', cast(array() as array<string>)),
        (acc, s) -> if(s.start >= acc.pos,
          named_struct('pos', s.end, 'out', concat(acc.out, array({part("acc.pos", "s.start")}, element_at(array({names}), s.rank)))),
          named_struct('pos', greatest(acc.pos, s.end), 'out', acc.out)),
        acc -> concat(array_join(acc.out, ''), {part("acc.pos", f"length({text})")}))""")
    keyed = docs.withColumns({text: F.coalesce(F.col(text_col), F.lit("")), key: F.col(id_col)}).withColumn(digest, F.xxhash64(text))
    joined = keyed.join(found.select(F.col("doc_id").alias(of_id), F.col("digest").alias(of_digest), F.col("spans").alias(listed)), F.expr(f"{key} <=> {of_id} and {digest} = {of_digest}"), "left")
    cut = joined.withColumn(pieces, F.when(F.col(listed).isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)))
    done = cut.withColumn(text_col, F.when(F.col(listed).isNotNull(), rewritten).otherwise(F.col(text_col)))
    return done.select(*(F.col(f"`{c}`") for c in docs.columns))
