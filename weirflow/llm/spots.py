"""SpotSigs document fingerprints.

A spot signature is an anchor, a common word, with the next `CHAIN` content words after it; a text's fingerprint is the set of
its signatures, written as sorted 32-bit hashes in base 64. Texts without a full chain have one signature of all their words.
Fingerprints are compared by Jaccard similarity, pruned by set length: sets whose length partitions are too far apart for
the asked similarity are not read, and a comparison stops when what is left cannot reach it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm import storage
from weirflow.llm import textops as tx
from weirflow.llm.graph import components

CHAIN = 2
#: Rows a range bucket should hold, and the bound of the number of buckets (their first ids are broadcast).
BUCKET_ROWS = 2000
MOST_BUCKETS = 1 << 16
U64 = np.uint64

# Anchors, and further common words that are not content words.
ANCHORS = "a an and are as at be by das de der des die du ein eine el en es est et for in ist it la las le les los of on que that the to un una und une was y".split()
COMMON = "als au auf aus avec aux but ce con dans dem den elle er from had has have he her his hem il im is las mit nicht no not o or par pas por pour qui se she si sich sie so su sur they this von war wie with zu zum".split()


def _table(words: list[str]) -> np.ndarray:
    return np.sort(np.array([tx.hash_word(w) for w in words], U64))


_ANCHOR, _STOP = _table(ANCHORS), _table([*ANCHORS, *COMMON])


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def spot_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit signatures of each text, and offsets."""
    w = tx.normal(buf, offsets)
    h = tx.span_hashes(w.buf, w.starts, w.ends)
    content = np.flatnonzero(~_among(h, _STOP)) if len(h) else np.zeros(0, np.int64)
    anchor = np.flatnonzero(_among(h, _ANCHOR)) if len(h) else np.zeros(0, np.int64)
    first = np.searchsorted(content, anchor)
    row = np.searchsorted(w.off, anchor, "right") - 1
    fits = first + CHAIN <= len(content)
    fits[fits] = content[first[fits] + CHAIN - 1] < w.off[row[fits] + 1]
    anchor, first, row = anchor[fits], first[fits], row[fits]
    sig = h[anchor]
    for k in range(CHAIN):
        sig = sig * U64(0x9E3779B97F4A7C15) + h[content[first + k]]
    off = np.searchsorted(row, np.arange(len(offsets)))
    sig = (tx.mix(sig) >> U64(32)).astype(U64)
    if (off[1:] == off[:-1]).any():
        whole, at = tx.shingles(h, w.off, 1)
        rows = [sig[off[i] : off[i + 1]] if off[i + 1] > off[i] else _whole(whole[at[i] : at[i + 1]]) for i in range(len(offsets) - 1)]
        sig, off = np.concatenate([*rows, np.zeros(0, U64)]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return tx.row_sets(sig, off)


def _whole(h: np.ndarray) -> np.ndarray:
    digest = hashlib.blake2b(h.tobytes(), digest_size=4).digest()
    return np.frombuffer(digest, "<u4").astype(U64)


def fingerprint(values: np.ndarray) -> str:
    return base64.b64encode(values.astype("<u4").tobytes()).decode()


def read_fingerprint(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4").astype(U64)


def length_partition(n: int, least: float) -> int:
    """Sets that are `least` similar lie in the same or neighbouring partitions."""
    return 0 if n <= 1 or least <= 0 else int(np.log(n) / -np.log(min(least, 0.999)))


def pruned_jaccard(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of sorted sets, or 0 where it is under `least`; two empty sets are equal."""
    small, large = sorted((len(x), len(y)))
    if large == 0:
        return 1.0
    if small < least * large or abs(length_partition(small, least) - length_partition(large, least)) > 1:
        return 0.0
    common, step = 0, 4096
    for at in range(0, len(x), step):
        part = x[at : at + step]
        other = y[np.searchsorted(y, part[0]) : np.searchsorted(y, part[-1], "right")]
        both = np.concatenate([part, other])
        both.sort()
        common += int((both[1:] == both[:-1]).sum())
        most = common + min(len(x) - at - len(part), len(y) - int(np.searchsorted(y, part[-1], "right")))
        if most < least * (small + large - most):
            return 0.0
    out = common / (small + large - common)
    return out if out >= least else 0.0


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _sets(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, _, buf, offsets in tx.text_parts(pa.array(texts, pa.large_string())):
        v, o = spot_sets(buf, offsets)
        out += [v[o[i] : o[i + 1]] for i in range(len(o) - 1)]
    return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (bucket, copy, doc_id); each is compared with the next row of its bucket."""
    held: tuple | None = None
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            part = whole.slice(at, 500)
            rows = list(zip(*(part.column(i).to_pylist() for i in range(4)), strict=True))
            rows = [held, *rows] if held is not None else rows
            held = rows[-1]
            texts = [r[3] for r in rows]
            here = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
            edited = []
            for i in here:
                t, half = texts[i], len(texts[i]) // 2
                edited.append(t[: len(t) - half] + texts[i + 1][:half])
            own, other = _sets(texts), _sets(edited)
            out = []
            for i, text, e in zip(here, edited, other, strict=True):
                out.append((rows[i][2], len(texts[i]), hashlib.sha256(text.encode()).hexdigest(), fingerprint(own[i]), fingerprint(e), pruned_jaccard(own[i], e), pruned_jaccard(own[i], own[i + 1])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT_ARROW.types, strict=True)] if out else [pa.array([], t) for t in _OUT_ARROW.types], schema=_OUT_ARROW)


def compare_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses; one row per row of `docs`.

    The next document is the next in order of (id, text), null ids last; after the last comes the first. Null texts are empty.
    Ids are dealt into ranges of about equal numbers of rows: cells of equal width, each cut again between its own least and
    greatest id by its count, so that an id far from the others costs a cell and no more. The first row of a range is copied to the
    end of the range before it, so each row meets its next one in its own range and texts move once. Rows are walked in sorted
    order, so a range need not fit in memory. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = (0, 0) if low is None else (low, high)
    cells = min(MOST_BUCKETS, max(1, n // BUCKET_ROWS))
    width = (high - low) // cells + 1
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    rows = rows.withColumn("cell", F.coalesce(F.floor((wide("doc_id") - low) / width).cast("int"), F.lit(cells)))
    # At most MOST_BUCKETS + 1 cells and twice as many ranges, of a few numbers each: a proven bound for one task and the broadcasts.
    cut = rows.groupBy("cell").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.greatest(F.lit(1), F.floor(F.count("*") / max(BUCKET_ROWS, n // MOST_BUCKETS))).alias("k"))
    cut = cut.select("cell", "lo", (wide("hi") - wide("lo") + 1).alias("span"), "k", (F.sum("k").over(Window.orderBy("cell")) - F.col("k")).alias("start"))
    inside = F.floor((wide("doc_id") - wide("lo")) * F.col("k") / F.col("span")).cast("int")
    rows = rows.join(F.broadcast(cut), "cell").withColumn("bucket", (F.col("start") + F.coalesce(inside, F.lit(0))).cast("int")).select("doc_id", "text", "bucket")
    firsts = rows.groupBy("bucket").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("bucket")
    firsts = firsts.withColumn("before", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())))
    rows = rows.join(F.broadcast(firsts.withColumnRenamed("bucket", "b")), F.col("bucket") == F.col("b"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("copy"))
    places = F.when(F.expr("doc_id <=> first"), F.array(own, copy)).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("p")).select("p.bucket", "p.copy", "doc_id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "copy", F.col("doc_id").asc_nulls_last(), "text").mapInArrow(_walk, _OUT)


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in tx.text_parts(batch.column(1)):
            v, o = spot_sets(buf, offsets)
            sets = pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], sets], names=["doc_id", "sigs"])


def _near(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            sims = [pruned_jaccard(np.array(x, U64), np.array(y, U64), least) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    return run


def near_duplicate_classes(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, n_signatures, class_id), the smallest id reachable by fingerprints `least` similar.

    Equal fingerprints are one node. Nodes are indexed in their length partition and the next by the rarest signatures of their
    set, as many as two similar sets must share one of; a list's members are compared with its smallest member first, and
    only those still in different classes with each other. Rows of a null id are their own class, null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_print_rows, "doc_id long, sigs array<long>")
    rows = storage.materialise(rows.withColumn("h", F.sha2(F.array_join("sigs", ","), 256)), "spots")
    rep = rows.groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("sigs").alias("sigs"))
    node = storage.materialise(rep.where("rep is not null").select(F.col("rep").alias("node"), "sigs", F.size("sigs").alias("n")), "spot-nodes")
    each = node.select("node", "n", F.explode("sigs").alias("sig"))
    ranked = each.join(each.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "sig"))
    prefix = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
    part = F.when(F.col("n") <= 1, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / -float(np.log(min(least, 0.999))))).cast("int")
    lists = prefix.withColumn("part", F.explode(F.array(part, part + 1)))
    leaders = lists.groupBy("part", "sig").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").drop("last")
    lists = storage.materialise(lists.join(leaders, ["part", "sig"]).select("part", "sig", "node", "n", "leader"), "spot-lists")
    sets = lambda name: node.select(F.col("node").alias(name), F.col("sigs").alias(f"s{name}"))

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", "sa", "sb")
        return both.mapInArrow(_near(least), "a long, b long, sim double").where(F.col("sim") >= least).select("a", "b")

    links = storage.materialise(linked(lists.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()), "spot-links")
    named = components(links, "a", "b")
    now = lists.join(named, "node", "left").select("part", "sig", "node", "n", F.coalesce("component", "node").alias("c"))
    open_ = now.join(now.groupBy("part", "sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("part", "sig"), ["part", "sig"])
    other = open_.select("part", "sig", F.col("node").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"))
    rest = open_.join(other, ["part", "sig"]).where((F.col("node") > F.col("b")) & (F.col("c") != F.col("d")) & (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m"))).select(F.col("node").alias("a"), "b").distinct()
    more = storage.materialise(linked(rest), "spot-links")
    named = components(links.union(more), "a", "b")
    out = rows.join(rep.select("h", "rep"), "h").join(named, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.size("sigs").cast("long").alias("n_signatures"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("class_id"))
