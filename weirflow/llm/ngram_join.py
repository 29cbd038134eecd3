"""Exact Jaccard self-join of word-shingle sets by universe partitioning and the pigeonhole principle.

Sets x, y (|x| >= |y|) link when 100*|x&y| >= 80*|x|y|; then |y| >= 0.8|x| and their symmetric difference is at most
(|x|+|y|)/9. Sizes fall into bands of ratio 1.25, so partners are in the same or the next band, and a pair is sought
in the band of its larger set. There the hash universe is cut into m segments. If a set has more non-empty segments
than the difference can touch, one of them is equal in both sets, so equal segment hashes find the pair.

Allocation of the pigeonhole budget is by cost: a set indexes all its non-empty segments but probes only as many
as it must, taking the largest segments first, since they are the rarest; small segments (a passage many documents
share) are matched only against probes. A set whose hash leaves it too few non-empty segments goes to a
second, coarser cut where each segment also carries its one-deletion neighbourhood (budget two a segment), and if
even that is too little, to one list per band. So no pair is lost.

Groups of equal segments are not expanded into pairs. Each member is verified against the group's best connected
member, and components of the links found are built. Only members still in different components meet again, under the
parity bound: each set has a bitmap in which an element flips one bit, so the bits that differ between two bitmaps are
no more than the elements that differ between the sets. Pairs within the bound are verified, the nearest of each
set and component first, and the rest only where that left them apart. The bitmaps of a long text are full, so before texts
meet, pairs of long ones are held to the same bound on bitmaps as wide as their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import storage
from weirflow.llm import textops as tx
from weirflow.llm.graph import components, merged

SHINGLE_WORDS = 5
#: Links have 9 * |x & y| >= 4 * (|x| + |y|), that is a similarity of 0.8.
BUCKET_BYTES = 1 << 20
SEEN_SETS = 1 << 20
FLUSH = 2 << 20
U64 = np.uint64

_BANDS = [1]
while _BANDS[-1] < 1 << 40:
    _BANDS.append(_BANDS[-1] * 5 // 4 + 1)
BANDS = np.array(_BANDS, np.int64)
_TOP = BANDS[1:] - 1
#: Segments of each band: one more than the largest possible difference, and slack for empty ones.
SEGMENTS = 2 * _TOP // 9 + 1 + -(-_TOP // 50) + 2
COARSE = (_TOP // 4) // 2 + 1
PARITY_WORDS = 8
#: Members of a group that one task holds against the whole group, and pairs of one leader that share a copy of its text.
GROUP_ROWS, PAIR_ROWS = 4096, 1000
#: The widest bitmap (32 KB); sets of more elements have theirs fuller, which only rules out fewer pairs.
WIDE_BITS = 1 << 18


def parities(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of PARITY_WORDS words for each set: bit b says whether an odd number of elements hash to b."""
    out = np.zeros((len(off) - 1, PARITY_WORDS * 64), np.uint8)
    bit = (tx.mix(values ^ U64(0x3956C25BF348B538)) % U64(PARITY_WORDS * 64)).astype(np.int64)
    count = np.bincount(tx.rows_of(off) * out.shape[1] + bit, minlength=out.size)
    return np.packbits((count & 1).astype(np.uint8).reshape(out.shape), axis=1).view(np.int64)


def set_digests(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each row's set."""
    sums = []
    for salt in (0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1):
        total = np.zeros(len(values) + 1, U64)
        np.cumsum(tx.mix(values ^ U64(salt)), out=total[1:])
        sums.append(tx.mix(total[off[1:]] - total[off[:-1]] + U64(salt)))
    return sums[0], sums[1]


def _segment_hashes(values, doc, scheme_of_doc, m_of_doc, salt):
    """Non-empty segments as (document, size, signature)."""
    g = tx.mix(values ^ U64(salt))
    seg = ((g >> U64(32)) * m_of_doc[doc].astype(U64)) >> U64(32)
    key = doc.astype(np.int64) * (int(m_of_doc.max(initial=1)) + 1) + seg.astype(np.int64)
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(tx.mix(g + U64(0x632BE59BD9B4E019))[order], head) if len(head) else np.zeros(0, U64)
    size = np.diff(np.append(head, len(key)))
    owner, at = doc[order][head], seg[order][head]
    tag = scheme_of_doc[owner].astype(U64) * U64(0x9FB21C651E98DF25) + at * U64(0xD1B54A32D192ED03) + size.astype(U64)
    return owner, size, tx.mix(total + tx.mix(tag)), (order, head)


def _coarse_signatures(v: np.ndarray, scheme: int) -> np.ndarray:
    """Segments of the coarse cut with their one-deletion neighbourhoods, or the band's own list if even these may miss."""
    m = int(COARSE[scheme])
    g = tx.mix(v ^ U64(0x1F83D9ABFB41BD6B))
    seg = ((g >> U64(32)) * U64(m)) >> U64(32)
    tag = np.array([(scheme * 0x9FB21C651E98DF25 + 0x510E527FADE682D1) & 0xFFFFFFFFFFFFFFFF], U64)
    one = tx.mix(g + U64(0x632BE59BD9B4E019))
    out, useful = [], 0
    for s in np.unique(seg):
        each = one[seg == s]
        total = each.sum(dtype=U64, keepdims=True)
        n = len(each)
        useful += n >= 2
        name = tag + np.array([s]) * U64(0xD1B54A32D192ED03)
        out.append(tx.mix(np.concatenate([total + tx.mix(name + U64(n)), total - each + tx.mix(name + U64(n - 1))])))
    if useful < (len(v) // 4) // 2 + 1:
        out.append(tx.mix(tag + U64(7)))
    return np.concatenate(out)


def signatures(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, probe) for sets of four and more; smaller ones link only with equal sets."""
    size = np.diff(off)
    rows, sigs, probes = [], [], []
    band = np.searchsorted(BANDS, np.maximum(size, 1), "right") - 1
    for role in (0, 1):
        scheme = band + role
        take = (size >= 4) & (10 * size >= 8 * BANDS[scheme])
        if not take.any():
            continue
        doc_ids = np.flatnonzero(take)
        keep = np.repeat(take, size)
        v = values[keep]
        doc = np.repeat(np.arange(len(doc_ids)), size[doc_ids])
        sch, n = scheme[doc_ids], size[doc_ids]
        owner, seg_size, sig, _ = _segment_hashes(v, doc, sch, SEGMENTS[sch], 0x428A2F98D728AE22)
        have = np.bincount(owner, minlength=len(doc_ids))
        need = n // 4 + 1
        order = np.lexsort((-seg_size, owner))
        first = np.concatenate([[0], np.cumsum(have)])[:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - first[owner[order]]
        rows.append(doc_ids[owner])
        sigs.append(sig)
        probes.append(rank < need[owner])
        for d in np.flatnonzero(have < need):
            extra = _coarse_signatures(values[off[doc_ids[d]] : off[doc_ids[d] + 1]], int(sch[d]))
            rows.append(np.full(len(extra), doc_ids[d]))
            sigs.append(extra)
            probes.append(np.ones(len(extra), bool))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(sigs), np.concatenate(probes)


def text_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    low = tx.lower_ascii(buf)
    w = tx.words_of(low, offsets)
    return tx.row_sets(*tx.shingles(tx.span_hashes(low, w.starts, w.ends), w.off, SHINGLE_WORDS))


_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])


def _pack(arrays: list[np.ndarray], level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b"".join(a.tobytes() for a in arrays))


def _index_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        turn = 0

        def flush():
            if not held:
                return
            ids, sig, probe = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(sig):
                return
            bucket = (sig % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            ids, code, bucket = ids[order], (((sig >> U64(17)) << U64(1)) | probe.astype(U64))[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            out = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
                six = code[a:b].view(np.uint8).reshape(-1, 8)[:, :6]
                out.append((int(bucket[a]), 1, b - a, _pack([np.diff(ids[a:b], prepend=np.int64(0)), np.ascontiguousarray(six)])))
            yield pa.RecordBatch.from_pylist([dict(zip(_PACKED.names, r, strict=True)) for r in out], _PACKED)

        for batch in batches:
            doc_ids = batch.column(0)
            known = np.asarray(doc_ids.is_valid())
            ids = np.asarray(doc_ids.fill_null(0), np.int64)
            for a, b, buf, offsets in tx.text_parts(batch.column(1)):
                values, off = text_sets(buf, offsets)
                size = np.diff(off)
                h1, h2 = set_digests(values, off)
                turn += 1
                yield pa.RecordBatch.from_pylist([{"bucket": (turn * 7919) % buckets, "kind": 0, "n": b - a, "blob": _pack([ids[a:b], known[a:b].astype(np.int64), size.astype(np.int64), h1, h2, parities(values, off)])}], _PACKED)
                fresh = np.zeros(b - a, bool)
                for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                    if known[a + i] and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                if len(seen) > SEEN_SETS:
                    seen.clear()
                values = values[np.repeat(fresh, size)]
                rows, sig, probe = signatures(values, np.concatenate([[0], np.cumsum(size[fresh])]))
                held.append((ids[a:b][fresh][rows], sig, probe))
                if sum(len(x[1]) for x in held) >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


_GROUPED = "kind int, a long, b long, c long, d long, parity array<long>"
_GROUPED_ARROW = pa.schema([("kind", pa.int32()), *((x, pa.int64()) for x in "abcd"), ("parity", pa.list_(pa.int64()))])


def _grouped(kind: int, *cols: np.ndarray, parity: np.ndarray | None = None) -> pa.Table:
    n = len(cols[0])
    bits = pa.nulls(n, pa.list_(pa.int64())) if parity is None else pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * PARITY_WORDS, parity.ravel())
    cols = [*cols, *[np.zeros(n, np.int64)] * (4 - len(cols))]
    return pa.table([pa.array(np.full(n, kind, np.int32)), *(pa.array(c.astype(np.int64)) if not isinstance(c, pa.Array) else c for c in cols), bits], schema=_GROUPED_ARROW)


def _meet(table: pa.Table) -> pa.Table:
    """Within a bucket: unpack document rows, and list the documents of each signature that two or more have.

    Signatures with the same documents give one group.
    """
    out, ids, codes = [], [], []
    for kind, n, blob in zip(table["kind"].to_pylist(), table["n"].to_pylist(), table["blob"].to_pylist(), strict=True):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        if kind == 0:
            doc, known, size, h1, h2 = np.frombuffer(raw, np.int64, 5 * n).reshape(5, n)
            out.append(_grouped(0, pa.array(doc, mask=known == 0), size, h1, h2, parity=np.frombuffer(raw, np.int64, n * PARITY_WORDS, 40 * n)))
        else:
            ids.append(np.cumsum(np.frombuffer(raw, np.int64, n)))
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, 8 * n).reshape(n, 6)
            codes.append(wide.view(U64).ravel())
    if ids:
        doc, code = np.concatenate(ids), np.concatenate(codes)
        sig = code >> U64(1)
        order = np.argsort(sig)
        shared = np.zeros(len(sig), bool)
        same = sig[order][1:] == sig[order][:-1]
        shared[1:] |= same
        shared[:-1] |= same
        order = order[shared]
        order = order[np.lexsort((doc[order], sig[order]))]
        sig, doc, probe = sig[order], doc[order], (code[order] & U64(1)).astype(np.int64)
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])]) if len(sig) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        if len(at):
            sig, doc, probe = sig[at], doc[at], np.maximum.reduceat(probe, at)
            head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            count = np.diff(np.append(head, len(sig)))
            group = np.add.reduceat(tx.mix(doc.astype(U64) ^ U64(0x7137449123EF65CD)), head)
            asks = np.add.reduceat(probe, head)
            group = tx.mix(group)
            wanted = np.repeat((count > 1) & (asks > 0), count)
            member = np.repeat(group, count)[wanted]
            doc, probe = doc[wanted], probe[wanted]
            order = np.lexsort((doc, member))
            member, doc, probe = member[order], doc[order], probe[order]
            if len(member):
                at = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (doc[1:] != doc[:-1])]))
                out.append(_grouped(1, member[at].view(np.int64), doc[at], np.maximum.reduceat(probe, at)))
    return pa.concat_tables(out) if out else _GROUPED_ARROW.empty_table()


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, size_a, size_b, common) of pairs of texts; neighbouring rows with the same b share its set."""
    for batch in batches:
        for lo, hi, buf, offsets in tx.text_parts(batch.column(2)):
            x, xo = text_sets(buf, offsets)
            b = batch.column(1)[lo:hi].to_numpy()
            new = np.concatenate([[True], b[1:] != b[:-1]])
            heads = batch.column(3)[lo:hi].filter(pa.array(new))
            sets = [v[o[i] : o[i + 1]] for _, _, raw, at in tx.text_parts(heads) for v, o in [text_sets(raw, at)] for i in range(len(at) - 1)]
            which = np.cumsum(new) - 1
            common = []
            for i in range(hi - lo):
                both = np.concatenate([x[xo[i] : xo[i + 1]], sets[which[i]]])
                both.sort()
                common.append(int((both[1:] == both[:-1]).sum()))
            nb = np.array([len(v) for v in sets], np.int64)[which]
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(np.diff(xo)), pa.array(nb), pa.array(common, pa.int64())], names=["a", "b", "na", "nb", "common"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact overlap of each pair (a, b) of document ids; `texts` is (doc_id, text).

    A `b` of very many pairs, the leader of a large group, has its text copied for every `PAIR_ROWS` of them, so that no task has them
    all. `pairs` is read more than once.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    some = storage.keep_possible(texts.where("doc_id is not null"), "doc_id", ids, "id")
    sizes = pairs.groupBy("b").agg(F.count("*").alias("size")).withColumn("salts", F.floor(F.col("size") / PAIR_ROWS).cast("int") + 1)
    salted = storage.with_class(pairs, sizes, ["b"], "size").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).select("a", "b", "salt")
    copied = some.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).join(sizes.select("b", "salts"), "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    joined = salted.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(copied, ["b", "salt"])
    return joined.select("a", "b", "ta", "tb").mapInArrow(_overlaps, "a long, b long, na long, nb long, common long")


def _differ():
    """Bits in which the bitmaps p0.. and p0_.. differ."""
    return sum(F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"p{i}_"))) for i in range(PARITY_WORDS))


def _within():
    """Whether sizes and bitmaps allow a link."""
    return F.expr("10 * least(n, n_) >= 8 * greatest(n, n_)") & (9 * _differ() <= F.col("n") + F.col("n_"))


def _possible(pairs: DataFrame, node: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow; a `b` of very many pairs comes to them by broadcast."""
    other = node.select(*(F.col(c).alias(f"{c}_") for c in node.columns))
    leaders = pairs.groupBy("b").agg(F.count("*").alias("size")).join(other, F.col("b") == F.col("node_"))
    members = pairs.join(node, pairs["a"] == node["node"])
    return storage.with_class(members, leaders, ["b"], "size").where(_within()).select("a", "b")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among `pairs`, a materialised table."""
    return storage.materialise(verify(pairs, texts).where("9 * common >= 4 * (na + nb)").select("a", "b"), "ngram-links")


def _wide_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, size, bits) of each text: bit b says whether an odd number of elements hash to b; as many bits as elements, rounded up to 2**k."""
    for batch in batches:
        for lo, hi, buf, offsets in tx.text_parts(batch.column(1)):
            values, off = text_sets(buf, offsets)
            h = tx.mix(values ^ U64(0x59F111F1B605D019))
            bits = []
            for i, n in enumerate(np.diff(off).tolist()):
                wide = min(WIDE_BITS, 1 << max(9, (n - 1).bit_length()))
                count = np.bincount((h[off[i] : off[i + 1]] & U64(wide - 1)).astype(np.int64), minlength=wide)
                bits.append(np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(off), pa.int64()), pa.array(bits, pa.binary())], names=["id", "size", "bits"])


def _far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that differ, by their wide bitmaps, in more elements than a link allows."""
    for batch in batches:
        far = []
        for n, x, y in zip(pc.add(batch.column(2), batch.column(4)).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            # Half of the bits, folded onto the other half, are the bitmap of half the width.
            while len(x) != len(y):
                x, y = (x, y) if len(x) > len(y) else (y, x)
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            far.append(9 * int(np.bitwise_count(x ^ y).sum()) > n)
        yield batch.select([0, 1]).filter(pa.array(far, pa.bool_()))


def narrowed(pairs: DataFrame, node: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of `pairs`, a materialised table, without those (a, b) of long texts that wide bitmaps show to be no link.

    Only sets of more elements than the narrow bitmaps have bits get wide ones, made from their texts, which are not sent for it.
    Ids of several rows have none, and their pairs stay.
    """
    long = node.where(F.col("n") > PARITY_WORDS * 64).select(F.col("node").alias("id"))
    ids = storage.materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(long, "id"), "ngram-long")
    if ids.isEmpty():
        return pairs
    some = storage.keep_possible(texts.where("doc_id is not null"), "doc_id", ids, "id")
    one = some.mapInArrow(_wide_rows, "id long, size long, bits binary").groupBy("id").agg(F.count("*").alias("rows"), F.first("size").alias("size"), F.first("bits").alias("bits"))
    wide = storage.materialise(one.where("rows = 1").drop("rows"), "ngram-wide")
    both = pairs.select("a", "b").join(wide.toDF("a", "na", "xa"), "a").join(wide.toDF("b", "nb", "xb"), "b").select("a", "b", "na", "xa", "nb", "xb")
    far = storage.materialise(both.mapInArrow(_far, "a long, b long").distinct(), "ngram-far")
    return storage.materialise(pairs.join(far, ["a", "b"], "left_anti").select(*pairs.columns), "ngram-narrowed")


def _more(labels: DataFrame, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """`labels` with the links among `pairs`, a materialised table."""
    links = _linked(pairs, texts)
    return labels if links.isEmpty() else merged(labels, links, "a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, n_shingles, component_id).

    Null texts and texts without words have no shingles and are their own component. Rows with a null id link through
    equal sets only, and a class of null ids alone has a null component. Rows that share an id are one node. Other
    columns of `docs`, whatever their names, are not read. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = storage.buckets_for(texts, BUCKET_BYTES)
    packed = texts.mapInArrow(_index_rows(n), "bucket int, kind int, n int, blob binary")
    met = storage.materialise(packed.groupBy("bucket").applyInArrow(_meet, _GROUPED), "ngram-groups")
    rows = met.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("h1"), F.col("d").alias("h2"), "parity")
    full, same = rows.where("n_shingles > 0"), ["h1", "h2", "n_shingles"]
    least = storage.materialise(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "ngram-copies")
    # Sets without a copy, and empty ones, which link with nothing, stand for themselves.
    known = storage.with_class(full, least, same, "copies").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), "parity")
    rows = storage.materialise(known.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"), "parity")), "ngram-rows")
    node = rows.where("doc_id = rep").groupBy(F.col("rep").alias("node")).agg(F.max_by(F.struct("n_shingles", "parity"), "n_shingles").alias("s"))
    node = node.select("node", F.col("s.n_shingles").alias("n"), *(F.col("s.parity")[i].alias(f"p{i}") for i in range(PARITY_WORDS)))
    members = (
        met.where("kind = 1")
        .groupBy(F.col("a").alias("g"), F.col("b").alias("doc_id"))
        .agg(F.max("c").alias("probe"))
        .join(rows.where("doc_id is not null").select("doc_id", F.col("rep").alias("node")).distinct(), "doc_id")
        .groupBy("g", "node")
        .agg(F.max("probe").alias("probe"))
    )
    degree = members.groupBy("node").agg(F.count("*").alias("degree"))
    leaders = members.join(degree, "node").groupBy("g").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("leader"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("g", "leader")
    members = storage.materialise(members.join(leaders, "g"), "ngram-members")
    stars = _possible(storage.materialise(members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "ngram-spokes"), node)
    links = _linked(narrowed(storage.materialise(stars, "ngram-pairs"), node, texts), texts)
    labels = components(links, "a", "b")
    open_ = members.join(labels, "node", "left").select("g", "node", "probe", F.coalesce("component", "node").alias("c"))
    split = open_.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g")
    open_ = open_.join(split, "g").join(node, "node")
    # A group's members are compared block by block, each block in a task of its own: a segment that very many unlike sets share is
    # no single task's work, and only pairs within the bounds leave it.
    size = open_.groupBy("g").agg(F.count("*").alias("size")).select("g", F.ceil(F.col("size") / GROUP_ROWS).cast("int").alias("blocks"))
    open_ = open_.join(size, "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = open_.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(f"{c}_") for c in open_.columns if c not in ("g", "block", "blocks")))
    rest = open_.join(other, ["g", "block"]).where(F.expr("node > node_ and c <> c_ and probe + probe_ > 0") & _within()).select(F.col("node").alias("a"), F.col("node_").alias("b"), "c", "c_", _differ().alias("differ")).distinct()
    rest = narrowed(storage.materialise(rest, "ngram-rest"), node, texts)
    sides = rest.select("a", "b", "differ", F.col("a").alias("x"), F.col("c_").alias("to")).union(rest.select("a", "b", "differ", "b", "c"))
    near = storage.materialise(sides.groupBy("x", "to").agg(F.min_by(F.struct("a", "b"), F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "ngram-near")
    if not near.isEmpty():
        labels = _more(labels, near, texts)
        name = labels.select(F.col("node").alias("a"), F.col("component").alias("x"))
        left = rest.select("a", "b").join(near, ["a", "b"], "left_anti").join(name, "a", "left").join(name.select(F.col("a").alias("b"), F.col("x").alias("y")), "b", "left")
        left = storage.materialise(left.where("coalesce(x, a) <> coalesce(y, b)").select("a", "b"), "ngram-left")
        if not left.isEmpty():
            labels = _more(labels, left, texts)
    return rows.join(labels, rows["rep"] == labels["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
