"""Exact removal of repeated 50-word passages by super-k-mer partitioning.

A window is 50 consecutive words. Each window has a minimiser, the least hash of its 6-word pieces; consecutive
windows of one document with the same minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket,
so equal windows always meet, and a word is sent about three times instead of fifty. There windows are sorted by hash
and equal hashes are compared as strings, which gives each window its least document id exactly. A second
pass over the texts looks its super-k-mers up among those with repeated windows and removes the covered words.

A phrase with a small hash that stands in very many different contexts would send all of them to one bucket. So minimisers are
first counted over all texts, and pieces whose slot is hot come last in the order of pieces: a window takes another minimiser
wherever it has one. The order is the same everywhere, so equal windows still meet, and results do not depend on it.

A passage that very many documents share gives the same packed strings everywhere: each task sends such a string once,
with the least and greatest id it has seen, so a hot passage costs one string a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import storage
from weirflow.llm import textops as tx

WINDOW = 50
PIECE = 6
BUCKET_BYTES = 1 << 20
FLUSH_BYTES = 24 << 20
SENT_STRINGS = 1 << 19
BITS = 1 << 26
#: Slots, by leading bits, in which minimisers are counted; a slot is hot with so many strings, and so many times the mean.
SLOT_BITS, HOT_STRINGS, HOT_TIMES = 16, 1 << 16, 8
U64 = np.uint64
#: Stands for a null id: later than every document.
LAST = np.iinfo(np.int64).max


def canonical(buf: np.ndarray, offsets: np.ndarray) -> tuple[bytes, tx.Words]:
    """The texts with one space between words and none at the ends."""
    w = tx.words_of(buf, offsets)
    inner = np.ones(len(w.starts), bool)
    inner[w.off[:-1][w.off[:-1] < w.off[1:]]] = False
    clean = buf.copy()
    at = w.starts[inner] - 1
    clean[at] = 32
    size = np.zeros(len(buf) + 1, np.int64)
    size[w.starts] += 1
    size[w.ends] -= 1
    keep = np.cumsum(size[:-1]) > 0
    keep[at] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    clean = clean[keep]
    return clean.tobytes(), tx.Words(clean, place[w.starts], place[w.ends], w.off)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    if n < w:
        return np.zeros(0, x.dtype)
    blocks = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def super_kmers(w: tx.Words, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, number of windows, minimiser) of each super-k-mer; pieces in the `hot` slots come last in their order."""
    h = tx.span_hashes(w.buf, w.starts, w.ends)
    acc = np.zeros(max(0, len(h) - PIECE + 1), U64)
    for i in range(PIECE):
        acc = acc * U64(0xD6E8FEB86659FD93) + h[i : i + len(acc)]
    order = tx.mix(acc)
    if hot is not None:
        order = (order >> U64(1)) | (hot[(order >> U64(64 - SLOT_BITS)).astype(np.int64)].astype(U64) << U64(63))
    least = _sliding_min(order, WINDOW - PIECE + 1)
    count = np.maximum(np.diff(w.off) - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + w.off[:-1][row]
    value = least[at]
    head = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[head], at[head], np.diff(np.append(head, len(row))), value[head]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, number of super-k-mers) of the texts."""
    count = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        for _, _, buf, offsets in tx.text_parts(batch.column(0)):
            value = super_kmers(tx.words_of(buf, offsets))[3]
            count += np.bincount((value >> U64(64 - SLOT_BITS)).astype(np.int64), minlength=len(count))
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(some, pa.int64()), "n": pa.array(count[some], pa.int64())})


def hot_slots(texts: DataFrame) -> np.ndarray | None:
    """Which slots of minimisers are hot over all texts, None if none is; at most 2**SLOT_BITS numbers come to the driver."""
    found = texts.select("text").mapInArrow(_tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(1 << SLOT_BITS, np.int64)
    count[found["slot"].to_numpy()] = found["n"].to_numpy()
    hot = count > max(HOT_STRINGS, HOT_TIMES * count.sum() >> SLOT_BITS)
    return hot if hot.any() else None


def _spans(w: tx.Words, first: np.ndarray, windows: np.ndarray) -> tuple[list[int], list[int]]:
    return w.starts[first].tolist(), w.ends[first + windows - 1 + WINDOW - 1].tolist()


_PACKED = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])


def _send(buckets: int, slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        sent: dict[bytes, int] = {}
        size, hot = 0, slots.value
        squeeze = zstandard.ZstdCompressor(level=3)

        def flush():
            by: dict[int, list] = {}
            for text, entry in held.items():
                by.setdefault(entry[0] % buckets, []).append((text, entry))
                if entry[1] < entry[2]:
                    sent[xxhash.xxh3_128_digest(text)] = entry[1]
            held.clear()
            if len(sent) > SENT_STRINGS:
                sent.clear()
            rows = []
            for b, items in by.items():
                head = np.array([[e[0], e[1], e[2], len(t)] for t, e in items], object)
                cols = [head[:, 0].astype(U64).tobytes(), *(head[:, i].astype(np.int64).tobytes() for i in (1, 2, 3))]
                rows.append({"bucket": b, "n": len(items), "blob": squeeze.compress(b"".join([*cols, *(t for t, _ in items)]))})
                if len(rows) >= 64:
                    yield pa.RecordBatch.from_pylist(rows, _PACKED)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _PACKED)

        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(LAST), np.int64)
            for a, _, buf, offsets in tx.text_parts(batch.column(1)):
                text, w = canonical(buf, offsets)
                row, first, windows, value = super_kmers(w, hot)
                for d, s, e, v in zip(ids[a + row].tolist(), *_spans(w, first, windows), value.tolist(), strict=True):
                    piece = text[s:e]
                    if (old := held.get(piece)) is not None:
                        if d < old[1]:
                            old[1] = d
                        elif d > old[2]:
                            old[2] = d
                    elif not sent or d < sent.get(xxhash.xxh3_128_digest(piece), LAST + 1):
                        held[piece] = [v, d, d]
                        size += len(piece)
                if size > FLUSH_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


_RUN = pa.schema([("k", pa.int64()), ("digest", pa.binary()), ("at", pa.int32()), ("windows", pa.int32()), ("least", pa.int64())])
_RUN_SQL = "k long, digest binary, at int, windows int, least long"


def _count_windows(texts: list[bytes], lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (text, offset, windows, least id) of the windows that several documents have."""
    flat = b"".join(texts)
    buf = np.frombuffer(flat, np.uint8)
    w = tx.words_of(buf, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    h = tx.span_hashes(buf, w.starts, w.ends)
    power, inverse = tx._power_tables(len(h) + 1)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * power[: len(h)], out=sums[1:])
    count = np.diff(w.off) - WINDOW + 1
    row = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = w.off[:-1][row] + offset
    key = tx.mix((sums[at + WINDOW] - sums[at]) * inverse[at])
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    many = np.diff(np.append(head, len(order)))
    least, most = lo[row], hi[row]
    starts, ends = w.starts, w.ends
    for a, n in zip(head[many > 1].tolist(), many[many > 1].tolist(), strict=True):
        same = order[a : a + n]
        place = at[same]
        texts_here = [flat[s:e] for s, e in zip(starts[place].tolist(), ends[place + WINDOW - 1].tolist(), strict=True)]
        if texts_here.count(texts_here[0]) == n:
            least[same], most[same] = least[same].min(), most[same].max()
        else:  # equal hashes of different windows
            by: dict[bytes, list[int]] = {}
            for t, i in zip(texts_here, same.tolist(), strict=True):
                by.setdefault(t, []).append(i)
            for group in by.values():
                least[group], most[group] = least[group].min(), most[group].max()
    mark = np.flatnonzero(least < most)
    if not len(mark):
        return mark, mark, mark, mark
    new = np.flatnonzero(np.concatenate([[True], (np.diff(mark) != 1) | (row[mark][1:] != row[mark][:-1]) | (least[mark][1:] != least[mark][:-1])]))
    return row[mark][new], offset[mark][new], np.diff(np.append(new, len(mark))), least[mark][new]


def _count(table: pa.Table) -> pa.Table:
    merged: dict[bytes, list] = {}
    for n, blob in zip(table["n"].to_pylist(), table["blob"].to_pylist(), strict=True):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        value, lo, hi, size = np.frombuffer(raw, U64, n), *(np.frombuffer(raw, np.int64, n, 8 * n * i) for i in (1, 2, 3))
        at = 32 * n
        for v, a, b, k in zip(value.tolist(), lo.tolist(), hi.tolist(), size.tolist(), strict=True):
            text = raw[at : at + k]
            at += k
            if (old := merged.get(text)) is None:
                merged[text] = [v, a, b]
            else:
                old[1], old[2] = min(old[1], a), max(old[2], b)
    texts = list(merged)
    value, lo, hi = (np.array([e[i] for e in merged.values()], t) for i, t in ((0, U64), (1, np.int64), (2, np.int64)))
    order = np.argsort(value, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    many = np.diff(np.append(head, len(order)))
    found: list[tuple[bytes, int, int, int]] = []
    for i in order[head[many == 1]]:
        if lo[i] < hi[i]:
            found.append((texts[i], 0, texts[i].count(b" ") + 2 - WINDOW, int(lo[i])))
    part: list[int] = []
    size = 0

    def close():
        pick = np.array(part)
        found.extend((texts[part[t]], o, n, d) for t, o, n, d in zip(*(x.tolist() for x in _count_windows([texts[i] for i in part], lo[pick], hi[pick])), strict=True))
        part.clear()

    for a, n in zip(head[many > 1].tolist(), many[many > 1].tolist(), strict=True):
        group = order[a : a + n].tolist()
        part += group
        size += sum(len(texts[i]) for i in group)
        if size > tx.PART_BYTES:
            close()
            size = 0
    if part:
        close()
    digests = [xxhash.xxh3_128_digest(f[0]) for f in found]
    return pa.table([pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()), pa.array(digests, pa.binary()), *(pa.array([f[i] for f in found], t) for i, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64())))], schema=_RUN)


_SEEN = "doc_id long, row long, n_words long, kept_sha256 string, text string, at array<int>, digest array<binary>"
_SEEN_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("at", pa.list_(pa.int32())), ("digest", pa.list_(pa.binary()))])


def _look_up(bitmap, slots):
    """A document without a repeated super-k-mer is done; the others keep their text and the places to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = bitmap.value, slots.value
        mask = len(bits) * 64 - 1
        bits = bits.tolist() if len(bits) < 4096 else bits
        next_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for a, b, buf, offsets in tx.text_parts(batch.column(1)):
                text, w = canonical(buf, offsets)
                row, first, windows, _ = super_kmers(w, hot)
                spans = _spans(w, first, windows)
                hits: dict[int, tuple[list[int], list[bytes]]] = {}
                for r, f, s, e in zip(row.tolist(), first.tolist(), *spans, strict=True):
                    d = xxhash.xxh3_128_digest(text[s:e])
                    slot = int.from_bytes(d[:8], "little") & mask
                    if int(bits[slot >> 6]) >> (slot & 63) & 1:
                        at, digest = hits.setdefault(r, ([], []))
                        at.append(f - int(w.off[r]))
                        digest.append(d)
                out = []
                for i in range(b - a):
                    lo, hi = int(w.off[i]), int(w.off[i + 1])
                    whole = text[w.starts[lo] : w.ends[hi - 1]] if hi > lo else b""
                    next_row += 1
                    hit = hits.get(i)
                    out.append({"doc_id": ids[a + i].as_py(), "row": next_row, "n_words": hi - lo} | ({"text": whole.decode(), "at": hit[0], "digest": hit[1]} if hit else {"kept_sha256": hashlib.sha256(whole).hexdigest()}))
                yield pa.RecordBatch.from_pylist(out, _SEEN_ARROW)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = text.split(" ") if text else []
            edge = np.zeros(len(words) + 1, np.int64)
            for s in spans or []:
                edge[s["a"]] += 1
                edge[s["b"]] -= 1
            keep = np.cumsum(edge[:-1]) == 0
            kept = " ".join(x for x, k in zip(words, keep.tolist(), strict=True) if k)
            out.append({"doc_id": doc, "n_words": len(words), "n_removed": int((~keep).sum()), "kept_text": kept, "kept_sha256": hashlib.sha256(kept.encode()).hexdigest()})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())]))


def _bitmap(runs: DataFrame) -> np.ndarray:
    """A bitmap of the digests, of bounded size: BITS bits (8 MB) at most."""
    n = runs.select("digest").distinct().count()
    bits = 1 << 12
    while bits < min(BITS, 16 * n):
        bits *= 2
    slot = F.pmod("k", F.lit(bits))
    words = (
        runs.select(F.floor(slot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.expr("1L"), F.pmod(slot, F.lit(64)).cast("int")).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(U64)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: (doc_id, n_words, n_removed, kept_sha256), and kept_text of the changed rows on demand.

    A word goes if it is covered by a window that also starts in a document with a smaller id, as the input has them. Null
    texts and texts under 50 words lose nothing; a null id counts as later than every other, and never as earlier; rows
    that share an id are not earlier than each other. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = storage.buckets_for(texts, BUCKET_BYTES)
    slots = spark.sparkContext.broadcast(hot_slots(texts))
    runs = storage.materialise(texts.mapInArrow(_send(n, slots), "bucket int, n int, blob binary").groupBy("bucket").applyInArrow(_count, _RUN_SQL), "passage-runs")
    bitmap = spark.sparkContext.broadcast(_bitmap(runs))
    seen = storage.materialise(texts.mapInArrow(_look_up(bitmap, slots), _SEEN), "passage-rows")
    places = seen.where("text is not null").select("row", "doc_id", F.explode(F.arrays_zip("at", "digest")).alias("p")).select("row", "doc_id", F.col("p.at").alias("start"), F.col("p.digest").alias("digest"))
    gone = (
        places.join(runs.drop("k"), "digest")
        .where(F.col("least") < F.coalesce("doc_id", F.lit(LAST)))
        .select("row", F.struct((F.col("start") + F.col("at")).alias("a"), (F.col("start") + F.col("at") + F.col("windows") + WINDOW - 1).alias("b")).alias("span"))
        .groupBy("row")
        .agg(F.collect_list("span").alias("spans"))
    )
    changed = seen.where("text is not null").select("doc_id", "text", "row").join(gone, "row", "left").select("doc_id", "text", "spans")
    changed = changed.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    same = seen.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept_text"), "kept_sha256")
    out = same.unionByName(changed)
    return out if with_text else out.drop("kept_text")
