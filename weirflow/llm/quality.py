"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Tokens are runs of letters and digits, or of other printing characters, so that shouting, symbol noise and table bars are
words of their own; each text's features are its token and token-pair frequencies in 2**18 hashed slots. The model
learns from a sample of labelled rows of bounded size (`TRAIN_ROWS`), drawn by hash over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm import textops as tx

SLOTS = 1 << 18
#: Bound of the training sample.
TRAIN_ROWS = 8000
EPOCHS = 4
SCALE = 16.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
_CLASS = np.full(256, 1, np.uint8)
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 2
_CLASS[:33] = _CLASS[127] = 0


def token_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row offsets of the tokens."""
    kind = _CLASS[buf]
    new = np.ones(len(kind) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets] = True
    edge = np.flatnonzero(new)
    if len(edge) and edge[-1] != len(kind):
        edge = np.append(edge, len(kind))
    starts, ends = edge[:-1], edge[1:]
    full = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(starts, offsets)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and row offsets."""
    starts, ends, off = token_spans(buf, offsets)
    return tx.span_hashes(buf, starts, ends), off


def slots(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots, tokens and then pairs interleaved, and row offsets."""
    h, off = tokens(buf, offsets)
    pair = tx.mix(h * tx.U64(0x9E3779B97F4A7C15) + np.append(h[1:], tx.U64(0)))
    row = tx.rows_of(off)
    # A token right after itself, or every other, is one n-gram class whatever the token: repetition is what it shows.
    for lag, mark in ((2, 0xA0761D6478BD642F), (1, 0xE7037ED1A0B428DB)):
        pair[:-lag][(h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag])] = mark
    last = off[1:][off[1:] > off[:-1]] - 1
    pair[last] = h[last] ^ tx.U64(0x5851F42D4C957F2D)
    both = np.empty(2 * len(h), np.int64)
    both[0::2] = (h % tx.U64(SLOTS)).astype(np.int64)
    both[1::2] = (pair % tx.U64(SLOTS)).astype(np.int64)
    return both, 2 * off


def train(examples: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights, the bias last, from (label, slots, values)."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            y, at, x = examples[i]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(SLOTS + 1))


def example(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(slot, return_counts=True)
    return np.append(at, SLOTS), np.append(SCALE * count / max(1, len(slot)), 1.0)


def score(weights: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    slot, off = slots(buf, offsets)
    size = np.diff(off)
    total = np.zeros(len(size))
    full = np.flatnonzero(size)
    # Each text is summed by itself, so that its score does not depend on its neighbours, not even by a rounding.
    total[full] = np.add.reduceat(weights[slot], off[:-1][full]) if len(full) else 0.0
    margin = SCALE * total / np.maximum(size, 1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the trained weights, from all (label, text) rows of the sample, whatever their order."""
    found = []
    for batch in batches:
        label = batch.column(0).to_pylist()
        for a, b, buf, offsets in tx.text_parts(batch.column(1)):
            slot, off = slots(buf, offsets)
            for i in range(b - a):
                at, x = example(slot[off[i] : off[i + 1]])
                found.append((at.astype(np.int32), x, label[a + i]))
    found.sort(key=lambda e: (e[0].tobytes(), e[1].tobytes(), e[2]))
    weights = train([(y, at, x) for at, x, y in found])
    yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.tobytes()], pa.binary())})


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, allowed, rows: int, salt: int = 0) -> DataFrame:
    """(doc_id, label, text) of at most `rows` labelled documents, the first in order of a hash of the id.

    Null ids and labels are left out; a document with contradicting labels takes the greater, and of several texts of one id
    the least counts.
    """
    some = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & allowed)
        .groupBy("doc_id")
        .agg(F.max(F.col(column).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id")
        .limit(rows)
    )
    # At most `rows` pairs of numbers: a proven bound for the broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, allowed=None, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights; without a labelled row all are zero and every score is a half.

    The sample, of at most `rows` rows, is trained on in one executor task, and only the weights come to the driver.
    """
    allowed = F.lit(True) if allowed is None else allowed
    sample = labelled_sample(docs, labels, "quality", allowed, rows).select("label", "text")
    found = sample.coalesce(1).mapInArrow(_train_rows, "weights binary").first()
    return np.zeros(SLOTS + 1) if found is None else np.frombuffer(found[0])


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """`docs` with `quality_score`, in place of a column of that name; null and empty texts score the bias alone."""
    docs = docs.drop("quality_score")
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value.astype(np.float64)
        for batch in batches:
            parts = [score(w, buf, offsets) for _, _, buf, offsets in tx.text_parts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(run, schema)


def kept(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """The rows of `docs` that score `least` or more, with all their columns; null and empty texts score the bias alone."""
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value.astype(np.float64)
        for batch in batches:
            parts = [score(w, buf, offsets) for _, _, buf, offsets in tx.text_parts(batch.column("text"))]
            yield batch.filter(pa.array((np.concatenate(parts) if parts else np.zeros(0)) >= least))

    return docs.mapInArrow(run, docs.schema)
