"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are the lower-cased tokens of the training sample, all of them; those that tell its labels apart (a chi-square test) weigh
`TELLING` times as much, because a few telling words drown in whole-text vectors. Document frequencies are counted over
all documents. Labelled examples go into an inverted index: the posting lists of rare terms are summed whole, those of common terms
are cut into blocks of examples with the greatest weight of each block. A text visits blocks in order of their upper bounds and
stops at the first that cannot reach its k-th best, which loses nothing. Neighbours vote with the square of their cosine, and a
logistic curve fitted on labelled rows outside the index turns the vote into a calibrated score; the neighbours are the
evidence. The sample has `TRAIN_ROWS` rows at most, so the model's size follows their texts, not the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm import textops as tx
from weirflow.llm.quality import labelled_sample, token_spans

#: Bounds of the training sample, of its part in the index, and of the terms that weigh more.
TRAIN_ROWS = 6000
INDEX_SHARE = 0.75
TERMS = 1024
LEAST_CHI2 = 18.0
TELLING = 8.0
#: Terms in more than one of so many examples are common.
COMMON = 4
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
NEIGHBOURS = 15
BLOCK = 64
#: Blocks visited first; each next visit takes twice as many.
VISIT = 6
PRIOR_WEIGHT = 0.5
U64 = np.uint64


def _lowered(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased tokens, and row offsets."""
    low = tx.lower_ascii(buf)
    starts, ends, off = token_spans(low, offsets)
    return tx.span_hashes(low, starts, ends), off


def choose_terms(sets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """The hashes of the terms most unevenly dealt between the labels, sorted.

    Hashed counters find the few slots worth a look first, so that memory does not follow the vocabulary.
    """
    n, pos = len(label), int(label.sum())
    if not n or pos in (0, n):
        return np.zeros(0, U64)

    def chi2(a, df):
        b, c, d = df - a, pos - a, n - pos - df + a
        x = n * (a * d - b * c) ** 2 / np.maximum(1e-9, (a + b) * (c + d) * (a + c) * (b + d))
        return np.where((df >= 3) & (a * d > b * c), x, 0.0)

    counts = np.zeros((2, SLOTS), np.int32)
    for s, y in zip(sets, label, strict=True):
        np.add.at(counts[int(y)], (s >> U64(64 - SLOT_BITS)).astype(np.int64), 1)
    some = np.flatnonzero(counts.sum(axis=0) >= 3)
    some = some[chi2(counts[1][some].astype(float), counts.sum(axis=0)[some].astype(float)) >= LEAST_CHI2 / 2]
    wanted = np.zeros(SLOTS, bool)
    wanted[some] = True
    picked = [s[wanted[(s >> U64(64 - SLOT_BITS)).astype(np.int64)]] for s in sets]
    term, at = np.unique(np.concatenate(picked), return_inverse=True)
    df = np.bincount(at, minlength=len(term)).astype(float)
    x = chi2(np.bincount(at, weights=np.repeat(label, [len(s) for s in picked]), minlength=len(term)), df)
    good = np.flatnonzero(x >= LEAST_CHI2)
    good = good[np.lexsort((term[good], -x[good]))][:TERMS]
    return np.sort(term[good])


class Terms:
    """Sorted hashes of terms, with a table by their leading bits where each search begins."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(1, min(SLOT_BITS, int(np.ceil(np.log2(len(hashes) + 1)))))
        self.first = np.searchsorted(hashes, np.arange(1 << self.bits, dtype=U64) << U64(64 - self.bits)).astype(np.int32)
        ends = np.append(self.first[1:], len(hashes))
        self.steps = int((ends - self.first).max(initial=0))

    def matches(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of `h` that hold terms, and which."""
        n = len(self.hashes)
        if not n or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self.first[(h >> U64(64 - self.bits)).astype(np.int64)]
        open_ = np.arange(len(h))
        for _ in range(self.steps):
            here = at[open_]
            open_ = open_[(here < n) & (self.hashes[np.minimum(here, n - 1)] < h[open_])]
            if not len(open_):
                break
            at[open_] += 1
        hit = np.flatnonzero((at < n) & (self.hashes[np.minimum(at, n - 1)] == h))
        return hit, at[hit].astype(np.int64)


def unit(t: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(tf)) * weight[t]
    norm = np.sqrt(w @ w)
    return t, (w / norm if norm > 0 else w)


def vectors(h: np.ndarray, off: np.ndarray, terms: Terms, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(term numbers, unit-length weights) of each row."""
    place, found = terms.matches(h)
    many = len(weight) + 1
    key, tf = np.unique((np.searchsorted(off, place, "right") - 1) * many + found, return_counts=True)
    cut = np.searchsorted(key, np.arange(len(off)) * many)
    found = key % many
    w = (1 + np.log(tf)) * weight[found]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        part = w[a:b]
        norm = np.sqrt(part @ part)
        yield found[a:b], (part / norm if norm > 0 else part)


class Index:
    """Block-max inverted index of example vectors."""

    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], terms: int):
        examples = sorted((e for e in examples if len(e[2])), key=lambda e: (e[2].tolist(), e[3].tolist(), e[0]))
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.label = np.array([e[1] for e in examples], float)
        n = len(examples)
        self.blocks = -(-n // BLOCK)
        owner = np.repeat(np.arange(n), [len(e[2]) for e in examples]).astype(np.int64)
        term = np.concatenate([*(e[2] for e in examples), np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([*(e[3] for e in examples), np.zeros(0)])
        many = np.bincount(term, minlength=terms)
        common = many > n / COMMON
        #: Where a common term is in `lists`, else -1.
        self.common = np.where(common, np.cumsum(common) - 1, -1)
        #: Posting lists of common terms by term and block; the examples are bounded, so lists are kept with their zeros.
        self.lists = np.zeros((int(common.sum()), self.blocks, BLOCK), np.float32)
        here = common[term]
        at = self.common[term[here]], owner[here] // BLOCK
        self.lists[*at, owner[here] % BLOCK] = weight[here]
        self.greatest = np.zeros(self.lists.shape[:2])
        np.maximum.at(self.greatest, at, weight[here])
        #: Posting lists of the other terms, one after another.
        order = np.flatnonzero(~here)[np.argsort(term[~here], kind="stable")]
        self.owner, self.weight = owner[order].astype(np.int32), weight[order].astype(np.float32)
        self.first = np.concatenate([[0], np.cumsum(np.where(common, 0, many))]).astype(np.int64)

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest with a common term; ties go to the example first in the index."""
        if not len(t) or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        dense = self.common[t] >= 0
        rare, wr, t, w = t[~dense], w[~dense], self.common[t[dense]], w[dense]
        many = self.first[rare + 1] - self.first[rare]
        post = np.arange(many.sum()) + np.repeat(self.first[rare] - np.cumsum(many) + many, many)
        sums = np.bincount(self.owner[post], np.repeat(wr, many) * self.weight[post], self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        bound = sums.max(axis=1) + w @ self.greatest[t]
        order = np.argsort(-bound, kind="stable")
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        s, visit = 0, VISIT
        while s < self.blocks:
            some = order[s : s + visit]
            s, visit = s + visit, 2 * visit
            some = some[bound[some] > (best[-1] - 1e-6 if len(best) == k else 0)]
            if not len(some):
                break
            sims = sums[some] + np.tensordot(w, self.lists[t[:, None], some].astype(float), 1)
            b, j = np.nonzero(sims > 0)
            best_at, best = np.append(best_at, some[b] * BLOCK + j), np.append(best, sims[b, j])
            top = np.lexsort((best_at, -np.round(best, 6)))[:k]
            best_at, best = best_at[top], best[top]
        return best_at, best

    def vote(self, at: np.ndarray, sim: np.ndarray, prior: float) -> float:
        w = sim * sim
        return float((w @ self.label[at] + PRIOR_WEIGHT * prior) / (w.sum() + PRIOR_WEIGHT))


def calibrate(vote: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a logistic curve on the votes, by regularised Newton steps."""
    if not len(label) or label.min() == label.max():
        return 4.0, -2.0
    theta = np.array([4.0, -2.0])
    x = np.stack([vote, np.ones(len(vote))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - label) + 0.05 * theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), grad)
        theta -= np.clip(step, -2, 2)
    return max(0.0, float(theta[0])), float(theta[1])


class Model:
    def __init__(self, terms, weight, index, prior, curve):
        self.terms, self.weight, self.index, self.prior, self.curve = terms, weight, index, prior, curve
        self.lookup = Terms(terms)
        self._known: dict[bytes, tuple[float, str]] = {}

    def rate(self, t: np.ndarray, w: np.ndarray) -> tuple[float, str]:
        """Calibrated score and the evidence, `id:cosine:label` of the neighbours."""
        key = hashlib.blake2b(t.astype(np.int32).tobytes() + w.tobytes(), digest_size=16).digest()
        if (old := self._known.get(key)) is None:
            at, sim = self.index.nearest(t, w)
            p = 1 / (1 + np.exp(-(self.curve[0] * self.index.vote(at, sim, self.prior) + self.curve[1])))
            old = float(p), ",".join(f"{i}:{s:.4f}:{int(y)}" for i, s, y in zip(self.index.ids[at].tolist(), sim.tolist(), self.index.label[at].tolist(), strict=True))
            if len(self._known) > 50_000:
                self._known.clear()
            self._known[key] = old
        return old


def build(ids: list[int], label: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, weight: np.ndarray) -> Model:
    """`bags` are the terms and their counts of each labelled text."""
    vecs = [unit(np.searchsorted(terms, v), n, weight) for v, n in bags]
    cut = int(len(bags) * INDEX_SHARE)
    index = Index([(ids[i], int(label[i]), *vecs[i]) for i in range(cut)], len(terms))
    prior = float(label[:cut].mean()) if cut else 0.5
    votes = np.array([index.vote(*index.nearest(*v), prior) for v in vecs[cut:]])
    return Model(terms, weight, index, prior, calibrate(votes, label[cut:]))


def _packed(h: np.ndarray) -> bytes:
    values, count = np.unique(h, return_counts=True)
    return values.tobytes() + np.minimum(count, 65535).astype(np.uint16).tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 10
    return np.frombuffer(raw, U64, n), np.frombuffer(raw, np.uint16, n, 8 * n)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in tx.text_parts(batch.column(2)):
            h, off = _lowered(buf, offsets)
            blobs = [_packed(h[off[i] : off[i + 1]]) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(blobs, pa.binary())], names=["doc_id", "label", "h"])


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Terms(shared.value)
        df, n = np.zeros(len(wanted.hashes), np.int64), 0
        for batch in batches:
            for a, b, buf, offsets in tx.text_parts(batch.column(0)):
                h, off = _lowered(buf, offsets)
                n += b - a
                if len(df):
                    hit, at = wanted.matches(h)
                    pairs = np.unique((np.searchsorted(off, hit, "right") - 1) * len(df) + at)
                    np.add.at(df, pairs % len(df), 1)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.append(-1, some), "n": np.append(n, df[some])})

    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[counted["term"].to_numpy() + 1] = counted["n"].to_numpy()
    return out[1:], int(out[0])


def fit(docs: DataFrame, labels: DataFrame, allowed=None, rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most `rows` labelled documents; without labels every text scores the same."""
    allowed = F.lit(True) if allowed is None else allowed
    found = labelled_sample(docs, labels, "toxic", allowed, rows, salt=6).mapInArrow(_token_rows, "doc_id long, label int, h binary").toArrow()
    rows_in = sorted(zip(found["doc_id"].to_pylist(), found["label"].to_pylist(), found["h"].to_pylist(), strict=True), key=lambda r: tx.mix(np.array([r[0]], np.int64).view(U64))[0])
    del found
    bags = [_unpacked(r[2]) for r in rows_in]
    label = np.array([r[1] for r in rows_in], float)
    telling = choose_terms([b[0] for b in bags], label)
    terms = np.unique(np.concatenate([np.zeros(0, U64), *(b[0] for b in bags)]))
    df, n = document_frequencies(docs, terms)
    weight = (np.log((n + 1) / (df + 1)) + 1) * np.where(np.isin(terms, telling), TELLING, 1.0)
    return build([r[0] for r in rows_in], label, bags, terms, weight)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `toxic_score` and `toxic_evidence`, in place of columns of those names; null and empty texts have no neighbours and score the prior."""
    docs = docs.drop("toxic_score", "toxic_evidence")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_evidence", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.rate(t, w) for _, _, buf, offsets in tx.text_parts(batch.column("text")) for t, w in vectors(*_lowered(buf, offsets), m.lookup, m.weight)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.string())], names=[*batch.schema.names, "toxic_score", "toxic_evidence"])

    return docs.mapInArrow(run, schema)
