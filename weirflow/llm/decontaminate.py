"""Benchmark decontamination: BM25 over an inverted index of the test items, searched with block-max WAND.

Test items are cut into parts of at most `PART_WORDS` words. Texts are cut into cells as long as the longest part, and
two neighbouring cells are a passage, so any part found in a text lies whole in some passage. A passage asks for all parts
whose BM25 score is at least `RATIO` of the part's score against itself; impacts are stored divided by that self score, so
one threshold holds for all lists. As in WAND, common terms of a part are not essential: their total is a constant of the
part and stays under the threshold, so no part is reached without an essential term. Essential postings are summed first by
blocks of parts with their block maxima, for all passages of a batch at once; only blocks whose bound reaches the threshold
have their parts scored exactly. Items of equal words are one item with several ids.

A hit is verified on the whole item: at least `OVERLAP` of the words of its question and of its answer must appear in the
passage region in order, anchored by a common five-word shingle. An item without an answer of its own (no `answer` column)
has its last sentence as the answer and the rest as the question.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import textops as tx

K1, B = 1.2, 0.75
RATIO = 0.6
OVERLAP = 0.8
PART_WORDS = 96
BLOCK = 8
SHINGLE = 5
#: Postings summed at a time.
POSTINGS = 1 << 21
#: Test text, in bytes, that one index holds; more is searched index by index, so what is sent along stays bounded.
INDEX_BYTES = 32 << 20
U64 = np.uint64


def words_between(w: tx.Words, lo: int, hi: int) -> list[bytes]:
    if hi <= lo:
        return []
    flat = w.buf[w.starts[lo] : w.ends[hi - 1]].tobytes()
    base = int(w.starts[lo])
    return [flat[s - base : e - base] for s, e in zip(w.starts[lo:hi].tolist(), w.ends[lo:hi].tolist(), strict=True)]


def normal_words(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode(), np.uint8)
    w = tx.normal(raw, np.array([0, len(raw)]))
    return words_between(w, 0, len(w.starts))


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the last question mark or else the last sentence end inside the text divides them."""
    cut = max(text.rfind("?", 0, len(text) - 1), -1)
    if cut < 0:
        ends = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", text)]
        cut = ends[-1] - 1 if ends else -1
    return (text, "") if cut < 0 else (text[: cut + 1], text[cut + 1 :])


class ItemIndex:
    """Parts of the items as block-max posting lists of impacts relative to the self score."""

    def __init__(self, items: list[tuple[int | None, str, str]]):
        same: dict[tuple, list[int | None]] = {}
        for i, q, a in items:
            same.setdefault((tuple(normal_words(q)), tuple(normal_words(a))), []).append(i)
        self.items = [(ids, list(q), list(a)) for (q, a), ids in same.items()]
        self.parts: list[tuple[int, list[bytes]]] = []
        for k, (_, q, a) in enumerate(self.items):
            words = q + a
            pieces = max(1, -(-len(words) // PART_WORDS))
            step = -(-len(words) // pieces) if words else 1
            self.parts += [(k, words[s : s + step]) for s in range(0, len(words), step)]
        self.cell = max([8, *(len(w) for _, w in self.parts)])
        terms = sorted({w for _, ws in self.parts for w in ws})
        number = {w: i for i, w in enumerate(terms)}
        n, mean = len(self.parts), sum(len(w) for _, w in self.parts) / max(1, len(self.parts))
        lists: list[dict[int, float]] = [{} for _ in terms]
        for p, (_, ws) in enumerate(self.parts):
            for w in ws:
                lists[number[w]][p] = lists[number[w]].get(p, 0) + 1
        own = np.zeros(n)
        for t, posts in enumerate(lists):
            idf = np.log(1 + (n - len(posts) + 0.5) / (len(posts) + 0.5))
            for p, tf in posts.items():
                posts[p] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(self.parts[p][1]) / mean))
                own[p] += posts[p]
        self.rest = np.zeros(n)
        essential: list[set[int]] = [set() for _ in lists]
        # The most common terms first: a term is left out of the search only while the part's total of such terms stays under RATIO.
        for t in sorted(range(len(lists)), key=lambda t: -len(lists[t])):
            posts = lists[t]
            common = len(posts) > max(2, n // 25)
            for p in posts:
                posts[p] /= own[p]
                if common and self.rest[p] + posts[p] < RATIO - 1e-6:
                    self.rest[p] += posts[p]
                else:
                    essential[t].add(p)
        blocks = -(-n // BLOCK)
        self.lists: list[dict[bytes, list[tuple[int, float]]]] = [{} for _ in range(blocks)]
        for w, posts in zip(terms, lists, strict=True):
            for p, x in posts.items():
                self.lists[p // BLOCK].setdefault(w, []).append((p, x))
        self.block_rest = np.array([self.rest[b * BLOCK : (b + 1) * BLOCK].max() for b in range(blocks)])
        rows = []
        for t, posts in enumerate(lists):
            best: dict[int, float] = {}
            for p in essential[t]:
                best[p // BLOCK] = max(best.get(p // BLOCK, 0), posts[p])
            rows += [(tx.hash_word(terms[t]), b, x) for b, x in best.items()]
        rows.sort()
        h = np.array([r[0] for r in rows], U64)
        self.terms, first = np.unique(h, return_index=True) if len(h) else (h, np.zeros(0, np.int64))
        self.first = np.append(first, len(rows)).astype(np.int64)
        self.block = np.array([r[1] for r in rows], np.int64)
        self.bound = np.array([r[2] for r in rows])
        # Anchors: the five-word shingles of an item, or all of its words if it has fewer.
        self.shingles = [{tuple(w[i : i + SHINGLE]) for w in [q + a] for i in range(max(1, len(w) - SHINGLE + 1))} for _, q, a in self.items]
        self.reach = [min(SHINGLE, len(q) + len(a)) for _, q, a in self.items]

    def passages(self, h: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, first cell, block) of passages whose block bound reaches the threshold; h are hashes of normal words."""
        if not len(self.terms) or not len(h):
            return
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == h)
        row = np.searchsorted(off, hit, "right") - 1
        cells = -(-np.diff(off) // self.cell)
        base = np.concatenate([[0], np.cumsum(cells + 1)])
        cell = base[row] + (hit - off[row]) // self.cell
        term = at[hit]
        # A term counts once a cell.
        key = np.unique(cell * len(self.terms) + term)
        cell, term = key // len(self.terms), key % len(self.terms)
        upto = np.concatenate([[0], np.cumsum(self.first[term + 1] - self.first[term])])
        s = 0
        while s < len(cell):
            last = cell[max(s, np.searchsorted(upto, upto[s] + POSTINGS, "right") - 2)]
            e, reach = np.searchsorted(cell, [last, last + 1], "right")
            cells, block = self._reaching(cell[s:reach], term[s:reach], last)
            row = np.searchsorted(base, cells, "right") - 1
            yield from zip(row.tolist(), (cells - base[row]).tolist(), block.tolist(), strict=True)
            s = e

    def _reaching(self, cell: np.ndarray, term: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, block) whose bound, with the cell after it, reaches the threshold; cells up to `last`."""
        many = self.first[term + 1] - self.first[term]
        post = np.repeat(self.first[term], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        key = np.repeat(cell, many) * len(self.block_rest) + self.block[post]
        key, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, weights=self.bound[post], minlength=len(key))
        cell, block = key // len(self.block_rest), key % len(self.block_rest)
        after = np.searchsorted(key, key + len(self.block_rest))
        follows = (after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key + len(self.block_rest))
        second = np.where(follows, total[np.minimum(after, len(key) - 1)], 0)
        # The passage that starts at a cell, and the one that ends at it, when no hit of the block is in the cell before.
        good = (total + second + self.block_rest[block] >= RATIO - 1e-9) & (cell <= last)
        return cell[good], block[good]

    def score(self, words: set[bytes], block: int) -> list[tuple[int, float]]:
        """Parts of the block whose exact relative score reaches the threshold."""
        got: dict[int, float] = {}
        lists = self.lists[block]
        for w in words & lists.keys():
            for p, x in lists[w]:
                got[p] = got.get(p, 0.0) + x
        return [(p, s) for p, s in got.items() if s >= RATIO - 1e-9]

    def verify(self, item: int, words: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and the answer's words found in order."""
        _, q, a = self.items[item]
        n = self.reach[item]
        if not any(tuple(words[i : i + n]) in self.shingles[item] for i in range(max(1, len(words) - n + 1))):
            return 0.0, 0.0
        whole = q + a
        found = np.zeros(len(whole), bool)
        for m in SequenceMatcher(None, whole, words, False).get_matching_blocks():
            found[m.a : m.a + m.size] = True
        share = lambda x: float(x.mean()) if len(x) else 1.0
        return share(found[: len(q)]), share(found[len(q) :])

    def search(self, w: tx.Words, row: int, cells: list[tuple[int, int]]) -> list[tuple[int, int, float, float, float]]:
        """(item, passage's first word, score, question, answer) of the verified hits, the best of each item."""
        first, last = int(w.off[row]), int(w.off[row + 1])
        best: dict[int, tuple] = {}
        here: dict[int, set[bytes]] = {}
        for cell, block in sorted(set(cells)):
            lo = first + cell * self.cell
            if cell not in here:
                here[cell] = set(words_between(w, lo, min(last, lo + 2 * self.cell)))
            for part, s in self.score(here[cell], block):
                item = self.parts[part][0]
                reach = len(self.items[item][1]) + len(self.items[item][2]) + self.cell
                q, a = self.verify(item, words_between(w, max(first, lo - reach), min(last, lo + 2 * self.cell + reach)))
                if min(q, a) >= OVERLAP and (item not in best or s > best[item][2]):
                    best[item] = (item, lo - first, s, q, a)
        return [best[k] for k in sorted(best)]


def _items_of(rows: list[tuple]) -> list[tuple[int | None, str, str]]:
    out: dict[tuple, None] = {}
    for i, *text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [x or "" for x in r[1:]])):
        q, a = (x or "" for x in text) if len(text) == 2 else split_item(text[0] or "")
        if normal_words(q + " " + a):
            out[i, q, a] = None
    return list(out)


def indexes(benchmark: DataFrame, text_col: str = "text", part_bytes: int = INDEX_BYTES) -> Iterator[ItemIndex]:
    """Indexes of all test items, each over `part_bytes` of their text or about that, one after another.

    Null and empty texts are left out; every text of a repeated or null id is kept. Equal texts come into the same index.
    """
    names = set(benchmark.columns)
    cols = ["question", "answer"] if {"question", "answer"} <= names else [text_col]
    size = benchmark.agg(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in cols))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    part = F.pmod(F.xxhash64(*(F.lower(c) for c in cols)), F.lit(parts))
    for k in range(parts):
        yield ItemIndex(_items_of([tuple(r) for r in benchmark.where(part == k).select("item_id", *cols).toLocalIterator()]))


_HIT = "doc_id long, item_id long, passage_start long, score double, question_overlap double, answer_overlap double"
_HIT_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage_start", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def _hits(index: ItemIndex, texts: pa.Array) -> Iterator[tuple[int, list]]:
    """(row, verified hits) of the rows that have any."""
    for a, _, buf, offsets in tx.text_parts(texts):
        w = tx.normal(buf, offsets)
        by: dict[int, list[tuple[int, int]]] = {}
        for r, cell, block in index.passages(tx.span_hashes(w.buf, w.starts, w.ends), w.off):
            by.setdefault(r, []).extend([(cell, block), (cell - 1, block)] if cell else [(cell, block)])
        for r, cells in sorted(by.items()):
            if found := index.search(w, r, cells):
                yield a + r, found


def contaminated(docs: DataFrame, benchmark: DataFrame, part_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document and test item found in it: (doc_id, item_id, passage_start in words, score, overlaps).

    Null and empty texts, an empty table or no items give no rows; a null id is kept; rows that repeat are searched each. Test text
    beyond `part_bytes` is cut into several indexes, for each of which the texts are searched once.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def searched(index: ItemIndex) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = batch.column(0)
                rows = [dict(zip(_HIT_ARROW.names, (ids[r].as_py(), item, lo, s, q, a), strict=True)) for r, found in _hits(index, batch.column(1)) for i, lo, s, q, a in found for item in index.items[i][0]]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _HIT_ARROW)

        return texts.mapInArrow(run, _HIT)

    found = [searched(index) for index in indexes(benchmark, part_bytes=part_bytes)]
    out = found[0]
    for one in found[1:]:
        out = out.union(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, part_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of `docs` in which no test item is found, with all their columns.

    Null and empty texts stay, as do all rows if there are no items; repeated rows are judged each. Columns are passed on by their
    place, whatever their names.
    """

    def kept(rows: DataFrame, index: ItemIndex) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _ in _hits(index, batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(run, docs.schema)

    for index in indexes(benchmark, part_bytes=part_bytes):
        docs = kept(docs, index)
    return docs
