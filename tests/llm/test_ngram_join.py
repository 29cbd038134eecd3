"""op7 against a brute-force join, and its edge cases."""

from __future__ import annotations

import itertools
import random

import numpy as np

from weirflow.llm import graph, ngram_join, storage


def shingle_set(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return {(d, len(s), min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def variants(seed, base_words, copies, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(base_words)]
    out = [base]
    for _ in range(copies):
        new = list(rng.choice(out[:3]))
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(new))
            new[at : at + rng.randrange(3)] = [f"x{rng.randrange(10_000)}" for _ in range(rng.randrange(1, 3))]
        out.append(new)
    return [" ".join(w) for w in out]


def test_against_brute_force(spark):
    texts = [t for s, (n, c, e) in enumerate([(60, 40, 6), (200, 30, 12), (12, 40, 2), (8, 30, 2), (5, 6, 1), (400, 12, 20), (30, 40, 3)]) for t in variants(s, n, c, e)]
    texts += ["", "  \n ", None, "one two", "ONE  two", "a b c d e", "A b c d E", texts[3], texts[3]]
    rows = list(enumerate(texts, 100))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x", d) for d, t in rows], "doc_id long, text string, component_id string, n long")
    got = {tuple(r) for r in ngram_join.jaccard_components(docs.repartition(5)).collect()}
    assert got == brute(sorted(rows))


def test_signatures_lose_no_pair():
    """Every linked pair shares a signature that one of the two probes, deficient hashes included."""
    rng = np.random.default_rng(3)
    for size in (4, 5, 6, 8, 11, 20, 45, 90, 230):
        for _ in range(60):
            x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            most = (2 * size) // 9
            drop = int(rng.integers(0, most + 1))
            add = int(rng.integers(0, most - drop + 1))
            y = np.concatenate([x[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
            if 9 * len(np.intersect1d(x, y)) < 4 * (len(x) + len(y)):
                continue
            x, y = np.unique(x), np.unique(y)
            row, sig, probe = ngram_join.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            if np.array_equal(x, y):
                continue
            a, b = ({int(s): bool(p) for r, s, p in zip(row, sig, probe, strict=True) if r == k} for k in (0, 1))
            assert any(a[s] or b[s] for s in a.keys() & b.keys()), size


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "z")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert got == [("7", 2, 7), ("None", 1, None), ("None", 2, 7)]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (30, 30), (None, 1)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges, "a", "b").collect()}
    assert {got[i] for i in (3, 4, 5, 9)} == {3} and got[21] == 20 and got[140] == 100 and 30 not in got and 1 not in got


def test_a_passage_that_many_unlike_texts_share(spark, monkeypatch):
    """Texts with one passage in common, of a few sizes, most of them unlike: groups are cut into blocks and lose no link."""
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 8)
    monkeypatch.setattr(ngram_join, "PAIR_ROWS", 3)
    monkeypatch.setattr(storage, "HOT_ROWS", 5)
    rng = random.Random(12)
    word = lambda: f"q{rng.randrange(100_000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(140):
        own = [word() for _ in range(rng.choice([12, 14, 30]))]
        rows.append((i, " ".join(passage + own)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([*passage, *own[:-1], word()])))
    for i in range(40):
        rows.append((500 + i, " ".join([*passage, *(f"same{k}" for k in range(30)), f"end{i}"])))
    rows += [(2000 + i, "" if i % 2 else None) for i in range(60)] + [(3000 + i, rows[0][1]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in ngram_join.jaccard_components(docs).collect()} == brute(sorted(rows))


def test_components_of_small_graphs_cost_no_rounds(spark, monkeypatch):
    """One task solves what fits it, without a round over the cluster; both ways agree, and links join components found before."""
    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)] + [(None, 2), (7, 7)], "a long, b long")
    rounds = []
    star = graph._star
    monkeypatch.setattr(graph, "_star", lambda *x: rounds.append(1) or star(*x))
    few = {tuple(r) for r in graph.components(edges, "a", "b").collect()}
    assert not rounds
    more = spark.createDataFrame([(460, 0), (900, 901), (901, 430)], "a long, b long")
    both = {tuple(r) for r in graph.merged(graph.components(edges, "a", "b"), more, "a", "b").collect()}
    monkeypatch.setattr(graph, "TASK_EDGES", 0)
    assert few == {tuple(r) for r in graph.components(edges, "a", "b").collect()} and rounds
    assert both == {tuple(r) for r in graph.components(edges.union(more), "a", "b").collect()}
    assert graph.components(edges.limit(0), "a", "b").count() == 0


def test_long_unlike_texts_never_meet(spark, monkeypatch):
    """Long texts with a passage in common fill the narrow bitmaps; wide ones keep unlike ones from being sent, and lose no link."""
    rng = random.Random(21)
    words = lambda n: [f"z{rng.randrange(1_000_000)}" for _ in range(n)]
    passage = words(120)
    rows = []
    for i in range(24):
        text = passage + words(rng.choice([1400, 1900, 2040, 2060]))
        rows.append((i, " ".join(text)))
        if i % 6 == 0:
            cut = rng.choice([0, 60, 130])
            rows.append((100 + i, " ".join(text[: len(text) - cut] + words(cut))))
    rows += [(3, " ".join(words(1500))), (50, rows[2][1]), (60, None)]
    asked = []
    verify = ngram_join.verify
    monkeypatch.setattr(ngram_join, "verify", lambda pairs, texts: asked.extend(map(tuple, pairs.select("a", "b").collect())) or verify(pairs, texts))
    docs = spark.createDataFrame([r for r in rows if r[0] != 3], "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in ngram_join.jaccard_components(docs).collect()} == brute(sorted(r for r in rows if r[0] != 3))
    asked_of_unlike = {(a, b) for a, b in asked if abs(a - b) != 100}
    assert not asked_of_unlike
    # An id of two rows has no wide bitmap, and its pairs stay.
    both = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = storage.materialise(spark.createDataFrame([(1, 2), (3, 4), (0, 100)], "a long, b long"), "test-pairs")
    node = spark.createDataFrame([(i, 2000) for i in (0, 1, 2, 3, 4, 100)], "node long, n long")
    assert sorted(map(tuple, ngram_join.narrowed(pairs, node, both).collect())) == [(0, 100), (3, 4)]
