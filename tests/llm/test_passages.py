"""op5 against a brute-force removal, and its edge cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa

from weirflow.llm import substring_dedup as sd
from weirflow.llm import textops as tx


def brute(rows):
    first = {}
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in docs:
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            key = float("inf") if d is None else d
            first[g] = min(first.get(g, key), key)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < (float("inf") if d is None else d):
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(d), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = lambda n: [f"wörd{rng.randrange(500)}" for _ in range(n)]
    passage, other = words(70), words(50)
    rows = []
    for i in range(60):
        w = words(rng.randrange(200))
        if i % 2:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(25) :] if i % 3 else other
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(1000 + i, rows[5][1]) for i in range(5)] + [(None, rows[5][1]), (None, " ".join(words(60)))]
    rows += [(2000, ""), (2001, None), (2002, "a " * 300), (2003, "a " * 200), (2002, "a " * 300), (2004, " ".join(passage)), (2005, " ".join(passage[:49]))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int").repartition(4)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in sd.repeated_passages(docs).collect()) == brute(rows)
    assert sd.repeated_passages(docs.limit(0)).count() == 0


def test_canonical_and_windows():
    column = pa.array(["  a\n\nb ", None, "", "c", " \x0b "])
    ((_, _, buf, off),) = tx.text_parts(column)
    text, w = sd.canonical(buf, off)
    assert text == b"a bc" and [text[s:e] for s, e in zip(w.starts, w.ends, strict=True)] == [b"a", b"b", b"c"]
    assert w.off.tolist() == [0, 2, 2, 2, 3, 3]
    x = np.random.default_rng(0).integers(0, 100, 57).astype(np.uint64)
    assert sd._sliding_min(x, 9).tolist() == [int(x[i : i + 9].min()) for i in range(49)]


def test_a_phrase_in_very_many_contexts(spark, monkeypatch):
    """Half of the texts hold one phrase whose pieces have the least hashes; its windows are spread and counted all the same."""
    rng = random.Random(9)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    phrase = min((words(8) for _ in range(300)), key=lambda p: _least(" ".join(p)))
    shared = words(40) + phrase + words(20)
    rows = []
    for i in range(160):
        w = words(60)
        if i % 2:
            w[30:30] = phrase
        if i % 16 == 3:
            w += shared
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(sd, "HOT_STRINGS", 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    hot = sd.hot_slots(docs)
    assert hot is not None and hot.sum() < 50
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in sd.repeated_passages(docs).collect())
    assert got == brute(rows) and sum(r[2] > 0 for r in got) == 9
    many = lambda slots: np.unique(np.concatenate([_minimisers(t, slots) for _, t in rows]), return_counts=True)[1].max()
    assert many(hot) < many(None) / 4


def _minimisers(text, hot=None):
    raw = np.frombuffer(text.encode(), np.uint8)
    return sd.super_kmers(tx.words_of(raw, np.array([0, len(raw)])), hot)[3]


def _least(phrase):
    h = [np.uint64(tx.hash_word(x)) for x in phrase.split()]
    out = []
    for i in range(len(h) - sd.PIECE + 1):
        acc = np.zeros(1, np.uint64)
        for x in h[i : i + sd.PIECE]:
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + x
        out.append(int(tx.mix(acc)[0]))
    return min(out)
