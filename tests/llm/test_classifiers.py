"""op6 and op9: held-out accuracy, exact nearest neighbours, edge cases."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from weirflow.llm import quality, toxicity


def corpus(n=400):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 60))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            words[rng.randrange(len(words))] = "Vilest"
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [words[0]] * 40
            words += ["vilest"] * toxic
        docs.append((i, " ".join(words), "x"))
        labels.append((i, good, toxic))
    return docs, labels


def frames(spark):
    docs, labels = corpus()
    extra = [(1000, None, "x"), (1001, "", "x"), (1002, "a" * 200_000, "x"), (None, "zz", "x"), (3, docs[3][1], "x")]
    return spark.createDataFrame(docs + extra, "doc_id long, text string, label string"), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), labels[7]], "doc_id long, quality int, toxic int")


def accuracy(out, labels, column, value):
    seen = out.where("doc_id % 4 = 0").join(labels.where("quality is not null").dropDuplicates(), "doc_id")
    return seen.agg(F.avg((F.col(column) == F.col(value).cast("boolean")).cast("double"))).first()[0]


def test_quality(spark):
    docs, labels = frames(spark)
    out = quality.scored(docs, quality.fit(docs, labels, F.col("doc_id") % 4 != 0))
    assert out.columns == [*docs.columns, "quality_score"] and out.count() == docs.count()
    assert out.where("quality_score between 0 and 1").count() == docs.count()
    assert accuracy(out.withColumn("p", F.col("quality_score") >= 0.5), labels, "p", "quality") > 0.95
    empty = docs.limit(0)
    weights = quality.fit(empty, labels)
    assert quality.scored(empty, weights).count() == 0 and not weights.any()
    assert quality.fit(docs, labels.limit(0)).any() is np.False_


def test_toxicity(spark):
    docs, labels = frames(spark)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 0)
    out = toxicity.scored(docs, model)
    assert out.count() == docs.count() and out.where("toxic_score between 0 and 1").count() == docs.count()
    assert accuracy(out.withColumn("p", F.col("toxic_score") >= 0.5), labels, "p", "toxic") > 0.95
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
    assert toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).select("toxic_score").distinct().count() == 1


def test_toxicity_vectors_are_of_whole_texts(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(60)], 12)) + (" vilest" if i % 4 == 0 else " calm") + f" only{i}x" for i in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (500, "w1 w2 w3"), (502, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert all(out[d].toxic_evidence for d in [*range(120), 500])
    inside = [int(i) for i in model.index.ids]
    vecs = {}
    for d in [*inside, 500]:
        raw = np.frombuffer((texts[d] if d < 500 else "w1 w2 w3").encode(), np.uint8)
        h, off = toxicity._lowered(raw, np.array([0, len(raw)]))
        h = h[h != 0]
        assert np.isin(h, model.terms).all()
        whole = np.zeros(len(model.terms))
        np.add.at(whole, np.searchsorted(model.terms, h), 1)
        whole = np.where(whole > 0, (1 + np.log(np.maximum(whole, 1))) * model.weight, 0)
        vecs[d] = whole / np.linalg.norm(whole)
    for d in [*inside[:10], 500]:
        want = sorted((float(vecs[d] @ vecs[i]) for i in inside), reverse=True)[: toxicity.NEIGHBOURS]
        assert np.allclose([float(x.split(":")[1]) for x in out[d].toxic_evidence.split(",")], [x for x in want if x > 0], atol=1e-4)
    own = inside[0]
    alone = spark.createDataFrame([(600, f"only{own}x")], "doc_id long, text string")
    assert str(own) in [x.split(":")[0] for x in toxicity.scored(alone, model).first().toxic_evidence.split(",")]
    assert out[502].toxic_evidence == ""


def test_block_max_is_exact():
    rng = np.random.default_rng(1)
    examples = []
    for i in range(700):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t))
        examples.append((i, int(i % 3 == 0), t, w / np.sqrt(w @ w)))
    index = toxicity.Index(examples, 40)
    for _ in range(30):
        t = np.sort(rng.choice(40, 4, replace=False))
        w = rng.random(4)
        w /= np.sqrt(w @ w)
        whole = sorted((float(sum(x * w[np.flatnonzero(t == k)[0]] for k, x in zip(e[2], e[3], strict=True) if k in t)) for e in examples), reverse=True)
        _, sim = index.nearest(t, w)
        assert np.allclose(sim, [s for s in whole[: toxicity.NEIGHBOURS] if s > 0], atol=1e-5)


def _flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_quality_score_of_a_text_ignores_its_neighbours():
    rng = random.Random(6)
    weights = np.random.default_rng(6).normal(size=quality.SLOTS + 1)
    texts = ["one two three four", "three x y", "four four", "", "a", "a a a", "two", "b a", "zzz!! zzz!!"]
    texts += [" ".join(rng.choice(["a", "b", "c!", "DD"]) for _ in range(rng.randrange(6))) for _ in range(60)]
    alone = {t: quality.score(weights, *_flat([t]))[0] for t in texts}
    for _ in range(20):
        rng.shuffle(texts)
        together = quality.score(weights, *_flat(texts))
        assert [alone[t] for t in texts] == together.tolist()
        for t in texts[:5]:
            slot, off = quality.slots(*_flat([t]))
            assert len(slot) == off[-1] and (not t.split() or len(slot) > 0)


def test_training_ignores_row_order_and_repeated_ids(spark):
    docs, labels = frames(spark)
    twice = docs.union(docs.where("doc_id < 20").withColumn("text", F.concat("text", F.lit(" later"))))
    one = quality.fit(twice, labels)
    assert np.array_equal(one, quality.fit(twice.repartition(7, "text"), labels.repartition(3)))


def brute_quality(weights, text):
    """The score by the plain rules: tokens, then a pair for each, repetitions apart, one sum."""
    import math
    import re

    from weirflow.llm import textops as tx

    size = quality.SLOTS
    h = [tx.hash_word(t) for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text.encode())]
    total = 0.0
    for i, x in enumerate(h):
        if i == len(h) - 1:
            pair = x ^ 0x5851F42D4C957F2D
        elif h[i + 1] == x:
            pair = 0xE7037ED1A0B428DB
        elif i + 2 < len(h) and h[i + 2] == x:
            pair = 0xA0761D6478BD642F
        else:
            pair = int(tx.mix(np.array([(x * 0x9E3779B97F4A7C15 + h[i + 1]) & (1 << 64) - 1], np.uint64))[0])
        total += weights[x % size] + weights[pair % size]
    margin = quality.SCALE * total / max(1, 2 * len(h)) + weights[-1]
    return 1 / (1 + math.exp(-min(35, max(-35, margin))))


def test_quality_score_by_the_plain_rules():
    rng = random.Random(8)
    weights = np.random.default_rng(8).normal(size=quality.SLOTS + 1)
    texts = ["", "a", "a a", "a b a", "Ünï cöde!! ok", "x\x7fy\tz", "one, two; (three) -- four"]
    texts += [" ".join(rng.choice(["a", "b", "c!", "DD", "é", "7%"]) for _ in range(rng.randrange(30))) for _ in range(80)]
    got = quality.score(weights, *_flat(texts))
    assert np.allclose(got, [brute_quality(weights, t) for t in texts], atol=1e-12)
