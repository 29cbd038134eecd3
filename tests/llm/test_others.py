"""op1, op2, op3, op4, op8, op10 and the guard: round trips, brute force, edge cases."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from weirflow.llm import decontaminate, pieces, pii, spots, url_rules, warc
from weirflow.llm.queries import TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def test_warc_round_trip(spark):
    pages = [(1, "http://a/é\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"), (None, "v", "alone"), (1, "x", "<p>é</p>"), (9, "u", "z" * 100_000)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, offset int").repartition(3)
    index = warc.write_archives(df, archive_bytes=600)
    got = warc.read_records(index, with_payload=True).collect()
    assert len(got) == len(pages) and index.select("file").distinct().count() > 1
    for r in got:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == r.payload_digest
    kinds = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", 9, "response", None), ("1", 9, "response", None), ("2", 9, "revisit", 1), ("None", 9, "revisit", 1), ("3", 0, "response", None), ("4", 0, "revisit", 3), ("None", 5, "response", None), ("9", 100_000, "response", None)])
    some = warc.read_records(index.where("page_id = 9")).collect()
    assert [r.page_id for r in some] == [9]
    assert warc.read_records(warc.write_archives(df.limit(0))).count() == 0


@pytest.mark.skipif(not Path(MODEL).exists(), reason="no tokenizer files")
def test_pieces_parity(spark):
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["", " ", "  a   b\n\tc", "日本語 😀 ▁x", "<s> </s>", "x" * 3000, *("x" + " " * k + "y" for k in range(1, 30)), "Hello, wörld! 123\x00"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*texts, None])], "doc_id long, text string, n_chars string")
    rows = {r.doc_id: r for r in pieces.token_rows(docs, MODEL).collect()}
    assert len(rows) == len(texts) + 1 and rows[len(texts)].n_tokens == 0
    for i, t in enumerate(texts):
        ids = np.frombuffer(bytes(rows[i].token_ids), "<i4").tolist()
        assert ids == judge.encode(t) and rows[i].decoded == judge.decode(ids) and rows[i].parity_diff == 0
    assert pieces.token_rows(docs.limit(0), MODEL).count() == 0


def test_unigram_model():
    def piece(text, score, kind=1):
        body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    raw = piece("<unk>", 0, 2) + b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256)) + piece("▁", -3) + piece("▁ab", -1) + piece("a", -2) + piece("b", -2) + piece("c", -2.5)
    trainer, normaliser = b"\x18\x01\x98\x02\x01", b"\x18\x01\x20\x00\x28\x01"
    raw += b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(normaliser)]) + normaliser
    codec = pieces.Codec(raw, verify=False)
    assert codec.spec.kind == pieces.UNIGRAM and codec.spec.byte_fallback and not codec.spec.squeeze
    (ids, text, _), (other, back, _) = codec.encode(["ab c", "é"])
    names = [codec.spec.pieces[i][0] for i in np.frombuffer(ids, "<i4")]
    assert names == ["▁ab", "▁", "c"] and text == "ab c" and back == "é" and len(other) == 12


def test_pii_base_and_bootstrap(spark):
    texts = ["mail a@b.co,a@b@c.de x@y 1.2.3.4.5.6.7.8 300.1.1.1 007.0.0.255", "card 4111 1111 1111 1111 or 4111111111111112 +1 (017) 555-7713 +1 2", None, "", "9" * 5000 + "." + "a" * 5000, "é😀 a@b.co"]
    texts += [f"fax +1 (017) 555-{i:04d} now" for i in range(8)] + ["fax 555-123456, now", "plain 555-999999 words"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    rows = pii.spans(docs).select("doc_id", pii.span_text("base").alias("b"), pii.span_text("all_spans").alias("a")).collect()
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def passes(kind, found):
        d = re.sub("[^0-9]", "", found)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in found.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()

    for r in rows:
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, x in rules.items() for m in re.finditer(x, texts[r.doc_id] or "") if passes(k, m.group()))
        assert r.b == want
        assert set(filter(None, r.b.split(","))) <= set(r.a.split(","))
    found = {r.doc_id: r.a for r in rows}
    assert found[14] == "phone:4:14" and found[15] == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[14] == "fax <phone>, now" and clean[6] == "fax <phone> now" and clean[2] is None and clean[5] == "é😀 <email>"
    assert pii.spans(docs.limit(0)).count() == 0


def test_decontamination(spark):
    item = "The quick brown fox jumps over the lazy dog near the old river bank. It then sleeps for seven long hours."
    other = " ".join(f"word{i}" for i in range(300))
    bench = spark.createDataFrame([(1, item), (2, other), (3, ""), (None, "x"), (4, None), (1, "zz")], "item_id long, text string")
    filler = " ".join(f"f{i % 97}x" for i in range(500))
    edited = item.replace("lazy", "idle").upper()
    texts = [f"{filler} {item} {filler}", filler, edited, item[:40], None, "", other, f"{filler} {other} {item}", "It then sleeps for seven long hours. " + filler]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 1), (2, 1), (6, 2), (7, 1), (7, 2)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {1, 3, 4, 5, 8}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_of_repeated_and_small_vocabulary_items(spark, monkeypatch):
    rng = np.random.default_rng(11)
    sums = [f"Tom has {i} red apples and buys {i % 7 + 2} more apples at the shop. How many apples does Tom have now in total? Tom has {i + i % 7 + 2} apples." for i in range(10, 50)]
    small = [" ".join(rng.choice([f"v{k}" for k in range(12)], 40)) for _ in range(40)]
    filler = " ".join(f"f{i % 97}x" for i in range(150))
    for items in ([" ".join(f"r{k}" for k in range(30))] * 3 + [" ".join(f"u{i}x{k}" for k in range(20)) for i in range(40)], sums, small):
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        docs = spark.createDataFrame([(i, f"{filler} {t} {filler}") for i, t in enumerate(items)] + [(99, filler)], "doc_id long, text string")
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
        assert {(i, j) for i, t in enumerate(items) for j, other in enumerate(items) if t == other} <= got
        assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [99]
    index = decontaminate.ItemIndex([(i, t, "") for i, t in enumerate(small)])
    assert index.rest.max() < decontaminate.RATIO
    raw = np.frombuffer(" ".join(small).encode(), np.uint8)
    w = decontaminate.tx.normal(raw, np.array([0, len(raw)]))
    whole = list(index.passages(decontaminate.tx.span_hashes(w.buf, w.starts, w.ends), w.off))
    monkeypatch.setattr(decontaminate, "POSTINGS", 50)
    assert whole and list(index.passages(decontaminate.tx.span_hashes(w.buf, w.starts, w.ends), w.off)) == whole


def test_decontamination_of_repeated_and_null_item_ids(spark):
    texts = [" ".join(f"{c}{k}" for k in range(20)) for c in "abc"]
    bench = spark.createDataFrame([(0, texts[0]), (0, texts[1]), (0, texts[1]), (None, texts[2])], "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(texts), (3, "none of them is here")], "doc_id long, text string")
    assert sorted((r.doc_id, str(r.item_id)) for r in decontaminate.contaminated(docs, bench).collect()) == [(0, "0"), (1, "0"), (2, "None")]
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [3]


def test_block_max_loses_nothing():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words, rng.integers(8, 60))), "") for i in range(60)]
    index = decontaminate.ItemIndex(items)
    text = " ".join(rng.choice(words, 3000))
    for i in (3, 17, 44):
        text += " " + items[i][1] + " " + " ".join(rng.choice(words, 90))
    raw = np.frombuffer(text.encode(), np.uint8)
    w = decontaminate.tx.normal(raw, np.array([0, len(raw)]))
    got = {(c, b) for _, c, b in index.passages(decontaminate.tx.span_hashes(w.buf, w.starts, w.ends), w.off)}
    got |= {(c - 1, b) for c, b in got}
    for cell in range(len(w.starts) // index.cell + 1):
        here = set(decontaminate.words_between(w, cell * index.cell, min(len(w.starts), (cell + 2) * index.cell)))
        for b in range(len(index.block_rest)):
            if index.score(here, b):
                assert (cell, b) in got


def test_spots(spark):
    texts = {5: "the cat sat on the mat and a dog ran to the house", 1: "the cat sat on the mat and a dog ran to the house", 9: "", 20: None, 7: "x y z", 30: "der Hund und die Katze der Maus " * 20}
    rows = [(d, t, 0) for d, t in texts.items()] + [(None, "last", 0), (7, "x y z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").repartition(3)
    got = sorted(spots.compare_in_order(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    order = sorted(((d, t or "") for d, t, _ in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert len(got) == len(rows)
    for i, ((d, t), r) in enumerate(zip(order, got, strict=True)):
        after, half = order[(i + 1) % len(order)][1], len(t) // 2
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    prints = {r.doc_id: r for r in got}
    assert prints[5].fingerprint == prints[1].fingerprint and prints[1].near_next == 1.0 and prints[9].near_next == 1.0
    assert spots.compare_in_order(docs.limit(0)).count() == 0
    a, b = spots.read_fingerprint(prints[5].fingerprint), spots.read_fingerprint(prints[30].fingerprint)
    x, y = set(a.tolist()), set(b.tolist())
    assert spots.pruned_jaccard(a, b) == len(x & y) / len(x | y) and spots.pruned_jaccard(a, a, 0.9) == 1.0
    assert spots.pruned_jaccard(a, b, 0.9) == 0.0


def test_spot_classes(spark):
    import itertools
    import random

    rng = random.Random(6)
    words = lambda n: [rng.choice(["the", "of", "a", *(f"k{rng.randrange(900)}" for _ in range(4))]) for _ in range(n)]
    texts = []
    for _ in range(6):
        base = words(120)
        for edits in (0, 0, 1, 2, 3, 6, 9):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += ["", "", "x y", "the a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(s.tolist()) for s in spots._sets(texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: (r.n_signatures, r.class_id) for r in spots.near_duplicate_classes(docs).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}
    assert spots.near_duplicate_classes(docs.limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["http://a.example.com/en/x?q", "https://EXAMPLE.com/en/", "https://www.example.com/en/y#f", "http://b.com", "http://b.com/", "ftp://x.net/fr/1", "http://net/es/", "http://notexample.com/en/", "nourl", "", None, "http://x.net/en", "http://www.example.com/en/deep/z", "://h?x", "http://com:80/en/"]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("example.com", "/en/x", "allow"), ("www.example.com", "/en/deep/", "block")]
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    frame = spark.createDataFrame(rules, "host string, path string, action string")
    for r in url_rules.judge(pages, frame).collect():
        u = ([*urls, urls[0]][r.page_id]) or ""
        rest = u.partition("://")[2] if "://" in u else ""
        raw = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(raw) :]).group()
        host = raw.lower()
        fits = [(h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *best), u
    assert url_rules.judge(pages.limit(0), frame).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, frame.limit(0), default="block").collect()} == {"block"}


def test_entry_without_this_subpackage(tmp_path):
    import shutil

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "weirflow", tmp_path / "weirflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'severity_histogram' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def _letters(spark):
    """Texts in which e-mail addresses and phone numbers stand in fixed surroundings, some of them in forms no base pattern has."""
    rows = []
    for i in range(60):
        word = "lorem ipsum dolor sit amet".split()[i % 5]
        rows.append((i, f"{word} number {i * 37 % 91}: please write to user{i}@host{i % 7}.org for details, or call me on +49 30 555{i:04d} today {word}"))
    rows.append((100, "ipsum: please write to jane.doe at example dot org for details, thanks"))
    rows.append((101, "dolor: or call me on 030 555 12345 today then"))
    rows.append((102, "the total of 12345678 was at the end dot com era 1234 5678 9012"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_pii_bootstrap_finds_unseen_forms(spark):
    docs = _letters(spark)
    text = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in pii.spans(docs).select("doc_id", "base", "all_spans").collect()}
    cut = lambda d, spans: [text[d][s.start : s.end] for s in spans]
    assert cut(0, found[0].base) == ["user0@host0.org", "+49 30 5550000"]
    assert cut(100, found[100].all_spans) == ["jane.doe at example dot org"] and not found[100].base
    assert cut(101, found[101].all_spans) == ["030 555 12345"]
    assert found[102].all_spans == []
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[100] == "ipsum: please write to <email> for details, thanks" and clean[101] == "dolor: or call me on <phone> today then"


def test_pii_held_out_seeds_come_back(spark):
    got = {r.kind: (r.hidden, r.found) for r in pii.held_out_recall(_letters(spark)).collect()}
    hidden, back = (sum(x) for x in zip(*got.values(), strict=True))
    assert hidden >= 15 and back >= 0.9 * hidden


def test_redaction_of_long_texts_and_clashing_columns(spark):
    import random

    rng = random.Random(3)
    parts = [rng.choice(["x" * rng.randrange(1, 9000), "öä🙂 " * rng.randrange(1, 900)]) for _ in range(30)]
    whole = " a.b@c.org ".join(parts) + " +49 30 1234567"
    rows = [(1, whole, 7, 8, 9), (1, "q@r.st", 1, 2, 3), (2, None, 4, 5, 6), (None, "q@r.st", 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text int, _digest int, `a.b` int")
    got = {(r.doc_id, r._text): tuple(r) for r in pii.redact(docs).collect()}
    assert got[1, 7] == (1, " <email> ".join(parts) + " <phone>", 7, 8, 9)
    assert got[1, 1] == (1, "<email>", 1, 2, 3) and got[2, 4][1] is None and got[None, 0][1] == "<email>"
    assert len(got) == 4


def test_decontamination_of_many_parts_and_short_items(spark):
    docs = spark.createDataFrame([(1, "well then " * 20 + "colourless green ideas" + " sleep furiously now" * 20), (2, "the answer to it all is forty two, they say, and no less " * 3), (3, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"filler item number {i} about topic {i * 7919 % 101} and {i * 31 % 97}") for i in range(50)] + [(100, "colourless green ideas"), (101, "the answer to it all is forty two")], "item_id long, text string")
    want = {(1, 100), (2, 101)}
    for part_bytes in (1 << 20, 200):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, part_bytes).collect()} == want
        assert [r.doc_id for r in decontaminate.clean(docs, bench, part_bytes).collect()] == [3]


def test_hot_payloads_hosts_and_plain_sessions(spark):
    from weirflow.llm import storage

    pages = spark.createDataFrame([(i, f"https://www.example.com/{'en/' if i % 2 else ''}{i}" if i % 3 else "no scheme", "same" if i % 2 else f"own {i}") for i in range(3000)], "page_id long, url string, html string")
    index = warc.write_archives(pages)
    read = {r.page_id: r for r in warc.read_records(index).collect()}
    assert len(read) == 3000 and read[1].record_type == "response"
    assert all((read[i].record_type, read[i].refers_to) == ("revisit", 1) for i in range(3, 3000, 2))
    assert all(read[i].record_type == "response" for i in range(0, 3000, 2))
    rules = spark.createDataFrame([("com", "/", "allow"), ("www.example.com", "/en/", "block"), ("net", "/", "block")], "host string, path string, action string")
    old, url_rules.SWEEP_ROWS = url_rules.SWEEP_ROWS, 100
    try:
        got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
    finally:
        url_rules.SWEEP_ROWS = old
    for i in range(3000):
        assert got[i] == ((None, "allow") if i % 3 == 0 else ("www.example.com/en/", "block") if i % 2 else ("com/", "allow"))
    rows = spark.range(6000).selectExpr("if(id % 2 = 0, -1L, id) as k", "id", "1 as `_word`")
    classes = rows.groupBy("k").count().withColumnRenamed("count", "n").where("n > 1")
    joined = storage.with_class(rows, classes, ["k"], "n")
    assert joined.count() == 6000 and joined.where("n = 3000").count() == 3000
    kept = storage.keep_possible(rows, "id", spark.range(10, 20), "id")
    assert {r.id for r in kept.collect()} >= set(range(10, 20)) and kept.columns == rows.columns and kept.where("_word <> 1").count() == 0
    assert storage.shared_dir(spark)


def test_order_with_ids_far_apart(spark):
    """Most ids near each other, some far away: ranges hold about equal numbers of rows, and each row meets its next one."""
    ids = [*range(9000), 1 << 62, -(1 << 62), (1 << 62) + 5]
    docs = spark.createDataFrame([(i, f"text number {i} of the lot and {i % 17}") for i in ids], "doc_id long, text string").repartition(5)
    old, spots.BUCKET_ROWS = spots.BUCKET_ROWS, 100
    try:
        rows = {r.doc_id: r for r in spots.compare_in_order(docs).collect()}
    finally:
        spots.BUCKET_ROWS = old
    text = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(ids)
    assert len(rows) == len(ids)
    for here, after in zip(order, [*order[1:], order[0]], strict=True):
        t, half = text[here], len(text[here]) // 2
        assert rows[here].edited_sha256 == hashlib.sha256((t[: len(t) - half] + text[after][:half]).encode()).hexdigest()
