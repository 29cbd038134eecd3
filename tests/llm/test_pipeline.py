"""The pipeline's stages on a small folder: each against what the stage alone should keep."""

from __future__ import annotations

import random
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from weirflow.llm import pieces
from weirflow.llm.queries import TOKENIZERS


@pytest.mark.skipif(not Path(f"{TOKENIZERS}/piece_bpe_32k.model").exists(), reason="no tokenizer files")
def test_stages(spark, tmp_path):
    rng = random.Random(8)
    good = [" ".join(f"w{rng.randrange(991)}" for _ in range(80)) for _ in range(40)]
    bad = [t.upper().replace(" ", "!! ") for t in good[:12]]
    item = "Which river runs through the old town of Arles? The river that runs there is called the Rhone by everyone."
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, t) for i, t in enumerate(bad)]
    rows += [(200, good[3]), (201, good[5] + " tail"), (202, good[39] + " x y " + item + " " + good[0][::-1]), (203, "mail me at a.b@c.org please"), (204, None), (205, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, quality_score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows[:50]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = []
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        ids.append({r.doc_id for r in now.select("doc_id").collect()})
    every = {i for i, _ in rows}
    assert ids[0] == every - set(range(100, 112))
    assert ids[1] == ids[0] - {200, 201}
    assert ids[2] == ids[1] - {202}
    assert ids[3] == ids[2]
    clean = {r.doc_id: r for r in now.collect()}
    assert clean[203].text == "mail me at <email> please" and clean[203].n_chars == len(clean[203].text)
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert {r.doc_id for r in out} == ids[3]
    codec = pieces.Codec(Path(f"{TOKENIZERS}/piece_bpe_32k.model").read_bytes())
    for r in out:
        (want, _, _) = codec.encode([clean[r.doc_id].text or ""])[0]
        assert bytes(r.token_ids) == want and r.n_tokens == len(want) // 4
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert docs.agg(F.count("*")).first()[0] == len(rows)
