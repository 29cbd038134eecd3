"""One ordered pass over the spans of each group, Arrow batch by batch: what the order of visiting decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame


def disjoint(spans: DataFrame, keys: tuple[str, ...], order: list[str | Column], rank: Column | None = None) -> DataFrame:
    """The spans (start, end) of each group that overlap none kept before, visited in `order`, which begins with the start.

    With a rank a span that overlaps the one kept last takes its place if it ranks higher. Since kept spans are disjoint and in
    order, only the last can overlap, so a task holds one row and a group of any size is a linear sweep. Rows of an empty
    table give none.
    """
    extra = ["_rank"] if rank is not None else []
    ranked = spans.withColumn("_rank", rank.cast("int")) if extra else spans
    dealt = ranked.repartition(*keys).sortWithinPartitions(*keys, *order)
    places = [spans.columns.index(k) for k in keys]
    first, last, width = spans.columns.index("start"), spans.columns.index("end"), len(spans.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        now, reach, best = None, 0, 0
        for batch in batches:
            groups = list(zip(*(batch.column(i).to_pylist() for i in places), strict=True))
            starts, ends = batch.column(first).to_pylist(), batch.column(last).to_pylist()
            ranks = batch.column(width).to_pylist() if extra else [0] * len(starts)
            keep = np.zeros(len(starts), bool)
            out = pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width])
            at = -1
            for i, (group, start, end, score) in enumerate(zip(groups, starts, ends, ranks, strict=True)):
                if group == now and start < reach:
                    if score <= best:
                        continue
                elif at >= 0:
                    keep[at] = True
                elif held is not None:
                    yield held
                held, at, now, reach, best = None, i, group, end, score
            yield out.filter(pa.array(keep))
            if at >= 0:
                held = out.slice(at, 1)
        if held is not None:
            yield held

    return dealt.mapInArrow(run, spans.schema)
