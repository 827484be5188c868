"""What the span finders share: order and digest of spans, and passing rows through."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices

Span = tuple[str, int, int]  # kind, start and end in code points, end exclusive


class Taken:
    """Disjoint stretches of a text, for overlap tests in logarithmic time."""

    def __init__(self, spans: Sequence[Span]):
        self.stretches: list[tuple[int, int]] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.stretches and a < self.stretches[-1][1]:
                self.stretches[-1] = (self.stretches[-1][0], max(b, self.stretches[-1][1]))
            else:
                self.stretches.append((a, b))

    def overlap(self, start: int, end: int) -> bool:
        at = bisect_left(self.stretches, (end, -1))
        return at > 0 and self.stretches[at - 1][1] > start

    def add(self, start: int, end: int) -> None:
        insort(self.stretches, (start, end))


def written(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    """kind:start:end by start, then by the order of kinds, joined by commas."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def span_table(
    documents: DataFrame,
    base: Sequence[str],
    kinds: Sequence[str],
    find: Callable[[], Callable[[str], tuple[list[Span], list[Span]]]],
) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans.

    ``find()`` makes, once per task, the function text -> (base spans, added spans).
    """
    counts = [f"n_{k}" for k in base]
    schema = "doc_id long, " + "".join(f"{c} long, " for c in counts) + "base_sha256 string, spans string"

    def rows(batches):
        spans_of = find()
        for batch in batches:
            for part in slices(batch, "text"):
                columns: list[list] = [[] for _ in range(len(base) + 2)]
                for text in part.column("text").to_pylist():
                    own, added = spans_of(text or "")
                    for k, kind in enumerate(base):
                        columns[k].append(sum(s[0] == kind for s in own))
                    columns[-2].append(hashlib.sha256(written(own, kinds).encode()).hexdigest())
                    columns[-1].append(written(own + added, kinds))
                arrays = [pa.array(c, pa.int64()) for c in columns[:-2]] + [pa.array(c, pa.string()) for c in columns[-2:]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *arrays], ["doc_id", *counts, "base_sha256", "spans"]
                )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(rows, schema)
