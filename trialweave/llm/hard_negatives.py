"""Hard negatives by an inverted multi-index with certified stops.

For each anchor the best other rows of its label are its positives; for each positive, the best rows
of other labels whose score lies in a window below the positive's are its hard negatives. Scores
are inner products of whole-number vectors, so results are exact: the index only saves work.

*Index.* Vectors are halved and each half has a codebook (k-means on at most ``SAMPLE`` rows, the
smallest by hash; about the fourth root of the rows as its size). The pair of nearest codewords is
a row's cell. Every row is indexed. A cell is split evenly into blocks of about ``BLOCK`` rows by the
position of the rows, not by their values, so that a cell of many copies is shared by many tasks.
*Visits.* For a half, product with the codeword + length x the codeword's radius bounds what any row
under that codeword can add. Both halves' bounds are sorted and a heap pops cells (i, j) by descending sum
(multi-sequence). An anchor first visits cells of ``FIRST`` rows together; what it finds is a threshold, and it then
visits all further cells whose bound reaches it. So whatever wasn't visited can't be among the results.
Positives are certified so, then each window: its threshold is its last negative found, or its lower end.
*Scoring.* Anchors travel to blocks in packed rows; a task holds one block and one batch of anchors.
Products run in single or double precision where the lengths prove them exact, else in 64-bit integers.

Rows with a null label, a null vector or a null or non-finite component take no part. Shorter vectors
count as filled up with zeros; components are cut at +-2^28 after scaling. Rows that repeat an id
are rows of their own, also as anchors. A null vec_id is no anchor and comes last among equal scores. Empty tables
give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import longs_of
from .exchange import groups_of, partitions, stored

SAMPLE = 8192
ROUNDS = 12
BLOCK = 4096
FIRST = 1024
BATCH = 256  # anchors that travel together
ROW_BITS = 20  # a row's number is its block's, shifted, plus its place
LARGEST = float(1 << 28)
LAST = 2**63 - 1  # stands for a null vec_id
NONE = -(2**62)


@dataclass
class Codebooks:
    """Two codebooks, and for the index also the radii of their codewords and the cells' rows and blocks."""

    halves: list[np.ndarray]
    scale: float
    dims: int
    radii: list[np.ndarray] | None = None
    rows: np.ndarray | None = None  # rows of cell i * k + j
    first: np.ndarray | None = None  # its first block; one more at the end
    longest: float = 0.0  # of all vectors

    @property
    def size(self) -> int:
        return len(self.halves[0])

    def split(self, vectors: np.ndarray) -> list[np.ndarray]:
        cut = self.dims - self.dims // 2
        return [vectors[:, :cut], vectors[:, cut:]]

    def whole(self, column: pa.ListArray) -> np.ndarray:
        """Scaled whole-number vectors as float64, filled up with zeros."""
        at = column.offsets.to_numpy() - column.offsets[0].as_py() if len(column) else np.zeros(1, int)
        values = column.flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(at)
        out = np.zeros((len(column), self.dims))
        owner = np.repeat(np.arange(len(column)), lengths)
        out[owner, np.arange(len(values)) - at[owner]] = np.clip(np.floor(self.scale * values), -LARGEST, LARGEST)
        return out

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cells, and the distances to both codewords, a little more rather than less."""
        codes, far = [], []
        for half, book in zip(self.split(vectors), self.halves):
            code = np.argmin((book**2).sum(1) - 2 * half @ book.T, axis=1)
            codes.append(code)
            far.append(np.sqrt(((half - book[code]) ** 2).sum(1)) * (1 + 1e-9))
        return codes[0] * self.size + codes[1], far

    def dtype(self):
        """A type in which every product is exact."""
        most = self.longest**2
        return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def fit_codebook(sample: np.ndarray, size: int) -> np.ndarray:
    """k-means: distinct rows spread over the sample to begin with, then ``ROUNDS`` rounds."""
    distinct = np.unique(sample, axis=0)
    book = distinct[np.linspace(0, len(distinct) - 1, min(size, len(distinct))).astype(int)].astype(float)
    for _ in range(ROUNDS):
        code = np.argmin((book**2).sum(1) - 2 * sample @ book.T, axis=1)
        n = np.bincount(code, minlength=len(book))
        total = np.stack([np.bincount(code, c, minlength=len(book)) for c in sample.T], 1) if sample.shape[1] else book * 0
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return np.concatenate([book, np.full((size - len(book), book.shape[1]), 4 * LARGEST)])


def visits(bounds: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple[int, float]]:
    """Cells that hold rows, and their bounds, by descending sum of the two half bounds."""
    a, b = (np.argsort(-x, kind="stable") for x in bounds)
    x, y = bounds[0][a].tolist(), bounds[1][b].tolist()
    a, b, size = a.tolist(), b.tolist(), len(a)
    heap, popped = [(-(x[0] + y[0]), 0, 0)], set()
    while heap:
        bound, i, j = heapq.heappop(heap)
        popped.add((i, j))
        if i + 1 < size and (j == 0 or (i + 1, j - 1) in popped):
            heapq.heappush(heap, (-(x[i + 1] + y[j]), i + 1, j))
        if j + 1 < size and (i == 0 or (i - 1, j + 1) in popped):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        cell = a[i] * size + b[j]
        if rows[cell]:
            yield cell, -bound


def _valid(embeddings: DataFrame) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    finite = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("v"))


def _fit(rows: DataFrame, scale: float) -> Codebooks | None:
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return None
    size = min(256, max(4, 1 << round(math.log2(n) / 4)))
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    books = Codebooks([], scale, max(dims, 2))
    vectors = books.whole(sample)
    books.halves = [fit_codebook(half, size) for half in books.split(vectors)]
    return books


def _data(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> bytes:
    return ids.astype(np.int64).tobytes() + labels.astype(np.int64).tobytes() + vectors.astype(np.int32).tobytes()


def _parts(data: bytes, n: int, dims: int, extra: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids or row numbers, labels, vectors, and ``extra`` more whole numbers per row."""
    ids, labels = np.frombuffer(data, np.int64, 2 * n).reshape(2, n)
    vectors = np.frombuffer(data, np.int32, n * dims, 16 * n).reshape(n, dims)
    more = np.frombuffer(data, np.int64, n * extra, 16 * n + 4 * n * dims).reshape(n, extra)
    return ids, labels, vectors, more


def _index(rows: DataFrame, books: Codebooks, n: int) -> tuple[DataFrame, Codebooks]:
    """(block, n, data) of every row, and the codebooks with radii and cells."""

    def cells(batches):
        for batch in batches:
            vectors = books.whole(batch.column("v"))
            cell, far = books.nearest(vectors)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell.astype(np.int32)), pa.array(longs_of(batch.column("vec_id"), LAST)), batch.column("label"),
                    pa.array([v.tobytes() for v in vectors.astype(np.int32)], pa.binary()),
                    *map(pa.array, far), pa.array(np.sqrt((vectors**2).sum(1))),
                ],
                ["cell", "vec_id", "label", "v", "far1", "far2", "length"],
            )

    assigned = rows.mapInArrow(cells, "cell int, vec_id long, label long, v binary, far1 double, far2 double, length double")
    assigned, _ = stored(assigned, "cells")
    k = books.size
    stats = assigned.groupBy("cell").agg(F.count(F.lit(1)), F.max("far1"), F.max("far2"), F.max("length")).collect()  # k x k rows
    books.rows, books.radii = np.zeros(k * k, np.int64), [np.zeros(k), np.zeros(k)]
    for cell, count, far1, far2, length in stats:
        books.rows[cell] = count
        books.radii[0][cell // k] = max(books.radii[0][cell // k], far1)
        books.radii[1][cell % k] = max(books.radii[1][cell % k], far2)
        books.longest = max(books.longest, length)
    blocks = -(-books.rows // BLOCK)
    books.first = np.r_[0, np.cumsum(blocks)]

    def dealt(batches):
        seen = np.full(k * k, TaskContext.get().partitionId(), np.int64)
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            s, e = groups_of(cell[order])
            number = np.empty(len(cell), np.int64)
            number[order] = np.arange(len(cell)) - np.repeat(s, e - s)
            block = books.first[cell] + (seen[cell] + number) % blocks[cell]
            seen += np.bincount(cell, minlength=k * k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.astype(np.int32)), batch.column("vec_id"), batch.column("label"), batch.column("v")],
                ["block", "vec_id", "label", "v"],
            )

    def gathered(batches):
        held: list = [None, []]

        def flush():
            ids, labels, vectors = (np.concatenate([x[i] for x in held[1]]) for i in range(3))
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0]], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([_data(ids, labels, vectors)], pa.binary())],
                ["block", "n", "data"],
            )

        for batch in batches:
            block = batch.column("block").to_numpy()
            ids, labels = longs_of(batch.column("vec_id")), longs_of(batch.column("label"))
            vectors = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int32).reshape(len(ids), books.dims)
            for a, b in zip(*groups_of(block)):
                if held[1] and held[0] != block[a]:
                    yield flush()
                    held[1] = []
                held[0] = block[a]
                held[1].append((ids[a:b], labels[a:b], vectors[a:b]))
        if held[1]:
            yield flush()

    spread = assigned.mapInArrow(dealt, "block int, vec_id long, label long, v binary").repartition(n, "block")
    index = spread.sortWithinPartitions("block", "vec_id").mapInArrow(gathered, "block int, n int, data binary")
    return stored(index, "index")[0], books


def _anchors(index: DataFrame, books: Codebooks, step: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            for block, n, data in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "data"))):
                ids, labels, vectors, _ = _parts(data, n, books.dims)
                on = np.flatnonzero((ids % step == 0) & (ids != LAST))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((block << ROW_BITS) + on), pa.array(ids[on]), pa.array(labels[on]),
                        pa.array([v.tobytes() for v in vectors[on]], pa.binary()),
                    ],
                    ["row", "anchor_id", "label", "v"],
                )

    return stored(index.mapInArrow(rows, "row long, anchor_id long, label long, v binary"), "anchors")[0]


def _routes(anchors: DataFrame, books, first: bool, extra: int) -> DataFrame:
    """(block, n, data): anchors(row, label, v, least, more) packed for the blocks that they visit.

    The first visits are of ``FIRST`` rows together; the others of all further cells whose bound reaches ``least``.
    """

    def rows(batches):
        index = books.value
        for batch in (b.slice(a, BATCH) for b in batches for a in range(0, b.num_rows, BATCH)):
            n = batch.num_rows
            number, label, least = (longs_of(batch.column(c)) for c in ("row", "label", "least"))
            vectors = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int32).reshape(n, index.dims)
            more = batch.column("more").flatten().to_numpy().reshape(n, extra)
            bounds = []
            for half, book, radius in zip(index.split(vectors.astype(float)), index.halves, index.radii):
                length = np.sqrt((half**2).sum(1))[:, None]
                used = radius + np.sqrt((book**2).sum(1))  # codewords without rows are far away
                bounds.append(half @ book.T + length * radius + 1e-9 * length * used)
            asked, cells = [], []
            for i in range(n):
                seen = 0
                for cell, bound in visits([x[i] for x in bounds], index.rows):
                    early = seen < FIRST
                    seen += int(index.rows[cell])
                    if first and not early or not (first or early) and bound < least[i]:
                        break
                    if early == first:
                        asked.append(i)
                        cells.append(cell)
            asked, cells = np.array(asked, np.int64), np.array(cells, np.int64)
            blocks = index.first[cells + 1] - index.first[cells]
            block = np.repeat(index.first[cells] - np.cumsum(blocks) + blocks, blocks) + np.arange(int(blocks.sum()))
            asked = np.repeat(asked, blocks)
            order = np.lexsort((asked, block))
            block, asked = block[order], asked[order]
            s, e = groups_of(block)
            data = [_data(number[own], label[own], vectors[own]) + more[own].tobytes() for own in (asked[a:b] for a, b in zip(s, e))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[s].astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.array(data, pa.binary())], ["block", "n", "data"]
            )

    return anchors.mapInArrow(rows, "block int, n int, data binary")


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of every owner."""
    order = np.lexsort((ids, -score, owner))
    s, e = groups_of(owner[order])
    return order[np.arange(len(order)) - np.repeat(s, e - s) < k]


def _scored(index: DataFrame, routes: DataFrame, books, extra: int, k: int, negatives: bool, n: int) -> DataFrame:
    """(row, window, score, vec_id): what the visited blocks hold for the anchors, k rows of each block at most.

    Positives: rows of the label, ``more`` is the least score. Negatives: rows of other labels, ``more`` has two
    numbers a window, the least and the greatest score.
    """
    both = index.withColumn("kind", F.lit(0)).unionByName(routes.withColumn("kind", F.lit(1)))
    both = both.repartition(n, "block").sortWithinPartitions("block", "kind")

    def rows(batches):
        kept = books.value
        kind_of = kept.dtype()
        held = None
        for batch in batches:
            out = []
            for block, size, data, kind in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "data", "kind"))):
                if kind == 0:
                    ids, labels, vectors, _ = _parts(data, size, kept.dims)
                    held = (ids, labels, vectors.astype(kind_of).T)
                    continue
                ids, labels, matrix = held
                row, label, vectors, more = _parts(data, size, kept.dims, extra)
                score = (vectors.astype(kind_of) @ matrix).astype(np.int64)
                same = label[:, None] == labels
                found = []
                if negatives:
                    for w in range(extra // 2):
                        low, high = more[:, 2 * w, None], more[:, 2 * w + 1, None]
                        found.append((w, *np.nonzero(~same & (score >= low) & (score <= high))))
                else:
                    own = np.flatnonzero(row >> ROW_BITS == block)
                    same[own, row[own] & ((1 << ROW_BITS) - 1)] = False
                    found.append((0, *np.nonzero(same & (score >= more))))
                for w, a, x in found:
                    best = _best(a, score[a, x], ids[x], k)
                    a, x = a[best], x[best]
                    out.append((row[a], np.full(len(a), w, np.int32), score[a, x], ids[x]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["row", "window", "score", "vec_id"])

    return both.mapInArrow(rows, "row long, window int, score long, vec_id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame, step: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0
) -> DataFrame:
    """embeddings(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``step``. A negative's score is between ``low``
    and ``high`` hundredths of its positive's.
    """
    spark = embeddings.sparkSession
    n = partitions(embeddings)
    rows = _valid(embeddings)
    fitted = _fit(rows, scale)
    if fitted is None:
        return rows.selectExpr(
            "vec_id as anchor_id", "vec_id as positive_id", "0 as rank", "vec_id as negative_id", "label as positive_score",
            "label as negative_score",
        ).limit(0)
    index, fitted = _index(rows, fitted, n)
    books = spark.sparkContext.broadcast(fitted)
    anchors = _anchors(index, fitted, step)

    def visited(asked: DataFrame, first: bool, extra: int, k: int, negative: bool) -> DataFrame:
        return stored(_scored(index, _routes(asked, books, first, extra), books, extra, k, negative, n), "visited")[0]

    # positives: thresholds from the first cells, then every cell that can reach them
    asked = anchors.withColumn("least", F.lit(NONE)).withColumn("more", F.array(F.lit(NONE)))
    early = visited(asked, True, 1, positives, False)
    last = _ranked(early, positives).where(F.col("rank") == positives).select("row", F.col("score").alias("least"))
    asked = anchors.join(last, "row", "left").withColumn("least", F.coalesce("least", F.lit(NONE)))
    late = visited(asked.withColumn("more", F.array("least")), False, 1, positives, False)
    found = _ranked(early.unionByName(late), positives).drop("window")
    found = found.select("row", F.col("rank").alias("window"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
    found, _ = stored(found.withColumn("window", (F.col("window") - 1).cast("int")), "positives")

    # negatives: score windows, 100 * least >= low * positive and 100 * greatest <= high * positive
    least = F.expr(f"-((-{low}L * positive_score - pmod(-{low}L * positive_score, 100L)) div 100L)")
    greatest = F.expr(f"({high}L * positive_score - pmod({high}L * positive_score, 100L)) div 100L")
    windows = found.select("row", "window", least.alias("least"), greatest.alias("greatest"))

    def with_windows(table: DataFrame) -> DataFrame:
        """Anchors with packed windows, those without a positive or a possible score empty."""
        per = table.groupBy("row").pivot("window", list(range(positives))).agg(F.struct(F.first("least").alias("least"), F.first("greatest").alias("greatest")))
        ends = []
        for w in range(positives):
            ends += [F.coalesce(F.col(f"`{w}`.least"), F.lit(-NONE)), F.coalesce(F.col(f"`{w}`.greatest"), F.lit(NONE))]
        open_ends = [F.when(ends[2 * w] <= ends[2 * w + 1], ends[2 * w]).otherwise(F.lit(-NONE)) for w in range(positives)]
        per = per.select("row", F.least(*open_ends, F.lit(-NONE)).alias("least"), F.array(*ends).alias("more"))
        return anchors.join(per, "row")

    early = visited(with_windows(windows), True, 2 * positives, negatives, True)
    last = _ranked(early, negatives).where(F.col("rank") == negatives).select("row", "window", F.col("score").alias("third"))
    narrowed = windows.join(last, ["row", "window"], "left").withColumn("least", F.coalesce("third", "least"))
    late = visited(with_windows(narrowed), False, 2 * positives, negatives, True)
    result = _ranked(early.unionByName(late), negatives).join(found, ["row", "window"]).join(anchors.select("row", "anchor_id"), "row")
    named = [F.when(F.col(c) < LAST, F.col(c)) for c in ("positive_id", "vec_id")]
    return result.select(
        "anchor_id", named[0].alias("positive_id"), "rank", named[1].alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, n FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS n FROM scored WHERE same
  ) WHERE n <= 5
), negative AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.r, p.n ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM positive p JOIN scored s ON s.r = p.r
  WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 3
"""
