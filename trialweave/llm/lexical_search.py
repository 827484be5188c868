"""Exact ranked lexical search over norm buckets.

A document is a vector of impacts, one number a term: weight * saturated frequency. An item scores
it by the inner product with its own term counts. Impacts are kept for the terms of the items only;
other terms add nothing to any score.

*Buckets.* Vectors are ordered by length inside every stored file and numbered by geometric length
buckets. The longest buckets are searched first and give every item a threshold, its k-th score so
far. Whatever is shorter than threshold / item length for all items isn't read (a filter on the
length column); chunks of what is read are skipped for each item by the same inequality of Cauchy and Schwarz.
*Coordinates.* In a chunk the item's terms of smallest possible contribution are set aside as long
as their sum stays below the threshold. A document must hold one of the other terms; only
their postings are opened. Its partial score plus a bound of the rest, the smaller of (length of the rest) x (item's rest)
and the summed maxima, must reach the threshold.
*Rescoring.* Survivors are scored whole in 64-bit integers. Bounds are doubles with a margin, so
that rounding can only let too many through.

The items are the stated query set. They go through in blocks of ``BLOCK_BYTES`` of distinct texts, each a
pass over the documents, so what is broadcast doesn't grow with either table.

Nulls and texts without terms are neither found nor find anything and don't count in N. Every row
is a document or an item of its own, rows that repeat an id or a text included; equal scores
are ranked by doc_id, a null doc_id last, and rows equal in both take consecutive ranks. Empty tables give no rows. Other
columns of the tables are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, Texts, longs_of, ranges, slices, texts_of, word_hashes, words_of
from .exchange import groups_of, stored

TOP = 10
BLOCK_BYTES = 1 << 20
SEED_DOCS = 4096  # the longest vectors, searched first
BUCKETS_PER_DOUBLING = 4
CHUNK_BYTES = 1 << 20  # of packed vectors
CELLS = 1 << 21  # items x documents looked at together
MARGIN = 1e-9
LAST = 2**63 - 1  # stands for a null doc_id

NOT_TERM = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    NOT_TERM[_low:_high] = False


@dataclass
class Items:
    """A block of item texts over their own vocabulary: item q has entries at[q]:at[q + 1]."""

    hashes: np.ndarray  # of the terms, ascending
    spelled: Texts  # the terms' folded bytes in the same order
    at: np.ndarray
    term: np.ndarray
    count: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def items_of(column: pa.Array) -> Items:
    texts = texts_of(column)
    words = words_of(texts, NOT_TERM)
    hashes = word_hashes(texts, words, LOWER)
    known, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    length = (words.end - words.start)[first]
    spelled = LOWER[texts.data[ranges(words.start[first], length)]]
    entry, count = np.unique(words.text_of_word() * max(len(known), 1) + term, return_counts=True)
    owner = entry // max(len(known), 1)
    return Items(
        known, Texts(spelled, np.r_[0, np.cumsum(length)]), np.searchsorted(owner, np.arange(len(texts) + 1)),
        entry % max(len(known), 1), count,
    )


def _found_terms(texts: Texts, words, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers that are terms of the items, compared byte by byte, and their term numbers."""
    if not len(items.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = word_hashes(texts, words, LOWER)
    term = np.minimum(np.searchsorted(items.hashes, hashes), len(items.hashes) - 1)
    start, length = items.spelled.at[term], np.diff(items.spelled.at)[term]
    word = np.flatnonzero((items.hashes[term] == hashes) & (words.end - words.start == length))
    if not len(word):
        return word, word
    length, start = length[word], start[word]
    same = LOWER[texts.data[ranges(words.start[word], length)]] == items.spelled.data[ranges(start, length)]
    same = np.logical_and.reduceat(same, np.cumsum(length) - length)
    return word[same], term[word[same]]


COUNTED = "doc long, n long, terms binary, tfs binary, term int, total long"


def _counted(documents: DataFrame, block) -> DataFrame:
    """Vectors of term frequencies; and per task, in rows with a term number, documents per term.

    Term -1 has the number of documents with terms, -2 the number of all their terms.
    """
    names = [c.split()[0] for c in COUNTED.split(", ")]

    def rows(batches):
        items = block.value
        size = max(len(items.hashes), 1)
        frequency, with_terms, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column("text"))
                words = words_of(texts, NOT_TERM)
                with_terms += int((words.per_text > 0).sum())
                total += len(words.start)
                word, term = _found_terms(texts, words, items)
                pair, tf = np.unique(words.text_of_word()[word] * size + term, return_counts=True)
                owner, term = pair // size, (pair % size).astype(np.uint32)
                frequency += np.bincount(term, minlength=size)
                s, e = groups_of(owner)
                own = owner[s]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(longs_of(part.column("doc_id"), LAST)[own]),
                        pa.array(words.per_text[own].astype(np.int64)),
                        pa.array([term[a:b].tobytes() for a, b in zip(s, e)], pa.binary()),
                        pa.array([tf[a:b].astype(np.uint32).tobytes() for a, b in zip(s, e)], pa.binary()),
                        pa.nulls(len(s), pa.int32()),
                        pa.nulls(len(s), pa.int64()),
                    ],
                    names,
                )
        held = np.flatnonzero(frequency)
        numbers, totals = np.r_[-1, -2, held], np.r_[with_terms, total, frequency[held]]
        none = [pa.nulls(len(numbers), t) for t in (pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [none[0], none[0], none[1], none[1], pa.array(numbers.astype(np.int32)), pa.array(totals.astype(np.int64))], names
        )

    return documents.mapInArrow(rows, COUNTED)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Contributions of terms, 64-bit integers: weight * ((10^9 tf) div (1000 tf + 8 m))."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


@dataclass
class Chunk:
    """Vectors of a chunk: document d has terms at[d]:at[d + 1], ascending."""

    doc: np.ndarray
    at: np.ndarray
    term: np.ndarray
    impact: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc)), np.diff(self.at))

    def norms(self) -> np.ndarray:
        return np.sqrt(np.bincount(self.owner, self.impact.astype(float) ** 2, minlength=len(self.doc)))


def _chunk(batch: pa.RecordBatch, weights: np.ndarray) -> Chunk:
    terms, tfs = texts_of(batch.column("terms")), texts_of(batch.column("tfs"))
    term = np.frombuffer(terms.data.tobytes(), np.uint32).astype(np.int64)
    tf = np.frombuffer(tfs.data.tobytes(), np.uint32).astype(np.int64)
    at = terms.at // 4
    m = np.repeat(longs_of(batch.column("m")), np.diff(at))
    return Chunk(longs_of(batch.column("doc"), LAST), at, term, impacts(weights[term], tf, m))


class Best:
    """The best k documents of every item so far, and the score that a further one must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()  # at least 1
        self.item = self.score = self.doc = np.zeros(0, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.r_[self.item, item], np.r_[self.score, score], np.r_[self.doc, doc]
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        s, e = groups_of(item)
        rank = np.arange(len(item)) - np.repeat(s, e - s)
        full = np.flatnonzero(rank == self.k - 1)
        self.least[item[full]] = np.maximum(self.least[item[full]], score[full])
        on = rank < self.k
        self.item, self.score, self.doc = item[on], score[on], doc[on]


def _search_chunk(chunk: Chunk, items: Items, item_norm: np.ndarray, best: Best) -> None:
    size = len(items.hashes)
    norm = chunk.norms()
    by_term = np.argsort(chunk.term, kind="stable")
    posted = np.searchsorted(chunk.term[by_term], np.arange(size + 1))
    owner = chunk.owner[by_term]
    impact = chunk.impact[by_term].astype(float)
    greatest = np.zeros(size)
    held = np.flatnonzero(np.diff(posted))
    greatest[held] = np.maximum.reduceat(impact, posted[held])
    place = chunk.owner * size + chunk.term
    active = np.flatnonzero(item_norm * norm.max() * (1 + MARGIN) >= best.least)
    step = max(1, CELLS // len(norm))
    for at in range(0, len(active), step):
        asked = active[at : at + step]
        lengths = np.diff(items.at)[asked]
        entry = ranges(items.at[asked], lengths)
        which = np.repeat(np.arange(len(asked)), lengths)
        count = items.count[entry].astype(float)
        most = count * greatest[items.term[entry]]
        # the terms of smallest contributions together stay below the threshold
        order = np.lexsort((most, which))
        run = np.cumsum(most[order])
        first = np.cumsum(lengths) - lengths
        run -= np.repeat(run[first] - most[order][first], lengths)
        below = np.zeros(len(entry), bool)
        below[order] = run * (1 + MARGIN) < best.least[asked][which[order]]
        rest_sum = np.bincount(which[below], most[below], minlength=len(asked))
        rest_norm = np.sqrt(np.bincount(which[below], count[below] ** 2, minlength=len(asked)))
        term, which, count = items.term[entry][~below], which[~below], count[~below]
        opened = posted[term + 1] - posted[term]
        post = ranges(posted[term], opened)
        cell = np.repeat(which, opened) * len(norm) + owner[post]
        part = np.bincount(cell, impact[post] * np.repeat(count, opened), minlength=len(asked) * len(norm))
        square = np.bincount(cell, impact[post] ** 2, minlength=len(part))
        cell = np.flatnonzero(part)
        which, doc = cell // len(norm), cell % len(norm)
        other = np.sqrt(np.maximum(norm[doc] ** 2 * (1 + MARGIN) - square[cell], 0))
        bound = part[cell] + np.minimum(rest_norm[which] * other, rest_sum[which])
        alive = bound * (1 + MARGIN) >= best.least[asked][which]
        which, doc = asked[which[alive]], doc[alive]
        # exact scores of the survivors
        lengths = np.diff(items.at)[which]
        entry = ranges(items.at[which], lengths)
        want = np.repeat(doc, lengths) * size + items.term[entry]
        found = np.minimum(np.searchsorted(place, want), len(place) - 1)
        value = np.where(place[found] == want, items.count[entry] * chunk.impact[found], 0)
        if not len(which):
            continue
        score = np.add.reduceat(value, np.cumsum(lengths) - lengths)
        good = score >= best.least[which]
        best.add(which[good], score[good], chunk.doc[doc[good]])


def _best_of(vectors: DataFrame, block, weights, least: np.ndarray, k: int) -> DataFrame:
    """(item, score, doc): of every task the best k documents that reach the items' thresholds."""

    def rows(batches):
        items = block.value
        item_norm = np.sqrt(np.bincount(items.owner, items.count.astype(float) ** 2, minlength=len(items.at) - 1))
        best = Best(least, k)
        for batch in batches:
            for part in slices(batch, "terms", CHUNK_BYTES):
                _search_chunk(_chunk(part, weights.value), items, item_norm, best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item.astype(np.int32)), pa.array(best.score), pa.array(best.doc)], ["item", "score", "doc"]
        )

    return _top(vectors.mapInArrow(rows, "item int, score long, doc long"), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of every item, first within parts of the items' rows."""
    order = [F.desc("score"), F.asc("doc")]
    part = F.pmod(F.xxhash64("doc"), F.lit(64))
    few = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
    few = few.where(F.col("rank") <= k).drop("part", "rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def _search_block(documents: DataFrame, texts: pa.Array, k: int) -> DataFrame:
    """(text, rank, doc_id, score) of a block of item texts."""
    spark = documents.sparkSession
    items = items_of(texts)
    block = spark.sparkContext.broadcast(items)
    counted, _ = stored(_counted(documents, block), "vectors")
    totals = counted.where("term is not null").groupBy("term").agg(F.sum("total").alias("total")).toArrow()
    totals = dict(zip(totals.column("term").to_pylist(), totals.column("total").to_pylist()))
    n, length = totals.get(-1, 0), max(totals.get(-2, 0), 1)
    values = np.array([weight(n, totals.get(t, 0)) for t in range(len(items.hashes))], np.int64)
    weights = spark.sparkContext.broadcast(values)
    # m = 100 - 75 + (75 * n * N) div L
    shares = counted.where("term is null").select("doc", F.expr(f"25L + (75L * n * {n}L) div {length}L").alias("m"), "terms", "tfs")

    def measured(batches):
        for batch in batches:
            for part in slices(batch, "terms", CHUNK_BYTES):
                norm = _chunk(part, weights.value).norms()
                bucket = np.floor(np.log2(np.maximum(norm, 1)) * BUCKETS_PER_DOUBLING).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(norm), pa.array(bucket)], [*part.schema.names, "norm", "bucket"])

    vectors = shares.mapInArrow(measured, "doc long, m long, terms binary, tfs binary, norm double, bucket int")
    vectors, _ = stored(vectors.where("norm > 0").sortWithinPartitions(F.desc("norm")), "impacts")
    sizes = vectors.groupBy("bucket").count().orderBy(F.desc("bucket")).collect()  # one row per length bucket
    seen, seeds = 0, 0
    for seeds, size in sizes:
        seen += size
        if seen >= SEED_DOCS:
            break
    least = np.ones(len(texts), np.int64)
    found, _ = stored(_best_of(vectors.where(F.col("bucket") >= seeds), block, weights, least, k), "found")
    last = found.where(F.col("rank") == k).select("item", "score").toArrow()
    least[last.column("item").to_numpy()] = last.column("score").to_numpy()
    item_norm = np.sqrt(np.bincount(items.owner, items.count.astype(float) ** 2, minlength=len(texts)))
    shortest = float((least / np.maximum(item_norm, 1)).min()) * (1 - MARGIN) if len(texts) else 0.0
    rest = vectors.where((F.col("bucket") < seeds) & (F.col("norm") >= shortest))
    found, _ = stored(found.drop("rank").unionByName(_best_of(rest, block, weights, least, k).drop("rank")), "found")
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(texts), dtype=np.int32)), "text": texts}))
    shown = F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id")
    return _top(found, k).join(names, "item").select("text", "rank", shown, "score")


def lexical_search(documents: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents(doc_id, text), items(item_id, text) -> item_id, rank, doc_id, score.

    Each item's ``k`` best documents of score above 0, best first, equal scores by doc_id.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    distinct, _ = stored(asked.select("text").distinct(), "items")
    total = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    ranked = []
    for b in range(blocks):
        texts = distinct.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).toArrow().column("text")
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        if len(texts):
            ranked.append(stored(_search_block(docs, texts.cast(pa.string()), k), "ranked")[0])
    if not ranked:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    found = ranked[0]
    for more in ranked[1:]:
        found = found.unionByName(more)
    return asked.join(found, "text").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), held AS (SELECT r, doc_id, terms, len(terms) AS n FROM texts WHERE len(terms) > 0
), whole AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM held
), asked AS (
  SELECT i, item_id, term, count(*) AS c FROM (
    SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark WHERE text IS NOT NULL)
  ) GROUP BY i, item_id, term
), counts AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM held) GROUP BY r, doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, all_docs
), scored AS (
  SELECT i, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), whole GROUP BY i, item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
