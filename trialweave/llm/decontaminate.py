"""Benchmark decontamination by greedy string tiling.

Texts and items are sequences of alphanumeric runs in lower case. Windows of ``TILE`` words are
hashed in a rolling manner; those of a text that some item shares are its seeds. For a text and an
item that share seeds, the longest common run of unmarked words is marked as a tile again and
again, until none of at least ``TILE`` words is left; no word is in two tiles. The tiles may come
in any order, so reordered passages count in full. The item is contained if its tiles cover at
least ``COVERAGE`` of its words.

The items are the stated query set: they go to the texts in blocks of bounded bytes, each block
broadcast, and no text is shuffled. Items of fewer than ``TILE`` words can't be tested and match
nothing. Nulls and empty texts match nothing; repeated rows are judged each on its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import FINE_SLICE, LOWER, slices, texts_of, window_hashes, window_starts, word_hashes, words_of

TILE = 4
COVERAGE = 0.6
BLOCK_BYTES = 8 << 20

NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False


@dataclass(frozen=True)
class Items:
    """A block of items: their word hashes, and their windows sorted by hash."""

    ids: list
    words: list[np.ndarray]
    key: np.ndarray
    item: np.ndarray
    place: np.ndarray


def items_of(ids: list, column: pa.Array) -> Items:
    texts = texts_of(column)
    words = words_of(texts, NOT_WORD)
    hashes = word_hashes(texts, words, LOWER)
    starts, count = window_starts(words, TILE)
    key = window_hashes(hashes, TILE)[starts] if len(starts) else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(texts)), count)
    order = np.argsort(key, kind="stable")
    place = (starts - words.at[:-1][item])[order] if len(starts) else starts
    parts = [hashes[words.at[t] : words.at[t + 1]] for t in range(len(texts))]
    return Items(ids, parts, key[order], item[order], place)


def blocks_of(benchmark: DataFrame, size: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of about ``size`` bytes (one item at least)."""
    ids, texts, held = [], [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string")).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        held += len((row[1] or "").encode()) + 64
        if held >= size:
            yield items_of(ids, pa.array(texts, pa.string()))
            ids, texts, held = [], [], 0
    if ids:
        yield items_of(ids, pa.array(texts, pa.string()))


def tiles_of(in_text: np.ndarray, in_item: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, length) from seed pairs of ``least`` words.

    Seeds on one diagonal that follow each other are one common run; the heap gives the longest.
    A run that a longer tile has cut is put back as what is left of it.
    """
    order = np.lexsort((in_text, in_item - in_text))
    i, j = in_text[order], in_item[order]
    new = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(i) != 1)])
    length = np.diff(np.r_[new, len(i)]) + least - 1
    heap = [(-int(n), int(j[a]), int(i[a])) for a, n in zip(new, length)]
    heapq.heapify(heap)
    text_taken: set[int] = set()
    item_taken: set[int] = set()
    out = []
    while heap:
        n, b, a = heapq.heappop(heap)
        free = [k for k in range(-n) if a + k not in text_taken and b + k not in item_taken]
        if len(free) == -n:
            text_taken.update(range(a, a - n))
            item_taken.update(range(b, b - n))
            out.append((a, b, -n))
        elif len(free) >= least:
            at = 0
            for k in range(1, len(free) + 1):
                if k == len(free) or free[k] != free[k - 1] + 1:
                    if k - at >= least:
                        heapq.heappush(heap, (-(k - at), b + free[at], a + free[at]))
                    at = k
    return out


def contained(part: pa.RecordBatch, items: Items, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(row, item, tiles, covered words, item's words) of items that texts of the batch contain."""
    texts = texts_of(part.column("text"))
    words = words_of(texts, NOT_WORD)
    starts, count = window_starts(words, TILE)
    if not len(starts) or not len(items.key):
        return []
    key = window_hashes(word_hashes(texts, words, LOWER), TILE)[starts]
    low = np.searchsorted(items.key, key, "left")
    hit = np.flatnonzero((low < len(items.key)) & (items.key[np.minimum(low, len(items.key) - 1)] == key))
    if not len(hit):
        return []
    number = np.searchsorted(items.key, key[hit], "right") - low[hit]
    owner = np.repeat(np.arange(len(texts)), count)[hit]
    place = starts[hit] - words.at[:-1][owner]
    entry = np.repeat(low[hit] - (np.cumsum(number) - number), number) + np.arange(number.sum())
    row, item = np.repeat(owner, number), items.item[entry]
    in_text, in_item = np.repeat(place, number), items.place[entry]
    order = np.lexsort((item, row))
    row, item, in_text, in_item = row[order], item[order], in_text[order], in_item[order]
    cuts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
    out = []
    for s, e in zip(cuts, np.r_[cuts[1:], len(row)]):
        size = len(items.words[item[s]])
        # tiles can't cover more words than the seeds do
        if np.unique(in_item[s:e]).size * TILE >= coverage * size:
            tiles = tiles_of(in_text[s:e], in_item[s:e])
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * size:
                out.append((int(row[s]), int(item[s]), len(tiles), covered, size))
    return out


def find_contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered_words, item_words, coverage) of contained items."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_tiles long, covered_words long, item_words long, coverage double"
    spark = docs.sparkSession

    def found(items):
        def rows(batches):
            for batch in batches:
                for part in slices(batch, "text", FINE_SLICE):
                    hits = contained(part, items.value, coverage)
                    at = pa.array([h[0] for h in hits], pa.int64())
                    numbers = [pa.array([h[k] for h in hits], pa.int64()) for k in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(at),
                            pa.array([items.value.ids[h[1]] for h in hits], pa.int64()),
                            *numbers,
                            pa.array([round(h[3] / h[4], 6) for h in hits], pa.float64()),
                        ],
                        ["doc_id", "item_id", "n_tiles", "covered_words", "item_words", "coverage"],
                    )

        return docs.mapInArrow(rows, schema)

    tables = [found(spark.sparkContext.broadcast(b)) for b in blocks_of(benchmark)]
    return reduce(DataFrame.union, tables) if tables else spark.createDataFrame([], schema)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of documents, all columns, that contain no item."""
    sc = documents.sparkSession.sparkContext

    def without(items):
        def rows(batches):
            for batch in batches:
                for part in slices(batch, "text", FINE_SLICE):
                    bad = np.zeros(part.num_rows, bool)
                    bad[[h[0] for h in contained(part, items.value, coverage)]] = True
                    yield part.filter(pa.array(~bad))

        return rows

    for block in blocks_of(benchmark):
        documents = documents.mapInArrow(without(sc.broadcast(block)), documents.schema)
    return documents
