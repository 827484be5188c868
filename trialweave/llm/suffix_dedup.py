"""Removal of repeated bytes by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document with a smaller
doc_id. Strings are judged on the input, overlaps count, and matches never cross documents.

*Suffixes.* Each string has one anchor, its leftmost least-hashed ``ANCHOR``-gram, so equal strings have
it at the same offset. Only suffixes that start at anchors are sorted, about one in sixteen; each carries the bytes left of
it that its strings need.
*Distinguishing prefixes.* As in published string sorters, hashes of the anchors are exchanged first. A suffix whose anchor
no other document holds differs from all others within its first ``ANCHOR`` bytes; it needs no exchange.
*Runs.* A task sorts the suffixes of its texts and reduces equal ones to the smallest document:
the others are decided. The run is cut at sampled splitters and front-coded: per suffix the length of the prefix
shared with its predecessor, and the rest.
*Merge.* A loser tree per range combines the runs. A loser remembers how much it shares with the
winner that beat it, so comparisons begin behind known prefixes, and most are decided by two lengths alone.
*Windows.* In the merged order, suffixes that share LENGTH - o bytes are neighbours; those whose o bytes on the left are equal too
hold the same string. All but those of the smallest document are marked, after a comparison of the bytes.

Anchors with very many different surroundings would bring all of them to one range. Their strings
travel as suffixes of their own, which start at the string and need nothing on the left. An anchor has up to OFFSETS strings, so
this is kept for those whose surroundings would outweigh a usual range, however many texts hold the anchor.
Documents whose whole text has a copy with a smaller doc_id are decided by a 128-bit digest beforehand.

A null text is empty. A null doc_id is smaller than all others. Rows that repeat a doc_id don't remove each other's
bytes, each is judged on its own. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BYTE_KEYS, Texts, longs_of, mix, powers, ranges, slices, texts_of
from .exchange import PACKED, bitmap, groups_of, in_bitmap, partitions, squeezed, stored, unsqueezed

LENGTH = 50
ANCHOR = 20
OFFSETS = LENGTH - ANCHOR + 1  # of an anchor in a string
HOT_SLICES = 1 << 15  # different surroundings of an anchor, summed over slices of texts that are packed together
SLICE = 1 << 18  # bytes whose anchors are sought at once
PACKED_ANCHORS = 1 << 18  # anchors that a task packs at once
RUN = 1 << 17  # suffixes that a task sorts at once
DECODED = 1 << 14  # suffixes, at least, that are decoded at once
RANGES = 4  # of suffixes a task merges, one after the other
SAMPLED = 64  # anchors of a packed group that take part in choosing the splitters
SPLIT_SAMPLE = 1 << 15
NULL_ID = -(2**63)
KNOWN, SAMPLE = -1, -2  # buckets of rows that need no exchange


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD1342543DE82EF95
    return powers(n), powers(n, pow(base, -1, 1 << 64))


def _running(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of all bytes before each place, and what makes their differences independent of the place."""
    up, down = _powers(1 << max(18, len(data).bit_length()))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * up[: len(data)], out=run[1:])
    return run, down


def gram_sums(data: np.ndarray) -> np.ndarray:
    """A number for each ANCHOR consecutive bytes, from running sums."""
    run, down = _running(data)
    sums = run[ANCHOR:] - run[:-ANCHOR]
    sums *= down[: len(sums)]
    return sums


def gram_hashes_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the ANCHOR bytes at these places."""
    return mix((BYTE_KEYS[data[at[:, None] + np.arange(ANCHOR)]] * _powers(1 << 18)[0][:ANCHOR]).sum(1, dtype=np.uint64))


def anchors_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place in the text, least and greatest offset in the strings anchored here, and hash."""
    data, at = texts.data, texts.at
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    sums = gram_sums(data)
    keys = sums * np.uint64(0x9E3779B97F4A7C15)
    keys &= np.uint64(0xFFFFFFFF00000000)
    keys |= np.arange(len(keys), dtype=np.uint64)
    width = 1
    while 2 * width <= OFFSETS:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    if width < OFFSETS:
        keys = np.minimum(keys[: len(keys) - (OFFSETS - width)], keys[OFFSETS - width :])
    whole = np.zeros(n + 1, np.int8)  # 1 from where strings of a text start on, -1 behind
    fits = np.diff(at) >= LENGTH
    whole[at[:-1][fits]] += 1
    whole[at[1:][fits] - LENGTH + 1] -= 1
    start = np.flatnonzero(np.cumsum(whole[:-1], dtype=np.int8))
    place = (keys[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    s, e = groups_of(place)  # a place lies in one text
    place, first, last = place[s], start[s], start[e - 1]
    owner = np.searchsorted(at, place, "right") - 1
    return owner, place - at[owner], place - last, place - first, mix(sums[place])


def surroundings_of(texts: Texts, owner: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of all bytes that the strings of an anchor cover."""
    run, down = _running(texts.data)
    at = texts.at[owner] + place
    start = at - high
    return mix((run[at - low + LENGTH] - run[start]) * down[start] + (high << 8 | low).astype(np.uint64))


def _buckets(spark: SparkSession, n: int, each: int = 1) -> np.ndarray:
    """Ascending numbers of buckets, of which Spark deals ``each`` to every one of n tasks."""
    numbers = spark.range(0, n * (each + 40), 1, 1).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("task"))
    task = numbers.toArrow().column("task").to_numpy()
    order = np.argsort(task, kind="stable")
    s, e = groups_of(task[order])
    turn = np.arange(len(order)) - np.repeat(s, e - s)
    return np.sort(order[np.argsort(turn, kind="stable")[: n * each]]).astype(np.int32)


def _own(documents: DataFrame) -> DataFrame:
    """(doc, row, text): row names the doc_id and the text."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(doc.alias("doc"), F.xxhash64(doc, text).alias("row"), text.alias("text"))


def _dealt(packed: DataFrame, n: int) -> DataFrame:
    """Rows of one bucket together, in order; those that need no exchange anywhere."""
    bucket = F.col("bucket")
    return packed.repartition(n, F.when(bucket >= 0, bucket).otherwise(-1 - F.pmod(F.hash("packed"), F.lit(n)))).sortWithinPartitions("bucket")


def _packed(buckets: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """One compressed row per bucket; signed arrays are stored as differences."""
    order = np.argsort(buckets, kind="stable")
    own = buckets[order]
    s, e = groups_of(own)
    parts = []
    for a in arrays:
        a = a[order]
        if a.dtype.kind == "i":
            change = a.copy()
            change[1:] -= a[:-1]
            change[s] = a[s]
            a = change
        parts.append((memoryview(a.tobytes()), a.itemsize))
    blobs = [squeezed(b"".join(p[i * x : j * x] for p, x in parts)) for i, j in zip(s.tolist(), e.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(own[s].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "packed"])


def _unpacked(blobs: list[bytes], types: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays of packed rows, joined, and how many numbers each row had."""
    types = [np.dtype(t) for t in types]
    width = sum(t.itemsize for t in types)
    out: list[list[np.ndarray]] = [[] for _ in types]
    counts = []
    for blob in map(unsqueezed, blobs):
        n, at = len(blob) // width, 0
        counts.append(n)
        for k, t in enumerate(types):
            out[k].append(np.frombuffer(blob, t, n, at))
            at += n * t.itemsize
    counts = np.array(counts, np.int64)
    arrays = [np.concatenate(v) if v else np.zeros(0, t) for v, t in zip(out, types)]
    full = counts[counts > 0]
    starts = np.cumsum(full) - full
    for k, t in enumerate(types):
        if t.kind == "i" and len(full):
            total = np.cumsum(arrays[k], dtype=t)
            total -= np.repeat(np.r_[t.type(0), total[starts[1:] - 1]], full)
            arrays[k] = total
    return arrays, counts


def _ids(batch: pa.RecordBatch, repeated) -> np.ndarray:
    """A row's id: its doc_id, or, where that is repeated or null, the hash of doc_id and text."""
    doc = longs_of(batch.column("doc"))
    return np.where(in_bitmap(repeated.value, doc), longs_of(batch.column("row")), doc)


def _texts(column: pa.Array) -> Texts:
    """Texts that travelled compressed."""
    texts = [unsqueezed(x) for x in column.to_pylist()]
    return Texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))


def _told(doc: np.ndarray, row: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Rows of equal (doc, row) as one, with the parts' bytes one after the other."""
    order = np.lexsort((parts[0], row, doc))
    doc, row, parts = doc[order], row[order], [p[order] for p in parts]
    s = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])]) if len(row) else np.zeros(0, np.int64)
    e = np.r_[s[1:], len(row)]
    return doc[s], row[s], [b"".join(p[a:b].tobytes() for p in parts) for a, b in zip(s, e)]


def _untold(blobs: list[bytes], types: list[str]) -> list[np.ndarray]:
    """The parts of blobs that ``_told`` made, joined."""
    width = sum(np.dtype(t).itemsize for t in types)
    out: list[list[np.ndarray]] = [[] for _ in types]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for k, t in enumerate(types):
            out[k].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(v) if v else np.zeros(0, t) for v, t in zip(out, types)]


ANCHORS = "bucket int, packed binary, hot long, sample binary"
FOUND = ["i4", "u1", "u1"]  # place, least and greatest offset


def _anchor_rows(bucket=None, packed=None, hot=None, sample=None) -> pa.RecordBatch:
    given = ((bucket, pa.int32()), (packed, pa.binary()), (hot, pa.int64()), (sample, pa.binary()))
    n = next(len(v) for v, _ in given if v is not None)
    arrays = [pa.nulls(n, t) if v is None else v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in given]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "packed", "hot", "sample"])


def _anchor_id(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and 40 bits of the rest; together they name an anchor well enough to propose it."""
    return (key % np.uint64(buckets)).astype(np.int64), (key // np.uint64(buckets)) & np.uint64((1 << 40) - 1)


def _anchor_number(bucket, name):
    return name | np.asarray(bucket, np.uint64) << np.uint64(40)


def shared_anchors(texts: DataFrame, n: int, live: Callable, repeated) -> DataFrame:
    """Anchors that several texts hold, by text; ids of those in very many groups of texts; a sample of all.

    ``live`` drops rows of a batch in the same Python worker.
    """
    numbers = _buckets(texts.sparkSession, n)
    types = ["V5", "i8", "i4", "u1", "u1", "u2"]  # name, id, place, offsets, and different surroundings it stands for

    def send(batches):
        held: list[tuple] = []

        def flush():
            row, place, low, high, key, around = (np.concatenate(c) for c in zip(*(h[:6] for h in held)))
            order = np.argsort(key)
            s, e = groups_of(key[order])
            own = row[order]
            several = np.zeros(len(key), bool)
            several[order] = np.repeat(np.minimum.reduceat(own, s) != np.maximum.reduceat(own, s), e - s)
            sent = ~several
            sent[order[s]] = True  # one tells the others
            of = order[several[order]]
            of = of[np.lexsort((around[of], key[of]))]
            s, e = groups_of(key[of])
            count = np.ones(len(key), np.uint16)
            if len(s):
                other = np.r_[True, (key[of[1:]] != key[of[:-1]]) | (around[of[1:]] != around[of[:-1]])]
                count[of] = np.repeat(np.minimum(np.add.reduceat(other, s, dtype=np.int64), 0xFFFF), e - s)
            bucket, name = _anchor_id(key, n)
            name = np.ascontiguousarray(name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).view("V5").reshape(-1)
            carried = [name, row, place, low, high, count]
            yield _packed(numbers[bucket[sent]], [c[sent] for c in carried])
            if several.any():
                yield _packed(np.full(int(several.sum()), KNOWN), [c[several] for c in carried])
            sample = [x.tobytes() for h in held for x in h[6]]
            yield pa.RecordBatch.from_arrays([pa.array([SAMPLE] * len(sample), pa.int32()), pa.array(sample, pa.binary())], ["bucket", "packed"])
            held.clear()

        for batch in live(batches):
            for part in slices(batch, "text", SLICE):
                own = texts_of(part.column("text"))
                owner, place, low, high, key = anchors_of(own)
                if len(key):
                    least = np.argsort(key)[:SAMPLED]
                    strings = own.data[(own.at[owner[least]] + place[least])[:, None] + np.arange(ANCHOR)]
                    row = _ids(part, repeated)[owner]
                    around = surroundings_of(own, owner, place, low, high)
                    held.append((row, place.astype(np.int32), low.astype(np.uint8), high.astype(np.uint8), key, around, strings[:: max(1, len(held))]))
                if sum(len(h[0]) for h in held) >= PACKED_ANCHORS:
                    yield from flush()
        if held:
            yield from flush()

    def meet(batches):
        found, blobs, known = [], [], []
        for batch in batches:
            bucket = np.asarray(batch.column("bucket"))
            sample = batch.filter(pa.array(bucket == SAMPLE)).column("packed")
            if len(sample):
                yield _anchor_rows(sample=sample)
            known += batch.filter(pa.array(bucket == KNOWN)).column("packed").to_pylist()
            rest = batch.filter(pa.array(bucket >= 0))
            blobs += zip(rest.column("bucket").to_pylist(), rest.column("packed").to_pylist())
        found.append(_unpacked(known, types)[0][1:5])
        if blobs:
            number, packed = zip(*blobs)
            (name, *carried, count), sizes = _unpacked(list(packed), types)
            key = np.zeros((len(name), 8), np.uint8)
            key[:, :5] = np.ascontiguousarray(name).view(np.uint8).reshape(-1, 5)
            key = _anchor_number(np.repeat(np.searchsorted(numbers, number), sizes), key.view("<u8").reshape(-1))
            order = np.argsort(key)
            key, own = key[order], carried[0][order]
            s, e = groups_of(key)
            on = order[np.repeat(np.minimum.reduceat(own, s) != np.maximum.reduceat(own, s), e - s)]
            found.append([c[on] for c in carried])
            hot = key[s[np.add.reduceat(count[order], s, dtype=np.int64) > HOT_SLICES]]
            if len(hot):
                yield _anchor_rows(hot=hot.view(np.int64))
        ids, *carried = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((carried[0], ids))
        batch = _packed(numbers[(mix(ids[order].view(np.uint64)) % np.uint64(n)).astype(np.int64)], [c[order] for c in (ids, *carried)])
        yield _anchor_rows(batch.column("bucket"), batch.column("packed"))

    return _dealt(texts.mapInArrow(send, PACKED), n).mapInArrow(meet, ANCHORS)


def places_of(anchors: DataFrame, n: int) -> DataFrame:
    """(id, found): a row per text; one per text and task of the exchange before would grow as their product."""

    def gather(batches):
        (ids, *carried), _ = _unpacked([x for batch in batches for x in batch.column("packed").to_pylist()], ["i8", *FOUND])
        if len(ids):
            _, ids, told = _told(np.zeros(len(ids), np.int64), ids, carried)
            for at in range(0, len(ids), 1 << 14):
                end = at + (1 << 14)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:end]), pa.array(told[at:end], pa.binary())], ["id", "found"])

    dealt = anchors.where("bucket is not null").select("bucket", "packed").repartition(n, "bucket")
    return dealt.mapInArrow(gather, "id long, found binary")


def _with_blobs(texts: DataFrame, told: DataFrame, bits, on: list[str], repeated) -> DataFrame:
    """(doc, row, id, text, found): compressed texts in the bitmap with all that was told about them, null where nothing was.

    Others aren't shuffled.
    """

    def may_have(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bits.value, _ids(batch, repeated))))
            for part in slices(batch, "text"):
                own = texts_of(part.column("text"))
                blobs = [squeezed(own.part(t)) for t in range(len(own))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("row"), pa.array(_ids(part, repeated)), pa.array(blobs, pa.binary())],
                    ["doc", "row", "id", "text"],
                )

    lists = told.groupBy(*on).agg(F.collect_list("found").alias("found"))
    found = texts.mapInArrow(may_have, "doc long, row long, id long, text binary")
    return found.join(lists.hint("shuffle_hash"), on, "left")


class Suffixes:
    """Suffixes as rows of bytes: LENGTH to the right, then OFFSETS - 1 to the left, nearest first."""

    def __init__(self, right, left, low, high, doc, row, place):
        self.right, self.left, self.low, self.high, self.doc, self.row, self.place = right, left, low, high, doc, row, place

    @property
    def columns(self):
        return self.right, self.left, self.low, self.high, self.doc, self.row, self.place

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, at) -> Suffixes:
        return Suffixes(*(c[at] for c in self.columns))

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate(c) for c in zip(*(p.columns for p in parts))))

    def masks(self) -> np.ndarray:
        """A bit for every offset of a string."""
        return (np.int64(2) << self.high.astype(np.int64)) - (np.int64(1) << self.low.astype(np.int64))


def suffixes_of(texts: Texts, doc: np.ndarray, row: np.ndarray, found: list, hot: np.ndarray, buckets: int) -> Suffixes:
    """Suffixes at the anchors found in the texts; hot ones give one for each of their strings."""
    parts = [_untold(x or [], FOUND) for x in found]
    owner = np.repeat(np.arange(len(texts)), [len(p[0]) for p in parts])
    place, low, high = (np.concatenate(c).astype(np.int64) for c in zip(*parts))
    bucket, name = _anchor_id(gram_hashes_at(texts.data, texts.at[owner] + place), buckets)
    often = in_bitmap(hot, _anchor_number(bucket.astype(np.uint64), name).view(np.int64))
    count = np.where(often, high - low + 1, 1)
    offset = ranges(np.where(often, low, 0), count)  # back from the anchor
    owner, place, low, high, often = (np.repeat(v, count) for v in (owner, place, low, high, often))
    place = place - offset
    low, high = np.where(often, 0, low), np.where(often, 0, high)
    at = texts.at[owner] + place
    j = np.arange(LENGTH)
    right = np.where(j < (LENGTH - low)[:, None], texts.data[np.minimum(at[:, None] + j, len(texts.data) - 1)], 0).astype(np.uint8)
    j = np.arange(OFFSETS - 1)
    left = np.where(j < high[:, None], texts.data[np.maximum(at[:, None] - 1 - j, 0)], 0).astype(np.uint8)
    return Suffixes(right, left, low.astype(np.uint8), high.astype(np.uint8), doc[owner], row[owner], place.astype(np.int32))


def _order(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").reshape(-1), kind="stable")


def shared_with_previous(rows: np.ndarray) -> np.ndarray:
    """Lengths of the prefixes that sorted rows share with the rows before them."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def sorted_run(suffixes: Suffixes) -> tuple[Suffixes, Suffixes]:
    """The sorted run without what a smaller document of the run holds too, and that rest."""
    whole = np.concatenate([suffixes.right, suffixes.low[:, None], suffixes.high[:, None], suffixes.left], 1)
    order = _order(whole)
    run, whole = suffixes.take(order), whole[order]
    s, e = groups_of(np.cumsum(shared_with_previous(whole) < whole.shape[1]))
    least = np.repeat(np.minimum.reduceat(run.doc, s), e - s) if len(s) else run.doc
    first = run.doc == least
    return run.take(first), run.take(~first)


def front_coded_pieces(run: Suffixes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Consecutive pieces of a sorted run: shared lengths, the rest of each suffix, and what it carries."""
    shared = shared_with_previous(run.right).astype(np.uint8)
    shared[starts] = 0
    j = np.arange(LENGTH)
    rest = run.right[(j >= shared[:, None]) & (j < LENGTH - run.low[:, None])]
    left = run.left[np.arange(OFFSETS - 1) < run.high[:, None]]
    rest_at = np.r_[0, np.cumsum(np.maximum(LENGTH - run.low.astype(np.int64) - shared, 0))]
    left_at = np.r_[0, np.cumsum(run.high, dtype=np.int64)]
    heads = np.stack([ends - starts, rest_at[ends] - rest_at[starts], left_at[ends] - left_at[starts]], 1).astype(np.int64)

    def each(values: np.ndarray, at: np.ndarray | None = None) -> list[memoryview]:
        flat, size = memoryview(np.ascontiguousarray(values).tobytes()), values.itemsize
        own = (starts, ends) if at is None else (at[starts], at[ends])
        return [flat[a * size : b * size] for a, b in zip(own[0].tolist(), own[1].tolist())]

    parts = (each(shared), each(run.low), each(run.high), each(rest, rest_at), each(left, left_at), each(run.doc), each(run.row ^ run.doc), each(run.place))
    return [squeezed(b"".join((head.tobytes(), *own))) for head, *own in zip(heads, *parts)]


def front_coded(run: Suffixes) -> bytes:
    """A whole sorted run as one piece."""
    return front_coded_pieces(run, np.zeros(1, np.int64), np.array([len(run)]))[0] if len(run) else squeezed(bytes(24))


def _decoded(blobs: list[bytes]) -> tuple[Suffixes, np.ndarray]:
    """Suffixes and shared lengths of uncompressed pieces; the first of each shares nothing, so they decode as one."""
    parts = []
    for blob in blobs:
        n, n_rest, n_left = np.frombuffer(blob, np.int64, 3).tolist()
        own, at = [], 24
        for kind, size in ((np.uint8, n), (np.uint8, n), (np.uint8, n), (np.uint8, n_rest), (np.uint8, n_left), (np.int64, n), (np.int64, n), (np.int32, n)):
            own.append(np.frombuffer(blob, kind, size, at))
            at += own[-1].nbytes
        parts.append(own)
    shared, low, high, rest, left, doc, row, place = (np.concatenate(c) for c in zip(*parts))
    n = len(shared)
    j = np.arange(LENGTH)
    right = np.zeros((n, LENGTH), np.uint8)
    right[(j >= shared[:, None]) & (j < LENGTH - low[:, None])] = rest
    # a byte within the shared prefix is that of the last suffix which brought one there
    source = np.where(shared[:, None] > j, 0, np.arange(n, dtype=np.int32)[:, None])
    right = np.take_along_axis(right, np.maximum.accumulate(source, axis=0), axis=0)
    lefts = np.zeros((n, OFFSETS - 1), np.uint8)
    lefts[np.arange(OFFSETS - 1) < high[:, None]] = left
    return Suffixes(right, lefts, low, high, doc, row ^ doc, place), shared.astype(np.int64)


def decoded_pieces(blobs: list[bytes]) -> tuple[Suffixes, np.ndarray, list[int]]:
    """All pieces one after the other, the shared lengths, and where the pieces begin and end."""
    found, held, count, at = [], [], 0, [0]
    for blob in map(unsqueezed, blobs):
        size = int.from_bytes(blob[:8], "little")
        held.append(blob)
        at.append(at[-1] + size)
        count += size
        if count >= DECODED:
            found.append(_decoded(held))
            held, count = [], 0
    if held:
        found.append(_decoded(held))
    parts, shared = zip(*found)
    return Suffixes.joined(list(parts)), np.concatenate(shared), at


def decoded(blob: bytes) -> tuple[Suffixes, np.ndarray]:
    """The piece, and the shared lengths."""
    return decoded_pieces([blob])[:2]


def merged(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Loser tree over sorted runs: run and place of every string in order, and the prefix it shares with the one before.

    ``common[r]`` is what run r's head shares with the string it was last beaten by, -1 for an ended run.
    Of two heads that lost to the same string the one that shares more with it is the smaller; only
    at equal lengths bytes are compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads = [r[0] if r else b"" for r in runs] + [b""] * (size - len(runs))
    common = [0 if r else -1 for r in runs] + [-1] * (size - len(runs))
    place, ends = [0] * size, [len(r) for r in runs] + [0] * (size - len(runs))

    def loses(a: int, b: int) -> bool:
        """Whether a, of as much in common with the last string as b, is greater; the loser's length is updated."""
        x, y = heads[a], heads[b]
        i, end = common[a], len(x)
        while i < end and x[i] == y[i]:
            i += 1
        if i < end and x[i] > y[i]:
            common[a] = i
            return True
        common[b] = i
        return False

    loser = [0] * size
    winners = list(range(size))
    level = size
    while level > 1:  # the first matches
        level //= 2
        following = []
        for i in range(level):
            a, b = winners[2 * i], winners[2 * i + 1]
            if common[b] > common[a] or common[a] >= 0 and common[a] == common[b] and loses(a, b):
                a, b = b, a
            loser[level + i] = b
            following.append(a)
        winners = following
    w = winners[0]
    out_run, out_place, out_shared = [], [], []
    while common[w] >= 0:
        out_run.append(w)
        out_place.append(place[w])
        out_shared.append(common[w])
        place[w] += 1
        i = place[w]
        if i < ends[w]:
            heads[w], mine = runs[w][i], shared[w][i]
        else:
            mine = -1
        common[w] = mine
        node = (size + w) >> 1
        if mine == LENGTH:
            continue  # equal to the last string: nothing is smaller
        while node:
            other = loser[node]
            theirs = common[other]
            if theirs > mine or theirs == mine and mine >= 0 and loses(w, other):
                loser[node], w = w, other
                mine = common[w]
            node >>= 1
    return out_run, out_place, out_shared


def repeated_strings(suffixes: Suffixes, shared: np.ndarray) -> np.ndarray:
    """For sorted suffixes a bit for each offset whose string a smaller document holds too."""
    masks = np.zeros(len(suffixes), np.int64)
    left = np.zeros(len(suffixes), np.uint64)
    for o in range(OFFSETS):
        if o:
            left = mix(left ^ BYTE_KEYS[suffixes.left[:, o - 1]])
        on = np.flatnonzero((suffixes.low <= o) & (o <= suffixes.high))
        group = np.cumsum(shared < LENGTH - o)[on]
        key = mix(left[on] + mix(group.astype(np.uint64)))
        order = np.lexsort((suffixes.doc[on], key))
        on, key, group = on[order], key[order], group[order]
        s, e = groups_of(key)
        first = np.repeat(s, e - s)
        later = suffixes.doc[on] > suffixes.doc[on[first]]
        at, least = on[later], on[first[later]]
        same = (group[later] == group[first[later]]) & (suffixes.left[at, :o] == suffixes.left[least, :o]).all(1)
        masks[at[same]] |= 1 << o
    return masks


STARTS = "doc long, id long, found binary"
MARKED = ["i4", "i4"]  # place and mask


def repeated_starts(texts: DataFrame, anchors: DataFrame, places: DataFrame, bits, hot, repeated, n: int) -> DataFrame:
    """(doc, id, found): places and masks of suffixes that hold strings of smaller documents."""
    sample = anchors.where("sample is not null").select("sample").orderBy(F.xxhash64("sample"), "sample").limit(SPLIT_SAMPLE)
    strings = np.unique(np.array(sample.toArrow().column("sample").to_pylist(), f"S{ANCHOR}"))
    cuts = strings[np.linspace(0, len(strings), RANGES * n + 1).astype(int)[1:-1]] if len(strings) else strings
    splitters = np.unique(cuts).astype(f"S{LENGTH}")
    ranges_, numbers = _buckets(texts.sparkSession, n, RANGES), _buckets(texts.sparkSession, n)

    def send(batches):
        held: list[Suffixes] = []

        def flush():
            run, rest = sorted_run(Suffixes.joined(held))
            to = np.searchsorted(splitters, np.ascontiguousarray(run.right).view(f"S{LENGTH}").reshape(-1), "right")
            s, e = groups_of(to)
            pieces = front_coded_pieces(run, s, e)
            yield pa.RecordBatch.from_arrays([pa.array(ranges_[to[s]]), pa.array(pieces, pa.binary())], ["bucket", "packed"])
            if len(rest):
                rest = rest.take(np.lexsort((rest.place, rest.row)))
                yield _packed(np.full(len(rest), KNOWN), [rest.doc, rest.row, rest.place, rest.masks().astype(np.int32)])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text", SLICE // 2):  # compressed
                found = part.column("found").to_pylist()
                own = _texts(part.column("text"))
                held.append(suffixes_of(own, longs_of(part.column("doc")), longs_of(part.column("id")), found, hot.value, n))
                if sum(map(len, held)) >= RUN:
                    yield from flush()
        if held:
            yield from flush()

    def merge(blobs: list[bytes]) -> list[np.ndarray]:
        whole, shared, at = decoded_pieces(blobs)
        flat, shared = whole.right.tobytes(), shared.tolist()
        strings = [flat[i : i + LENGTH] for i in range(0, len(flat), LENGTH)]
        runs = list(zip(at[:-1], at[1:]))
        run, place, lengths = merged([strings[a:b] for a, b in runs], [shared[a:b] for a, b in runs])
        whole = whole.take(np.array(at, np.int64)[np.array(run, np.int64)] + np.array(place, np.int64))
        masks = repeated_strings(whole, np.array(lengths, np.int64))
        on = np.flatnonzero(masks)
        return [whole.doc[on], whole.row[on], whole.place[on], masks[on].astype(np.int32)]

    def meet(batches):
        bucket, blobs, known = None, [], []
        marks = [[np.zeros(0, t)] for t in ("i8", "i8", "i4", "i4")]

        def keep(found):
            for list_, part in zip(marks, found):
                list_.append(part)

        for batch in batches:
            for own, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                if own == KNOWN:
                    known.append(blob)
                    continue
                if own != bucket and blobs:
                    keep(merge(blobs))
                    blobs = []
                bucket = own
                blobs.append(blob)
        if blobs:
            keep(merge(blobs))
        keep(_unpacked(known, ["i8", "i8", *MARKED])[0])
        doc, ids, *carried = map(np.concatenate, marks)
        order = np.lexsort((carried[0], ids))
        to = (mix(ids[order].view(np.uint64)) % np.uint64(n)).astype(np.int64)
        yield _packed(numbers[to], [c[order] for c in (doc, ids, *carried)])

    def gather(batches):
        """A row per document: one per document and range would grow as their product."""
        (doc, ids, *carried), _ = _unpacked([x for batch in batches for x in batch.column("packed").to_pylist()], ["i8", "i8", *MARKED])
        if len(ids):
            doc, ids, told = _told(doc, ids, carried)
            for at in range(0, len(ids), 1 << 14):
                end = at + (1 << 14)
                yield pa.RecordBatch.from_arrays([pa.array(doc[at:end]), pa.array(ids[at:end]), pa.array(told[at:end], pa.binary())], ["doc", "id", "found"])

    near = _with_blobs(texts, places, bits, ["id"], repeated).where("found is not null")
    marked = _dealt(near.select("doc", "id", "text", "found").mapInArrow(send, PACKED), n).mapInArrow(meet, PACKED)
    return marked.repartition(n, "bucket").mapInArrow(gather, STARTS)


def removed_bytes(size: int, found: list[bytes] | None) -> np.ndarray:
    """Flags of the bytes covered by marked strings."""
    change = np.zeros(size + 1, np.int64)
    if found:
        place, mask = _untold(found, MARKED)
        offset, at = np.nonzero(mask >> np.arange(OFFSETS)[:, None] & 1)
        start = place[at] - offset
        np.add.at(change, start, 1)
        np.add.at(change, start + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _copies(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, row) of texts, and (doc, row, n_bytes) of those that a smaller document equals."""
    rows = texts.select("doc", "row", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows, _ = stored(rows, "digests")
    first = rows.where(f"n_bytes >= {LENGTH}").groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    first = first.where("least < most").select("digest", "least")
    copies = rows.join(first, "digest").where("doc > least").select("doc", "row", "n_bytes")
    return rows.select("doc", "row"), stored(copies, "copies")[0]


def suffix_dedup(documents: DataFrame, as_bytes: bool = False) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans and the kept bytes or their digest, per row.

    With ``as_bytes`` the last column is ``kept`` (binary: a cut may split a character), else
    ``kept_sha256`` (lowercase hex). ``n_spans`` counts maximal removed runs.
    """
    n = partitions(documents)
    everything = _own(documents)
    rows, copies = _copies(everything)
    counts = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    repeated = bitmap(counts.where((F.col("n") > 1) | (F.col("doc") == NULL_ID)), "doc")
    copied = bitmap(copies, "row")

    def marked(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(copied.value, longs_of(batch.column("row")))))

    # rows that only share a bit with a copy
    spared = rows.mapInArrow(marked, "doc long, row long").join(copies.select("doc", "row").distinct(), ["doc", "row"], "left_anti")
    spared = bitmap(spared, "row")

    def live(batches):
        for batch in batches:
            row = longs_of(batch.column("row"))
            yield batch.filter(pa.array(~in_bitmap(copied.value, row) | in_bitmap(spared.value, row)))

    anchors, _ = stored(shared_anchors(everything, n, live, repeated), "anchors")
    hot = bitmap(anchors.where("hot is not null"), "hot")
    places, _ = stored(places_of(anchors, n), "places")
    shared = bitmap(places, "id")
    starts, _ = stored(repeated_starts(everything, anchors, places, shared, hot, repeated, n), "starts")
    bits = bitmap(starts, "id")
    last = "kept" if as_bytes else "kept_sha256"
    schema = f"doc long, row long, n_bytes long, n_removed long, n_spans long, {last} {'binary' if as_bytes else 'string'}"

    def finish(batches, judged: bool):
        for batch in batches if judged else live(batches):
            if not judged:
                batch = batch.filter(pa.array(~in_bitmap(bits.value, _ids(batch, repeated))))
            for part in slices(batch, "text"):
                own = _texts(part.column("text")) if judged else texts_of(part.column("text"))
                found = part.column("found").to_pylist() if judged else [None] * len(own)
                removed, spans, kept = [], [], []
                for t, places in enumerate(found):
                    text = own.data[own.at[t] : own.at[t + 1]]
                    gone = removed_bytes(len(text), places) if places else np.zeros(len(text), bool)
                    removed.append(int(gone.sum()))
                    spans.append(int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum()))
                    left = text[~gone].tobytes() if places else text.tobytes()
                    kept.append(left if as_bytes else hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"), part.column("row"), pa.array(np.diff(own.at)), pa.array(removed, pa.int64()),
                        pa.array(spans, pa.int64()), pa.array(kept, pa.binary() if as_bytes else pa.string()),
                    ],
                    [c.split()[0] for c in schema.split(", ")],
                )

    # copies that get here by a shared bit go with the last join
    hit = _with_blobs(everything, starts, bits, ["doc", "id"], repeated).select("doc", "row", "text", "found")
    done = hit.mapInArrow(lambda b: finish(b, True), schema).unionByName(everything.mapInArrow(lambda b: finish(b, False), schema))
    done = done.join(copies.select("doc", "row").distinct(), ["doc", "row"], "left_anti")
    nothing = F.lit(b"") if as_bytes else F.lit(hashlib.sha256(b"").hexdigest())
    whole = copies.select("doc", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), nothing.alias(last))
    shown = F.when(F.col("doc") > NULL_ID, F.col("doc")).alias("doc_id")
    return done.drop("row").unionByName(whole).select(shown, "n_bytes", "n_removed", "n_spans", last)
