"""Removal of repeated passages by difference-cover anchors.

Of every run of ``WINDOW`` words that occurs more than once in the corpus, all occurrences but the
first (smallest document, then earliest place) are removed. Windows are judged on the input.

*Anchors.* Positions whose remainder modulo ``PERIOD`` is in a perfect difference cover are hashed,
``ANCHOR`` words each. For two places i, j of the same window there is a shift below the period that
brings both onto the cover, and the shifted anchor still lies inside the window
(``PERIOD - 1 + ANCHOR = WINDOW``), so equal windows always share an equal anchor.
*Extension.* Only windows around an anchor that occurs twice are hashed whole, and only those meet
their copies; the smallest place of each hash stays.

An anchor or window that a slice of texts holds many times is sent once per slice: the sender
already knows that its other places repeat. So a passage in a third of all documents costs its
bucket one entry per slice. Texts are shuffled only if a bitmap says they may hold a repeat.

Nulls and empty texts have no words and lose none. Rows that repeat a doc_id are judged each on its
own: a row's window is removed if it also starts at a smaller (doc_id, place), so two identical
rows with one doc_id keep the same words. A null doc_id counts as smaller than all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Texts, Words, longs_of, mix, ranges, slices, texts_of, window_hashes, window_starts, word_hashes, words_of
from .exchange import PACKED, bitmap, dealt, groups_of, in_bitmap, pack, partitions, stored, unpack

PERIOD = 13
COVER = (0, 1, 3, 9)  # every difference modulo 13 once
ANCHOR = 8
WINDOW = PERIOD - 1 + ANCHOR
KEEP_BITS = 48  # of an anchor's hash, beside its bucket: equal anchors only propose windows

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _split_places(doc: np.ndarray, text: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """A row per place: one per document and task would grow as documents times tasks."""
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(text), pa.array(place.astype(np.int32))], ["doc", "text_hash", "place"]
    )


PLACES = "doc long, text_hash long, place int"


def _anchors(documents: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors; bucket -1 holds those that the slice itself repeats."""

    def send(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column("text"))
                doc, text_hash = longs_of(part.column("doc_id")), longs_of(part.column("text_hash"))
                words = words_of(texts)
                starts, count = window_starts(words, ANCHOR)
                owner = np.repeat(np.arange(len(texts)), count)
                place = starts - words.at[:-1][owner]
                on = np.isin(place % PERIOD, COVER)
                starts, owner, place = starts[on], owner[on], place[on].astype(np.int32)
                key = window_hashes(word_hashes(texts, words), ANCHOR)[starts] if len(starts) else np.zeros(0, np.uint64)
                order = np.argsort(key, kind="stable")
                s, e = groups_of(key[order])
                several = np.repeat(e - s > 1, e - s)
                known = np.zeros(len(key), bool)
                known[order] = several
                first = np.zeros(len(key), bool)
                first[order[s]] = True
                yield pack(
                    (key[first] % np.uint64(buckets)).astype(np.int64),
                    [_six(key[first] // np.uint64(buckets)), doc[owner[first]], text_hash[owner[first]], place[first]],
                )
                if known.any():
                    yield pack(
                        np.full(int(known.sum()), -1),
                        [_six(key[known] // np.uint64(buckets)), doc[owner[known]], text_hash[owner[known]], place[known]],
                    )

    return documents.mapInArrow(send, PACKED)


def _six(hashes: np.ndarray) -> np.ndarray:
    """The low 48 bits as six-byte items."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").reshape(-1)


def _eight(items: np.ndarray) -> np.ndarray:
    out = np.zeros((len(items), 8), np.uint8)
    out[:, :6] = np.ascontiguousarray(items).view(np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def repeated_anchors(documents: DataFrame) -> DataFrame:
    """(doc, text_hash, place): places of anchors that occur more than once."""
    n = partitions(documents)
    buckets = 4 * n

    def meet(batches):
        found: list[pa.RecordBatch] = []

        def sent():
            for b in batches:
                own = np.asarray(b.column("bucket")) == -1
                if own.any():
                    found.append(b.filter(pa.array(own)))
                yield b.filter(pa.array(~own)), own

        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for b, _ in sent():
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("packed").to_pylist()):
                k, d, t, p = unpack(iter([pa.RecordBatch.from_pydict({"packed": [blob]})]), ["V6", "i8", "i8", "i4"])
                for at, v in enumerate((_eight(k), d, t, p, np.full(len(d), bucket))):
                    parts[at].append(v)
        if parts[0]:
            key, doc, text, place, bucket = (np.concatenate(v) for v in parts)
            order = np.lexsort((key, bucket))
            key = key[order] ^ mix(bucket[order].astype(np.uint64))
            s, e = groups_of(key)
            many = np.repeat(e - s > 1, e - s)
            doc, text, place = doc[order][many], text[order][many], place[order][many]
            order = np.lexsort((text, doc))
            yield _split_places(doc[order], text[order], place[order])
        for b in found:
            _, doc, text, place = unpack(iter([b]), ["V6", "i8", "i8", "i4"])
            order = np.lexsort((text, doc))
            yield _split_places(doc[order], text[order], place[order])

    packed = _anchors(documents, buckets)
    spread = packed.repartition(
        n, F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.hash("packed"), F.lit(n)))
    )
    return spread.mapInArrow(meet, PLACES)


def _with_places(documents: DataFrame, places: DataFrame, bits, how: str) -> DataFrame:
    """Texts that have places, with them: only texts in the bitmap are shuffled.

    Places belong to a doc_id and a text, so that texts of one repeated or null id don't share lists.
    """

    def may_have(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(bits.value, longs_of(b.column("doc_id")))))

    per_doc = places.groupBy("doc", "text_hash").agg(F.collect_list("place").alias("places"))
    asked = documents.mapInArrow(may_have, documents.schema)
    per_doc = per_doc.withColumnRenamed("text_hash", "hash_of_text")
    on = (F.coalesce(F.col("doc_id"), F.lit(-(2**63))) == F.col("doc")) & (F.col("text_hash") == F.col("hash_of_text"))
    return asked.join(per_doc.hint("shuffle_hash"), on, how)


def repeated_windows(documents: DataFrame, anchors: DataFrame, bits) -> DataFrame:
    """(doc, text_hash, place): starts of windows that also start at a smaller (doc, place)."""
    n = partitions(documents)

    def send(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column("text"))
                doc, text_hash = longs_of(part.column("doc_id")), longs_of(part.column("text_hash"))
                words = words_of(texts)
                _, count = window_starts(words, WINDOW)
                first = np.cumsum(count) - count
                near = np.zeros(int(count.sum()) + 1, np.int64)
                for t, lists in enumerate(part.column("places").to_pylist()):
                    if count[t]:
                        at = np.unique(np.array(lists, np.int64))
                        low = np.minimum(np.maximum(at - (PERIOD - 1), 0), count[t])
                        high = np.minimum(at + 1, count[t])
                        np.add.at(near, first[t] + low, 1)
                        np.add.at(near, first[t] + high, -1)
                owner = np.repeat(np.arange(len(texts)), count)
                on = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                owner = owner[on]
                place = (on - first[owner]).astype(np.int32)
                key = window_hashes(word_hashes(texts, words), WINDOW)
                key = key[words.at[:-1][owner] + place] if len(on) else np.zeros(0, np.uint64)
                own = doc[owner]
                order = np.lexsort((place, own, key))
                s, e = groups_of(key[order])
                least = np.repeat(order[s], e - s)
                later = (own[order] != own[least]) | (place[order] != place[least])
                rest = np.sort(order[later])
                if len(rest):
                    yield pack(
                        np.full(len(rest), -1), [key[rest], own[rest], text_hash[owner[rest]].view(np.uint64), place[rest]]
                    )
                # of identical rows with one doc_id all are at the least place
                keep = np.sort(order[~later])
                yield pack(
                    (key[keep] % np.uint64(4 * n)).astype(np.int64),
                    [key[keep], own[keep], text_hash[owner[keep]].view(np.uint64), place[keep]],
                )

    types = ["u8", "i8", "u8", "i4"]

    def meet(batches):
        def rest():
            for b in batches:
                own = np.asarray(b.column("bucket")) == -1
                if own.any():
                    known.append(b.filter(pa.array(own)))
                yield b.filter(pa.array(~own))

        known: list[pa.RecordBatch] = []
        key, doc, text, place = unpack(rest(), types)
        order = np.lexsort((place, doc, key))
        key, doc, text, place = key[order], doc[order], text[order], place[order]
        s, e = groups_of(key)
        later = (doc != np.repeat(doc[s], e - s)) | (place != np.repeat(place[s], e - s))
        for d, t, p in [(doc[later], text[later], place[later])] + [unpack(iter([b]), types)[1:] for b in known]:
            if len(d):
                order = np.lexsort((t, d))
                yield _split_places(d[order], t[order].view(np.int64), p[order])

    near = _with_places(documents, anchors, bits, "inner").select("doc_id", "text", "places", "text_hash")
    packed = near.mapInArrow(send, PACKED)
    spread = packed.repartition(
        n, F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.hash("packed"), F.lit(n)))
    )
    return spread.mapInArrow(meet, PLACES)


def kept_words(texts: Texts, words: Words, t: int, removed: np.ndarray) -> bytes:
    """Words of text t that are not removed, joined by one space."""
    own = slice(words.at[t], words.at[t + 1])
    start, end = words.start[own][~removed], words.end[own][~removed]
    if not len(start):
        return b""
    length = end - start
    out = np.full(int(length.sum()) + len(length) - 1, 0x20, np.uint8)
    to = np.cumsum(length + 1) - length - 1
    out[ranges(to, length)] = texts.data[ranges(start, length)]
    return out.tobytes()


def _removed(count: int, places: list[int] | None) -> np.ndarray:
    change = np.zeros(count + 1, np.int64)
    at = np.array(places or [], np.int64)
    np.add.at(change, np.minimum(at, count), 1)
    np.add.at(change, np.minimum(at + WINDOW, count), -1)
    return np.cumsum(change[:-1]) > 0


def substring_dedup(documents: DataFrame, as_text: bool = False) -> DataFrame:
    """Per row of documents(doc_id, text): counts, and the kept words or their digest.

    With ``as_text`` the last column is ``kept`` (the words joined by one space), else
    ``kept_sha256`` (lowercase hex).
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    anchors, _ = stored(repeated_anchors(docs), "anchors")
    bits = bitmap(anchors, "doc")
    windows, _ = stored(repeated_windows(docs, anchors, bits), "windows")
    bits = bitmap(windows, "doc")
    last = "kept string" if as_text else "kept_sha256 string"

    def finish(batches, judged: bool):
        for batch in batches:
            if not judged:
                batch = batch.filter(pa.array(~in_bitmap(bits.value, longs_of(batch.column("doc_id")))))
            for part in slices(batch, "text"):
                texts = texts_of(part.column("text"))
                words = words_of(texts)
                lists = part.column("places").to_pylist() if judged else [None] * len(texts)
                removed = [_removed(int(c), x) for c, x in zip(words.per_text, lists)]
                kept = [kept_words(texts, words, t, r) for t, r in enumerate(removed)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(words.per_text.astype(np.int64)),
                        pa.array(np.array([r.sum() for r in removed], np.int64)),
                        pa.array([x.decode() if as_text else hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", last.split()[0]],
                )

    schema = f"doc_id long, n_words long, n_removed long, {last}"
    hit = _with_places(docs, windows, bits, "left").select("doc_id", "text", "places")
    return hit.mapInArrow(lambda b: finish(b, True), schema).unionByName(
        docs.mapInArrow(lambda b: finish(b, False), schema)
    )
