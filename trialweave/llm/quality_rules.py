"""Quality rules: counts of words, symbols and repeats, and perplexity under a Kneser-Ney model.

*Model.* Pairs of consecutive words, as 64-bit hashes of their bytes in any script, are counted over all texts, in two
passes, each of ``ROUNDS`` readings that fill a part of the buckets, so that less lies on disk at once. In the first pass each slice of texts sends its different pairs to the pairs' buckets as packed arrays; a bucket
sorts and adds them up and tells the buckets of words what it counted: words as contexts and as continuations. These add up and
answer each bucket of pairs in the order of its words, which is all that is stored. In the second slices
send their pairs with the texts that hold them, and a bucket, with its answers, finds the interpolated
modified Kneser-Ney probability of every pair in its sorted hash arrays; sums per text return. Frequent words
travel as codes of two bytes, others as hashes. Only counts of counts and the ``CODES`` most frequent words pass through the
driver; the tables grow with the corpus and stay on the cluster. A text's own pairs count, so a text of words that occur nowhere else is
too predictable rather than too surprising; the bands have two ends.
*Bands.* The log perplexity of a text is the negative log probability of its words per byte. Per language
the median and the median distance from it are taken over all texts of at least ``LEAST_WORDS``
words, exactly, from counts of rounded values; texts outside median +- ``WIDTH`` distances (and at
least ``LEAST_WIDTH``) are rejected. A language's own ends count with its number of such texts, those that
span the bands of all languages with ``SHARED_TEXTS``: a rare language is judged by what is usual anywhere,
a common one by itself, without a step between.

Nulls and empty texts have no words and fail the base rules. A null language is a language of its
own. Repeated rows are judged each on its own, and count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Texts, Words, fast_word_hashes, fast_words_of, mix, slices, texts_of, window_hashes, window_starts
from .exchange import discard, groups_of, partitions, small_batches, squeezed, stored, unsqueezed
from .letters import CLASSES

ORDER = 4  # of the model of letter classes
START = np.uint64(1)  # the word before a text
CODES = 60000  # words sent as two bytes
SLOT_BITS = 20  # of a word's hash, by which its code is found
OFTEN = 4  # times in one slice, to be counted for that
ROUNDS = 3  # readings in which the buckets of pairs are filled, each a part of them
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MICRO = 1e6  # log probabilities are added up as whole millionths
LEAST_WORDS = 50
WIDTH = 6.0
LEAST_WIDTH = 0.13
SHARED_TEXTS = 20  # the weight of the shared band beside a language's own
STEPS = 1000  # log perplexities are compared in steps of one thousandth

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SLOT_SHIFT = np.uint64(64 - SLOT_BITS)
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Level:
    """One order: windows and their discounted shares, contexts and their back-off weights, sorted."""

    key: np.ndarray
    share: np.ndarray
    context: np.ndarray
    weight: np.ndarray


def discounts(spread: np.ndarray) -> np.ndarray:
    """The three discounts, at 1 to 3, from how many windows were counted once to four times."""
    y = spread[0] / max(spread[0] + 2 * spread[1], 1)
    out = np.zeros(4)
    for i in range(3):
        d = i + 1 - (i + 2) * y * spread[i + 1] / spread[i] if spread[i] else 0.5
        out[i + 1] = min(max(d, 0.05), i + 0.95)
    return out


def spread_of(count: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(count, 5).astype(int), minlength=6)[1:5]


def kneser_ney(gram: np.ndarray, n: np.ndarray, order: int = ORDER) -> list[Level]:
    """Levels of a model of letter classes, from the longest windows down; shorter ones count the different windows they end."""
    at = np.argsort(gram)
    key, count = gram[at].astype(np.int64), n[at].astype(np.float64)
    levels = []
    for k in range(order, 0, -1):
        discount = discounts(spread_of(count).astype(float))
        own = discount[np.minimum(count, 3).astype(int)]
        context, first = np.unique(key >> 6, return_index=True)
        total, taken = np.add.reduceat(count, first), np.add.reduceat(own, first)
        share = (count - own) / np.repeat(total, np.diff(np.r_[first, len(key)]))
        levels.append(Level(key.astype(np.int32), share, context.astype(np.int32), taken / total))
        key, count = np.unique(key & (CLASSES ** (k - 1) - 1), return_counts=True)
        count = count.astype(np.float64)
    return levels


def log_table(levels: list[Level]) -> np.ndarray:
    """Log probability of every possible window, from the sorted arrays."""
    p = np.full(CLASSES, 1 / CLASSES)
    for k, level in enumerate(reversed(levels), 1):
        weight = np.ones(CLASSES ** (k - 1))
        weight[level.context] = level.weight
        if k == 1:
            p = weight[0] * p
        else:  # contexts by their first class and the rest, which is the shorter context
            p = (weight.reshape(CLASSES, -1, 1) * p.reshape(1, -1, CLASSES)).reshape(-1)
        p[level.key] += level.share
    return np.log(p).astype(np.float32)


def repeats(texts: Texts, words: Words, hashes: np.ndarray) -> np.ndarray:
    """Words inside a 3-word window that its text holds twice or more."""
    starts, count = window_starts(words, 3)
    owner = np.repeat(np.arange(len(texts)), count)
    key = window_hashes(hashes, 3)[starts] ^ mix(owner.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    order = np.argsort(key)
    cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, int)
    size = np.diff(np.r_[cuts, len(key)])
    again = starts[order[np.repeat(size > 1, size)]]
    covered = np.zeros(len(hashes) + 3, bool)
    for k in range(3):
        covered[again + k] = True
    return np.add.reduceat(np.r_[covered[: len(hashes)], False], words.at[:-1], dtype=np.int64) * (words.per_text > 0)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"]
MEASURED = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in NAMES[:-1]) + ", n_bytes long, row long"


def _per_text(found: np.ndarray, texts: Texts) -> np.ndarray:
    """How many bytes of each text a mask finds."""
    return np.diff(np.searchsorted(np.flatnonzero(found), texts.at)).astype(np.int64)


def features(texts: Texts, words: Words, hashes: np.ndarray) -> list[np.ndarray]:
    word_bytes = np.r_[0, np.cumsum(words.end - words.start)]
    return [
        words.per_text.astype(np.int64),
        np.diff(word_bytes[words.at]) - _per_text((texts.data & 0xC0) == 0x80, texts),  # blanks are single bytes
        _per_text(SYMBOL[texts.data], texts),
        np.array([duplicate_lines(texts.part(t)) for t in range(len(texts))], np.int64),
        repeats(texts, words, hashes).astype(np.int64),
        np.diff(texts.at),
    ]


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, compressed byte plane by byte plane, without the upper planes that hold only zeros."""
    sizes, planes = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        used = (int(a.view(f"u{a.itemsize}").max(initial=0)).bit_length() + 7) >> 3
        sizes.append(len(a) << 4 | used)
        planes.append(a.view(np.uint8).reshape(len(a), a.itemsize)[:, :used].T.tobytes())
    return np.array(sizes, np.int64).tobytes() + squeezed(b"".join(planes))


def _arrays(blob: bytes, *types) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int64, len(types)).tolist(), 0, []
    data = np.frombuffer(unsqueezed(blob[8 * len(types) :]), np.uint8)
    for size, t in zip(sizes, map(np.dtype, types)):
        n, used = size >> 4, size & 15
        full = np.zeros((n, t.itemsize), np.uint8)
        full[:, :used] = data[at : at + n * used].reshape(used, n).T
        out.append(full.reshape(-1).view(t))
        at += n * used
    return out


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts)]


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    n = np.uint64(buckets)
    return (keys - keys // n * n).astype(np.int64)  # in numpy faster than the remainder


def _dealt(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of the keys in it), in the order of the keys."""
    both = np.sort(to.astype(np.uint64) << np.uint64(32) | np.arange(len(to), dtype=np.uint64))
    order = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for a, b in zip(*groups_of(both >> np.uint64(32))):
        yield int(to[order[a]]), order[a:b]


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(names)], [n for n, _ in names])


def frequent_words(documents: DataFrame):
    """Broadcast hashes, sorted, of at most ``CODES`` words that the texts hold most often, and ``START``.

    They only shorten what is sent: other words go by their hashes.
    """

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column("text"))
                word = np.sort(fast_word_hashes(texts, fast_words_of(texts)))
                first, ends = groups_of(word)
                often = ends - first >= OFTEN
                first, ends = first[often], ends[often]
                yield pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), pa.array(ends - first)], ["word", "n"])

    spark = documents.sparkSession
    sums = documents.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted, path = stored(sums.select("word", F.floor(8 * F.log2("n")).cast("int").alias("step")), "frequent")
    least, left = 0, CODES
    for step, n in sorted(map(tuple, counted.groupBy("step").count().collect()), reverse=True):
        least, left = step, left - n
        if left < 0:
            least += 1
            break
    word = counted.where(F.col("step") >= least).select("word").toArrow().column("word").to_numpy().view(np.uint64)
    discard(spark, path)
    return spark.sparkContext.broadcast(np.union1d(word, [START]))


def _slots(table: np.ndarray) -> np.ndarray:
    """By a word's first bits: the code of a word of the table that begins with them, 0 if none does."""
    slots = np.zeros(1 << SLOT_BITS, np.uint16)
    slots[table >> _SLOT_SHIFT] = np.arange(1, len(table) + 1)
    return slots


def _codes(words: np.ndarray, table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """1 and more for words of the table, 0 for others."""
    code = slots[words >> _SLOT_SHIFT]
    other = np.flatnonzero((code > 0) & (table[np.maximum(code, 1) - 1] != words))  # these begin alike: search
    at = np.minimum(np.searchsorted(table, words[other]), len(table) - 1)
    code[other] = np.where(table[at] == words[other], at + 1, 0)
    return code


def _sent(before, word, key, columns, table, buckets, slots=None) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed): pairs by their codes, hashes of words without a code, and further columns."""
    slots = _slots(table) if slots is None else slots
    code_b, code_w, to = _codes(before, table, slots), _codes(word, table, slots), _bucket_of(key, buckets)
    order = np.argsort(to.astype(np.uint64) << np.uint64(32) | code_b.astype(np.uint64) << np.uint64(16) | code_w)
    for a, b in zip(*groups_of(to[order])):
        k = order[a:b]
        x, y = code_b[k], code_w[k]
        yield int(to[k[0]]), _blob(np.diff(x, prepend=np.uint16(0)), y, before[k[x == 0]], word[k[y == 0]], *(c[k] for c in columns))


def _received(blob: bytes, table: np.ndarray, *types) -> list[np.ndarray]:
    """before, word and further columns of one packed row."""
    x, y, before, word, *columns = _arrays(blob, np.uint16, np.uint16, np.uint64, np.uint64, *types)
    out = []
    for code, rest in ((np.cumsum(x, dtype=np.uint16), before), (y, word)):
        full = table[np.maximum(code, 1) - 1]
        full[code == 0] = rest
        out.append(full)
    return [*out, *columns]


def _pairs_of(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word, and a key of the two."""
    before = np.r_[START, hashes[:-1]][: len(hashes)]
    before[words.at[:-1][words.per_text > 0]] = START
    return before, mix(before * _ODD ^ hashes)


def _of_turn(key: np.ndarray, buckets: int, turn: int) -> np.ndarray:
    """Places of the pairs whose buckets have their turn."""
    own = np.arange(buckets) % ROUNDS == turn
    return np.flatnonzero(own[_bucket_of(key, buckets)])


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, where its runs start in it, and their lengths."""
    order = np.argsort(key)
    first, ends = groups_of(key[order])
    return order, first, ends - first


def _by_bucket(batches, column: str, *others: str) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, *rest in zip(*(batch.column(c).to_pylist() for c in (column, *others))):
            out.setdefault(bucket, []).append(tuple(rest))
    return out


ANSWER = "bucket int, source int, packed binary, spread array<long>"


def count_pairs(documents: DataFrame, table, buckets: int, turn: int) -> DataFrame:
    """What the buckets of pairs of one round tell the buckets of words, and counts of counts."""

    def send(batches):
        slots = _slots(table.value)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column("text"))
                words = fast_words_of(texts)
                hashes = fast_word_hashes(texts, words)
                before, key = _pairs_of(words, hashes)
                mine = _of_turn(key, buckets, turn)
                order, first, times = _counted(key[mine])
                k = mine[order[first]]
                rows = list(_sent(before[k], hashes[k], key[k], [times.astype(np.uint32)], table.value, buckets, slots))
                yield _table("bucket int, packed binary", rows)

    def count(batches):
        for bucket, blobs in _by_bucket(batches, "bucket", "packed").items():
            before, word, times = _joined([_received(x, table.value, np.uint32) for (x,) in blobs])
            order, first, _ = _counted(mix(before * _ODD ^ word))
            n = np.add.reduceat(times[order].astype(np.int64), first)
            before, word = before[order[first]], word[order[first]]
            words, at = np.unique(np.r_[before, word], return_inverse=True)
            own, last = at[: len(before)], at[len(before) :]
            found = [np.bincount(own, n, len(words)), *(np.bincount(own[x], minlength=len(words)) for x in (n == 1, n == 2, n > 2))]
            found = [x.astype(np.uint64) for x in (*found, np.bincount(last, minlength=len(words)))]
            rows = [(b, bucket, _blob(np.diff(words[k], prepend=np.uint64(0)), *(x[k] for x in found)), None) for b, k in _dealt(_bucket_of(mix(words), buckets))]
            yield _table(ANSWER, [*rows, (bucket, None, None, [*spread_of(n), 0, 0, 0, 0, 0, 0])])

    return documents.mapInArrow(send, "bucket int, packed binary").repartition(buckets, "bucket").mapInArrow(count, ANSWER)


def add_words(counted: DataFrame, buckets: int) -> DataFrame:
    """What each bucket of pairs needs to know of its words, in their order; rows without a bucket hold counts of counts."""
    numbers = [np.uint64] * 6  # word, times as context, followers counted once, twice, more often, words before

    def add(batches):
        rows = _by_bucket(batches, "bucket", "source", "packed", "spread")
        for bucket, own in rows.items():
            yield _table(ANSWER, [(None, None, None, s) for _, _, s in own if s])
            own = [x for x in own if x[1]]
            if not own:
                continue
            parts = [_arrays(x, *numbers) for _, x, _ in own]
            word, *columns = _joined([[np.cumsum(x[0], dtype=np.uint64), *x[1:]] for x in parts])
            words, at = np.unique(word, return_inverse=True)
            sums = [np.bincount(at, c, len(words)).astype(np.uint64) for c in columns]
            after = sums[4].astype(np.int64)
            yield _table(ANSWER, [(None, None, None, [0, 0, 0, 0, *spread_of(after), np.count_nonzero(after), after.sum()])])
            done = 0
            for (source, _, _), part in zip(own, parts):
                k = at[done : done + len(part[0])]
                done += len(k)
                yield _table(ANSWER, [(source, bucket, _blob(*(c[k] for c in sums)), None)])

    return counted.repartition(buckets, "bucket").mapInArrow(add, ANSWER)


def probabilities(own, last, count, stats, discount, discount1, spread1) -> np.ndarray:
    """Interpolated modified Kneser-Ney probabilities of pairs, from their words' places in ``stats``."""
    context, once, twice, more, after = stats
    once1, twice1, _, _, size, total = spread1
    after = after[last].astype(np.int64)
    taken = discount1[1] * once1 + discount1[2] * twice1 + discount1[3] * (size - once1 - twice1)
    lower = (after - discount1[np.minimum(after, 3)] + taken / size) / total
    weight = discount[1] * once[own] + discount[2] * twice[own] + discount[3] * more[own]
    return (count - discount[np.minimum(count, 3)] + weight * lower) / context[own]


SCORED = MEASURED + ", bucket int, source int, packed binary"


def spreads(answers: DataFrame) -> np.ndarray:
    """Sums of the counts of counts, of pairs and of words."""
    row = answers.agg(*[F.sum(F.col("spread")[k]) for k in range(10)]).first()
    return np.array([x or 0 for x in row], float)


def score(documents: DataFrame, answers: DataFrame, table, spread: np.ndarray, buckets: int, turn: int) -> DataFrame:
    """The log probabilities of one round's pairs, added up by text and packed; in the first round the texts with their counts too.

    Rounds know a text by its place, so each partition also sends a checksum of what it read (source -1).
    """
    discount, spread1 = discounts(spread[:4]), spread[4:]
    discount1 = discounts(spread1)
    names = [c.split()[0] for c in SCORED.split(", ")]
    kinds = _table(MEASURED, []).schema.types

    def packed(rows: list[tuple], source: int | None = None) -> pa.RecordBatch:
        """Rows (bucket, packed) that are not texts."""
        empty = [pa.nulls(len(rows), t) for t in kinds]
        blobs = pa.array([x[1] for x in rows], pa.binary())
        buckets = pa.array([x[0] for x in rows], pa.int32())
        return pa.RecordBatch.from_arrays([*empty, buckets, pa.array([source] * len(rows), pa.int32()), blobs], names)

    def measured(part, texts, words, hashes, row) -> pa.RecordBatch:
        n = len(texts)
        found = [part.column("doc_id"), part.column("lang"), *map(pa.array, features(texts, words, hashes)), pa.array(row + np.arange(n))]
        home = pa.array(np.full(n, (row >> 40) % buckets, np.int32))
        return pa.RecordBatch.from_arrays([*found, home, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)

    def measure(batches):
        part_id = TaskContext.get().partitionId()
        row, check, slots = part_id << 40, np.uint64(0), _slots(table.value)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column("text"))
                words = fast_words_of(texts)
                hashes = fast_word_hashes(texts, words)
                n = len(texts)
                if turn == 0:
                    yield measured(part, texts, words, hashes, row)
                before, key = _pairs_of(words, hashes)
                text = words.text_of_word().astype(np.uint32)
                place = np.repeat(mix(np.arange(n, dtype=np.uint64) + np.uint64(row) + _ODD), words.per_text)
                held = mix(key ^ place)
                check ^= np.bitwise_xor.reduce(held, initial=np.uint64(0))
                mine = _of_turn(key, buckets, turn)
                order, first, times = _counted(held[mine])
                k = mine[order[first]]
                sent = _sent(before[k], hashes[k], key[k], [text[k], times.astype(np.uint32)], table.value, buckets, slots)
                base = row.to_bytes(8, "little")
                yield packed([(b, base + blob) for b, blob in sent])
                row += n
        check ^= mix(np.array([row], np.uint64))[0]
        yield packed([(part_id % buckets, part_id.to_bytes(8, "little") + int(check).to_bytes(8, "little"))], -1)

    def look_up(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            done = pa.compute.or_kleene(batch.column("packed").is_null(), pa.compute.equal(pa.compute.fill_null(batch.column("source"), 0), -1))
            yield batch.filter(done)
            rest = batch.filter(pa.compute.invert(done))
            for bucket, source, blob in zip(*(rest.column(c).to_pylist() for c in names[-3:])):
                held.setdefault(bucket, ([], []))[source is not None].append((source, blob))
        for asked, told in held.values():
            parts = []
            for _, blob in asked:
                before, word, text, times = _received(blob[8:], table.value, np.uint32, np.uint32)
                parts.append([before, word, int.from_bytes(blob[:8], "little") + text.astype(np.int64), times])
            before, word, row, times = _joined(parts)
            order, first, holders = _counted(mix(before * _ODD ^ word))
            row, times = row[order], times[order].astype(np.int64)
            count = np.add.reduceat(times, first)
            words, at = np.unique(np.r_[before[order[first]], word[order[first]]], return_inverse=True)
            stats, to, known = np.zeros((5, len(words)), np.int64), _bucket_of(mix(words), buckets), 0
            for source, blob in told:
                values = np.array(_arrays(blob, *[np.uint64] * 5))
                stats[:, to == source] = values
                known += values.shape[1]
            if known != len(words):
                raise ValueError("the texts changed between two readings")
            p = probabilities(at[: len(first)], at[len(first) :], count, stats, discount, discount1, spread1)
            nats = np.repeat(np.rint(-MICRO * np.log(p)).astype(np.int64), holders) * times
            order = np.argsort(row)
            at, _ = groups_of(row[order])
            row, nats = row[order[at]], np.add.reduceat(nats[order], at)
            rows = [(b, _blob(np.diff(row[k], prepend=0), nats[k])) for b, k in _dealt((row >> 40) % buckets)]
            yield packed(rows)

    told = answers.where(f"bucket % {ROUNDS} = {turn}").select(*[F.lit(None).alias(c) for c in names[:-3]], *names[-3:])
    asked = documents.mapInArrow(measure, SCORED).unionByName(told)
    return asked.repartition(buckets, "bucket").mapInArrow(look_up, SCORED)


def add_scores(scored: DataFrame, buckets: int) -> DataFrame:
    """A row per text with its counts and nats: the negative log probability of its words, in millionths."""
    names = [c.split()[0] for c in MEASURED.split(", ")]

    def add(batches):
        texts, parts, checks = [], [[np.zeros(0, np.int64)] * 2], {}
        for batch in batches:
            texts.append(batch.filter(batch.column("packed").is_null()).select(range(len(names))))
            for source, blob in zip(batch.column("source").to_pylist(), batch.column("packed").to_pylist()):
                if source is not None:
                    checks.setdefault(blob[:8], []).append(blob[8:])
                elif blob is not None:
                    row, nats = _arrays(blob, np.int64, np.int64)
                    parts.append([np.cumsum(row), nats])
        if any(len(x) != ROUNDS or len(set(x)) > 1 for x in checks.values()):
            raise ValueError("the texts came in another order at another reading: store the table first")
        row, nats = _joined(parts)
        order = np.argsort(row)
        at, _ = groups_of(row[order])
        row, nats = np.r_[row[order[at]], -1], np.r_[np.add.reduceat(nats[order], at) if len(at) else nats, 0]
        for batch in texts:
            own = batch.column("row").to_numpy()
            at = np.searchsorted(row[:-1], own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(row[at] == own, nats[at], 0))], [*names, "nats"])

    return scored.repartition(buckets, "bucket").mapInArrow(add, MEASURED + ", nats long")


def bands(measured: DataFrame) -> DataFrame:
    """(lang, low, high) of languages with texts."""
    own = _bands(measured)
    whole = _bands(measured.withColumn("lang", F.lit(None).cast("string"))).select(F.col("low").alias("all_low"), F.col("high").alias("all_high"))
    share = F.col("texts") / (F.col("texts") + SHARED_TEXTS)

    def pooled(end: str, other: str):
        return share * F.col(end) + (1 - share) * F.col(other)

    # a row per language from here on
    near = own.crossJoin(F.broadcast(whole))
    ends = near.agg(
        F.min(F.least(pooled("low", "all_low"), "all_low")).alias("least"), F.max(F.greatest(pooled("high", "all_high"), "all_high")).alias("most")
    )
    near = near.crossJoin(F.broadcast(ends))
    return near.select("lang", pooled("low", "least").alias("low"), pooled("high", "most").alias("high"))


def _bands(measured: DataFrame) -> DataFrame:
    """(lang, texts, low, high) in steps of log perplexity, exact, from counts per value."""
    bins = measured.where(f"n_words >= {LEAST_WORDS}").groupBy("lang", "log_perplexity").agg(F.count(F.lit(1)).alias("n"))
    middle = bins.groupBy("lang").agg(F.expr("percentile(log_perplexity, 0.5, n)").alias("middle"), F.sum("n").alias("texts"))
    away = bins.join(middle.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")))
    spread = away.groupBy("lang", "middle", "texts").agg(F.expr("percentile(abs(log_perplexity - middle), 0.5, n)").alias("away"))
    half = F.greatest(F.lit(WIDTH) * F.col("away"), F.lit(LEAST_WIDTH * STEPS))
    return spread.select("lang", "texts", (F.col("middle") - half).alias("low"), (F.col("middle") + half).alias("high"))


def _all(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    out = parts[0][0]
    for table, _ in parts[1:]:
        out = out.unionByName(table)
    return out


def _discard(spark, parts: list[tuple[DataFrame, str]]) -> None:
    for _, path in parts:
        discard(spark, path)


def quality_rules(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, lang) -> doc_id, the counts, base_failed, kept, log_perplexity (nats a byte)."""
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    spark = docs.sparkSession
    buckets = 2 * partitions(docs)
    small_batches(spark)
    table = frequent_words(docs)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # each table is stored, so nothing reads a finished job's shuffle again
    try:
        parts = [stored(count_pairs(docs, table, buckets, k), "counted") for k in range(ROUNDS)]
        answers, path = stored(add_words(_all(parts), buckets), "answers")
        _discard(spark, parts)
        spread = spreads(answers)
        parts = [stored(score(docs, answers, table, spread, buckets, k), "scored") for k in range(ROUNDS)]
        discard(spark, path)
        scored = add_scores(_all(parts), buckets)
        per_byte = F.col("nats") / F.lit(MICRO) / F.greatest(F.col("n_bytes"), F.lit(1))
        measured = scored.withColumn("log_perplexity", F.rint(STEPS * per_byte).cast("long"))
        measured, _ = stored(measured.select("doc_id", "lang", *NAMES), "measured")
    finally:
        spark.conf.set(CLEANUP, before)
    _discard(spark, parts)
    limits = bands(measured).withColumnRenamed("lang", "l")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return (
        measured.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & inside)
        .select("doc_id", *NAMES[:-1], "base_failed", "kept", (F.col("log_perplexity") / STEPS).alias("log_perplexity"))
    )
