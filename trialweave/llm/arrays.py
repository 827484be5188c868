"""Texts of Arrow batches as flat numpy arrays: bytes, words, hashes, windows.

Nothing here loops over words or bytes in Python. Batches are cut into slices of whole texts of a
few megabytes, so memory is bounded by the slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
BLOCK = 1 << 14  # numbers that a core keeps near while several steps work on them
FINE_SLICE = 1 << 20  # where a byte of text becomes many bytes of arrays

_BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BLANK = np.zeros(256, bool)
BLANK[list(_BLANKS)] = True

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
BYTE_KEYS = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits look random (finaliser with two multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Texts:
    """Texts back to back: text i is data[at[i]:at[i + 1]]."""

    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def part(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    """UTF-8 bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return Texts(data, at - at[0])


def longs_of(column: pa.Array, null: int = -(2**63)) -> np.ndarray:
    """A whole-number column as int64; a null becomes ``null``."""
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``size`` bytes, at least one row each."""
    at = texts_of(batch.column(text)).at
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] numbers), starts[1], ..."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


@dataclass
class Words:
    """Words of texts: byte bounds, and the words of text i are at[i]:at[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.at)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.per_text)


def words_of(texts: Texts, blank: np.ndarray = BLANK) -> Words:
    """Maximal runs of bytes that are not ``blank``, never across texts."""
    return _runs(texts, ~blank[texts.data])


def fast_words_of(texts: Texts) -> Words:
    """The same words between usual blanks, which are compared instead of looked up."""
    return _runs(texts, (texts.data != 0x20) & (texts.data - np.uint8(0x09) > 0x0D - 0x09))


def _runs(texts: Texts, found: np.ndarray) -> Words:
    at, n = texts.at, len(texts.data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = found
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    before[at] = False  # a text begins afresh
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[: max(n - 1, 0)] = inside[1:n]
    cuts = at[1:-1]
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside[:n] & ~after) + 1
    return Words(start, end, np.searchsorted(start, at))


def word_hashes(texts: Texts, words: Words, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hashes of the words' (folded) bytes."""
    lengths = words.end - words.start
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum()), dtype=np.int32)
    place = inside - np.repeat(first.astype(np.int32), lengths)
    inside += np.repeat((words.start - first).astype(np.int32), lengths)
    keys = BYTE_KEYS[fold]
    values = keys[texts.data[inside]]
    values *= powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _STEP)


def _eight(words: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The bytes from ``at`` on as one number, at most eight and at most ``left``, from bytes seen as 64-bit words."""
    shift = ((at & 7) << 3).astype(np.uint64)
    k = at >> 3
    value = words[k] >> shift | words[k + 1] << (np.uint64(56) - shift) << np.uint64(8)
    return value << (64 - 8 * np.minimum(left, 8)).astype(np.uint64)


def fast_word_hashes(texts: Texts, words: Words) -> np.ndarray:
    """Other 64-bit hashes of the words' bytes, which are read eight at a time instead of one by one."""
    lengths = words.end - words.start
    if not len(lengths):
        return np.zeros(0, np.uint64)
    data = np.zeros((len(texts.data) >> 3) + 2, "<u8")
    data.view(np.uint8)[: len(texts.data)] = texts.data
    total = np.empty(len(lengths), np.uint64)
    for a in range(0, len(lengths), BLOCK):
        k = slice(a, a + BLOCK)
        total[k] = mix(_eight(data, words.start[k], lengths[k]))
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = (lengths[long] - 1) >> 3
        piece = ranges(np.ones(len(long), np.int64), more)
        at = np.repeat(words.start[long], more) + 8 * piece
        values = mix(_eight(data, at, np.repeat(words.end[long], more) - at))
        values *= powers(int(more.max()) + 1)[piece]
        total[long] += np.add.reduceat(values, np.cumsum(more) - more)
    return mix(total + lengths.astype(np.uint64) * _STEP)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive numbers, whatever text they are in (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= _STEP
        total += hashes[j : j + n]
    return mix(total)


def window_starts(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which a window of k words inside one text starts; windows per text."""
    count = np.maximum(words.per_text - k + 1, 0)
    return ranges(words.at[:-1], count), count


def characters(texts: Texts) -> np.ndarray:
    """Running count of code points: characters(t)[b] of them start before byte b."""
    out = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=out[1:])
    return out
