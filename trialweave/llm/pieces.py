"""SentencePiece encoding and decoding with a given vocabulary, by batched Viterbi.

Texts become code points, blanks as U+2581 after one leading blank, and are cut into units that no
piece crosses: runs of blanks with what follows, and single characters that the vocabulary lacks,
which become byte pieces. Every distinct unit of a slice is encoded once. Units of equal length
advance together: hashes of all their substrings of piece length probe the sorted piece keys, and
at every end the best admissible piece and its start are kept as back-pointers.

The vocabulary's pieces were merged pairwise by score. So a piece is admissible after another only
if merging the two strings by score gives just these two (checked by undoing merges, latest
first, and remembered per pair); then the best path is the one that merging finds, and the ids equal
those of the sentencepiece library. One exception: a U+2581 in the text itself is encoded as
bytes, so that decoding gives back every text exactly.

Nulls and empty texts have no pieces. Repeated rows are encoded each on its own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import FINE_SLICE, mix, powers, ranges, slices, texts_of

BLANK_MARK = 0x2581
LITERAL_MARK = 0x110000  # a U+2581 that the text itself holds
BASE = 0xD1342543DE82EF95
STEP = np.uint64(0x9E3779B97F4A7C15)
MATRIX = 4_000_000  # substrings probed at once
CACHE = 1 << 20
REMEMBERED = 1 << 20  # units; beyond it the memory starts afresh


@dataclass(frozen=True)
class Vocabulary:
    key: np.ndarray  # sorted hashes of the pieces that merging can make
    id: np.ndarray
    longest: int
    score: np.ndarray  # by id
    left: np.ndarray  # the last merge that makes a piece, -1 for single characters
    right: np.ndarray
    pair: np.ndarray  # sorted left * size + right of every two pieces that make a third
    pair_score: np.ndarray
    known: np.ndarray  # by code point: whether it is a piece
    byte_id: np.ndarray  # of each byte
    data: np.ndarray  # what pieces decode to, back to back
    at: np.ndarray

    @property
    def size(self) -> int:
        return len(self.score)


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file; the library only lists the pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    score = np.array([model.get_score(i) for i in range(size)])
    plain = {
        names[i]: i
        for i in range(size)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    }
    byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    left, right = np.full(size, -1), np.full(size, -1)
    pairs, made = {}, []
    for name, i in plain.items():
        for cut in range(1, len(name)):
            a, b = plain.get(name[:cut]), plain.get(name[cut:])
            if a is not None and b is not None:
                pairs[a * size + b] = score[i]
        parts = merged(name, plain, score, stop=2)
        if len(name) == 1 or len(parts) == 2 and all(p in plain for p in parts):
            made.append(name)
            if len(name) > 1:
                left[i], right[i] = plain[parts[0]], plain[parts[1]]
    keys = piece_keys([[ord(c) for c in n] for n in made])
    order = np.argsort(keys)
    pair = np.array(sorted(pairs), np.int64)
    text = [n.replace("▁", " ").encode() for n in names]
    for b, i in enumerate(byte_id):
        text[i] = bytes([b])
    for i in range(size):
        if model.is_control(i) or model.is_unknown(i):
            text[i] = b""
    return Vocabulary(
        keys[order],
        np.array([plain[n] for n in made])[order],
        max(map(len, made)),
        score,
        left,
        right,
        pair,
        np.array([pairs[k] for k in pair.tolist()]),
        _flags([ord(n) for n in made if len(n) == 1]),
        byte_id,
        np.frombuffer(b"".join(text), np.uint8),
        np.r_[0, np.cumsum([len(t) for t in text])],
    )


def _flags(points: list[int]) -> np.ndarray:
    out = np.zeros(LITERAL_MARK + 1, bool)
    out[points] = True
    return out


def merged(text: str, plain: dict[str, int], score: np.ndarray, stop: int = 1) -> list[str]:
    """The text's characters merged pairwise, best score and then leftmost first, down to ``stop`` parts."""
    parts = list(text)
    while len(parts) > stop:
        found = [(-score[plain[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in plain]
        if not found:
            break
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def _char_keys(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + STEP)


def piece_keys(pieces: list[list[int]]) -> np.ndarray:
    length = np.array([len(p) for p in pieces])
    flat = _char_keys(np.concatenate([np.array(p) for p in pieces]))
    first = np.cumsum(length) - length
    flat = flat * powers(int(length.max()), BASE)[np.arange(len(flat)) - np.repeat(first, length)]
    return mix(np.add.reduceat(flat, first) + length.astype(np.uint64) * STEP)


class Encoder:
    """Encodes units; remembers which pairs of pieces may follow each other."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pair_key = np.full(CACHE, -1, np.int64)
        self.pair_ok = np.zeros(CACHE, bool)
        self.forget()
        self.maybe = np.zeros(1 << 20, bool)  # first bits of the piece keys: most substrings are none
        self.maybe[vocabulary.key >> np.uint64(44)] = True

    def forget(self) -> None:
        """No units are remembered: their sorted keys, and where their pieces are."""
        self.unit_key = np.zeros(0, np.uint64)
        self.unit_at = np.zeros(0, np.int64)
        self.unit_count = np.zeros(0, np.int64)
        self.unit_ids = np.zeros(0, np.int32)

    def remember(self, key: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Adds units (none of them known) with their pieces back to back."""
        if len(self.unit_key) + len(key) > REMEMBERED:
            self.forget()
        keys = np.concatenate([self.unit_key, key])
        order = np.argsort(keys)
        self.unit_key = keys[order]
        self.unit_at = np.concatenate([self.unit_at, len(self.unit_ids) + np.cumsum(count) - count])[order]
        self.unit_count = np.concatenate([self.unit_count, count])[order]
        self.unit_ids = np.concatenate([self.unit_ids, ids.astype(np.int32)])

    def place_of(self, key: np.ndarray) -> np.ndarray:
        """Where the units are in the memory, or -1."""
        if not len(self.unit_key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.unit_key, key), len(self.unit_key) - 1)
        return np.where(self.unit_key[at] == key, at, -1)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        some = np.flatnonzero(self.maybe[keys >> np.uint64(44)])
        own = keys[some]
        at = np.minimum(np.searchsorted(self.v.key, own), len(self.v.key) - 1)
        hit = self.v.key[at] == own
        out[some[hit]] = self.v.id[at[hit]]
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.v.size + b
        slot = (mix(key.astype(np.uint64)) & np.uint64(CACHE - 1)).astype(np.int64)
        out = self.pair_ok[slot]
        miss = np.flatnonzero(self.pair_key[slot] != key)
        if len(miss):
            new, at = np.unique(key[miss], return_inverse=True)
            ok = self._undo(new // self.v.size, new % self.v.size)
            out[miss] = ok[at]
            self.pair_key[slot[miss]] = key[miss]
            self.pair_ok[slot[miss]] = out[miss]
        return out

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging a's and b's characters leaves exactly a and b.

        From the last merge back, the pieces that touch at the border are compared with the merge
        that consumed one of them: had the two made a piece of better score, they would have been
        merged first. At equal score the place further left wins.
        """
        v = self.v
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        limit, tie = np.full(len(a), -np.inf), np.ones(len(a), bool)  # first: any common piece
        live = np.arange(len(a))
        while len(live):
            key = a[live] * v.size + b[live]
            at = np.minimum(np.searchsorted(v.pair, key), len(v.pair) - 1)
            score = np.where(v.pair[at] == key, v.pair_score[at], -np.inf)
            bad = (v.pair[at] == key) & ((score > limit[live]) | (tie[live] & (score == limit[live])))
            ok[live[bad]] = False
            live = live[~bad]
            whole_a, whole_b = v.left[a[live]] < 0, v.left[b[live]] < 0
            live, whole_a, whole_b = (x[~(whole_a & whole_b)] for x in (live, whole_a, whole_b))
            # the worse score was merged later; of equal ones the right
            undo_a = ~whole_a & (whole_b | (v.score[a[live]] < v.score[b[live]]))
            x, y = live[undo_a], live[~undo_a]
            limit[x], tie[x] = v.score[a[x]], False
            a[x] = v.right[a[x]]
            limit[y], tie[y] = v.score[b[y]], True
            b[y] = v.left[b[y]]
        return ok

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of n units of equal length (n x length code points): matrix padded by -1, counts."""
        v = self.v
        n, length = points.shape
        widest = min(v.longest, length)
        power = powers(length + 1, BASE)
        inverse = powers(length + 1, pow(BASE, -1, 1 << 64))
        prefix = np.zeros((n, length + 1), np.uint64)
        np.cumsum(_char_keys(points) * power[:length], axis=1, out=prefix[:, 1:])
        # piece[w][:, s] is the piece of w + 1 characters from s, or -1
        piece = np.full((widest, n, length), -1, np.int64)
        for w in range(1, widest + 1):
            h = (prefix[:, w:] - prefix[:, :-w]) * inverse[: length - w + 1]
            piece[w - 1][:, : length - w + 1] = self.probe(mix(h + STEP * np.array(w, np.uint64)).ravel()).reshape(n, -1)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((n, length + 1), -1, np.int64)
        start = np.zeros((n, length + 1), np.int64)
        rows = np.arange(n)
        for e in range(1, length + 1):
            w = np.arange(1, min(widest, e) + 1)
            own = np.stack([piece[k - 1][:, e - k] for k in w], axis=1)
            before = last[:, e - w]
            ok = (own >= 0) & (best[:, e - w] > -np.inf)
            ask = ok & (before >= 0)
            if ask.any():
                ok[ask] = self.may_follow(before[ask], own[ask])
            total = np.where(ok, best[:, e - w] + v.score[own], -np.inf)
            top = total.argmax(1)
            best[:, e] = total[rows, top]
            last[:, e] = np.where(best[:, e] > -np.inf, own[rows, top], -1)
            start[:, e] = e - w[top]
        out = np.full((n, length), -1, np.int64)
        count, at = np.zeros(n, np.int64), np.full(n, length)
        while (live := np.flatnonzero(at > 0)).size:
            out[live, length - 1 - count[live]] = last[live, at[live]]
            count[live] += 1
            at[live] = start[live, at[live]]
        return out, count


@dataclass
class Encoded:
    """Piece ids of texts back to back: text i has id[at[i]:at[i + 1]]."""

    id: np.ndarray
    at: np.ndarray


def _units(points: np.ndarray, begins: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of units, and which of them are single unknown characters."""
    strange = ~known[points]
    blank = points == BLANK_MARK
    cut = strange.copy()
    cut[1:] |= strange[:-1] | (blank[1:] & ~blank[:-1])
    cut[begins] = True
    start = np.flatnonzero(cut)
    return start, strange[start]


def _encode_units(
    points: np.ndarray, start: np.ndarray, length: np.ndarray, strange: np.ndarray, encoder: Encoder
) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of units back to back, and their numbers."""
    v = encoder.v
    ids: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    count = np.zeros(len(start), np.int64)
    for u in np.flatnonzero(strange):
        c = points[start[u]]
        own = v.byte_id[list(chr(BLANK_MARK if c == LITERAL_MARK else c).encode())]
        ids.append(own)
        owners.append(np.full(len(own), u))
        count[u] = len(own)
    plain = np.flatnonzero(~strange)
    plain = plain[np.argsort(length[plain], kind="stable")]
    own_length = length[plain]
    for w in np.unique(own_length):
        group = plain[np.searchsorted(own_length, w) : np.searchsorted(own_length, w, "right")]
        step = max(1, MATRIX // int(w * min(w, v.longest)))
        for at in range(0, len(group), step):
            some = group[at : at + step]
            matrix, n = encoder.encode(points[start[some][:, None] + np.arange(w)])
            ids.append(matrix[matrix >= 0])
            owners.append(np.repeat(some, n))
            count[some] = n
    flat, owner = np.concatenate(ids), np.concatenate(owners)
    return flat[np.argsort(owner, kind="stable")], count


def encode_texts(texts: list[str | None], encoder: Encoder) -> Encoded:
    """Piece ids of every text."""
    texts = [" " + t if t else "" for t in texts]
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    if not len(points):
        return Encoded(np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    points[points == BLANK_MARK] = LITERAL_MARK
    points[points == 0x20] = BLANK_MARK
    begins = (np.cumsum(size) - size)[size > 0]
    start, strange = _units(points, begins, encoder.v.known)
    length = np.diff(np.r_[start, len(points)])
    place = np.arange(len(points)) - np.repeat(start, length)
    unit_key = np.add.reduceat(_char_keys(points) * powers(int(length.max()), BASE)[place], start)
    unit, first, which = np.unique(mix(unit_key + length.astype(np.uint64) * STEP), return_index=True, return_inverse=True)
    if len(encoder.unit_key) + len(unit) > REMEMBERED:
        encoder.forget()
    new = np.flatnonzero(encoder.place_of(unit) < 0)
    if len(new):
        ids, count = _encode_units(points, start[first[new]], length[first[new]], strange[first[new]], encoder)
        encoder.remember(unit[new], ids, count)
    at = encoder.place_of(unit)[which]
    per_unit = encoder.unit_count[at]
    out = encoder.unit_ids[ranges(encoder.unit_at[at], per_unit)].astype(np.int64)
    unit_text = np.searchsorted(np.cumsum(size), start, "right")
    per_text = np.bincount(unit_text, per_unit, len(texts)).astype(np.int64)
    return Encoded(out, np.r_[0, np.cumsum(per_text)])


def decode_ids(encoded: Encoded, v: Vocabulary) -> list[bytes]:
    """The texts of piece ids, without the leading blank."""
    length = np.diff(v.at)[encoded.id]
    data = v.data[ranges(v.at[encoded.id], length)]
    ends = np.r_[0, np.cumsum(length)][encoded.at]
    return [data[a + 1 : b].tobytes() for a, b in zip(ends, ends[1:])]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, shared) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(shared.value)
    return _ENCODERS[name]


def encode(documents: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of documents and an array of piece ids, in place of the text."""
    shared = documents.sparkSession.sparkContext.broadcast(load(vocabulary))
    rest = [c for c in documents.columns if c != text and c != ids]
    out = documents.select(*rest).schema.add(ids, T.ArrayType(T.IntegerType()))

    def rows(batches):
        encoder = _encoder(vocabulary, shared)
        for batch in batches:
            for part in slices(batch, text, FINE_SLICE):
                e = encode_texts(part.column(text).to_pylist(), encoder)
                lists = pa.ListArray.from_arrays(pa.array(e.at.astype(np.int32)), pa.array(e.id.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), lists], [*rest, ids])

    return documents.withColumn(text, F.col(text).cast("string")).mapInArrow(rows, out)


def decode(encoded: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The inverse of ``encode``; a null list is a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(vocabulary))
    rest = [c for c in encoded.columns if c != text and c != ids]
    out = encoded.select(*rest).schema.add(text, T.StringType())

    def rows(batches):
        for batch in batches:
            lists = batch.column(ids)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            texts = decode_ids(Encoded(flat, np.r_[0, np.cumsum(size)]), shared.value)
            values = [None if missing else t.decode() for t, missing in zip(texts, lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(values, pa.string())], [*rest, text])

    return encoded.mapInArrow(rows, out)


def round_trip(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (32-bit little-endian ids), text_sha256 of the decoded text, exact."""
    shared = documents.sparkSession.sparkContext.broadcast(load(vocabulary))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def rows(batches):
        encoder = _encoder(vocabulary, shared)
        for batch in batches:
            for part in slices(batch, "text", FINE_SLICE):
                texts = texts_of(part.column("text"))
                e = encode_texts(part.column("text").to_pylist(), encoder)
                ids = e.id.astype("<i4")
                back = decode_ids(e, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(e.at)),
                        pa.array([hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(e.at, e.at[1:])], pa.string()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()),
                        pa.array([t == texts.part(i) for i, t in enumerate(back)]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "text_sha256", "exact"],
                )

    return docs.mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, text_sha256 string, exact boolean")
