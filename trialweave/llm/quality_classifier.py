"""Quality classifier from weak labels.

*Labellers.* Overlapping heuristics vote good, bad or nothing on every text.
*Label model.* Texts are counted per pattern of votes (at most 3**labellers patterns) over the
whole corpus; expectation-maximisation on these counts estimates the share of good texts and how
each labeller votes on good and bad ones, and gives every pattern its posterior.
*Scorer.* A logistic regression over hashed features (windows of three letter classes, and the
labellers' measures in steps) learns the posteriors of a bounded sample: per likely class the
``SAMPLE`` texts of smallest hash of (doc_id, text). It then scores every text; below ``REJECT`` it is rejected.

Nulls and empty texts get the votes of a text without words. Repeated rows count each, and are
scored alike. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import FINE_SLICE, Texts, slices, texts_of, word_hashes, words_of
from .exchange import discard, stored
from .letters import CLASS, sums, windows
from .quality_rules import SYMBOL, duplicate_lines

SAMPLE = 1000
SLOTS = 1 << 16
ROUNDS = 80
REJECT = 0.25
BAD, GOOD, NONE = 0, 1, 2

FEW = 20  # words (or letters) below which shares say nothing
# measure, bad from (or up to), good up to (or from); between them, or of too few words, no vote
LABELLERS = (
    ("symbol_share", ">=", 0.04, 0.01),  # of characters that aren't blank
    ("upper_share", ">=", 0.5, 0.15),  # of letters
    ("short_words", "<=", 0.04, 0.15),  # share of words of up to three bytes, of those with a letter
    ("different_words", "<=", 0.2, 0.4),  # share, of texts with at least 20 words
    ("longest_run", ">=", 4, 2),  # of one word
    ("bare_marks", ">=", 0.15, 0.02),  # share of words without a letter or digit at their start
    ("line_copies", ">=", 0.5, 0.1),  # share of lines that equal an earlier one
)
STEPS = 8  # of a measure, as a hashed feature


def measures(texts: Texts) -> np.ndarray:
    """A row per text, a column per labeller."""
    words = words_of(texts)
    n = words.per_text
    some = np.maximum(n, 1)
    data = texts.data
    solid = np.maximum(sums((data > 0x20).astype(np.int32), texts), 1)
    letters = sums(((CLASS[data] >= 1) & (CLASS[data] < 53)).astype(np.int32), texts)
    upper = sums(((CLASS[data] >= 27) & (CLASS[data] < 53)).astype(np.int32), texts)
    owner = words.text_of_word()
    first = CLASS[data[words.start]]
    lettered = (first >= 1) & (first <= 53) | (first >= 61)
    solid_words = np.bincount(owner[lettered], minlength=len(texts))
    short = np.bincount(owner[lettered & (words.end - words.start <= 3)], minlength=len(texts))
    hashes = word_hashes(texts, words)
    order = np.lexsort((hashes, owner))
    new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])][: len(order)]
    different = np.bincount(owner[order][new], minlength=len(texts))
    start = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])][: len(hashes)])
    run = np.zeros(len(texts), np.int64)
    np.maximum.at(run, owner[start], np.diff(np.r_[start, len(hashes)]))
    lines = np.bincount(np.repeat(np.arange(len(texts)), np.diff(texts.at))[data == 0x0A], minlength=len(texts)) + 1
    copies = np.array([duplicate_lines(texts.part(t)) for t in range(len(texts))], float)
    enough = n >= FEW
    return np.stack(
        [
            sums(SYMBOL[data].astype(np.int32), texts) / solid,
            np.where(letters >= FEW, upper / np.maximum(letters, 1), np.nan),
            np.where(solid_words >= FEW, short / np.maximum(solid_words, 1), np.nan),
            np.where(enough, different / some, np.nan),
            run.astype(float),
            np.where(enough, 1 - solid_words / some, np.nan),
            np.where(enough, copies / lines, np.nan),
        ],
        axis=1,
    )


def votes(m: np.ndarray) -> np.ndarray:
    out = np.full(m.shape, NONE, np.int64)
    for k, (_, side, bad, good) in enumerate(LABELLERS):
        sign = 1 if side == ">=" else -1
        out[sign * m[:, k] >= sign * bad, k] = BAD
        out[sign * m[:, k] <= sign * good, k] = GOOD
    return out


def patterns(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass(frozen=True)
class LabelModel:
    good: float  # share of good texts
    tables: np.ndarray  # [class][labeller][vote]; a withheld vote (1 in both classes) says nothing

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good."""
        v = votes_of(np.asarray(pattern, np.int64))
        at = np.arange(v.shape[1])
        logs = [np.log(p) + np.log(self.tables[c][at, v]).sum(1) for c, p in ((BAD, 1 - self.good), (GOOD, self.good))]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Per labeller: probability that a vote, if given, is right."""
        return (1 - self.good) * self.tables[BAD][:, BAD] + self.good * self.tables[GOOD][:, GOOD]


def fit_labels(pattern: np.ndarray, n: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation on pattern counts; starts from texts without any bad vote being good."""
    v, n = votes_of(pattern), n.astype(float)
    good = np.where((v == BAD).any(1), 0.2, 0.95)
    model = None
    for _ in range(rounds):
        tables = np.ones((2, v.shape[1], 3))  # one of each vote beforehand
        for c, w in ((BAD, n * (1 - good)), (GOOD, n * good)):
            for k in range(v.shape[1]):
                tables[c, k] += np.bincount(v[:, k], w, 3)
        tables /= tables[:, :, :NONE].sum(2, keepdims=True)
        tables[:, :, NONE] = 1
        model = LabelModel(float((n @ good + 1) / (n.sum() + 2)), tables)
        now = model.posterior(pattern)
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return model


def _hashed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def step_slots(m: np.ndarray) -> np.ndarray:
    """Slots of the measures' steps: between the good and the bad limit, with a step beyond each and one for no measure."""
    out = np.zeros(m.shape, np.int64)
    for k, (_, _, bad, good) in enumerate(LABELLERS):
        step = np.clip(np.floor((m[:, k] - good) / (bad - good) * (STEPS - 2)) + 1, 0, STEPS - 1)
        step = np.where(np.isnan(step), STEPS, step)
        out[:, k] = _hashed((1 << 20) + k * (STEPS + 1) + step.astype(np.int64))
    return out


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def scores(self, texts: Texts, m: np.ndarray) -> np.ndarray:
        """Probability of a good text."""
        size = np.maximum(np.diff(texts.at), 1)
        total = sums(self.weights[_hashed(windows(texts, 3))], texts) * (WINDOW_SCALE / size)
        total += self.weights[step_slots(m)].sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


WINDOW_SCALE = 10.0  # the shares of windows add up to this


def sparse(texts: Texts, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text."""
    slot = _hashed(windows(texts, 3))
    out = []
    for t, steps in enumerate(step_slots(m)):
        own, n = np.unique(slot[texts.at[t] : texts.at[t + 1]], return_counts=True)
        out.append((np.r_[own, steps], np.r_[n * (WINDOW_SCALE / max(n.sum(), 1)), np.ones(len(steps))]))
    return out


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, weight: np.ndarray) -> Scorer:
    """Weighted logistic regression by adaptive gradient steps."""
    slot = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    own = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    w, bias = np.zeros(SLOTS), 0.0
    square, square_bias = np.full(SLOTS, 1e-8), 1e-8
    weight = weight / weight.sum()
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(own, value * w[slot], len(rows)) + bias, -500, 500)))
        error = weight * (p - target)
        g = np.bincount(slot, value * error[own], SLOTS) + 1e-6 * w
        square += g * g
        w -= 0.3 * g / np.sqrt(square)
        square_bias += error.sum() ** 2
        bias -= 0.3 * error.sum() / np.sqrt(square_bias)
    return Scorer(w, bias)


def train(documents: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, Scorer] | None:
    """Label model over all texts of documents(doc_id, text), scorer on the bounded sample."""

    def vote(batches):
        for batch in batches:
            for part in slices(batch, "text", FINE_SLICE):
                found = patterns(votes(measures(texts_of(part.column("text")))))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found)], ["row", "pattern"])

    # rows are drawn by what they hold: null and repeated ids take part, and a retry draws the same
    row = F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), "doc_id", "text")
    documents = documents.select(row.alias("row"), "text")
    voted, path = stored(documents.mapInArrow(vote, "row long, pattern long"), "votes")
    table = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toArrow()
    pattern, n = table.column("pattern").to_numpy(), table.column("n").to_numpy()
    if not len(pattern):
        return None
    labels = fit_labels(pattern, n)
    good = labels.posterior(pattern) >= 0.5
    drawn: dict[int, None] = {}
    for side in (True, False):
        own = [int(p) for p in pattern[good == side]]
        rows = voted.where(F.col("pattern").isin(own)) if own else voted.limit(0)
        rows = rows.select("row").distinct().orderBy("row").limit(sample)
        drawn.update(dict.fromkeys(r.row for r in rows.collect()))
    discard(documents.sparkSession, path)
    wanted = documents.sparkSession.sparkContext.broadcast(np.array(sorted(drawn), np.int64))

    def gather(batches):
        for batch in batches:
            batch = batch.filter(pa.array(np.isin(batch.column("row").to_numpy(), wanted.value)))
            for part in slices(batch, "text", FINE_SLICE):
                texts = texts_of(part.column("text"))
                m = measures(texts)
                rows = sparse(texts, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        pa.array(patterns(votes(m))),
                        pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()),
                        pa.array([r[1].astype(np.float32).tobytes() for r in rows], pa.binary()),
                    ],
                    ["row", "pattern", "slots", "shares"],
                )

    found = documents.mapInArrow(gather, "row long, pattern long, slots binary, shares binary")
    found = found.dropDuplicates(["row"]).toPandas().sort_values("row", ignore_index=True)
    target = labels.posterior(found["pattern"].to_numpy())
    rows = [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for s, v in zip(found["slots"], found["shares"])]
    side = target >= 0.5
    weight = np.where(side, 1 / max(side.sum(), 1), 1 / max((~side).sum(), 1))
    return labels, fit_scorer(rows, target, weight)


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def classify(documents: DataFrame, sample: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """doc_id, weak (posterior of the votes), score (of the scorer), kept, per row of documents(doc_id, text)."""
    docs = _plain(documents)
    models = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text", FINE_SLICE):
                labels, scorer = models.value
                texts = texts_of(part.column("text"))
                m = measures(texts)
                score = scorer.scores(texts, m)
                weak = labels.posterior(patterns(votes(m)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(weak.round(6)), pa.array(score.round(6)), pa.array(score >= reject)],
                    ["doc_id", "weak", "score", "kept"],
                )

    return docs.mapInArrow(rows, "doc_id long, weak double, score double, kept boolean")


def keep_good(documents: DataFrame, sample: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """The rows of documents, all columns, that the classifier doesn't reject."""
    models = documents.sparkSession.sparkContext.broadcast(train(_plain(documents), sample))

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text", FINE_SLICE):
                texts = texts_of(part.column("text"))
                yield part.filter(pa.array(models.value[1].scores(texts, measures(texts)) >= reject))

    return documents.mapInArrow(rows, documents.schema)
