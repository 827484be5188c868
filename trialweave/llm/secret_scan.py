"""Secrets: probabilistic automata learned from labelled credentials score every candidate.

Patterns label credentials in the corpus itself (assigned values, access keys, long hex runs); they
are the base spans. All distinct labelled values, and as the background all other distinct runs of token characters in the
texts that hold one (texts without are where credentials that no pattern labels are looked for), grow prefix trees over
character classes, counted by Spark. States whose outgoing frequencies agree within the
Hoeffding bound everywhere below are merged, round by round (``learn_all``), into probabilistic automata. What the driver holds is
their states. Then every run of at least ``SHORTEST`` token characters, or what base spans leave of
it, is scored: its log likelihood under the automaton minus that under the background. It is a span of
kind ``token`` if that outweighs how much rarer distinct credentials are than distinct other runs, and exceeds the ratio
of all but one in 200 of those. So short runs must be very unlike words.

Without labelled values there is no automaton and nothing is added. Nulls and empty texts have no
spans; repeated rows are judged each on its own; other columns than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .exchange import discard, stored
from .spans import Span, Taken, span_table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token")
STEPS = 1000  # ratios are counted in steps of one thousandth
SHORTEST = 6  # as short as a labelled credential
ALPHA = 0.05  # of the Hoeffding bound
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{SHORTEST},}}")
_EDGE = ".-=/"  # marks around a run, not of it
CACHED = 1 << 18  # verdicts on distinct runs that a task remembers

CLASSES = {
    **dict.fromkeys("0123456789", 0), **dict.fromkeys("abcdef", 1), **dict.fromkeys("ghijklmnopqrstuvwxyz", 2),
    **dict.fromkeys("ABCDEF", 3), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", 4),
    "+": 5, "/": 6, "_": 7, "=": 8, "-": 9, ".": 10,
}
SYMBOLS = 12  # the last: anything else


def classes_of(value: str) -> list[int]:
    return [CLASSES.get(c, SYMBOLS - 1) for c in value]


def base_spans(text: str) -> list[Span]:
    """Leftmost matches per kind that don't overlap; those that are too short are dropped."""
    out: list[Span] = []
    low = text.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


@dataclass(frozen=True)
class Automaton:
    """moves[state][symbol] = (next state, log probability); ends[state] = log probability."""

    moves: list[dict[int, tuple[int, float]]]
    ends: list[float]
    floor: float = math.log(1e-4)

    def score(self, symbols: list[int]) -> float:
        """Log likelihood; an unknown move costs ``floor`` and starts afresh."""
        state, total = 0, 0.0
        for s in symbols:
            state, p = self.moves[state].get(s, (0, self.floor))
            total += p
        return total + max(self.ends[state], self.floor)


def learn(words: list[list[int]], alpha: float = ALPHA) -> Automaton:
    """Merges compatible states of the prefix tree of a few words, one after the other."""
    moves: list[dict[int, int]] = [{}]
    flow: list[dict[int, int]] = [{}]  # how often each move is taken
    ends = [0]
    for w in words:
        at = 0
        for s in w:
            if s not in moves[at]:
                moves[at][s] = len(moves)
                moves.append({})
                flow.append({})
                ends.append(0)
            flow[at][s] = flow[at].get(s, 0) + 1
            at = moves[at][s]
        ends[at] += 1

    def total(q: int) -> int:
        return ends[q] + sum(flow[q].values())

    bound = _bound(alpha)

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = total(p), total(q)
            if not n or not m:
                continue
            if differ(ends[p], n, ends[q], m):
                return False
            for s in flow[p].keys() | flow[q].keys():
                if differ(flow[p].get(s, 0), n, flow[q].get(s, 0), m):
                    return False
                if s in moves[p] and s in moves[q]:
                    todo.append((moves[p][s], moves[q][s]))
        return True

    def fold(p: int, q: int) -> None:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            ends[p] += ends[q]
            for s, n in flow[q].items():
                flow[p][s] = flow[p].get(s, 0) + n
                if s in moves[p]:
                    todo.append((moves[p][s], moves[q][s]))
                else:
                    moves[p][s] = moves[q][s]

    red = [0]
    while True:
        blue = [(total(q), -q, p, s) for p in red for s, q in moves[p].items() if q not in red]
        if not blue:
            break
        _, q, p, s = max(blue)
        q = -q
        for r in red:
            if compatible(r, q):
                moves[p][s] = r
                fold(r, q)
                break
        else:
            red.append(q)
    number = {q: i for i, q in enumerate(red)}
    out = []
    for q in red:
        n = total(q) + SYMBOLS + 1  # one more of everything
        out.append({s: (number[moves[q][s]], math.log((c + 1) / n)) for s, c in flow[q].items()})
    return Automaton(out, [math.log((ends[q] + 1) / (total(q) + SYMBOLS + 1)) for q in red])


@dataclass(frozen=True)
class Scorer:
    credentials: Automaton
    ordinary: Automaton
    threshold: float

    def ratio(self, value: str) -> float:
        symbols = classes_of(value)
        return self.credentials.score(symbols) - self.ordinary.score(symbols)


def train(documents: DataFrame) -> Scorer | None:
    """Automata of all distinct labelled values and of all other distinct runs, and the threshold."""
    values, path = stored(_values(documents), "values")
    known = dict(values.groupBy("label").agg(F.sum("n")).collect())
    if not known.get(1):
        discard(documents.sparkSession, path)
        return None
    learned = learn_all(values)
    good, plain = learned[1], learned.get(0) or learn([[s] for s in range(SYMBOLS)])
    limit = math.log(max(known.get(0, 0) / known[1], 1.0))
    if known.get(0):
        limit = max(limit, _nearly_all(values.where("label = 0"), good, plain))
    discard(documents.sparkSession, path)
    return Scorer(good, plain, limit)


def _values(documents: DataFrame) -> DataFrame:
    """(label, symbols, n, id): class strings of the distinct labelled values (1) and the other runs (0) of their texts."""

    def labelled(batches):
        found: set[tuple[int, str]] = set()

        def batch_of():
            columns = [pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["label", "value"])

        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    if not text:
                        continue
                    spans = base_spans(text)
                    for kind, a, b in spans:
                        found.add((1, _ASSIGN.fullmatch(text[a:b])[2] if kind == "assign" else text[a:b]))
                    if spans:
                        found.update((0, text[a:b]) for a, b in candidates(text, spans))
                if len(found) >= CACHED:
                    yield batch_of()
                    found.clear()
        yield batch_of()

    def classed(batches):
        for batch in batches:
            symbols = [bytes(classes_of(v)) for v in batch.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(symbols, pa.binary())], ["label", "symbols"])

    values = documents.select("text").mapInArrow(labelled, "label int, value string").distinct()
    values = values.mapInArrow(classed, "label int, symbols binary")
    return values.groupBy("label", "symbols").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.xxhash64("symbols"))


def _nearly_all(values: DataFrame, good: Automaton, plain: Automaton) -> float:
    """What the ratio of all but one in 200 of the values doesn't exceed, in steps of 1 / ``STEPS``."""

    def ratios(batches):
        for batch in batches:
            score = [math.ceil(STEPS * (good.score(list(w)) - plain.score(list(w)))) for w in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(score, pa.int64()), batch.column("n")], ["ratio", "n"])

    bins = values.select("symbols", "n").mapInArrow(ratios, "ratio long, n long").groupBy("ratio").agg(F.sum("n").alias("n"))
    return bins.agg(F.expr("percentile(ratio, 0.995, n)")).first()[0] / STEPS


def learn_all(values: DataFrame, alpha: float = ALPHA) -> dict[int, Automaton]:
    """One automaton per label from all rows of values(label, symbols, n, id).

    In each round every string runs through the states so far; the rests of those that leave them by the same move
    are the prefix tree of a new state. Spark counts the nodes of these trees, joins each new state's nodes with
    the places that the same strings reach from the other states, and tells which pairs differ. A new state is merged with the first
    state, the larger first, that agrees everywhere, or stays. Nodes that one string visits differ from nothing
    under the bound and are left out of the comparison, not of the counts.
    """
    labels = sorted(r[0] for r in values.select("label").distinct().collect())
    moves: dict[int, list[dict[int, int]]] = {label: [{}] for label in labels}
    while True:
        tree, path = stored(_nodes(values, moves), "nodes")
        counts: dict[int, dict[int, list[int]]] = {label: {} for label in labels}
        near: dict[int, dict[tuple[int, int], list[int]]] = {label: {} for label in labels}
        for r in tree.where("length < 2").select("label", "node", "place", "counts").collect():
            near[r.label][r.node, r.place] = r.counts
            if r.node < 0:
                counts[r.label][-1 - r.node] = r.counts
        new = {
            label: sorted((-n, q * SYMBOLS + s) for q, c in counts[label].items() for s, n in enumerate(c[:SYMBOLS]) if n and s not in moves[label][q])
            for label in labels
        }
        if not any(new.values()):
            discard(values.sparkSession, path)
            break
        alike = {label: _alike(near[label], moves[label], [b for n, b in new[label] if n < -1], alpha) for label in labels}
        unlike = {tuple(r) for r in _differing(values, tree, moves, alike, alpha).collect()}
        for label in labels:
            # states by the name that the comparison gives them: -1 - number, or the move that leads there
            names = [(-1 - k, k) for k in range(len(moves[label]))]
            for _, b in new[label]:
                left = alike[label].get(b)
                to = next((k for name, k in names if left is None or name in left and (label, b, name) not in unlike), None)
                if to is None:
                    to = len(moves[label])
                    moves[label].append({})
                    names.append((b, to))
                moves[label][b // SYMBOLS][b % SYMBOLS] = to
        discard(values.sparkSession, path)
    out = {}
    for label in labels:
        states = [counts[label].get(q, [0] * (SYMBOLS + 1)) for q in range(len(moves[label]))]
        totals = [sum(c) + SYMBOLS + 1 for c in states]  # one more of everything
        out[label] = Automaton(
            [{s: (to, math.log((c[s] + 1) / n)) for s, to in m.items()} for m, c, n in zip(moves[label], states, totals)],
            [math.log((c[SYMBOLS] + 1) / n) for c, n in zip(states, totals)],
        )
    return out


def _bound(alpha: float) -> float:
    return math.sqrt(0.5 * math.log(2 / alpha))


def _alike(near: dict[tuple[int, int], list[int]], moves: list[dict[int, int]], new: list[int], alpha: float) -> dict[int, set[int]]:
    """For each new state the states, and new states before it, that agree with it in their own counts and one move on."""
    names = [-1 - k for k in range(len(moves))] + new
    step = [_child(0, s) for s in range(SYMBOLS)]
    counts = np.zeros((len(names), SYMBOLS + 1, SYMBOLS + 1))
    for k, x in enumerate(names):
        if x < 0:
            own = moves[-1 - x]
            places = [(x, 0), *((-1 - own[s] if s in own else (-1 - x) * SYMBOLS + s, 0) for s in range(SYMBOLS))]
        else:
            places = [(x, 0), *((x, place) for place in step)]
        for j, place in enumerate(places):
            if place in near:
                counts[k, j] = near[place]
    total = counts.sum(2)
    share = counts / np.maximum(total, 1)[:, :, None]
    slack = _bound(alpha) / np.sqrt(np.maximum(total, 1e-6))
    out = {}
    for k, b in enumerate(new):
        q = len(moves) + k
        far = (np.abs(share[:q] - share[q]).max(2) > slack[:q] + slack[q]).any(1)
        out[b] = {names[i] for i in np.flatnonzero(~far)}
    return out


def _child(place: int, symbol: int) -> int:
    """The hash of a path one symbol longer, as a signed 64-bit number."""
    x = ((place ^ (symbol + 1)) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)
    x ^= x >> 29
    return x - 2**64 if x >> 63 else x


def _nodes(values: DataFrame, moves: dict[int, list[dict[int, int]]]) -> DataFrame:
    """(label, node, place, total, counts, id, start, length): visits of states, and of tree nodes with two or more.

    States are nodes -1 - number at place 0; others are named by the move that leaves the states, and the hash of the path
    from there. ``counts`` has visits per next symbol, ends last; the path is length symbols of the string ``id`` from start on.
    """
    schema = "label int, node int, place long, symbol int, n long, id long, start int, length int"

    def walk(batches):
        seen: dict[tuple, list[int]] = {}

        def batch_of():
            keys = list(zip(*seen)) if seen else [()] * 4
            columns = [*keys, *(list(zip(*seen.values())) if seen else [()] * 4)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in schema.split(", ")])

        def visit(key, n, *where):
            if key in seen:
                seen[key][0] += n
            else:
                seen[key] = [n, *where]

        for batch in batches:
            for label, symbols, n, i in zip(*(batch.column(c).to_pylist() for c in ("label", "symbols", "n", "id"))):
                own, state, at = moves[label], 0, 0
                while at < len(symbols):
                    s = symbols[at]
                    visit((label, -1 - state, 0, s), n, 0, 0, 0)
                    at += 1
                    if s not in own[state]:
                        break
                    state = own[state][s]
                else:
                    visit((label, -1 - state, 0, SYMBOLS), n, 0, 0, 0)
                    continue
                node, place = state * SYMBOLS + s, 0
                for length in range(len(symbols) - at):
                    visit((label, node, place, symbols[at + length]), n, i, at, length)
                    place = _child(place, symbols[at + length])
                visit((label, node, place, SYMBOLS), n, i, at, len(symbols) - at)
                if len(seen) >= CACHED:
                    yield batch_of()
                    seen.clear()
        yield batch_of()

    visits = values.select("label", "symbols", "n", "id").mapInArrow(walk, schema)
    counts = F.array(*[F.sum(F.when(F.col("symbol") == s, F.col("n")).otherwise(0)) for s in range(SYMBOLS + 1)])
    nodes = visits.groupBy("label", "node", "place").agg(F.sum("n").alias("total"), counts.alias("counts"), F.min(F.struct("id", "start", "length")).alias("path"))
    return nodes.where("node < 0 or total > 1").select("label", "node", "place", "total", "counts", "path.*")


def _differing(values: DataFrame, tree: DataFrame, moves: dict, alike: dict[int, dict[int, set[int]]], alpha: float) -> DataFrame:
    """(label, node, other) of the pairs ``alike`` that differ after two or more moves."""
    schema = "label int, node int, other int, total long, counts array<long>, to_node int, to_place long"

    def pairs(batches):
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                label, symbols, own = row["label"], row["symbols"], moves[row["label"]]
                by_start: dict[tuple[int, int], dict[int, dict]] = {}
                for x in row["found"]:
                    by_start.setdefault((x["node"], x["start"]), {})[x["length"]] = x
                for (node, start), found in by_start.items():
                    for other in alike[label][node]:
                        at_node, place = other, 0
                        for length in range(max(found) + 1):
                            if length in found:
                                x = found[length]
                                out.append((label, node, other, x["total"], x["counts"], at_node, place))
                            if start + length == len(symbols):
                                break
                            s = symbols[start + length]
                            if at_node >= 0:
                                place = _child(place, s)
                            else:
                                state = -1 - at_node
                                at_node = -1 - own[state][s] if s in own[state] else state * SYMBOLS + s
                if len(out) >= CACHED >> 2:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    def batch_of(out):
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64()]
        names = ["label", "node", "other", "total", "counts", "to_node", "to_place"]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)

    found = tree.where("node >= 0 and length > 1").groupBy("label", "id").agg(F.collect_list(F.struct("node", "place", "start", "length", "total", "counts")).alias("found"))
    asked = found.join(values.select("label", "id", "symbols"), ["label", "id"]).mapInArrow(pairs, schema)
    there = tree.select("label", F.col("node").alias("to_node"), F.col("place").alias("to_place"), F.col("total").alias("m"), F.col("counts").alias("there"))
    apart = f"exists(zip_with(counts, there, (a, b) -> abs(a / total - b / m)), d -> d > {_bound(alpha)!r} * (1 / sqrt(total) + 1 / sqrt(m)))"
    return asked.join(there, ["label", "to_node", "to_place"]).where(apart).select("label", "node", "other").distinct()


def candidates(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Runs of token characters, without marks at their ends, outside the spans; covered runs leave their rests."""
    out: list[tuple[int, int]] = []
    covered = Taken(spans).stretches
    k = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.start(), m.end()
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        rests, at, j = [], start, k
        while j < len(covered) and covered[j][0] < end:
            rests.append((at, covered[j][0]))
            at = max(at, covered[j][1])
            j += 1
        rests.append((at, end))
        for a, b in rests:
            while a < b and text[a] in _EDGE:
                a += 1
            while b > a and text[b - 1] in _EDGE:
                b -= 1
            if b - a >= SHORTEST:
                out.append((a, b))
    return out


def added_spans(text: str, base: list[Span], scorer: Scorer | None, seen: dict[str, bool] | None = None) -> list[Span]:
    """Candidates that the automata take for credentials; ``seen`` keeps verdicts on runs that come again."""
    if scorer is None:
        return []
    seen = {} if seen is None else seen
    out: list[Span] = []
    for a, b in candidates(text, base):
        value = text[a:b]
        good = seen.get(value)
        if good is None:
            if len(seen) >= CACHED:
                seen.clear()
            good = seen[value] = scorer.ratio(value) > scorer.threshold
        if good:
            out.append(("token", a, b))
    return out


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row of documents(doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scorer = docs.sparkSession.sparkContext.broadcast(train(docs))

    def find():
        own, seen = scorer.value, {}

        def spans(text: str):
            base = base_spans(text)
            return base, added_spans(text, base, own, seen)

        return spans

    return span_table(docs, BASE, KINDS, find)
