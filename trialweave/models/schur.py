"""Elimination of item effects from a symmetric matrix, tile by tile and with derivatives.

The matrix has a row and column per item effect and, as its last tile, a border of a few more
(fixed effects and response, or a gradient). Every tile is an array (1 + k, rows, columns): the
values, then their derivatives in k parameters, which go through every step with the values. What
is left when all items are gone is the border's Schur complement, and the log determinant.

A matrix of one tile is eliminated where it is. Larger ones stay on the cluster as rows
(candidate, i, j, data), i >= j: absent tiles are zero and cost nothing, and tile columns that
don't touch each other are eliminated by the same job.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import stored

TILE = 256  # columns of a tile
TILES = "cand int, i int, j int, data binary"
_NAMES = ["cand", "i", "j", "data"]


def factor(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower Cholesky factor with derivatives, and the inverse of its values."""
    out = np.empty_like(a)
    out[0] = np.linalg.cholesky(a[0])
    inverse = np.linalg.solve(out[0], np.eye(a.shape[1]))
    for d in range(1, len(a)):
        inner = np.tril(inverse @ a[d] @ inverse.T)
        inner[np.diag_indices(len(inner))] /= 2.0
        out[d] = out[0] @ inner
    return out, inverse


def below(a: np.ndarray, lower: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """The factor's tile below the diagonal one: a times the inverse of lower, transposed."""
    out = np.empty_like(a)
    out[0] = a[0] @ inverse.T
    for d in range(1, len(a)):
        out[d] = (a[d] - out[0] @ lower[d].T) @ inverse.T
    return out


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x times y transposed."""
    out = x @ y[0].T
    out[1:] += x[0] @ y[1:].transpose(0, 2, 1)
    return out


def log_det(lower: np.ndarray) -> np.ndarray:
    diagonal = np.diagonal(lower, axis1=1, axis2=2)
    return np.append(2.0 * np.log(diagonal[0]).sum(), 2.0 * (diagonal[1:] / diagonal[0]).sum(1))


def eliminate_one(items: np.ndarray, border: np.ndarray, rest: np.ndarray):
    """A matrix of one tile: the border's complement, the log determinant, and the solution for the border."""
    lower, inverse = factor(items)
    x = below(border, lower, inverse)
    return rest - product(x, x), log_det(lower), inverse.T @ x[0].T


def levels_of(pattern: set[tuple[int, int]], columns: int) -> list[list[int]]:
    """Columns in an order of elimination; those of one level don't touch each other.

    Each level takes columns of few neighbours, as many as are independent, so a chain of tiles
    needs a logarithmic number of levels and separate blocks need one.
    """
    near: list[set[int]] = [set() for _ in range(columns)]
    for i, j in pattern:
        if i != j and max(i, j) < columns:
            near[i].add(j)
            near[j].add(i)
    left, out = set(range(columns)), []
    while left:
        most = 2 * min(len(near[c]) for c in left)
        level, taken = [], set()
        for c in sorted(left, key=lambda c: (len(near[c]), c)):
            if len(near[c]) > most:
                break
            if c not in taken:
                level.append(c)
                taken |= near[c]
        for c in level:
            for i in near[c]:
                near[i] |= near[c] - {i}
                near[i].discard(c)
        left -= set(level)
        out.append(level)
    return out


class Shape:
    """Sizes of the tiles; tile ``columns`` is the border. ``order``: tiles by their place in the elimination."""

    def __init__(self, effects: int, per_item: int, border: int, k: int, tile: int | None = None):
        self.width = max(1, (tile or TILE) // max(per_item, 1)) * max(per_item, 1)
        self.columns = -(-effects // self.width)
        self.effects, self.border, self.k = effects, border, k
        self.order = list(range(self.columns))

    def ordered(self, order: list[int]) -> Shape:
        out = copy.copy(self)
        out.order = order
        return out

    def place(self, i: int) -> slice:
        """Effects of a tile."""
        start = self.order[i] * self.width
        return slice(start, min(start + self.width, self.effects))

    def size(self, i: int) -> int:
        own = self.place(i) if i < self.columns else slice(0, self.border)
        return own.stop - own.start

    def read(self, data: bytes, i: int, j: int, layers: int | None = None) -> np.ndarray:
        return np.frombuffer(data).reshape(layers or self.k + 1, self.size(i), self.size(j))


def tile_rows(found) -> pa.RecordBatch:
    cand, i, j, data = zip(*found)
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip((cand, i, j, [np.ascontiguousarray(d).tobytes() for d in data]), types)], _NAMES
    )


def summed_tiles(tiles: DataFrame, shape: Shape, layers: int, partitions: int, then: Callable | None = None) -> DataFrame:
    """Tiles of equal (cand, i, j) added up; ``then(cand, i, j, tile)`` may change what comes out."""

    def add(batches: Iterator[pa.RecordBatch]):
        key, total = None, None

        def out():
            return tile_rows([(*key, then(*key, total) if then else total)])

        for batch in batches:
            for *own, data in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                if own != key:
                    if key is not None:
                        yield out()
                    key, total = own, np.zeros((layers, shape.size(own[1]), shape.size(own[2])))
                total += shape.read(data, own[1], own[2], layers)
        if key is not None:
            yield out()

    dealt = tiles.repartition(partitions, "cand", "i", "j").sortWithinPartitions("cand", "i", "j")
    return dealt.mapInArrow(add, TILES)


def eliminate(tiles: DataFrame, shape: Shape, candidates: int, partitions: int, solve: bool = False):
    """Per candidate (complement, log determinant, solution or None) of tiles on the cluster.

    The solution is that of the item effects for each border column; it has the items' size.
    """
    last = shape.columns
    levels = levels_of({(r.i, r.j) for r in tiles.select("i", "j").distinct().collect()}, last)
    natural, shape = shape, shape.ordered([c for level in levels for c in level])
    rank = {c: at for at, c in enumerate(shape.order)} | {last: last}

    def reordered(batches):
        for batch in batches:
            out = []
            for cand, i, j, data in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                turned = rank[i] < rank[j]
                tile = natural.read(data, i, j)
                out.append((cand, max(rank[i], rank[j]), min(rank[i], rank[j]), tile.transpose(0, 2, 1) if turned else tile))
            if out:
                yield tile_rows(out)

    tiles = tiles.mapInArrow(reordered, TILES)
    logs = [np.zeros(shape.k + 1) for _ in range(candidates)]
    rests = [np.zeros((shape.k + 1, shape.border, shape.border)) for _ in range(candidates)]
    factors = []
    for level in levels:
        own = [rank[c] for c in level]

        def column(batches):
            """Rows of one column in order, the diagonal tile first."""
            held: list = []

            def done():
                cand, c = held[0][0], held[0][2]
                lower, inverse = factor(held[0][3])
                yield (cand, -1, c, log_det(lower))
                if solve:
                    yield (cand, -2, c, inverse)
                panel = [(i, below(a, lower, inverse)) for _, i, _, a in held[1:]]
                for at, (i, x) in enumerate(panel):
                    if solve:
                        yield (cand, -3 - i, c, x[0])
                    for j, y in panel[: at + 1]:
                        yield (cand, i, j, -product(x, y))

            for batch in batches:
                for cand, i, j, data in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                    if held and (held[0][0], held[0][2]) != (cand, j):
                        for row in done():
                            yield tile_rows([row])
                        held.clear()
                    held.append((cand, i, j, shape.read(data, i, j)))
            if held:
                for row in done():
                    yield tile_rows([row])

        mine = tiles.where(F.col("j").isin(own)).repartition(partitions, "cand", "j").sortWithinPartitions("cand", "j", "i")
        made, _ = stored(mine.mapInArrow(column, TILES), "eliminated")
        for r in made.where("i = -1").collect():
            logs[r.cand] += np.frombuffer(r.data)
        factors.append(made)
        others = tiles.where(~F.col("j").isin(own)).unionByName(made.where("i >= 0"))
        tiles, _ = stored(summed_tiles(others, shape, shape.k + 1, partitions), "tiles")
    for r in tiles.where(F.col("i") == last).where(F.col("j") == last).collect():
        rests[r.cand] = shape.read(r.data, last, last).copy()
    solutions: list = [None] * candidates
    if solve:
        solutions = [np.zeros((shape.effects, shape.border)) for _ in range(candidates)]
        for made in reversed(factors):
            _back(made, shape, solutions)
    return list(zip(rests, logs, solutions))


def _back(made: DataFrame, shape: Shape, solutions: list[np.ndarray]) -> None:
    """Back substitution for the columns of one level, given the solution of later ones."""
    last = shape.columns
    known = [s.copy() for s in solutions]

    def apply(batches):
        for batch in batches:
            out = []
            for cand, i, j, data in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                i = -3 - i
                x = np.frombuffer(data).reshape(shape.size(i), shape.size(j))
                # the border's tile is the right side, all others act on what is known
                out.append((cand, -3, j, x.T if i == last else -x.T @ known[cand][shape.place(i)]))
            if out:
                yield tile_rows(out)

    sides = made.where("i <= -3").mapInArrow(apply, TILES)
    found: dict = {}
    for r in sides.collect():  # a few numbers per item effect
        side = np.frombuffer(r.data).reshape(shape.size(r.j), shape.border)
        found[r.cand, r.j] = found.get((r.cand, r.j), 0.0) + side
    for r in made.where("i = -2").collect():
        inverse = np.frombuffer(r.data).reshape(shape.size(r.j), shape.size(r.j))
        solutions[r.cand][shape.place(r.j)] = inverse.T @ found.get((r.cand, r.j), 0.0)
