"""Model specification: predictors with codings, fixed terms, random terms."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .contrasts import CODINGS, column_names


@dataclass(frozen=True)
class Factor:
    """Categorical predictor with explicit level order."""

    name: str
    levels: tuple
    coding: str = "treatment"

    def codes(self, values: Sequence) -> np.ndarray:
        rows = {level: i for i, level in enumerate(self.levels)}
        unknown = sorted({str(v) for v in values if v not in rows})
        if unknown:
            raise ValueError(f"{self.name}: values outside the levels: {', '.join(unknown)}")
        return CODINGS[self.coding](len(self.levels))[[rows[v] for v in values]]

    @property
    def columns(self) -> list[str]:
        return column_names(self.name, self.levels, self.coding)

    def expressions(self) -> list[Column]:
        table = CODINGS[self.coding](len(self.levels))
        out = []
        for j in range(len(self.levels) - 1):
            expr = None
            for level, row in zip(self.levels, table):
                cond = F.col(self.name) == F.lit(level)
                expr = (F if expr is None else expr).when(cond, F.lit(float(row[j])))
            out.append(expr)
        return out


@dataclass(frozen=True)
class Numeric:
    """Numeric predictor."""

    name: str

    def codes(self, values: Sequence) -> np.ndarray:
        return np.asarray(values, dtype=float)[:, None]

    @property
    def columns(self) -> list[str]:
        return [self.name]

    def expressions(self) -> list[Column]:
        return [F.col(self.name).cast("double")]


@dataclass(frozen=True)
class Random:
    """Random intercept and/or slopes by one grouping column."""

    group: str
    terms: tuple[tuple[str, ...], ...] = ()
    intercept: bool = True


@dataclass(frozen=True)
class Model:
    """``response ~ fixed + random``; a term is a tuple of predictor names (interaction if > 1).

    At most two random groupings, units and items. Units are eliminated first, inside the tasks;
    name the larger grouping first.
    """

    response: str
    predictors: tuple = ()
    fixed: tuple[tuple[str, ...], ...] = ()
    intercept: bool = True
    random: tuple[Random, ...] = field(default=())

    @property
    def variables(self) -> list[str]:
        return [p.name for p in self.predictors]

    def _term_columns(self, terms, intercept) -> list[tuple[str, list[tuple[int, int]]]]:
        """(column name, [(predictor, code column), ...]) per design column."""
        index = {p.name: i for i, p in enumerate(self.predictors)}
        out = [("(Intercept)", [])] if intercept else []
        for term in terms:
            parts = [
                [(index[v], j, c) for j, c in enumerate(self.predictors[index[v]].columns)]
                for v in term
            ]
            # the first factor of an interaction varies fastest
            for combo in itertools.product(*reversed(parts)):
                combo = combo[::-1]
                out.append((":".join(c for _, _, c in combo), [(i, j) for i, j, _ in combo]))
        return out

    def matrix(self, points: dict[str, Sequence], terms=None, intercept=None) -> np.ndarray:
        """Design rows for the given predictor values (default: the fixed part)."""
        terms = self.fixed if terms is None else terms
        intercept = self.intercept if intercept is None else intercept
        codes = [p.codes(points[p.name]) for p in self.predictors]
        n = len(next(iter(points.values()))) if points else 1
        cols = []
        for _, parts in self._term_columns(terms, intercept):
            c = np.ones(n)
            for i, j in parts:
                c = c * codes[i][:, j]
            cols.append(c)
        return np.stack(cols, axis=1) if cols else np.zeros((n, 0))

    def fixed_names(self) -> list[str]:
        return [name for name, _ in self._term_columns(self.fixed, self.intercept)]

    def random_names(self, r: Random) -> list[str]:
        return [name for name, _ in self._term_columns(r.terms, r.intercept)]

    def expressions(self, terms=None, intercept=None) -> list[Column]:
        """Design columns as Spark columns (default: the fixed part)."""
        terms = self.fixed if terms is None else terms
        intercept = self.intercept if intercept is None else intercept
        codes = [p.expressions() for p in self.predictors]
        out = []
        for _, parts in self._term_columns(terms, intercept):
            e = F.lit(1.0)
            for i, j in parts:
                e = e * codes[i][j]
            out.append(e.cast("double"))
        return out

    def column_expressions(self) -> list[tuple[str, Column]]:
        """Fixed part as Spark columns (without the intercept)."""
        exprs = [p.expressions() for p in self.predictors]
        out = []
        for name, parts in self._term_columns(self.fixed, False):
            e = None
            for i, j in parts:
                e = exprs[i][j] if e is None else e * exprs[i][j]
            out.append((name, e))
        return out
