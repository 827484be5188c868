"""Estimated marginal means and their pairwise contrasts."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .degrees import range_tail, satterthwaite, t_quantile, t_tail
from .design import Factor
from .fit import Fit, normal_quantile, normal_tail


def _grid(fit: Fit, by: Sequence[str], at: dict[str, Sequence] | None):
    """Reference grid over ``by`` and the averaged design row of each of its cells."""
    levels = {}
    for p in fit.model.predictors:
        if at and p.name in at:
            levels[p.name] = list(at[p.name])
        elif isinstance(p, Factor):
            levels[p.name] = list(p.levels)
        else:
            raise ValueError(f"give the values of the numeric predictor {p.name!r} in `at`")
    names = list(levels)
    combos = list(itertools.product(*levels.values()))
    x = fit.model.matrix({v: [c[i] for c in combos] for i, v in enumerate(names)})
    where = [names.index(b) for b in by]
    cells = list(dict.fromkeys(tuple(c[i] for i in where) for c in combos))
    rows = np.array(
        [x[[tuple(c[i] for i in where) == cell for c in combos]].mean(axis=0) for cell in cells]
    )
    return cells, rows


def marginal_means(
    spark: SparkSession,
    fit: Fit,
    by: Sequence[str],
    response: bool = False,
    at: dict[str, Sequence] | None = None,
    level: float = 0.95,
    df: str = "normal",
) -> DataFrame:
    """Mean per cell of ``by``, other factors averaged with equal weight.

    Intervals and tests are normal, or with ``df="satterthwaite"`` (linear mixed models) those of t
    with estimated degrees of freedom, in a further column ``df``. ``response=True`` gives probabilities for logistic fits (interval ends transformed, delta
    standard errors); the test is always against 0 on the link scale.
    """
    cells, rows = _grid(fit, by, at)
    degrees = _degrees(fit, df)
    out = []
    for cell, row in zip(cells, rows):
        est, se, free = float(row @ fit.beta), math.sqrt(row @ fit.cov @ row), degrees(row)
        z = t_quantile(0.5 + level / 2.0, free) if free else normal_quantile(0.5 + level / 2.0)
        low, high, stat = est - z * se, est + z * se, est / se
        if response and fit.family == "binomial":
            probs = [1.0 / (1.0 + math.exp(-v)) for v in (est, low, high)]
            se = se * probs[0] * (1.0 - probs[0])
            est, low, high = probs
        p_value = t_tail(stat, free) if free else normal_tail(stat)
        out.append((*[str(c) for c in cell], est, se, low, high, stat, p_value, free))
    fields = ", ".join(f"`{b}` string" for b in by)
    table = spark.createDataFrame(
        out,
        f"{fields}, estimate double, std_error double, low double, high double, "
        "statistic double, p_value double, df double",
    )
    return table if df == "satterthwaite" else table.drop("df")


def _degrees(fit: Fit, df: str):
    if df == "normal":
        return lambda row: None
    if df != "satterthwaite":
        raise ValueError(f"unknown degrees of freedom: {df!r}")
    return satterthwaite(fit)


def tukey_tail(z: float, k: int) -> float:
    """P(range of k standard normals > |z| sqrt 2), by quadrature."""
    q = abs(z) * math.sqrt(2.0)
    x = np.linspace(-8.0, 8.0 + q, 8001)
    phi = np.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in x])
    shifted = np.array([0.5 * math.erfc(-(v - q) / math.sqrt(2.0)) for v in x])
    inside = k * np.trapezoid(phi * (cdf - shifted) ** (k - 1), x)
    return float(min(1.0, max(0.0, 1.0 - inside)))


def pairwise(
    spark: SparkSession,
    fit: Fit,
    by: Sequence[str],
    at: dict[str, Sequence] | None = None,
    df: str = "normal",
) -> DataFrame:
    """All differences between marginal means with Wald and Tukey-adjusted p.

    ``df="satterthwaite"``: tails of t and of the studentised range, and a column ``df``.
    """
    cells, rows = _grid(fit, by, at)
    degrees = _degrees(fit, df)
    out = []
    for i, j in itertools.combinations(range(len(cells)), 2):
        row = rows[i] - rows[j]
        est, se = float(row @ fit.beta), math.sqrt(row @ fit.cov @ row)
        label = " - ".join(" ".join(str(v) for v in cells[c]) for c in (i, j))
        stat, free = est / se, degrees(row)
        if free:
            tails = t_tail(stat, free), range_tail(abs(stat) * math.sqrt(2.0), len(cells), free)
        else:
            tails = normal_tail(stat), tukey_tail(stat, len(cells))
        out.append((label, est, se, stat, *tails, math.exp(est) if fit.family == "binomial" else None, free))
    table = spark.createDataFrame(
        out,
        "contrast string, estimate double, std_error double, statistic double, p_value double, "
        "p_tukey double, odds_ratio double, df double",
    )
    return table if df == "satterthwaite" else table.drop("df")
