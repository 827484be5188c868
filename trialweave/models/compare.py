"""Likelihood-ratio comparison of fits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .design import Model
from .fit import Fit
from .lmm import refit_ml


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of chi-square: regularised incomplete gamma by series or continued fraction."""
    if df <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    a, x = df / 2.0, x / 2.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h


def complete_rows(df: DataFrame, models: Sequence[Model]) -> DataFrame:
    """Rows in which nothing that any of the models uses is missing."""
    used = {c for m in models for c in (m.response, *m.variables, *(r.group for r in m.random))}
    return df.dropna(subset=sorted(used))


def compare_fits(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    """Fits in order of size, each tested against the one before. REML fits are refitted by ML.

    Degrees of freedom are the difference in the number of parameters, random part included.
    Fits of different rows or families can't be compared: ``complete_rows`` gives models whose
    predictors are missing in different places one common table.
    """
    if len({(f.rows, f.family, f.model.response) for f in fits.values()}) > 1:
        raise ValueError("the fits differ in rows, family or response")
    ml: Sequence[tuple[str, Fit]] = [(name, refit_ml(f)) for name, f in fits.items()]
    ml = sorted(ml, key=lambda nf: nf[1].parameters)
    rows, before = [], None
    for name, f in ml:
        stat = df = p = None
        if before is not None:
            stat, df = before.deviance - f.deviance, f.parameters - before.parameters
            p = chi2_tail(stat, df) if df > 0 else None
        rows.append(
            (name, f.parameters, f.deviance + 2.0 * f.parameters, -f.deviance / 2.0, f.deviance,
             stat, df, p)
        )
        before = f
    return spark.createDataFrame(
        rows,
        "model string, parameters int, aic double, log_lik double, deviance double, "
        "chisq double, df int, p_value double",
    )
