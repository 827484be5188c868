"""What a fit holds, and the small tables made of it."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .design import Model


def theta_start(q: int) -> np.ndarray:
    return np.eye(q)[np.tril_indices(q)]


def lower_triangle(theta: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros((q, q), dtype=np.asarray(theta).dtype)
    out[np.tril_indices(q)] = theta
    return out


def newton_direction(grad: np.ndarray, hess: np.ndarray, limit: float = 2.0) -> np.ndarray:
    """Downhill Newton step: curvatures in absolute value, steps bounded."""
    values, vectors = np.linalg.eigh(hess)
    floor = 1e-8 * max(1.0, float(np.max(np.abs(values))))
    step = -vectors @ ((vectors.T @ grad) / np.maximum(np.abs(values), floor))
    return step * min(1.0, limit / max(limit, float(np.max(np.abs(step)))))


def inverse_logit(eta: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * eta))


def normal_tail(z: float) -> float:
    """Two-sided p of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


@dataclass
class Fit:
    model: Model
    family: str
    beta: np.ndarray
    cov: np.ndarray
    covariances: list[np.ndarray]
    sigma2: float
    deviance: float
    reml: bool
    rows: int
    units: int
    theta: np.ndarray
    converged: bool
    compressed: Any = None

    @property
    def parameters(self) -> int:
        return len(self.beta) + len(self.theta) + (self.family == "gaussian")

    @property
    def singular(self) -> bool:
        """A standard deviation at zero or a correlation at +-1."""
        at = 0
        for c in self.covariances:
            q = len(c)
            lam = lower_triangle(self.theta[at : at + q * (q + 1) // 2], q)
            at += q * (q + 1) // 2
            if np.any(np.abs(np.diag(lam)) < 1e-4):
                return True
        return False

    def coefficients(self, spark: SparkSession, level: float = 0.95) -> DataFrame:
        """Term, estimate, standard error, z (t), Wald p, interval, and exp(estimate) for logits."""
        z = normal_quantile(0.5 + level / 2.0)
        rows = []
        for name, b, v in zip(self.model.fixed_names(), self.beta, np.diag(self.cov)):
            se = math.sqrt(v) if v > 0 else math.nan
            rows.append(
                (name, float(b), se, float(b / se), normal_tail(b / se), float(b - z * se),
                 float(b + z * se), math.exp(b) if self.family == "binomial" else None)
            )
        return spark.createDataFrame(
            rows,
            "term string, estimate double, std_error double, statistic double, p_value double, "
            "low double, high double, odds_ratio double",
        )

    def variance_components(self, spark: SparkSession) -> DataFrame:
        """Variances and covariances of each grouping and the residual variance."""
        rows = []
        for r, c in zip(self.model.random, self.covariances):
            names = self.model.random_names(r)
            for i in range(len(names)):
                for j in range(i + 1):
                    sd = math.sqrt(max(c[i, i] * c[j, j], 0.0))
                    corr = float(c[i, j] / sd) if i != j and sd > 0 else None
                    rows.append((r.group, names[i], names[j], float(c[i, j]), corr))
        if self.family == "gaussian":
            rows.append(("Residual", None, None, self.sigma2, None))
        return spark.createDataFrame(
            rows, "grouping string, term string, with_term string, covariance double, corr double"
        )

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: log-likelihood, deviance, AIC, sizes and flags."""
        return spark.createDataFrame(
            [(
                -self.deviance / 2.0, self.deviance, self.deviance + 2.0 * self.parameters,
                self.parameters, self.rows, self.units, self.reml, self.singular,
                bool(self.converged),
            )],
            "log_lik double, deviance double, aic double, parameters int, n_rows long, "
            "n_units long, reml boolean, singular boolean, converged boolean",
        )
