"""Fixed-effects logistic regression with Spark ML on compressed cells."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import checkpointed
from .design import Model
from .fit import Fit
from .moments import cells_of


def fit_glm(
    df: DataFrame,
    model: Model,
    weight: str | None = None,
    tolerance: float = 1e-10,
    max_iter: int = 25,
) -> Fit:
    """Logistic fit of a 0/1 response; rows are first collapsed to weighted predictor cells."""
    cells = checkpointed(cells_of(df, model, weight))
    names = [f"_x{i}" for i in range(len(model.column_expressions()))]
    cols = [e.alias(n) for n, (_, e) in zip(names, model.column_expressions())]
    outcomes = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("y"), F.col("_s").alias("w")),
            F.struct(F.lit(0.0).alias("y"), (F.col("_n") - F.col("_s")).alias("w")),
        )
    )
    weighted = cells.select(*cols, outcomes.alias("_o")).select(
        *names, F.col("_o.y").alias("y"), F.col("_o.w").alias("w")
    ).filter("w > 0")
    if not names:
        raise ValueError("give at least one predictor")
    data = VectorAssembler(inputCols=names, outputCol="features").transform(weighted)
    found = GeneralizedLinearRegression(
        family="binomial", link="logit", weightCol="w", labelCol="y", featuresCol="features",
        fitIntercept=model.intercept, tol=tolerance, maxIter=max_iter,
    ).fit(data)
    beta = np.array([*found.coefficients])
    if model.intercept:
        beta = np.append(found.intercept, beta)
    information, rows = _information(cells, model, beta)
    # all entries of the covariance are needed for marginal means, Spark reports the diagonal
    cov = np.linalg.inv(information)
    return Fit(
        model=model, family="binomial", beta=beta, cov=cov, covariances=[], sigma2=1.0,
        deviance=float(found.summary.deviance), reml=False, rows=rows, units=0,
        theta=np.zeros(0), converged=int(found.summary.numIterations) < max_iter,
    )


def _information(cells: DataFrame, model: Model, beta: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of n mu (1 - mu) x x' over all predictor rows, and the number of trials, in one job."""
    # in the order of beta: a constant, if any, stands first
    x = [e.cast("double") for _, e in model.column_expressions()]
    x = [F.lit(1.0), *x] if model.intercept else x
    p = len(x)
    named = cells.select("_n", *[e.alias(f"_x{i}") for i, e in enumerate(x)])
    eta = sum((F.lit(float(b)) * F.col(f"_x{i}") for i, b in enumerate(beta)), F.lit(0.0))
    mu = 1.0 / (1.0 + F.exp(-eta))
    weighted = named.withColumn("_w", F.col("_n") * mu * (1.0 - mu))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i, j in pairs]
    found = weighted.agg(F.sum("_n").alias("n"), *sums).first()
    out = np.zeros((p, p))
    for i, j in pairs:
        out[i, j] = out[j, i] = found[f"_s{i}_{j}"]
    return out, int(found.n)
