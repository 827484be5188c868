"""Naming game: accuracy and response times by match of participant and actor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import num
from ..models import compare_fits, fit_lmm, marginal_means
from ..operators import derive, summarise
from ..operators.bootstrap import percentile_ci
from ..operators.quantiles import group_quantiles
from ..operators.units import null_safe_join
from .analysis import catalogue


def features(memory: DataFrame, race_labels: tuple[str, str] = ("white", "black")) -> DataFrame:
    out = derive.memory_match_features(memory.withColumn("rt", num("rt")), race_labels=race_labels)
    return out.withColumn("log_rt", F.ln("rt"))


def correct_first(memory: DataFrame, cutoff: float = 10_000) -> DataFrame:
    """Correct first guesses below the time cutoff."""
    return memory.filter(
        (F.col("first_guess_num") == 1) & (F.col("correct_response") == 1) & (F.col("rt") < cutoff)
    )


def accuracy(memory: DataFrame) -> DataFrame:
    keep = (F.col("first_guess_num") == 1) & (F.col("correct_response") == 1)
    return summarise.accuracy_rt(
        memory, ["ppt_gender", "figure_gender", "figure_race"], "first_guess_num", "rt", keep
    )


def match_summary(memory: DataFrame, cutoff: float = 10_000, replicates: int = 1000) -> DataFrame:
    """Mean of participant medians, plain and within-subject errors, bootstrap interval."""
    kept = correct_first(memory, cutoff)
    within = summarise.within_subject_se(kept, ["id"], ["LikeMeFeature"], "rt")
    medians = group_quantiles(kept, ["id", "LikeMeFeature"], "rt", {"rt": 0.5})
    ci = percentile_ci(medians, ["LikeMeFeature"], ["id"], "rt", replicates).drop("n")
    return null_safe_join(within, ci, ["LikeMeFeature"], "left")


def cutoff_report(
    spark: SparkSession, memory: DataFrame, cutoffs: Sequence[float] = (10_000, 6_000)
) -> DataFrame:
    """Slope of the match score against the null model for each time cutoff."""
    models = catalogue()
    out = None
    for cutoff in cutoffs:
        rows = correct_first(memory, cutoff)
        fits = {n: fit_lmm(rows, models[f"memory_{n}"][1]) for n in ("LikeMeFeatureNumeric", "null")}
        table = compare_fits(spark, fits).withColumn("cutoff", F.lit(float(cutoff)))
        out = table if out is None else out.unionByName(table)
    return out


def ordered_means(spark: SparkSession, memory: DataFrame, cutoff: float = 10_000) -> DataFrame:
    """Marginal means of the ordered match score."""
    rows = correct_first(memory, cutoff).withColumn(
        "LikeMeFeatureOrdered", F.col("LikeMeFeatureNumeric")
    )
    fit = fit_lmm(rows, catalogue()["memory_ordered"][1])
    return marginal_means(
        spark, fit, ["LikeMeFeatureOrdered"], at={"LikeMeFeatureNumeric": [0.0]}
    )
