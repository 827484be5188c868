"""Summaries: participant means to group means, contingency tables, within-subject errors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import strict_mean
from ..sources.work import checkpointed, stored
from .quantiles import group_quantiles
from .units import null_safe_join


def stage_means(
    df: DataFrame,
    stages: Sequence[Sequence[str]],
    value: str,
    scale: float = 1.0,
    na_rm: bool = True,
) -> DataFrame:
    """Repeated averaging from fine to coarse groupings; ``scale`` applies to the first stage."""
    mean = F.avg if na_rm else strict_mean
    out = df
    for i, by in enumerate(stages):
        expr = mean(F.col(value))
        out = out.groupBy(*by).agg((expr * scale if i == 0 and scale != 1.0 else expr).alias(value))
    return out


def spread(value: str, n: Column | None = None) -> dict[str, Column]:
    """Mean, sample sd, standard error over all rows (missing ones count), and row count."""
    n = F.count(F.lit(1)) if n is None else n
    return {
        "mean": F.avg(value),
        "sd": F.stddev_samp(value),
        "se": F.stddev_samp(value) / F.sqrt(n),
        "n": n,
    }


def multi_stage(
    df: DataFrame,
    stages: Sequence[Sequence[str]],
    by: Sequence[str],
    value: str,
    scale: float = 1.0,
    na_rm: bool = True,
) -> DataFrame:
    """Means over ``stages``, then mean/sd/se/n over ``by`` (empty: one global row)."""
    inner = stage_means(df, stages, value, scale, na_rm)
    return inner.groupBy(*by).agg(*[e.alias(k) for k, e in spread(value).items()])


def group_report(
    df: DataFrame,
    unit: Sequence[str],
    by: Sequence[str],
    value: str,
    scale: float = 100.0,
    replicates: int = 1000,
    seed: int = 999,
    na_rm: bool = True,
    digits: int | None = None,
) -> DataFrame:
    """Two-stage summary with percentile bootstrap interval over units."""
    from .bootstrap import percentile_ci

    groups = list(by)
    if not by:  # one global group
        df, by = df.withColumn("_all", F.lit(1)), ["_all"]
    means = stage_means(df, [[*unit, *by]], value, scale, na_rm)
    summary = means.groupBy(*by).agg(*[e.alias(k) for k, e in spread(value).items()])
    ci = percentile_ci(means, by, unit, value, replicates, seed).drop("n")
    out = null_safe_join(summary, ci, by, "left")
    if digits is not None:
        for c in ("mean", "sd", "se", "ci_low", "ci_high"):
            out = out.withColumn(c, F.bround(c, digits))
    return out if groups else out.drop("_all")


def summary_family(
    df: DataFrame, unit: Sequence[str], factors: Sequence[Sequence[str]], value: str, scale=1.0
) -> DataFrame:
    """The two-stage summary for many groupings in one job.

    Unit means are taken per (unit, grouping) with grouping sets, so the log is read once.
    ``grouping`` names the factors of the row.
    """
    every = list(dict.fromkeys(f for fs in factors for f in fs))
    sets = [[*unit, *fs] for fs in factors]
    cols = [F.col(c) for c in [*unit, *every]]
    means = df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        (F.avg(value) * scale).alias("_m"),
        *[F.grouping(c).alias(f"_g_{c}") for c in every],
    )
    name = F.concat_ws(" x ", *[F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in every])
    return (
        means.withColumn("grouping", name)
        .groupBy("grouping", *every)
        .agg(*[e.alias(k) for k, e in spread("_m").items()])
    )


def five_number(df: DataFrame, by: Sequence[str], value: str, group_limit: int | None = None):
    """Minimum, quartiles, mean, maximum and number of missing values."""
    kw = {} if group_limit is None else {"group_limit": group_limit}
    groups = list(by)
    if not by:
        df, by = df.withColumn("_all", F.lit(1)), ["_all"]
    quartiles = group_quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, **kw)
    rest = df.groupBy(*by).agg(
        F.min(value).alias("min"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
    )
    out = null_safe_join(rest, quartiles, by, "inner")
    return out if groups else out.drop("_all")


def contingency(df: DataFrame, factors: Sequence[str], max_cells: int | None = None) -> DataFrame:
    """Cell counts of all level combinations, zero cells included, missing levels dropped.

    Levels are distinct values of the aggregated cells, which are stored, so the data are read once;
    the grid, whose rows are the result's rows, is built from the level tables on the cluster. ``max_cells``
    refuses larger results, by exact counts.
    """
    present, _ = stored(
        df.dropna(subset=list(factors)).groupBy(*factors).agg(F.count(F.lit(1)).alias("n")), "cells"
    )
    levels = [present.select(f).distinct() for f in factors]
    if max_cells is not None:
        cells = math.prod(level.count() for level in levels)
        if cells > max_cells:
            raise ValueError(f"contingency table would have {cells} cells (limit {max_cells})")
    grid = levels[0]
    for level in levels[1:]:
        grid = grid.crossJoin(level)
    return null_safe_join(grid, present, factors, "left").withColumn(
        "n", F.coalesce(F.col("n"), F.lit(0))
    )


def contingency_wide(df: DataFrame, rows: Sequence[str], column: str, levels: Sequence) -> DataFrame:
    """Two-way table with the levels of ``column`` as columns."""
    return (
        df.groupBy(*rows).pivot(column, list(levels)).agg(F.count(F.lit(1))).fillna(0, list(levels))
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency of each value (or combination)."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def compare_key_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of the two tables with ``where`` = both / only_a / only_b."""
    tagged = a.select(*keys).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(
        b.select(*keys).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    )
    both = tagged.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return both.withColumn(
        "where",
        F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both")
        .when(F.col("_a") == 1, "only_a")
        .otherwise("only_b"),
    ).drop("_a", "_b")


def within_subject_se(
    df: DataFrame,
    unit: Sequence[str],
    condition: Sequence[str],
    value: str,
    z: float = 1.96,
) -> DataFrame:
    """Median per unit x condition, centred by unit, condition mean added back; se and interval.

    A unit has one cell per condition, so the window that centres it is small. Adding the
    condition mean back shifts a condition as a whole and leaves its sd alone; the shifted value
    is therefore not carried through another pass.
    """
    cells = group_quantiles(df, [*unit, *condition], value, {"_v": 0.5})
    cells = cells.withColumn(
        "_norm", F.col("_v") - F.avg("_v").over(Window.partitionBy(*unit))
    )
    root_n = F.sqrt(F.count(F.lit(1)))
    return cells.groupBy(*condition).agg(
        F.avg("_v").alias("mean"),
        (F.stddev_samp("_v") / root_n).alias("se"),
        (F.stddev_samp("_norm") / root_n).alias("se_norm"),
        (z * F.stddev_samp("_norm") / root_n).alias("ci_norm"),
        F.count(F.lit(1)).alias("n"),
    )


def accuracy_rt(
    df: DataFrame,
    by: Sequence[str],
    flag: str,
    value: str,
    keep: Column | None = None,
    na_rm: bool = False,
) -> DataFrame:
    """Mean of a 0/1 flag and mean time per group, on the rows that ``keep`` selects.

    A missing flag or time makes its group's mean missing unless ``na_rm`` leaves it out.
    """
    rows = df if keep is None else df.filter(keep)
    mean = F.avg if na_rm else strict_mean
    return rows.groupBy(*by).agg(
        mean(flag).alias("mean_flag"), mean(value).alias("mean_value"), F.count(F.lit(1)).alias("n")
    )


def cutoff_sensitivity(
    df: DataFrame, value: str, cutoffs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Kept rows, kept share and mean below each cutoff, in one pass."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cutoffs):
        kept = F.col(value) < c
        aggs += [F.count_if(kept).alias(f"_k{i}"), F.avg(F.when(kept, F.col(value))).alias(f"_m{i}")]
    rows = [
        F.struct(
            F.lit(float(c)).alias("cutoff"),
            F.col(f"_k{i}").alias("kept"),
            (F.col(f"_k{i}") / F.col("_n")).alias("kept_share"),
            F.col(f"_m{i}").alias("mean_kept"),
        )
        for i, c in enumerate(cutoffs)
    ]
    return df.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*rows)).alias("r")).select(
        *by, "r.*"
    )


def retention(df: DataFrame, kept: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows, kept rows and percent kept from one pass."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(kept).alias("rows_kept"),
        (100.0 * F.count_if(kept) / F.count(F.lit(1))).alias("pct_kept"),
    )
