"""Exact group quantiles (linear interpolation between the two neighbouring ranks).

``percentile`` keeps every distinct value of a group in one buffer.  That is right for the usual
participant x condition cell and wrong for a group holding a third of a huge log, so groups above
``group_limit`` rows take another, equally exact way: values are collapsed to counts, each group
is cut at sketched quantiles a little below and above the wanted ones, all slices are counted, and
only the slices that hold a wanted rank are sorted. The sketch decides how small those are, not
what the result is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import stored
from .units import ROWS_PER_TASK, null_safe_join, profile_units, unit_join

BRACKET = 5e-4  # half width, in probability, of the slice around a wanted quantile
ACCURACY = 10_000  # rank error of the sketch: 1 / ACCURACY


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    group_limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per group with one column per entry of ``probs`` (name -> probability)."""
    if group_limit > 0:
        largest = df.groupBy(*by).agg(F.count(value).alias("_n")).agg(F.max("_n")).first()[0]
        if (largest or 0) <= group_limit:
            return df.groupBy(*by).agg(
                *[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()]
            )
    return _sliced(df, by, value, probs)


def _sliced(df, by, value, probs) -> DataFrame:
    keys = list(by) or ["_all"]
    if not by:
        df = df.withColumn("_all", F.lit(1))
    df = df.select(*keys, F.col(value).cast("double").alias("_v"))
    around = {min(max(p + side, 0.0), 1.0) for p in probs.values() for side in (-BRACKET, BRACKET)}
    cuts = df.groupBy(*keys).agg(
        F.count("_v").alias("_total"),
        F.percentile_approx("_v", sorted(around), ACCURACY).alias("_cuts"),
    )
    counts = df.filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_n")
    )
    # an array of cuts per group: its measured size decides the join
    cuts, _ = stored(cuts, "cuts")
    sliced = unit_join(counts, cuts, keys, "inner", profile_units(counts, keys))
    sliced = sliced.withColumn(
        "_slice", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    ).drop("_cuts")
    upto = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    starts = sliced.groupBy(*keys, "_slice", "_total").agg(F.sum("_n").alias("_size"))
    starts = starts.withColumn("_start", F.sum("_size").over(upto) - F.col("_size"))
    wanted = F.lit(False)
    for p in probs.values():
        h = (F.col("_total") - 1) * F.lit(float(p))
        for rank in (F.floor(h), F.ceil(h)):
            wanted = wanted | ((F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_size")))
    starts = starts.filter(wanted).select(*keys, "_slice", "_start")
    inside = Window.partitionBy(*keys, "_slice").orderBy("_v")
    ranked = null_safe_join(sliced, starts, [*keys, "_slice"], "inner").withColumn(
        "_end", F.col("_start") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    picks = []
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        at = [
            F.max(F.when((F.col("_end") - F.col("_n") <= r) & (r < F.col("_end")), F.col("_v")))
            for r in (F.floor(h), F.ceil(h))
        ]
        share = F.max(h - F.floor(h))
        picks.append((at[0] + share * (at[1] - at[0])).alias(name))
    found = ranked.groupBy(*keys).agg(*picks)
    # groups without any value keep a row of missing quantiles
    out = null_safe_join(cuts.select(*keys), found, keys, "left")
    return out.drop("_all") if not by else out
