"""Percentile bootstrap of a mean over units.

Draws come from digests, not from a random generator: draw ``j`` of replicate ``b`` in a group is a
32-bit word of ``md5(seed:group:b:j div 4)`` modulo the number of units (one digest gives four
draws).  Results therefore do not depend on partitioning, task retries or the engine.

Units are numbered 0..n-1 in the order of the md5 of their key.  The numbering runs inside
(group, first three hex digits) with offsets from the counts, so no task sees a whole group.
The draws meet the unit values in an equi-join: broadcast when the unit table is small in bytes,
else shuffled on (group, index), which spreads evenly because draws are uniform.

``poisson_ci`` is the one-pass form for large tables: every unit counts Poisson(1) times in each
replicate, by a word of ``md5(seed:group:unit:b div 4)``. Sums per group and replicate are all that is
shuffled; there is no numbering and no join. Replicates have about, not exactly, n draws.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .units import BROADCAST_BYTES

_GROUP = "_group"


def _key_text(columns: Sequence[str]) -> Column:
    """Columns as one text; separators inside values are doubled and missing values marked."""
    if not columns:
        return F.lit("")
    parts = [F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("||")) for c in columns]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("|NA")) for p in parts])


def _numbered(units: DataFrame, unit: Sequence[str], value: str) -> DataFrame:
    keyed = units.select(_GROUP, _key_text(unit).alias("_unit"), F.col(value).cast("double").alias("_v"))
    keyed = keyed.withColumn("_h", F.md5("_unit")).withColumn("_part", F.substring("_h", 1, 3))
    sizes = keyed.groupBy(_GROUP, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(_GROUP).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(_GROUP, "_part").orderBy("_h", "_unit")
    return keyed.join(offsets, [_GROUP, "_part"]).select(
        _GROUP, "_v", (F.col("_before") + F.row_number().over(inside) - 1).alias("_i")
    )


def replicate_means(
    units: DataFrame,
    by: Sequence[str],
    unit: Sequence[str],
    value: str,
    replicates: int = 1000,
    seed: int = 999,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per group and replicate with the mean of the resampled units.

    ``units`` has one row per (group, unit); missing values can be drawn and are skipped in the
    mean.
    """
    grouped = units.withColumn(_GROUP, _key_text(by))
    numbered = _numbered(grouped, unit, value)
    sizes = grouped.groupBy(*by, _GROUP).agg(F.count(F.lit(1)).alias("n"))
    total, width = sizes.agg(F.sum("n"), F.max(F.octet_length(_GROUP))).first()
    total = total or 0
    tasks = units.sparkSession.sparkContext.defaultParallelism
    # about 4 million draws per task
    tasks = max(tasks, -(-total * replicates // 4_000_000)) if total else 1
    plan = sizes.select(
        *by, _GROUP, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_b")
    )
    # one replicate of a huge group must not be one task: it is cut into ranges of digests
    step = 1_000_000
    plan = plan.withColumn(
        "_from",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 4), F.lit(step))),
    ).repartition(int(tasks), _GROUP, "_b", "_from")
    last = F.least(F.col("_from") + step - 1, F.floor((F.col("n") - 1) / 4))
    digests = plan.withColumn("_q", F.explode(F.sequence(F.col("_from"), last))).withColumn(
        "_d", F.md5(F.concat_ws(":", F.lit(str(seed)), _GROUP, "_b", "_q"))
    )
    draws = digests.withColumn("_w", F.explode(F.array(*[F.lit(w) for w in range(4)]))).filter(
        F.col("_q") * 4 + F.col("_w") < F.col("n")
    )
    word = F.conv(F.substring(F.col("_d"), F.col("_w") * 8 + 1, F.lit(8)), 16, 10).cast("long")
    draws = draws.select(*by, _GROUP, "n", "_b", F.pmod(word, F.col("n")).alias("_i"))
    values = F.broadcast(numbered) if total * (24 + (width or 0)) <= broadcast_bytes else numbered
    return (
        draws.join(values, [_GROUP, "_i"])
        .groupBy(*by, "n", "_b")
        .agg(F.avg("_v").alias("replicate_mean"))
        .withColumnRenamed("_b", "replicate")
    )


def percentile_ci(
    units: DataFrame,
    by: Sequence[str],
    unit: Sequence[str],
    value: str,
    replicates: int = 1000,
    seed: int = 999,
    level: float = 0.95,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Percentile interval of the mean per group; both ends from the same replicates."""
    tail = (1.0 - level) / 2.0
    means = replicate_means(units, by, unit, value, replicates, seed, broadcast_bytes)
    return means.groupBy(*by, "n").agg(
        F.percentile("replicate_mean", F.lit(tail)).alias("ci_low"),
        F.percentile("replicate_mean", F.lit(1.0 - tail)).alias("ci_high"),
    )


def poisson_limits() -> list[int]:
    """A 32-bit word counts once for each limit that it reaches: Poisson(1), as far as 32 bits tell."""
    limits, share = [], 0.0
    for k in range(13):
        share += math.exp(-1.0) / math.factorial(k)
        limits.append(min(math.floor(share * 2**32), 2**32 - 1))
    return limits


def poisson_means(
    units: DataFrame,
    by: Sequence[str],
    unit: Sequence[str],
    value: str,
    replicates: int = 1000,
    seed: int = 999,
) -> DataFrame:
    """One row per group and replicate: the mean of the units, each weighted by its Poisson count.

    ``units`` has one row per (group, unit). Missing values count in ``n`` alone; a replicate without a
    counted value has a missing mean.
    """
    keyed = units.select(*by, _key_text(by).alias(_GROUP), _key_text(unit).alias("_unit"), F.col(value).cast("double").alias("_v"))
    digests = keyed.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))))
    digests = digests.withColumn("_d", F.md5(F.concat_ws(":", F.lit(str(seed)), _GROUP, "_unit", "_q")))
    draws = digests.withColumn("_w", F.explode(F.array(*[F.lit(w) for w in range(4)])))
    draws = draws.withColumn("replicate", F.col("_q") * 4 + F.col("_w")).filter(F.col("replicate") < replicates)
    word = F.conv(F.substring(F.col("_d"), F.col("_w") * 8 + 1, F.lit(8)), 16, 10).cast("long")
    draws = draws.select(*by, "replicate", "_v", word.alias("_word"))
    count = sum(((F.col("_word") >= limit).cast("int") for limit in poisson_limits()), F.lit(0))
    draws = draws.withColumn("_c", count)
    counted = F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")))
    mean = F.sum(F.col("_c") * F.col("_v")) / F.when(counted > 0, counted)
    return draws.groupBy(*by, "replicate").agg(F.count(F.lit(1)).alias("n"), mean.alias("replicate_mean"))


def poisson_ci(
    units: DataFrame,
    by: Sequence[str],
    unit: Sequence[str],
    value: str,
    replicates: int = 1000,
    seed: int = 999,
    level: float = 0.95,
) -> DataFrame:
    """Percentile interval of the mean per group from one pass over the units."""
    tail = (1.0 - level) / 2.0
    means = poisson_means(units, by, unit, value, replicates, seed)
    return means.groupBy(*by, "n").agg(
        F.percentile("replicate_mean", F.lit(tail)).alias("ci_low"),
        F.percentile("replicate_mean", F.lit(1.0 - tail)).alias("ci_high"),
    )
