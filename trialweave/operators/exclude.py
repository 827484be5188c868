"""Exclusion rules.

A rule on units returns a table with one row per excluded unit and a ``reason``; nothing is
removed until ``remove_units`` applies it.  So the table a rule is computed on and the table it is
applied to can differ, as they do in the cleaning plans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import if_else, larger_of
from .units import UnitProfile, attach_group_stats, null_safe_join, unit_join


def _reasoned(units: DataFrame, unit: Sequence[str], reason: str) -> DataFrame:
    return units.select(*unit).distinct().withColumn("reason", F.lit(reason))


def bad_trial_counts(
    df: DataFrame,
    unit: Sequence[str],
    bad: Column,
    condition: str,
    levels: Sequence[str],
    extra: Sequence[str] = (),
) -> DataFrame:
    """Bad trials per unit, one column per condition level (NULL where there is none)."""
    return (
        df.filter(bad)
        .groupBy(*unit, *extra)
        .pivot(condition, list(levels))
        .agg(F.count(F.lit(1)))
        .select(
            *unit, *extra, *[F.when(F.col(l) > 0, F.col(l)).alias(l) for l in levels]
        )
    )


def by_bad_trials(
    df: DataFrame,
    unit: Sequence[str],
    bad: Column,
    threshold: int,
    condition: str | None = None,
    levels: Sequence[str] = (),
    extra: Sequence[str] = (),
    reason: str = "bad trials",
) -> DataFrame:
    """Units with more than ``threshold`` bad trials in any condition (or in total)."""
    if condition is None:
        counts = df.filter(bad).groupBy(*unit, *extra).agg(F.count(F.lit(1)).alias("n_excl"))
        return _reasoned(counts.filter(F.col("n_excl") > threshold), unit, reason)
    counts = bad_trial_counts(df, unit, bad, condition, levels, extra)
    over = F.lit(False)
    for level in levels:
        over = over | (F.col(level) > threshold)
    return _reasoned(counts.filter(over), unit, reason)


def orientation_shares(
    df: DataFrame, unit: Sequence[str], left: Column, right: Column, extra: Sequence[str] = ()
) -> DataFrame:
    """Share of left-first and right-first trials per unit and the larger of the two."""
    return (
        df.groupBy(*unit, *extra)
        .agg(
            F.avg(if_else(left, 1.0, 0.0)).alias("left_share"),
            F.avg(if_else(right, 1.0, 0.0)).alias("right_share"),
        )
        .withColumn("orientation_bias", larger_of("left_share", "right_share"))
    )


def by_share_bounds(
    shares: DataFrame,
    unit: Sequence[str],
    low: float = 0.1,
    high: float = 0.9,
    share: str = "orientation_bias",
    reason: str = "orientation bias",
) -> DataFrame:
    """Units whose share lies outside the closed interval."""
    return _reasoned(shares.filter(~F.col(share).between(low, high)), unit, reason)


def by_rate(
    df: DataFrame,
    unit: Sequence[str],
    correct: str,
    minimum: float,
    reason: str = "catch rate",
) -> DataFrame:
    """Units whose mean of a 0/1 flag is below ``minimum``."""
    rates = df.groupBy(*unit).agg(F.avg(correct).alias("rate"))
    return _reasoned(rates.filter(F.col("rate") < minimum), unit, reason)


def by_condition(df: DataFrame, unit: Sequence[str], cond: Column, reason: str) -> DataFrame:
    """Units with at least one row that fulfils a condition (e.g. a button answer)."""
    return _reasoned(df.filter(cond), unit, reason)


def by_table(
    spark, unit: Sequence[str], rows: Sequence[tuple], types: Sequence[str] | None = None
) -> DataFrame:
    """Hand-written exclusions: (unit values..., reason)."""
    types = types or ["string"] * len(unit)
    ddl = ", ".join(f"`{u}` {t}" for u, t in zip(unit, types))
    return spark.createDataFrame(list(rows), f"{ddl}, reason string")


def eligibility_mismatch(
    answers: DataFrame,
    unit: Sequence[str],
    checks: dict[str, tuple[Column, Column]],
    normalise: dict[str, str] | None = None,
) -> DataFrame:
    """Units whose reported attribute differs from the registered one.

    ``checks`` maps a reason to (reported, registered); both are trimmed, lower-cased and passed
    through ``normalise`` (answer -> canonical answer). A missing answer is a mismatch.
    """
    from ..functions.recode import map_values

    def canonical(c: Column) -> Column:
        c = F.lower(F.trim(c))
        return F.coalesce(map_values(c, normalise), c) if normalise else c

    reasons = [
        F.when(~canonical(rep).eqNullSafe(canonical(reg)), F.lit(name))
        for name, (rep, reg) in checks.items()
    ]
    return (
        answers.withColumn("reason", F.concat_ws(", ", *reasons))
        .filter(F.col("reason") != "")
        .groupBy(*unit)
        .agg(F.min("reason").alias("reason"))
    )


def remove_units(
    df: DataFrame, excluded: DataFrame, unit: Sequence[str], profile: UnitProfile | None = None
) -> DataFrame:
    """Rows of units that are not in the exclusion table (missing units are kept)."""
    return unit_join(df, excluded.select(*unit).distinct(), unit, "left_anti", profile)


def slow_trial_limits(
    df: DataFrame,
    unit: Sequence[str],
    value: str,
    prefix: str | None = None,
    profile: UnitProfile | None = None,
) -> DataFrame:
    """Each row with its unit's mean, sample sd and standard error (over all rows of the unit)."""
    p = prefix or value
    return attach_group_stats(
        df,
        unit,
        profile,
        **{
            f"{p}_mean": F.avg(value),
            f"{p}_sd": F.stddev_samp(value),
            f"{p}_se": F.stddev_samp(value) / F.sqrt(F.count(F.lit(1))),
        },
    )


def exclude_slow_trials(
    df: DataFrame,
    unit: Sequence[str],
    value: str = "rt",
    k: float = 3.0,
    profile: UnitProfile | None = None,
) -> DataFrame:
    """Keep rows not above mean + k sd of their unit; no sd or no value means not kept."""
    limits = slow_trial_limits(df, unit, value, profile=profile)
    return limits.filter(~(F.col(value) > F.col(f"{value}_mean") + F.col(f"{value}_sd") * k))


def score_catch_trials(
    df: DataFrame, rules: Sequence[tuple[Column, str]], name: str = "catch_correct"
) -> DataFrame:
    """First matching rule gives the label; no match leaves it missing."""
    out = None
    for cond, label in rules:
        out = (F if out is None else out).when(cond, F.lit(label))
    return df.withColumn(name, out)


def straight_lining(
    df: DataFrame,
    unit: Sequence[str],
    answer: str,
    threshold: int,
    values: Sequence | None = None,
) -> DataFrame:
    """Units that gave the same answer more than ``threshold`` times, with answer and count."""
    if values is not None:
        df = df.filter(F.col(answer).isin(list(values)))
    return (
        df.groupBy(*unit, answer)
        .agg(F.count(F.lit(1)).alias("n_same"))
        .filter(F.col("n_same") > threshold)
    )


def first_of_copies(df: DataFrame, key: str, order: str, n_name: str = "n_copies") -> DataFrame:
    """First row (by a unique ``order``) of all rows with the same key, with the number of copies.

    The key is reduced to a digest and aggregated; the join back is on (digest, first order),
    which one row fulfils, so a key shared by a third of all rows stays harmless. A missing key is
    no copy of another missing key.
    """
    own = F.concat(F.lit("row "), F.col(order).cast("string"))
    keyed = df.withColumn("_key", F.coalesce(F.sha2(F.col(key).cast("string"), 256), own))
    firsts = keyed.groupBy("_key").agg(
        F.min(order).alias(order), F.count(F.lit(1)).alias(n_name)
    )
    return null_safe_join(keyed, firsts, ["_key", order], "inner").drop("_key")


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their count."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def split_rejects(
    df: DataFrame, rules: Sequence[tuple[str, Column]]
) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with the first reason that applies)."""
    reason = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules])
    tagged = df.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(
        F.col("reason").isNotNull()
    )


def waterfall(df: DataFrame, rules: Sequence[tuple[str, Column]], digits: int = 1) -> DataFrame:
    """Rows left after each rule in turn, and percent of the rows before it.

    ``rules`` are (name, failed) in order of application. One aggregate over the table: every row
    is counted at the first rule it fails, the running counts come from those totals.
    """
    first_failed = F.lit(len(rules) + 1)
    for i in range(len(rules), 0, -1):
        failed = F.coalesce(rules[i - 1][1], F.lit(False))
        first_failed = F.when(failed, F.lit(i)).otherwise(first_failed)
    counts = df.select(first_failed.alias("_at")).agg(
        *[F.count_if(F.col("_at") > i).alias(f"_left{i}") for i in range(len(rules) + 1)]
    )
    rows = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit("start" if i == 0 else rules[i - 1][0]).alias("rule"),
            F.col(f"_left{i}").alias("rows_left"),
            (F.col(f"_left{max(i - 1, 0)}") - F.col(f"_left{i}")).alias("rows_out"),
            F.bround(
                100.0 * F.col(f"_left{i}") / F.col(f"_left{max(i - 1, 0)}"), digits
            ).alias("pct_kept"),
        )
        for i in range(len(rules) + 1)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def flag_units(
    df: DataFrame,
    excluded: DataFrame,
    unit: Sequence[str],
    name: str,
    profile: UnitProfile | None = None,
) -> DataFrame:
    """Boolean column telling whether the row's unit is in an exclusion table."""
    marked = excluded.select(*unit).distinct().withColumn(name, F.lit(True))
    out = unit_join(df, marked, unit, "left", profile)
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def participant_answers(
    log: DataFrame,
    unit: Sequence[str],
    fields: dict[str, str],
    kind: Column,
    responses: str = "responses",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Questionnaire answers as columns: ``fields`` maps a question (``Q0``) to a column name."""
    from ..functions.text import answer_fields

    parsed = log.filter(kind).withColumn("_m", answer_fields(responses))
    return parsed.select(
        *unit, *keep, *[F.col("_m").getItem(q).cast(T.StringType()).alias(n) for q, n in fields.items()]
    )
