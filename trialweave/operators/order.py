"""Operators that depend on row order inside a unit.

Spark tables have no row order, so an order column of numbers, dates or times, unique inside the
unit, is required. Small units use one window. A unit above the profile's ``rows_per_task`` is cut
into chunks of about that many rows: a window never sees more than one chunk of one unit, and
what passes between chunks, the state at a chunk's end, is one row per (unit, chunk).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.work import stored
from .units import UnitProfile, attach_group_stats, null_safe_join, profile_units, unit_join

_CHUNK = "_chunk"
ACCURACY = 10_000


def _measure(log: DataFrame, order: str) -> Column:
    """The order column as a number."""
    kind = log.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(order)
    if isinstance(kind, T.NumericType):
        return F.col(order)
    raise ValueError(f"order column {order!r} must hold numbers, dates or times")


def _chunked(log: DataFrame, unit: Sequence[str], order: str, profile: UnitProfile) -> DataFrame:
    """The log with the number of each row's chunk inside its unit, rising with the order.

    Units above the limit are cut at approximate quantiles of the order column, so chunks hold
    about the limit's rows whatever the values' spacing; the others are one chunk.
    """
    most = -(-profile.largest // profile.rows_per_task)
    shares = F.array(*[F.lit(k / most) for k in range(1, most)])
    hot = null_safe_join(log.select(*unit, _measure(log, order).alias("_at")), profile.hot, unit, "inner")
    cuts = hot.groupBy(*unit, "_splits").agg(F.percentile_approx("_at", shares, max(ACCURACY, 20 * most)).alias("_cuts"))
    # one list of shares for all units: a unit with fewer chunks keeps every few of its cuts
    part = lambda k: F.floor(k * F.col("_splits") / most)
    cuts = cuts.select(*unit, F.filter("_cuts", lambda c, k: part(k + 1) > part(k)).alias("_cuts"))
    joined = unit_join(log, stored(cuts, "cuts")[0], unit, "left", profile)
    below = F.size(F.filter("_cuts", lambda c: c < _measure(log, order)))
    return joined.withColumn(_CHUNK, F.when(F.col("_cuts").isNull(), 0).otherwise(below)).drop("_cuts")


def _require(log: DataFrame, order: str) -> None:
    if order not in log.columns:
        raise ValueError(f"row-order semantics need an order column; {order!r} is not in the table")


def sequence_number(
    log: DataFrame,
    unit: Sequence[str],
    order: str,
    name: str,
    profile: UnitProfile | None = None,
) -> DataFrame:
    """1, 2, ... inside each unit in the order of ``order``."""
    _require(log, order)
    profile = profile or profile_units(log, unit)
    if profile.hot is None:
        w = Window.partitionBy(*unit).orderBy(order)
        return log.withColumn(name, F.row_number().over(w).cast("long"))
    cut = _chunked(log, unit, order, profile)
    before = Window.partitionBy(*unit).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*unit, _CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*unit, _CHUNK).orderBy(order)
    return (
        null_safe_join(cut, offsets, [*unit, _CHUNK], "inner")
        .withColumn(name, F.row_number().over(inside) + F.col("_before"))
        .drop(_CHUNK, "_before")
    )


def cycle_number(
    log: DataFrame,
    unit: Sequence[str],
    order: str,
    length: int,
    name: str = "trial_number",
    profile: UnitProfile | None = None,
) -> DataFrame:
    """Position inside the unit, counted 1..length over and over."""
    numbered = sequence_number(log, unit, order, name, profile)
    return numbered.withColumn(name, F.pmod(F.col(name) - 1, F.lit(length)) + 1)


def carry_forward(
    log: DataFrame,
    unit: Sequence[str],
    order: str,
    value: str,
    name: str | None = None,
    profile: UnitProfile | None = None,
) -> DataFrame:
    """Fill missing values with the last one before them in the unit."""
    _require(log, order)
    name = name or value
    profile = profile or profile_units(log, unit)
    upto_here = (Window.unboundedPreceding, Window.currentRow)
    if profile.hot is None:
        w = Window.partitionBy(*unit).orderBy(order).rowsBetween(*upto_here)
        return log.withColumn(name, F.last(value, ignorenulls=True).over(w))
    cut = _chunked(log, unit, order, profile)
    before = Window.partitionBy(*unit).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*unit, _CHUNK)
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(before))
        .drop("_last")
    )
    inside = Window.partitionBy(*unit, _CHUNK).orderBy(order).rowsBetween(*upto_here)
    return (
        null_safe_join(cut, carried, [*unit, _CHUNK], "inner")
        .withColumn(
            name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried"))
        )
        .drop(_CHUNK, "_carried")
    )


def center_by(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    name: str,
    add_back: Sequence[str] | None = None,
    profile: UnitProfile | None = None,
) -> DataFrame:
    """Value minus its group mean, optionally plus the mean of a second grouping.

    Written as aggregates joined back, not as windows: the second grouping has few large groups.
    """
    if add_back:  # measured on the input, not on the joined table
        back = profile_units(df, add_back)
    out = attach_group_stats(df, by, profile, _m=F.avg(value))
    out = out.withColumn(name, F.col(value) - F.col("_m")).drop("_m")
    if add_back:
        out = attach_group_stats(out, add_back, back, _m=F.avg(value))
        out = out.withColumn(name, F.col(name) + F.col("_m")).drop("_m")
    return out


def display_rank(df: DataFrame, column: str, levels: Sequence, name: str) -> DataFrame:
    """Add the position of a category in a given display order."""
    from ..functions.recode import order_rank

    rank: Column = order_rank(column, levels)
    return df.withColumn(name, rank)


def number_rows(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of the columns, rows equal in them in any order.

    The sorted table is stored once, so that its partitions stay as they are; each goes on
    where those before it end. No task sees more than its own partition.
    """
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    placed, _ = stored(placed, "numbered")
    part = F.shiftright("_place", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))  # a row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", part).join(sizes, "_part")
    number = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + start
    return joined.withColumn(name, number).drop("_part", "_place", "_before")
