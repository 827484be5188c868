"""Joins of a trial log with one-row-per-unit tables.

A *unit* is whatever owns many rows of the log (participant, participant x condition, item).
Unit tables are made by ``groupBy().agg`` (partial aggregation runs before the shuffle, so a unit
holding a third of all rows costs no more than the others) and are then joined back.  The join is
where a hot unit would hurt, so it is chosen from measured facts:

* a unit table of at most ``BROADCAST_BYTES``, measured, is broadcast and the log is not shuffled;
* a larger one: a shuffle join, in which the rows of the units above ``ROWS_PER_TASK`` are dealt
  in turn, by a stored row number, to as many salts as they need, and only the matching rows of the
  unit table are repeated. The hot units are a table too, however many there are.

``profile_units`` measures once on the raw log (a scan of the key columns); filters only shrink
units, so one profile serves every later operator on that log.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.work import stored

BROADCAST_BYTES = 64 << 20
ROWS_PER_TASK = 2_000_000


@dataclass(frozen=True)
class UnitProfile:
    keys: tuple[str, ...]
    units: int
    rows: int
    largest: int
    key_bytes: int  # of all units' keys
    hot: DataFrame | None  # keys and _splits of units above rows_per_task
    rows_per_task: int = ROWS_PER_TASK
    broadcast_bytes: int = BROADCAST_BYTES

    def broadcastable(self, side: DataFrame) -> bool:
        """Whether a table of at most one row per unit is small enough."""
        if self.key_bytes > self.broadcast_bytes:
            return False
        rest = [f for f in side.schema.fields if f.name not in self.keys]
        if all(_fixed(f.dataType) for f in rest):
            return self.key_bytes + self.units * _width(rest) <= self.broadcast_bytes
        return measured_bytes(side) <= self.broadcast_bytes


def _fixed(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType, T.NullType))


def _width(fields) -> int:
    return sum(16 if isinstance(f.dataType, T.DecimalType) else 8 for f in fields)


def _row_bytes(fields) -> Column:
    """Bytes of a row, from the lengths of its texts and, of nested columns, of their JSON form."""
    total = F.lit(_width([f for f in fields if _fixed(f.dataType)]))
    for f in fields:
        if not _fixed(f.dataType):
            plain = isinstance(f.dataType, (T.StringType, T.BinaryType))
            text = F.col(f.name) if plain else F.to_json(F.struct(F.col(f.name)))
            total = total + F.coalesce(F.octet_length(text), F.lit(0)) + 8
    return total


def measured_bytes(table: DataFrame) -> int:
    """Bytes of a table's values; one pass over it."""
    return int(table.agg(F.sum(_row_bytes(table.schema.fields).cast("long"))).first()[0] or 0)


def profile_units(
    log: DataFrame,
    keys: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> UnitProfile:
    """Number of units, size of the largest one and the table of hot ones."""
    counts = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    width = _row_bytes([log.schema[k] for k in keys]).cast("long")
    total = counts.agg(
        F.count(F.lit(1)).alias("u"), F.sum("_n").alias("r"), F.max("_n").alias("m"), F.sum(width).alias("b")
    ).first()
    hot = None
    if (total.m or 0) > rows_per_task:
        splits = F.ceil(F.col("_n") / rows_per_task).cast("long").alias("_splits")
        hot, _ = stored(counts.filter(F.col("_n") > rows_per_task).select(*keys, splits), "hot")
    return UnitProfile(
        tuple(keys), total.u, total.r or 0, total.m or 0, total.b or 0, hot, rows_per_task, broadcast_bytes
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a missing key matches a missing key. Keeps the left key columns."""
    tmp = {k: f"_right_{k}" for k in keys}
    right = right.withColumnsRenamed(tmp)
    cond: Column | None = None
    for k, t in tmp.items():
        eq = F.col(k).eqNullSafe(F.col(t))
        cond = eq if cond is None else cond & eq
    return left.join(right, cond, how).drop(*tmp.values())


def unit_join(
    log: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    profile: UnitProfile | None = None,
) -> DataFrame:
    """Join a log with a table of its units (inner, left, semi or anti).

    ``side`` has at most one row per unit of the profiled log; the profile therefore bounds its
    size. Tables from elsewhere go through ``lookup_join``.
    """
    profile = profile or profile_units(log, keys)
    if profile.broadcastable(side):
        return null_safe_join(log, F.broadcast(side), keys, how)
    return _shuffle_join(log, side, keys, how, profile)


def _shuffle_join(log: DataFrame, side: DataFrame, keys, how: str, profile: UnitProfile) -> DataFrame:
    if profile.hot is None:
        return null_safe_join(log, side, keys, how)
    # a rerun task must deal its rows as before: the row numbers are stored with the rows
    placed, _ = stored(log.withColumn("_place", F.monotonically_increasing_id()), "placed")
    salted = null_safe_join(placed, profile.hot, keys, "left")
    salt = F.pmod(F.col("_place"), F.coalesce("_splits", F.lit(1)))
    salted = salted.withColumn("_salt", salt).drop("_splits", "_place")
    repeated = null_safe_join(side, profile.hot, keys, "left")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_splits", F.lit(1)) - 1))
    repeated = repeated.withColumn("_salt", salts).drop("_splits")
    return null_safe_join(salted, repeated, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    log: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    rows: int | None = None,
    profile: UnitProfile | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """n:1 join with a table that was not made from the log, so its own size has to be checked.

    ``rows`` is a known upper bound of the lookup's size (for instance the count of the stored
    table it is made of), enough for a lookup of numbers; else its bytes are measured. Above
    ``max_bytes`` the join is a shuffle with hot units of the log salted.
    """
    fields = lookup.schema.fields
    known = rows is not None and all(_fixed(f.dataType) for f in fields)
    if (rows * _width(fields) if known else measured_bytes(lookup)) <= max_bytes:
        return null_safe_join(log, F.broadcast(lookup), keys, how)
    return _shuffle_join(log, lookup, keys, how, profile or profile_units(log, keys))


def natural_left_join(log: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join on all columns the two tables share."""
    return lookup_join(log, lookup, [c for c in log.columns if c in set(lookup.columns)])


def attach_group_stats(
    log: DataFrame, keys: Sequence[str], profile: UnitProfile | None = None, **aggs: Column
) -> DataFrame:
    """Every row with aggregates of its group."""
    stats = log.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return unit_join(log, stats, keys, "inner", profile)
