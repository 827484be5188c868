"""What a mixed model needs of a log, reduced by Spark and kept on the cluster.

Everything is a sum of products of design columns, so predictors may have any number of values and
no table of design points exists. A linear model keeps one row per unit: sums of z z', z x' and
z y, and the sums of z b' for each of the unit's items. Units with equal designs share a row. A
logistic model keeps each unit's different cells as flat arrays. Only sums of the size of the fixed
part and of the item effects ever come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import number_rows
from ..sources.work import stored
from .design import Factor, Model

NUMBERS_A_TASK = 25_000  # few bytes, much arithmetic: unit rows are spread by their numbers


def cells_of(df: DataFrame, model: Model, weight: str | None = None) -> DataFrame:
    """Count, sum and sum of squares per (unit, item, predictor values); incomplete rows go."""
    groups = [r.group for r in model.random]
    keys = list(dict.fromkeys([*groups, *model.variables]))
    y = F.col(model.response).cast("double")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return (
        df.select(*keys, y.alias("_y"), w.alias("_w"))
        .dropna()
        .groupBy(*keys)
        .agg(
            F.sum("_w").alias("_n"),
            F.sum(F.col("_w") * F.col("_y")).alias("_s"),
            F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("_ss"),
        )
    )


@dataclass
class Design:
    """Cells with numbered items, and the design columns of each part."""

    cells: DataFrame  # the item's number is _item, -1 without items
    model: Model
    n_items: int

    @property
    def unit(self) -> str:
        return self.model.random[0].group

    @property
    def x(self) -> list[Column]:
        return self.model.expressions()

    @property
    def z(self) -> list[Column]:
        r = self.model.random[0]
        return self.model.expressions(r.terms, r.intercept)

    @property
    def b(self) -> list[Column]:
        if len(self.model.random) < 2:
            return []
        r = self.model.random[1]
        return self.model.expressions(r.terms, r.intercept)


def design_of(df: DataFrame, model: Model, weight: str | None = None) -> Design:
    if not 1 <= len(model.random) <= 2:
        raise ValueError("a mixed model needs one or two random groupings")
    cells = cells_of(df, model, weight)
    if len(model.random) == 1:
        return Design(stored(cells.withColumn("_item", F.lit(-1)), "cells")[0], model, 0)
    cells, _ = stored(cells, "cells")
    item = model.random[1].group
    items = number_rows(cells.select(item).distinct(), [item], "_item")
    items = items.withColumn("_item", F.col("_item").cast("int"))
    joined, _ = stored(cells.join(items, item), "cells")
    return Design(joined, model, joined.agg(F.coalesce(F.max("_item"), F.lit(-1))).first()[0] + 1)


def check(design: Design) -> tuple[np.ndarray, float]:
    """Products of the fixed columns and the response, and the number of trials; says what is wrong."""
    model, cells = design.model, design.cells
    factors = [p for p in model.predictors if isinstance(p, Factor)]
    strange = [F.max(F.when(~F.col(p.name).isin(*p.levels), F.col(p.name).cast("string"))) for p in factors]
    if strange:
        for p, value in zip(factors, cells.agg(*strange).first()):
            if value is not None:
                raise ValueError(f"{p.name}: values outside the levels: {value}")
    x = design.x
    p = len(x)
    sums = [F.sum(F.col("_n") * x[i] * x[j]) for i in range(p) for j in range(i + 1)]
    sums += [F.sum(F.col("_s") * c) for c in x] + [F.sum("_ss"), F.sum("_n")]
    found = cells.agg(*[s.alias(f"_{i}") for i, s in enumerate(sums)]).first()
    if found is None or not (found[-1] or 0) > 0:
        raise ValueError("no complete rows to fit")
    total = np.zeros((p + 1, p + 1))
    total[np.tril_indices(p)] = found[: p * (p + 1) // 2]
    total[p, :p] = found[p * (p + 1) // 2 : -2]
    total[p, p] = found[-2]
    total = total + np.tril(total, -1).T
    if p:
        scale = np.sqrt(np.maximum(np.diag(total)[:p], 1e-300))
        if np.linalg.eigvalsh(total[:p, :p] / np.outer(scale, scale))[0] < 1e-12:
            raise ValueError("the fixed part is rank deficient: a level or combination has no rows")
    return total, float(found[-1])


@dataclass(frozen=True)
class Sizes:
    """Numbers of fixed columns, of random columns per unit and per item, and of items."""

    p: int
    q: int
    qb: int
    n_items: int

    @property
    def effects(self) -> int:
        return self.n_items * self.qb


@dataclass
class Moments:
    """Unit rows and item rows of a linear model, and the sums over all rows."""

    rows: DataFrame
    items: DataFrame | None
    sizes: Sizes
    total: np.ndarray  # (p + 1) x (p + 1)
    size: float
    units: int


def _products(left: list[Column], right: list[Column], weight: str) -> list[Column]:
    return [F.sum(F.col(weight) * a * b) for a in left for b in right]


def _sums(groups: DataFrame, named: dict[str, list[Column]]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Aggregates with a list of sums under each name; the columns that hold them."""
    flat, names = [], {}
    for name, sums in named.items():
        names[name] = [f"_{name}{i}" for i in range(len(sums))]
        flat += [s.alias(n) for s, n in zip(sums, names[name])]
    return groups.agg(*(flat or [F.count(F.lit(1)).alias("_none")])), names


def _list(names: list[str]) -> Column:
    return F.array(*names) if names else F.array().cast("array<double>")


def moments_of(design: Design, total: np.ndarray, size: float, n: str = "_n", s: str = "_s") -> Moments:
    """Unit and item rows; ``n`` and ``s`` name the columns of weights and weighted responses."""
    x, z, b = design.x, design.z, design.b
    p, q, qb = len(x), len(z), len(b)
    one = [F.lit(1.0)]
    wanted = {"g": _products(z, z, n), "x": _products(z, x, n), "t": _products(z, one, s)}
    group = [design.unit, "_item"] if b else [design.unit]
    sums, names = _sums(design.cells.groupBy(*group), wanted | ({"c": _products(z, b, n)} if b else {}))
    if b:
        again = [F.sum(c).alias(c) for k in ("g", "x", "t") for c in names[k]]
        entries = F.array_sort(F.collect_list(F.struct("_item", _list(names["c"]).alias("c")))).alias("_entries")
        sums = sums.groupBy(design.unit).agg(*again, entries)
    keys = [_list(names["g"]).alias("g"), _list(names["x"]).alias("x")]
    if b:
        keys += [F.col("_entries._item").alias("item"), F.flatten("_entries.c").alias("c")]
    t = names["t"]
    rows = sums.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("m"),
        F.array(*[F.sum(c) for c in t]).alias("t"),
        F.array(*[F.sum(F.col(c) * F.col(d)) for c in t for d in t]).alias("tt"),
    )
    rows = spread(rows, F.size("g") + F.size("x") + (2 * F.size("c") if b else F.lit(0)))
    units = int(rows.agg(F.sum("m")).first()[0])
    items = None
    if b:
        wanted = {"bb": _products(b, b, n), "bx": _products(b, x, n), "by": _products(b, one, s)}
        sums, names = _sums(design.cells.groupBy("_item"), wanted)
        items, _ = stored(sums.select("_item", *[_list(names[k]).alias(k) for k in names]), "items")
    return Moments(rows, items, Sizes(p, q, qb, design.n_items), total, size, units)


def spread(rows: DataFrame, numbers: Column) -> DataFrame:
    """The rows stored, dealt to as many partitions as their arithmetic is worth."""
    held, _ = stored(rows, "units")
    values = held.agg(F.sum(numbers)).first()[0] or 0
    cores = held.sparkSession.sparkContext.defaultParallelism
    wanted = int(min(4 * cores, max(1, values // NUMBERS_A_TASK)))
    if wanted == held.rdd.getNumPartitions():
        return held
    return stored(held.repartition(wanted), "units")[0] if wanted > 1 else held.coalesce(1)


def numbers(column: pa.Array) -> np.ndarray:
    """The numbers of a column of numbers or of lists, one after the other."""
    flat = column.flatten() if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else column
    return flat.to_numpy(zero_copy_only=False)


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def total_of(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` over batches of rows, added up in the tasks and then in a tree of tasks."""

    def partial(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(batch)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def added(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            for v in batch.column("v").to_pylist():
                v = np.frombuffer(v)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    parts, n = rows.mapInArrow(partial, "v binary"), rows.rdd.getNumPartitions()
    while n > 16:
        n = max(1, int(n**0.5))
        parts = parts.repartition(n).mapInArrow(added, "v binary")
    return sum(np.frombuffer(v.as_py()) for v in parts.toArrow().column("v"))
