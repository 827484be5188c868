"""Writing results and pseudonymised logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).options(header="true", escape='"').csv(path)


def write_numbered_csv(df: DataFrame, path: str, order: Sequence[str], mode: str = "error") -> None:
    """CSV with a leading row number: 1, 2, ... in the order of the columns ``order``."""
    from ..operators.order import number_rows

    numbered = number_rows(df, order, "_row", start=1)
    write_csv(numbered.select("_row", *df.columns), path, mode)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error"
) -> None:
    """Parquet. With partitions, ``overwrite`` replaces only those that the table has rows of."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def pseudonymise(
    df: DataFrame, columns: Sequence[str], how: str = "constant", constant: str = "anonymised",
    salt: str = "",
) -> DataFrame:
    """Replace identifying columns by a constant or by a (salted) digest."""
    if how not in ("constant", "sha2"):
        raise ValueError(f"unknown way to pseudonymise: {how!r}")
    for c in columns:
        new = (
            F.lit(constant)
            if how == "constant"
            else F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256)
        )
        df = df.withColumn(c, new)
    return df
