"""CSV trial logs: one file per participant, one row per screen.

Schemas are never inferred: every column is read as text and cast where it is used.  Files whose
headers differ are read per header and united by name.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "multiLine": "false",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "enforceSchema": "false",
    "mode": "FAILFAST",
}


MISSING = ("", "NA")  # cell texts that stand for a missing value


def _cell(name: str) -> Column:
    """A cell without blanks around it, quoted or not; missing when it says so."""
    text = F.trim(F.col(name))
    return F.when(~text.isin(*MISSING), text).alias(name)


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_log(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str],
    types: Mapping[str, str] | None = None,
    pattern: str | None = None,
    id_column: str | None = "id",
    multi_line: bool = False,
    corrupt: str | None = None,
) -> DataFrame:
    """All CSV files below ``path`` that share one header, with the file path as ``id``.

    ``types`` casts single columns (unreadable values become missing); ``pattern`` is a file-name
    glob such as ``*english.csv``. ``multi_line`` allows line breaks inside quotes, at the price of one
    task per file. ``corrupt`` names a column for rows that don't fit the header: they are kept with their
    text there instead of stopping the read.
    """
    options = CSV_OPTIONS | {"multiLine": str(multi_line).lower()}
    schema, kept = text_schema(columns), []
    if corrupt:
        # only whole rows show that a row has too many cells
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "columnPruning": "false"}
        schema, kept = schema.add(corrupt, T.StringType()), [F.col(corrupt)]
    reader = spark.read.schema(schema).options(**options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    df = reader.csv(path if isinstance(path, str) else list(path))
    provenance = [F.col("_metadata.file_path").alias(id_column)] if id_column else []
    df = df.select(*[_cell(c) for c in columns], *kept, *provenance)
    for name, to in (types or {}).items():
        df = df.withColumn(name, F.col(name).try_cast(to))
    return df


def headers(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None) -> dict[tuple[str, ...], list[str]]:
    """Header -> files below ``path`` that have it, from one pass: a file's first line is that of its smallest row number."""
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    lines = reader.text(path if isinstance(path, str) else list(path))
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), "_metadata.file_block_start")
    first = lines.groupBy("file").agg(F.min_by("value", F.struct("file_block_start", "place")).alias("header"))
    grouped = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()  # a row per header
    return {tuple(next(csv.reader([r.header]))): r.files for r in grouped}


def read_mixed(
    spark: SparkSession,
    path: str | Sequence[str],
    types: Mapping[str, str] | None = None,
    pattern: str | None = None,
    **kw,
) -> DataFrame:
    """Files of different headers below ``path``, read per header and united by name."""
    parts = []
    for columns, files in sorted(headers(spark, path, pattern).items()):
        own = {c: t for c, t in (types or {}).items() if c in columns}
        parts.append(read_log(spark, files, columns, own, **kw))
    return union_logs(parts)


def union_logs(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns a part lacks are missing there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_logs(
    spark: SparkSession,
    folders: Sequence[tuple],
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Several folders: (path, columns) or (path, columns, constant tags) each."""
    parts = []
    for path, columns, *tags in folders:
        part = read_log(spark, path, columns, types)
        for name, value in (tags[0] if tags else {}).items():
            part = part.withColumn(name, F.lit(value))
        parts.append(part)
    return union_logs(parts)


def read_lookup(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    lower: Sequence[str] = (),
    computed: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Lookup table with the named columns in lower case and columns recomputed."""
    df = read_log(spark, path, columns, id_column=None)
    for c in lower:
        df = df.withColumn(c, F.lower(c))
    for c, expr in (computed or {}).items():
        df = df.withColumn(c, expr)
    return df


def read_intermediate(
    spark: SparkSession, path: str, columns: Sequence[str], types: Mapping[str, str] | None = None, **kw
) -> DataFrame:
    """A result written with row numbers: the unnamed first column is dropped."""
    return read_log(spark, path, ["_row", *columns], types, id_column=None, **kw).drop("_row")
