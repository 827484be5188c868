"""Moving many small numbers between documents and keys, and what is built on that.

*Packed exchange.* A row per (slice of texts, bucket of keys) holds arrays as bytes: eight bytes a
number and no row overhead, and the receiving task sorts arrays instead of rows. Buckets are
hashes, so their sizes are even; keys that many rows share are reduced or salted by the sender.

*Bitmaps.* A set of ids as a bit array of fixed size. It is only used to let rows skip a shuffle
that they provably don't need: a full bitmap costs time, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import scratch_path

PACKED = "bucket int, packed binary"
BITMAP_BITS = 1 << 25
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20
USUAL = ("67108864b", str(64 << 20))  # Spark's own limit


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of about as many bytes as the input has."""
    spark = df.sparkSession
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(asked, df.rdd.getNumPartitions())


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand texts to Python tasks in batches of a few megabytes.

    By default a batch holds up to 64 MB: as many buffers in the executor's JVM and again in each of
    its Python workers, which keep them. Any other limit is the user's and stays.
    """
    if spark.conf.get(BATCH, None) in USUAL:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table written once into the shared folder, and its path.

    Unlike an eager checkpoint of a table, which runs its last stage twice, this runs it once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``stored`` wrote and nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def pack(buckets: np.ndarray, arrays: Sequence[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket. Signed arrays are stored as differences, which compress well."""
    order = np.argsort(buckets, kind="stable")
    own = buckets[order]
    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    ends = np.r_[cuts[1:], len(own)]
    sorted_arrays = [a[order] for a in arrays]
    packed = []
    for s, e in zip(cuts, ends):
        parts = []
        for a in sorted_arrays:
            v = a[s:e]
            parts.append((np.diff(v, prepend=v.dtype.type(0)) if v.dtype.kind == "i" else v).tobytes())
        packed.append(b"".join(parts))
    return pa.RecordBatch.from_arrays(
        [pa.array(own[cuts].astype(np.int32)), pa.array(packed, pa.binary())], ["bucket", "packed"]
    )


def unpack(batches: Iterator[pa.RecordBatch], types: Sequence) -> list[np.ndarray]:
    """All arrays of a partition, joined."""
    types = [np.dtype(t) for t in types]
    width = sum(t.itemsize for t in types)
    out: list[list[np.ndarray]] = [[] for _ in types]
    for batch in batches:
        for blob in batch.column("packed").to_pylist():
            n, at = len(blob) // width, 0
            for k, t in enumerate(types):
                v = np.frombuffer(blob, t, n, at)
                out[k].append(np.cumsum(v, dtype=t) if t.kind == "i" else v)
                at += n * t.itemsize
    return [np.concatenate(v) if v else np.zeros(0, t) for v, t in zip(out, types)]


def squeezed(data: bytes) -> bytes:
    """Compressed, with the size in front; for what travels better than the shuffle's own codec makes it."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], size, codec="zstd", asbytes=True) if size else b""


def dealt(packed: DataFrame, n: int) -> DataFrame:
    return packed.repartition(n, "bucket")


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal numbers in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return cuts, np.r_[cuts[1:], len(keys)]


def in_bitmap(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = _slot(ids)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _slot(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - 25)).astype(np.int64)


def bitmap(ids: DataFrame, column: str):
    """Broadcast bit array (4 MB whatever the number of ids) of a column of longs.

    Every id is turned into its slot once; at most ``BITMAP_BITS / 64`` words of 64 bits reach the
    driver.
    """
    spark = ids.sparkSession

    def slots(batches):
        for b in batches:
            s = np.unique(_slot(b.column(0).drop_null().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays(
                [pa.array((s >> 6).astype(np.int32)), pa.array((s & 63).astype(np.int32))], ["w", "b"]
            )

    words = (
        ids.select(column)
        .distinct()
        .mapInArrow(slots, "w int, b int")
        .groupBy("w")
        .agg(F.expr("bit_or(shiftleft(1L, b))").alias("v"))
        .toArrow()
    )
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return spark.sparkContext.broadcast(bits.view(np.uint8))


def edges_total(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of the edges (a, b), longs.

    Large-star and small-star steps in turn until nothing changes: a logarithmic number of rounds,
    each a few joins; a node with many edges is aggregated before the shuffle and its join side is
    split by the adaptive skew join. Edges a = a are allowed; no edges give no rows.
    """
    spark = edges.sparkSession
    edges, path = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = edges_total(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # each node has smaller neighbours only now
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").union(smallest.select("a", F.col("m").alias("b"))).distinct()
        last = path
        edges, path = stored(small, "edges")
        discard(spark, last)
        after = edges_total(edges)
        if after == before:
            break
        before = after
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct()).distinct()


def pick(table: DataFrame, *columns: Column | str) -> DataFrame:
    """Only the named columns, so that other columns of the caller's table can't clash."""
    return table.select(*columns)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
