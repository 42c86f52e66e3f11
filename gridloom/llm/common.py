"""Shared pieces of the corpus operators: the shared folder, checkpoints, spread row
numbers, bounded bitmaps and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Bytes of rows that go to a Python worker at a time. Texts may be long: a batch counted in rows has no bound.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ``BATCH_BYTES``, where they may be larger."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset on one machine (a local master, as in tests) a fresh temporary folder is
    used; on a cluster it would be a folder of the driver alone, and is refused."""
    bounded_batches(spark)
    context = spark.sparkContext
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not wanted and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(wanted or f"file://{tempfile.mkdtemp(prefix='gridloom-')}")
        current = context._jsc.sc().getCheckpointDir()
    return wanted or current.get()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in files that survive the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A table in the shared folder: like a checkpoint, but in compressed columns."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(spark: SparkSession) -> int:
    """Number of hash buckets for work that must not meet in one task."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, group: list[str], order: list[Column], key: list[Column], out: str) -> DataFrame:
    """Adds ``out``: 0, 1, ... without gaps within each ``group``, without bringing a whole
    group to one task.

    Rows of a group are dealt by a hash of ``key`` to ``spread`` buckets; a small table of
    counts by (group, bucket) gives each bucket its start. The window that numbers rows and
    the one that sums counts both run by (group, bucket) or over the counts alone."""
    n = spread(df.sparkSession)
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))
    starts = (
        b.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.sum("_n").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)))
        .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce("_start", F.lit(0)).alias("_start"))
    )
    rows = b.withColumn("_row", F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(*order)) - 1)
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_bucket") == F.col("_b")]
    return rows.join(starts, on).withColumn(out, (F.col("_start") + F.col("_row")).cast("long")).drop("_bucket", "_row", "_start", "_b", *[f"_g{i}" for i in range(len(group))])


def bitmap_of(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of ``2**bits`` bits, set at the low bits of the 64-bit values of a column.

    Fixed size whatever the input. A task holds the packed bits of its values and yields them in
    64 kbit blocks, as sorted 16-bit places where there are few and as packed bits where there are many; blocks are
    united by key, so that the driver gets ``2**bits / 8`` bytes at most."""
    block = min(bits, 16)
    size = (1 << block) // 8

    def packed(held: np.ndarray):
        import pyarrow as pa

        parts = held.reshape(-1, size)
        used = np.flatnonzero(parts.any(axis=1))
        for i in range(0, len(used), 128):
            rows = []
            for k in used[i : i + 128]:
                places = np.flatnonzero(np.unpackbits(parts[k])).astype("<u2") if np.bitwise_count(parts[k]).sum(dtype=np.int64) * 2 < size else None
                rows.append((places is None, (parts[k] if places is None else places).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(used[i : i + 128].astype(np.int64)), pa.array([d for d, _ in rows], pa.bool_()), pa.array([v for _, v in rows], pa.binary())], ["k", "dense", "v"])

    def unpacked(dense: bool, v: bytes) -> np.ndarray:
        if dense:
            return np.frombuffer(v, np.uint8)
        own = np.zeros(size * 8, np.uint8)
        own[np.frombuffer(v, "<u2")] = 1
        return np.packbits(own)

    def set_bits(batches):
        own = np.zeros(1 << bits >> 3, np.uint8)
        for b in batches:
            at = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.int64)
            if len(at):
                byte, bit = at >> 3, (128 >> (at & 7)).astype(np.uint8)
                first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
                own[byte[first]] |= np.bitwise_or.reduceat(bit, first)
        yield from packed(own)

    def unite(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, dense, v in zip(*(b.column(c).to_pylist() for c in ("k", "dense", "v"))):
                v = unpacked(dense, v)
                found[k] = found[k] | v if k in found else v.copy()
        import pyarrow as pa

        for k, v in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([True]), pa.array([v.tobytes()], pa.binary())], ["k", "dense", "v"])

    kind = "k long, dense boolean, v binary"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(column).cast("long").alias("x")).mapInArrow(set_bits, kind).repartition(n, "k").mapInArrow(unite, kind).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for k, _, v in rows:
        out[k * size : (k + 1) * size] = np.frombuffer(v, np.uint8)
    return out


class Known:
    """A set of 64-bit values to sift rows by. While 2**``most`` bits hold 16 bits a value it is a bitmap, sized by the
    counted values, that travels to the tasks and lets one in 16 others through; beyond that
    the bitmap is None and ``sift`` joins with the table of values."""

    def __init__(self, values: DataFrame, column: str, most: int = 27):
        self.table = checkpoint(values.select(F.col(column).cast("long").alias("_known")))
        n = self.table.count()
        bits = max(16, (16 * n - 1).bit_length()) if n else 3
        self.bitmap = bitmap_of(self.table, "_known", bits) if bits <= max(most, 3) else None

    def holds(self, values: np.ndarray) -> np.ndarray:
        """Whether each value may be in the set (all may, where there is no bitmap)."""
        return np.ones(len(values), bool) if self.bitmap is None else in_bitmap(self.bitmap, values)

    def sift(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows that ``holds`` let through, by the table where there is no bitmap."""
        return rows if self.bitmap is not None else rows.join(self.table, F.col(column) == F.col("_known"), "left_semi")

    def __getstate__(self):  # tasks get the bitmap alone
        return {"bitmap": self.bitmap}


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id reachable from each node of an undirected edge list (``node``, ``component``).

    Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014), each round a
    pair of aggregations followed by a checkpoint; stops when a round changes nothing. No
    node's neighbours are gathered in memory: only their minimum is aggregated, and the
    rewritten edges come from a join that adaptive execution may split."""
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = checkpoint(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        n = both(e)
        low = n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = n.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = checkpoint(small)
        sign = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen:
            break
        seen = sign
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
