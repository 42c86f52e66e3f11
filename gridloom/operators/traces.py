"""Label traces: the mean of a movie over each label's voxels, at each time."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import expr
from gridloom.plans.memory import resolve_budget

BYTES_PER_CELL, BYTES_PER_MEMBER = 160, 24


def check(movie, labels) -> None:
    if "time" not in movie.axes:
        raise ValueError("a movie has a time axis")
    rest = tuple(a for a in movie.axes if a != "time")
    if labels.axes != rest or labels.shape != tuple(n for a, n in zip(movie.axes, movie.shape) if a != "time"):
        raise ValueError(f"labels need the movie's other axes {rest}")
    if labels.dtype.kind not in "iu":
        raise ValueError("labels must be whole numbers")


def label_counts(labels, memory_limit=None) -> DataFrame:
    """(chunk, label, voxels) of the spatial chunks that hold any label; negative labels raise."""
    m = labels.metadata
    cells = labels.cells()
    chunk = F.lit(0).cast("bigint")
    for a, n, c in zip(m.axes, m.shape, m.chunks or m.shape):
        chunk = chunk * math.ceil(n / c) + F.floor(F.col(f"`{a}`") / c)
    bad = F.raise_error(F.lit("labels must not be negative")).cast("bigint")
    value = F.when(F.col("value") < 0, bad).otherwise(F.col("value").cast("bigint"))
    return cells.where("value <> 0").groupBy(chunk.alias("chunk"), value.alias("label")).agg(F.count(F.lit(1)).alias("voxels"))


@dataclass(frozen=True)
class TracePlan:
    cells: int
    active_chunks: int
    skipped_chunks: int
    time_window: int
    tasks: int
    memory_per_task: int
    bytes_read: int
    label_bytes: int

    def to_dict(self) -> dict:
        return asdict(self)


def task_memory(frames: int, block: int, item: int, cells: int) -> int:
    """Source, two float32 copies, labels and their workspace, sums, output and cell records."""
    return frames * block * (item + 8) + block * 16 + cells * (frames * 12 + BYTES_PER_CELL)


def time_window(n: int, native: int, block: int, item: int, cells: int, budget: int) -> int:
    """The most frames that fit, in whole native chunks where one fits."""
    fixed, each = block * 16 + cells * BYTES_PER_CELL, block * (item + 8) + cells * 12
    fit = (budget - fixed) // each
    if fit < 1:
        raise MemoryError("not even one frame fits the memory limit")
    return min(n, fit if fit < native else fit // native * native)


def plan_traces(movie, labels, memory_limit: int | str = "1 GiB") -> TracePlan:
    """Reads the labels only."""
    check(movie, labels)
    m = movie.metadata
    budget = resolve_budget(memory_limit).task_bytes
    counts = label_counts(labels)
    row = counts.agg(F.count_distinct("label").alias("cells"), F.count_distinct("chunk").alias("active"), F.count(F.lit(1)).alias("members")).first()
    if row.cells * BYTES_PER_CELL + row.members * BYTES_PER_MEMBER > budget:
        raise MemoryError(f"{row.cells} labels don't fit the memory limit")
    lm = labels.metadata
    chunks = math.prod(math.ceil(n / c) for n, c in zip(lm.shape, lm.chunks or lm.shape))
    at = m.axes.index("time")
    native = (m.chunks or m.shape)[at]
    block = math.prod(c for i, c in enumerate(m.chunks or m.shape) if i != at)
    window = time_window(m.shape[at], native, block, np.dtype(m.dtype).itemsize, row.cells, budget)
    tasks = math.ceil(m.shape[at] / window)
    size = np.dtype(m.dtype).itemsize
    return TracePlan(row.cells, row.active, chunks - row.active, window, tasks, task_memory(window, block, size, row.cells), row.active * block * m.shape[at] * size, math.prod(lm.shape) * np.dtype(lm.dtype).itemsize)


def trace_cells(movie: DataFrame, labels: DataFrame, space: list[str], broadcast_rows: int | None = None) -> DataFrame:
    """(time, cell, value): voxels join their label, sums are double and map-side partial, results float.

    The label side is broadcast only where its counted rows are within the bound given."""
    named = labels.where("value <> 0").select(*space, F.col("value").cast("bigint").alias("cell"))
    if broadcast_rows is not None:
        named = F.broadcast(named)
    joined = movie.join(named, space)
    return joined.groupBy("time", "cell").agg(F.avg(F.col("value").cast("float").cast("double")).cast("float").alias("value"))


class Traces:
    """The result: long cells, and the two coordinates that belong to them."""

    def __init__(self, values: DataFrame, timestamps: DataFrame, cell_ids: DataFrame, shape):
        self.values, self.timestamps, self.cell_ids, self.shape = values, timestamps, cell_ids, shape

    def matrix(self, memory_limit: int | str = "1 GiB") -> np.ndarray:
        """(time, cell), cells ascending, NaN where nothing was measured."""
        if 20 * math.prod(self.shape) > resolve_budget(memory_limit).task_bytes:
            raise MemoryError("the traces don't fit the driver")
        ids = np.array(sorted(r[0] for r in self.cell_ids.collect()))
        t = self.values.toArrow()
        out = np.full((self.shape[0], len(ids)), np.nan, np.float32)
        out[t.column("time").to_numpy(), np.searchsorted(ids, t.column("cell").to_numpy())] = t.column("value").to_numpy(zero_copy_only=False)
        return out


def extract_traces(movie, labels, *, output=None, memory_limit: int | str = "1 GiB", broadcast_rows: int = 1_000_000, resume: bool = True):
    """Traces of every label. With an output (a path) they are written a time window at a time; windows
    that are there, complete, are kept."""
    check(movie, labels)
    plan = plan_traces(movie, labels, memory_limit)
    spark, m = movie._session(), movie.metadata
    space = [a for a in movie.axes if a != "time"]
    counts = label_counts(labels)
    cell_ids = counts.select(F.col("label").alias("cell")).distinct()
    voxels = counts.agg(F.sum("voxels")).first()[0] or 0
    bound = voxels if voxels <= broadcast_rows else None
    stamps = movie.selection.timestamps(spark)
    if stamps is None:
        stamps = spark.range(movie.shape[movie.axes.index("time")]).select(F.col("id").alias("time"), F.col("id").cast("double").alias("t"))
    shape = (movie.shape[movie.axes.index("time")], plan.cells)
    if output is None:
        return Traces(trace_cells(movie.cells(), labels.cells(), space, bound), stamps, cell_ids, shape)
    import os

    from gridloom.storage.manifest import read_json, write_json
    from gridloom.storage.outputs import Output, separate

    root = Output(output if isinstance(output, str) else output.uri).root
    separate(root, [m.source.uri, labels.metadata.source.uri])
    identity = expr.stable_hash({"movie": [m.source.uri, m.source.checksum, m.path, [list(b) for b in m.bounds], expr.identity(movie.expression)], "labels": [labels.metadata.source.uri, labels.metadata.source.checksum, labels.metadata.path], "window": plan.time_window})
    record = os.path.join(root, "provenance.json")
    if os.path.exists(record) and read_json(record)["workflow_id"] != identity:
        from gridloom.exceptions import ProvenanceMismatchError

        raise ProvenanceMismatchError(f"{root} holds other traces")
    write_json(record, {"workflow_id": identity, "plan": plan.to_dict(), "complete": False})
    for k in range(plan.tasks):
        path = f"{root}/traces/window={k}"
        if resume and os.path.exists(f"{path}/_SUCCESS"):
            continue
        window = slice(k * plan.time_window, min(shape[0], (k + 1) * plan.time_window))
        part = movie.isel(time=window)
        trace_cells(part.cells(), labels.cells(), space, bound).withColumn("time", F.col("time") + window.start).write.mode("overwrite").parquet(path)
    stamps.write.mode("overwrite").parquet(f"{root}/timestamps")
    cell_ids.write.mode("overwrite").parquet(f"{root}/cell_ids")
    write_json(record, {"workflow_id": identity, "plan": plan.to_dict(), "complete": True})
    return Traces(spark.read.parquet(f"{root}/traces").drop("window"), spark.read.parquet(f"{root}/timestamps"), spark.read.parquet(f"{root}/cell_ids"), shape)
