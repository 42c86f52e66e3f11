"""User functions on dense blocks: adapters, and the kernel that assembles a partition's block from its
cells, runs the function, writes the outcome and then the manifest."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from gridloom.exceptions import AdapterCompatibilityError


@dataclass(frozen=True)
class Requirements:
    input_kinds: tuple[str, ...] = ("array",)
    splittable_axes: tuple[str, ...] | None = None
    requires_overlap: dict[str, int | str] = field(default_factory=dict)
    output_kinds: tuple[str, ...] = ("array",)
    resources: dict[str, int] = field(default_factory=dict)
    deterministic: bool = True
    requires_local_path: bool = False


@dataclass(frozen=True)
class ResourceSpec:
    cpu: int = 1
    memory: int | None = None
    gpu: int = 0
    local_scratch: int | None = None

    def profile(self):
        """A Spark resource profile for kernels that need more than a task's default."""
        from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

        tasks = TaskResourceRequests().cpus(self.cpu)
        executors = ExecutorResourceRequests().cores(self.cpu)
        if self.gpu:
            tasks, executors = tasks.resource("gpu", self.gpu), executors.resource("gpu", self.gpu)
        if self.memory:
            executors = executors.memory(f"{self.memory >> 20}m")
        return ResourceProfileBuilder().require(tasks).require(executors).build


@dataclass(frozen=True)
class OutputSchema:
    kind: str
    name: str
    dtype: str = "float64"
    reduced_axes: tuple[str, ...] = ()
    chunks: tuple[int, ...] | None = None
    columns: str = ""


@dataclass(frozen=True)
class Loaded:
    """A partition in a task: block (with halo), its ranges, and times of its samples."""

    data: np.ndarray
    key: str
    read: tuple
    output: tuple
    trim: tuple
    axes: tuple[str, ...]
    timestamps: np.ndarray | None = None
    parameters: dict = field(default_factory=dict)
    seed: int = 0


class Adapter(ABC):
    """A named, versioned function of partitions."""

    name = "adapter"
    version = "1"
    requirements = Requirements()
    output: OutputSchema
    parameters: dict = {}

    def identity(self) -> dict:
        return {"name": self.name, "version": self.version, "parameters": {k: repr(v) for k, v in sorted(self.parameters.items())}}

    def prepare(self) -> None:
        """Called once in each worker process."""

    @abstractmethod
    def run(self, part: Loaded): ...

    def memory(self, block_bytes: int) -> int:
        return 4 * block_bytes

    def stages(self) -> list[dict]:
        return []


class MergeableAdapter(Adapter):
    """Declared for functions whose partition results could be merged at borders; nothing calls it."""

    @abstractmethod
    def boundary_summary(self, part: Loaded, result): ...

    @abstractmethod
    def merge(self, summaries): ...


class FunctionAdapter(Adapter):
    """``function(block, **parameters)`` giving an array (of the owned shape, or with the halo) or a table."""

    def __init__(self, function: Callable, output: OutputSchema, *, name: str | None = None, version: str = "1", parameters: dict | None = None, requirements: Requirements | None = None):
        self.function, self.output, self.version = function, output, version
        self.name = name or f"{function.__module__}.{function.__qualname__}"
        self.parameters = dict(parameters or {})
        self.requirements = requirements or Requirements()

    def run(self, part: Loaded):
        return self.function(part.data, **self.parameters)


class TimeSeriesAdapter(Adapter):
    """``function(series, **parameters)`` giving a table. The series is made by ``build(rank)`` of an
    optional time-series package, or is a (times, values) pair without one."""

    def __init__(self, function: Callable, output: OutputSchema, *, package=None, parameters: dict | None = None, requires_overlap: int = 0):
        self.function, self.output, self.package = function, output, package
        self.parameters = dict(parameters or {})
        self.name = f"timeseries.{function.__qualname__}"
        self.requirements = Requirements(output_kinds=("table",), splittable_axes=("time",), requires_overlap={"time": requires_overlap} if requires_overlap else {})

    def run(self, part: Loaded):
        import pandas as pd

        t, v = part.timestamps, part.data
        if self.package is not None:
            kind = ("Tsd", "TsdFrame", "TsdTensor")[min(v.ndim, 3) - 1]
            series = getattr(self.package, kind)(t=t, d=v)
        else:
            series = (t, v)
        out = self.function(series, **self.parameters)
        if isinstance(out, pd.DataFrame):
            return out
        return pd.DataFrame(out if isinstance(out, dict) and any(np.ndim(x) for x in out.values()) else [out])


def trimmed(result: np.ndarray, part, axes_kept: list[int]) -> np.ndarray:
    """The part of an array result that a partition owns."""
    result = np.asarray(result)
    owned = tuple(part.trim[i][1] - part.trim[i][0] for i in axes_kept)
    whole = tuple(part.read[i][1] - part.read[i][0] for i in axes_kept)
    if result.shape == owned:
        return result
    if result.shape == whole:
        return result[tuple(slice(*part.trim[i]) for i in axes_kept)]
    raise AdapterCompatibilityError(f"{part.key}: the function gave shape {result.shape}; {owned} or {whole} was due")


def block_of(group, axes: tuple[str, ...], read, dtype) -> np.ndarray:
    """A dense block from an Arrow table of its cells."""
    out = np.zeros([b - a for a, b in read], dtype)
    index = tuple(group.column(a).to_numpy() - lo for a, (lo, _) in zip(axes, read))
    out[index] = group.column("value").to_numpy(zero_copy_only=False).astype(dtype)
    return out


def atomic(path: str, data: bytes) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temporary, "wb") as f:
        f.write(data)
    os.replace(temporary, path)


def write_blocks(root: str, name: str, data: np.ndarray, start: tuple[int, ...], chunks: tuple[int, ...], codec: str | None) -> tuple[dict, dict, dict]:
    """Chunk files of an owned region that starts at a chunk border: outputs, checksums, sizes."""
    import gzip
    import zlib

    outputs, sums, sizes = {}, {}, {}
    data = np.asarray(data)
    counts = [range(math.ceil(n / c)) for n, c in zip(data.shape, chunks)]
    for index in itertools.product(*counts):
        block = np.zeros(chunks, data.dtype)
        part = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunks))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = block.tobytes()
        raw = zlib.compress(raw, 1) if codec == "zlib" else gzip.compress(raw, 1, mtime=0) if codec == "gzip" else raw
        place = ".".join(str(s // c + i) for s, c, i in zip(start, chunks, index)) or "0"
        location = f"arrays/{name}/{place}"
        atomic(os.path.join(root, location), raw)
        key = f"{name}:{place}"
        outputs[key], sums[key], sizes[key] = location, hashlib.sha256(raw).hexdigest(), len(raw)
    return outputs, sums, sizes


def write_table(root: str, name: str, frame, partition_id: str, partition_on: tuple[str, ...]) -> tuple[dict, dict, dict]:
    """Parquet files of a partition's rows: one, or one for each distinct key."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    outputs, sums, sizes = {}, {}, {}
    if partition_on:
        parts = [(hashlib.sha256(repr(key).encode()).hexdigest()[:16], f) for key, f in frame.groupby(list(partition_on), dropna=False, sort=True)]
    else:
        parts = [("", frame)]
    for bucket, f in parts:
        sink = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_pandas(f, preserve_index=False), sink)
        raw = sink.getvalue().to_pybytes()
        location = f"tables/{name}/partitions/{bucket}/part-{partition_id}.parquet" if bucket else f"tables/{name}/part-{partition_id}.parquet"
        atomic(os.path.join(root, location), raw)
        key = f"{name}:{bucket or partition_id}"
        outputs[key], sums[key], sizes[key] = location, hashlib.sha256(raw).hexdigest(), len(raw)
    return outputs, sums, sizes
