"""HDF5 files, where h5py is installed: one input range of the first axis a task."""

from __future__ import annotations

import hashlib
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridloom.array import ArrayMeta, SourceIdentity, default_axes
from gridloom.dtypes import spark_type
from gridloom.exceptions import SourceResolutionError, UnsupportedBackendError
from gridloom.sources.base import Source, redacted
from gridloom.sources.zarr import local_path

TRANSPORTS = ("auto", "lindi", "remfile", "fsspec")
# Defaults of the remote transport.
BLOCK, CACHE, CACHE_TYPE = 1 << 20, 64 << 20, "readahead"


def transport_options(transport: str = "auto", block_size: int = BLOCK, cache_size: int = CACHE, cache_type: str = CACHE_TYPE, **unknown) -> dict:
    if unknown:
        raise ValueError(f"unknown storage options {sorted(unknown)}")
    if transport not in TRANSPORTS:
        raise ValueError(f"transport is one of {TRANSPORTS}")
    if block_size <= 0 or cache_size < 0:
        raise ValueError("block and cache sizes must be positive")
    return {"transport": transport, "block_size": block_size, "cache_size": cache_size, "cache_type": cache_type}


def usable(dataset) -> bool:
    """Whether something has what an array needs: rank, shape, dtype and, if any, fitting chunks."""
    shape, chunks = getattr(dataset, "shape", None), getattr(dataset, "chunks", None)
    return bool(shape) and getattr(dataset, "ndim", None) == len(shape) and hasattr(dataset, "dtype") and (chunks is None or (len(chunks) == len(shape) and all(c > 0 for c in chunks)))


class Hdf5Source(Source):
    capabilities = ("select", "inspect")

    def __init__(self, uri: str, **options):
        self.options = transport_options(**options)
        try:
            import h5py
        except ImportError as e:
            raise UnsupportedBackendError("HDF5 sources need the package h5py") from e
        path = local_path(uri)
        if not os.path.exists(path):
            raise SourceResolutionError(f"no file at {redacted(uri)}")
        state = os.stat(path)
        self.path, self._h5 = path, h5py.File(path, "r")
        digest = hashlib.sha256(f"{redacted(uri)}|{state.st_size}|{state.st_mtime_ns}".encode()).hexdigest()
        self.identity = SourceIdentity(redacted(uri), None, None, f"sha256:{digest}")

    def objects(self) -> list[ArrayMeta]:
        found = []

        def visit(name, item):
            if not name.endswith("/data") or not usable(item):
                return
            group = item.parent
            attrs = {k: v for k, v in group.attrs.items() if isinstance(v, (str, int, float))}
            start = group.get("starting_time")
            rate = None if start is None else float(start.attrs.get("rate", 0)) or None
            timed = rate is not None or "timestamps" in group
            path = name.removesuffix("/data")
            found.append(ArrayMeta(self.identity, "/" + path, path.rsplit("/", 1)[-1], item.shape, default_axes(item.ndim, timed), np.dtype(item.dtype), item.chunks, attrs.get("neurodata_type"), (), rate, None if start is None else float(start[()]), f"/{path}/timestamps" if "timestamps" in group else None, attributes=attrs | {"backend": "hdf5"}))

        self._h5.visititems(visit)
        return found

    def _reader(self, meta: ArrayMeta):
        path, name, axes = self.path, meta.path + "/data", meta.axes

        def read(spark: SparkSession, bounds) -> DataFrame:
            (lo, hi), step = bounds[0], max(1, (meta.chunks or (1,))[0])
            rows = spark.range(lo // step, -(-hi // step), 1, max(1, min(1024, (hi - lo) // step)))

            def run(batches):
                import h5py
                import pyarrow as pa

                with h5py.File(path, "r") as f:
                    for b in batches:
                        for i in b.column(0).to_pylist():
                            a, z = max(lo, i * step), min(hi, (i + 1) * step)
                            block = f[name][(slice(a, z), *[slice(*r) for r in bounds[1:]])]
                            grid = np.meshgrid(np.arange(a, z), *[np.arange(*r) for r in bounds[1:]], indexing="ij")
                            yield pa.RecordBatch.from_arrays([*[pa.array(g.ravel()) for g in grid], pa.array(block.ravel())], [*axes, "value"])

            return rows.mapInArrow(run, ", ".join(f"`{a}` bigint" for a in axes) + f", value {spark_type(meta.dtype)}")

        return read

    def close(self) -> None:
        self._h5.close()
