"""Zarr v2 stores as a Spark data source: one input partition per chunk in the bounds.

Chunks are C-ordered, little or big endian, raw or compressed as ``codecs`` reads; other compressors and filters
are refused. Bounds are options of a load, never pushed filters, so that two plans over one
DataFrame can't prune each other's chunks."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import json
import math
import os
import zlib
from functools import partial
from urllib.parse import unquote, urlsplit

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.array import ArrayMeta, SourceIdentity, default_axes
from gridloom.dtypes import spark_type
from gridloom.exceptions import SourceResolutionError, UnsupportedBackendError
from gridloom.sources import codecs
from gridloom.sources.base import Source

FORMAT = "gridloom_zarr"


def local_path(uri: str) -> str:
    return unquote(urlsplit(uri).path) if uri.startswith("file:") else uri


def read_chunk(root: str, meta: dict, index: tuple[int, ...]) -> np.ndarray | None:
    """One chunk, or None where it was never written."""
    path = os.path.join(root, (meta.get("dimension_separator") or ".").join(map(str, index)) if index else "0")
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        data = f.read()
    data = codecs.decode(data, (meta.get("compressor") or {}).get("id"))
    return np.frombuffer(data, np.dtype(meta["dtype"])).reshape(meta["chunks"])


def check_supported(meta: dict, path: str) -> None:
    kind = (meta.get("compressor") or {}).get("id")
    if meta.get("zarr_format") != 2 or meta.get("order", "C") != "C" or meta.get("filters") or kind not in codecs.KNOWN:
        raise UnsupportedBackendError(f"{path}: only Zarr v2 in C order, without filters, compressed by one of {codecs.KNOWN}")


def read_region(root: str, bounds) -> np.ndarray:
    """A dense block, from the chunks that it meets."""
    with open(os.path.join(root, ".zarray")) as f:
        meta = json.load(f)
    dtype = np.dtype(meta["dtype"])
    out = np.full([hi - lo for lo, hi in bounds], meta.get("fill_value") or 0, dtype.newbyteorder("="))
    for index in itertools.product(*[range(lo // c, -(-hi // c)) for (lo, hi), c in zip(bounds, meta["chunks"])]):
        chunk = read_chunk(root, meta, index)
        if chunk is not None:
            spans = [(max(lo, i * c), min(hi, (i + 1) * c)) for (lo, hi), i, c in zip(bounds, index, meta["chunks"])]
            out[tuple(slice(a - lo, z - lo) for (a, z), (lo, _) in zip(spans, bounds))] = chunk[tuple(slice(a - i * c, z - i * c) for (a, z), i, c in zip(spans, index, meta["chunks"]))]
    return out


class ChunkPartition(InputPartition):
    def __init__(self, index: tuple[int, ...]):
        self.index = index


class ZarrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.bounds = options["path"], json.loads(options["bounds"])
        with open(os.path.join(self.root, ".zarray")) as f:
            self.meta = json.load(f)

    def partitions(self):
        spans = [range(lo // c, -(-hi // c)) for (lo, hi), c in zip(self.bounds, self.meta["chunks"])]
        return [ChunkPartition(i) for i in itertools.product(*spans)]

    def read(self, partition):
        import pyarrow as pa

        chunks = self.meta["chunks"]
        block = read_chunk(self.root, self.meta, partition.index)
        if block is None:
            block = np.full(chunks, self.meta.get("fill_value") or 0, np.dtype(self.meta["dtype"]))
        origin = [i * c for i, c in zip(partition.index, chunks)]
        inside = tuple(slice(max(0, lo - o), min(c, hi - o)) for (lo, hi), o, c in zip(self.bounds, origin, chunks))
        block = block[inside]
        block = block.astype(block.dtype.newbyteorder("="))
        grid = np.meshgrid(*[np.arange(s.start + o, s.start + o + n) for s, o, n in zip(inside, origin, block.shape)], indexing="ij")
        values = block.ravel()
        kind = {"boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0)}[spark_type(block.dtype)]
        for i in range(0, len(values), 1 << 16):
            s = slice(i, i + (1 << 16))
            v = pa.array(values[s].astype(np.float32) if block.dtype == np.float16 else values[s]).cast(kind)
            yield pa.RecordBatch.from_arrays([*[pa.array(g.ravel()[s]) for g in grid], v], [*[f"d{k}" for k in range(len(grid))], "value"])


class ZarrDataSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return self.options["cells"]

    def reader(self, schema):
        return ZarrReader(dict(self.options))


class ZarrSource(Source):
    """A hierarchy in which every array named ``data``, of rank 1 or more, is an object. Discovery reads
    metadata files only; the identity hashes paths, sizes, times and those files."""

    capabilities = ("select", "inspect", "chunks")

    def __init__(self, uri: str):
        self.root = local_path(uri)
        if not os.path.isdir(self.root):
            raise SourceResolutionError(f"no store at {uri}")
        digest = hashlib.sha256()
        self._metas: list[ArrayMeta] = []
        self.files = self.bytes = 0
        found = []
        for d, names, files in sorted(os.walk(self.root)):
            names.sort()
            for f in sorted(files):
                path = os.path.join(d, f)
                state = os.stat(path)
                digest.update(f"{os.path.relpath(path, self.root)}|{state.st_size}|{state.st_mtime_ns}".encode())
                if f in (".zarray", ".zattrs", ".zgroup"):
                    with open(path, "rb") as stream:
                        digest.update(data := stream.read())
                    self.files, self.bytes = self.files + 1, self.bytes + len(data)
            if ".zarray" in files and os.path.basename(d) == "data":
                found.append(os.path.relpath(os.path.dirname(d), self.root))
        self.identity = SourceIdentity(uri, None, None, f"sha256:{digest.hexdigest()}")
        for path in found:
            if m := self._describe(path):
                self._metas.append(m)

    def _json(self, *parts: str) -> dict:
        path = os.path.join(self.root, *parts)
        if not os.path.exists(path):
            return {}
        with open(path) as f:
            return json.load(f)

    def _describe(self, path: str) -> ArrayMeta | None:
        a = self._json(path, "data", ".zarray")
        shape = tuple(a.get("shape", ()))
        if not shape or len(a.get("chunks", ())) != len(shape):
            return None
        check_supported(a, path)
        attrs, root = self._json(path, ".zattrs"), self._json(".zattrs")
        time, stamps = self._json(path, "starting_time", ".zattrs"), self._json(path, "timestamps", ".zarray")
        rate = attrs.get("rate", time.get("rate"))
        start = attrs.get("starting_time")
        if start is None and (m := self._json(path, "starting_time", ".zarray")):
            block = read_chunk(os.path.join(self.root, path, "starting_time"), m, tuple(0 for _ in m["shape"]))
            start = float(block.ravel()[0]) if block is not None else 0.0
        kind = attrs.get("neurodata_type")
        hierarchy = tuple(attrs.get("type_hierarchy", ()))
        axes = tuple(attrs["axes"]) if "axes" in attrs else default_axes(len(shape), rate is not None or bool(stamps), "ImageSeries" in (kind, *hierarchy))
        return ArrayMeta(
            self.identity, "/" + path, os.path.basename(path), shape, axes, np.dtype(a["dtype"]).newbyteorder("="), tuple(a["chunks"]), kind, hierarchy, rate,
            None if rate is None else float(start or 0.0), f"/{path}/timestamps" if stamps else None, attributes=attrs | {"backend": "zarr"}, subject=root.get("subject_id"), session_id=root.get("session_id"),
        )

    def objects(self) -> list[ArrayMeta]:
        return self._metas

    def io_counters(self) -> dict[str, int | None]:
        """Files and bytes that discovery read here; tasks read chunks elsewhere and don't count."""
        return {"responses": self.files, "bytes": self.bytes}

    def _reader(self, meta: ArrayMeta):
        return load_cells(os.path.join(self.root, meta.path.lstrip("/"), "data"), meta.axes, meta.dtype)

    def _block(self, meta: ArrayMeta):
        return partial(read_region, os.path.join(self.root, meta.path.lstrip("/"), "data"))

    def _times(self, meta: ArrayMeta):
        if not meta.timestamps_path:
            return None
        root = os.path.join(self.root, meta.timestamps_path.lstrip("/"))
        n = self._json(meta.timestamps_path.lstrip("/"), ".zarray")["shape"][0]

        def times(spark: SparkSession) -> DataFrame:
            return load_cells(root, ("time",), np.dtype("f8"))(spark, ((0, n),)).withColumnRenamed("value", "t")

        return times


def load_cells(root: str, axes: tuple[str, ...], dtype):
    def read(spark: SparkSession, bounds) -> DataFrame:
        spark.dataSource.register(ZarrDataSource)
        schema = ", ".join([*(f"d{i} bigint" for i in range(len(axes))), f"value {spark_type(dtype)}"])
        df = spark.read.format(FORMAT).option("path", root).option("bounds", json.dumps([list(b) for b in bounds])).option("cells", schema).load()
        return df.toDF(*axes, "value")

    return read


def write_array(root: str, data: np.ndarray, chunks: tuple[int, ...], compressor: str | None = None, attributes: dict | None = None) -> None:
    """Writes a NumPy array as a Zarr v2 array (fixtures, small results)."""
    os.makedirs(root, exist_ok=True)
    meta = {"zarr_format": 2, "shape": list(data.shape), "chunks": list(chunks), "dtype": data.dtype.str, "order": "C", "fill_value": 0, "filters": None, "compressor": {"id": compressor, "level": 1} if compressor else None}
    with open(os.path.join(root, ".zarray"), "w") as f:
        json.dump(meta, f)
    if attributes:
        with open(os.path.join(root, ".zattrs"), "w") as f:
            json.dump(attributes, f)
    for index in itertools.product(*[range(math.ceil(n / c)) for n, c in zip(data.shape, chunks)]):
        block = np.zeros(chunks, data.dtype)
        part = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunks))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = block.tobytes()
        raw = zlib.compress(raw, 1) if compressor == "zlib" else gzip.compress(raw, 1) if compressor == "gzip" else raw
        with open(os.path.join(root, ".".join(map(str, index))), "wb") as f:
            f.write(raw)


def write_object(root: str, path: str, data: np.ndarray, chunks, *, rate=None, starting_time=0.0, timestamps=None, attributes=None, compressor=None) -> None:
    """An object of a store: group with ``data`` and its time base."""
    group = os.path.join(root, path)
    os.makedirs(group, exist_ok=True)
    attrs = dict(attributes or {})
    if rate is not None:
        attrs |= {"rate": rate, "starting_time": starting_time}
    with open(os.path.join(group, ".zattrs"), "w") as f:
        json.dump(attrs, f)
    write_array(os.path.join(group, "data"), data, tuple(chunks), compressor)
    if timestamps is not None:
        write_array(os.path.join(group, "timestamps"), np.asarray(timestamps, "f8"), (len(timestamps),))
