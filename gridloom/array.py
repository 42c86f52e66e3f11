"""Lazy labelled arrays over Spark DataFrames of cells.

Nothing is read before ``compute``, ``persist`` or an action on ``cells()``: building an
expression works on metadata alone."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from numpy.lib.mixins import NDArrayOperatorsMixin
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import expr
from gridloom.functions import elementwise
from gridloom.lower import Lowering
from gridloom.plans.memory import resolve_budget


@dataclass(frozen=True)
class SourceIdentity:
    uri: str
    version: str | None = None
    asset_id: str | None = None
    checksum: str | None = None


@dataclass(frozen=True)
class ArrayMeta:
    """What is known of an array without reading it. ``bounds``: the half-open range in the original
    dataset, one pair an axis."""

    source: SourceIdentity
    path: str
    name: str
    shape: tuple[int, ...]
    axes: tuple[str, ...]
    dtype: np.dtype
    chunks: tuple[int, ...] | None = None
    neurodata_type: str | None = None
    type_hierarchy: tuple[str, ...] = ()
    rate: float | None = None
    starting_time: float | None = None
    timestamps_path: str | None = None
    bounds: tuple[tuple[int, int], ...] = ()
    attributes: dict[str, Any] = field(default_factory=dict)
    subject: str | None = None
    session_id: str | None = None

    def __post_init__(self):
        if not self.bounds:
            object.__setattr__(self, "bounds", tuple((0, n) for n in self.shape))


def default_axes(rank: int, timed: bool, image_series: bool = False) -> tuple[str, ...]:
    """Axis names by rank, where a dataset doesn't name them."""
    first = "time" if timed else "axis_0"
    rest = {1: (), 2: ("y",), 3: ("y", "x"), 4: ("y", "x", "z") if image_series else ("z", "y", "x")}
    return (first, *(rest[rank] if rank in rest else tuple(f"axis_{i}" for i in range(1, rank))))


def contiguous(s: slice, n: int) -> tuple[int, int]:
    if not isinstance(s, slice):
        raise TypeError("only slices select")
    if s.step not in (None, 1):
        raise ValueError("slices must have step 1")
    start, stop, _ = s.indices(n)
    if stop <= start:
        raise ValueError("a slice must not be empty")
    return start, stop


class Selection:
    """One array of a source: metadata and a way to read ranges of it as cells."""

    def __init__(self, meta: ArrayMeta, read, times=None, block=None):
        """``read(spark, bounds)`` gives cells with the original coordinates, restricted to the
        bounds; ``times(spark)`` gives (index, t) of irregular timestamps; ``block(bounds)``, where
        there is one, reads a dense block in a task."""
        self.metadata, self._read, self._times, self._block = meta, read, times, block

    def isel(self, **slices: slice) -> Selection:
        m = self.metadata
        for a in slices:
            if a not in m.axes:
                raise ValueError(f"no axis {a!r} among {m.axes}")
        bounds, shape, start_time = list(m.bounds), list(m.shape), m.starting_time
        for i, a in enumerate(m.axes):
            if a in slices:
                start, stop = contiguous(slices[a], m.shape[i])
                low = m.bounds[i][0]
                bounds[i], shape[i] = (low + start, low + stop), stop - start
                if a == "time" and m.rate and start_time is not None:
                    start_time += start / m.rate
        chunks = None if m.chunks is None else tuple(min(c, n) for c, n in zip(m.chunks, shape))
        return Selection(replace(m, bounds=tuple(bounds), shape=tuple(shape), chunks=chunks, starting_time=start_time), self._read, self._times, self._block)

    def cells(self, spark: SparkSession) -> DataFrame:
        """Rows (axes..., value) with coordinates from 0; bounds are given to the reader, which
        prunes chunks, and stay as predicates on coordinates."""
        m = self.metadata
        df = self._read(spark, m.bounds)
        keep = [(F.col(f"`{a}`") >= lo) & (F.col(f"`{a}`") < hi) for a, (lo, hi) in zip(m.axes, m.bounds)]
        for k in keep:
            df = df.where(k)
        return df.select(*[(F.col(f"`{a}`") - F.lit(lo)).cast("bigint").alias(a) for a, (lo, _) in zip(m.axes, m.bounds)], "value")

    def timestamps(self, spark: SparkSession) -> DataFrame | None:
        """(time, t) in seconds: stored ones, else from the rate; None without either."""
        m = self.metadata
        axis = m.axes.index("time") if "time" in m.axes else 0
        lo, hi = m.bounds[axis]
        if self._times is not None:
            return self._times(spark).where((F.col("time") >= lo) & (F.col("time") < hi)).select((F.col("time") - lo).alias("time"), "t")
        if m.rate:
            return spark.range(hi - lo).select(F.col("id").alias("time"), (F.lit(m.starting_time or 0.0) + F.col("id") / F.lit(m.rate)).alias("t"))
        return None

    def plan(self) -> dict:
        m = self.metadata
        return {"path": m.path, "shape": m.shape, "axes": m.axes, "dtype": m.dtype.str, "bytes": math.prod(m.shape) * m.dtype.itemsize, "bounds": m.bounds}


class NamedArray(NDArrayOperatorsMixin):
    """A lazy expression over one selection. NumPy functions and operators build further ones."""

    __array_priority__ = 1000

    def __init__(self, selection: Selection, expression: expr.Expression | None = None, spark: SparkSession | None = None):
        m = selection.metadata
        self.selection = selection
        self.expression = expression if expression is not None else expr.Input(m.shape, m.axes, np.dtype(m.dtype))
        self.spark = spark

    shape = property(lambda self: self.expression.shape)
    axes = property(lambda self: self.expression.axes)
    dtype = property(lambda self: self.expression.dtype)
    ndim = property(lambda self: len(self.expression.shape))
    size = property(lambda self: math.prod(self.expression.shape))
    nbytes = property(lambda self: self.size * self.dtype.itemsize)
    metadata = property(lambda self: self.selection.metadata)

    def __len__(self) -> int:
        if not self.shape:
            raise TypeError("a 0-D array has no length")
        return self.shape[0]

    def __repr__(self) -> str:
        return f"NamedArray({', '.join(f'{a}={n}' for a, n in zip(self.axes, self.shape))}; {self.dtype}; {self.metadata.path})"

    def __array__(self, *_, **__):
        raise TypeError("arrays are lazy; call compute() for a NumPy array")

    def __bool__(self):
        raise TypeError("the truth of a lazy array isn't known; call compute()")

    def __iter__(self):
        raise TypeError("lazy arrays can't be iterated; call compute()")

    def _with(self, expression: expr.Expression) -> NamedArray:
        return NamedArray(self.selection, expression, self.spark)

    def isel(self, **slices: slice) -> NamedArray:
        """Slices by axis name. They go below the expression, to the source."""
        e = self.expression
        for a in slices:
            if a not in e.axes:
                raise ValueError(f"no axis {a!r} among {e.axes}")
            if a in _reduced(e):
                raise ValueError(f"axis {a!r} is reduced and can't be sliced")
        part = self.selection.isel(**slices)
        m = part.metadata
        return NamedArray(part, expr.rebind(e, expr.Input(m.shape, m.axes, np.dtype(m.dtype))), self.spark)

    def __getitem__(self, key) -> NamedArray:
        keys = list(key) if isinstance(key, tuple) else [key]
        if any(k is None or isinstance(k, (int, np.integer, bool, list, np.ndarray, NamedArray)) for k in keys):
            raise IndexError("only contiguous slices and one ellipsis are supported")
        if sum(k is Ellipsis for k in keys) > 1:
            raise IndexError("an index has one ellipsis at most")
        if Ellipsis in keys:
            i = keys.index(Ellipsis)
            keys[i : i + 1] = [slice(None)] * (self.ndim - len(keys) + 1)
        if len(keys) > self.ndim:
            raise IndexError("too many indices")
        chosen = {a: k for a, k in zip(self.axes, keys) if k != slice(None)}
        return self.isel(**chosen) if chosen else self

    def __array_ufunc__(self, function, method, *inputs, out=None, **keywords):
        if method != "__call__" or out is not None or keywords or function.__name__ not in elementwise.NAMES:
            return NotImplemented
        operands = []
        for x in inputs:
            if isinstance(x, NamedArray):
                if x.selection is not self.selection and x.metadata != self.metadata:
                    raise ValueError("operands must use the same source selection")
                operands.append(x.expression)
            else:
                operands.append(expr.scalar(x))
        return self._with(expr.ufunc(function.__name__, operands))

    def __array_function__(self, function, types, args, keywords):
        made = FUNCTIONS.get(function)
        return NotImplemented if made is None else made(*args, **keywords)

    def astype(self, dtype, order: str = "K", casting: str = "unsafe", subok: bool = True, copy: bool = True) -> NamedArray:
        if order != "K" or not subok:
            raise ValueError("astype takes order='K' and subok=True only")
        return self._with(expr.cast(self.expression, dtype, casting))

    def _reduce(self, name: str, axis, keepdims, dtype=None, parameters=None, refused=None) -> NamedArray:
        for k, v in (refused or {}).items():
            if v is not None and v is not False and v is not np._NoValue:
                raise TypeError(f"{name} doesn't take {k}")
        keepdims = False if keepdims is np._NoValue else keepdims
        return self._with(expr.reduction(name, self.expression, axis, keepdims, dtype, parameters))

    def sum(self, axis=None, dtype=None, out=None, keepdims=False, initial=None, where=None):
        return self._reduce("sum", axis, keepdims, dtype, refused={"out": out, "initial": initial, "where": where})

    def mean(self, axis=None, dtype=None, out=None, keepdims=False, where=None):
        return self._reduce("mean", axis, keepdims, dtype, refused={"out": out, "where": where})

    def min(self, axis=None, out=None, keepdims=False, initial=None, where=None):
        return self._reduce("min", axis, keepdims, refused={"out": out, "initial": initial, "where": where})

    def max(self, axis=None, out=None, keepdims=False, initial=None, where=None):
        return self._reduce("max", axis, keepdims, refused={"out": out, "initial": initial, "where": where})

    def median(self, axis=None, out=None, overwrite_input=False, keepdims=False, output=None, chunks=None, max_workers=None, memory_limit=None):
        made = self._reduce("median", axis, keepdims, refused={"out": out, "overwrite_input": overwrite_input})
        return made if output is None else made.persist(output, chunks=chunks, max_workers=max_workers, memory_limit=memory_limit)

    def percentile(self, q, axis=None, out=None, overwrite_input=False, method="linear", keepdims=False, weights=None):
        return self._reduce("percentile", axis, keepdims, parameters={"q": q, "method": method}, refused={"out": out, "overwrite_input": overwrite_input, "weights": weights})

    def quantile(self, q, axis=None, out=None, overwrite_input=False, method="linear", keepdims=False, weights=None):
        return self._reduce("quantile", axis, keepdims, parameters={"q": q, "method": method}, refused={"out": out, "overwrite_input": overwrite_input, "weights": weights})

    def _session(self) -> SparkSession:
        return self.spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def cells(self) -> DataFrame:
        """The result as a DataFrame (axes..., value): one plan, nothing read yet."""
        m = self.metadata
        return Lowering(self.selection.cells(self._session()), expr.Input(m.shape, m.axes, np.dtype(m.dtype))).run(self.expression)

    def kept_axes(self) -> set[str]:
        """Axes that no reduction of the expression spans, global staged scalars apart."""
        return {a for a in self.metadata.axes if a not in _reduced(self.expression, True)}

    def _tiles(self, most: int = 64 << 20) -> list[tuple[tuple[int, int], ...]] | None:
        """Ranges of the selection that can be evaluated each on its own: reduced axes whole, others by
        native chunk or less. None where a reduction spans everything or a tile would be too large."""
        m, e = self.metadata, self.expression
        kept = [a for a in m.axes if a not in _reduced(e, True)]
        if self.selection._block is None or not e.axes or any(not r.axes and r.name not in ("sum", "mean", "min", "max") for r in _reductions(e)):
            return None
        if not kept or any(a not in e.axes for a in kept):
            return None
        size = {a: min(n, c) if a in kept else n for a, n, c in zip(m.axes, m.shape, m.chunks or m.shape)}
        bytes_ = lambda: math.prod(size.values()) * max(4, np.dtype(m.dtype).itemsize)
        while bytes_() > most and max(size[a] for a in kept) > 1:
            a = max(kept, key=size.get)
            size[a] = -(-size[a] // 2)
        if bytes_() > most:
            return None
        return list(itertools.product(*[[(lo, min(n, lo + size[a])) for lo in range(0, n, size[a])] for a, n in zip(m.axes, m.shape)]))

    def _by_blocks(self, tiles) -> np.ndarray:
        """One task a tile: read its block, evaluate the expression in NumPy, return the bytes. No shuffle."""
        import pyarrow as pa

        spark, m, e, read = self._session(), self.metadata, self.expression, self.selection._block
        scalars = {}
        for s in expr.staged(e):
            row = Lowering(self.selection.cells(spark), expr.Input(m.shape, m.axes, np.dtype(m.dtype))).run(s).first()
            scalars[expr.identity(s)] = s.dtype.type(row["value"])

        def run(batches):
            for b in batches:
                for i in b.column(0).to_pylist():
                    block = read([(lo + a, lo + z) for (lo, _), (a, z) in zip(m.bounds, tiles[i])])
                    value = np.ascontiguousarray(expr.evaluate(e, block, m.axes, scalars), dtype=e.dtype)
                    yield pa.RecordBatch.from_pydict({"tile": [i], "data": [value.tobytes()]})

        out = np.zeros(self.shape, self.dtype)
        for r in spark.range(0, len(tiles), 1, min(len(tiles), 4096)).mapInArrow(run, "tile long, data binary").collect():
            ranges = dict(zip(m.axes, tiles[r.tile]))
            index = tuple(slice(*ranges[a]) if n > 1 or m.shape[m.axes.index(a)] == 1 else slice(0, 1) for a, n in zip(self.axes, self.shape))
            part = out[index]
            out[index] = np.frombuffer(r.data, self.dtype).reshape(part.shape)
        return out

    def compute(self, memory_limit: int | str = "1 GiB", engine: str | None = None):
        """The result as a NumPy array or scalar; refused where it wouldn't fit the driver.

        ``engine``: "cells" (the DataFrame plan), or "auto": dense blocks where the source has them and no
        tile needs another's values, else cells."""
        need = self.size * (8 * (self.ndim + 1)) + self.nbytes
        budget = resolve_budget(memory_limit)
        if need > budget.task_bytes:
            raise MemoryError(f"the result takes about {need} bytes, {budget.task_bytes} are allowed; persist it instead")
        if (engine or ENGINE) == "auto" and (tiles := self._tiles()):
            return self._by_blocks(tiles)
        table = self.cells().toArrow()
        values = table.column("value").to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0)
        if not self.axes:
            return self.dtype.type(values[0])
        out = np.zeros(self.shape, self.dtype)
        out[tuple(table.column(a).to_numpy() for a in self.axes)] = values.astype(self.dtype)
        return out

    def persist(self, output, chunks=None, **how):
        from gridloom.run import persist_expression

        return persist_expression(self, output, chunks=chunks, **how)

    def segment(self, adapter, *, tile: dict[str, int] | None = None, halo: dict[str, int] | None = None, allow_unmerged: bool = False, **how):
        from gridloom.operators.segmentation import segment

        return segment(self, adapter, tile=tile, halo=halo, allow_unmerged=allow_unmerged, **how)

    def cellpose(self, *, output, memory_limit: int | str = "4 GiB", **parameters):
        from gridloom.operators.segmentation import cellpose

        return cellpose(self, output=output, memory_limit=memory_limit, **parameters)

    def extract_traces(self, labels: NamedArray, *, output=None, **how):
        from gridloom.operators.traces import extract_traces

        return extract_traces(self, labels, output=output, **how)

    def plan_traces(self, labels: NamedArray, **how):
        from gridloom.operators.traces import plan_traces

        return plan_traces(self, labels, **how)


#: How ``compute`` works unless told.
ENGINE = "auto"


def _reductions(x: expr.Expression) -> list[expr.Reduction]:
    return [*([x] if isinstance(x, expr.Reduction) else []), *(r for c in expr.children(x) for r in _reductions(c))]


def _reduced(x: expr.Expression, staged_apart: bool = False) -> set[str]:
    """Axes that a reduction of the expression spans (global staged scalars apart, if asked)."""
    if staged_apart and isinstance(x, expr.Reduction) and not x.axes:
        return set()
    own = set(x.reduced) if isinstance(x, expr.Reduction) else set()
    return own.union(*[_reduced(c, staged_apart) for c in expr.children(x)])


def _shape(a):
    return a.shape


def _size(a, axis=None):
    return a.size if axis is None else math.prod(a.shape[a.axes.index(n)] for n in expr.normalise_axes(axis, a.axes))


FUNCTIONS = {getattr(np, n): (lambda a, *p, _n=n, **k: getattr(a, _n)(*p, **k)) for n in ("sum", "mean", "min", "max", "median", "percentile", "quantile")}
FUNCTIONS |= {np.amin: FUNCTIONS[np.min], np.amax: FUNCTIONS[np.max], np.shape: _shape, np.ndim: lambda a: a.ndim, np.size: _size}
