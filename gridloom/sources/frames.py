"""Arrays over DataFrames: cells that are there already, or a column of equal-length vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.array import ArrayMeta, NamedArray, Selection, SourceIdentity


def from_cells(df: DataFrame, axes: tuple[str, ...], shape: tuple[int, ...], dtype, *, uri: str = "frame", name: str = "cells", chunks=None, rate=None, times: DataFrame | None = None) -> NamedArray:
    """``df`` has the axis columns and ``value``; slices become predicates on it."""
    meta = ArrayMeta(SourceIdentity(uri), f"/{name}", name, tuple(shape), tuple(axes), np.dtype(dtype), chunks, rate=rate, starting_time=0.0 if rate else None, timestamps_path="/times" if times is not None else None, attributes={"backend": "frame"})
    return NamedArray(Selection(meta, lambda spark, bounds: df, None if times is None else (lambda spark: times)), spark=df.sparkSession)


def from_vectors(df: DataFrame, index: str, vector: str, axes: tuple[str, str], shape: tuple[int, int], dtype="f4", **how) -> NamedArray:
    """Rows with an index and an array column, as a two-axis array."""
    cells = df.select(F.col(index).cast("bigint").alias(axes[0]), F.posexplode(vector).alias(axes[1], "value"))
    return from_cells(cells.select(F.col(axes[0]), F.col(axes[1]).cast("bigint").alias(axes[1]), "value"), axes, shape, dtype, **how)
