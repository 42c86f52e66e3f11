"""NumPy dtypes as Spark column types.

Unsigned integers are widened to the next signed type, uint64 to DECIMAL(20,0); the logical
dtype stays in the array's metadata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.exceptions import UnsupportedBackendError

# The Spark type of each NumPy dtype.
SPARK = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float16": "float", "float32": "float", "float64": "double",
}


def spark_type(dtype) -> str:
    name = np.dtype(dtype).name
    if name not in SPARK:
        raise UnsupportedBackendError(f"no column type for dtype {name}")
    return SPARK[name]


def wrapped(x: Column, dtype) -> Column:
    """An integral column (wide enough not to overflow) reduced modulo the dtype's range."""
    d = np.dtype(dtype)
    bits = 8 * d.itemsize
    low = 0 if d.kind == "u" else -(1 << (bits - 1))
    if bits < 64:
        wide = x.cast("decimal(38,0)") if bits == 32 else x.cast("bigint")
        return (F.pmod(wide - F.lit(low), F.lit(1 << bits).cast(wide_type(bits))) + F.lit(low)).cast(spark_type(d))
    x = x.cast("decimal(38,0)")
    big = F.lit(str(1 << 64)).cast("decimal(20,0)")
    offset = F.lit(str(low)).cast("decimal(20,0)")
    return (F.pmod((x - offset).cast("decimal(38,0)"), big) + offset).cast(spark_type(d))


def wide_type(bits: int) -> str:
    return "decimal(20,0)" if bits >= 32 else "bigint"


def converted(x: Column, source, target) -> Column:
    """``astype`` by NumPy's rules: integers wrap, floats are truncated first, NaN is true."""
    a, b = np.dtype(source), np.dtype(target)
    if a == b:
        return x
    if b.kind == "b":
        return x.cast("boolean") if a.kind == "b" else (F.isnan(x) | (x != 0) if a.kind == "f" else x != 0)
    if a.kind == "b":
        return x.cast("int").cast(spark_type(b))
    if b.kind in "iu":
        if a.kind == "f":
            whole = F.when(x >= 0, F.floor(x.cast("double"))).otherwise(F.ceil(x.cast("double")))
            # Out of range and non-finite values have no defined result; they become the lowest value.
            fits = (F.abs(x.cast("double")) < F.lit(float(2**63))) & ~F.isnan(x)
            lowest = F.lit(str(np.iinfo(b).min)).cast("decimal(38,0)")
            return wrapped(F.when(fits, whole.cast("decimal(38,0)")).otherwise(lowest), b)
        return x.cast(spark_type(b)) if np.can_cast(a, b, "safe") else wrapped(x, b)
    return rounded(x.cast("double"), b)


def rounded(x: Column, dtype) -> Column:
    """A double column in the precision of a float dtype (float16 is kept as float)."""
    return x.cast("float") if np.dtype(dtype).itemsize <= 4 else x.cast("double")
