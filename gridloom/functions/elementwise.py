"""NumPy's elementwise functions as native Spark columns.

Spark in ANSI mode raises where NumPy gives inf, NaN or a wrapped integer, and it orders NaN as
equal to itself and above all; every expression here is guarded so that the NumPy result
comes out, within whole-stage code generation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.dtypes import converted, rounded, spark_type, wrapped

NAN, INF = float("nan"), float("inf")


def _nan(*xs: Column) -> Column:
    out = F.isnan(xs[0])
    for x in xs[1:]:
        out = out | F.isnan(x)
    return out


def _inf(x: Column) -> Column:
    return F.abs(x) == INF


def _minus_zero(x: Column) -> Column:
    return x.cast("string") == "-0.0"


def divide(a: Column, b: Column) -> Column:
    zero = F.when((a == 0) | F.isnan(a), NAN).when((a > 0) == _minus_zero(b), -INF).when(a.isNotNull(), INF)  # null: null
    return F.when(b == 0, zero).otherwise(a / b)


def floor_divide(a: Column, b: Column) -> Column:
    below = F.when((a == 0) | ((a > 0) == (b > 0)), F.lit(0.0)).otherwise(F.lit(-1.0))
    # Beyond 2**53 a quotient is whole already, and floor's bigint result could overflow.
    q = F.when(b == 0, F.lit(1.0)).otherwise(b)
    exact = a / q
    whole = F.when(F.abs(exact) < F.lit(float(2**53)), F.floor(exact).cast("double")).otherwise(exact)
    return F.when(b == 0, divide(a, b)).when(_nan(a, b) | _inf(a), NAN).when(_inf(b), below).otherwise(whole)


def remainder(a: Column, b: Column) -> Column:
    kept = F.when((a == 0) | ((a > 0) == (b > 0)), a).otherwise(b)
    q = F.when(b == 0, F.lit(1.0)).otherwise(b)
    r = a % q
    return F.when((b == 0) | _nan(a, b) | _inf(a), NAN).when(_inf(b), kept).otherwise(F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r))


def power(a: Column, b: Column) -> Column:
    return F.when((a == 1) | (b == 0), F.lit(1.0)).when((F.abs(a) == 1) & _inf(b), F.lit(1.0)).otherwise(F.pow(a, b))


def log(a: Column) -> Column:
    return F.when(F.isnan(a) | (a < 0), NAN).when(a == 0, -INF).otherwise(F.ln(a))


def log1p(a: Column) -> Column:
    return F.when(F.isnan(a) | (a < -1), NAN).when(a == -1, -INF).otherwise(F.log1p(a))


FLOATS = {
    "absolute": F.abs, "negative": lambda a: -a, "positive": lambda a: a,
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b,
    "divide": divide, "floor_divide": floor_divide, "remainder": remainder, "power": power,
    "maximum": lambda a, b: F.greatest(a, b), "minimum": lambda a, b: F.when(_nan(a, b), NAN).otherwise(F.least(a, b)),
    "sqrt": F.sqrt, "exp": F.exp, "expm1": F.expm1, "log": log, "log1p": log1p,
    "sin": F.sin, "cos": F.cos, "tan": F.tan,
}
COMPARISONS = {
    "equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b, "greater": lambda a, b: a > b,
    "greater_equal": lambda a, b: a >= b, "less": lambda a, b: a < b, "less_equal": lambda a, b: a <= b,
}
TESTS = {
    "isnan": F.isnan, "isinf": _inf, "isfinite": lambda a: ~F.isnan(a) & (F.abs(a) < INF),
}
#: The functions that expressions may use.
NAMES = (*FLOATS, *COMPARISONS, *TESTS)


def _floor_quotient(a: Column, b: Column) -> Column:
    safe = F.when(b == 0, F.lit(1)).otherwise(b)
    r = a % safe
    whole = ((a - r) / safe).cast("decimal(38,0)")
    return F.when(b == 0, F.lit(0)).otherwise(whole - F.when((r != 0) & ((r < 0) != (safe < 0)), 1).otherwise(0))


def _floor_remainder(a: Column, b: Column) -> Column:
    safe = F.when(b == 0, F.lit(1)).otherwise(b)
    r = a % safe
    return F.when(b == 0, F.lit(0)).otherwise(F.when((r != 0) & ((r < 0) != (safe < 0)), r + safe).otherwise(r))


def _integer(name: str, xs: list[Column], dtype: np.dtype) -> Column:
    """Integer results, computed in DECIMAL or BIGINT wide enough and wrapped."""
    wide = "decimal(20,0)" if dtype.itemsize == 8 else "bigint"
    xs = [x.cast(wide) for x in xs]
    if name == "floor_divide":
        if dtype.itemsize < 8:
            a, b = xs
            safe = F.when(b == 0, F.lit(1)).otherwise(b)
            r = a % safe
            q = F.floor((a - r).cast("double") / safe.cast("double")).cast("bigint")
            return wrapped(F.when(b == 0, F.lit(0)).otherwise(q - F.when((r != 0) & ((r < 0) != (safe < 0)), 1).otherwise(0)), dtype)
        return wrapped(_floor_quotient(*xs), dtype)
    if name == "remainder":
        return wrapped(_floor_remainder(*xs), dtype)
    if name == "power":
        # By squaring, wrapped at each step; NumPy refuses negative exponents of integers.
        base, exponent = xs
        out, square = F.lit(1), base
        for bit in range(6):
            out = F.when((F.floor(exponent / (1 << bit)) % 2) == 1, wrapped(out.cast(wide) * square.cast(wide), dtype).cast(wide)).otherwise(out.cast(wide))
            square = wrapped(square.cast(wide) * square.cast(wide), dtype)
        return wrapped(F.when(exponent < 0, F.raise_error(F.lit("Integers to negative integer powers are not allowed.")).cast(wide)).otherwise(out), dtype)
    if name == "maximum":
        return F.greatest(*xs).cast(wide) if dtype.itemsize < 8 else F.greatest(*xs)
    if name == "minimum":
        return F.least(*xs)
    return wrapped(FLOATS[name](*xs), dtype)


def apply(name: str, xs: list[Column], kinds: list[np.dtype], loop: list[np.dtype], out: np.dtype) -> Column:
    """The function on columns of dtypes ``kinds``; ``loop``: NumPy's operand dtypes for it."""
    xs = [converted(x, k, t) for x, k, t in zip(xs, kinds, loop)]
    floats = loop[0].kind == "f"
    if name in TESTS:
        return TESTS[name](xs[0].cast("double")) if floats else F.lit(name == "isfinite") & xs[0].isNotNull()
    if name in COMPARISONS:
        made = COMPARISONS[name](*xs)
        if not floats:
            return made
        return made | _nan(*xs) if name == "not_equal" else made & ~_nan(*xs)
    if out.kind == "b":
        a, b = [x.cast("int") for x in xs] if len(xs) > 1 else (xs[0].cast("int"), F.lit(0))
        return {"add": a + b > 0, "maximum": F.greatest(a, b) > 0, "multiply": a * b > 0, "minimum": F.least(a, b) > 0, "absolute": a > 0}[name]
    if not floats:
        return _integer(name, xs, out).cast(spark_type(out)) if out.kind in "iu" else FLOATS[name](*[x.cast("double") for x in xs])
    if name in ("add", "subtract", "multiply", "absolute", "negative", "positive", "maximum", "minimum") and out.itemsize == 4:
        return FLOATS[name](*xs).cast("float")
    return rounded(FLOATS[name](*[x.cast("double") for x in xs]), out)
