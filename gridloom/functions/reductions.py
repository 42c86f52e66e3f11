"""Reductions as Spark aggregates that propagate NaN as NumPy does."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.dtypes import rounded, spark_type, wrapped

NAMES = ("sum", "mean", "min", "max", "median", "percentile", "quantile")
#: Those that a global scalar stage may hold (they merge from partial results).
STAGED = ("sum", "mean", "min", "max")
NAN = float("nan")
# NumPy's names of quantile methods; (alpha, beta) of those that interpolate at n*q + alpha + q*(1 - alpha - beta) - 1.
PLACES = {"interpolated_inverted_cdf": (0.0, 1.0), "hazen": (0.5, 0.5), "weibull": (0.0, 0.0), "median_unbiased": (1 / 3, 1 / 3), "normal_unbiased": (3 / 8, 3 / 8)}
METHODS = ("linear", "inverted_cdf", "averaged_inverted_cdf", "lower", "higher", "nearest", "midpoint", *PLACES)


def at_rank(x: Column, q: float, method: str) -> Column:
    """A quantile that the built-in aggregate doesn't have: two neighbours of the sorted group, weighted. A group
    is as long as the reduced axes."""
    values, n, half = F.sort_array(F.collect_list(x)), F.count(x).cast("double"), F.lit(0.5)
    straight, cdf = (n - 1) * F.lit(q), n * F.lit(q)
    if method in PLACES:
        a, b = PLACES[method]
        low = F.floor(at := cdf + F.lit(a + q * (1 - a - b) - 1))
        share = at - low
    elif method == "inverted_cdf":
        low, share = F.ceil(cdf) - 1, F.lit(0.0)
    elif method == "averaged_inverted_cdf":
        low = F.floor(cdf - 1)
        share = F.when(cdf - 1 == low, half).otherwise(1.0)
    else:
        low = F.floor(straight)
        rest = straight - low
        share = {"lower": F.lit(0.0), "higher": F.when(rest > 0, 1.0).otherwise(0.0), "midpoint": F.when(rest > 0, half).otherwise(0.0), "nearest": F.when((rest > half) | ((rest == half) & (low % 2 == 1)), 1.0).otherwise(0.0)}[method]
    place = lambda k: F.element_at(values, F.greatest(F.lit(1), F.least(k + 1, F.count(x))).cast("int")).cast("double")
    first, second = place(low), place(low + 1)
    return F.when((share == 0) | (first == second), first).when(share == 1, second).otherwise(first + (second - first) * share)


def aggregate(name: str, x: Column, kind: np.dtype, out: np.dtype, parameters: dict) -> Column:
    """The aggregate of a column of dtype ``kind``, in dtype ``out``."""
    if kind.kind == "b":
        x = x.cast("int")
    nan = F.bool_or(F.isnan(x)) if kind.kind == "f" else F.lit(False)
    if name == "sum":
        if out.kind == "f":
            return rounded(F.sum(x.cast("double")), out)
        return wrapped(F.sum(x.cast("decimal(20,0)")), out)
    if name == "mean":
        return rounded(F.avg(x.cast("double")), out)
    if name == "max":
        return F.max(x).cast(spark_type(out)) if kind.kind != "b" else F.max(x) > 0
    if name == "min":
        low = F.when(nan, NAN).otherwise(F.min(x)) if kind.kind == "f" else F.min(x)
        return low.cast(spark_type(out)) if kind.kind != "b" else low > 0
    if name == "median":
        return rounded(F.when(nan, NAN).otherwise(F.median(x.cast("double"))), out)
    q = parameters["q"] / 100 if name == "percentile" else parameters["q"]
    if (method := parameters.get("method", "linear")) != "linear":
        made = F.when(nan, NAN).otherwise(at_rank(x, float(q), method))
        return rounded(made, out) if out.kind == "f" else made.cast(spark_type(out))
    return rounded(F.when(nan, NAN).otherwise(F.percentile(x.cast("double"), F.lit(float(q)))), out)
