"""From expressions to DataFrames of cells.

A frame is a DataFrame of axis columns and value columns. Elementwise nodes are columns of
their operand's frame; all reductions of one frame over the same axes are one aggregation;
global scalars are a one-row frame joined by broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.dtypes import converted, spark_type
from gridloom.expr import Cast, Expression, Input, Reduction, Scalar, UFunc, children, identity
from gridloom.functions import elementwise, reductions


def _frame_of(x: Expression) -> tuple:
    """Key of the frame that a node's columns stand in (without joined scalars)."""
    if isinstance(x, Input):
        return ("input",)
    if isinstance(x, Scalar):
        return ()
    if isinstance(x, Reduction):
        return ("reduce", _frame_of(x.operand), x.reduced, x.keepdims)
    keys = [k for k in map(_frame_of, children(x)) if k]
    ranked = [k for c, k in zip([c for c in children(x) if _frame_of(c)], keys) if c.axes]
    return (ranked or keys or [()])[0]


class Lowering:
    def __init__(self, cells: DataFrame, source: Input, value: str = "value"):
        self.cells, self.source, self.value = cells, source, value
        self.wanted: dict[tuple, dict[str, Reduction]] = {}

    def _collect(self, x: Expression) -> None:
        for c in children(x):
            self._collect(c)
        if isinstance(x, Reduction):
            self.wanted.setdefault(_frame_of(x), {})[identity(x)] = x

    def run(self, x: Expression) -> DataFrame:
        """Axis columns and ``value``, one row a cell (a single row for a 0-D result)."""
        self._collect(x)
        self.made: dict[tuple, DataFrame] = {}
        frame = _frame_of(x)
        if not frame:
            raise ValueError("the expression has no array")
        df = self._needed(frame, x)
        return df.select(*[F.col(f"`{a}`") for a in x.axes], self._column(x, frame).cast(spark_type(x.dtype)).alias("value"))

    def _needed(self, frame: tuple, *nodes: Expression) -> DataFrame:
        """The frame with the columns of other frames that the nodes use joined to it."""
        df = self._frame(frame)
        for other, node in {_frame_of(r): r for x in nodes for r in self._foreign(x, frame)}.items():
            names = ["r_" + i for i in self.wanted[other]]
            new = self._frame(other)
            if not node.axes:
                df = df.crossJoin(F.broadcast(new.select(*names)))  # one row
            else:
                df = df.join(new.select(*node.axes, *names), list(node.axes))
        return df

    def _foreign(self, x: Expression, frame: tuple) -> list[Reduction]:
        if isinstance(x, Reduction):
            return [] if _frame_of(x) == frame else [x]
        return [r for c in children(x) for r in self._foreign(c, frame)]

    def _frame(self, key: tuple) -> DataFrame:
        if key == ("input",):
            return self.cells
        if key not in self.made:
            members = self.wanted[key]
            first = next(iter(members.values()))
            parent = _frame_of(first.operand)
            df = self._needed(parent, *[r.operand for r in members.values()])
            kept = [a for a in first.operand.axes if a not in first.reduced]
            inputs = df.select(*[F.col(f"`{a}`") for a in kept], *[self._column(r.operand, parent).alias("x_" + i) for i, r in members.items()])
            sums = [reductions.aggregate(r.name, F.col("x_" + i), r.operand.dtype, r.dtype, dict(r.parameters)).alias("r_" + i) for i, r in members.items()]
            out = inputs.groupBy(*kept).agg(*sums)
            if first.keepdims:
                for a in first.reduced:
                    out = out.withColumn(a, F.lit(0).cast("bigint"))
            self.made[key] = out
        return self.made[key]

    def _column(self, x: Expression, frame: tuple) -> Column:
        if isinstance(x, Input):
            return F.col(self.value)
        if isinstance(x, Scalar):
            value = x.value.item() if hasattr(x.value, "item") else x.value
            return F.lit(value)
        if isinstance(x, Reduction):
            return F.col("r_" + identity(x))
        if isinstance(x, Cast):
            return converted(self._column(x.operand, frame), x.operand.dtype, x.dtype)
        columns, kinds = [], []
        for o, loop in zip(x.operands, x.loop):
            c = self._column(o, frame)
            if isinstance(o, Scalar):  # a literal takes the loop's dtype at once
                c = F.lit(loop.type(o.value).item()).cast(spark_type(loop)) if loop.kind != "b" else F.lit(bool(o.value))
            columns.append(c)
            kinds.append(loop if isinstance(o, Scalar) else o.dtype)
        return elementwise.apply(x.name, columns, kinds, list(x.loop), x.dtype)
