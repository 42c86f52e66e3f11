"""Row conditions in Python's syntax as columns; what isn't Python is taken as SQL."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
_BINARY = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Div: "__truediv__", ast.Mod: "__mod__", ast.Pow: "__pow__", ast.BitAnd: "__and__", ast.BitOr: "__or__"}


def column_of(condition: str, columns: list[str]) -> Column | str:
    """``name`` in back quotes may hold any characters. Nothing is called or looked up but the given columns."""
    names: dict[str, str] = {}
    parts = condition.split("`")
    for i in range(1, len(parts), 2):
        names[f"_quoted_{i}"] = parts[i]
        parts[i] = f"_quoted_{i}"
    try:
        tree = ast.parse("".join(parts).strip(), mode="eval").body
    except SyntaxError:
        return condition  # SQL: a single "=", IS NULL, LIKE ...

    def make(x):
        match x:
            case ast.Constant():
                return x.value
            case ast.Name():
                name = names.get(x.id, x.id)
                if name not in columns:
                    raise KeyError(f"no column {name!r} among {columns}")
                return F.col(f"`{name}`")
            case ast.List() | ast.Tuple():
                return [make(v) for v in x.elts]
            case ast.BoolOp():
                made = [as_column(make(v)) for v in x.values]
                out = made[0]
                for m in made[1:]:
                    out = out & m if isinstance(x.op, ast.And) else out | m
                return out
            case ast.UnaryOp(op=ast.Not() | ast.Invert()):
                return ~as_column(make(x.operand))
            case ast.UnaryOp(op=ast.USub()):
                return -make(x.operand)
            case ast.BinOp() if type(x.op) in _BINARY:
                return getattr(as_column(make(x.left)), _BINARY[type(x.op)])(make(x.right))
            case ast.Compare():
                out, left = None, make(x.left)
                for op, right in zip(x.ops, x.comparators):
                    right = make(right)
                    if isinstance(op, (ast.In, ast.NotIn)):
                        step = as_column(left).isin(right)
                        step = ~step if isinstance(op, ast.NotIn) else step
                    elif type(op) in _COMPARE:
                        step = getattr(as_column(left), _COMPARE[type(op)])(right)
                    else:
                        raise ValueError(f"unknown comparison in {condition!r}")
                    out, left = step if out is None else out & step, right
                return out
        raise ValueError(f"{ast.unparse(x)!r} isn't part of a condition")

    return as_column(make(tree))


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
