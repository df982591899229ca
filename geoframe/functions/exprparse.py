"""Expression strings as columns, by a whitelist of syntax; nothing is evaluated as Python."""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / F.nullif(b, F.lit(0)), ast.FloorDiv: lambda a, b: F.floor(a / F.nullif(b, F.lit(0))), ast.Mod: lambda a, b: F.pmod(a, F.nullif(b, F.lit(0))), ast.Pow: lambda a, b: F.pow(a, b), ast.BitAnd: lambda a, b: _both(a, b, "&"), ast.BitOr: lambda a, b: _both(a, b, "|"), ast.BitXor: lambda a, b: a.cast("long").bitwiseXOR(b.cast("long"))}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_CALLS = {"abs": F.abs, "min": F.least, "max": F.greatest, "sqrt": F.sqrt, "log": F.ln, "log10": F.log10, "exp": F.exp, "round": F.round, "floor": F.floor, "ceil": F.ceil, "int": lambda c: c.cast("long"), "float": lambda c: c.cast("double"), "str": lambda c: c.cast("string"), "len": F.length, "lower": F.lower, "upper": F.upper, "convert": lambda c, *_: c}


class _Truth:
    """A parsed comparison, told apart from a number so that & and | mean and, or."""

    def __init__(self, column: Column):
        self.column = column


def _both(a, b, sign):
    x, y = a.cast("long"), b.cast("long")
    return x.bitwiseAND(y) if sign == "&" else x.bitwiseOR(y)


def parse(text: str, names: Mapping[str, Column] | None = None) -> Column:
    """A column for an arithmetic, comparison or boolean expression over the given names (any column's name, if none are given).
    Division by zero is null. Calls are limited to a list of functions."""

    def number(v):
        return v.column.cast("int") if isinstance(v, _Truth) else v

    def truth(v):
        return v.column if isinstance(v, _Truth) else v.cast("boolean")

    def walk(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float | str | bool | None):
            return _Truth(F.lit(node.value)) if isinstance(node.value, bool) else F.lit(node.value)
        if isinstance(node, ast.Name):
            if names is None:
                return F.col(f"`{node.id}`")
            if node.id not in names:
                raise ValueError(f"unknown name in expression: {node.id}")
            return names[node.id]
        if isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant) and isinstance(node.value, ast.Name) and node.value.id in ("f", "feat"):
            return F.col(f"`{node.slice.value}`")
        if isinstance(node, ast.UnaryOp):
            v = walk(node.operand)
            if isinstance(node.op, ast.Not | ast.Invert):
                return _Truth(~truth(v))
            return -number(v) if isinstance(node.op, ast.USub) else number(v)
        if isinstance(node, ast.BoolOp):
            parts = [truth(walk(v)) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return _Truth(out)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            a, b = walk(node.left), walk(node.right)
            if isinstance(a, _Truth) and isinstance(b, _Truth) and isinstance(node.op, ast.BitAnd | ast.BitOr | ast.BitXor):
                return _Truth(a.column & b.column if isinstance(node.op, ast.BitAnd) else a.column | b.column if isinstance(node.op, ast.BitOr) else a.column != b.column)
            return _BINARY[type(node.op)](number(a), number(b))
        if isinstance(node, ast.Compare) and all(type(op) in _COMPARE or isinstance(op, ast.In | ast.NotIn) for op in node.ops):
            out, left = None, walk(node.left)
            for op, other in zip(node.ops, node.comparators, strict=True):
                if isinstance(op, ast.In | ast.NotIn):
                    if not isinstance(other, ast.List | ast.Tuple):
                        raise ValueError("'in' takes a list")
                    one = number(left).isin([ast.literal_eval(e) for e in other.elts])
                    one, right = (one if isinstance(op, ast.In) else ~one), left
                else:
                    right = walk(other)
                    one = _COMPARE[type(op)](number(left), number(right))
                out, left = one if out is None else out & one, right
            return _Truth(out)
        if isinstance(node, ast.IfExp):
            return F.when(truth(walk(node.test)), number(walk(node.body))).otherwise(number(walk(node.orelse)))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            args = [number(walk(a)) for a in node.args]
            return _CALLS[node.func.id](*args)
        raise ValueError(f"not allowed in an expression: {ast.dump(node)[:80]}")

    out = walk(ast.parse(text, mode="eval").body)
    return out.column if isinstance(out, _Truth) else out
