"""The restricted arithmetic expression language, compiled to Columns.

Numbers up to 1e12, column names, + - * / ** % and unary signs, and log, log1p, sqrt, abs.
Division by zero and results outside the reals give NULL; ``%`` takes the divisor's sign.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS, MAX_NODES, MAX_NUMBER, MAX_POWER = 1000, 100, 1e12, 10
CALLS: dict[str, Callable[[Column], Column]] = {
    "log": lambda x: F.when(x > 0, F.ln(x)),
    "log1p": lambda x: F.when(x > -1, F.log1p(x)),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "abs": F.abs,
}


def compile_expression(text: str, columns: set[str] | dict[str, Column]) -> Column:
    """A double Column for ``text`` over column names, or over names bound to Columns."""
    if not text or len(text) > MAX_CHARS:
        raise ValueError(f"an expression has 1 to {MAX_CHARS} characters")
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text!r}") from e
    if sum(1 for _ in ast.walk(tree)) > MAX_NODES:
        raise ValueError(f"an expression has at most {MAX_NODES} parts")
    names = columns if isinstance(columns, dict) else {c: F.col(f"`{c}`") for c in columns}
    return _emit(tree.body, names)


def _emit(node: ast.expr, columns: dict[str, Column]) -> Column:
    match node:
        case ast.Constant(value=bool()):
            raise ValueError("truth values are not numbers")
        case ast.Constant(value=int() | float() as v) if abs(v) <= MAX_NUMBER:
            return F.lit(float(v))
        case ast.Name(id=name) if name in columns:
            return columns[name].cast("double")
        case ast.Name(id=name):
            raise ValueError(f"unknown column {name!r}")
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_emit(x, columns)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return _emit(x, columns)
        case ast.BinOp(left=a, op=ast.Pow(), right=b):
            power = _number(b)
            if abs(power) > MAX_POWER:
                raise ValueError(f"exponents lie within {MAX_POWER}")
            v = F.pow(_emit(a, columns), F.lit(power))
            return F.when(~F.isnan(v), v)
        case ast.BinOp(left=a, op=op, right=b):
            x, y = _emit(a, columns), _emit(b, columns)
            match op:
                case ast.Add():
                    return x + y
                case ast.Sub():
                    return x - y
                case ast.Mult():
                    return x * y
                case ast.Div():
                    return F.try_divide(x, y)
                case ast.Mod():
                    return x - y * F.floor(F.try_divide(x, y))
        case ast.Call(func=ast.Name(id=name), args=[x], keywords=[]) if name in CALLS:
            return CALLS[name](_emit(x, columns))
    raise ValueError(f"{ast.dump(node)[:60]} is not part of the expression language")


def _number(node: ast.expr) -> float:
    match node:
        case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
            return float(v)
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_number(x)
    raise ValueError("an exponent is a plain number")
