"""Operator registry: ports, parameter schemas and validation.

An operator is a function of its input DataFrames and its parameters. Every row-level frame
carries ``RID``, a unique, order-preserving row id that the scan assigns; every rule that reads
"position" or "first" orders by it last.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.position import banded, own_rows

RID = "__rid"


class OperatorError(ValueError):
    """Wrong parameters or inputs; the message says what to change."""


@dataclass(frozen=True)
class Port:
    name: str
    type: str
    required: bool = True
    accepts: tuple[str, ...] = ()

    def takes(self, kind: str) -> bool:
        return kind == self.type or kind in self.accepts


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable[..., Any]
    inputs: tuple[Port, ...]
    outputs: tuple[Port, ...]
    params: dict[str, inspect.Parameter]
    choices: dict[str, tuple] = field(default_factory=dict)
    doc: str = ""

    @property
    def category(self) -> str:
        return self.name.partition(".")[0]

    def check(self, given: dict[str, Any]) -> dict[str, Any]:
        """Parameters with defaults; unknown, missing or out-of-range ones are errors."""
        if extra := set(given) - set(self.params):
            raise OperatorError(f"{self.name} has no parameter {sorted(extra)}")
        out = {}
        for name, p in self.params.items():
            if name in given:
                out[name] = given[name]
            elif p.default is inspect.Parameter.empty:
                raise OperatorError(f"{self.name} needs {name}")
            else:
                out[name] = p.default
            if name in self.choices and out[name] not in self.choices[name]:
                raise OperatorError(f"{self.name}: {name} is one of {list(self.choices[name])}")
        return out

    def __call__(self, *frames, **params):
        return self.run(*frames, **self.check(params))

    def describe(self) -> dict:
        port = lambda p: {"name": p.name, "type": p.type, "required": p.required, "accepts": list(p.accepts)}
        params = {n: {"required": p.default is inspect.Parameter.empty, **({} if p.default is inspect.Parameter.empty else {"default": p.default}), **({"choices": list(self.choices[n])} if n in self.choices else {})} for n, p in self.params.items()}
        return {"name": self.name, "category": self.category, "summary": self.doc, "inputs": [*map(port, self.inputs)], "outputs": [*map(port, self.outputs)], "parameters": params}


OPERATORS: dict[str, Operator] = {}


def _ports(text: str, optional: bool) -> tuple[Port, ...]:
    """"name:Type|Other name2:Type?" -> ports."""
    out = []
    for part in text.split():
        name, _, kinds = part.partition(":")
        first, *more = kinds.rstrip("?").split("|")
        out.append(Port(name, first, not kinds.endswith("?"), tuple(more)))
    return tuple(out)


def operator(name: str, inputs: str, outputs: str, **choices: tuple):
    """Register a function; its keyword-only arguments are the operator's parameters."""

    def add(fn):
        params = {n: p for n, p in inspect.signature(fn).parameters.items() if p.kind is inspect.Parameter.KEYWORD_ONLY}
        if name in OPERATORS:
            raise OperatorError(f"{name} is registered twice")
        OPERATORS[name] = Operator(name, fn, _ports(inputs, True), _ports(outputs, False), params, choices, (fn.__doc__ or "").strip().split("\n")[0])
        return fn

    return add


def numeric_columns(df: DataFrame, chosen=(), exclude=()) -> list[str]:
    """The chosen columns, checked; else every numeric one (truth values only when named)."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    number = {"byte", "short", "integer", "long", "float", "double", "decimal"}
    if chosen:
        for c in chosen:
            if c not in kinds:
                raise OperatorError(f"there is no column {c!r}")
            if kinds[c].partition("(")[0] not in number | {"boolean"}:
                raise OperatorError(f"column {c!r} is not numeric")
        return list(chosen)
    found = [c for c, k in kinds.items() if k.partition("(")[0] in number and c != RID and c not in exclude]
    if not found:
        raise OperatorError("the table has no numeric column")
    return found


def num(c: str):
    """A numeric column as double with NaN as NULL."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def need(df: DataFrame, *columns: str | None) -> None:
    for c in columns:
        if c and c not in df.columns:
            raise OperatorError(f"there is no column {c!r}")


def guard(df: DataFrame, **rules) -> None:
    """One aggregation for all checks: each rule is (Column that must never hold, message)."""
    if not rules:
        return
    row = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, (c, _) in rules.items())).first()
    for k, (_, message) in rules.items():
        if row[k]:
            raise OperatorError(f"{message} ({row[k]} rows)")


def order_by(time_column: str | None):
    return [*([F.col(time_column).asc_nulls_last()] if time_column else []), F.col(RID)]


def in_order(df: DataFrame, group_column: str | None, time_column: str | None, back: int = 0, ahead: int = 0):
    """(rows, window, finish) for frames of at most ``back`` rows before and ``ahead`` after a row.

    Rows of a group are ordered in the group. Without groups the table is one sequence, which is
    cut into bands that overlap by the frames; ``finish`` must be called on the framed rows.
    """
    if group_column:
        return df, Window.partitionBy(group_column).orderBy(*order_by(time_column)), lambda out: out
    rows, w = banded(df, order_by(time_column), back, ahead)
    return rows, w, own_rows
