"""Duration literals: bare seconds, or a number with one of s, m, h, d, w."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(text: str | float | int | None) -> float:
    if text is None or text == "":
        return 0.0
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhdw]?)\s*", str(text).lower())
    if not m:
        raise ValueError(f"{text!r} is not a duration such as 30m or 7d")
    return float(m[1]) * UNITS[m[2] or "s"]


def as_seconds(df: DataFrame, column: str) -> Column:
    """A time column in seconds: numbers are seconds already."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    if kind == "string":
        return F.unix_micros(F.to_timestamp(c)) / F.lit(1e6)
    return c.cast("double")
