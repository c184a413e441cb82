"""Fitted transformations: power families by likelihood, and quantile maps."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.position import exact_quantiles
from millrace.operators.base import OperatorError, num

GOLDEN = (5**0.5 - 1) / 2


def _powered(x, lam: float, method: str):
    if method == "box-cox":
        return F.ln(x) if abs(lam) < 1e-10 else (F.pow(x, F.lit(lam)) - 1) / lam
    up = F.log1p(x) if abs(lam) < 1e-10 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-10 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def power_transform(df: DataFrame, c: str, method: str) -> DataFrame:
    """Likelihood-best power on a grid that one aggregation evaluates and narrows, then z-scores."""
    x = num(c)
    if method == "box-cox" and df.agg(F.min(x)).first()[0] <= 0:
        raise OperatorError(f"box-cox needs positive values in {c}")
    log = F.ln(x) if method == "box-cox" else F.signum(x) * F.log1p(F.abs(x))
    lo, hi = -4.0, 4.0
    for _ in range(5):
        grid = np.linspace(lo, hi, 17)
        row = df.agg(F.count("*").alias("n"), F.sum(log).alias("s"), *(F.var_pop(_powered(x, float(g), method)).alias(f"v{i}") for i, g in enumerate(grid))).first()
        like = [-row["n"] / 2 * np.log(max(row[f"v{i}"] or 0, 1e-300)) + (g - 1) * row["s"] for i, g in enumerate(grid)]
        k = int(np.argmax(like))
        lo, hi = float(grid[max(k - 1, 0)]), float(grid[min(k + 1, 16)])
    y = _powered(x, (lo + hi) / 2, method)
    m, s = df.agg(F.avg(y), F.stddev_pop(y)).first()
    return df.withColumn(c, (y - F.lit(m)) / F.lit(s or 1.0))


def quantile_transform(df: DataFrame, c: str, n_quantiles: int, normal: bool) -> DataFrame:
    """Ranks by interpolation between at most ``n_quantiles`` exact quantiles (ties: middle)."""
    n = min(n_quantiles, df.count())
    points = np.linspace(0, 1, max(n, 2))
    q = np.array(exact_quantiles(df, {c: num(c)}, points)[c], float)
    norm = NormalDist()

    @F.pandas_udf("double")
    def rank(v):
        x = v.to_numpy(float)
        u = (np.interp(x, q, points) - np.interp(-x, -q[::-1], -points[::-1])) / 2
        if normal:
            u = np.array([norm.inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) for p in u])
        return v.__class__(u)

    return df.withColumn(c, rank(num(c)))
