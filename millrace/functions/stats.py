"""The per-window statistics as Columns.

``PLAIN`` statistics are ordinary aggregates (partial aggregation applies). The others read the
window's values in order from one collected array, which a window bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.hof import let

zero = lambda c: F.coalesce(c, F.lit(0.0))
safe = F.try_divide


def _q(x: Column, q: float) -> Column:
    return F.percentile(x, F.lit(q))


PLAIN: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "variance": F.var_pop,
    "min": F.min,
    "max": F.max,
    "median": lambda x: _q(x, 0.5),
    "rms": lambda x: F.sqrt(F.avg(x * x)),
    "skewness": lambda x: F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(zero(F.skewness(x))),
    "kurtosis": lambda x: F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(zero(F.kurtosis(x))),
    "range": lambda x: F.max(x) - F.min(x),
    "iqr": lambda x: _q(x, 0.75) - _q(x, 0.25),
    "peak": lambda x: F.max(F.abs(x)),
    "crest_factor": lambda x: zero(safe(F.max(F.abs(x)), F.sqrt(F.avg(x * x)))),
    "count": lambda x: F.count(F.lit(1)).cast("double"),
    "distinct_count": lambda x: F.count_distinct(x).cast("double"),
    "duplicate_point_ratio": lambda x: F.lit(1.0) - F.count_distinct(x) / F.count(x),
    "std_gt_range": lambda x: (F.stddev_pop(x) > F.max(x) - F.min(x)).cast("double"),
    "variance_gt_std": lambda x: (F.var_pop(x) > F.stddev_pop(x)).cast("double"),
}


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _mean(a: Column) -> Column:
    return safe(_sum(a), F.size(a))


def _median(a: Column) -> Column:
    n = F.size(a)
    return let(F.sort_array(a), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _first_at(a: Column, v: Column) -> Column:
    return zero(safe(F.array_position(a, v) - 1, F.size(a) - 1))


def _last_at(a: Column, v: Column) -> Column:
    return zero(safe(F.size(a) - F.array_position(F.reverse(a), v), F.size(a) - 1))


def _longest(a: Column, hit: Callable[[Column], Column]) -> Column:
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, v: Column) -> Column:
        now = F.when(hit(v), s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(a, start, step, lambda s: s["best"]).cast("double")


def _half_delta(a: Column) -> Column:
    half = F.floor(F.size(a) / 2).cast("int")
    return F.when(F.size(a) < 2, 0.0).otherwise(_mean(F.slice(a, half + 1, F.size(a) - half)) - _mean(F.slice(a, F.lit(1), half)))


def _curvature(a: Column) -> Column:
    n = F.size(a)
    return F.when(n <= 2, 0.0).otherwise(safe((F.get(a, n - 1) - F.get(a, n - 2)) - (F.get(a, F.lit(1)) - F.get(a, F.lit(0))), n - 2))


def _asymmetry(a: Column) -> Column:
    jump = F.transform(F.slice(a, F.lit(1), F.size(a) - 2), lambda v, i: F.pow(F.get(a, i + 2) - v, F.lit(2.0)))
    return F.when(F.size(a) <= 2, 0.0).otherwise(_mean(jump))


def _sorted(a: Column, body: Callable[[Column], Column]) -> Column:
    return let(F.sort_array(a), body)


def _repeat_ratio(s: Column) -> Column:
    same = lambda i, j: F.coalesce(F.get(s, i) == F.get(s, j), F.lit(False))
    return F.size(F.filter(s, lambda v, i: same(i, i - 1) | same(i, i + 1))) / F.size(s)


def _repeat_sum(s: Column) -> Column:
    return _sum(F.filter(s, lambda v, i: F.coalesce(F.get(s, i - 1) == v, F.lit(False))))


def _times(a: Column, v: Column) -> Column:
    return (F.size(F.filter(a, lambda x: x == v)) > 1).cast("double")


#: name -> Column of the ordered value array
ORDERED: dict[str, Callable[[Column], Column]] = {
    "mad": lambda a: let(_median(a), lambda m: _median(F.transform(a, lambda v: F.abs(v - m)))),
    "argmax_first": lambda a: _first_at(a, F.array_max(a)),
    "argmax_last": lambda a: _last_at(a, F.array_max(a)),
    "argmin_first": lambda a: _first_at(a, F.array_min(a)),
    "argmin_last": lambda a: _last_at(a, F.array_min(a)),
    "count_above_mean": lambda a: let(_mean(a), lambda m: F.size(F.filter(a, lambda v: v > m)).cast("double")),
    "count_below_mean": lambda a: let(_mean(a), lambda m: F.size(F.filter(a, lambda v: v < m)).cast("double")),
    "longest_above_mean": lambda a: let(_mean(a), lambda m: _longest(a, lambda v: v > m)),
    "longest_below_mean": lambda a: let(_mean(a), lambda m: _longest(a, lambda v: v < m)),
    "mean_delta": _half_delta,
    "mean_abs_delta": lambda a: F.abs(_half_delta(a)),
    "mean_second_derivative": _curvature,
    "repeated_value_ratio": lambda a: _sorted(a, _repeat_ratio),
    "duplicate_sum": lambda a: _sorted(a, _repeat_sum),
    "time_reversal_asymmetry": _asymmetry,
    "max_repeated": lambda a: _times(a, F.array_max(a)),
    "min_repeated": lambda a: _times(a, F.array_min(a)),
}

STATISTICS = (
    "mean", "std", "variance", "min", "max", "median", "rms", "skewness", "kurtosis", "quantile", "range", "iqr", "mad", "peak",
    "crest_factor", "count", "distinct_count", "argmax_first", "argmax_last", "argmin_first", "argmin_last", "count_above_mean",
    "count_below_mean", "longest_above_mean", "longest_below_mean", "mean_delta", "mean_abs_delta", "mean_second_derivative",
    "duplicate_point_ratio", "repeated_value_ratio", "duplicate_sum", "time_reversal_asymmetry", "std_gt_range", "variance_gt_std",
    "max_repeated", "min_repeated",
)


def plain(name: str, x: Column, quantile: float = 0.75) -> Column | None:
    if name == "quantile":
        return _q(x, quantile)
    return PLAIN[name](x) if name in PLAIN else None
