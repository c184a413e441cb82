"""Explore operators: statistics, dependence, drift and tests. Results are small tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import kernels
from millrace.functions.position import exact_quantiles
from millrace.operators.base import RID, OperatorError, guard, in_order, need, num, numeric_columns, operator
from millrace.operators.feature import correlation_matrix

#: A series that one task computes on holds at most this many rows.
SERIES_ROWS = 20_000
ANY = "dataset:Dataset|FeatureDataset"


def _groups(group_column):
    return [group_column] if group_column else []


def _long(df: DataFrame, used, *keep) -> DataFrame:
    """(keep, column, value) rows without missing values."""
    parts = F.array(*(F.struct(F.lit(c).alias("column"), num(c).alias("value")) for c in used))
    return df.select(*keep, F.explode(parts).alias("__v")).select(*keep, "__v.column", "__v.value").where("value is not null")


@operator("explore.central_tendency", ANY, "statistics:Statistics", method=("mean", "median", "mode", "weighted_mean"))
def central_tendency(df: DataFrame, *, columns=(), method="mean", weight_column=None):
    """Mean, median, all modes or weighted mean of each column."""
    used = numeric_columns(df, columns, (weight_column,))
    if method == "mode":
        counts = _long(df, used).groupBy("column", "value").agg(F.count("*").alias("n"))
        top = F.max("n").over(Window.partitionBy("column"))
        return counts.withColumn("top", top).where("n = top").select("column", "value", "n")
    if method == "weighted_mean":
        need(df, weight_column)
        w = num(weight_column)
        guard(df, bad=(w.isNull() | (w < 0), "weights must be finite and not negative"))
        return _stack(df, {c: F.try_divide(F.sum(w * num(c)), F.sum(F.when(num(c).isNotNull(), w))) for c in used})
    if method == "median":
        return _table(df, {c: q[0] for c, q in _quantiles(df, used, 0.5).items()})
    return _stack(df, {c: F.avg(num(c)) for c in used})


def _quantiles(df: DataFrame, used, *points) -> dict[str, list[float | None]]:
    return exact_quantiles(df, {c: num(c) for c in used}, points)


def _table(df: DataFrame, values: dict) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, None if v is None else float(v)) for c, v in values.items()], "column string, value double")


def _stack(df: DataFrame, values: dict, name: str = "value") -> DataFrame:
    """One aggregation, one row per column."""
    one = df.agg(*(v.alias(f"c{i}") for i, v in enumerate(values.values())))
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias(name)) for i, c in enumerate(values)))
    return one.select(F.explode(parts).alias("x")).select("x.*")


@operator("explore.dispersion", ANY, "statistics:Statistics", method=("std", "variance", "range", "iqr", "mad", "cv"))
def dispersion(df: DataFrame, *, columns=(), method="std"):
    """Sample spread measures of each column."""
    used = numeric_columns(df, columns)
    if method == "mad":
        mid = _quantiles(df, used, 0.5)
        away = exact_quantiles(df, {c: F.abs(num(c) - F.lit(mid[c][0])) for c in used}, (0.5,))
        return _table(df, {c: q[0] for c, q in away.items()})
    if method == "iqr":
        return _table(df, {c: None if a is None else b - a for c, (a, b) in _quantiles(df, used, 0.25, 0.75).items()})
    fn = {
        "std": F.stddev_samp, "variance": F.var_samp, "range": lambda x: F.max(x) - F.min(x),
        "cv": lambda x: F.try_divide(F.stddev_samp(x), F.avg(x)),
    }[method]
    return _stack(df, {c: fn(num(c)) for c in used})


def ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average ranks over the whole column, from the (value, count) histogram."""
    counts = df.where(num(column).isNotNull()).groupBy(num(column).alias("__v")).agg(F.count("*").alias("__n"))
    upto = running_total(counts, "__v", "__n")
    return df.join(upto.select("__v", (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out)), num(column) == F.col("__v"), "left").drop("__v")


def running_total(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Adds ``__upto``, the running sum in key order: range-partitioned sums, then local windows."""
    parts = max(2, counts.sparkSession.sparkContext.defaultParallelism)
    placed = counts.repartitionByRange(parts, key).withColumn("__p", F.spark_partition_id())
    from millrace.plans.durable import materialize

    placed = materialize(placed, "ranged")
    base = placed.groupBy("__p").agg(F.sum(n).alias("__s"))
    base = base.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__base"))  # one row per partition
    local = F.sum(n).over(Window.partitionBy("__p").orderBy(key))
    return placed.join(F.broadcast(base), "__p").withColumn("__upto", F.col("__base") + local).drop("__p", "__base")


@operator("explore.correlation", ANY, "matrix:CorrelationMatrix", method=("pearson", "spearman", "kendall"))
def correlation(df: DataFrame, *, columns=(), method="pearson"):
    """Pairwise-complete correlations, one row per pair."""
    used = numeric_columns(df, columns)
    spark = df.sparkSession
    if method == "kendall":
        rows = [(a, b, 1.0 if a == b else kendall(df, a, b)) for a in used for b in used if a <= b]
        rows += [(b, a, v) for a, b, v in rows if a != b]
        return spark.createDataFrame(rows, "column_a string, column_b string, value double")
    if method == "pearson":
        m = correlation_matrix(df, used)
        return spark.createDataFrame([(a, b, m[a, b]) for a in used for b in used], "column_a string, column_b string, value double")
    out = []
    for i, a in enumerate(used):  # ranks over the rows where both are present
        for b in used[i:]:
            d = df.where(num(a).isNotNull() & num(b).isNotNull()).select(num(a).alias("x"), num(b).alias("y"))
            d = ranks(ranks(d, "x", "rx"), "y", "ry")
            v = correlation_matrix(d, ["rx", "ry"])["rx", "ry"]
            out += [(a, b, v)] + ([(b, a, v)] if a != b else [])
    return spark.createDataFrame(out, "column_a string, column_b string, value double")


#: Kendall compares pairs of distinct (x, y) cells; above this many it is refused.
KENDALL_CELLS = 20_000


def kendall(df: DataFrame, a: str, b: str) -> float | None:
    """Tau-b over distinct (x, y) cells with their counts, in blocks of numpy comparisons."""
    cells = df.select(num(a).alias("x"), num(b).alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("n"))
    if (k := cells.count()) > KENDALL_CELLS:
        raise OperatorError(f"{k} distinct pairs are too many for Kendall's tau")
    t = cells.toPandas()
    x, y, n = t["x"].to_numpy(), t["y"].to_numpy(), t["n"].to_numpy(float)
    total = 0.0
    for at in range(0, len(x), 512):
        s = np.sign(x[at : at + 512, None] - x) * np.sign(y[at : at + 512, None] - y)
        total += float((s * n).sum(axis=1) @ n[at : at + 512])
    m = n.sum()
    ties = lambda v: float(sum(c * (c - 1) for c in np.bincount(np.unique(v, return_inverse=True)[1], n)))
    pairs = m * (m - 1)
    bottom = math.sqrt((pairs - ties(x)) * (pairs - ties(y)))
    return total / bottom if bottom else None


def histogram_counts(df: DataFrame, column: str, lo, hi, bins: int) -> list[int]:
    """Counts of equal-width bins; the last one is closed."""
    if lo is None:
        return [0] * bins
    width = (hi - lo) / bins if hi > lo else 1.0
    slot = F.least(F.floor((num(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    got = {int(r["b"]): r["n"] for r in df.where(num(column).isNotNull()).groupBy(slot.alias("b")).agg(F.count("*").alias("n")).collect()}
    return [got.get(i, 0) for i in range(bins)]


@operator("explore.distribution", ANY, "statistics:Statistics")
def distribution(df: DataFrame, *, columns=(), bins=20):
    """Count, missing rate, moments, quantiles and an equal-width histogram of each column."""
    used = numeric_columns(df, columns)
    zero = lambda x, f: F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(f(x))
    cuts, parts = _quantiles(df, used, 0.05, 0.5, 0.95), []
    for i, c in enumerate(used):
        x = num(c)
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("count"), (1 - F.count(x) / F.count("*")).alias("missing_rate"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
            zero(x, F.skewness).alias("skewness"), zero(x, F.kurtosis).alias("kurtosis"), F.min(x).alias("min"), F.max(x).alias("max"),
            *(F.lit(v).cast("double").alias(n) for v, n in zip(cuts[c], ("q05", "median", "q95"))),
        ).alias(f"s{i}"))
    one = df.agg(*parts)
    out = one.select(F.explode(F.array(*(F.col(f"s{i}") for i in range(len(used))))).alias("x")).select("x.*")
    ends = {r["column"]: (r["min"], r["max"]) for r in out.select("column", "min", "max").collect()}
    hist = df.sparkSession.createDataFrame([(c, histogram_counts(df, c, *ends[c], bins)) for c in used], "column string, histogram array<long>")
    return out.join(F.broadcast(hist), "column")


def series_products(df: DataFrame, columns, max_lag: int, group_column=None, time_column=None) -> DataFrame:
    """(group, column, lag, acf, n): one window stage with all lags, then sums."""
    g = _groups(group_column)
    out = None
    for c in columns:
        mean = df.groupBy(*g).agg(F.avg(num(c)).alias("__m"), F.count(num(c)).alias("n"))
        d = df.select(*g, RID, *([time_column] if time_column else []), num(c).alias("__x")).where("__x is not null")
        if g:
            d = d.join(mean.withColumnRenamed(g[0], "__g"), d[g[0]].eqNullSafe(F.col("__g"))).drop("__g")
        else:
            m = mean.first()
            d = d.withColumn("__m", F.lit(m["__m"])).withColumn("n", F.lit(m["n"]))
        d = d.withColumn("__d", F.col("__x") - F.col("__m"))
        d, w, finish = in_order(d, group_column, time_column, max_lag)
        d = finish(d.withColumns({f"l{k}": F.lag("__d", k).over(w) for k in range(1, max_lag + 1)}))
        sums = d.groupBy(*g, "n").agg(F.sum(F.col("__d") * F.col("__d")).alias("s0"), *(F.sum(F.col("__d") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)))
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.coalesce(F.try_divide(F.coalesce(F.col(f"s{k}"), F.lit(0.0)), F.col("s0")), F.lit(0.0)).alias("acf")) for k in range(max_lag + 1))))
        part = sums.select(*g, F.lit(c).alias("column"), "n", each.alias("x")).select(*g, "column", "n", "x.*").where("lag < n")
        out = part if out is None else out.union(part)
    return out


@operator("explore.periodicity", "dataset:Dataset", "statistics:Statistics")
def periodicity(df: DataFrame, *, columns=(), max_lag=100, sampling_rate=None):
    """The lag of the largest autocorrelation and its period."""
    used = numeric_columns(df, columns)
    acf = series_products(df, used, max_lag).where("lag > 0")
    best = acf.groupBy("column").agg(F.max_by("lag", F.struct(F.col("acf"), -F.col("lag"))).alias("lag"), F.max("acf").alias("strength"))
    rate = F.lit(float(sampling_rate) if sampling_rate else None).cast("double")
    return best.withColumns({"period_seconds": F.col("lag") / rate, "frequency": rate / F.col("lag")})


@operator("explore.acf", ANY, "statistics:Statistics")
def acf(df: DataFrame, *, columns=(), max_lag=50, alpha=0.05, group_column=None):
    """Autocorrelations with the white-noise band per group and column."""
    need(df, group_column)
    z = NormalDist().inv_cdf(1 - alpha / 2)
    out = series_products(df, numeric_columns(df, columns, (group_column,)), max_lag, group_column)
    band = F.lit(z) / F.sqrt("n")
    return out.withColumns({"band": band, "significant": (F.col("lag") > 0) & (F.abs("acf") > band)})


def _shares(df: DataFrame, c: str, edges: list[float]) -> np.ndarray:
    inner = edges[1:-1]
    slot = sum(((num(c) >= F.lit(e)).cast("int") for e in inner), F.lit(0))
    got = {r["b"]: r["n"] for r in df.where(num(c).isNotNull()).groupBy(slot.alias("b")).agg(F.count("*").alias("n")).collect()}
    n = np.array([got.get(i, 0) for i in range(len(edges) - 1)], float)
    return n / max(n.sum(), 1)


def kolmogorov(d: float, n: float) -> float:
    """Asymptotic two-sided p value."""
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


@operator("explore.concept_drift", "reference:Dataset current:Dataset", "statistics:Statistics")
def concept_drift(reference: DataFrame, current: DataFrame, *, columns=(), bins=10, psi_threshold=0.2, alpha=0.05):
    """Population stability index on reference quantile bins and a two-sample Kolmogorov-Smirnov test."""
    from millrace.operators.data import bin_edges

    rows = []
    for c in numeric_columns(reference, columns):
        need(current, c)
        edges = bin_edges(reference.where(num(c).isNotNull()), c, bins, "quantile")
        p, q = (np.clip(_shares(d, c, edges), 1e-6, None) for d in (reference, current))
        psi = float(((q - p) * np.log(q / p)).sum())
        d, n, m = ks_distance(reference, current, c)
        pv = kolmogorov(d, n * m / (n + m)) if n and m else 1.0
        rows.append((c, psi, d, pv, bool(psi >= psi_threshold or pv < alpha)))
    return reference.sparkSession.createDataFrame(rows, "column string, psi double, ks double, p_value double, drift boolean")


def ks_distance(a: DataFrame, b: DataFrame, c: str) -> tuple[float, int, int]:
    """Largest distance of the two distribution functions, by running counts over distinct values."""
    both = a.select(num(c).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(num(c).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))).dropna()
    t = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n, m = t.agg(F.sum("a"), F.sum("b")).first()
    if not n or not m:
        return 0.0, n or 0, m or 0
    t = t.withColumn("gap", F.col("a") / F.lit(n) - F.col("b") / F.lit(m))
    return float(running_total(t, "v", "gap").agg(F.max(F.abs("__upto"))).first()[0]), n, m


@operator("explore.cross_relation", "dataset:Dataset", "matrix:CorrelationMatrix", method=("cross_correlation", "cross_covariance"))
def cross_relation(df: DataFrame, *, first_column, second_column, method="cross_correlation", max_lag=20, normalize=True):
    """Covariance or correlation of the overlapping parts at every lag."""
    need(df, first_column, second_column)
    d = df.select(RID, num(first_column).alias("x"), num(second_column).alias("y")).dropna()
    d, w, finish = in_order(d, None, None, max_lag, max_lag)
    shifted = finish(d.withColumns({f"y{i}": (F.lag("y", k) if k >= 0 else F.lead("y", -k)).over(w) for i, k in enumerate(range(-max_lag, max_lag + 1))}))
    aggs = []
    for i, k in enumerate(range(-max_lag, max_lag + 1)):
        x, y = F.when(F.col(f"y{i}").isNotNull(), F.col("x")), F.col(f"y{i}")
        v = F.covar_pop(x, y)
        if method == "cross_correlation" and normalize:
            s = F.stddev_pop(x) * F.stddev_pop(y)
            v = F.coalesce(F.try_divide(v, F.when(s > 0, s)), F.lit(0.0))
        aggs.append(F.struct(F.lit(k).alias("lag"), v.alias("value"), F.count(y).alias("sample_count")).alias(f"s{i}"))
    one = shifted.agg(*aggs)
    return one.select(F.explode(F.array(*(F.col(f"s{i}") for i in range(2 * max_lag + 1)))).alias("x")).select("x.*").where("sample_count > 1")


@operator("explore.anomaly", ANY, "prediction:Prediction", method=("boxplot", "dynamic_threshold", "hyperbolic_smoothing"))
def anomaly(df: DataFrame, *, columns=(), method="boxplot", window=20, threshold=3.0, iqr_multiplier=1.5, group_column=None, time_column=None):
    """Row-aligned centre, limits, score and flag per column, and whether any column is flagged."""
    need(df, group_column, time_column)
    used = numeric_columns(df, columns, (group_column, time_column))
    g = _groups(group_column)
    out = df.select(RID, *g, *([time_column] if time_column and time_column not in g else []), *(num(c).alias(f"{c}__value") for c in used))
    new: dict = {}
    finish = lambda rows: rows
    if method == "boxplot":
        names = [(f"__a{i}", f"__m{i}", f"__b{i}") for i in range(len(used))]
        if g:
            q = df.groupBy(*g).agg(*(F.percentile(num(c), F.lit(p)).alias(n) for c, ns in zip(used, names) for p, n in zip((0.25, 0.5, 0.75), ns)))
            q = q.withColumnRenamed(g[0], "__g")
            out = out.join(q, out[g[0]].eqNullSafe(q["__g"])).drop("__g")
        else:
            cuts = _quantiles(df, used, 0.25, 0.5, 0.75)
            out = out.withColumns({n: F.lit(v).cast("double") for c, ns in zip(used, names) for v, n in zip(cuts[c], ns)})
        for i, c in enumerate(used):
            a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
            new[c] = (F.col(f"__m{i}"), a - iqr_multiplier * (b - a), b + iqr_multiplier * (b - a), b - a)
    else:
        spread = df.agg(*(F.stddev_pop(num(c)).alias(f"s{i}") for i, c in enumerate(used))).first()
        out, w, finish = in_order(out, group_column, time_column, window - 1)
        f = w.rowsBetween(-(window - 1), 0)
        for i, c in enumerate(used):
            whole = F.lit((spread[f"s{i}"] or 0.0) or 1.0)
            x = F.col(f"{c}__value")
            if method == "dynamic_threshold":
                centre = F.percentile(x, F.lit(0.5)).over(f)
                out = out.withColumn(f"__m{i}", centre)
                seen = F.collect_list(x).over(f)
                out = out.withColumn(f"__s{i}", seen)
                mid = F.col(f"__m{i}")
                dev = F.sort_array(F.transform(F.col(f"__s{i}"), lambda v: F.abs(v - mid)))  # noqa: B023
                out = out.withColumn(f"__s{i}", dev)
                n = F.size(f"__s{i}")
                mad = (F.get(F.col(f"__s{i}"), F.floor((n - 1) / 2).cast("int")) + F.get(F.col(f"__s{i}"), F.floor(n / 2).cast("int"))) / 2 * 1.4826
                scale = F.when(mad > 0, mad).otherwise(whole)
                m = F.col(f"__m{i}")
            else:
                mean = F.avg(x).over(f)
                m = mean + whole * F.tanh((x - mean) / whole)
                scale = whole
            new[c] = (m, m - threshold * scale, m + threshold * scale, scale)
    flags = []
    for c, (m, lo, hi, scale) in new.items():
        x = F.col(f"{c}__value")
        out = out.withColumns({f"{c}__center": m, f"{c}__lower": lo, f"{c}__upper": hi, f"{c}__score": F.coalesce(F.try_divide(F.abs(x - m), scale), F.lit(0.0)), f"{c}__is_anomaly": F.coalesce((x < lo) | (x > hi), F.lit(False))})
        flags.append(F.col(f"{c}__is_anomaly"))
    any_ = flags[0]
    for x in flags[1:]:
        any_ = any_ | x
    names = [f"{c}__{k}" for c in used for k in ("value", "center", "lower", "upper", "score", "is_anomaly")]
    return finish(out.withColumn("is_anomaly", any_)).select(RID, *names, "is_anomaly")


def per_series(df: DataFrame, columns: list[str], group_column, time_column, fn, schema: str) -> DataFrame:
    """``fn(arrays)`` on each group's ordered columns; a group is one task's (bounded) series."""
    g = _groups(group_column)
    d = df.select((F.coalesce(F.col(g[0]).cast("string"), F.lit("<missing>")) if g else F.lit("all")).alias("series"), F.struct(*([F.col(time_column)] if time_column else []), F.col(RID)).alias("__o"), *(num(c).alias(c) for c in columns))
    largest = d.groupBy("series").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > SERIES_ROWS:
        raise OperatorError(f"a series of {largest} rows is longer than {SERIES_ROWS}; resample or group it")

    def run(key, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("__o", key=lambda s: s.map(lambda v: tuple(v.values()) if isinstance(v, dict) else tuple(v)))
        rows = fn(*(t[c].to_numpy(float) for c in columns))
        return pd.DataFrame([{"series": key[0], **r} for r in (rows if isinstance(rows, list) else [rows])])

    return d.groupBy("series").applyInPandas(run, f"series string, {schema}")


@operator("explore.peaks", ANY, "statistics:Statistics")
def peaks(df: DataFrame, *, columns=(), prominence=0.0, distance=1, group_column=None):
    """Number of peaks, their mean height and spacing per group and column."""
    need(df, group_column)
    out = None
    for c in numeric_columns(df, columns, (group_column,)):

        def row(x, c=c):
            p = kernels.find_peaks(x[~np.isnan(x)], prominence, distance)
            v = x[~np.isnan(x)][p]
            return {"column": c, "peaks": len(p), "mean_height": float(v.mean()) if len(p) else None, "mean_spacing": float(np.diff(p).mean()) if len(p) > 1 else None}

        part = per_series(df, [c], group_column, None, row, "column string, peaks long, mean_height double, mean_spacing double")
        out = part if out is None else out.union(part)
    return out


@operator("explore.normality", ANY, "statistics:Statistics", method=("normaltest", "shapiro"))
def normality(df: DataFrame, *, columns=(), method="normaltest", alpha=0.05):
    """D'Agostino-Pearson test from moments, or Shapiro-Wilk on at most 5000 values."""
    rows = []
    for c in numeric_columns(df, columns):
        x = num(c)
        n, s, k, lo, hi = df.agg(F.count(x), F.skewness(x), F.kurtosis(x), F.min(x), F.max(x)).first()
        if method == "shapiro":
            if not 3 <= n <= 5000:
                raise OperatorError("Shapiro-Wilk takes 3 to 5000 values")
            stat, p = shapiro(np.sort(df.select(x.alias("x")).dropna().toPandas()["x"].to_numpy(float)))
        else:
            if n < 8:
                raise OperatorError("the test needs 8 values")
            stat, p = k_squared(n, s or 0.0, k or 0.0) if hi > lo else (float("nan"), float("nan"))
        rows.append((c, n, float(s or 0.0), float(k or 0.0), float(stat), float(p), bool(p >= alpha)))
    return df.sparkSession.createDataFrame(rows, "column string, n long, skewness double, kurtosis double, statistic double, p_value double, normal boolean")


def k_squared(n: int, skew: float, kurt: float) -> tuple[float, float]:
    """Omnibus statistic of the transformed skewness and kurtosis, chi-square with two degrees."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(w2) / 2)
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt + 3 - e) / math.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    t = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(t) ** (1 / 3), t)) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, math.exp(-k2 / 2)


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """Royston's approximation for sorted values."""
    n = len(x)
    if x[0] == x[-1]:
        return 1.0, 1.0
    norm = NormalDist()
    m = np.array([norm.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c = m / math.sqrt(m @ m)
    u = 1 / math.sqrt(n)
    a = c.copy()
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
            phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            a = m / math.sqrt((m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        z = (-math.log(g - math.log1p(-w)) - mu) / sd
    else:
        ln = math.log(n)
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
        sd = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
        z = (math.log1p(-w) - mu) / sd
    return w, 1 - norm.cdf(z)


@operator("explore.kl_divergence", "reference:Dataset current:Dataset", "statistics:Statistics")
def kl_divergence(reference: DataFrame, current: DataFrame, *, columns=(), bins=10, epsilon=1e-9, js_threshold=0.1):
    """KL(current || reference) and Jensen-Shannon divergence on shared equal-width bins."""
    rows = []
    for c in numeric_columns(reference, columns):
        need(current, c)
        ends = [d.agg(F.min(num(c)), F.max(num(c))).first() for d in (reference, current)]
        lo, hi = min(e[0] for e in ends), max(e[1] for e in ends)
        n = [np.array(histogram_counts(d, c, lo, hi, bins), float) for d in (reference, current)]
        p, q = (np.clip(v / max(v.sum(), 1), epsilon, None) for v in n)
        p, q = p / p.sum(), q / q.sum()
        mid = (p + q) / 2
        kl = lambda a, b: float((a * np.log(a / b)).sum())
        js = (kl(p, mid) + kl(q, mid)) / 2
        rows.append((c, kl(q, p), js, bool(js >= js_threshold)))
    return reference.sparkSession.createDataFrame(rows, "column string, kl double, js double, drift boolean")


@operator("explore.isotonic", ANY, "statistics:Statistics", out_of_bounds=("clip", "nan"))
def isotonic(df: DataFrame, *, x_column, y_column, increasing=True, out_of_bounds="clip", max_points=500):
    """Monotone regression: its blocks as (boundary, fitted) points, R2 and Spearman's rho."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    need(df, x_column, y_column)
    d = df.select(num(x_column).alias("x"), num(y_column).alias("y")).dropna()
    v = VectorAssembler(inputCols=["x"], outputCol="v").transform(d)
    model = IsotonicRegression(featuresCol="v", labelCol="y", isotonic=increasing).fit(v)
    fit = model.transform(v)
    m = d.agg(F.avg("y")).first()[0]
    res, tot = fit.agg(F.sum(F.pow(F.col("y") - F.col("prediction"), F.lit(2.0))), F.sum(F.pow(F.col("y") - F.lit(m), F.lit(2.0)))).first()
    rho = correlation_matrix(ranks(ranks(d, "x", "rx"), "y", "ry"), ["rx", "ry"])["rx", "ry"]
    x, y = model.boundaries.toArray(), model.predictions.toArray()
    step = max(1, -(-len(x) // max_points))
    r2 = 1 - res / tot if tot else None
    return df.sparkSession.createDataFrame([(float(a), float(b), r2, rho) for a, b in zip(x[::step], y[::step])], "x double, fitted double, r2 double, spearman double")


@operator("explore.gbr_fit", ANY, "statistics:Statistics importance:FeatureImportance")
def gbr_fit(df: DataFrame, *, columns, target_column, n_estimators=100, learning_rate=0.1, max_depth=3, min_samples_leaf=1, subsample=1.0, test_size=0.0, random_state=42, max_points=500):
    """Gradient boosted regression with in-sample or held-out R2, MAE and RMSE."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from millrace.operators.data import split
    from millrace.operators.evaluation import regression_metrics

    used = numeric_columns(df, columns)
    d = df.select(RID, *used, num(target_column).alias("__y")).dropna()
    parts = split(d, method="random", test_size=test_size, random_state=random_state) if test_size else {"train": d, "test": d}
    vec = VectorAssembler(inputCols=used, outputCol="v")
    model = GBTRegressor(featuresCol="v", labelCol="__y", maxIter=n_estimators, stepSize=learning_rate, maxDepth=max_depth, minInstancesPerNode=min_samples_leaf, subsamplingRate=subsample, seed=random_state).fit(vec.transform(parts["train"]))
    pred = model.transform(vec.transform(parts["test"])).select(RID, F.col("__y").alias("actual"), "prediction")
    rank = df.sparkSession.createDataFrame(list(zip(used, map(float, model.featureImportances.toArray()))), "feature string, importance double")
    return {"statistics": regression_metrics(pred), "importance": rank}


@operator("explore.hp_filter", ANY, "statistics:Statistics")
def hp_filter(df: DataFrame, *, column, lamb=1600.0, group_column=None, time_column=None, max_points=500):
    """Hodrick-Prescott trend per group: variance shares and the trend's slope."""
    need(df, column, group_column, time_column)

    def row(y):
        y = y[~np.isnan(y)]
        t = kernels.hp_trend(y, lamb)
        var = y.var()
        slope = float(np.polyfit(np.arange(len(t)), t, 1)[0]) if len(t) > 1 else 0.0
        step = max(1, -(-len(y) // max_points))
        return {"n": len(y), "trend_share": float(t.var() / var) if var > 0 else None, "cycle_share": float((y - t).var() / var) if var > 0 else None, "trend_slope": slope, "trend": t[::step].tolist()}

    return per_series(df, [column], group_column, time_column, row, "n long, trend_share double, cycle_share double, trend_slope double, trend array<double>")


@operator("explore.stationarity", ANY, "statistics:Statistics", regression=("c", "ct", "n"))
def stationarity(df: DataFrame, *, column, max_lag=0, regression="c", group_column=None, time_column=None):
    """Augmented Dickey-Fuller statistic per group against asymptotic critical values."""
    need(df, column, group_column, time_column)
    return per_series(df, [column], group_column, time_column, lambda y: kernels.adf(y[~np.isnan(y)], max_lag, regression), "statistic double, lag long, n long, critical_1 double, critical_5 double, critical_10 double, stationary boolean")


@operator("explore.dtw", ANY, "statistics:Statistics")
def dtw_distance(df: DataFrame, *, first_column, second_column, band=0, normalize=True, group_column=None, time_column=None):
    """Dynamic time warping distance of two columns, per group."""
    need(df, first_column, second_column, group_column, time_column)

    def row(a, b):
        a, b = a[~np.isnan(a)], b[~np.isnan(b)]
        a, b = (kernels.z_scores(a), kernels.z_scores(b)) if normalize else (a, b)
        d, steps = kernels.dtw(a, b, band)
        return {"distance": d, "path_length": steps, "per_step": d / steps}

    return per_series(df, [first_column, second_column], group_column, time_column, row, "distance double, path_length long, per_step double")


@operator("explore.sbd", ANY, "statistics:Statistics")
def shape_distance(df: DataFrame, *, first_column, second_column, max_lag_fraction=0.5, normalize=True, group_column=None, time_column=None):
    """Shape-based distance of two columns, per group."""
    need(df, first_column, second_column, group_column, time_column)

    def row(a, b):
        ok = ~(np.isnan(a) | np.isnan(b))
        a, b = (kernels.z_scores(a[ok]), kernels.z_scores(b[ok])) if normalize else (a[ok], b[ok])
        d, lag = kernels.sbd(a, b, max_lag_fraction)
        return {"distance": d, "lag": lag}

    return per_series(df, [first_column, second_column], group_column, time_column, row, "distance double, lag long")


@operator("explore.slope_cosine", ANY, "prediction:Prediction")
def slope_cosine(df: DataFrame, *, first_column, second_column, window=20, threshold=0.5, group_column=None, time_column=None):
    """Rolling slopes of two columns and the cosine of their increments; missing until full."""
    need(df, first_column, second_column, group_column, time_column)
    df, w, finish = in_order(df, group_column, time_column, window)
    d = df.withColumns({"__x": num(first_column), "__y": num(second_column), "__i": F.row_number().over(w).cast("double")})
    d = d.withColumns({"__dx": F.col("__x") - F.lag("__x").over(w), "__dy": F.col("__y") - F.lag("__y").over(w)})
    f, h = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-(window - 2), 0)
    full = F.count("*").over(f) == window
    s = lambda a: F.try_divide(F.covar_pop(F.col(a), F.col("__i")).over(f), F.var_pop("__i").over(f))
    size = F.sqrt(F.sum(F.col("__dx") * F.col("__dx")).over(h) * F.sum(F.col("__dy") * F.col("__dy")).over(h))
    cos = F.try_divide(F.sum(F.col("__dx") * F.col("__dy")).over(h), F.when(size > 0, size))
    out = d.withColumns({"first_slope": F.when(full, s("__x")), "second_slope": F.when(full, s("__y")), "cosine": F.when(full, cos)})
    return finish(out).select(RID, "first_slope", "second_slope", "cosine", F.coalesce(F.col("cosine") < -threshold, F.lit(False)).alias("opposite"))
