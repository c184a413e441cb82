"""Data operators: rows, columns, filling, scaling, resampling, splitting."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.durations import as_seconds, seconds
from millrace.functions.expr import compile_expression
from millrace.functions.position import exact_quantiles, filled_bands, nth_smallest, own_rows
from millrace.operators.base import RID, OperatorError, guard, in_order, need, num, numeric_columns, operator
from millrace.sources import tables

COMPARISONS = ("gt", "ge", "lt", "le", "eq", "ne", ">", ">=", "<", "<=", "==", "!=", "in", "between")
TYPES = {"float64": "double", "int64": "bigint", "string": "string", "bool": "boolean"}


@operator("data.input", "", "dataset:Dataset", format=("csv", "parquet"))
def input_table(spark: SparkSession, *, path, paths=(), source_column="", format="csv", encoding="utf-8-sig", separator=",", columns=(), max_rows=0, filters=(), streaming=False, chunk_rows=200_000):
    """Scan CSV or Parquet sources (``streaming`` and ``chunk_rows`` need no other plan here)."""
    return tables.scan(spark, path, paths, source_column=source_column, format=format, encoding=encoding, separator=separator, columns=columns, max_rows=max_rows, filters=filters)


@operator("data.materialize", "dataset:Dataset", "dataset:Dataset")
def materialize_table(df: DataFrame):
    """Fix a table's rows in the shared folder."""
    from millrace.plans.durable import materialize

    return materialize(df)


@operator("data.asset_key", "dataset:Dataset", "dataset:Dataset", mode=("split", "regex"))
def asset_key(df: DataFrame, *, column, target="asset", mode="split", separator="_", index=0, pattern=""):
    """Derive a key from a text column by split and index, or by the first group of a pattern."""
    need(df, column)
    if target in df.columns:
        raise OperatorError(f"{target!r} exists already")
    text = F.col(column).cast("string")
    if mode == "split":
        parts = F.split(text, re.escape(separator))
        at = index if index >= 0 else F.size(parts) + index
        key = F.get(parts, F.lit(at).cast("int") if isinstance(at, int) else at.cast("int"))
    else:
        if re.compile(pattern).groups < 1:
            raise OperatorError("the pattern needs a group")
        key = F.regexp_extract(text, pattern, 1)
    out = df.withColumn(target, key)
    guard(out, bad=(F.col(target).isNull() | (F.col(target) == ""), f"no {target} can be derived from {column}"))
    return out


def condition(df: DataFrame, column: str, operator: str, value):
    """A predicate with missing values dropped by all comparisons but ``ne``, which keeps them."""
    need(df, column)
    if operator not in COMPARISONS:
        raise OperatorError(f"{operator!r} is not a comparison")
    kind = dict(df.dtypes)[column]
    c = num(column) if kind in ("double", "float") else F.col(f"`{column}`")
    match operator:
        case "gt" | ">":
            return c > F.lit(value)
        case "ge" | ">=":
            return c >= F.lit(value)
        case "lt" | "<":
            return c < F.lit(value)
        case "le" | "<=":
            return c <= F.lit(value)
        case "eq" | "==":
            return c == F.lit(value)
        case "ne" | "!=":
            return ~c.eqNullSafe(F.lit(value))
        case "in":
            return c.isin(list(value))
    low, high = value
    return c.between(F.lit(low), F.lit(high))


@operator("data.filter", "dataset:Dataset", "dataset:Dataset", operator=COMPARISONS, logical_operator=("and", "or"))
def filter_rows(df: DataFrame, *, column, operator="gt", value=0, conditions=(), logical_operator="and"):
    """Keep rows that meet the conditions, joined left to right by one logical operator."""
    out = condition(df, column, operator, value)
    for c in conditions:
        more = condition(df, c["column"], c.get("operator", "gt"), c.get("value", 0))
        out = out & more if logical_operator == "and" else out | more
    return df.where(out)


@operator("data.row_operation", "dataset:Dataset", "dataset:Dataset", operation=("head", "tail", "range", "sample", "sort", "drop_rows", "remove_duplicates", "drop_missing"))
def row_operation(df: DataFrame, *, operation="head", count=10, start=0, columns=(), ascending=True, indices=(), random_state=42):
    """Head, tail, range, sample, sort, drop rows, drop duplicates or drop missing."""
    need(df, *columns)
    used = list(columns) or [c for c in df.columns if c != RID]
    match operation:
        case "head":
            return df.orderBy(RID).limit(count)
        case "tail":
            return df.orderBy(F.desc(RID)).limit(count).orderBy(RID)
        case "range":
            return df.orderBy(RID).offset(start).limit(count)
        case "sample":
            return df.orderBy(F.xxhash64(RID, F.lit(random_state)), RID).limit(count)
        case "sort":
            way = F.asc_nulls_last if ascending else F.desc_nulls_last
            return df.orderBy(*map(way, used), RID)
        case "drop_rows":
            return df.where(~F.col(RID).isin([int(i) for i in indices])) if indices else df
        case "remove_duplicates":
            first = Window.partitionBy(*used).orderBy(RID)
            return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return df.dropna(subset=used)


@operator("data.column_operation", "dataset:Dataset", "dataset:Dataset", operation=("select", "drop", "rename", "reorder", "create", "cast_type", "drop_empty", "drop_constant", "trim_extrema"), dtype=tuple(TYPES))
def column_operation(df: DataFrame, *, operation="select", columns=(), mapping=None, name="", expression_text="", dtype="float64", extrema_count=1):
    """Select, drop, rename, reorder, create, cast, drop empty or constant columns, trim extrema."""
    need(df, *columns)
    own = [c for c in df.columns if c != RID]
    match operation:
        case "select":
            return df.select(*columns, RID)
        case "reorder":
            if sorted(columns) != sorted(own):
                raise OperatorError("reorder takes every column once")
            return df.select(*columns, RID)
        case "drop":
            return df.drop(*columns)
        case "rename":
            need(df, *(mapping or {}))
            after = [(mapping or {}).get(c, c) for c in own]
            if len(set(after)) < len(after):
                raise OperatorError("two columns would have one name")
            return df.withColumnsRenamed(mapping or {})
        case "create":
            if not name or name in df.columns:
                raise OperatorError("create needs a new column name")
            return df.withColumn(name, compile_expression(expression_text, set(own)))
        case "cast_type":
            return df.withColumns({c: F.col(c).cast(TYPES[dtype]) for c in columns})
        case "drop_empty" | "drop_constant":
            used = list(columns) or own
            agg = df.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(used)), *(F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(used)), F.count("*").alias("all")).first()
            if operation == "drop_empty":
                return df.drop(*(c for i, c in enumerate(used) if not agg[f"n{i}"]))
            return df.drop(*(c for i, c in enumerate(used) if agg[f"d{i}"] + (agg[f"n{i}"] < agg["all"]) <= 1))
    used = numeric_columns(df, columns)
    gone = None
    for c in used:  # the k least and the k greatest of each column; ties by row id
        for way in (F.asc, F.desc):
            ids = df.where(F.col(c).isNotNull()).orderBy(way(c), RID).limit(extrema_count).select(RID)
            gone = ids if gone is None else gone.union(ids)
    return df.join(gone.distinct(), RID, "left_anti")


AGGREGATIONS = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum}


@operator("data.time_resample", "dataset:Dataset", "dataset:Dataset", aggregation=(*AGGREGATIONS, "first", "last"), fill_method=("none", "interpolate", "ffill"))
def time_resample(df: DataFrame, *, time_column, frequency, columns=(), aggregation="mean", group_column=None, fill_method="none"):
    """Per group a dense grid of fixed bins between the first and the last, aggregated and filled.

    Bins align to the start of the day of the group's first sample. An empty bin sums to 0 and
    is missing otherwise; ``interpolate`` is linear in time, ends take the nearest value.
    """
    need(df, time_column, group_column)
    used = numeric_columns(df, columns, (group_column, time_column))
    step = seconds(frequency)
    if step <= 0:
        raise OperatorError("frequency must be positive")
    g = [group_column] if group_column else []
    base = df.select(*g, as_seconds(df, time_column).alias("__t"), RID, *used).where("__t is not null")
    lows = base.groupBy(*g).agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
    origin = F.floor(F.col("__lo") / 86400) * 86400
    slot = lambda t: F.floor((t - F.col("__o")) / F.lit(step))
    lows = lows.withColumn("__o", origin)
    grid = lows.select(*g, "__o", F.explode(F.sequence(slot(F.col("__lo")), slot(F.col("__hi")))).alias("__b"))
    if g:
        placed = base.join(lows.select(*g, "__o"), g)
    else:
        low = lows.first()
        placed = base.withColumn("__o", F.lit(low["__o"] if low else None).cast("double"))
    place = F.struct("__t", RID)

    def agg(c: str):
        x = num(c)
        if aggregation == "first":
            return F.min_by(x, F.when(x.isNotNull(), place))
        if aggregation == "last":
            return F.max_by(x, F.when(x.isNotNull(), place))
        return AGGREGATIONS[aggregation](x)

    binned = placed.groupBy(*g, slot(F.col("__t")).alias("__b")).agg(*(agg(c).alias(c) for c in used))
    out = grid.join(binned, [*g, "__b"], "left")
    if aggregation == "sum":
        out = out.fillna(0.0, subset=used)
    if fill_method != "none":
        if g:
            at, finish = Window.partitionBy(*g).orderBy("__b"), lambda rows: rows
        else:
            (out, at), finish = filled_bands(out, [F.col("__b")], used), own_rows
        back, ahead = at.rowsBetween(Window.unboundedPreceding, 0), at.rowsBetween(0, Window.unboundedFollowing)
        out = finish(out.withColumns({c: _filled(F.col(c), F.col("__b"), back, ahead, fill_method == "interpolate") for c in used}))
    time = F.timestamp_micros(((F.col("__o") + F.col("__b") * step) * 1_000_000).cast("long"))
    ids = F.row_number().over(Window.partitionBy(*g).orderBy("__b")) if g else F.col("__b") + 1
    rid = F.xxhash64(*g).bitwiseAND(F.lit(0x3FFFFF)) * F.lit(1 << 40) + ids if g else ids
    kind = dict(df.dtypes)[time_column]
    shown = time.cast(kind) if kind.startswith("timestamp") or kind == "date" else (F.col("__o") + F.col("__b") * step)
    return out.select(*g, shown.alias(time_column), *used, rid.cast("long").alias(RID))


def _filled(x, place, back, ahead, linear: bool):
    """Missing values from their neighbours: linear in ``place``, or the last one; ends nearest."""
    a, b = F.last(x, ignorenulls=True).over(back), F.first(x, ignorenulls=True).over(ahead)
    if not linear:
        return F.coalesce(a, b)
    pa = F.last(F.when(x.isNotNull(), place), ignorenulls=True).over(back)
    pb = F.first(F.when(x.isNotNull(), place), ignorenulls=True).over(ahead)
    return F.coalesce(x, a + (b - a) * (place - pa) / (pb - pa), a, b)


@operator("data.split", "dataset:Dataset", "train:Dataset test:Dataset", method=("random", "temporal", "group"))
def split(df: DataFrame, *, method="random", test_size=0.25, random_state=42, group_column=None, stratify_column=None):
    """Train and test tables by seeded hash order, by row order, or by whole groups."""
    if not 0 < test_size < 1:
        raise OperatorError("test_size lies between 0 and 1")
    need(df, group_column, stratify_column)
    seed = F.lit(random_state)
    if method == "group":
        if not group_column:
            raise OperatorError("a group split needs group_column")
        groups = df.select(F.col(group_column).alias("__g")).distinct()
        n = groups.count()
        test = groups.orderBy(F.xxhash64("__g", seed), "__g").limit(max(1, round(n * test_size))).withColumn("__test", F.lit(True))
        out = df.join(test, df[group_column].eqNullSafe(test["__g"]), "left").drop("__g")
    elif method == "temporal":
        cut = nth_smallest(df, F.col(RID), int(df.count() * (1 - test_size)) + 1)
        out = df.withColumn("__test", F.col(RID) >= F.lit(0 if cut is None else cut))
    elif stratify_column:
        w = Window.partitionBy(stratify_column)
        rank = F.row_number().over(w.orderBy(F.xxhash64(RID, seed), RID))
        out = df.withColumn("__test", rank <= F.round(F.count("*").over(w) * test_size))
    else:  # the n rows of least hash: one threshold, no global order
        h = F.xxhash64(RID, seed)
        cut = nth_smallest(df, h, round(df.count() * test_size))
        out = df.withColumn("__test", F.lit(False) if cut is None else h <= F.lit(cut))
    hit = F.coalesce("__test", F.lit(False))
    return {"train": out.where(~hit).drop("__test"), "test": out.where(hit).drop("__test")}


@operator("data.neighbor_features", "dataset:Dataset", "dataset:Dataset")
def neighbor_features(df: DataFrame, *, columns, offsets=(1,), group_column=None, time_column=None, drop_missing=False):
    """Lag (positive offsets) and lead (negative) columns within groups in time order."""
    need(df, *columns, group_column, time_column)
    df, w, finish = in_order(df, group_column, time_column, max([0, *offsets]), -min([0, *offsets]))
    new = {}
    for c, k in itertools.product(columns, offsets):
        if k == 0:
            raise OperatorError("an offset is not 0")
        new[f"{c}_lag_{k}" if k > 0 else f"{c}_lead_{-k}"] = F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w)
    out = finish(df.withColumns(new))
    return out.dropna(subset=list(new)) if drop_missing else out


@operator("data.imputation", "dataset:Dataset", "dataset:Dataset", method=("mean", "max", "min", "interpolate"), interpolation_method=("linear", "nearest"))
def imputation(df: DataFrame, *, columns=(), method="mean", group_column=None, interpolation_method="linear"):
    """Fill missing numbers by group then table statistic, or by interpolation in row order."""
    need(df, group_column)
    used = numeric_columns(df, columns, (group_column,))
    g = [group_column] if group_column else []
    if method != "interpolate":
        fn = {"mean": F.avg, "max": F.max, "min": F.min}[method]
        whole = df.agg(*(fn(num(c)).alias(c) for c in used)).first()
        out = df
        if g:
            stats = df.groupBy(*g).agg(*(fn(num(c)).alias(f"__{c}") for c in used)).withColumnRenamed(g[0], "__g")
            out = df.join(stats, df[g[0]].eqNullSafe(stats["__g"]), "left")
        own = lambda c: [F.col(f"__{c}")] if g else []
        out = out.withColumns({c: F.coalesce(num(c), *own(c), F.lit(whole[c]).cast("double")) for c in used})
        out = out.drop("__g", *(f"__{c}" for c in used))
    else:
        out = df.withColumns({f"__x{i}": num(c) for i, c in enumerate(used)})
        if g:
            w, finish = Window.partitionBy(*g).orderBy(RID), lambda rows: rows
            out = out.withColumn("__p", F.row_number().over(w))
        else:
            (out, w), finish = filled_bands(out, [F.col(RID)], [f"__x{i}" for i in range(len(used))]), own_rows
            out = out.withColumn("__p", F.col("__pos"))
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        new = {}
        for i, c in enumerate(used):
            x = F.col(f"__x{i}")
            if interpolation_method == "linear":
                new[c] = _filled(x, F.col("__p"), back, ahead, True)
            else:
                a, b = F.last(x, ignorenulls=True).over(back), F.first(x, ignorenulls=True).over(ahead)
                pa = F.last(F.when(x.isNotNull(), F.col("__p")), ignorenulls=True).over(back)
                pb = F.first(F.when(x.isNotNull(), F.col("__p")), ignorenulls=True).over(ahead)
                new[c] = F.coalesce(x, F.when(F.col("__p") - pa <= pb - F.col("__p"), a), b, a)
        out = finish(out.withColumns(new)).drop("__p", *(f"__x{i}" for i in range(len(used))))
    guard(out, left=(F.greatest(*(F.col(c).isNull().cast("int") for c in used), F.lit(0)) == 1, "values are still missing"))
    return out


def _finite(df: DataFrame, used: list[str]) -> None:
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    guard(df, **{f"c{i}": (bad(c), f"{c} has missing or infinite values") for i, c in enumerate(used)})


@operator("data.normalization", "dataset:Dataset", "dataset:Dataset", method=("minmax", "l1", "l2", "maxabs"))
def normalization(df: DataFrame, *, columns=(), method="minmax", feature_range=(0, 1)):
    """Min-max or max-abs per column, or L1/L2 per row; constants divide by 1."""
    used = numeric_columns(df, columns)
    _finite(df, used)
    one = lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)
    if method in ("l1", "l2"):
        parts = [F.abs(num(c)) if method == "l1" else num(c) * num(c) for c in used]
        total = sum(parts[1:], parts[0])
        norm = one(total if method == "l1" else F.sqrt(total))
        return df.withColumns({c: num(c) / norm for c in used})
    s = df.agg(*(F.min(num(c)).alias(f"lo{i}") for i, c in enumerate(used)), *(F.max(num(c)).alias(f"hi{i}") for i, c in enumerate(used))).first()
    new = {}
    for i, c in enumerate(used):
        lo, hi = s[f"lo{i}"], s[f"hi{i}"]
        if lo is None:
            continue
        if method == "maxabs":
            new[c] = num(c) / F.lit(max(abs(lo), abs(hi)) or 1.0)
        else:
            a, b = map(float, feature_range)
            new[c] = (num(c) - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(b - a) + F.lit(a)
    return df.withColumns(new) if new else df


@operator("data.standardization", "dataset:Dataset", "dataset:Dataset", method=("zscore", "robust"))
def standardization(df: DataFrame, *, columns=(), method="zscore", with_mean=True, with_std=True):
    """Population z-scores, or median and interquartile range; constants divide by 1."""
    used = numeric_columns(df, columns)
    _finite(df, used)
    if method == "zscore":
        aggs = [(F.avg(num(c)).alias(f"m{i}"), F.stddev_pop(num(c)).alias(f"s{i}")) for i, c in enumerate(used)]
    else:
        q = exact_quantiles(df, {c: num(c) for c in used}, (0.25, 0.5, 0.75))
        aggs = [(F.lit(q[c][1]).alias(f"m{i}"), F.lit(q[c][2] - q[c][0] if q[c][0] is not None else None).alias(f"s{i}")) for i, c in enumerate(used)]
    s = df.agg(*(a for pair in aggs for a in pair)).first()
    if s["m0"] is None:
        return df
    return df.withColumns({c: (num(c) - F.lit(s[f"m{i}"] if with_mean else 0.0)) / F.lit((s[f"s{i}"] if with_std else 1.0) or 1.0) for i, c in enumerate(used)})


TRANSFORMATIONS = ("log", "log1p", "sqrt", "power", "box-cox", "yeo-johnson", "quantile_uniform", "quantile_normal", "expression")


@operator("data.transformation", "dataset:Dataset", "dataset:Dataset", method=TRANSFORMATIONS)
def transformation(df: DataFrame, *, columns=(), method="log1p", power=2, expression_text="x", n_quantiles=1000):
    """Elementwise and fitted transformations; a result outside the reals is an error."""
    from millrace.functions import power as fitted

    used = numeric_columns(df, columns)
    _finite(df, used)
    simple = {"log": "log(x)", "log1p": "log1p(x)", "sqrt": "sqrt(x)", "power": f"x ** {power}", "expression": expression_text}
    out = df
    for c in used:
        x = num(c)
        if method in simple:
            out = out.withColumn(c, compile_expression(simple[method], {"x": x}))
        elif method in ("box-cox", "yeo-johnson"):
            out = fitted.power_transform(out, c, method)
        else:
            out = fitted.quantile_transform(out, c, n_quantiles, method == "quantile_normal")
    guard(out, **{f"c{i}": (F.col(c).isNull() | (F.abs(F.col(c)) == float("inf")), f"{method} of {c} is not finite") for i, c in enumerate(used)})
    return out


@operator("data.binarize", "dataset:Dataset", "dataset:Dataset")
def binarize(df: DataFrame, *, columns, threshold=0.0, keep_original=True, suffix="_binary"):
    """1 where a value is above the threshold, else 0; missing is 0."""
    used = numeric_columns(df, columns)
    flag = lambda c: F.coalesce(num(c) > F.lit(float(threshold)), F.lit(False)).cast("tinyint")
    return df.withColumns({c + suffix if keep_original else c: flag(c) for c in used})


@operator("data.polynomial_features", "dataset:Dataset", "dataset:Dataset")
def polynomial_features(df: DataFrame, *, columns, degree=2, interaction_only=False, include_bias=False, keep_original=True, max_columns=512):
    """Monomials up to a degree, named like ``a^2`` and ``a*b``."""
    used = numeric_columns(df, columns)
    pick = itertools.combinations if interaction_only else itertools.combinations_with_replacement
    new = {"bias": F.lit(1.0)} if include_bias else {}
    for d in range(2 if keep_original else 1, degree + 1):
        for combo in pick(used, d):
            powers = {c: combo.count(c) for c in dict.fromkeys(combo)}
            name = "*".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items())
            value = num(combo[0])
            for c in combo[1:]:
                value = value * num(c)
            new[name] = value
    if len(new) > max_columns:
        raise OperatorError(f"{len(new)} columns are more than max_columns")
    return df.withColumns(new) if keep_original else df.drop(*used).withColumns(new) if not set(used) & set(new) else df.withColumns(new)


@operator("data.discretize", "dataset:Dataset", "dataset:Dataset", strategy=("uniform", "quantile", "kmeans"), encode=("ordinal", "onehot-dense"))
def discretize(df: DataFrame, *, columns, n_bins=5, strategy="quantile", encode="ordinal", keep_original=True, suffix="_bin", random_state=42):
    """Bins of equal width, equal counts, or around one-dimensional k-means centres."""
    used = numeric_columns(df, columns)
    _finite(df, used)
    new = {}
    for c in used:
        edges = bin_edges(df, c, n_bins, strategy, random_state)
        inner = edges[1:-1]
        at = F.lit(0.0) if not inner else sum(((num(c) >= F.lit(e)).cast("int") for e in inner[1:]), (num(c) >= F.lit(inner[0])).cast("int")).cast("double")
        if encode == "ordinal":
            new[c + suffix if keep_original else c] = at
        else:
            new |= {f"{c}{suffix}_{k}": (at == k).cast("double") for k in range(len(edges) - 1)}
    out = df.withColumns(new)
    return out.drop(*used) if encode != "ordinal" and not keep_original else out


def bin_edges(df: DataFrame, c: str, n_bins: int, strategy: str, seed: int = 42) -> list[float]:
    if strategy == "quantile":
        points = [i / n_bins for i in range(n_bins + 1)]
        edges = exact_quantiles(df, {c: num(c)}, points)[c]
        return sorted(set(edges)) if edges[0] is not None else [0.0]
    if strategy == "uniform":
        lo, hi = df.agg(F.min(num(c)), F.max(num(c))).first()
        return [lo + (hi - lo) * i / n_bins for i in range(n_bins + 1)]
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    lo, hi = df.agg(F.min(num(c)), F.max(num(c))).first()
    points = VectorAssembler(inputCols=["v"], outputCol="features").transform(df.select(num(c).alias("v")))
    mid = sorted(float(x[0]) for x in KMeans(k=n_bins, seed=seed).fit(points).clusterCenters())
    return [lo, *((a + b) / 2 for a, b in itertools.pairwise(mid)), hi]


@operator("data.seasonal_difference", "dataset:Dataset", "dataset:Dataset", mode=("difference", "ratio"))
def seasonal_difference(df: DataFrame, *, columns, period=24, mode="difference", group_column=None, time_column=None, keep_original=True, suffix="", drop_missing=False):
    """Difference or ratio to the value one period earlier; a ratio needs positive baselines."""
    used = numeric_columns(df, columns)
    need(df, group_column, time_column)
    df, w, finish = in_order(df, group_column, time_column, period)
    end = suffix or ("_seasonal_diff" if mode == "difference" else "_seasonal_ratio")
    out = finish(df.withColumns({f"__b{i}": F.lag(num(c), period).over(w) for i, c in enumerate(used)}))
    if mode == "ratio":
        guard(out, **{f"c{i}": (F.col(f"__b{i}") <= 0, f"{c} has a baseline that is not positive") for i, c in enumerate(used)})
    name = lambda c: c + end if keep_original else c
    out = out.withColumns({name(c): num(c) - F.col(f"__b{i}") if mode == "difference" else num(c) / F.col(f"__b{i}") for i, c in enumerate(used)})
    out = out.drop(*(f"__b{i}" for i in range(len(used))))
    return out.dropna(subset=[name(c) for c in used]) if drop_missing else out


@operator("data.concat", "first:Dataset second:Dataset third:Dataset? fourth:Dataset?", "dataset:Dataset")
def concat(*frames: DataFrame, source_column=""):
    """Rows of two to four tables with one column set, in the order of the inputs."""
    frames = tuple(f for f in frames if f is not None)
    want = set(frames[0].columns)
    out = None
    for k, (f, port) in enumerate(zip(frames, ("first", "second", "third", "fourth"))):
        if set(f.columns) != want:
            raise OperatorError(f"{port} has other columns: {sorted(set(f.columns) ^ want)}")
        if f.isEmpty():
            raise OperatorError(f"{port} is empty")
        f = f.withColumn(RID, F.lit(k << 56) + F.col(RID))
        f = f.withColumn(source_column, F.lit(port)) if source_column else f
        out = f if out is None else out.unionByName(f)
    return out


@operator("data.labels", "dataset:Dataset", "labels:LabelVector")
def labels(df: DataFrame, *, column):
    """One column as a label vector aligned by row id."""
    need(df, column)
    return df.select(RID, F.col(column).alias("label"))
