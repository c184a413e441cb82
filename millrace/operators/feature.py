"""Feature operators: window features, row-aligned features, encoders, selection."""

from __future__ import annotations

import inspect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import kernels, stats
from millrace.functions.position import exact_quantiles
from millrace.operators.base import RID, OperatorError, guard, in_order, need, num, numeric_columns, operator
from millrace.operators.windows import Spec, windows

HEAD = ("window_id", "group_no", "group_label", "asset", "rid_start", "rid_stop", "n_rows", "t_begin", "t_end", "label", RID)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in HEAD]


def windowed(*more: inspect.Parameter):
    """Give a window operator the shared window parameters besides its own."""
    import dataclasses

    def add(fn):
        own = [p for p in inspect.signature(fn).parameters.values() if p.kind is inspect.Parameter.KEYWORD_ONLY and p.name != "spec"]
        shared = [inspect.Parameter(f.name, inspect.Parameter.KEYWORD_ONLY, default=f.default) for f in dataclasses.fields(Spec)]
        names = {f.name for f in dataclasses.fields(Spec)}

        def run(df, **params):
            spec = Spec(**{k: v for k, v in params.items() if k in names})
            return fn(df, spec=spec, **{k: v for k, v in params.items() if k not in names})

        run.__doc__, run.__name__ = fn.__doc__, fn.__name__
        run.__signature__ = inspect.Signature([inspect.Parameter("df", inspect.Parameter.POSITIONAL_ONLY), *shared, *own])
        return run

    return add


def plan_of(columns: list[str], default, column_features: dict | None, known) -> dict[str, list[str]]:
    """Targets of each column; an override names its own, unknown or empty ones are errors."""
    plan = {c: list((column_features or {}).get(c, default)) for c in columns}
    if extra := set(column_features or {}) - set(columns):
        raise OperatorError(f"column_features names unused columns {sorted(extra)}")
    for c, names in plan.items():
        if not names or (bad := set(names) - set(known)):
            raise OperatorError(f"{c}: unknown or no features {sorted(bad) if names else ''}")
    return plan


def _signal_columns(df, columns, spec: Spec) -> list[str]:
    used = numeric_columns(df, columns, (spec.group_column, spec.asset_column, spec.label_column, spec.time_column))
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    guard(df, **{f"c{i}": (bad(c), f"{c} has missing values; impute first") for i, c in enumerate(used)})
    return used


@operator("feature.statistical", "dataset:Dataset|FeatureDataset", "features:FeatureDataset")
@windowed()
def statistical(df: DataFrame, *, columns=(), features=("mean", "std", "rms"), quantile=0.75, column_features=None, spec: Spec = Spec()):
    """The 36 statistics of every window and column, named ``<column>__<statistic>``."""
    used = _signal_columns(df, columns, spec)
    plan = plan_of(used, features, column_features, stats.STATISTICS)
    agg, finish, temporary = {}, {}, []
    for c, names in plan.items():
        ordered = [n for n in names if stats.plain(n, num(c), quantile) is None]
        agg |= {f"{c}__{n}": stats.plain(n, num(c), quantile) for n in names if n not in ordered}
        if ordered:
            array = f"__a_{c}"
            agg[array] = F.transform(F.array_sort(F.collect_list(F.struct("pos", num(c).alias("x")))), lambda s: s["x"])
            temporary.append(array)
            finish |= {f"{c}__{n}": stats.ORDERED[n](F.col(f"`{array}`")) for n in ordered}
    out = windows(df, spec).features(agg, finish, temporary)
    names = [f"{c}__{n}" for c, ns in plan.items() for n in ns]
    return out.select(*[c for c in out.columns if c in HEAD and c != RID], *names, RID)


@operator("feature.fitting", "dataset:Dataset|FeatureDataset", "features:FeatureDataset", fitting_method=("linear", "polynomial", "exponential"))
@windowed()
def fitting(df: DataFrame, *, columns=(), fitting_method="linear", degree=2, spec: Spec = Spec()):
    """Least-squares fits per window: coefficients, r2, trend strength, residual mean and spread.

    A constant window has r2 0 and trend strength 0. Linear fits are aggregates in SQL; other
    ones collect the (bounded) window.
    """
    used = _signal_columns(df, columns, spec)
    agg, finish, temporary = {}, {}, []
    for c in used:
        x = F.ln(num(c)) if fitting_method == "exponential" else num(c)
        t = F.col("__t") if spec.time_column else F.col("pos").cast("double")
        if fitting_method == "polynomial":
            name = f"__a_{c}"
            agg[name] = F.array_sort(F.collect_list(F.struct(F.lit(0).alias("k"), t.alias("t"), num(c).alias("x"))))
            temporary += [name, f"__f_{c}"]
            finish[f"__f_{c}"] = kernels.polyfit_udf(degree)(F.col(f"`{name}`"))
            names = [*(f"coef_{d}" for d in range(degree, -1, -1)), "r2", "trend_strength", "residual_mean", "residual_std"]
            finish |= {f"{c}__{n}": F.element_at(f"__f_{c}", i + 1) for i, n in enumerate(names)}
            continue
        p = {"sxx": F.var_pop(t), "sxy": F.covar_pop(t, x), "syy": F.var_pop(x), "mx": F.avg(t), "my": F.avg(x), "t0": F.min(t)}
        for k, v in p.items():
            agg[f"__{k}_{c}"] = v
            temporary.append(f"__{k}_{c}")
        g = lambda k, c=c: F.col(f"`__{k}_{c}`")
        slope = F.try_divide(g("sxy"), g("sxx"))
        share = F.coalesce(F.try_divide(g("sxy") * g("sxy"), g("sxx") * g("syy")), F.lit(0.0))
        finish |= {
            f"{c}__coef_1": slope,
            f"{c}__coef_0": g("my") - slope * (g("mx") - g("t0")),
            f"{c}__r2": share,
            f"{c}__trend_strength": F.greatest(F.lit(0.0), share),
            f"{c}__residual_mean": F.when(slope.isNotNull(), F.lit(0.0)),
            f"{c}__residual_std": F.sqrt(F.greatest(F.lit(0.0), g("syy") * (1 - share))),
        }
    if fitting_method == "exponential":
        guard(df, **{f"c{i}": (num(c) <= 0, f"an exponential fit needs positive {c}") for i, c in enumerate(used)})
    return windows(df, spec).features(agg, finish, temporary)


@operator("feature.entropy", "dataset:Dataset|FeatureDataset", "features:FeatureDataset")
@windowed()
def entropy(df: DataFrame, *, columns=(), methods=("approximate_entropy", "information_entropy"), bins=16, embedding_dimension=2, tolerance_ratio=0.2, column_features=None, spec: Spec = Spec()):
    """Histogram entropy (bits) and approximate entropy of every window."""
    used = _signal_columns(df, columns, spec)
    plan = plan_of(used, methods, column_features, ("approximate_entropy", "information_entropy", "binned_entropy"))
    agg, finish, temporary = {}, {}, []
    for c, names in plan.items():
        a = f"__a_{c}"
        agg[a] = F.transform(F.array_sort(F.collect_list(F.struct("pos", num(c).alias("x")))), lambda s: s["x"])
        temporary.append(a)
        for n in names:
            finish[f"{c}__{n}"] = kernels.apen_udf(embedding_dimension, tolerance_ratio)(F.col(f"`{a}`")) if n == "approximate_entropy" else histogram_entropy(F.col(f"`{a}`"), bins)
    return windows(df, spec).features(agg, finish, temporary)


def histogram_entropy(a, bins: int):
    """Shannon entropy in bits over equal-width bins of a value array (JVM side)."""
    from millrace.functions.hof import let

    lo, hi = F.array_min(a), F.array_max(a)

    def of(lo, hi):
        slot = lambda v: F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))
        at = F.transform(a, slot)
        share = lambda b: F.size(F.filter(at, lambda v: v == b)) / F.size(a)
        return F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0.0), lambda s, b: s + let(share(b), lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)))

    return F.when(lo == hi, F.lit(0.0)).otherwise(let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda s: of(s["lo"], s["hi"])))


@operator("feature.spectral", "dataset:Dataset|FeatureDataset", "features:FeatureDataset", flat_policy=("nan", "skip", "error"))
@windowed()
def spectral(df: DataFrame, *, sampling_rate, columns=(), features=("dominant_frequency", "spectral_centroid", "spectral_entropy", "band_energy_ratio"), band_edges=(0.25, 0.5), harmonic_tolerance=0.02, flat_policy="nan", flat_threshold=0.0, column_features=None, spec: Spec = Spec()):
    """Hann-tapered spectrum features of every window; flat windows by policy."""
    used = _signal_columns(df, columns, spec)
    plan = plan_of(used, features, column_features, kernels.SPECTRAL)
    agg, finish, temporary = {}, {}, []
    for c, names in plan.items():
        a, f = f"__a_{c}", f"__f_{c}"
        agg[a] = F.transform(F.array_sort(F.collect_list(F.struct("pos", num(c).alias("x")))), lambda s: s["x"])
        temporary += [a, f]
        outs = [o for n in names for o in ([f"band_energy_ratio_{k}" for k in range(len(band_edges) + 1)] if n == "band_energy_ratio" else [n])]
        finish[f] = kernels.spectral_udf(outs, float(sampling_rate), tuple(band_edges), harmonic_tolerance, flat_threshold)(F.col(f"`{a}`"))
        finish |= {f"{c}__{o}": F.element_at(f, i + 1) for i, o in enumerate(outs)}
    out = windows(df, spec).features(agg, finish, temporary)
    names = feature_columns(out)
    if flat_policy == "skip":
        return out.dropna(subset=names)
    if flat_policy == "error":
        guard(out, flat=(F.greatest(*(F.col(c).isNull().cast("int") for c in names), F.lit(0)) == 1, "a window is flat"))
    return out


ROLLING = ("mean", "std", "variance", "median", "max", "min", "max_repeat")


@operator("feature.rolling_statistics", "dataset:Dataset", "features:FeatureDataset", method=ROLLING)
def rolling_statistics(df: DataFrame, *, columns, method="mean", window=5, group_column=None, time_column=None, column_features=None):
    """Trailing statistics per row, named ``<column>__rolling_<method>_<window>``."""
    need(df, group_column, time_column)
    plan = plan_of(numeric_columns(df, columns), [method], column_features, ROLLING)
    df, w, finish = in_order(df, group_column, time_column, window - 1)
    w = w.rowsBetween(-(window - 1), 0)
    fn = {
        "mean": F.avg, "std": F.stddev_pop, "variance": F.var_pop, "max": F.max, "min": F.min,
        "median": lambda x: F.percentile(x, F.lit(0.5)),
    }
    new = {}
    for c, names in plan.items():
        for m in names:
            if m == "max_repeat":
                top, seen = F.max(num(c)).over(w), F.collect_list(num(c)).over(w)
                new[f"{c}__rolling_{m}_{window}"] = (F.size(F.array_remove(seen, top)) < F.size(seen) - 1).cast("double")
            else:
                new[f"{c}__rolling_{m}_{window}"] = fn[m](num(c)).over(w)
    return finish(df.withColumns(new)).select(RID, *(F.col(f"`{n}`") for n in new))


TEMPORAL = ("first_difference", "second_difference", "autocorrelation", "sum_abs_change", "peak_count")


@operator("feature.temporal", "dataset:Dataset", "features:FeatureDataset", method=TEMPORAL)
def temporal(df: DataFrame, *, columns, method="first_difference", lag=1, window=20, prominence=0.0, group_column=None, time_column=None, column_features=None):
    """Row-aligned differences, rolling autocorrelation, absolute change and peak counts."""
    need(df, group_column, time_column)
    plan = plan_of(numeric_columns(df, columns), [method], column_features, TEMPORAL)
    work, w, finish = in_order(df, group_column, time_column, window + lag + 2)
    names: list[str] = []
    for i, (c, methods) in enumerate(plan.items()):
        x = num(c)
        work = work.withColumn(f"__d{i}", x - F.lag(x, 1).over(w)).withColumn(f"__l{i}", F.lag(x, lag).over(w))
        for m in methods:
            name = f"{c}__{m}" if m in TEMPORAL[:2] else f"{c}__{m}_{lag if m == 'autocorrelation' else window}"
            names.append(name)
            if m == "first_difference":
                work = work.withColumn(name, F.coalesce(f"__d{i}", F.lit(0.0)))
            elif m == "second_difference":
                work = work.withColumn(name, F.coalesce(F.col(f"__d{i}") - F.lag(f"__d{i}", 1).over(w), F.lit(0.0)))
            elif m == "sum_abs_change":
                work = work.withColumn(name, F.coalesce(F.sum(F.abs(f"__d{i}")).over(w.rowsBetween(-(window - 2), 0)), F.lit(0.0)))
            elif m == "autocorrelation":
                # pairs (x, lagged x) that lie wholly inside the trailing window
                f = w.rowsBetween(-(window - 1 - lag), 0)
                a, b = F.when(F.col(f"__l{i}").isNotNull(), x), F.col(f"__l{i}")
                cov = F.covar_pop(a, b).over(f)
                spread = F.stddev_pop(a).over(f) * F.stddev_pop(b).over(f)
                enough = F.count(x).over(w.rowsBetween(-(window - 1), 0)) >= lag + 2
                work = work.withColumn(name, F.when(enough, F.coalesce(F.try_divide(cov, F.when(spread > 1e-12, spread)), F.lit(0.0))))
            else:
                seen = F.collect_list(x).over(w.rowsBetween(-(window - 1), 0))
                work = work.withColumn(name, kernels.peak_count_udf(float(prominence))(seen))
    return finish(work).select(RID, *names)


@operator("feature.wavelet", "dataset:Dataset", "features:FeatureDataset")
def wavelet(df: DataFrame, *, columns, window=32, levels=3, peak_sigma=3.0, group_column=None, time_column=None):
    """Trailing Haar decomposition: energy share per level, dominant level, robust peaks."""
    need(df, group_column, time_column)
    if window < 2**levels:
        raise OperatorError("the window is shorter than 2 ** levels")
    out, w, finish = in_order(df, group_column, time_column, window - 1)
    w, pick = w.rowsBetween(-(window - 1), 0), [RID]
    for i, c in enumerate(numeric_columns(df, columns)):
        out = out.withColumn(f"__h{i}", kernels.haar_udf(window, levels, peak_sigma)(F.collect_list(num(c)).over(w)))
        names = [*(f"energy_level_{k + 1}" for k in range(levels)), "dominant_level", "peak_count"]
        pick += [F.element_at(f"__h{i}", k + 1).alias(f"{c}__wavelet_{n}") for k, n in enumerate(names)]
    return finish(out).select(*pick)


# --- encoders -------------------------------------------------------------------------

ENCODINGS = ("onehot", "ordinal", "frequency", "target", "category_statistics")
MISSING = "<missing>"


def _category(c: str):
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING))


class Encoder:
    """A fitted mapping: one table (category -> values) per column."""

    def __init__(self, method: str, tables: dict[str, DataFrame], outputs: dict[str, list[str]], defaults: dict[str, list], handle_unknown: str):
        self.method, self.tables, self.outputs, self.defaults, self.handle_unknown = method, tables, outputs, defaults, handle_unknown

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        out = df.select(RID, *keep, *(_category(c).alias(f"__c_{c}") for c in self.tables))
        for c, table in self.tables.items():
            if self.handle_unknown == "error":
                bad = out.join(table, out[f"__c_{c}"] == table["category"], "left_anti")
                if not bad.isEmpty():
                    raise OperatorError(f"{c} has categories the encoder has not seen")
            names = self.outputs[c]
            t = table.select(F.col("category").alias(f"__c_{c}"), *names)
            out = out.join(t, f"__c_{c}", "left")
            out = out.withColumns({n: F.coalesce(n, F.lit(d).cast("double")) for n, d in zip(names, self.defaults[c])})
        return out.select(*keep, *(n for ns in self.outputs.values() for n in ns), RID)


ONEHOT_MAX = 1000


def fit_encoder(df: DataFrame, columns, method="onehot", target_column=None, handle_unknown="ignore") -> Encoder:
    tables, outputs, defaults = {}, {}, {}
    for c in columns:
        cat = _category(c).alias("category")
        if method == "onehot":
            values = [r[0] for r in df.select(cat).distinct().orderBy("category").limit(ONEHOT_MAX + 1).collect()]
            if len(values) > ONEHOT_MAX:
                raise OperatorError(f"{c} has more than {ONEHOT_MAX} categories; use another encoding")
            names = [f"{c}={v}" for v in values]
            safe = [f"{c}__{i}" for i in range(len(values))]
            t = df.sparkSession.createDataFrame([(v, *(float(i == j) for j in range(len(values)))) for i, v in enumerate(values)], ", ".join(["category string", *(f"`{s}` double" for s in safe)]))
            t = t.withColumnsRenamed(dict(zip(safe, names)))
            dflt = [0.0] * len(names)
        elif method == "ordinal":
            t = df.select(cat).distinct()
            t = t.select("category", (F.row_number().over(Window.orderBy("category")) - 1).cast("double").alias(f"{c}__ordinal"))
            names, dflt = [f"{c}__ordinal"], [-1.0]
        elif method == "frequency":
            n = df.count()
            t = df.groupBy(cat).agg((F.count("*") / F.lit(max(n, 1))).alias(f"{c}__frequency"))
            names, dflt = [f"{c}__frequency"], [0.0]
        else:
            if not target_column:
                raise OperatorError(f"{method} needs target_column")
            y = num(target_column)
            mean = df.agg(F.avg(y)).first()[0]
            if method == "target":
                t, names, dflt = df.groupBy(cat).agg(F.avg(y).alias(f"{c}__target")), [f"{c}__target"], [mean]
            else:
                names = [f"{c}__{k}" for k in ("count", "mean", "std", "min", "max")]
                t = df.groupBy(cat).agg(*(f.alias(n) for f, n in zip((F.count(y).cast("double"), F.avg(y), F.coalesce(F.stddev_pop(y), F.lit(0.0)), F.min(y), F.max(y)), names)))
                dflt = [0.0, mean, 0.0, mean, mean]
        tables[c], outputs[c], defaults[c] = t, names, dflt
    return Encoder(method, tables, outputs, defaults, handle_unknown)


FOLDS = 5


@operator("feature.categorical", "dataset:Dataset", "features:FeatureDataset encoder:FeatureTransformer", method=ENCODINGS, handle_unknown=("ignore", "error"))
def categorical(df: DataFrame, *, columns, method="onehot", target_column=None, random_state=42, handle_unknown="ignore", keep_columns=()):
    """Fit an encoder and encode; target encoding is out of fold (five hashed folds)."""
    need(df, *columns, target_column, *keep_columns)
    encoder = fit_encoder(df, columns, method, target_column, handle_unknown)
    if method != "target":
        return {"features": encoder.transform(df, keep_columns), "encoder": encoder}
    y, fold = num(target_column), F.pmod(F.xxhash64(RID, F.lit(random_state)), F.lit(FOLDS))
    mean = df.agg(F.avg(y)).first()[0]
    out = df.select(RID, *keep_columns, fold.alias("__f"), *(_category(c).alias(f"__c_{c}") for c in columns))
    for c in columns:
        sums = df.groupBy(_category(c).alias(f"__c_{c}"), fold.alias("__f")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
        w = Window.partitionBy(f"__c_{c}")
        rest = sums.select(f"__c_{c}", "__f", F.try_divide(F.sum("s").over(w) - F.coalesce("s", F.lit(0.0)), F.sum("n").over(w) - F.col("n")).alias(f"{c}__target"))
        out = out.join(rest, [f"__c_{c}", "__f"], "left").fillna(mean or 0.0, subset=[f"{c}__target"])
    return {"features": out.select(*keep_columns, *(f"{c}__target" for c in columns), RID), "encoder": encoder}


@operator("feature.categorical_transform", "dataset:Dataset encoder:FeatureTransformer", "features:FeatureDataset")
def categorical_transform(df: DataFrame, encoder: Encoder, *, keep_columns=()):
    """Apply a fitted encoder."""
    return encoder.transform(df, keep_columns)


# --- feature tables -------------------------------------------------------------------


@operator("feature.select", "dataset:Dataset", "features:FeatureDataset")
def select(df: DataFrame, *, columns):
    """Numeric columns of a table as features."""
    return df.select(*numeric_columns(df, columns), RID)


@operator("feature.imputation", "features:FeatureDataset", "features:FeatureDataset", method=("mean", "median", "zero", "drop_columns"))
def feature_imputation(df: DataFrame, *, columns=(), method="mean", fill_value=0.0):
    """Fill missing features, or drop columns without any value."""
    used = list(columns) or [c for c in feature_columns(df) if dict(df.dtypes)[c] in ("double", "float", "int", "bigint")]
    need(df, *used)
    if method == "median":
        middle = exact_quantiles(df, {c: num(c) for c in used}, (0.5,)) if used else {}
        s = {f"v{i}": middle[c][0] for i, c in enumerate(used)}
    else:
        s = df.agg(*(F.avg(num(c)).alias(f"v{i}") for i, c in enumerate(used))).first()
    if method == "drop_columns":
        return df.drop(*(c for i, c in enumerate(used) if s[f"v{i}"] is None))
    if method == "zero":
        return df.withColumns({c: F.coalesce(num(c), F.lit(float(fill_value))) for c in used})
    if empty := [c for i, c in enumerate(used) if s[f"v{i}"] is None]:
        raise OperatorError(f"{empty} have no value to learn from")
    return df.withColumns({c: F.coalesce(num(c), F.lit(s[f"v{i}"])) for i, c in enumerate(used)})


@operator("feature.merge", "left:FeatureDataset right:FeatureDataset", "features:FeatureDataset")
def merge(left: DataFrame, right: DataFrame):
    """Join two feature branches of one window table; keys and coverage must be equal."""
    key = "window_id" if "window_id" in left.columns and "window_id" in right.columns else RID
    if both := set(feature_columns(left)) & set(feature_columns(right)):
        raise OperatorError(f"both sides have {sorted(both)}")
    shared = [c for c in ("rid_start", "rid_stop", "group_label", "asset", "label") if c in left.columns and c in right.columns]
    a, b = left.select(key, *shared), right.select(key, *shared)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise OperatorError("the branches cover different windows")
    return left.join(right.select(key, *feature_columns(right)), key)


@operator("feature.score_select", "features:FeatureDataset labels:LabelVector?", "features:FeatureDataset scores:FeatureImportance", method=("variance", "correlation", "mutual_information", "importance"))
def score_select(df: DataFrame, labels: DataFrame | None = None, *, method="variance", top_k=0, threshold=None, random_state=42):
    """Rank features by variance, correlation pruning, mutual information or forest importance."""
    used = feature_columns(df)
    var = df.agg(*(F.var_pop(num(c)).alias(f"v{i}") for i, c in enumerate(used))).first()
    score = {c: var[f"v{i}"] or 0.0 for i, c in enumerate(used)}
    if method == "correlation":
        limit = 0.95 if threshold is None else threshold
        r = correlation_matrix(df, used)
        kept: list[str] = []
        for c in sorted(used, key=lambda c: (-score[c], c)):
            if all(abs(r[c, k] or 0.0) <= limit for k in kept):
                kept.append(c)
        chosen = [c for c in used if c in kept]
    else:
        if method in ("mutual_information", "importance"):
            if labels is None:
                raise OperatorError(f"{method} needs labels")
            table = df.join(labels.select(RID, F.col("label").alias("__y")), RID)
            score = binned_information(table, used) if method == "mutual_information" else forest_importance(table, used, random_state)
        ranked = sorted(used, key=lambda c: (-score[c], used.index(c)))
        chosen = [c for c in ranked if threshold is None or score[c] >= threshold]
        chosen = [c for c in used if c in chosen[: top_k or len(chosen)]]
    scores = df.sparkSession.createDataFrame([(c, float(score[c]), c in chosen) for c in used], "feature string, score double, selected boolean")
    return {"features": df.select(*[c for c in df.columns if c in HEAD and c != RID], *chosen, RID), "scores": scores}


def correlation_matrix(df: DataFrame, used: list[str]) -> dict:
    """Pairwise-complete Pearson correlations in one aggregation; constants give None."""
    pairs = [(a, b) for i, a in enumerate(used) for b in used[i:]]
    both = lambda a, b: num(a).isNotNull() & num(b).isNotNull()

    def corr(a, b):
        x, y = F.when(both(a, b), num(a)), F.when(both(a, b), num(b))
        return F.try_divide(F.covar_pop(x, y), F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.stddev_pop(x) * F.stddev_pop(y)))

    row = df.agg(*(corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first()
    out = {}
    for i, (a, b) in enumerate(pairs):
        out[a, b] = out[b, a] = row[f"c{i}"]
    return out


def binned_information(df: DataFrame, used: list[str], bins: int = 16) -> dict[str, float]:
    """Mutual information (nats) of quantile-binned features with the label ``__y``."""
    from millrace.operators.data import bin_edges

    out = {}
    for c in used:
        inner = bin_edges(df.where(num(c).isNotNull()), c, bins, "quantile")[1:-1]
        slot = sum(((num(c) >= F.lit(e)).cast("int") for e in inner), F.lit(0))
        cells = df.groupBy(slot.alias("b"), "__y").agg(F.count("*").alias("n")).collect()  # at most bins x classes
        total = sum(r["n"] for r in cells) or 1
        px: dict = {}
        py: dict = {}
        for r in cells:
            px[r["b"]] = px.get(r["b"], 0) + r["n"]
            py[r["__y"]] = py.get(r["__y"], 0) + r["n"]
        out[c] = float(sum(r["n"] / total * np.log(r["n"] * total / (px[r["b"]] * py[r["__y"]])) for r in cells))
    return out


def forest_importance(df: DataFrame, used: list[str], seed: int) -> dict[str, float]:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    d = StringIndexer(inputCol="__y", outputCol="__i").fit(t := df.withColumn("__y", F.col("__y").cast("string"))).transform(t)
    d = VectorAssembler(inputCols=used, outputCol="__v").transform(d)
    model = RandomForestClassifier(featuresCol="__v", labelCol="__i", numTrees=50, seed=seed).fit(d)
    return dict(zip(used, map(float, model.featureImportances.toArray())))


@operator("feature.pca", "features:FeatureDataset", "features:FeatureDataset variance:Statistics")
def pca(df: DataFrame, *, n_components=2, columns=(), whiten=False):
    """Principal components ``pc_i`` from the covariance matrix; the largest loading is positive."""
    used = list(columns) or feature_columns(df)
    mean, vectors, values, total = principal_axes(df, used, n_components)
    new = {}
    for k in range(vectors.shape[1]):
        scale = np.sqrt(values[k]) if whiten and values[k] > 0 else 1.0
        new[f"pc_{k + 1}"] = sum(((num(c) - F.lit(float(mean[i]))) * F.lit(float(vectors[i, k] / scale)) for i, c in enumerate(used)), F.lit(0.0))
    ratio = [float(v / total) if total else 0.0 for v in values]
    table = df.sparkSession.createDataFrame([(f"pc_{k + 1}", float(v), r) for k, (v, r) in enumerate(zip(values, ratio))], "component string, variance double, ratio double")
    return {"features": df.select(*[c for c in df.columns if c in HEAD and c != RID], *(v.alias(n) for n, v in new.items()), RID), "variance": table}


#: Columns up to which a covariance matrix is one aggregation of built-in functions.
FEW_COLUMNS = 16


def _covariances(df: DataFrame, used: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(means, pairwise-complete sample covariances)."""
    d = len(used)
    if d <= FEW_COLUMNS:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        row = df.agg(*(F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(used)), *(F.covar_samp(num(used[i]), num(used[j])).alias(f"c{i}_{j}") for i, j in pairs)).first()
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
        return np.array([row[f"m{i}"] for i in range(d)], float), cov
    row = df.agg(*(F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(used))).first()
    mean = np.array([row[f"m{i}"] for i in range(d)], float)
    shift = np.nan_to_num(mean)

    def products(batches):
        """Of a task's rows: counts, sums and products of every pair of columns."""
        total = np.zeros((3, d, d))
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(d)], 1).astype(float)
            there = ~np.isnan(x)
            x, there = np.where(there, x - shift, 0.0), there.astype(float)
            total += there.T @ there, x.T @ there, x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])

    parts = df.select(*(num(c).alias(f"x{i}") for i, c in enumerate(used))).mapInArrow(products, "v array<double>")
    got = parts.select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()  # 3 x columns x columns
    total = np.zeros(3 * d * d)
    for r in got:
        total[r["k"]] = r["v"]
    n, one, two = total.reshape(3, d, d)
    return mean, np.where(n > 1, (two - one * one.T / np.maximum(n, 1)) / np.maximum(n - 1, 1), 0.0)


def principal_axes(df: DataFrame, used: list[str], n: int):
    """(means, loadings, variances, total variance); the matrix is columns x columns."""
    m, cov = _covariances(df, used)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][: n or None]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    return m, vectors * np.where(signs == 0, 1, signs), np.maximum(values[order], 0), float(np.trace(cov))
