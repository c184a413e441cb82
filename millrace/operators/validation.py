"""Validation operators: classifiers, regressors, forecasters and detectors.

Models are MLlib pipelines where MLlib has the estimator, else NumPy on bounded inputs (the
window table's sample); scoring is always distributed.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import kernels
from millrace.functions.neighbours import METRICS, Neighbours, squares
from millrace.functions.position import before_bands, exact_quantiles
from millrace.operators import evaluation as ev
from millrace.operators.base import RID, OperatorError, guard, in_order, need, num, numeric_columns, operator
from millrace.operators.explore import per_series
from millrace.operators.feature import feature_columns, principal_axes
from millrace.plans.durable import materialize, release

SPLITS = ("stratified", "group", "asset", "temporal")
MODEL_IN = "features:FeatureDataset labels:LabelVector"
MODEL_OUT = "model:Model prediction:Prediction metrics:Metrics"
DETECT_OUT = "model:Model prediction:Prediction metrics:Metrics"
#: Classes fitted against the rest at a time.
CLASSES_AT_ONCE = 4


class Classifier:
    """A fitted pipeline with its column order and class names."""

    def __init__(self, stages, columns: list[str], names: list[str]):
        self.stages, self.columns, self.names = stages, columns, names

    def predict(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in self.columns if c not in df.columns]:
            raise OperatorError(f"the model was trained with {missing}")
        return self.stages.transform(df)


def _table(features: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    used = feature_columns(features)
    table = features.drop("label").join(labels.select(RID, F.col("label").cast("string").alias("__y")), RID)
    if features.count() != table.count():
        raise OperatorError("features and labels are not aligned")
    bad = lambda c: num(c).isNull() | (F.abs(num(c)) == float("inf"))
    guard(table, **{f"c{i}": (bad(c), f"{c} has missing or infinite values") for i, c in enumerate(used)})
    return table, used


def _classify(features, labels, estimator, split_method, test_size, random_state, positive_class, class_weight=None, scaled=False, extra=()):
    table, used = _table(features, labels)
    if table.select("__y").distinct().count() < 2:
        raise OperatorError("a classifier needs two classes")
    train, test = ev.holdout(table, "__y", split_method, test_size, random_state)
    index = StringIndexer(inputCol="__y", outputCol="__i", stringOrderType="alphabetAsc", handleInvalid="keep").fit(table)
    names = list(index.labels)
    train = index.transform(train)
    if class_weight == "balanced":
        n = train.groupBy("__y").agg(F.count("*").alias("__k"))
        rows = train.count()
        w = n.select("__y", (F.lit(float(rows)) / (F.lit(float(len(names))) * F.col("__k"))).alias("__w"))
        train = train.join(F.broadcast(w), "__y")  # one row per class
        estimator = estimator.setWeightCol("__w")
    stages = [VectorAssembler(inputCols=used, outputCol="__raw" if scaled else "__v"), *extra]
    if scaled:
        stages.append(StandardScaler(inputCol="__x" if extra else "__raw", outputCol="__v", withMean=True))
    ready = Pipeline(stages=stages).fit(train)
    # estimators pass over their input many times: the vectors are made once
    vectors = materialize(ready.transform(train).select("__v", "__i", *(["__w"] if class_weight == "balanced" else [])), "vectors")
    fitted = estimator.setFeaturesCol("__v").setLabelCol("__i").setPredictionCol("__p").fit(vectors)
    model = PipelineModel([*ready.stages, fitted])
    scored = IndexToString(inputCol="__p", outputCol="prediction", labels=names).transform(model.transform(test))
    keep = [c for c in ("window_id",) if c in scored.columns]
    positive = positive_class or names[-1]
    score = vector_to_array("probability")[names.index(positive)] if "probability" in scored.columns else None
    pred = scored.select(RID, *keep, F.col("__y").alias("actual"), "prediction", *([score.alias("probability")] if score is not None else []))
    last = model.stages[-1]
    out = {"model": Classifier(model, used, names), "prediction": pred, "metrics": ev.classification_metrics(pred, positive)}
    if hasattr(last, "featureImportances"):
        ranked = list(zip(used, map(float, last.featureImportances.toArray())))
        out["importance"] = features.sparkSession.createDataFrame(ranked, "feature string, importance double")
    return out


@operator("validation.random_forest", MODEL_IN, MODEL_OUT + " importance:FeatureImportance", split_method=SPLITS)
def random_forest(features, labels, *, split_method="stratified", test_size=0.25, random_state=42, positive_class="", n_estimators=100, max_depth=None, min_samples_split=2, min_samples_leaf=1, class_weight=None):
    """Random forest classification under the holdout protocol."""
    from pyspark.ml.classification import RandomForestClassifier

    est = RandomForestClassifier(numTrees=n_estimators, maxDepth=max_depth or 12, minInstancesPerNode=max(min_samples_leaf, min_samples_split // 2), seed=random_state)
    return _classify(features, labels, est, split_method, test_size, random_state, positive_class, class_weight)


@operator("validation.decision_tree", MODEL_IN, MODEL_OUT + " importance:FeatureImportance", split_method=SPLITS, criterion=("gini", "entropy", "log_loss"))
def decision_tree(features, labels, *, split_method="stratified", test_size=0.25, random_state=42, positive_class="", criterion="gini", max_depth=None, min_samples_split=2, min_samples_leaf=1, class_weight=None):
    """Decision tree classification."""
    from pyspark.ml.classification import DecisionTreeClassifier

    est = DecisionTreeClassifier(impurity="gini" if criterion == "gini" else "entropy", maxDepth=max_depth or 12, minInstancesPerNode=max(min_samples_leaf, min_samples_split // 2), seed=random_state)
    return _classify(features, labels, est, split_method, test_size, random_state, positive_class, class_weight)


@operator("validation.xgboost", MODEL_IN, MODEL_OUT + " importance:FeatureImportance", split_method=SPLITS, objective=("auto", "binary:logistic", "multi:softprob"))
def boosted_trees(features, labels, *, split_method="stratified", test_size=0.25, random_state=42, positive_class="", n_estimators=100, max_depth=4, learning_rate=0.1, subsample=1.0, colsample_bytree=1.0, objective="auto"):
    """Gradient boosted trees; several classes go one against the rest."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    share = "all" if colsample_bytree >= 1 else str(colsample_bytree)
    est = GBTClassifier(maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, subsamplingRate=subsample, featureSubsetStrategy=share, seed=random_state)
    if objective != "binary:logistic" and labels.select("label").distinct().count() > 2:
        est = OneVsRest(classifier=est, parallelism=CLASSES_AT_ONCE)
    return _classify(features, labels, est, split_method, test_size, random_state, positive_class)


def _random_features(kernel: str, used: list[str], gamma: float | str, size: int, seed: int):
    """Random Fourier (rbf) or random tanh features of standardised inputs, as a transformer."""
    return ArrayMap(kernel=kernel, dims=len(used), gamma=1.0 / len(used) if gamma in ("scale", "auto") else float(gamma), size=size, seed=seed)



class ArrayMap(Transformer):
    """A fixed seeded map of the assembled vector: rbf, polynomial, sigmoid or echo-state features."""

    def __init__(self, kernel: str, dims: int, gamma: float = 1.0, size: int = 256, seed: int = 42, radius: float = 0.9, scale: float = 0.5, leak: float = 1.0, steps: int = 3):
        super().__init__()
        rng = np.random.default_rng(seed)
        self.kernel, self.leak, self.steps = kernel, leak, steps
        if kernel == "reservoir":
            self.w_in = rng.uniform(-scale, scale, (dims, size))
            self.bias = rng.uniform(-scale, scale, size)
            w = rng.normal(size=(size, size))
            self.w = w * (radius / (max(abs(np.linalg.eigvals(w))) or 1.0))
        else:
            self.w_in = rng.normal(size=(dims, size)) * math.sqrt(2 * gamma)
            self.bias = rng.uniform(0, 2 * np.pi, size)

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.kernel == "reservoir":
            state = np.zeros((len(x), self.w.shape[0]))
            for _ in range(self.steps):
                state = (1 - self.leak) * state + self.leak * np.tanh(x @ self.w_in + self.bias + state @ self.w)
            return state
        if self.kernel == "sigmoid":
            return np.tanh(x @ self.w_in + self.bias)
        if self.kernel == "poly":
            iu = np.triu_indices(x.shape[1])
            return np.hstack([x, (x[:, :, None] * x[:, None, :])[:, iu[0], iu[1]]])
        return np.cos(x @ self.w_in + self.bias) * math.sqrt(2 / self.w_in.shape[1])

    def _transform(self, df: DataFrame) -> DataFrame:
        fn = self.apply

        @F.pandas_udf("array<double>")
        def run(v: pd.Series) -> pd.Series:
            return pd.Series(list(fn(np.array(v.tolist(), float).reshape(len(v), -1))))

        from pyspark.ml.functions import array_to_vector

        return df.withColumn("__x", array_to_vector(run(vector_to_array("__s"))))


def _scaled_map(m: ArrayMap) -> list:
    return [StandardScaler(inputCol="__raw", outputCol="__s", withMean=True), m]


@operator("validation.svm", MODEL_IN, MODEL_OUT, split_method=SPLITS, kernel=("linear", "poly", "rbf", "sigmoid"))
def svm(features, labels, *, split_method="stratified", test_size=0.25, random_state=42, positive_class="", kernel="rbf", C=1.0, gamma="scale", class_weight=None, probability=True):
    """Support vector classification; kernels other than linear by seeded random features."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    used = feature_columns(features)
    est = LinearSVC(regParam=1.0 / (max(C, 1e-9) * 100), maxIter=100)
    if labels.select("label").distinct().count() > 2:
        est = OneVsRest(classifier=est, parallelism=CLASSES_AT_ONCE)
    extra = [] if kernel == "linear" else _scaled_map(_random_features(kernel, used, gamma, 256, random_state))
    return _classify(features, labels, est, split_method, test_size, random_state, positive_class, class_weight, True, extra)


@operator("validation.reservoir_classifier", MODEL_IN, MODEL_OUT, split_method=SPLITS)
def reservoir_classifier(features, labels, *, split_method="stratified", test_size=0.25, random_state=42, positive_class="", reservoir_size=50, spectral_radius=0.9, input_scale=0.5, leaking_rate=1.0, n_steps=3, C=1.0, max_iter=1000, class_weight=None):
    """Echo-state features with logistic regression."""
    from pyspark.ml.classification import LogisticRegression

    m = ArrayMap("reservoir", len(feature_columns(features)), size=reservoir_size, seed=random_state, radius=spectral_radius, scale=input_scale, leak=leaking_rate, steps=n_steps)
    est = LogisticRegression(regParam=1.0 / (max(C, 1e-9) * 100), maxIter=min(max_iter, 200))
    return _classify(features, labels, est, split_method, test_size, random_state, positive_class, class_weight, True, _scaled_map(m))


# --- regression -----------------------------------------------------------------------


class Linear:
    def __init__(self, columns: list[str], coefficients: np.ndarray, intercept: float):
        self.columns, self.coefficients, self.intercept = columns, coefficients, intercept

    def column(self):
        return sum((num(c) * F.lit(float(b)) for c, b in zip(self.columns, self.coefficients)), F.lit(float(self.intercept)))

    def predict(self, df: DataFrame) -> DataFrame:
        need(df, *self.columns)
        return df.withColumn("prediction", self.column())


def normal_equations(df: DataFrame, used: list[str], y: str):
    """(n, means of x, mean of y, centred X'X, centred X'y) from one aggregation."""
    pairs = [(i, j) for i in range(len(used)) for j in range(i, len(used))]
    row = df.agg(
        F.count("*").alias("n"), F.avg(y).alias("my"), *(F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(used)),
        *(F.covar_pop(num(used[i]), num(used[j])).alias(f"a{i}_{j}") for i, j in pairs), *(F.covar_pop(num(c), F.col(y)).alias(f"b{i}") for i, c in enumerate(used)),
    ).first()
    k = len(used)
    a = np.zeros((k, k))
    for i, j in pairs:
        a[i, j] = a[j, i] = row[f"a{i}_{j}"]
    return row["n"], np.array([row[f"m{i}"] for i in range(k)]), row["my"], a * row["n"], np.array([row[f"b{i}"] for i in range(k)]) * row["n"]


def fit_linear(df: DataFrame, used, y: str, alpha: float = 0.0, intercept: bool = True, positive: bool = False) -> Linear:
    n, mx, my, a, b = normal_equations(df, used, y)
    if not intercept:
        a, b = a + n * np.outer(mx, mx), b + n * mx * my
    a = a + alpha * np.eye(len(used))
    if positive:
        beta = np.zeros(len(used))
        for _ in range(2000):  # coordinate descent on the normal equations
            before = beta.copy()
            for i in range(len(used)):
                if a[i, i] > 0:
                    beta[i] = max(0.0, beta[i] + (b[i] - a[i] @ beta) / a[i, i])
            if np.abs(beta - before).max() < 1e-12:
                break
    else:
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
    return Linear(list(used), beta, float(my - mx @ beta) if intercept else 0.0)


def _regress(features, target, split_method, test_size, random_state, **fit):
    used = feature_columns(features)
    table = features.join(target.select(RID, F.col("label").cast("double").alias("__t")), RID)
    if split_method == "random":
        train, test = ev.hash_split(table, test_size, random_state)
    elif split_method == "group":
        train, test = ev.group_split(table.withColumn("__one", F.lit("1")), "group_label", "__one", test_size, random_state)
    else:
        train, test = ev.temporal_split(table, None, test_size)
    model = fit_linear(train, used, "__t", **fit)
    pred = model.predict(test).select(RID, F.col("__t").alias("actual"), "prediction")
    rank = features.sparkSession.createDataFrame([(c, float(b)) for c, b in zip(used, model.coefficients)], "feature string, importance double")
    return {"model": model, "prediction": pred, "metrics": ev.regression_metrics(pred).first().asDict(), "importance": rank}


@operator("validation.linear_regression", "features:FeatureDataset target:LabelVector", MODEL_OUT + " importance:FeatureImportance", split_method=("random", "group", "temporal"))
def linear_regression(features, target, *, split_method="random", test_size=0.25, random_state=42, fit_intercept=True, positive=False):
    """Least squares from normal equations."""
    return _regress(features, target, split_method, test_size, random_state, intercept=fit_intercept, positive=positive)


@operator("validation.ridge", "features:FeatureDataset target:LabelVector", MODEL_OUT + " importance:FeatureImportance", split_method=("random", "group", "temporal"))
def ridge(features, target, *, split_method="random", test_size=0.25, random_state=42, alpha=1.0, fit_intercept=True):
    """Ridge regression from normal equations."""
    return _regress(features, target, split_method, test_size, random_state, alpha=float(alpha), intercept=fit_intercept)


# --- forecasters ----------------------------------------------------------------------


class Forecaster:
    """One smoothed or autoregressive series per group; ``forecast`` gives (series, step, value)."""

    def __init__(self, df, columns, group, time, fn):
        self.args, self.fn = (df, columns, group, time), fn

    def forecast(self, steps: int) -> DataFrame:
        fn = self.fn
        return per_series(*self.args, lambda y: [{"step": k + 1, "value": float(v)} for k, v in enumerate(fn(y[~np.isnan(y)], steps))], "step long, value double")


def _forecast(df, column, test_size, group_column, time_column, fn):
    need(df, column, group_column, time_column)

    def score(y):
        y = y[~np.isnan(y)]
        h = max(1, int(round(len(y) * test_size)))
        got = fn(y[:-h], h)
        return [{"step": k + 1, "actual": float(a), "prediction": float(p)} for k, (a, p) in enumerate(zip(y[-h:], got))]

    pred = per_series(df, [column], group_column, time_column, score, "step long, actual double, prediction double")
    return {"model": Forecaster(df, [column], group_column, time_column, fn), "prediction": pred, "metrics": ev.regression_metrics(pred).first().asDict()}


@operator("validation.exponential_smoothing", "dataset:Dataset", MODEL_OUT, method=("holt", "holt_winters"), seasonal=("additive", "multiplicative"))
def exponential_smoothing(df, *, column, method="holt", alpha=0.3, beta=0.1, gamma=0.1, seasonal_periods=24, seasonal="additive", test_size=0.25, time_column=None, group_column=None):
    """Holt or Holt-Winters forecasts of each group's tail; the model refits on all rows of every group."""
    return _forecast(df, column, test_size, group_column, time_column, lambda y, h: kernels.smooth_forecast(y, h, method, alpha, beta, gamma, seasonal_periods, seasonal == "multiplicative"))


@operator("validation.arma", "dataset:Dataset", MODEL_OUT)
def arma(df, *, column, p=2, q=1, test_size=0.25, iterations=5, time_column=None, group_column=None):
    """ARMA by iterated least squares with a multi-step tail forecast of each group."""
    return _forecast(df, column, test_size, group_column, time_column, lambda y, h: kernels.arma_forecast(y, h, p, q, iterations))


@operator("validation.arima", "dataset:Dataset", MODEL_OUT)
def arima(df, *, column, order=(2, 1, 1), test_size=0.25, trend="c", time_column=None, group_column=None):
    """ARIMA: an ARMA fit of the differenced series, integrated back."""
    p, d, q = order

    def fn(y, h):
        levels = [y]
        for _ in range(d):
            levels.append(np.diff(levels[-1]))
        out = kernels.arma_forecast(levels[-1], h, p, q, 8)
        for k in range(d - 1, -1, -1):
            out = levels[k][-1] + np.cumsum(out)
        return out

    return _forecast(df, column, test_size, group_column, time_column, fn)


# --- unsupervised detectors -----------------------------------------------------------


class Detector:
    """A scoring function over columns with a threshold."""

    def __init__(self, columns, score, threshold: float, inclusive: bool, above: bool = True):
        self.columns, self.score, self.threshold, self.inclusive, self.above = columns, score, threshold, inclusive, above

    def predict(self, df: DataFrame) -> DataFrame:
        scored = df.withColumn("score", self.score)
        s, t = F.col("score"), F.lit(self.threshold)
        flag = (s >= t if self.inclusive else s > t) if self.above else s < t
        return scored.select(RID, "score", flag.alias("is_anomaly"))


def _scaling(df: DataFrame, used: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*(f.alias(n) for i, c in enumerate(used) for f, n in ((F.avg(num(c)), f"m{i}"), (F.stddev_pop(num(c)), f"s{i}")))).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(used)}


def _scaled(c: str, stat) -> F.Column:
    m, s = stat
    return (num(c) - F.lit(float(m))) / F.lit(float(s))


def _sample(df: DataFrame, used: list[str], n: int, seed: int = 42) -> np.ndarray:
    """The n rows of least hash (a documented, bounded sample), standardised columns given."""
    t = df.select(*used, RID).orderBy(F.xxhash64(RID, F.lit(seed)), RID).limit(n).select(*used).toPandas()
    return t.to_numpy(float)


def _array_udf(fn):
    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(fn(np.array(v.tolist(), float).reshape(len(v), -1)))

    return run


def _detect(df: DataFrame, columns, score_of, contamination: float | None, inclusive: bool, threshold: float | None = None):
    """Scores all rows; the threshold is an exact quantile of the scores unless given."""
    used = numeric_columns(df, columns)
    stat = _scaling(df, used)
    scaled = df.select(RID, *(_scaled(c, stat[c]).alias(c) for c in used))
    guard(scaled, **{f"c{i}": (F.col(c).isNull(), f"{c} has missing values") for i, c in enumerate(used)})
    fn = score_of(scaled, used)
    raw = F.array(*(_scaled(c, stat[c]) for c in used))
    score = _array_udf(fn)(raw) if callable(fn) and not isinstance(fn, F.Column) else fn
    scored = df.withColumn("__s", score)
    if threshold is None:
        threshold = exact_quantiles(scored, {"s": F.col("__s")}, (1 - contamination,))["s"][0]
    model = Detector(used, score, float(threshold), inclusive)
    pred = model.predict(df)
    n, hit = pred.agg(F.count("*"), F.count_if("is_anomaly")).first()
    return {"model": model, "prediction": pred, "metrics": {"rows": n, "anomalies": hit, "threshold": float(threshold)}}


class NeighbourDetector(Detector):
    """Mean distance to the nearest training rows, searched rather than computed from columns."""

    def __init__(self, columns, stat, search: Neighbours, neighbors: int):
        super().__init__(columns, None, math.inf, True)
        self.stat, self.search, self.neighbors = stat, search, neighbors

    def scored(self, df: DataFrame) -> DataFrame:
        x = F.array(*(_scaled(c, self.stat[c]) for c in self.columns))
        rows = df.select(RID, F.when(~F.exists(x, lambda v: v.isNull()), x).alias("x"))
        return rows.join(self.search.mean_distance(rows.where("x is not null"), self.neighbors), "x", "left").select(RID, "score")

    def predict(self, df: DataFrame, scored: DataFrame | None = None) -> DataFrame:
        scored = self.scored(df) if scored is None else scored
        return scored.select(RID, "score", (F.col("score") >= F.lit(self.threshold)).alias("is_anomaly"))


@operator("validation.knn_detector", "dataset:Dataset", DETECT_OUT)
def knn_detector(df, *, columns=(), contamination=0.05, neighbors=5):
    """Mean distance to the nearest of all rows (a row itself included), exact at every size."""
    used = numeric_columns(df, columns)
    stat = _scaling(df, used)
    scaled = df.select(RID, *(_scaled(c, stat[c]).alias(c) for c in used))
    guard(scaled, **{f"c{i}": (F.col(c).isNull(), f"{c} has missing values") for i, c in enumerate(used)})
    model = NeighbourDetector(used, stat, Neighbours(scaled.select(F.array(*used).alias("x")), len(used)), min(neighbors, max(1, df.count())))
    scored = materialize(model.scored(df), "scored")
    if (cut := exact_quantiles(scored, {"s": F.col("score")}, (1 - contamination,))["s"][0]) is not None:
        model.threshold = float(cut)
    pred = model.predict(df, scored)
    n, hit = pred.agg(F.count("*"), F.count_if("is_anomaly")).first()
    return {"model": model, "prediction": pred, "metrics": {"rows": n, "anomalies": hit, "threshold": model.threshold}}


@operator("validation.isolation_forest_detector", "dataset:Dataset", DETECT_OUT)
def isolation_forest_detector(df, *, columns=(), contamination=0.05, random_state=42, n_estimators=100):
    """Isolation forest: every tree grows on 256 rows, as the method has it, out of a seeded draw of 256 a tree."""

    def fit(scaled, used):
        rng = np.random.default_rng(random_state)
        pool = _sample(scaled, used, 256 * n_estimators, random_state)
        size = min(256, len(pool))
        deep = max(1, math.ceil(math.log2(max(size, 2))))
        norm = lambda n: 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

        def grow(x, depth):
            width = np.ptp(x, axis=0) if len(x) else np.zeros(pool.shape[1])
            if depth >= deep or len(x) < 2 or not width.any():
                return depth + norm(len(x))
            c = int(rng.choice(np.flatnonzero(width > 0)))
            at = float(rng.uniform(x[:, c].min(), x[:, c].max()))
            left = x[:, c] < at
            return c, at, grow(x[left], depth + 1), grow(x[~left], depth + 1)

        trees = [grow(pool[rng.choice(len(pool), size, replace=False)], 0) for _ in range(n_estimators)]

        def walk(tree, x, rows, out):
            if not isinstance(tree, tuple):
                out[rows] += tree
                return
            c, at, a, b = tree
            left = x[rows, c] < at
            if left.any():
                walk(a, x, rows[left], out)
            if not left.all():
                walk(b, x, rows[~left], out)

        def fn(x):
            depth = np.zeros(len(x))
            for t in trees:
                walk(t, x, np.arange(len(x)), depth)
            return 2.0 ** (-depth / len(trees) / max(norm(size), 1e-9))

        return fn

    return _detect(df, columns, fit, contamination, True)


@operator("validation.pca_detector", "dataset:Dataset", DETECT_OUT)
def pca_detector(df, *, columns=(), n_components=0, contamination=0.05, random_state=42):
    """Reconstruction error of the leading components (0: 95 % of the variance)."""

    def fit(scaled, used):
        mean, vectors, values, total = principal_axes(scaled, used, len(used))
        k = n_components or int(np.searchsorted(np.cumsum(values) / max(total, 1e-300), 0.95) + 1)
        keep = vectors[:, : min(k, len(used))]
        rest = np.eye(len(used)) - keep @ keep.T
        mean = np.array(mean, float)
        return lambda x: (((x - mean) @ rest) ** 2).mean(1)

    return _detect(df, columns, fit, contamination, False)


def fit_kmeans_centres(scaled: DataFrame, used, n_clusters: int, max_clusters: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    v = VectorAssembler(inputCols=used, outputCol="features").transform(scaled).select("features").cache()
    fit = lambda k: KMeans(k=k, seed=seed).fit(v)
    if n_clusters:
        model = fit(n_clusters)
    else:
        judge = ClusteringEvaluator()
        model = max((fit(k) for k in range(2, max_clusters + 1)), key=lambda m: judge.evaluate(m.transform(v)))
    v.unpersist()
    return np.array(model.clusterCenters())


def _nearest(centres):
    return lambda x: np.sqrt(((x[:, None, :] - centres) ** 2).sum(-1)).min(1)


@operator("validation.min_cluster_detector", "dataset:Dataset", DETECT_OUT)
def min_cluster_detector(df, *, columns=(), n_clusters=0, contamination=0.05, max_clusters=8, batch_size=1024, silhouette_sample=5000, random_state=42):
    """Distance to the nearest cluster centre."""
    return _detect(df, columns, lambda s, used: _nearest(fit_kmeans_centres(s, used, n_clusters, max_clusters, random_state)), contamination, False)


@operator("validation.kmeans", "dataset:Dataset|FeatureDataset", DETECT_OUT)
def kmeans(df, *, columns=(), n_clusters=0, max_clusters=8, batch_size=1024, silhouette_sample=5000, random_state=42):
    """Cluster labels and distances; the number of clusters by silhouette when 0."""
    used = numeric_columns(df, columns)
    stat = _scaling(df, used)
    scaled = df.select(RID, *(_scaled(c, stat[c]).alias(c) for c in used))
    centres = fit_kmeans_centres(scaled, used, n_clusters, max_clusters, random_state)
    x = F.array(*(_scaled(c, stat[c]) for c in used))
    near = _array_udf(lambda v: ((v[:, None, :] - centres) ** 2).sum(-1).argmin(1).astype(float))(x).cast("int")
    pred = df.select(RID, near.alias("cluster"), _array_udf(_nearest(centres))(x).alias("distance"))
    sizes = {r["cluster"]: r["n"] for r in pred.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    return {"model": centres, "prediction": pred, "metrics": {"clusters": len(centres), "sizes": sizes}}


#: Rows whose kernels span the one-class function; up to as many rows it is the exact dual solution.
LANDMARKS = 1000
#: Passes over all rows and the relative duality gap that end a fit early; the metrics give the gap reached.
PASSES, GAP = 60, 1e-3
#: Rows whose kernel values are held at once.
KERNEL_ROWS = 512


def _least_weights(gram: np.ndarray, cap: float, tolerance: float, moves: int) -> np.ndarray:
    """Weights up to ``cap`` with sum 1 of least ``a @ gram @ a``, moved between the most violating pair."""
    a = np.full(len(gram), 1 / len(gram))
    grad = gram @ a
    for _ in range(moves):
        up, down = np.where(a < cap - 1e-12, grad, np.inf), np.where(a > 1e-12, grad, -np.inf)
        i, j = int(np.argmin(up)), int(np.argmax(down))
        if down[j] - up[i] < tolerance:
            break
        curve = max(gram[i, i] + gram[j, j] - 2 * gram[i, j], 1e-12)
        d = min((grad[j] - grad[i]) / curve, cap - a[i], a[j])
        a[i] += d
        a[j] -= d
        grad += d * (gram[:, i] - gram[:, j])
    return a


def _in_parts(fn):
    """``fn`` over ``KERNEL_ROWS`` rows at a time."""
    return lambda v: np.concatenate([fn(v[at : at + KERNEL_ROWS]) for at in range(0, max(len(v), 1), KERNEL_ROWS)])


def _whole_margin(points: DataFrame, total: int, z: np.ndarray, kern, nu: float, c: np.ndarray):
    """(coefficients, offset, gap, passes) of the one-class function of all rows in the span of z.

    The dual is the shortest vector of the hull of means of ``nu * total`` rows. Every pass adds
    the mean of the rows that lie lowest under the present function; the best mixture of the
    means so far is a small problem of the driver.
    """
    spark, share = points.sparkSession, nu * total
    own = kern(z, z)
    least = 1e-3 * float(np.diag(own).mean())  # a hull that holds the origin has no margin: its size goes to 0
    values, axes = np.linalg.eigh(own)
    keep = values > 1e-10 * values[-1]
    inverse = (axes[:, keep] / values[keep]) @ axes[:, keep].T
    means, lead, gap = [], None, math.inf
    for done in range(PASSES + 1):
        scored = materialize(points.select(_array_udf(_in_parts(lambda v: kern(v, z) @ c))("x").alias("f")), "margin", "one_class")
        rank = min(total, max(1, math.ceil(share))) - 1
        rho = float(exact_quantiles(scored, {"f": F.col("f")}, (rank / max(1, total - 1),))["f"][0])
        release(spark, "one_class")
        if done == PASSES or gap < GAP:
            return c, rho, gap, done
        near = 1e-9 * abs(rho) + 1e-15

        def run(batches):
            low, even = np.zeros(len(z) + 1), np.zeros(len(z) + 1)  # the last slot counts rows
            for t in batches:
                for at in range(0, len(t), KERNEL_ROWS):
                    k = kern(np.array(t["x"].iloc[at : at + KERNEL_ROWS].tolist(), float), z)
                    f, k = k @ c, np.c_[k, np.ones(len(k))]
                    low += k[f < rho - near].sum(0)
                    even += k[np.abs(f - rho) <= near].sum(0)
            yield pd.DataFrame({"slot": np.arange(len(low)), "low": low, "even": even})

        sums = points.mapInPandas(run, "slot long, low double, even double").groupBy("slot").agg(F.sum("low").alias("low"), F.sum("even").alias("even")).toPandas().sort_values("slot")
        low, even = sums["low"].to_numpy(), sums["even"].to_numpy()
        mean = ((low + even * (share - low[-1]) / max(even[-1], 1.0)) / share)[:-1]  # equal rows share what is left
        if lead is not None:
            size = float(lead @ inverse @ lead)
            gap = (size - float(mean @ c)) / max(size, least)
            if gap < GAP:
                return c, rho, gap, done
        means.append(mean)
        m = np.array(means)
        gram = m @ inverse @ m.T
        lead = _least_weights(gram, 1.0, 1e-9 * float(np.abs(gram).max()), 20_000) @ m
        c = inverse @ lead


@operator("validation.one_class_svm", "dataset:Dataset", DETECT_OUT, kernel=("rbf", "linear", "poly", "sigmoid"))
def one_class_svm(df, *, columns=(), nu=0.05, kernel="rbf", gamma="scale"):
    """One-class decision values (negative is anomalous) that every row helps to fix.

    Up to ``LANDMARKS`` rows the dual is solved exactly. Beyond them the function is a combination of
    the kernels of as many rows of least hash, fitted by passes over all rows.
    """
    used = numeric_columns(df, columns)
    stat = _scaling(df, used)
    scaled = df.select(RID, *(_scaled(c, stat[c]).alias(c) for c in used))
    z, total = _sample(scaled, used, LANDMARKS), scaled.count()
    g = 1 / len(used) if gamma in ("scale", "auto") else float(gamma)
    kern = {
        "rbf": lambda a, b: np.exp(-g * squares(a, b)), "linear": lambda a, b: a @ b.T,
        "poly": lambda a, b: (g * a @ b.T) ** 3, "sigmoid": lambda a, b: np.tanh(g * a @ b.T),
    }[kernel]
    k, cap = kern(z, z), 1 / (nu * max(len(z), 1))
    c = _least_weights(k, cap, 1e-6, 5000)
    fit = {}
    if total > len(z):
        points = materialize(scaled.select(F.array(*used).alias("x")), "points")
        c, rho, gap, passes = _whole_margin(points, total, z, kern, nu, c)
        fit = {"gap": gap, "passes": passes}
    else:
        grad = k @ c
        inner = (c > 1e-9) & (c < cap - 1e-9)
        rho = float(grad[inner].mean() if inner.any() else np.quantile(grad, nu))
    live = np.abs(c) > 1e-12
    sv, w = z[live], c[live]
    score = _array_udf(_in_parts(lambda v: kern(v, sv) @ w - rho))(F.array(*(_scaled(c, stat[c]) for c in used)))
    model = Detector(used, score, 0.0, False, above=False)
    pred = model.predict(df)
    total, hit = pred.agg(F.count("*"), F.count_if("is_anomaly")).first()
    return {"model": model, "prediction": pred, "metrics": {"rows": total, "anomalies": hit, "support_vectors": int(live.sum())} | fit}


@operator("validation.dbscan_detector", "dataset:Dataset", DETECT_OUT, metric=METRICS)
def dbscan_detector(df, *, columns=(), eps=1.0, min_samples=5, metric="euclidean"):
    """Distance to the nearest core row; rows farther than eps are anomalies."""
    used = numeric_columns(df, columns)
    stat = _scaling(df, used)
    scaled = df.select(RID, F.array(*(_scaled(c, stat[c]) for c in used)).alias("x"))
    guard(scaled, missing=(F.exists("x", lambda v: v.isNull()), "a column has missing values"))
    reach, core = Neighbours(scaled, len(used), metric).nearest_core(eps, min_samples)
    pred = materialize(scaled.join(reach, "x", "left").select(RID, F.coalesce("score", F.lit(math.inf)).alias("score"), F.col("score").isNull().alias("is_anomaly")), "scored")
    n, hit = pred.agg(F.count("*"), F.count_if("is_anomaly")).first()
    return {"model": {"eps": eps, "columns": used, "scaling": stat}, "prediction": pred, "metrics": {"rows": n, "anomalies": hit, "core": core}}


# --- change detectors -----------------------------------------------------------------


def _series(df, column, group_column, time_column, back=0, ahead=0):
    """(rows, window, finish): rows with value x, group g, position and the group's count n.

    The window reaches ``back`` and ``ahead`` rows; ``finish`` must be called on framed rows.
    Missing values are an error.
    """
    need(df, group_column, time_column)
    numeric_columns(df, [column])
    g = [F.coalesce(F.col(group_column).cast("string"), F.lit("<missing>")).alias("g")] if group_column else [F.lit("all").alias("g")]
    d = df.select(RID, *g, *([F.col(time_column).alias("__t")] if time_column else []), num(column).alias("x"))
    guard(d, bad=(F.col("x").isNull(), f"{column} has missing values"))
    d, w, finish = in_order(d, "g" if group_column else None, "__t" if time_column else None, back, ahead)
    if not group_column:
        return d.withColumns({"pos": F.col("__pos"), "n": F.lit(df.count())}), w, finish
    return d.withColumns({"pos": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("g"))}), w, finish


def _flagged(d: DataFrame, threshold: float) -> dict:
    pred = d.select(RID, F.col("g").alias("series"), "pos", "score", F.coalesce(F.col("score") > threshold, F.lit(False)).alias("is_anomaly"))
    per = pred.groupBy("series").agg(F.count("*").alias("rows"), F.count_if("is_anomaly").alias("anomalies"), F.max("score").alias("max_score"), F.min(F.when(F.col("is_anomaly"), F.col("pos"))).alias("first_alarm"))
    return {"model": {"threshold": threshold}, "prediction": pred.drop("pos"), "metrics": per}


@operator("validation.level_shift_detector", "dataset:Dataset", DETECT_OUT)
def level_shift_detector(df, *, column, window=20, threshold=4.0, group_column=None, time_column=None):
    """Welch t of the rows before and after each split."""
    d, w, finish = _series(df, column, group_column, time_column, window, window - 1)
    a, b = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
    full = (F.col("pos") >= window) & (F.col("pos") <= F.col("n") - window)
    d = d.withColumns({"__e": F.sqrt(F.var_samp("x").over(a) / window + F.var_samp("x").over(b) / window), "__d": F.abs(F.avg("x").over(b) - F.avg("x").over(a))})
    return _flagged(finish(d).withColumn("score", F.when(full & (F.col("__e") > 0), F.col("__d") / F.col("__e"))), threshold)


VARIANCE_FLOOR = 1e-12


@operator("validation.volatility_shift_detector", "dataset:Dataset", DETECT_OUT)
def volatility_shift_detector(df, *, column, window=20, threshold=4.0, group_column=None, time_column=None):
    """Log variance ratio of the rows before and after, in standard errors."""
    d, w, finish = _series(df, column, group_column, time_column, window, window - 1)
    a, b = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
    full = (F.col("pos") >= window) & (F.col("pos") <= F.col("n") - window)
    d = finish(d.withColumns({"__a": F.var_samp("x").over(a), "__b": F.var_samp("x").over(b)}))
    floor = VARIANCE_FLOOR * F.greatest(F.coalesce(F.var_samp("x"), F.lit(0.0)), F.lit(1.0))
    d = d.join(d.groupBy("g").agg(floor.alias("__f")), "g")
    ratio = F.abs(F.ln((F.col("__b") + F.col("__f")) / (F.col("__a") + F.col("__f")))) / math.sqrt(2 / max(window - 1, 1))
    return _flagged(d.withColumn("score", F.when(full, ratio)), threshold)


def _robust(d: DataFrame, x: str, rows, out: str) -> DataFrame:
    """(g, out): 1.4826 times the median absolute deviation of ``x`` over ``rows``."""
    part = d.where(rows)
    mid = part.groupBy("g").agg(F.percentile(x, F.lit(0.5)).alias("__mid"))
    return part.join(mid, "g").groupBy("g").agg((1.4826 * F.percentile(F.abs(F.col(x) - F.col("__mid")), F.lit(0.5))).alias(out))


@operator("validation.seasonal_detector", "dataset:Dataset", DETECT_OUT)
def seasonal_detector(df, *, column, period=24, threshold=4.0, reference_fraction=0.5, group_column=None, time_column=None):
    """Distance to the phase medians of the leading reference rows, in robust spreads."""
    d, _, finish = _series(df, column, group_column, time_column)
    d = finish(d)
    edge = F.greatest(F.lit(period), F.floor(F.col("n") * reference_fraction)).cast("int")
    d = d.withColumns({"phase": F.col("pos") % period, "__ref": F.col("pos") < edge, "__edge": edge})
    guard(d, short=((F.col("n") < 2 * period) | (F.col("__edge") >= F.col("n")), "a series needs two periods and a shorter reference"))
    profile = d.where("__ref").groupBy("g", "phase").agg(F.percentile("x", F.lit(0.5)).alias("__p"))
    d = d.join(profile, ["g", "phase"]).withColumn("__r", F.col("x") - F.col("__p"))
    d = d.join(_robust(d, "__r", F.col("__ref"), "__s"), "g").join(_robust(d, "x", F.lit(True), "__w"), "g")
    scale = F.when(F.col("__s") > 0, F.col("__s")).otherwise(F.col("__w"))
    return _flagged(d.withColumn("score", F.when(scale > 0, F.abs("__r") / scale).otherwise(0.0)), threshold)


@operator("validation.autoregression_detector", "dataset:Dataset", DETECT_OUT)
def autoregression_detector(df, *, column, order=2, threshold=4.0, train_fraction=0.5, group_column=None, time_column=None):
    """One-step residuals of an autoregression fitted on the leading rows, in robust spreads."""
    d, w, finish = _series(df, column, group_column, time_column, order)
    edge = F.floor(F.col("n") * train_fraction)
    d = finish(d.withColumns({f"l{k}": F.lag("x", k).over(w) for k in range(1, order + 1)} | {"__train": F.col("pos") < edge}))
    guard(d, short=((edge <= order + 2) | (F.col("n") - edge < 2), "a series has too few training rows"))
    lags = [f"l{k}" for k in range(1, order + 1)]
    pairs = [(i, j) for i in range(order) for j in range(i, order)]
    fit = d.where("__train").where(f"pos >= {order}").groupBy("g").agg(
        F.avg("x").alias("my"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(lags)),
        *(F.covar_pop(lags[i], lags[j]).alias(f"a{i}_{j}") for i, j in pairs), *(F.covar_pop(c, "x").alias(f"b{i}") for i, c in enumerate(lags)),
    )

    @F.pandas_udf("array<double>")
    def solve(t: pd.DataFrame) -> pd.Series:
        out = []
        for r in t.to_dict("records"):
            a = np.zeros((order, order))
            for i, j in pairs:
                a[i, j] = a[j, i] = r[f"a{i}_{j}"]
            beta = np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(order)]), rcond=None)[0]
            out.append([float(r["my"] - sum(beta[i] * r[f"m{i}"] for i in range(order))), *map(float, beta)])
        return pd.Series(out)

    beta = fit.select("g", solve(F.struct(*[c for c in fit.columns if c != "g"])).alias("beta"))
    d = d.join(beta, "g")
    d = d.withColumn("__r", F.col("x") - sum((F.get("beta", F.lit(i + 1)) * F.col(c) for i, c in enumerate(lags)), F.get("beta", F.lit(0))))
    d = d.join(_robust(d, "__r", F.col("__train") & (F.col("pos") >= order), "__s"), "g")
    return _flagged(d.withColumn("score", F.when(~F.col("__train") & (F.col("__s") > 0), F.abs("__r") / F.col("__s"))), threshold)


@operator("validation.esd_detector", "dataset:Dataset", DETECT_OUT)
def esd_detector(df, *, column, max_outlier_fraction=0.1, alpha=0.05, group_column=None, time_column=None):
    """Generalised extreme studentised deviate test per group."""
    d, _, finish = _series(df, column, group_column, time_column)
    d = finish(d)

    def run(key, t: pd.DataFrame) -> pd.DataFrame:
        x = t["x"].to_numpy(float)
        hit = kernels.esd(x, max(1, int(len(x) * max_outlier_fraction)), alpha)
        s = x.std(ddof=1) if len(x) > 1 else 0.0
        t["score"] = np.where(hit, np.abs(x - x.mean()) / s if s > 0 else 0.0, 0.0)
        return t[[RID, "g", "pos", "score"]]

    scored = d.select(RID, "g", "pos", "x").groupBy("g").applyInPandas(run, f"{RID} long, g string, pos long, score double")
    return _flagged(scored, 0.0)


@operator("validation.nsigma_detector", "dataset:Dataset", DETECT_OUT, mode=("global", "group", "rolling"))
def nsigma_detector(df, *, column, sigma=3.0, mode="global", window=30, group_column=None, time_column=None):
    """Distance to the mean in population standard deviations: of all rows, the group, or trailing rows."""
    d, w, finish = _series(df, column, group_column, time_column, window - 1 if mode == "rolling" else 0)
    if mode == "rolling":
        f = w.rowsBetween(-(window - 1), 0)
        d = finish(d.withColumns({"__m": F.avg("x").over(f), "__s": F.stddev_pop("x").over(f), "__k": F.count("x").over(f)}))
        ok = (F.col("__k") >= max(2, window // 2)) & (F.col("__s") > 0)
        return _flagged(d.withColumn("score", F.when(ok, F.abs(F.col("x") - F.col("__m")) / F.col("__s"))), sigma)
    d = finish(d)
    if mode == "group":
        if not group_column:
            raise OperatorError("mode group needs group_column")
        d = d.join(d.groupBy("g").agg(F.avg("x").alias("__m"), F.stddev_pop("x").alias("__s")), "g")
    else:
        m, s = d.agg(F.avg("x"), F.stddev_pop("x")).first()
        d = d.withColumns({"__m": F.lit(m).cast("double"), "__s": F.lit(s).cast("double")})
    return _flagged(d.withColumn("score", F.when(F.col("__s") > 0, F.abs(F.col("x") - F.col("__m")) / F.col("__s")).otherwise(0.0)), sigma)


@operator("validation.mean_drift_detector", "dataset:Dataset", DETECT_OUT)
def mean_drift_detector(df, *, column, reference_fraction=0.3, slack=0.5, decision=5.0, group_column=None, time_column=None, compat=False):
    """Two-sided CUSUM against the reference mean, in closed form over running sums.

    An arm that restarts at 0 equals S - min(0, running min S). ``compat`` gives the lower arm
    the upper arm's deviation, as some implementations do.
    """
    d, w, finish = _series(df, column, group_column, time_column)
    edge = F.floor(F.col("n") * reference_fraction)
    guard(d, short=((edge < 3) | (F.col("n") - edge < 2), "the reference is too short"))
    ref = d.where(F.col("pos") < edge).groupBy("g").agg(F.avg("x").alias("__m"), F.stddev_samp("x").alias("__s"))
    guard(ref, flat=(F.col("__s") <= 0, "the reference is constant"))
    d = d.join(ref, "g")
    live = F.col("pos") >= edge
    z = (F.col("x") - F.col("__m")) / F.col("__s")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"__u": F.when(live, z - slack).otherwise(0.0), "__l": F.when(live, z - slack if compat else z + slack).otherwise(0.0)})
    d = d.withColumns({"__su": F.sum("__u").over(run), "__sl": F.sum("__l").over(run)})
    least, most = F.min("__su").over(run), F.max("__sl").over(run)
    if not group_column:  # sums and their extremes go on from band to band
        d = d.join(before_bands(d, sum_u=F.sum("__u"), sum_l=F.sum("__l")), "__band").fillna(0.0, ["sum_u", "sum_l"])
        d = d.withColumns({"__su": F.col("__su") + F.col("sum_u"), "__sl": F.col("__sl") + F.col("sum_l")})
        d = d.join(before_bands(d, min_u=F.min("__su"), max_l=F.max("__sl")), "__band")
        least, most = F.least(least, "min_u"), F.greatest(most, "max_l")  # nulls of the first band are skipped
    up = F.col("__su") - F.least(F.lit(0.0), least)
    low = F.col("__sl") - F.greatest(F.lit(0.0), most)
    return _flagged(finish(d.withColumn("score", F.when(live, F.greatest(up, -low)))), decision)


@operator("validation.persistence_detector", "dataset:Dataset", DETECT_OUT, direction=("above", "below", "absolute"))
def persistence_detector(df, *, column, threshold, direction="above", min_consecutive=3, group_column=None):
    """Flag rows where the last n rows of the group all breach the threshold."""
    d, w, finish = _series(df, column, group_column, None, min_consecutive - 1)
    x = F.col("x")
    breach = {"above": x > threshold, "below": x < threshold, "absolute": F.abs(x) > threshold}[direction].cast("int")
    runs = F.sum(breach).over(w.rowsBetween(-(min_consecutive - 1), 0))
    return _flagged(finish(d.withColumn("score", F.when(runs >= min_consecutive, 1.0).otherwise(0.0))), 0.5)


# --- search and comparison ------------------------------------------------------------

ALGORITHMS = {
    "random_forest": random_forest, "svm": svm, "xgboost": boosted_trees, "decision_tree": decision_tree,
    "linear_regression": linear_regression, "ridge": ridge,
}


@operator("validation.grid_search", MODEL_IN, "model:Model metrics:Metrics importance:FeatureImportance?", algorithm=tuple(ALGORITHMS), cv_method=("stratified", "group", "temporal"))
def grid_search(features, labels, *, algorithm="random_forest", param_grid=None, cv_method="stratified", cv_folds=3, scoring="", top_k=5):
    """Every combination of the grid by mean validation score over hashed, grouped or contiguous folds."""
    grid = param_grid or {"n_estimators": [100, 300], "max_depth": [4, 8]}
    names = sorted(grid)
    regression = algorithm in ("linear_regression", "ridge")
    metric = scoring or ("r2" if regression else "macro_f1")
    method = {"stratified": "random" if regression else "stratified", "group": "group", "temporal": "temporal"}[cv_method]
    rows = []
    for values in itertools.product(*(grid[k] for k in names)):
        params = dict(zip(names, values))
        scores = [ALGORITHMS[algorithm](features, labels, split_method=method, test_size=1 / cv_folds, random_state=seed, **params)["metrics"][metric] for seed in range(1 if cv_method == "temporal" else cv_folds)]
        rows.append((float(np.mean(scores)), float(np.std(scores)), params))
    rows.sort(key=lambda r: -r[0])
    best = ALGORITHMS[algorithm](features, labels, split_method=method, **rows[0][2])
    table = [{"rank": i + 1, "score": s, "spread": d, "params": p} for i, (s, d, p) in enumerate(rows[:top_k])]
    return {"model": best["model"], "metrics": {"metric": metric, "best": rows[0][2], "score": rows[0][0], "table": table}, "importance": best.get("importance")}


@operator("validation.compare", "first:Metrics second:Metrics third:Metrics?", "comparison:Statistics")
def compare(*metrics):
    """Metrics side by side; they must come from one test set (equal row counts)."""
    got = [m for m in metrics if m is not None]
    if len({m.get("rows") for m in got}) > 1:
        raise OperatorError("the metrics come from different test sets")
    keys = [k for k in got[0] if all(k in m for m in got)]
    return {k: [m[k] for m in got] for k in keys}
