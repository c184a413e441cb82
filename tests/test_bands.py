"""A table without groups gives what one group of all rows gives, however its sequence is cut."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import kernels, position
from millrace.operators import data, explore, feature, quality, validation
from millrace.operators.base import RID
from millrace.operators.windows import Spec, windows


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(10 * i + rng.randint(0, 9), float(rng.randint(0, 400)), rng.gauss(0, 1) + 5, rng.gauss(0, 2), None if rng.random() < 0.4 or 30 < i < 60 else rng.random(), i // 17 % 2, "one") for i in range(150)]
    return spark.createDataFrame(rows, f"{RID} long, t double, x double, y double, holes double, label long, g string").repartition(3)


def rows(df):
    drop = [c for c in ("series", "group_label") if c in df.columns]
    df = df.drop(*drop)
    key = lambda r: tuple(str(v) for v in r)
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=key)


def close(a, b):
    assert len(a) == len(b)
    for r, s in zip(a, b):
        for v, w in zip(r, s):
            assert v == w or (isinstance(v, float) and isinstance(w, float) and math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-9)), (r, s)


CASES = {
    "lags": lambda d, g: data.neighbor_features(d, columns=["x"], offsets=(1, 9, -2), group_column=g, time_column="t"),
    "season": lambda d, g: data.seasonal_difference(d, columns=["x"], period=24, group_column=g),
    "linear": lambda d, g: data.imputation(d, columns=["holes"], method="interpolate", group_column=g),
    "nearest": lambda d, g: data.imputation(d, columns=["holes"], method="interpolate", interpolation_method="nearest", group_column=g),
    "resample": lambda d, g: data.time_resample(d, time_column="t", frequency="5s", columns=["x"], group_column=g, fill_method="interpolate").drop(RID),
    "ffill": lambda d, g: data.time_resample(d, time_column="t", frequency="5s", columns=["x"], group_column=g, fill_method="ffill").drop(RID),
    "median": lambda d, g: feature.rolling_statistics(d, columns=["x"], method="median", window=7, group_column=g, time_column="t"),
    "repeat": lambda d, g: feature.rolling_statistics(d, columns=["label"], method="max_repeat", window=5, group_column=g),
    "temporal": lambda d, g: feature.temporal(d, columns=["x"], lag=2, window=11, group_column=g, column_features={"x": list(feature.TEMPORAL)}),
    "wavelet": lambda d, g: feature.wavelet(d, columns=["x"], window=16, group_column=g),
    "threshold": lambda d, g: explore.anomaly(d, columns=["x"], method="dynamic_threshold", window=9, group_column=g),
    "smoothing": lambda d, g: explore.anomaly(d, columns=["x"], method="hyperbolic_smoothing", window=9, group_column=g),
    "boxplot": lambda d, g: explore.anomaly(d, columns=["x"], method="boxplot", group_column=g),
    "acf": lambda d, g: explore.acf(d, columns=["x"], max_lag=12, group_column=g),
    "slopes": lambda d, g: explore.slope_cosine(d, first_column="x", second_column="y", window=8, group_column=g),
    "level": lambda d, g: validation.level_shift_detector(d, column="x", window=10, group_column=g)["prediction"],
    "volatility": lambda d, g: validation.volatility_shift_detector(d, column="x", window=10, group_column=g)["prediction"],
    "seasonal": lambda d, g: validation.seasonal_detector(d, column="x", period=12, group_column=g)["prediction"],
    "autoregression": lambda d, g: validation.autoregression_detector(d, column="x", group_column=g)["prediction"],
    "esd": lambda d, g: validation.esd_detector(d, column="x", group_column=g)["prediction"],
    "rolling": lambda d, g: validation.nsigma_detector(d, column="x", mode="rolling", window=9, group_column=g)["prediction"],
    "cusum": lambda d, g: validation.mean_drift_detector(d, column="x", group_column=g)["prediction"],
    "persistence": lambda d, g: validation.persistence_detector(d, column="x", threshold=5.0, group_column=g)["prediction"],
    "row windows": lambda d, g: windows(d, Spec(group_column=g, window_size=20, step=5)).features({"m": F.avg("x")}),
    "time windows": lambda d, g: windows(d, Spec(group_column=g, time_column="t", window_span="40s", step_span="15s")).features({"m": F.avg("x")}),
}


@pytest.mark.parametrize("case", CASES)
def test_one_sequence_in_bands(table, monkeypatch, case):
    monkeypatch.setattr(position, "BAND", 16)
    whole, banded = (rows(CASES[case](table, g)) for g in ("g", None))
    if case in ("acf", "resample", "ffill"):
        whole = [tuple(v for v in r if v != "one") for r in whole]
    close(whole, banded)


def test_label_changes_and_cross_relation(table, monkeypatch):
    monkeypatch.setattr(position, "BAND", 16)
    a, b = (quality.quality(table, columns=["x"], label_column="label", group_column=g)["label_changes"] for g in ("g", None))
    assert a["one"] == b["all"] == 8
    x, y = (np.array([r[0] for r in table.orderBy(RID).select(c).collect()]) for c in ("x", "y"))
    got = {r["lag"]: r for r in explore.cross_relation(table, first_column="x", second_column="y", max_lag=20).collect()}
    for k in range(-20, 21):
        u, v = (x[k:], y[: len(y) - k]) if k >= 0 else (x[:k], y[-k:])
        assert got[k]["sample_count"] == len(u) and got[k]["value"] == pytest.approx(np.corrcoef(u, v)[0, 1])


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "infinite", "constant"])
def test_exact_quantiles(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    x = {"normal": rng.normal(size=900), "ties": rng.integers(0, 5, 900).astype(float), "wide": np.exp(rng.normal(size=900) * 200), "infinite": np.r_[rng.normal(size=890), [np.inf] * 5, [-np.inf] * 5], "constant": np.full(900, 3.0)}[kind]
    df = spark.createDataFrame([(float(v), float(-v) if i % 3 else None) for i, v in enumerate(x)], "a double, b double")
    points = (0, 0.05, 0.25, 0.5, 0.731, 0.95, 1)
    columns = {"a": F.col("a"), "b": F.col("b"), "none": F.lit(None).cast("double")}
    want = position.exact_quantiles(df, columns, points)
    monkeypatch.setattr(position, "FEW", 50)
    monkeypatch.setattr(position, "BUCKETS", 8)
    got = position.exact_quantiles(df, columns, points)
    assert str(got) == str(want) and got["none"] == [None] * 7


def esd_by_definition(x, most, alpha):
    left, gone, found = np.ones(len(x), bool), [], 0
    for step in range(1, most + 1):
        v = x[left]
        n = len(v)
        s = v.std(ddof=1) if n > 2 else 0.0
        if s <= 0:
            break
        r = np.abs(x - v.mean()) / s
        r[~left] = -1
        k = int(np.argmax(r))
        t = kernels.t_quantile(1 - alpha / (2 * n), n - 2)
        left[k] = False
        gone.append(k)
        if r[k] > (n - 1) * t / math.sqrt(n * (n - 2 + t * t)):
            found = step
    out = np.zeros(len(x), bool)
    out[gone[:found]] = True
    return out


def test_esd_by_definition():
    rng = np.random.default_rng(6)
    for k in range(60):
        x = rng.normal(size=80)
        x[rng.integers(0, 80, 6)] += rng.choice([-1, 1], 6) * 10.0 ** rng.integers(1, 9)
        if k % 5 == 0:
            x = np.round(x)
        assert (kernels.esd(x, 12, 0.05) == esd_by_definition(x, 12, 0.05)).all()
    assert not kernels.esd(np.full(20, 2.0), 5, 0.05).any()


def test_spectral_bands_are_open_below():
    """A tone on a band edge lies in the lower band; a harmonic at the Nyquist frequency does not count."""
    t = np.arange(64)
    row = kernels.spectrum_row(np.sin(2 * np.pi * t / 4), 1.0, (0.5,), 0.02, 0.0)
    assert row["band_energy_ratio_0"] > 0.5 > row["band_energy_ratio_1"]
    assert row["harmonic_ratio"] == 0.0


def test_wide_covariances(spark):
    """Many columns, some with missing values, against the aggregation for few."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 20)) * 3 + 100
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(20)))
    used = [f"c{i}" for i in range(20)]
    mean, cov = feature._covariances(df, used)
    for at in (used[:10], used[10:]):
        m, c = feature._covariances(df, at)
        k = [used.index(u) for u in at]
        assert np.allclose(mean[k], m) and np.allclose(cov[np.ix_(k, k)], c)
