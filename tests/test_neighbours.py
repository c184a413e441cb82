"""Neighbour search against brute force: copies, ties, many blocks, new rows, empty tables."""

import numpy as np
import pytest

from millrace.functions import neighbours
from millrace.operators import validation
from millrace.operators.base import RID


def brute(x, ref, k):
    return np.array([np.sort(np.sqrt(((ref - v) ** 2).sum(1)))[:k].mean() for v in x])


def frame(spark, x):
    names = [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], f"{RID} long, " + ", ".join(f"{c} double" for c in names)), names


@pytest.mark.parametrize("width", [2, 9])
def test_knn_detector_measures_against_all_rows(spark, monkeypatch, width):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 1)  # blocks of 256 points
    monkeypatch.setattr(neighbours, "QUERIES", 300)
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.normal(size=(1200, width)), np.tile(rng.normal(size=width), (700, 1)), rng.normal(40, 1e-3, (600, width)), np.full((3, width), 90.0)])
    df, names = frame(spark, x)
    out = validation.knn_detector(df, columns=names, contamination=0.02)
    z = (x - x.mean(0)) / x.std(0)
    want = brute(z, z, 5)
    got = {r[RID]: (r["score"], r["is_anomaly"]) for r in out["prediction"].collect()}
    assert len(got) == len(x)
    assert np.allclose([got[i][0] for i in range(len(x))], want, rtol=1e-9, atol=1e-12)
    cut = np.quantile(want, 0.98)
    assert out["metrics"]["threshold"] == pytest.approx(cut) and out["metrics"]["anomalies"] == sum(a for _, a in got.values())
    new = np.concatenate([rng.normal(size=(40, width)), np.full((1, width), -500.0), x[:2]])
    fresh, _ = frame(spark, new)
    scored = {r[RID]: r["score"] for r in out["model"].predict(fresh).collect()}
    assert np.allclose([scored[i] for i in range(len(new))], brute((new - x.mean(0)) / x.std(0), z, 5), rtol=1e-9)


@pytest.mark.parametrize("metric", neighbours.METRICS)
def test_dbscan_detector_against_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 1)
    monkeypatch.setattr(neighbours, "QUERIES", 300)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(900, 2)), np.tile([[3.0, 3.0]], (400, 1)), rng.uniform(-9, 9, (60, 2))])
    df, names = frame(spark, x)
    out = validation.dbscan_detector(df, columns=names, eps=0.2, min_samples=6, metric=metric)
    z = (x - x.mean(0)) / x.std(0)
    gap = z[:, None, :] - z
    d = {"euclidean": np.sqrt((gap**2).sum(-1)), "manhattan": np.abs(gap).sum(-1), "chebyshev": np.abs(gap).max(-1)}[metric]
    core = (d <= 0.2).sum(1) >= 6
    want = d[:, core].min(1)
    want[want > 0.2] = np.inf
    got = {r[RID]: (r["score"], r["is_anomaly"]) for r in out["prediction"].collect()}
    assert np.allclose([got[i][0] for i in range(len(x))], want, rtol=1e-9, atol=1e-12)
    assert 0 < out["metrics"]["anomalies"] == np.isinf(want).sum() == sum(a for _, a in got.values())
    assert out["metrics"]["core"] == core.sum()


def test_few_rows_copies_and_missing_values(spark):
    df, names = frame(spark, np.array([[1.0], [1.0], [4.0]]))
    out = validation.knn_detector(df, columns=names, neighbors=9)
    got = {r[RID]: r["score"] for r in out["prediction"].collect()}
    far = 3 / np.std([1, 1, 4])
    assert got == pytest.approx({0: far / 3, 1: far / 3, 2: 2 * far / 3})
    holed = spark.createDataFrame([(0, None), (1, 4.0)], f"{RID} long, c0 double")
    assert {r[RID]: r["is_anomaly"] for r in out["model"].predict(holed).collect()} == {0: None, 1: True}


def test_an_empty_table_has_no_scores(spark):
    df = spark.createDataFrame([], f"{RID} long, c0 double")
    out = validation.knn_detector(df, columns=["c0"])
    assert out["prediction"].count() == 0 and out["metrics"]["anomalies"] == 0


def test_one_class_svm_of_more_rows_than_landmarks(spark, monkeypatch):
    """All rows decide: the function fitted in the span of a fifth of the rows is close to the exact one."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(5, 1, size=(900, 3)), rng.normal(5, 6, size=(30, 3))])
    df, names = frame(spark, x)
    exact = validation.one_class_svm(df, columns=names, nu=0.1)
    assert "gap" not in exact["metrics"]
    monkeypatch.setattr(validation, "LANDMARKS", 200)
    fitted = validation.one_class_svm(df, columns=names, nu=0.1)
    assert fitted["metrics"]["gap"] < validation.GAP
    a, b = ({r[RID]: r["score"] for r in m["prediction"].collect()} for m in (exact, fitted))
    assert 0.07 * len(x) <= fitted["metrics"]["anomalies"] <= 0.11 * len(x)
    assert np.corrcoef([a[i] for i in sorted(a)], [b[i] for i in sorted(b)])[0, 1] > 0.99
    assert sum((a[i] < 0) != (b[i] < 0) for i in a) <= 0.02 * len(x)


def test_one_class_svm_without_a_margin_ends(spark, monkeypatch):
    """Standardised columns lie around the origin, where a linear one-class function is zero."""
    df, names = frame(spark, np.random.default_rng(6).normal(size=(300, 3)))
    monkeypatch.setattr(validation, "LANDMARKS", 100)
    fitted = validation.one_class_svm(df, columns=names, nu=0.1, kernel="linear")
    assert fitted["metrics"]["gap"] < validation.GAP and fitted["metrics"]["anomalies"] <= 0.12 * 300
