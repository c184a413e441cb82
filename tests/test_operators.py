import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import kernels
from millrace.functions.durations import seconds
from millrace.functions.expr import compile_expression
from millrace.functions.stats import STATISTICS
from millrace.operators import data, evaluation, explore, feature, validation, visual
from millrace.operators.base import OPERATORS, RID, OperatorError
from millrace.plans import catalog


def frame(spark, schema, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{RID} long, {schema}")


def values(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy(RID).select(*columns).collect()]


def test_catalogue_is_complete():
    by = {}
    for o in OPERATORS.values():
        by[o.category] = by.get(o.category, 0) + 1
    assert by == {"data": 20, "explore": 19, "visual": 8, "feature": 14, "validation": 27}
    assert len(STATISTICS) == 36


def test_durations():
    assert seconds("7d") == 604800 and seconds("30m") == 1800 and seconds("") == 0 and seconds(5) == 5
    with pytest.raises(ValueError):
        seconds("3 moons")


def test_expression_language(spark):
    df = frame(spark, "a double, b double", [(7.0, -3.0), (1.0, 0.0), (-1.0, 2.0)])
    e = lambda t: values(df.withColumn("v", compile_expression(t, {"a", "b"})), "v")
    assert e("a % b") == [-2.0, None, 1.0]
    assert e("a / b")[1] is None and e("log(a)")[2] is None and e("sqrt(a)")[2] is None
    assert e("-a ** 2 + abs(b)") == [-46.0, -1.0, 1.0]
    for bad in ("c", "a.b", "__import__('os')", "a ** b", "a ** 11", "1e13", "a if b else a", "True", ""):
        with pytest.raises(ValueError):
            compile_expression(bad, {"a", "b"})


def test_filter_missing_semantics(spark):
    df = frame(spark, "x double", [(1.0,), (None,), (float("nan"),), (3.0,)])
    f = lambda op, v: values(data.filter_rows(df, column="x", operator=op, value=v), RID)
    assert f("ne", 1.0) == [1, 2, 3] and f("gt", 0) == [0, 3] and f("between", [1, 2]) == [0] and f("in", [3.0]) == [3]


def test_statistics_by_hand(spark):
    df = frame(spark, "x double", [(1.0,), (2.0,), (2.0,), (5.0,), (1.0,)])
    r = feature.statistical(df, columns=["x"], features=list(STATISTICS)).first().asDict()
    want = {"count": 5, "distinct_count": 3, "argmax_first": 0.75, "argmax_last": 0.75, "argmin_first": 0, "argmin_last": 1, "count_above_mean": 1, "count_below_mean": 4, "longest_above_mean": 1, "longest_below_mean": 3, "duplicate_sum": 3, "max_repeated": 0, "min_repeated": 1, "repeated_value_ratio": 0.8, "mean_second_derivative": -5 / 3, "mad": 1.0}
    assert {k: r[f"x__{k}"] for k in want} == pytest.approx(want)
    assert r["window_id"] == "g0_w0"


def hourly(spark, days=10, fault=168):
    rows = [("a", float(h * 3600), float(h % 7), int(fault is not None and h >= fault)) for h in range(days * 24)]
    return frame(spark, "asset string, t double, v double, fault long", rows)


@pytest.mark.parametrize(
    ("more", "labels"),
    [({"prediction_horizon": "2d"}, [0, 0, 0, 1, 1, 1]), ({"prediction_horizon": "2d", "prediction_gap": "1d"}, [0, 0, 1, 1, 1]), ({"prediction_horizon": "7d"}, [1])],
)
def test_horizon_labels(spark, more, labels):
    out = feature.statistical(hourly(spark), columns=["v"], features=["mean"], group_column="asset", time_column="t", label_column="fault", window_span="2d", step_span="1d", label_policy="horizon", current_fault_policy="drop", **more)
    got = sorted((int(r["t_begin"]), r["label"], r["window_id"]) for r in out.collect())
    assert [g[1] for g in got] == labels
    if "prediction_gap" not in more and len(labels) == 6:
        assert [g[2] for g in got] == [f"g0_t{86400 * k}" for k in range(6)]


def test_thin_windows_and_label_rules(spark):
    times = [20 * k for k in range(360)] + [20000, 40000, 40020, 40040, 40060]
    df = frame(spark, "t long, v double, label long", [(t, 1.0, 0) for t in times])
    run = lambda **k: feature.statistical(df, columns=["v"], features=["count"], time_column="t", window_span="2h", step_span="30m", **k).select("n_rows").collect()
    n = [r[0] for r in run()]
    assert min(n) >= 1 and len(run(min_window_rows=3)) == sum(x >= 3 for x in n) < len(n)
    mixed = frame(spark, "v double, label long", [(1.0, 0), (1.0, 1)])
    with pytest.raises(OperatorError):
        feature.statistical(mixed, columns=["v"], label_column="label")
    assert feature.statistical(mixed, columns=["v"], label_column="label", label_policy="mode").first()["label"] == 0


def test_sequences_by_hand(spark):
    df = frame(spark, "v double", [(1.0,), (2.0,), (4.0,)])
    assert values(feature.temporal(df, columns=["v"], method="second_difference"), "v__second_difference") == [0, 0, 1]
    df = frame(spark, "v double", [(float(x),) for x in (1, 3, 2, 6, 1, 1, 5, 4)])
    assert values(feature.temporal(df, columns=["v"], method="sum_abs_change", window=4), "v__sum_abs_change_4")[-1] == 5
    assert values(feature.temporal(df, columns=["v"], method="peak_count", window=4), "v__peak_count_4")[-1] == 1
    df = frame(spark, "v double", [(1.0,), (2.0,), (2.0,)])
    assert values(feature.rolling_statistics(df, columns=["v"], method="max_repeat", window=3), "v__rolling_max_repeat_3")[-1] == 1


def test_imputation_by_group(spark):
    df = frame(spark, "g string, v double", [("a", 1.0), ("a", None), ("a", 3.0), ("b", 5.0), ("b", float("nan")), ("b", 9.0)])
    assert values(data.imputation(df, columns=["v"], method="max", group_column="g"), "v") == [1, 3, 3, 5, 9, 9]
    assert values(data.imputation(df, columns=["v"], method="interpolate", group_column="g"), "v") == [1, 2, 3, 5, 7, 9]


def test_spectrum_of_a_tone(spark):
    t = np.arange(512) / 512
    row = kernels.spectrum_row(np.sin(2 * np.pi * 64 * t), 512.0, (0.25, 0.5), 0.02, 0.0)
    assert row["dominant_frequency"] == 64 and row["dominant_amplitude"] == pytest.approx(1, abs=0.01)
    assert row["spectral_rms"] == pytest.approx(1 / math.sqrt(2), abs=0.01)
    assert sum(row[f"band_energy_ratio_{k}"] for k in range(3)) == pytest.approx(1)
    assert kernels.spectrum_row(np.ones(16), 1.0, (0.5,), 0.02, 0.0) is None


def test_kernels_against_dense_solutions():
    rng = np.random.default_rng(0)
    y = rng.normal(size=40).cumsum()
    k = np.diff(np.eye(40), 2, axis=0)
    assert np.allclose(kernels.hp_trend(y, 50.0), np.linalg.solve(np.eye(40) + 50 * k.T @ k, y))
    a, b = rng.normal(size=13), rng.normal(size=9)
    d = np.full((14, 10), np.inf)
    d[0, 0] = 0
    for i in range(13):
        for j in range(9):
            d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    assert kernels.dtw(a, b)[0] == pytest.approx(d[-1, -1])
    assert kernels.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert list(np.flatnonzero(kernels.esd(np.r_[rng.normal(size=60), 15.0], 5, 0.05))) == [60]


def test_detectors_find_planted_changes(spark):
    rng = np.random.default_rng(1)
    step = np.r_[rng.normal(size=150), rng.normal(size=150) + 8]
    df = frame(spark, "v double", [(float(x),) for x in step])
    flagged = [r[RID] for r in validation.level_shift_detector(df, column="v")["prediction"].where("is_anomaly").collect()]
    assert 150 in flagged
    calm = frame(spark, "v double", [(float(x),) for x in rng.normal(size=300)])
    got = validation.mean_drift_detector(calm, column="v", slack=1.0, decision=8.0)["metrics"].first()
    assert got["first_alarm"] is None
    alarm = validation.mean_drift_detector(df, column="v", decision=20.0)["metrics"].first()["first_alarm"]
    assert 150 <= alarm <= 170
    loop, s = [], (step - step[:90].mean()) / step[:90].std(ddof=1)
    up = low = 0.0
    for z in s[90:]:
        up, low = max(0.0, up + z - 0.5), min(0.0, low + z + 0.5)
        loop.append(max(up, -low))
    score = values(validation.mean_drift_detector(df, column="v")["prediction"], "score")[90:]
    assert np.allclose(score, loop)


def test_group_seam_does_not_alarm(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.normal(size=60)] + [("b", float(x)) for x in rng.normal(size=60) + 9]
    got = validation.level_shift_detector(frame(spark, "g string, v double", rows), column="v", group_column="g")
    assert got["prediction"].where("is_anomaly").count() == 0


def test_metrics_identities(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "actual string, prediction string")
    m = evaluation.classification_metrics(pred)
    rows = evaluation.class_metrics(pred).collect()
    assert m["accuracy"] == 0.5 and m["macro_f1"] == pytest.approx(np.mean([r["f1"] for r in rows]))
    scored = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, score double")
    assert evaluation.ranking_metrics(scored)["roc_auc"] == pytest.approx(0.875)


def test_model_protocol(spark):
    rng = np.random.default_rng(3)
    rows = [(f"m{g}", float(rng.normal() + 3 * (g % 2)), g % 2) for g in range(12) for _ in range(20)]
    df = frame(spark, "machine string, v double, fault long", rows)
    f = feature.statistical(df, columns=["v"], features=["mean", "std"], group_column="machine", label_column="fault", window_size=10)
    y = data.labels(f, column="label")
    got = validation.decision_tree(f, y, split_method="group")
    assert got["metrics"]["accuracy"] > 0.8 and got["importance"].count() == 2
    overlap = feature.statistical(df, columns=["v"], features=["mean"], group_column="machine", label_column="fault", window_size=10, step=5)
    with pytest.raises(OperatorError):
        validation.decision_tree(overlap, data.labels(overlap, column="label"))


def test_encoder_unseen_and_merge_checks(spark):
    df = frame(spark, "c string, y double", [("a", 1.0), ("b", 3.0), (None, 5.0)])
    enc = feature.categorical(df, columns=["c"], method="target", target_column="y")["encoder"]
    new = frame(spark, "c string", [("a",), ("zzz",), (None,)])
    assert values(feature.categorical_transform(new, enc), "c__target") == [1, 3, 5]
    a = feature.statistical(df, columns=["y"], features=["mean"])
    b = feature.statistical(df.where("y > 1"), columns=["y"], features=["max"])
    with pytest.raises(OperatorError):
        feature.merge(a, b)


def test_explore_and_visual_are_bounded(spark):
    df = frame(spark, "x double, y double", [(float(i), float(i % 5)) for i in range(2000)])
    assert len(visual.scatter(df, x="x", y="y")["series"][0]["x"]) <= 500
    assert explore.correlation(df, columns=["x", "y"], method="kendall").count() == 4
    iso = explore.isotonic(df.limit(50), x_column="x", y_column="x")
    assert iso.first()["spearman"] == pytest.approx(1)
    assert not data.concat(df.limit(3), df.limit(2)).groupBy(RID).count().where(F.col("count") > 1).count()


def test_positions_without_a_global_window(spark, monkeypatch):
    from millrace.functions import position

    monkeypatch.setattr(position, "FEW", 10)
    df = spark.range(3000).select((F.col("id") * F.col("id") % 5003).alias("v"))
    want = sorted(i * i % 5003 for i in range(3000))
    for n in (1, 2, 1500, 2999, 3000):
        assert position.nth_smallest(df, F.col("v"), n) == want[n - 1]
    assert position.nth_smallest(df, F.col("v"), 3001) is None
    placed = position.positioned(spark.range(100).select((F.col("id") * 3).alias("k")), "k", "p").orderBy("k").collect()
    assert [r["p"] for r in placed] == list(range(100))


def test_model_queries_take_whole_embeddings(spark, tmp_path):
    """Rows that differ only in the last of nine elements are told apart."""
    rows = [(i, [float(i % 3)] * 8 + [100.0 if i == 7 else float(i % 2)], i % 2) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.elements(catalog.embedded(spark, str(tmp_path))) == [f"e{i}" for i in range(9)]
    score = {r["vec_id"]: r["score"] for r in catalog.QUERIES["knn_detector"](spark, str(tmp_path)).collect()}
    assert max(score, key=score.get) == 7
