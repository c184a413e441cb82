"""Visual operators: bounded, renderer-independent series as small dictionaries.

Row order decides which points are kept: every k-th row of a group, at most ``max_points``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.position import positioned
from millrace.operators.base import RID, OperatorError, need, num, numeric_columns, operator
from millrace.operators.explore import histogram_counts
from millrace.operators.feature import correlation_matrix

POINTS, SERIES, EDGES = 500, 12, 100
ANY = "dataset:Dataset|FeatureDataset"


def sampled(df: DataFrame, columns: list[str], group: str | None = None, points: int = POINTS) -> DataFrame:
    """Every k-th row of each group, ``points`` at most; k comes from the group's own count."""
    d = df.select(*dict.fromkeys([RID, *columns, *([group] if group else [])]))
    if not group:
        step = max(1, -(-d.count() // points))
        return positioned(d, RID, "__n").where(F.col("__n") % step == 0).drop("__n")
    w = Window.partitionBy(group)
    d = d.withColumns({"__n": F.row_number().over(w.orderBy(RID)) - 1, "__k": F.ceil(F.count("*").over(w) / points)})
    return d.where("__n % __k = 0").drop("__n", "__k")


def _series(df: DataFrame, kind: str, x: str, ys, group, title: str, labels=("", ""), points: int = POINTS) -> dict:
    need(df, x, *ys, group)
    if len(ys) > SERIES:
        raise OperatorError(f"at most {SERIES} value columns")
    if group:
        names = [r[0] for r in df.groupBy(group).agg(F.min(RID).alias("m")).orderBy("m").limit(SERIES).collect()]
        df = df.where(F.col(group).isin([n for n in names if n is not None]) | (F.col(group).isNull() if None in names else F.lit(False)))
    rows = sampled(df, [x, *ys], group, points).orderBy(RID).collect()  # at most points x groups
    out: dict = {}
    for r in rows:
        for y in ys:
            s = out.setdefault((r[group] if group else None, y), {"x": [], "y": []})
            s["x"].append(r[x])
            s["y"].append(r[y])
    series = [{"name": y if g is None and not group else f"{g} {y}" if len(ys) > 1 else str(g), **v} for (g, y), v in out.items()]
    return {"kind": kind, "title": title, "x_label": labels[0] or x, "y_label": labels[1] or ", ".join(ys), "series": series}


@operator("visual.scatter", ANY, "plot:PlotArtifact")
def scatter(df, *, x, y, group=None, title="Scatter plot", x_label="", y_label=""):
    """Points of two columns, by group."""
    return _series(df, "scatter", x, [y], group, title, (x_label, y_label))


@operator("visual.line", ANY, "plot:PlotArtifact")
def line(df, *, time_column, value_columns, group=None, title="Time series"):
    """Lines over time."""
    return _series(df, "line", time_column, list(value_columns), group, title)


@operator("visual.subplot", ANY, "plot:PlotArtifact", kind=("line", "scatter"))
def subplot(df, *, x, value_columns, kind="line", title="Subplots", max_points=500):
    """One panel per column over a shared sample."""
    whole = _series(df, kind, x, list(value_columns), None, title, points=max_points)
    return {"kind": "subplot", "title": title, "panels": [{"kind": kind, "column": s["name"], "series": [s]} for s in whole["series"]]}


@operator("visual.histogram", ANY, "plot:PlotArtifact")
def histogram(df, *, columns, bins=20, density=False, title="Histogram"):
    """Equal-width counts or densities of at most twelve columns."""
    out = []
    for c in numeric_columns(df, columns)[:SERIES]:
        lo, hi = df.agg(F.min(num(c)), F.max(num(c))).first()
        n = histogram_counts(df, c, lo, hi, bins)
        width = (hi - lo) / bins if lo is not None and hi > lo else 1.0
        edges = [(lo or 0.0) + i * width for i in range(bins + 1)]
        total = sum(n) or 1
        out.append({"name": c, "edges": edges, "centers": [(a + b) / 2 for a, b in zip(edges, edges[1:])], "values": [v / total / width for v in n] if density else n})
    return {"kind": "histogram", "title": title, "series": out}


@operator("visual.compare", "first:Dataset second:Dataset", "plot:PlotArtifact")
def compare(first, second, *, columns, x_column=None, first_name="first", second_name="second", title="Dataset comparison", max_points=500):
    """At most six columns of two tables over one another."""
    out = []
    for df, name in ((first, first_name), (second, second_name)):
        for s in _series(df, "line", x_column or RID, list(columns)[:6], None, title, points=max_points)["series"]:
            out.append(s | {"name": f"{name} {s['name']}"})
    return {"kind": "compare", "title": title, "series": out}


@operator("visual.anomaly", "dataset:Dataset prediction:Prediction?", "plot:PlotArtifact")
def anomaly(df, prediction=None, *, x, y, anomaly_column, title="Anomalies", max_points=500):
    """Normal and anomalous rows as two samples, with the true number of anomalies."""
    if prediction is not None:
        n = df.count()
        df = df.join(prediction.select(RID, anomaly_column), RID)
        if df.count() != n:
            raise OperatorError("dataset and prediction are not aligned")
    need(df, x, y, anomaly_column)
    hit = F.coalesce(F.col(anomaly_column).cast("boolean"), F.lit(False))
    parts = {"normal": df.where(~hit), "anomaly": df.where(hit)}
    series = [s | {"name": name} for name, d in parts.items() for s in _series(d, "scatter", x, [y], None, title, points=max_points)["series"]]
    return {"kind": "anomaly", "title": title, "anomaly_count": parts["anomaly"].count(), "series": series}


@operator("visual.relationship", ANY, "plot:PlotArtifact", method=("pearson", "spearman", "kendall"))
def relationship(df, *, columns=(), method="pearson", threshold=0.3):
    """Column pairs whose correlation reaches the threshold, strongest first."""
    used = numeric_columns(df, columns)
    if method == "pearson":
        m = correlation_matrix(df, used)
        pairs = [(a, b, m[a, b]) for i, a in enumerate(used) for b in used[i + 1 :]]
    else:
        from millrace.operators.explore import correlation

        pairs = [tuple(r) for r in correlation(df, columns=used, method=method).collect() if used.index(r[0]) < used.index(r[1])]
    edges = sorted(({"source": a, "target": b, "weight": v} for a, b, v in pairs if v is not None and abs(v) >= threshold), key=lambda e: -abs(e["weight"]))
    return {"kind": "relationship", "nodes": used, "edges": edges[:EDGES]}


@operator("visual.overview", "dataset:Dataset|FeatureDataset labels:LabelVector?", "overview:Visualization")
def overview(df, labels=None, *, time_column=None, label_column=None):
    """Rows, types, missing rates, distinct counts, describe, time range and label balance."""
    need(df, time_column, label_column)
    own = [c for c in df.columns if c != RID]
    agg = [F.count("*").alias("rows")]
    for i, c in enumerate(own):
        agg += [F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"d{i}")]
    numbers = [c for c in numeric_columns(df) if c in own] if any(t in ("int", "bigint", "double", "float") for _, t in df.dtypes) else []
    for c in numbers:
        i = own.index(c)
        agg += [F.avg(num(c)).alias(f"m{i}"), F.stddev_samp(num(c)).alias(f"s{i}"), F.min(num(c)).alias(f"a{i}"), F.max(num(c)).alias(f"b{i}")]
    if time_column:
        agg += [F.min(time_column).alias("t0"), F.max(time_column).alias("t1")]
    r = df.agg(*agg).first()
    kinds = dict(df.dtypes)
    columns = []
    for i, c in enumerate(own):
        col = {"name": c, "type": kinds[c], "missing_rate": 1 - r[f"n{i}"] / r["rows"] if r["rows"] else 0.0, "distinct": r[f"d{i}"]}
        if c in numbers:
            col |= {"mean": r[f"m{i}"], "std": r[f"s{i}"], "min": r[f"a{i}"], "max": r[f"b{i}"]}
        columns.append(col)
    out = {"rows": r["rows"], "columns": columns}
    if time_column:
        out["time_range"] = (r["t0"], r["t1"])
    y = labels.select("label") if labels is not None else df.select(F.col(label_column).alias("label")) if label_column else None
    if y is not None:
        n = {str(x["label"]): x["n"] for x in y.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(1000).collect()}
        total = sum(n.values()) or 1
        out["label_balance"] = {k: {"count": v, "share": v / total} for k, v in n.items()}
        out["findings"] = [f"class {k} has {v / total:.1%} of the rows" for k, v in n.items() if v / total < 0.1]
    return out
