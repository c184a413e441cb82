"""Holdout protocol: class-aware splits, leak checks, classification and regression metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.position import nth_smallest, positioned
from millrace.operators.base import RID, OperatorError
from millrace.operators.windows import overlapping, purge

MIN_ROWS = 8


def key_of(df: DataFrame) -> str:
    return "window_id" if "window_id" in df.columns else RID


def confusion(pred: DataFrame) -> DataFrame:
    """(actual, predicted, n) with both as text."""
    return pred.groupBy(F.col("actual").cast("string").alias("actual"), F.col("prediction").cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class; no division by zero (0 instead)."""
    c = confusion(pred)
    classes = c.select(F.col("actual").alias("class")).union(c.select("predicted")).distinct()
    tp = c.where("actual = predicted").select(F.col("actual").alias("class"), F.col("n").alias("tp"))
    sup = c.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"))
    got = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted"))
    t = classes.join(tp, "class", "left").join(sup, "class", "left").join(got, "class", "left").fillna(0)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    t = t.withColumns({"precision": zero(F.try_divide("tp", "predicted")), "recall": zero(F.try_divide("tp", "support"))})
    f1 = zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return t.select("class", "precision", "recall", f1.alias("f1"), "support")


def classification_metrics(pred: DataFrame, positive: str | None = None) -> dict[str, float]:
    """Accuracy, balanced accuracy, macro scores, AUCs (where ``probability`` exists), miss rate."""
    rows = class_metrics(pred).collect()  # one row per class
    n = sum(r["support"] for r in rows)
    hit = sum(r["recall"] * r["support"] for r in rows)
    real = [r for r in rows if r["support"]]
    out = {
        "rows": float(n), "accuracy": hit / n if n else 0.0,
        "balanced_accuracy": float(np.mean([r["recall"] for r in real])) if real else 0.0,
        **{f"macro_{k}": float(np.mean([r[k] for r in rows])) if rows else 0.0 for k in ("precision", "recall", "f1")},
    }
    names = sorted(r["class"] for r in rows)
    positive = positive or (names[-1] if names else None)
    hit_rate = next((r["recall"] for r in rows if r["class"] == positive), 0.0)
    out["miss_rate"] = 1 - hit_rate
    if "probability" in pred.columns and len(names) == 2:
        out |= ranking_metrics(pred.select((F.col("actual").cast("string") == positive).cast("int").alias("y"), F.col("probability").alias("score")))
    return out


def ranking_metrics(scored: DataFrame) -> dict[str, float]:
    """ROC-AUC by midranks and average precision, both over (score, y) cells."""
    from millrace.operators.explore import running_total

    cells = scored.groupBy("score").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    pos, all_ = cells.agg(F.sum("p"), F.sum("n")).first()
    if not pos or pos == all_:
        return {}
    up = running_total(cells, "score", "n")
    rank = up.agg(F.sum(F.col("p") * (F.col("__upto") - (F.col("n") - 1) / 2))).first()[0]
    auc = (rank - pos * (pos + 1) / 2) / (pos * (all_ - pos))
    down = running_total(cells.withColumn("key", -F.col("score")), "key", "n").withColumnRenamed("__upto", "seen")
    down = running_total(down, "key", "p")
    ap = down.agg(F.sum(F.col("p") / F.lit(pos) * F.col("__upto") / F.col("seen"))).first()[0]
    return {"roc_auc": float(auc), "pr_auc": float(ap)}


def regression_metrics(pred: DataFrame) -> DataFrame:
    e = F.col("actual") - F.col("prediction")
    one = pred.agg(F.count("*").alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("r"), F.var_pop("actual").alias("v"))
    r2 = F.when(F.col("v") > 0, 1 - F.col("r") / (F.col("v") * F.col("rows")))
    return one.select("rows", r2.alias("r2"), "mae", "rmse")


# --- splits ---------------------------------------------------------------------------


def hash_split(df: DataFrame, test_size: float, seed: int, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Seeded hash order, per class where ``by`` is given; exact counts by rank."""
    key = key_of(df)
    if not by:
        cut = nth_smallest(df, F.xxhash64(key, F.lit(seed)), max(1, round(df.count() * test_size)))
        hit = F.xxhash64(key, F.lit(seed)) <= F.lit(cut)
        return df.where(~hit), df.where(hit)
    w = Window.partitionBy(by)
    rank = F.row_number().over(w.orderBy(F.xxhash64(key, F.lit(seed)), key))
    marked = df.withColumn("__test", rank <= F.greatest(F.lit(1), F.round(F.count("*").over(w) * test_size)))
    return marked.where("not __test").drop("__test"), marked.where("__test").drop("__test")


def group_split(df: DataFrame, group: str, label: str, test_size: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Whole groups, chosen so that both sides hold every class where that is possible.

    Only group-by-class counts reach the driver. Groups in seeded order, those with the rarest
    class first: a side that lacks one of the group's classes gets it, else the side that is
    relatively emptier.
    """
    counts = df.groupBy(F.col(group).alias("g"), F.col(label).cast("string").alias("y")).agg(F.count("*").alias("n")).collect()
    classes = sorted({r["y"] for r in counts})
    groups: dict = {}
    for r in counts:
        groups.setdefault(r["g"], {})[r["y"]] = r["n"]
    if len(groups) < 2:
        raise OperatorError("a group split needs two groups")
    total = {y: sum(g.get(y, 0) for g in groups.values()) for y in classes}
    order = sorted(groups, key=str)
    np.random.default_rng(seed).shuffle(order)
    order.sort(key=lambda g: min(total[y] for y in groups[g]))
    aim = {"test": test_size * sum(total.values()), "train": (1 - test_size) * sum(total.values())}
    size, has, chosen = {"test": 0, "train": 0}, {"test": set(), "train": set()}, {"test": [], "train": []}
    for g in order:
        rare = sorted(groups[g], key=total.__getitem__)
        lacking = [s for y in rare for s in ("train", "test") if y not in has[s]]
        side = lacking[0] if lacking else max(aim, key=lambda s: (aim[s] - size[s]) / aim[s])
        chosen[side].append(g)
        size[side] += sum(groups[g].values())
        has[side] |= set(groups[g])
    if not chosen["test"]:
        chosen["test"].append(chosen["train"].pop())
    kind = dict(df.dtypes)[group]
    t = df.sparkSession.createDataFrame([(g,) for g in chosen["test"]], f"`{group}` {kind}")
    return df.join(t, group, "left_anti"), df.join(t, group, "left_semi")


def temporal_split(df: DataFrame, label: str | None, test_size: float) -> tuple[DataFrame, DataFrame]:
    """Cut in row order; the cut may move by half the test size to give both sides every class."""
    n = df.count()
    placed = positioned(df.select(RID, *([F.col(label).cast("string").alias("y")] if label else [])), RID, "k").withColumn("k", F.col("k") + 1)
    want, slack = int(n * (1 - test_size)), int(n * test_size / 2)
    cut = want
    if label:
        ends = placed.groupBy("y").agg(F.min("k").alias("a"), F.max("k").alias("b")).collect()
        lo, hi = max((r["a"] for r in ends), default=1), min((r["b"] for r in ends), default=n) - 1
        if lo <= hi and not lo <= want <= hi:
            near = lo if want < lo else hi
            cut = near if abs(near - want) <= slack else want
    at = placed.where(F.col("k") == cut).select(RID).first()
    edge = at[0] if at else -1
    train, test = df.where(F.col(RID) <= edge), df.where(F.col(RID) > edge)
    return (purge(train, test) if "rid_start" in df.columns else train), test


def holdout(df: DataFrame, label: str, split_method: str, test_size: float, seed: int, overlapping_windows: bool = False):
    """(train, test) under the protocol; raw rows shared by both sides are an error."""
    if df.count() < MIN_ROWS:
        raise OperatorError(f"a holdout needs {MIN_ROWS} rows")
    group = "asset" if split_method == "asset" else "group_label"
    if split_method in ("group", "asset"):
        if group not in df.columns:
            raise OperatorError(f"the features carry no {group}")
        train, test = group_split(df, group, label, test_size, seed)
    elif split_method == "temporal":
        train, test = temporal_split(df, label, test_size)
    elif split_method == "random":
        train, test = hash_split(df, test_size, seed)
    else:
        if overlapping_windows:
            raise OperatorError("overlapping windows leak in a stratified split; split by group or time")
        train, test = hash_split(df, test_size, seed, label)
    if "rid_start" in df.columns and split_method in ("stratified", "random") and not overlapping(train, test).isEmpty():
        raise OperatorError("train and test windows share raw rows; split by group or time")
    return train, test
