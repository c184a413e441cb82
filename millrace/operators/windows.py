"""The window table: complete windows of rows or of time, their labels and coverage.

One plan serves every window operator: rows are numbered inside their group, assigned to all
windows that cover them, and aggregated by (group_no, w). Time windows are anchored on real
samples; only that chain of anchors is sequential, and it streams over sorted (group, time)
pairs in bounded memory. Rows then meet anchors by (group, time bucket).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.durations import as_seconds, seconds
from millrace.functions.position import positioned
from millrace.operators.base import RID, OperatorError, guard, need

EPSILON = 1e-6
SPARSE = 3
POLICIES = ("strict", "last", "mode", "horizon")
CURRENT = ("drop", "positive", "negative")


@dataclass(frozen=True)
class Spec:
    group_column: str | None = None
    asset_column: str | None = None
    label_column: str | None = None
    time_column: str | None = None
    window_size: int = 0
    step: int = 0
    window_span: str = ""
    step_span: str = ""
    prediction_horizon: str = ""
    prediction_gap: str = ""
    current_fault_policy: str = "positive"
    normal_label: str = "0"
    label_policy: str = "strict"
    min_window_rows: int = 0

    def __post_init__(self):
        span, horizon = seconds(self.window_span), seconds(self.prediction_horizon)
        if self.window_size < 0 or self.step < 0:
            raise OperatorError("window_size and step are not negative")
        if span and (self.window_size or self.step):
            raise OperatorError("give a row window or a time window, not both")
        if self.step_span and not span:
            raise OperatorError("step_span needs window_span")
        if span and not self.time_column:
            raise OperatorError("a time window needs time_column")
        if self.label_policy not in POLICIES or self.current_fault_policy not in CURRENT:
            raise OperatorError("unknown label or current-fault policy")
        if self.label_policy == "horizon" and not (horizon and span and self.label_column):
            raise OperatorError("policy horizon needs prediction_horizon, window_span and label_column")
        if (horizon or self.prediction_gap) and self.label_policy != "horizon":
            raise OperatorError("prediction_horizon and prediction_gap need policy horizon")

    @property
    def overlapping(self) -> bool:
        span = seconds(self.window_span)
        if span:
            return (seconds(self.step_span) or span) < span
        return 0 < self.step < self.window_size


def numbered(df: DataFrame, spec: Spec) -> DataFrame:
    """Adds group_no (first appearance), group_label, __t (seconds), pos and rows of the group."""
    need(df, spec.group_column, spec.asset_column, spec.label_column, spec.time_column)
    if spec.group_column:
        g = F.col(spec.group_column)
        groups = df.groupBy(g.alias("__g")).agg(F.min(RID).alias("__first"))
        # one row per group: the only global order here
        groups = groups.select("__g", (F.row_number().over(Window.orderBy("__first")) - 1).cast("long").alias("group_no"))
        df = df.join(groups, g.eqNullSafe(F.col("__g"))).drop("__g")
        label = F.coalesce(g.cast("string"), F.lit("<missing>"))
    else:
        df, label = df.withColumn("group_no", F.lit(0).cast("long")), F.lit("all")
    t = as_seconds(df, spec.time_column) if spec.time_column else F.col(RID).cast("double")
    out = df.withColumn("group_label", label).withColumn("__t", t)
    if not spec.group_column:
        out = positioned(out, [F.col("__t").asc(), F.col(RID)], "pos")
        return out.withColumn("n_group", F.lit(out.count()))
    w = Window.partitionBy("group_no")
    return out.withColumns({"pos": F.row_number().over(w.orderBy("__t", RID)) - 1, "n_group": F.count("*").over(w)})


def _row_windows(rows: DataFrame, spec: Spec) -> DataFrame:
    size, step = spec.window_size, spec.step or spec.window_size
    if not size:
        return rows.withColumn("w", F.lit(0).cast("long"))
    if step >= size:  # each row lies in one window at most
        start = F.col("pos") - F.col("pos") % step
        return rows.withColumn("w", start.cast("long")).where((F.col("pos") - F.col("w") < size) & (F.col("w") + size <= F.col("n_group")))
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / step)).cast("long")
    hi = F.least(F.floor(F.col("pos") / step), F.floor((F.col("n_group") - size) / step)).cast("long")
    k = F.explode(F.when(hi >= lo, F.sequence(lo, hi)))
    return rows.withColumn("__k", k).withColumn("w", F.col("__k") * step).drop("__k")


def anchor_chain(rows: DataFrame, span: float, stride: float) -> DataFrame:
    """(group_no, t0): starts of complete windows; the next start is the first sample past the stride."""
    timed = rows.select("group_no", "__t").where("__t is not null")
    base = timed.join(timed.groupBy("group_no").agg(F.max("__t").alias("last")), "group_no")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, due = None, 0.0
        for b in batches:
            g, t, last = (b.column(n).to_numpy(zero_copy_only=False) for n in ("group_no", "__t", "last"))
            keep, i = [], 0
            ends = np.r_[np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
            for end in ends.tolist():
                if g[i] != group:
                    group, due = g[i], -np.inf
                while i < end:
                    i += int(np.searchsorted(t[i:end], due))
                    if i >= end or t[i] + span > last[i] + EPSILON:
                        break
                    keep.append(i)
                    due = t[i] + stride
                    i += 1
                i = end
            yield pa.RecordBatch.from_arrays([pa.array(g[keep]), pa.array(t[keep])], ["group_no", "t0"])

    spread = base.repartition("group_no").sortWithinPartitions("group_no", "__t")
    return spread.mapInArrow(chain, "group_no long, t0 double")


def _between(anchors: DataFrame, rows: DataFrame, lo: Column, hi: Column, width: float, inside: Column, kind: str = "inner") -> DataFrame:
    """Interval join by (group_no, bucket of ``width``): a row has one bucket, an anchor all it spans."""
    b = lambda t: F.floor(t / F.lit(width)).cast("long")
    left = anchors.withColumn("__b", F.explode(F.sequence(b(lo), b(hi))))
    right = rows.withColumn("__b", b(F.col("__t")))
    return left.join(right, ["group_no", "__b"], kind).where(inside).drop("__b")


def _span_windows(rows: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    span = seconds(spec.window_span)
    anchors = anchor_chain(rows, span, seconds(spec.step_span) or span)
    t, t0 = F.col("__t"), F.col("t0")
    return _between(anchors, rows, t0, t0 + span, span, (t >= t0) & (t < t0 + span)).withColumn("w", t0.cast("long")), anchors


@dataclass
class Windows:
    """Assigned rows (keys group_no, w and t0 for time windows) and what windows are made of."""

    rows: DataFrame
    spec: Spec
    keys: tuple[str, ...]
    numbered: DataFrame

    def features(self, aggregates: dict[str, Column], finish: dict[str, Column] | None = None, temporary=()) -> DataFrame:
        """One row per window: id, group, coverage, label, then the features."""
        spec = self.spec
        place = F.struct("pos")
        agg = {
            "group_label": F.first("group_label"), "rid_start": F.min(RID), "rid_stop": F.max(RID) + 1,
            "n_rows": F.count(F.lit(1)), "t_begin": F.min("__t"), "t_end": F.max("__t"),
        }
        if spec.asset_column:
            agg |= {"asset": F.first(F.col(spec.asset_column).cast("string")), "__assets": F.count_distinct(spec.asset_column)}
        if spec.label_column:
            y = F.col(spec.label_column)
            agg["__unlabelled"] = F.count_if(y.isNull())
            if spec.label_policy == "horizon":
                agg["__fault"] = F.max(self._fault(y))
            else:
                agg["__classes"] = F.count_distinct(y)
                agg["label"] = F.mode(y, True) if spec.label_policy == "mode" else F.max_by(y, place)
        out = self.rows.groupBy(*self.keys).agg(*(c.alias(n) for n, c in (agg | aggregates).items()))
        if spec.min_window_rows:
            out = out.where(F.col("n_rows") >= spec.min_window_rows)
        if spec.label_column:
            rules = {"missing": (F.col("__unlabelled") > 0, "labels are missing in a window")}
            if spec.label_policy == "strict":
                rules["mixed"] = (F.col("__classes") > 1, "a window has several labels; name a label_policy")
            guard(out, **rules)
        if spec.asset_column:
            guard(out, asset=(F.col("__assets") != 1, "a group maps to several assets"))
        if spec.label_policy == "horizon":
            out = self._horizon(out)
        mark = "t" if "t0" in self.keys else "w"
        out = out.withColumn("window_id", F.concat(F.lit("g"), F.col("group_no"), F.lit("_" + mark), F.col("w")))
        if finish:
            out = out.withColumns(finish)
        names = [n for n in (*aggregates, *(finish or ())) if n not in temporary]
        head = ["window_id", "group_no", "group_label", *(["asset"] if spec.asset_column else []), "rid_start", "rid_stop", "n_rows", "t_begin", "t_end"]
        return out.select(*head, *(["label"] if spec.label_column else []), *names, F.col("rid_start").alias(RID))

    def _fault(self, y: Column) -> Column:
        return y.cast("string") != F.lit(str(self.spec.normal_label))

    def _horizon(self, out: DataFrame) -> DataFrame:
        """1/0 by the labels in (end + gap, end + gap + horizon]; unknown futures are dropped."""
        spec = self.spec
        span, horizon, gap = seconds(spec.window_span), seconds(spec.prediction_horizon), seconds(spec.prediction_gap)
        t, start = F.col("__t"), F.col("t0") + span + gap
        seen = self.numbered.select("group_no", "__t", self._fault(F.col(spec.label_column)).alias("__f")).where("__t is not null")
        ends = seen.groupBy("group_no").agg(F.max("__t").alias("__last"))
        future = _between(out.select("group_no", "t0"), seen, start, start + horizon, max(horizon, 1.0), (t > start) & (t <= start + horizon))
        future = future.groupBy("group_no", "t0").agg(F.max("__f").cast("long").alias("__next"))
        out = out.join(ends, "group_no").join(future, ["group_no", "t0"], "left")
        known = F.when(start + horizon <= F.col("__last") + EPSILON, F.col("__next"))
        if spec.current_fault_policy == "drop":
            out = out.where(~F.col("__fault"))
        now = F.lit(1 if spec.current_fault_policy == "positive" else 0).cast("long")
        return out.withColumn("label", F.when(F.col("__fault"), now).otherwise(known)).where("label is not null")


def windows(df: DataFrame, spec: Spec) -> Windows:
    rows = numbered(df, spec)
    if spec.window_span:
        assigned, _ = _span_windows(rows, spec)
        return Windows(assigned, spec, ("group_no", "w", "t0"), rows)
    return Windows(_row_windows(rows, spec), spec, ("group_no", "w"), rows)


# --- coverage -------------------------------------------------------------------------


def overlapping(train: DataFrame, held: DataFrame, bucket: int = 4096) -> DataFrame:
    """The windows of ``train`` whose rows touch a window of ``held`` (interval semi join)."""
    parts = lambda p: F.explode(F.sequence(F.floor(F.col(f"{p}rid_start") / bucket), F.floor((F.col(f"{p}rid_stop") - 1) / bucket)))
    a = train.withColumn("__b", parts(""))
    h = held.select(F.col("rid_start").alias("h_rid_start"), F.col("rid_stop").alias("h_rid_stop")).withColumn("__b", parts("h_"))
    touch = (a["__b"] == h["__b"]) & (F.col("rid_start") < F.col("h_rid_stop")) & (F.col("h_rid_start") < F.col("rid_stop"))
    return a.join(h, touch, "left_semi").drop("__b").dropDuplicates(["window_id"])


def purge(train: DataFrame, held: DataFrame) -> DataFrame:
    """The windows of ``train`` that share no row with ``held``."""
    return train.join(overlapping(train, held).select("window_id"), "window_id", "left_anti")
