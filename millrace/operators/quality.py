"""The table pre-check report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.base import RID, in_order, need, num, numeric_columns, operator
from millrace.operators.windows import Spec, windows


@operator("data.quality", "dataset:Dataset", "report:Visualization")
def quality(df: DataFrame, *, columns=(), group_column=None, label_column=None, time_column=None, window_size=0, step=0, max_groups=20, flat_threshold=0.0):
    """Empty, constant and zero columns, duplicates, flat and mixed windows, label changes.

    The report shows the first ``max_groups`` groups in row order; every other figure covers all rows.
    """
    need(df, *columns, group_column, label_column, time_column)
    used = list(columns) or numeric_columns(df, (), (group_column, label_column, time_column))
    agg = [F.count("*").alias("rows"), F.count_distinct(F.struct(*used)).alias("unique")]
    for i, c in enumerate(used):
        agg += [F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"d{i}"), F.max(F.abs(num(c))).alias(f"m{i}")]
    r = df.agg(*agg).first()
    out: dict = {
        "rows": r["rows"], "duplicate_rows": r["rows"] - r["unique"],
        "empty_columns": [c for i, c in enumerate(used) if not r[f"n{i}"]],
        "constant_columns": [c for i, c in enumerate(used) if r[f"n{i}"] == r["rows"] and r[f"d{i}"] == 1],
        "zero_columns": [c for i, c in enumerate(used) if r[f"n{i}"] and r[f"m{i}"] == 0],
    }
    if group_column:
        per = df.groupBy(group_column).agg(F.min(RID).alias("first"), *(F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(used))).orderBy("first").limit(max_groups)
        out["group_constants"] = {str(g[group_column]): [c for i, c in enumerate(used) if g[f"d{i}"] <= 1] for g in per.collect()}
    if label_column:
        g = [group_column] if group_column else []
        rows, w, finish = in_order(df, group_column, time_column, 1)
        before, first = F.lag(label_column).over(w), F.lag(F.lit(1)).over(w).isNull()
        moved = finish(rows.withColumn("__c", ~first & ~F.col(label_column).eqNullSafe(before)))
        per = moved.groupBy(*g).agg(F.min(RID).alias("first"), F.count_if("__c").alias("n"))
        out["label_changes"] = {str(x[0]) if g else "all": x["n"] for x in per.orderBy("first").limit(max_groups).collect()}
    if window_size:
        spec = Spec(group_column=group_column, time_column=time_column, window_size=window_size, step=step)
        win = windows(df, spec)
        flat = {f"flat{i}": F.max(num(c)) - F.min(num(c)) <= F.lit(float(flat_threshold)) for i, c in enumerate(used)}
        mixed = {"mixed": F.count_distinct(label_column) > 1} if label_column else {}
        t = win.rows.groupBy(*win.keys).agg(*(v.alias(k) for k, v in (flat | mixed).items()))
        s = t.agg(F.count("*").alias("windows"), *(F.count_if(k).alias(k) for k in (flat | mixed))).first()
        n = s["windows"] or 1
        out |= {"windows": s["windows"], "flat_window_ratio": {c: s[f"flat{i}"] / n for i, c in enumerate(used)}}
        if label_column:
            out["mixed_windows"] = s["mixed"]
    out["findings"] = [f"{k.replace('_', ' ')}: {', '.join(v)}" for k, v in out.items() if k.endswith("_columns") and v]
    if out["duplicate_rows"]:
        out["findings"].append(f"{out['duplicate_rows']} duplicate rows")
    return out
