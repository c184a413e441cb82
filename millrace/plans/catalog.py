"""The registered queries over the driver's tables and their SQL oracles.

``events`` is the telemetry stream: group ``user_id``, time ``ts``, tie ``event_id``, signal
``value``, label ``event_type``. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import millrace.operators.quality  # noqa: F401  (registers its operator)
from millrace.functions.stats import STATISTICS
from millrace.operators import data, evaluation, explore, feature, validation, visual, windows
from millrace.operators.base import RID, num
from millrace.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 5) -> DataFrame:
    """Drop the row id, widen integers, round doubles (and turn -0 into 0)."""
    out = []
    for f in df.schema:
        if f.name == RID:
            continue
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 5):
    """Register a query; ``doubles`` lists the oracle's columns to round."""

    def add(fn):
        QUERIES[name] = lambda spark, sf: tidy(fn(spark, sf), digits)
        if sql:
            cols = ", ".join(f'round("{c}"::DOUBLE, {digits}) + 0.0 AS "{c}"' for c in doubles.split())
            ORACLES[name] = f"SELECT * REPLACE ({cols}) FROM ({sql})" if cols else sql
        return fn

    return add


def events(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    t = table(spark, sf, "events", "event_id")
    return t.select(*columns, RID) if columns else t


def item(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a unique row id from the file's order."""
    return table(spark, sf, "lineitem")


def keyed(df: DataFrame, name: str = "event_id") -> DataFrame:
    return df.withColumn(name, F.col(RID))


# --- data -----------------------------------------------------------------------------


@query("scan_project_filter", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.05", "l_quantity")
def _(s, sf):
    f = data.filter_rows(item(s, sf), column="l_quantity", operator="gt", value=45, conditions=[{"column": "l_discount", "operator": "le", "value": 0.05}])
    return data.column_operation(f, operation="select", columns=["l_orderkey", "l_quantity"])


@query("input_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 400000", "o_totalprice")
def _(s, sf):
    return data.input_table(s, path=f"{sf}/orders.parquet", columns=["o_orderkey", "o_totalprice"], filters=[("o_totalprice", ">=", 400000)])


@query("materialize_table", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def _(s, sf):
    o = data.filter_rows(table(s, sf, "orders", "o_orderkey"), column="o_custkey", operator="eq", value=7)
    return data.materialize_table(o.select("o_orderkey", "o_custkey", RID))


@query("filter_in_between_or", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_linenumber IN (1, 7) OR l_quantity BETWEEN 10 AND 12")
def _(s, sf):
    f = data.filter_rows(item(s, sf), column="l_linenumber", operator="in", value=[1, 7], logical_operator="or", conditions=[{"column": "l_quantity", "operator": "between", "value": [10, 12]}])
    return f.select("l_orderkey", "l_linenumber")


HOLES = "SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events"


def holes(s, sf):
    return events(s, sf, "event_id", "user_id", "ts", "value").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


@query("filter_ne_nulls", f"SELECT event_id FROM ({HOLES}) WHERE value IS DISTINCT FROM 6.55")
def _(s, sf):
    return data.filter_rows(holes(s, sf), column="value", operator="ne", value=6.55).select("event_id")


for _op, _sql in {
    "head": "ORDER BY o_orderkey LIMIT 25", "tail": "ORDER BY o_orderkey DESC LIMIT 25", "range": "ORDER BY o_orderkey LIMIT 25 OFFSET 40",
}.items():

    @query(f"row_{_op}", f"SELECT o_orderkey, o_custkey FROM orders {_sql}")
    def _(s, sf, op=_op):
        return data.row_operation(table(s, sf, "orders", "o_orderkey"), operation=op, count=25, start=40).select("o_orderkey", "o_custkey")


@query("row_dedup", "SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderstatus FROM orders GROUP BY o_custkey, o_orderstatus")
def _(s, sf):
    return data.row_operation(table(s, sf, "orders", "o_orderkey"), operation="remove_duplicates", columns=["o_custkey", "o_orderstatus"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("row_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "o_totalprice")
def _(s, sf):
    return data.row_operation(table(s, sf, "orders", "o_orderkey"), operation="sort", columns=["o_totalprice"], ascending=False).select("o_orderkey", "o_totalprice").limit(20)


@query("row_drop_rows", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (1, 2, 3)")
def _(s, sf):
    return data.row_operation(table(s, sf, "orders", "o_orderkey"), operation="drop_rows", indices=[1, 2, 3]).select("o_orderkey")


@query("drop_missing", f"SELECT event_id FROM ({HOLES}) WHERE value IS NOT NULL")
def _(s, sf):
    return data.row_operation(holes(s, sf), operation="drop_missing", columns=["value"]).select("event_id")


@query("row_sample")
def _(s, sf):
    return data.row_operation(table(s, sf, "orders", "o_orderkey"), operation="sample", count=100, random_state=1).select("o_orderkey")


@query("col_create_expr", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) / 2 + ln(l_quantity) - sqrt(l_tax) AS v FROM lineitem", "v", 6)
def _(s, sf):
    return data.column_operation(item(s, sf), operation="create", name="v", expression_text="l_extendedprice * (1 - l_discount) / 2 + log(l_quantity) - sqrt(l_tax)").select("l_orderkey", "v")


@query("col_cast", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey FROM orders")
def _(s, sf):
    return data.column_operation(table(s, sf, "orders", "o_orderkey").select("o_orderkey", "o_custkey", RID), operation="cast_type", columns=["o_orderkey", "o_custkey"], dtype="string")


@query("col_rename_reorder", "SELECT c_name AS name, c_custkey FROM customer")
def _(s, sf):
    c = table(s, sf, "customer", "c_custkey").select("c_custkey", "c_name", RID)
    c = data.column_operation(c, operation="rename", mapping={"c_name": "name"})
    return data.column_operation(c, operation="reorder", columns=["name", "c_custkey"])


@query("drop_constant", "SELECT event_id FROM events")
def _(s, sf):
    return data.column_operation(events(s, sf, "event_id").withColumn("c", F.lit(1)), operation="drop_constant")


@query("trim_extrema", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events ORDER BY value, event_id LIMIT 3) AND event_id NOT IN (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 3)")
def _(s, sf):
    return data.column_operation(events(s, sf, "event_id", "value"), operation="trim_extrema", columns=["value"], extrema_count=3).select("event_id")


@query("concat_sources", "SELECT c_name AS name, 'first' AS origin FROM customer UNION ALL SELECT s_name, 'second' FROM supplier")
def _(s, sf):
    a = table(s, sf, "customer", "c_custkey").select(F.col("c_name").alias("name"), RID)
    b = table(s, sf, "supplier", "s_suppkey").select(F.col("s_name").alias("name"), RID)
    return data.concat(a, b, source_column="origin")


@query("asset_key_split", "SELECT c_custkey, split_part(c_name, '#', 2) AS asset FROM customer")
def _(s, sf):
    return data.asset_key(table(s, sf, "customer", "c_custkey"), column="c_name", separator="#", index=1).select("c_custkey", "asset")


@query("asset_key_regex", "SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)', 1) AS asset FROM customer")
def _(s, sf):
    return data.asset_key(table(s, sf, "customer", "c_custkey"), column="c_name", mode="regex", pattern="([A-Za-z]+)").select("c_custkey", "asset")


@query("label_vector", "SELECT event_id, event_type AS label FROM events")
def _(s, sf):
    return keyed(data.labels(events(s, sf), column="event_type"))


RESAMPLE = """
WITH e AS (SELECT user_id, epoch(ts)::DOUBLE AS t, value FROM events),
b AS (SELECT user_id, (floor(t / 21600))::BIGINT AS k, avg(value) AS v FROM e GROUP BY ALL),
g AS (SELECT user_id, unnest(range(min(k), max(k) + 1)) AS k FROM b GROUP BY user_id),
d AS (SELECT g.user_id, g.k, v FROM g LEFT JOIN b USING (user_id, k)),
n AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k) AS a,
  last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k) AS ka,
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
  first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kb FROM d)
"""
for _fill, _v in {"none": "v", "ffill": "coalesce(a, b)", "interpolate": "coalesce(v, a + (b - a) * (k - ka) / (kb - ka))"}.items():

    @query(f"resample_{_fill}", f"{RESAMPLE} SELECT user_id, k * 21600 AS t, {_v} AS value FROM n", "value", 8)
    def _(s, sf, fill=_fill):
        r = data.time_resample(events(s, sf, "user_id", "ts", "value"), time_column="ts", frequency="6h", columns=["value"], group_column="user_id", fill_method=fill)
        return r.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("t"), "value")


W = "PARTITION BY user_id ORDER BY ts, event_id"


@query("lag_lead", f"SELECT event_id, lag(value, 1) OVER ({W}) AS value_lag_1, lead(value, 2) OVER ({W}) AS value_lead_2 FROM events", "value_lag_1 value_lead_2")
def _(s, sf):
    return data.neighbor_features(events(s, sf), columns=["value"], offsets=[1, -2], group_column="user_id", time_column="ts").select("event_id", "value_lag_1", "value_lead_2")


@query("seasonal_diff", f"SELECT event_id, value - lag(value, 5) OVER ({W}) AS d FROM events", "d")
def _(s, sf):
    return data.seasonal_difference(events(s, sf), columns=["value"], period=5, group_column="user_id", time_column="ts", suffix="_d").select("event_id", F.col("value_d").alias("d"))


@query("seasonal_ratio", f"SELECT event_id, (value + 1) / lag(value + 1, 5) OVER ({W}) AS r FROM events", "r")
def _(s, sf):
    e = events(s, sf).withColumn("value", F.col("value") + 1)
    return data.seasonal_difference(e, columns=["value"], period=5, mode="ratio", group_column="user_id", time_column="ts", suffix="_r").select("event_id", F.col("value_r").alias("r"))


for _m in ("mean", "max", "min"):
    _f = {"mean": "avg"}.get(_m, _m)

    @query(f"impute_group_{_m}", f"SELECT event_id, coalesce(value, {_f}(value) OVER (PARTITION BY user_id), {_f}(value) OVER ()) AS value FROM ({HOLES})", "value")
    def _(s, sf, m=_m):
        return data.imputation(holes(s, sf), columns=["value"], method=m, group_column="user_id").select("event_id", "value")


@query("impute_linear", f"""
WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ({HOLES})),
n AS (SELECT *, last_value(value IGNORE NULLS) OVER o AS a, last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER o AS pa,
 first_value(value IGNORE NULLS) OVER f AS b, first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER f AS pb FROM h
 WINDOW o AS (PARTITION BY user_id ORDER BY p), f AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, coalesce(value, a + (b - a) * (p - pa) / (pb - pa), a, b) AS value FROM n""", "value")
def _(s, sf):
    return data.imputation(holes(s, sf), columns=["value"], method="interpolate", group_column="user_id").select("event_id", "value")


SCALES = {
    "scale_minmax": ("normalization", {"method": "minmax"}, "(l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ())"),
    "scale_maxabs": ("normalization", {"method": "maxabs"}, "l_quantity / max(abs(l_quantity)) OVER ()"),
    "zscore": ("standardization", {}, "(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()"),
    "robust_scale": ("standardization", {"method": "robust"}, "(l_quantity - (SELECT median(l_quantity) FROM lineitem)) / (SELECT quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) FROM lineitem)"),
}
for _n, (_fn, _p, _e) in SCALES.items():

    @query(_n, f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {_e} AS v FROM lineitem", "v")
    def _(s, sf, fn=_fn, p=_p):
        return getattr(data, fn)(item(s, sf), columns=["l_quantity"], **p).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"))


for _n, _norm in {"l1": "abs(l_quantity) + abs(l_tax)", "l2": "sqrt(l_quantity * l_quantity + l_tax * l_tax)"}.items():

    @query(f"scale_{_n}", f"SELECT l_orderkey, l_quantity / ({_norm}) AS q, l_tax / ({_norm}) AS t FROM lineitem", "q t")
    def _(s, sf, n=_n):
        return data.normalization(item(s, sf), columns=["l_quantity", "l_tax"], method=n).select("l_orderkey", F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))


@query("binarize", "SELECT l_orderkey, (l_quantity > 25)::BIGINT AS l_quantity_binary FROM lineitem")
def _(s, sf):
    return data.binarize(item(s, sf), columns=["l_quantity"], threshold=25).select("l_orderkey", "l_quantity_binary")


@query("polynomial_d2", "SELECT l_orderkey, l_tax * l_tax AS a, l_tax * l_discount AS b, l_discount * l_discount AS c FROM lineitem", "a b c")
def _(s, sf):
    p = data.polynomial_features(item(s, sf), columns=["l_tax", "l_discount"])
    return p.select("l_orderkey", F.col("`l_tax^2`").alias("a"), F.col("`l_tax*l_discount`").alias("b"), F.col("`l_discount^2`").alias("c"))


@query("discretize_uniform", "SELECT l_orderkey, least(floor((l_quantity - lo) / ((hi - lo) / 5)), 4) AS b FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)", "b")
def _(s, sf):
    return data.discretize(item(s, sf), columns=["l_quantity"], strategy="uniform").select("l_orderkey", F.col("l_quantity_bin").alias("b"))


@query("discretize_quantile", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem)
SELECT l_orderkey, (l_extendedprice >= a)::INT + (l_extendedprice >= b)::INT + (l_extendedprice >= c)::INT AS b FROM lineitem, q""", "b")
def _(s, sf):
    return data.discretize(item(s, sf), columns=["l_extendedprice"], n_bins=4).select("l_orderkey", F.col("l_extendedprice_bin").alias("b"))


@query("discretize_kmeans")
def _(s, sf):
    return data.discretize(item(s, sf), columns=["l_quantity"], strategy="kmeans", n_bins=3).select("l_orderkey", "l_quantity_bin")


@query("transform_log1p", "SELECT l_orderkey, ln(1 + l_extendedprice) AS v FROM lineitem", "v")
def _(s, sf):
    return data.transformation(item(s, sf), columns=["l_extendedprice"]).select("l_orderkey", F.col("l_extendedprice").alias("v"))


for _m in ("yeo-johnson", "quantile_normal"):

    @query(f"transform_{_m.replace('-', '_')}")
    def _(s, sf, m=_m):
        return data.transformation(events(s, sf, "event_id", "value"), columns=["value"], method=m, n_quantiles=100).select("event_id", "value")


@query("split_temporal", "SELECT event_id FROM events WHERE event_id < (SELECT (count(*) * 0.75)::BIGINT FROM events)")
def _(s, sf):
    return data.split(events(s, sf), method="temporal")["train"].select("event_id")


for _m, _p in {"random": {}, "group": {"group_column": "user_id"}, "stratified": {"stratify_column": "event_type"}}.items():

    @query(f"split_{_m}")
    def _(s, sf, m=_m, p=_p):
        return data.split(events(s, sf), method="random" if m == "stratified" else m, **p)["test"].select("event_id")


def _rows(spark, rows: dict[str, list]) -> DataFrame:
    import json

    return spark.createDataFrame([(k, json.dumps(v, default=str)) for k, v in rows.items()], "name string, value string")


@query("quality_report", """
SELECT 'duplicate_rows' AS name, (count(*) - count(DISTINCT value))::VARCHAR AS value FROM events UNION ALL
SELECT 'rows', count(*)::VARCHAR FROM events UNION ALL
SELECT 'label_changes', sum(c)::VARCHAR FROM (SELECT (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AND row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1)::INT AS c FROM events)""")
def _(s, sf):
    r = millrace.operators.quality.quality(events(s, sf), columns=["value"], group_column="user_id", label_column="event_type", time_column="ts", max_groups=1_000_000)
    return s.createDataFrame([("rows", str(r["rows"])), ("duplicate_rows", str(r["duplicate_rows"])), ("label_changes", str(sum(r["label_changes"].values())))], "name string, value string")


# --- windows and features -------------------------------------------------------------

GROUPS = "g AS (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS no FROM events GROUP BY user_id)"
NUMBERED = f"n AS (SELECT e.*, g.no, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY e.user_id) AS m FROM events e JOIN g USING (user_id))"


def row_windows(size: int, step: int) -> str:
    """CTEs g, n and w (rows of complete windows with their start)."""
    return f"{GROUPS}, {NUMBERED}, w AS (SELECT n.*, s.start FROM n JOIN (SELECT user_id, unnest(range(0, m - {size} + 1, {step})) AS start FROM (SELECT DISTINCT user_id, m FROM n)) s ON n.user_id = s.user_id AND n.pos >= s.start AND n.pos < s.start + {size})"


WID = "'g' || no || '_w' || start AS window_id"
SPEC = {"group_column": "user_id", "time_column": "ts"}


def _win_query(name: str, size: int, step: int, features: list[str], sql: dict[str, str], digits: int = 5):
    cols = ", ".join(f"{e} AS {k}" for k, e in sql.items())

    @query(name, f"WITH {row_windows(size, step)} SELECT {WID}, {cols} FROM w GROUP BY no, start", " ".join(sql), digits)
    def _(s, sf):
        out = feature.statistical(events(s, sf), columns=["value"], features=features, window_size=size, step=step, **SPEC)
        return out.select("window_id", *(F.col(f"value__{f}").alias(f) for f in features))


_win_query("window_tumbling_basic", 20, 0 or 20, ["mean", "std", "rms"], {"mean": "avg(value)", "std": "stddev_pop(value)", "rms": "sqrt(avg(value * value))"})
_win_query("window_sliding_basic", 20, 5, ["mean", "std", "rms"], {"mean": "avg(value)", "std": "stddev_pop(value)", "rms": "sqrt(avg(value * value))"})
_win_query("window_stats_moments", 20, 10, ["skewness", "kurtosis", "variance_gt_std", "std_gt_range", "crest_factor", "peak"], {
    "skewness": "avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * pow(avg(value), 3)", "kurtosis": "kurtosis_pop(value)",
    "variance_gt_std": "(var_pop(value) > stddev_pop(value))::INT", "std_gt_range": "(stddev_pop(value) > max(value) - min(value))::INT",
    "crest_factor": "max(abs(value)) / sqrt(avg(value * value))", "peak": "max(abs(value))",
}, 4)
ORACLES["window_stats_moments"] = ORACLES["window_stats_moments"].replace("+ 2 * pow(avg(value), 3) AS skewness", "+ 2 * pow(avg(value), 3) AS m3, pow(var_pop(value), 1.5) AS s3").replace(
    "SELECT * REPLACE (", "SELECT * EXCLUDE (m3, s3) REPLACE (").replace('round("skewness"::DOUBLE, 4) + 0.0 AS "skewness", ', "").replace(" FROM (WITH", ", round(m3 / s3, 4) + 0.0 AS skewness FROM (WITH", 1)
_win_query("window_stats_order", 20, 10, ["min", "max", "median", "quantile", "range", "iqr", "mad"], {
    "min": "min(value)", "max": "max(value)", "median": "median(value)", "quantile": "quantile_cont(value, 0.75)", "range": "max(value) - min(value)",
    "iqr": "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)", "mad": "mad(value)",
})
_win_query("window_stats_variance", 20, 10, ["variance"], {"variance": "var_pop(value)"}, 8)
LIST = "list(value ORDER BY pos)"
_win_query("window_stats_counts", 20, 10, ["count", "distinct_count", "count_above_mean", "count_below_mean", "duplicate_point_ratio", "max_repeated", "min_repeated"], {
    "count": "count(*)", "distinct_count": "count(DISTINCT value)",
    "count_above_mean": f"len(list_filter({LIST}, lambda x: x > list_avg({LIST})))", "count_below_mean": f"len(list_filter({LIST}, lambda x: x < list_avg({LIST})))",
    "duplicate_point_ratio": "1 - count(DISTINCT value) / count(*)", "max_repeated": "(len(list_filter(list(value), lambda x: x = list_max(list(value)))) > 1)::INT", "min_repeated": "(len(list_filter(list(value), lambda x: x = list_min(list(value)))) > 1)::INT",
})
_win_query("window_stats_positions", 20, 10, ["argmax_first", "argmax_last", "argmin_first", "argmin_last", "mean_delta", "mean_abs_delta", "mean_second_derivative", "time_reversal_asymmetry"], {
    "argmax_first": f"(list_position({LIST}, max(value)) - 1) / 19.0", "argmax_last": f"(20 - list_position(list_reverse({LIST}), max(value))) / 19.0",
    "argmin_first": f"(list_position({LIST}, min(value)) - 1) / 19.0", "argmin_last": f"(20 - list_position(list_reverse({LIST}), min(value))) / 19.0",
    "mean_delta": "avg(value) FILTER (pos - start >= 10) - avg(value) FILTER (pos - start < 10)", "mean_abs_delta": "abs(avg(value) FILTER (pos - start >= 10) - avg(value) FILTER (pos - start < 10))",
    "mean_second_derivative": f"(({LIST}[20] - {LIST}[19]) - ({LIST}[2] - {LIST}[1])) / 18", "time_reversal_asymmetry": f"list_avg(list_transform(range(1, 19), lambda i: pow({LIST}[i + 2] - {LIST}[i], 2)))",
}, 7)


@query("window_stats_repeats", f"""WITH {row_windows(20, 20)}, c AS (SELECT no, start, value, count(*) AS k FROM w GROUP BY ALL)
SELECT {WID}, coalesce(sum(k) FILTER (k > 1), 0) / 20 AS ratio, coalesce(sum(value * (k - 1)) FILTER (k > 1), 0) AS total FROM c GROUP BY no, start""", "ratio total")
def _(s, sf):
    out = feature.statistical(events(s, sf), columns=["value"], features=["repeated_value_ratio", "duplicate_sum"], window_size=20, **SPEC)
    return out.select("window_id", F.col("value__repeated_value_ratio").alias("ratio"), F.col("value__duplicate_sum").alias("total"))


@query("window_stats_runs", f"""WITH {row_windows(20, 20)}, a AS (SELECT *, value > avg(value) OVER (PARTITION BY no, start) AS up, value < avg(value) OVER (PARTITION BY no, start) AS down FROM w),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY no, start, up ORDER BY pos) AS iu, pos - row_number() OVER (PARTITION BY no, start, down ORDER BY pos) AS id FROM a),
u AS (SELECT no, start, max(c) AS m FROM (SELECT no, start, count(*) AS c FROM i WHERE up GROUP BY no, start, iu) GROUP BY ALL),
d AS (SELECT no, start, max(c) AS m FROM (SELECT no, start, count(*) AS c FROM i WHERE down GROUP BY no, start, id) GROUP BY ALL)
SELECT {WID}, coalesce(u.m, 0) AS up, coalesce(d.m, 0) AS down FROM (SELECT DISTINCT no, start FROM w) LEFT JOIN u USING (no, start) LEFT JOIN d USING (no, start)""", "up down")
def _(s, sf):
    out = feature.statistical(events(s, sf), columns=["value"], features=["longest_above_mean", "longest_below_mean"], window_size=20, **SPEC)
    return out.select("window_id", F.col("value__longest_above_mean").alias("up"), F.col("value__longest_below_mean").alias("down"))


@query("window_all_statistics")
def _(s, sf):
    return feature.statistical(events(s, sf), columns=["value"], features=list(STATISTICS), window_size=32, step=16, **SPEC)


for _p, _e in {"last": "arg_max(event_type, pos)", "mode": "(SELECT NULL)"}.items():
    _sql = f"WITH {row_windows(10, 10)} SELECT {WID}, {_e} AS label FROM w GROUP BY no, start" if _p == "last" else f"WITH {row_windows(10, 10)}, c AS (SELECT no, start, event_type, count(*) AS k FROM w GROUP BY ALL) SELECT {WID}, arg_min(event_type, (-k, event_type)) AS label FROM c GROUP BY no, start"

    @query(f"window_label_{_p}", _sql)
    def _(s, sf, p=_p):
        return feature.statistical(events(s, sf), columns=["value"], label_column="event_type", label_policy=p, window_size=10, **SPEC).select("window_id", "label")


@query("window_label_strict", f"WITH {row_windows(10, 10)} SELECT {WID}, min(user_id) AS label FROM w GROUP BY no, start")
def _(s, sf):
    return feature.statistical(events(s, sf), columns=["value"], label_column="user_id", window_size=10, **SPEC).select("window_id", "label")


@query("window_per_column_plan", f"WITH {row_windows(10, 10)} SELECT {WID}, avg(value) AS a, max(event_id) AS b FROM w GROUP BY no, start", "a b")
def _(s, sf):
    out = feature.statistical(events(s, sf), columns=["value", "event_id"], features=["mean"], column_features={"event_id": ["max"]}, window_size=10, **SPEC)
    return out.select("window_id", F.col("value__mean").alias("a"), F.col("event_id__max").alias("b"))


SPAN = f"""RECURSIVE {GROUPS}, e AS (SELECT event_id, event_type, value, no, epoch_us(ts) / 1e6 AS t FROM events JOIN g USING (user_id)),
l AS (SELECT no, max(t) AS last, min(t) AS first FROM e GROUP BY no),
a AS (SELECT no, first AS t0 FROM l WHERE first + 259200 <= last + 1e-6 UNION ALL
  SELECT no, t0 FROM (SELECT a.no, min(e.t) AS t0, any_value(l.last) AS last FROM a JOIN e ON e.no = a.no AND e.t >= a.t0 + 86400 JOIN l ON l.no = a.no GROUP BY a.no, a.t0) WHERE t0 + 259200 <= last + 1e-6),
w AS (SELECT a.no, a.t0, e.* EXCLUDE (no) FROM a JOIN e ON e.no = a.no AND e.t >= a.t0 AND e.t < a.t0 + 259200)"""
SPAN_SPEC = SPEC | {"window_span": "3d", "step_span": "1d"}
TID = "'g' || no || '_t' || floor(t0)::BIGINT AS window_id"


@query("span_windows", f"WITH {SPAN} SELECT {TID}, count(*) AS n_rows, avg(value) AS m FROM w GROUP BY no, t0", "m", 8)
def _(s, sf):
    return feature.statistical(events(s, sf), columns=["value"], features=["mean"], **SPAN_SPEC).select("window_id", "n_rows", F.col("value__mean").alias("m"))


@query("window_thin_filter", f"WITH {SPAN} SELECT {TID}, count(*) AS n_rows FROM w GROUP BY no, t0 HAVING count(*) >= 8")
def _(s, sf):
    return feature.statistical(events(s, sf), columns=["value"], features=["mean"], min_window_rows=8, **SPAN_SPEC).select("window_id", "n_rows")


for _policy in ("drop", "positive", "negative"):
    for _gap in ("", "12h"):
        _g = 43200 if _gap else 0
        _now = {"drop": "NULL", "positive": "1", "negative": "0"}[_policy]

        @query(f"horizon_labels_{_policy}" + ("_gap" if _gap else ""), f"""WITH {SPAN}, f AS (SELECT no, t0, max((value > 120)::INT) AS bad FROM w GROUP BY no, t0),
p AS (SELECT f.no, f.t0, max((e.value > 120)::INT) AS ahead FROM f JOIN e ON e.no = f.no AND e.t > f.t0 + 259200 + {_g} AND e.t <= f.t0 + 345600 + {_g} GROUP BY ALL)
SELECT {TID}, y AS label FROM (SELECT f.no, f.t0, CASE WHEN bad = 1 THEN {_now} WHEN f.t0 + 345600 + {_g} <= last + 1e-6 THEN ahead END::BIGINT AS y FROM f JOIN l ON l.no = f.no LEFT JOIN p ON p.no = f.no AND p.t0 = f.t0) WHERE y IS NOT NULL""")
        def _(s, sf, policy=_policy, gap=_gap):
            return feature.statistical(events(s, sf).withColumn("hot", (F.col("value") > 120).cast("long")), columns=["value"], features=["mean"], label_column="hot", label_policy="horizon", prediction_horizon="1d", prediction_gap=gap, current_fault_policy=policy, **SPAN_SPEC).select("window_id", "label")


@query("fit_linear_windows", f"""WITH {row_windows(20, 20)}, f AS (SELECT no, start, regr_slope(value, pos - start) AS a, regr_intercept(value, pos - start) AS b, regr_r2(value, pos - start) AS r FROM w GROUP BY no, start)
SELECT {WID}, a, b, r FROM f""", "a b r")
def _(s, sf):
    out = feature.fitting(events(s, sf).drop("ts"), columns=["value"], group_column="user_id", window_size=20)
    return out.select("window_id", F.col("value__coef_1").alias("a"), F.col("value__coef_0").alias("b"), F.col("value__r2").alias("r"))


ORACLES["fit_linear_windows"] = ORACLES["fit_linear_windows"].replace("ORDER BY ts, event_id", "ORDER BY event_id")

ROLL = f"({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
for _m, _e in {
    "mean": f"avg(value) OVER {ROLL}", "std": f"stddev_pop(value) OVER {ROLL}", "variance": f"var_pop(value) OVER {ROLL}", "median": f"median(value) OVER {ROLL}",
    "max": f"max(value) OVER {ROLL}", "min": f"min(value) OVER {ROLL}", "max_repeat": f"(len(list_filter(list(value) OVER {ROLL}, lambda x: x = list_max(list(value) OVER {ROLL}))) > 1)::INT",
}.items():
    _inner = f"SELECT event_id, {_e} AS v FROM events" if _m != "max_repeat" else f"SELECT event_id, (len(list_filter(a, lambda x: x = m)) > 1)::INT AS v FROM (SELECT event_id, list(value) OVER {ROLL} AS a, max(value) OVER {ROLL} AS m FROM events)"

    @query(f"rolling_{_m}", _inner, "v", 8 if _m == "variance" else 5)
    def _(s, sf, m=_m):
        r = feature.rolling_statistics(events(s, sf), columns=["value"], method=m, window=5, group_column="user_id", time_column="ts")
        return keyed(r).select("event_id", F.col(f"value__rolling_{m}_5").alias("v"))


DIFF = f"d AS (SELECT event_id, user_id, ts, value, value - lag(value) OVER ({W}) AS d, lag(value) OVER ({W}) AS l, row_number() OVER ({W}) AS p FROM events)"
for _m, _sql in {
    "first_difference": f"WITH {DIFF} SELECT event_id, coalesce(d, 0) AS v FROM d",
    "second_difference": f"WITH {DIFF} SELECT event_id, coalesce(d - lag(d) OVER ({W}), 0) AS v FROM d",
    "sum_abs_change": f"WITH {DIFF} SELECT event_id, coalesce(sum(abs(d)) OVER ({W} ROWS BETWEEN 18 PRECEDING AND CURRENT ROW), 0) AS v FROM d",
    "autocorrelation": f"""WITH {DIFF}, c AS (SELECT event_id, p, covar_pop(value, l) OVER f AS c, stddev_pop(CASE WHEN l IS NOT NULL THEN value END) OVER f * stddev_pop(l) OVER f AS s FROM d WINDOW f AS ({W} ROWS BETWEEN 18 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN p >= 3 THEN CASE WHEN s > 1e-12 THEN c / s ELSE 0 END END AS v FROM c""",
}.items():

    @query(f"temporal_{_m}", _sql, "v", 4)
    def _(s, sf, m=_m):
        r = feature.temporal(events(s, sf), columns=["value"], method=m, group_column="user_id", time_column="ts")
        return keyed(r).select("event_id", F.col([c for c in r.columns if c != RID][0]).alias("v"))


#: Runs of equal values of a user's series; a peak run lies above both neighbours (r: rows, k: peak runs from f to l).
RUNS = f"""r AS (SELECT event_id, user_id, value, row_number() OVER ({W}) - 1 AS i FROM events),
u AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run FROM (SELECT *, coalesce(value <> lag(value) OVER (PARTITION BY user_id ORDER BY i), true)::INT AS new FROM r)),
v AS (SELECT user_id, run, min(i) AS f, max(i) AS l, any_value(value) AS level FROM u GROUP BY user_id, run),
k AS (SELECT * FROM (SELECT *, lag(level) OVER o AS before, lead(level) OVER o AS after FROM v WINDOW o AS (PARTITION BY user_id ORDER BY run)) WHERE level > before AND level > after)"""


@query("temporal_peak_count", f"WITH {RUNS} SELECT r.event_id, count(k.run)::DOUBLE AS v FROM r LEFT JOIN k ON k.user_id = r.user_id AND k.f > r.i - 19 AND k.l < r.i GROUP BY r.event_id", "v")
def _(s, sf):
    r = keyed(feature.temporal(events(s, sf), columns=["value"], method="peak_count", window=20, group_column="user_id", time_column="ts"))
    return r.select("event_id", F.col("value__peak_count_20").alias("v"))


@query("entropy_hist_windows", f"""WITH {row_windows(20, 20)}, b AS (SELECT no, start, least(floor((value - lo) / (hi - lo) * 16), 15) AS b FROM (SELECT *, min(value) OVER (PARTITION BY no, start) AS lo, max(value) OVER (PARTITION BY no, start) AS hi FROM w)),
c AS (SELECT no, start, b, count(*) / 20.0 AS p FROM b GROUP BY ALL) SELECT {WID}, -sum(p * log2(p)) AS h FROM c GROUP BY no, start""", "h")
def _(s, sf):
    out = feature.entropy(events(s, sf), columns=["value"], methods=["information_entropy"], window_size=20, **SPEC)
    return out.select("window_id", F.col("value__information_entropy").alias("h"))


#: Templates of two and of three values; every one is compared with all of its window.
APEN = f"""WITH {row_windows(20, 20)}, t AS (SELECT no, start, pos - start AS i, value AS a, lead(value) OVER o AS b, lead(value, 2) OVER o AS c, 0.2 * stddev_pop(value) OVER (PARTITION BY no, start) AS r FROM w WINDOW o AS (PARTITION BY no, start ORDER BY pos)),
two AS (SELECT p.no, p.start, p.i, avg((greatest(abs(p.a - q.a), abs(p.b - q.b)) <= p.r)::INT) AS c FROM t AS p JOIN t AS q USING (no, start) WHERE p.i <= 18 AND q.i <= 18 GROUP BY ALL),
three AS (SELECT p.no, p.start, p.i, avg((greatest(abs(p.a - q.a), abs(p.b - q.b), abs(p.c - q.c)) <= p.r)::INT) AS c FROM t AS p JOIN t AS q USING (no, start) WHERE p.i <= 17 AND q.i <= 17 GROUP BY ALL)
SELECT {WID}, phi - psi AS v FROM (SELECT no, start, avg(ln(c)) AS phi FROM two GROUP BY ALL) JOIN (SELECT no, start, avg(ln(c)) AS psi FROM three GROUP BY ALL) USING (no, start)"""


@query("entropy_approximate", APEN, "v")
def _(s, sf):
    out = feature.entropy(events(s, sf), columns=["value"], methods=["approximate_entropy"], window_size=20, **SPEC)
    return out.select("window_id", F.col("value__approximate_entropy").alias("v"))


#: A discrete Fourier transform of 32 tapered samples, bin by bin.
DFT = f"""WITH {row_windows(32, 32)}, t AS (SELECT no, start, pos - start AS i, value - avg(value) OVER (PARTITION BY no, start) AS x, 0.5 - 0.5 * cos(2 * pi() * (pos - start) / 31) AS h FROM w),
d AS (SELECT no, start, k, sum(x * h * cos(2 * pi() * k * i / 32)) AS re, sum(x * h * sin(2 * pi() * k * i / 32)) AS im, sum(h) AS taper FROM t, range(1, 17) AS b(k) GROUP BY ALL),
p AS (SELECT no, start, k, k / 32 AS f, (re * re + im * im) AS p, CASE WHEN k = 16 THEN 1 ELSE 2 END * sqrt(re * re + im * im) / taper AS amp FROM d),
q AS (SELECT *, p / sum(p) OVER z AS e, first_value(k) OVER (PARTITION BY no, start ORDER BY amp DESC, k) AS top, sum(p * f) OVER z / sum(p) OVER z AS centre FROM p WINDOW z AS (PARTITION BY no, start)),
m AS (SELECT no, start, sqrt(sum(x * x * h * h) / sum(h * h)) AS rms FROM t GROUP BY ALL)
SELECT {WID}, any_value(top) / 32 AS dominant_frequency, max(amp) AS dominant_amplitude, any_value(centre) AS spectral_centroid, sqrt(sum((f - centre) ** 2 * e)) AS spectral_spread, -sum(e * ln(e)) / ln(16) AS spectral_entropy,
any_value(rms) AS spectral_rms, sum(e) FILTER (k > 8) AS high_frequency_ratio, coalesce(sum(e) FILTER (k IN (2 * top, 3 * top, 4 * top, 5 * top) AND k < 16), 0) AS harmonic_ratio,
sum(e) FILTER (k <= 4) AS band_energy_ratio_0, sum(e) FILTER (k > 4 AND k <= 8) AS band_energy_ratio_1, sum(e) FILTER (k > 8) AS band_energy_ratio_2 FROM q JOIN m USING (no, start) GROUP BY no, start"""
SPECTRUM = "dominant_frequency dominant_amplitude spectral_centroid spectral_spread spectral_entropy spectral_rms high_frequency_ratio harmonic_ratio band_energy_ratio_0 band_energy_ratio_1 band_energy_ratio_2"


@query("spectral_windows", DFT, SPECTRUM)
def _(s, sf):
    from millrace.functions.kernels import SPECTRAL

    out = feature.spectral(events(s, sf), columns=["value"], features=list(SPECTRAL), sampling_rate=1.0, window_size=32, **SPEC)
    return out.select("window_id", *(F.col(f"value__{n}").alias(n) for n in SPECTRUM.split()))


#: Haar details of the trailing 16 values (the oldest one stands in for missing ones) and their robust peaks.
HAAR = f"""WITH {RUNS}, a AS (SELECT p.event_id, j, q.value AS x FROM r AS p, range(16) AS b(j), r AS q WHERE q.user_id = p.user_id AND q.i = greatest(0, p.i - 15 + j)),
one AS (SELECT event_id, j // 2 AS j, sum(x) AS x, (max(x) - min(x)) ** 2 / 2 AS e FROM a GROUP BY event_id, j // 2), two AS (SELECT event_id, j // 2 AS j, sum(x) AS x, (max(x) - min(x)) ** 2 / 4 AS e FROM one GROUP BY event_id, j // 2),
three AS (SELECT event_id, j // 2 AS j, (max(x) - min(x)) ** 2 / 8 AS e FROM two GROUP BY event_id, j // 2),
e AS (SELECT event_id, a, b, c, a + b + c AS t FROM (SELECT event_id, sum(e) AS a FROM one GROUP BY ALL) JOIN (SELECT event_id, sum(e) AS b FROM two GROUP BY ALL) USING (event_id) JOIN (SELECT event_id, sum(e) AS c FROM three GROUP BY ALL) USING (event_id)),
m AS (SELECT p.event_id, p.user_id, p.i, median(q.value) AS mid, 1.4826 * mad(q.value) AS s FROM r AS p JOIN r AS q ON q.user_id = p.user_id AND q.i BETWEEN p.i - 15 AND p.i GROUP BY ALL),
n AS (SELECT m.event_id, count(k.run) AS n FROM m LEFT JOIN k ON k.user_id = m.user_id AND k.f > m.i - 15 AND k.l < m.i AND m.s > 0 AND abs(k.level - mid) > 3 * s GROUP BY ALL)
SELECT event_id, CASE WHEN t > 0 THEN a / t ELSE 0 END AS energy_1, CASE WHEN t > 0 THEN b / t ELSE 0 END AS energy_2, CASE WHEN t > 0 THEN c / t ELSE 0 END AS energy_3, CASE WHEN t <= 0 THEN 0 WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END AS dominant, n AS peaks FROM e JOIN n USING (event_id)"""


@query("wavelet_rows", HAAR, "energy_1 energy_2 energy_3 dominant peaks")
def _(s, sf):
    out = keyed(feature.wavelet(events(s, sf), columns=["value"], window=16, **SPEC))
    names = {f"energy_level_{k}": f"energy_{k}" for k in (1, 2, 3)} | {"dominant_level": "dominant", "peak_count": "peaks"}
    return out.select("event_id", *(F.col(f"value__wavelet_{n}").alias(a) for n, a in names.items()))


#: Over 20 even steps t and the centred square are orthogonal, so each coefficient is a slope of its own.
QUADRATIC = f"""WITH {row_windows(20, 20)}, f AS (SELECT no, start, regr_slope(value, pos - start) AS b, regr_slope(value, (pos - start - 9.5) ** 2) AS c, avg(value) AS m, corr(value, pos - start) ** 2 + corr(value, (pos - start - 9.5) ** 2) ** 2 AS r, var_pop(value) AS v FROM w GROUP BY no, start)
SELECT {WID}, c AS coef_2, b - 19 * c AS coef_1, m - 9.5 * b + 57 * c AS coef_0, r AS r2, r AS trend_strength, 0 AS residual_mean, sqrt(v * (1 - r)) AS residual_std FROM f""".replace("ORDER BY ts, event_id", "ORDER BY event_id")
QUADRATIC_FIT = "coef_2 coef_1 coef_0 r2 trend_strength residual_mean residual_std"


@query("fit_polynomial_windows", QUADRATIC, QUADRATIC_FIT)
def _(s, sf):
    out = feature.fitting(events(s, sf).drop("ts"), columns=["value"], fitting_method="polynomial", group_column="user_id", window_size=20)
    return out.select("window_id", *(F.col(f"value__{n}").alias(n) for n in QUADRATIC_FIT.split()))


def orders(s, sf):
    return table(s, sf, "orders", "o_orderkey")


@query("encode_onehot", "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS f, (o_orderstatus = 'O')::INT AS o, (o_orderstatus = 'P')::INT AS p FROM orders", "f o p")
def _(s, sf):
    e = feature.categorical(orders(s, sf), columns=["o_orderstatus"])["features"]
    return keyed(e, "o_orderkey").select("o_orderkey", *(F.col(f"`o_orderstatus={k}`").alias(k.lower()) for k in "FOP"))


@query("encode_ordinal", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS v FROM orders", "v")
def _(s, sf):
    e = feature.categorical(orders(s, sf), columns=["o_orderpriority"], method="ordinal")["features"]
    return keyed(e, "o_orderkey").select("o_orderkey", F.col("o_orderpriority__ordinal").alias("v"))


@query("encode_frequency", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) / count(*) OVER () AS v FROM orders", "v")
def _(s, sf):
    e = feature.categorical(orders(s, sf), columns=["o_orderpriority"], method="frequency")["features"]
    return keyed(e, "o_orderkey").select("o_orderkey", F.col("o_orderpriority__frequency").alias("v"))


@query("encode_category_statistics", "SELECT o_orderkey, count(*) OVER p AS n, avg(o_totalprice) OVER p AS m, stddev_pop(o_totalprice) OVER p AS s FROM orders WINDOW p AS (PARTITION BY o_orderpriority)", "n m s", 2)
def _(s, sf):
    e = feature.categorical(orders(s, sf), columns=["o_orderpriority"], method="category_statistics", target_column="o_totalprice")["features"]
    return keyed(e, "o_orderkey").select("o_orderkey", *(F.col(f"o_orderpriority__{k}").alias(a) for k, a in (("count", "n"), ("mean", "m"), ("std", "s"))))


@query("encode_target_oof")
def _(s, sf):
    return keyed(feature.categorical(orders(s, sf), columns=["o_orderpriority"], method="target", target_column="o_totalprice")["features"], "o_orderkey")


@query("encode_unseen", """
WITH t AS (SELECT o_orderpriority, avg(o_totalprice) AS m FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority <> '5-LOW' GROUP BY ALL)
SELECT o_orderkey, coalesce(t.m, (SELECT avg(o_totalprice) FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority <> '5-LOW')) AS v FROM orders LEFT JOIN t USING (o_orderpriority) WHERE o_orderkey % 2 = 1""", "v", 2)
def _(s, sf):
    enc = feature.categorical(orders(s, sf).where("o_orderkey % 2 = 0 and o_orderpriority <> '5-LOW'"), columns=["o_orderpriority"], method="target", target_column="o_totalprice")["encoder"]
    return keyed(feature.categorical_transform(orders(s, sf).where("o_orderkey % 2 = 1"), enc), "o_orderkey").select("o_orderkey", F.col("o_orderpriority__target").alias("v"))


@query("merge_branches", f"WITH {row_windows(20, 20)} SELECT {WID}, avg(value) AS a, max(value) AS b FROM w GROUP BY no, start", "a b")
def _(s, sf):
    a = feature.statistical(events(s, sf), columns=["value"], features=["mean"], window_size=20, **SPEC)
    b = feature.statistical(events(s, sf), columns=["value"], features=["max"], window_size=20, **SPEC)
    return feature.merge(a, b).select("window_id", F.col("value__mean").alias("a"), F.col("value__max").alias("b"))


@query("feature_select", "SELECT event_id, value FROM events", "value")
def _(s, sf):
    return feature.select(events(s, sf), columns=["event_id", "value"])


@query("feature_impute_median", f"SELECT event_id, coalesce(value, (SELECT median(value) FROM ({HOLES}))) AS value FROM ({HOLES})", "value")
def _(s, sf):
    return feature.feature_imputation(holes(s, sf), columns=["value"], method="median").select("event_id", "value")


def line_features(s, sf):
    return item(s, sf).select("l_quantity", "l_extendedprice", "l_discount", "l_tax", RID)


@query("select_variance", "SELECT * FROM (VALUES ('l_extendedprice', true), ('l_quantity', true), ('l_discount', false), ('l_tax', false)) t(feature, selected)")
def _(s, sf):
    return feature.score_select(line_features(s, sf), top_k=2)["scores"].select("feature", "selected")


@query("select_corr_prune", "SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, true AS selected")
def _(s, sf):
    return feature.score_select(line_features(s, sf), method="correlation")["scores"].select("feature", "selected")


for _m in ("mutual_information", "importance"):

    @query(f"select_{_m}")
    def _(s, sf, m=_m):
        t = item(s, sf)
        return feature.score_select(line_features(s, sf), data.labels(t, column="l_returnflag"), method=m)["scores"]


@query("pca_variance", "SELECT var_samp(l_quantity) + var_samp(l_discount) + var_samp(l_tax) AS total FROM lineitem", "total", 4)
def _(s, sf):
    return feature.pca(line_features(s, sf).drop("l_extendedprice"), n_components=3)["variance"].agg(F.sum("variance").alias("total"))


# --- explore --------------------------------------------------------------------------

TWO = ("l_quantity", "l_discount")
_union = lambda e: " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {e.format(c=c)} AS value FROM lineitem" for c in TWO)
for _m, _e in {"mean": "avg({c})", "median": "median({c})"}.items():

    @query(f"tendency_{_m}", _union(_e), "value")
    def _(s, sf, m=_m):
        return explore.central_tendency(item(s, sf), columns=TWO, method=m)


@query("tendency_mode", "SELECT 'l_quantity' AS \"column\", l_quantity AS value, count(*) AS n FROM lineitem GROUP BY l_quantity HAVING count(*) = (SELECT max(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity))", "value")
def _(s, sf):
    return explore.central_tendency(item(s, sf), columns=["l_quantity"], method="mode")


@query("weighted_mean", "SELECT 'l_discount' AS \"column\", sum(l_discount * l_quantity) / sum(l_quantity) AS value FROM lineitem", "value")
def _(s, sf):
    return explore.central_tendency(item(s, sf), columns=["l_discount"], method="weighted_mean", weight_column="l_quantity")


for _m, _e in {"std": "stddev_samp({c})", "variance": "var_samp({c})", "range": "max({c}) - min({c})", "iqr": "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", "mad": "mad({c})", "cv": "stddev_samp({c}) / avg({c})"}.items():

    @query(f"dispersion_{_m}", _union(_e), "value")
    def _(s, sf, m=_m):
        return explore.dispersion(item(s, sf), columns=TWO, method=m)


def _corr(expr):
    return " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {expr(a, b)} AS value FROM r" for a in TWO for b in TWO)


@query("corr_pearson", f"WITH r AS (SELECT * FROM lineitem) {_corr(lambda a, b: f'corr({a}, {b})')}", "value")
def _(s, sf):
    return explore.correlation(item(s, sf), columns=TWO)


@query("corr_spearman", f"WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS l_quantity, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS l_discount FROM lineitem) {_corr(lambda a, b: f'corr({a}, {b})')}", "value")
def _(s, sf):
    return explore.correlation(item(s, sf), columns=TWO, method="spearman")


@query("corr_kendall", """
WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) AS s FROM c a, c b), m AS (SELECT sum(n) AS m FROM c),
tx AS (SELECT sum(n * (n - 1)) AS t FROM (SELECT sum(n) AS n FROM c GROUP BY x)), ty AS (SELECT sum(n * (n - 1)) AS t FROM (SELECT sum(n) AS n FROM c GROUP BY y)),
v AS (SELECT s / sqrt((m * (m - 1) - tx.t)::DOUBLE * (m * (m - 1) - ty.t)::DOUBLE) AS v FROM s, m, tx, ty)
SELECT 'l_quantity' AS column_a, 'l_discount' AS column_b, v AS value FROM v UNION ALL SELECT 'l_discount', 'l_quantity', v FROM v UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_discount', 'l_discount', 1.0""", "value")
def _(s, sf):
    return explore.correlation(item(s, sf), columns=TWO, method="kendall")


@query("distribution_summary", """SELECT 'value' AS "column", count(value) AS count, avg(value) AS mean, stddev_pop(value) AS std, kurtosis_pop(value) AS kurtosis, quantile_cont(value, 0.05) AS q05, median(value) AS median, quantile_cont(value, 0.95) AS q95 FROM events""", "mean std kurtosis q05 median q95", 4)
def _(s, sf):
    return explore.distribution(events(s, sf), columns=["value"]).select("column", "count", "mean", "std", "kurtosis", "q05", "median", "q95")


@query("histogram", """SELECT b::BIGINT AS bin, count(*) AS n FROM (SELECT least(floor((value - lo) / ((hi - lo) / 20)), 19) AS b FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)) GROUP BY b""")
def _(s, sf):
    h = explore.distribution(events(s, sf), columns=["value"]).select(F.posexplode("histogram").alias("bin", "n"))
    return h.where("n > 0")


def halves(s, sf):
    e = events(s, sf, "event_id", "value")
    return e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").withColumn("value", F.col("value") * 1.1)


HALVES = "r AS (SELECT value AS v FROM events WHERE event_id % 2 = 0), c AS (SELECT value * 1.1 AS v FROM events WHERE event_id % 2 = 1)"


@query("drift_psi", f"""WITH {HALVES}, q AS (SELECT list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM r), b AS (SELECT unnest(range(0, 10)) AS b),
pr AS (SELECT len(list_filter(e, lambda x: v >= x)) AS b, count(*) / (SELECT count(*) FROM r) AS p FROM r, q GROUP BY ALL), pc AS (SELECT len(list_filter(e, lambda x: v >= x)) AS b, count(*) / (SELECT count(*) FROM c) AS p FROM c, q GROUP BY ALL)
SELECT sum((greatest(coalesce(pc.p, 0), 1e-6) - greatest(coalesce(pr.p, 0), 1e-6)) * ln(greatest(coalesce(pc.p, 0), 1e-6) / greatest(coalesce(pr.p, 0), 1e-6))) AS psi FROM b LEFT JOIN pr USING (b) LEFT JOIN pc USING (b)""", "psi", 4)
def _(s, sf):
    return explore.concept_drift(*halves(s, sf), columns=["value"]).select("psi")


@query("drift_ks", f"""WITH {HALVES}, u AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT v, 1 AS a, 0 AS b FROM r UNION ALL SELECT v, 0, 1 FROM c) GROUP BY v)
SELECT max(abs(d)) AS ks FROM (SELECT sum(a) OVER (ORDER BY v) / (SELECT count(*) FROM r) - sum(b) OVER (ORDER BY v) / (SELECT count(*) FROM c) AS d FROM u)""", "ks")
def _(s, sf):
    return explore.concept_drift(*halves(s, sf), columns=["value"]).select("ks")


@query("kl_js", f"""WITH {HALVES}, e AS (SELECT min(v) AS lo, max(v) AS hi FROM (SELECT v FROM r UNION ALL SELECT v FROM c)), b AS (SELECT unnest(range(0, 10)) AS b),
k AS (SELECT b, greatest(coalesce(x.n, 0) / (SELECT count(*) FROM r), 1e-9) AS p, greatest(coalesce(y.n, 0) / (SELECT count(*) FROM c), 1e-9) AS q FROM b
 LEFT JOIN (SELECT least(floor((v - lo) / ((hi - lo) / 10)), 9)::BIGINT AS b, count(*) AS n FROM r, e GROUP BY ALL) x USING (b) LEFT JOIN (SELECT least(floor((v - lo) / ((hi - lo) / 10)), 9)::BIGINT AS b, count(*) AS n FROM c, e GROUP BY ALL) y USING (b)),
z AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM k)
SELECT sum(q * ln(q / p)) AS kl, (sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2 AS js FROM z""", "kl js")
def _(s, sf):
    return explore.kl_divergence(*halves(s, sf), columns=["value"]).select("kl", "js")


ACF = """c AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT user_id, sum(d * d) AS s FROM c GROUP BY ALL)"""


@query("acf_groups", f"WITH {ACF} SELECT a.user_id, k AS lag, any_value(a.n) AS n, sum(a.d * b.d) / any_value(s.s) AS acf FROM c a JOIN (SELECT unnest(range(0, 6)) AS k) ON true JOIN c b ON a.user_id = b.user_id AND b.p = a.p - k JOIN s ON s.user_id = a.user_id WHERE s.s > 0 GROUP BY a.user_id, k", "acf")
def _(s, sf):
    return explore.acf(events(s, sf), columns=["value"], max_lag=5, group_column="user_id").select("user_id", "lag", "n", "acf")


@query("periodicity", """WITH c AS (SELECT value - avg(value) OVER () AS d, row_number() OVER (ORDER BY event_id) AS p FROM events), t AS (SELECT sum(d * d) AS s FROM c),
a AS (SELECT k, sum(x.d * y.d) / any_value(t.s) AS r FROM c x JOIN (SELECT unnest(range(1, 21)) AS k) ON true JOIN c y ON y.p = x.p - k, t GROUP BY k) SELECT arg_max(k, r) AS lag, max(r) AS strength FROM a""", "strength")
def _(s, sf):
    return explore.periodicity(events(s, sf), columns=["value"], max_lag=20).select("lag", "strength")


@query("cross_relation", """WITH c AS (SELECT value AS x, user_id::DOUBLE AS y, row_number() OVER (ORDER BY event_id) AS p FROM events)
SELECT k AS lag, corr(a.x, b.y) AS value, count(*) AS sample_count FROM c a JOIN (SELECT unnest(range(-5, 6)) AS k) ON true JOIN c b ON b.p = a.p - k GROUP BY k""", "value")
def _(s, sf):
    return explore.cross_relation(events(s, sf), first_column="value", second_column="user_id", max_lag=5)


@query("boxplot_anomaly", """WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS a, median(value) AS m, quantile_cont(value, 0.75) AS b FROM events GROUP BY user_id)
SELECT event_id, a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS bad FROM events JOIN q USING (user_id)""", "lo hi")
def _(s, sf):
    r = explore.anomaly(events(s, sf), columns=["value"], group_column="user_id")
    return keyed(r).select("event_id", F.col("value__lower").alias("lo"), F.col("value__upper").alias("hi"), F.col("is_anomaly").alias("bad"))


@query("dynamic_threshold", f"""WITH a AS (SELECT event_id, value, median(value) OVER f AS m, list(value) OVER f AS l FROM events WINDOW f AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, 1.4826 * list_median(list_transform(l, lambda x: abs(x - m))) AS s FROM a), c AS (SELECT *, CASE WHEN s > 0 THEN s ELSE (SELECT stddev_pop(value) FROM events) END AS k FROM b)
SELECT event_id, m AS center, m - 3 * k AS lo, m + 3 * k AS hi FROM c""", "center lo hi", 7)
def _(s, sf):
    r = explore.anomaly(events(s, sf), columns=["value"], method="dynamic_threshold", window=10, group_column="user_id", time_column="ts")
    return keyed(r).select("event_id", F.col("value__center").alias("center"), F.col("value__lower").alias("lo"), F.col("value__upper").alias("hi"))


@query("hyperbolic_smoothing", f"""WITH d AS (SELECT event_id, value AS x, avg(value) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a, (SELECT stddev_pop(value) FROM events) AS s FROM events),
m AS (SELECT *, a + s * tanh((x - a) / s) AS m FROM d),
f AS (SELECT event_id, x AS value__value, m AS value__center, m - 3 * s AS value__lower, m + 3 * s AS value__upper, abs(x - m) / s AS value__score, x < m - 3 * s OR x > m + 3 * s AS value__is_anomaly FROM m)
SELECT *, value__is_anomaly AS is_anomaly FROM f""", "value__value value__center value__lower value__upper value__score", 4)
def _(s, sf):
    return keyed(explore.anomaly(events(s, sf), columns=["value"], method="hyperbolic_smoothing", group_column="user_id", time_column="ts"))


@query("slope_cosine", f"""WITH d AS (SELECT event_id, user_id, ts, value AS x, event_id::DOUBLE AS y, row_number() OVER ({W}) AS i, value - lag(value) OVER ({W}) AS dx, event_id - lag(event_id) OVER ({W}) AS dy FROM events),
r AS (SELECT event_id, i, regr_slope(x, i) OVER f AS a, regr_slope(y, i) OVER f AS b, sum(dx * dy) OVER h / sqrt(sum(dx * dx) OVER h * sum(dy * dy) OVER h) AS c FROM d WINDOW f AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), h AS ({W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN i >= 10 THEN a END AS first_slope, CASE WHEN i >= 10 THEN b END AS second_slope, CASE WHEN i >= 10 THEN c END AS cosine FROM r""", "first_slope second_slope cosine", 3)
def _(s, sf):
    e = events(s, sf).withColumn("y", F.col("event_id").cast("double"))
    r = explore.slope_cosine(e, first_column="value", second_column="y", window=10, group_column="user_id", time_column="ts")
    return keyed(r).select("event_id", "first_slope", "second_slope", "cosine")


FREE = {
    "peaks": lambda s, sf: explore.peaks(events(s, sf), columns=["value"], prominence=5.0, group_column="user_id"),
    "normality": lambda s, sf: explore.normality(events(s, sf), columns=["value"]),
    "isotonic": lambda s, sf: explore.isotonic(events(s, sf), x_column="event_id", y_column="value"),
    "gbr_fit": lambda s, sf: explore.gbr_fit(line_features(s, sf), columns=["l_quantity", "l_discount"], target_column="l_extendedprice", n_estimators=5)["statistics"],
    "hp_filter": lambda s, sf: explore.hp_filter(events(s, sf), column="value", group_column="user_id", time_column="ts").drop("trend"),
    "stationarity": lambda s, sf: explore.stationarity(events(s, sf), column="value", group_column="user_id", time_column="ts", max_lag=2),
    "dtw": lambda s, sf: explore.dtw_distance(events(s, sf), first_column="value", second_column="event_id", band=20, group_column="user_id", time_column="ts"),
    "sbd": lambda s, sf: explore.shape_distance(events(s, sf), first_column="value", second_column="event_id", group_column="user_id", time_column="ts"),
}
#: Where only SQL's own functions are needed.
_SERIES = RUNS.replace("ORDER BY ts, event_id", "ORDER BY event_id")
FREE_SQL = {
    "peaks": (f"""WITH {_SERIES}, p AS (SELECT user_id, (f + l) // 2 AS i, level FROM k),
h AS (SELECT p.user_id, p.i, level, max(r.i) FILTER (r.i < p.i AND value > level) AS a, min(r.i) FILTER (r.i > p.i AND value > level) AS b FROM p JOIN r USING (user_id) GROUP BY ALL),
g AS (SELECT h.user_id, h.i, level, min(value) FILTER (r.i < h.i AND r.i > coalesce(a, -1)) AS lo, min(value) FILTER (r.i > h.i AND (b IS NULL OR r.i < b)) AS hi FROM h JOIN r USING (user_id) GROUP BY ALL),
z AS (SELECT * FROM g WHERE level - greatest(lo, hi) >= 5)
SELECT u.user_id::VARCHAR AS series, 'value' AS "column", count(z.i) AS peaks, avg(level) AS mean_height, CASE WHEN count(z.i) > 1 THEN (max(z.i) - min(z.i)) / (count(z.i) - 1) END AS mean_spacing FROM (SELECT DISTINCT user_id FROM events) AS u LEFT JOIN z USING (user_id) GROUP BY u.user_id""", "mean_height mean_spacing", 8),
    "normality": ("""WITH m AS (SELECT avg(value) AS m FROM events), c AS (SELECT count(value)::DOUBLE AS n, avg((value - m) ** 2) AS c2, avg((value - m) ** 3) AS c3, avg((value - m) ** 4) AS c4 FROM events, m),
s AS (SELECT n, c3 / c2 ** 1.5 AS skew, c4 / c2 ** 2 AS b2, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM c),
w AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / root * (2 / root + sqrt(1 + 4 / root ** 2)) AS a, (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x FROM s),
z AS (SELECT *, asinh(skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS z1, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS t FROM w),
k AS (SELECT *, z1 ** 2 + ((1 - 2 / (9 * a) - sign(t) * cbrt(abs(t))) / sqrt(2 / (9 * a))) ** 2 AS k2 FROM z)
SELECT 'value' AS "column", n::BIGINT AS n, skew AS skewness, b2 - 3 AS kurtosis, k2 AS statistic, exp(-k2 / 2) AS p_value, exp(-k2 / 2) >= 0.05 AS normal FROM k""", "skewness kurtosis statistic p_value"),
    "sbd": (f"""WITH r AS (SELECT user_id, row_number() OVER ({W}) - 1 AS i, count(*) OVER g AS n, (value - avg(value) OVER g) / stddev_pop(value) OVER g AS a, (event_id - avg(event_id) OVER g) / stddev_pop(event_id) OVER g AS b FROM events WINDOW g AS (PARTITION BY user_id)),
c AS (SELECT p.user_id, p.i - q.i AS lag, sum(p.a * q.b) / p.n AS c FROM r AS p JOIN r AS q USING (user_id) WHERE abs(p.i - q.i) <= p.n // 2 GROUP BY p.user_id, p.i - q.i, p.n)
SELECT user_id::VARCHAR AS series, 1 - max(c) AS distance, arg_max(lag, c) AS lag FROM c GROUP BY user_id""", "distance"),
}
for _n, _f in FREE.items():
    query(_n, *FREE_SQL.get(_n, ()))(_f)


# --- visual ---------------------------------------------------------------------------


def _points(spark, plot: dict) -> DataFrame:
    rows = [(s["name"], float(x), float(y)) for s in plot["series"] for x, y in zip(s["x"], s["y"])]
    return spark.createDataFrame(rows, "series string, x double, y double")


STRIDE = "SELECT {c} FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, ceil(count(*) OVER () / 500.0)::BIGINT AS k FROM events {w}) WHERE i % k = 0"


@query("visual_scatter", STRIDE.format(c="'value' AS series, event_id::DOUBLE AS x, value AS y", w=""), "x y")
def _(s, sf):
    return _points(s, visual.scatter(events(s, sf), x="event_id", y="value"))


@query("visual_line", STRIDE.format(c="'value' AS series, event_id::DOUBLE AS x, value AS y", w=""), "x y")
def _(s, sf):
    return _points(s, visual.line(events(s, sf), time_column="event_id", value_columns=["value"]))


@query("visual_subplot", STRIDE.format(c="'value' AS series, event_id::DOUBLE AS x, value AS y", w=""), "x y")
def _(s, sf):
    p = visual.subplot(events(s, sf), x="event_id", value_columns=["value"])
    return _points(s, {"series": [x for panel in p["panels"] for x in panel["series"]]})


@query("visual_histogram", "SELECT b::BIGINT AS bin, count(*) AS n FROM (SELECT least(floor((l_quantity - lo) / ((hi - lo) / 10)), 9) AS b FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)) GROUP BY b")
def _(s, sf):
    h = visual.histogram(item(s, sf), columns=["l_quantity"], bins=10)["series"][0]["values"]
    return s.createDataFrame([(i, n) for i, n in enumerate(h) if n], "bin long, n long")


@query("visual_compare", STRIDE.format(c="'even value' AS series, event_id::DOUBLE AS x, value AS y", w="WHERE event_id % 2 = 0") + " UNION ALL " + STRIDE.format(c="'odd value' AS series, event_id::DOUBLE AS x, value AS y", w="WHERE event_id % 2 = 1"), "x y")
def _(s, sf):
    e = events(s, sf)
    return _points(s, visual.compare(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), columns=["value"], x_column="event_id", first_name="even", second_name="odd"))


@query("visual_anomaly", "SELECT count(*) AS anomalies FROM events WHERE value > 100")
def _(s, sf):
    e = events(s, sf)
    p = visual.anomaly(e, e.select(RID, (F.col("value") > 100).alias("bad")), x="event_id", y="value", anomaly_column="bad")
    return s.createDataFrame([(p["anomaly_count"],)], "anomalies long")


@query("visual_relationship", "SELECT 'l_quantity' AS source, 'l_extendedprice' AS target, corr(l_quantity, l_extendedprice) AS weight FROM lineitem WHERE true HAVING abs(corr(l_quantity, l_extendedprice)) >= 0.3", "weight")
def _(s, sf):
    e = visual.relationship(line_features(s, sf))["edges"]
    return s.createDataFrame([(x["source"], x["target"], x["weight"]) for x in e], "source string, target string, weight double")


@query("overview", " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS distinct_values FROM events" for c in ("event_id", "user_id", "event_type", "value")))
def _(s, sf):
    o = visual.overview(events(s, sf, "event_id", "user_id", "event_type", "value"))
    return s.createDataFrame([(c["name"], c["distinct"]) for c in o["columns"]], "name string, distinct_values long")


@query("label_balance", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY event_type")
def _(s, sf):
    o = visual.overview(events(s, sf, "event_type", "value"), label_column="event_type")
    return s.createDataFrame([(k, v["count"]) for k, v in o["label_balance"].items()], "label string, n long")


# --- detectors ------------------------------------------------------------------------


def _flags(r) -> DataFrame:
    return keyed(r["prediction"]).select("event_id", "score", F.col("is_anomaly").alias("bad"))


PN = f"p AS (SELECT event_id, user_id, ts, value AS x, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
FR = f"a AS ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), b AS ({W} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)"


@query("level_shift", f"""WITH {PN}, r AS (SELECT event_id, pos, n, sqrt(var_samp(x) OVER a / 10 + var_samp(x) OVER b / 10) AS e, abs(avg(x) OVER b - avg(x) OVER a) AS d FROM p WINDOW {FR}),
s AS (SELECT event_id, CASE WHEN pos >= 10 AND pos <= n - 10 AND e > 0 THEN d / e END AS score FROM r) SELECT event_id, score, coalesce(score > 4, false) AS bad FROM s""", "score", 4)
def _(s, sf):
    return _flags(validation.level_shift_detector(events(s, sf), column="value", window=10, **SPEC))


@query("volatility_shift", f"""WITH {PN}, r AS (SELECT event_id, pos, n, var_samp(x) OVER a AS va, var_samp(x) OVER b AS vb, 1e-12 * greatest(var_samp(x) OVER (PARTITION BY user_id), 1) AS f FROM p WINDOW {FR}),
s AS (SELECT event_id, CASE WHEN pos >= 10 AND pos <= n - 10 THEN abs(ln((vb + f) / (va + f))) / sqrt(2 / 9.0) END AS score FROM r) SELECT event_id, score, coalesce(score > 4, false) AS bad FROM s""", "score", 4)
def _(s, sf):
    return _flags(validation.volatility_shift_detector(events(s, sf), column="value", window=10, **SPEC))


for _m, _sql in {
    "global": "SELECT event_id, abs(value - avg(value) OVER ()) / stddev_pop(value) OVER () AS score FROM events",
    "group": "SELECT event_id, CASE WHEN stddev_pop(value) OVER g > 0 THEN abs(value - avg(value) OVER g) / stddev_pop(value) OVER g ELSE 0 END AS score FROM events WINDOW g AS (PARTITION BY user_id)",
    "rolling": f"SELECT event_id, CASE WHEN count(*) OVER f >= 5 AND stddev_pop(value) OVER f > 0 THEN abs(value - avg(value) OVER f) / stddev_pop(value) OVER f END AS score FROM events WINDOW f AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
}.items():

    @query(f"nsigma_{_m}", f"SELECT event_id, score, coalesce(score > 3, false) AS bad FROM ({_sql})", "score", 4)
    def _(s, sf, m=_m):
        return _flags(validation.nsigma_detector(events(s, sf), column="value", mode=m, window=10, **SPEC))


@query("cusum", f"""WITH {PN}, f AS (SELECT user_id, avg(x) AS m, stddev_samp(x) AS s FROM p WHERE pos < floor(n * 0.3) GROUP BY user_id),
d AS (SELECT p.*, CASE WHEN pos >= floor(n * 0.3) THEN (x - m) / s - 0.5 ELSE 0 END AS u, CASE WHEN pos >= floor(n * 0.3) THEN (x - m) / s + 0.5 ELSE 0 END AS l FROM p JOIN f USING (user_id)),
c AS (SELECT *, sum(u) OVER ({W}) AS su, sum(l) OVER ({W}) AS sl FROM d), k AS (SELECT *, su - least(0, min(su) OVER ({W})) AS up, sl - greatest(0, max(sl) OVER ({W})) AS low FROM c),
s AS (SELECT event_id, CASE WHEN pos >= floor(n * 0.3) THEN greatest(up, -low) END AS score FROM k) SELECT event_id, score, coalesce(score > 5, false) AS bad FROM s""", "score", 4)
def _(s, sf):
    return _flags(validation.mean_drift_detector(events(s, sf), column="value", **SPEC))


@query("persistence", "SELECT event_id, coalesce(sum((value > 50)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3, false) AS bad FROM events")
def _(s, sf):
    return _flags(validation.persistence_detector(events(s, sf), column="value", threshold=50, group_column="user_id")).select("event_id", "bad")


@query("seasonal_detector", f"""WITH {PN}, q AS (SELECT *, pos % 5 AS ph, pos < greatest(5, floor(n * 0.5)) AS ref FROM p), m AS (SELECT user_id, ph, median(x) AS m FROM q WHERE ref GROUP BY ALL),
r AS (SELECT q.*, x - m AS r FROM q JOIN m USING (user_id, ph)), k AS (SELECT user_id, 1.4826 * mad(r) FILTER (ref) AS s, 1.4826 * mad(x) AS w FROM r GROUP BY user_id),
z AS (SELECT event_id, CASE WHEN s > 0 THEN abs(r) / s WHEN w > 0 THEN abs(r) / w ELSE 0 END AS score FROM r JOIN k USING (user_id)) SELECT event_id, score, score > 4 AS bad FROM z""", "score", 4)
def _(s, sf):
    return _flags(validation.seasonal_detector(events(s, sf), column="value", period=5, **SPEC))


#: Two lags: the normal equations of centred moments by Cramer's rule.
AUTOREGRESSION = f"""WITH d AS (SELECT user_id, event_id, value AS x, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS ({W})),
t AS (SELECT *, pos < floor(n * 0.5) AS train FROM d),
m AS (SELECT user_id, avg(x) AS my, avg(l1) AS m1, avg(l2) AS m2, var_pop(l1) AS a, covar_pop(l1, l2) AS b, var_pop(l2) AS c, covar_pop(l1, x) AS p, covar_pop(l2, x) AS q FROM t WHERE train AND pos >= 2 GROUP BY user_id),
k AS (SELECT user_id, my, m1, m2, (p * c - q * b) / (a * c - b * b) AS b1, (q * a - p * b) / (a * c - b * b) AS b2 FROM m),
r AS (SELECT t.*, x - (my - b1 * m1 - b2 * m2 + b1 * l1 + b2 * l2) AS r FROM t JOIN k USING (user_id)),
g AS (SELECT user_id, median(r) AS mid FROM r WHERE train AND pos >= 2 GROUP BY user_id),
s AS (SELECT user_id, 1.4826 * median(abs(r - mid)) AS s FROM r JOIN g USING (user_id) WHERE train AND pos >= 2 GROUP BY user_id)
SELECT event_id, CASE WHEN NOT train AND s > 0 THEN abs(r) / s END AS score, coalesce(NOT train AND s > 0 AND abs(r) / s > 4, false) AS bad FROM r JOIN s USING (user_id)"""


@query("autoregression_detector", AUTOREGRESSION, "score", 3)
def _(s, sf):
    return _flags(validation.autoregression_detector(events(s, sf), column="value", **SPEC))


@query("esd_detector")
def _(s, sf):
    return _flags(validation.esd_detector(events(s, sf), column="value", **SPEC))


# --- models ---------------------------------------------------------------------------


def embedded(s, sf) -> DataFrame:
    """One column for every element of the longest embedding."""
    e = table(s, sf, "embeddings", "vec_id")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return e.select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(size)), F.col("label").cast("string").alias("class"), RID)


def elements(e: DataFrame) -> list[str]:
    return [c for c in e.columns if c not in ("vec_id", "class", RID)]


def _features(s, sf):
    e = embedded(s, sf)
    return feature.select(e, columns=elements(e)), data.labels(e, column="class")


MODELS = {
    "random_forest": {"n_estimators": 10, "max_depth": 4}, "decision_tree": {"max_depth": 4}, "svm": {"kernel": "rbf"}, "reservoir_classifier": {"reservoir_size": 20},
}
for _n, _p in MODELS.items():

    @query(_n)
    def _(s, sf, n=_n, p=_p):
        return keyed(getattr(validation, n)(*_features(s, sf), **p)["prediction"], "vec_id").select("vec_id", "actual", "prediction")


@query("xgboost")
def _(s, sf):
    f, _y = _features(s, sf)
    y = data.labels(embedded(s, sf).withColumn("b", (F.col("class") == "0").cast("string")), column="b")
    return keyed(validation.boosted_trees(f, y, n_estimators=5)["prediction"], "vec_id").select("vec_id", "actual", "prediction")


@query("grid_search")
def _(s, sf):
    g = validation.grid_search(*_features(s, sf), algorithm="decision_tree", param_grid={"max_depth": [2, 4]}, cv_folds=2)
    return s.createDataFrame([(r["rank"], r["params"]["max_depth"], r["score"]) for r in g["metrics"]["table"]], "rank long, max_depth long, score double")


@query("compare_metrics")
def _(s, sf):
    a = validation.decision_tree(*_features(s, sf), max_depth=2)["metrics"]
    b = validation.decision_tree(*_features(s, sf), max_depth=5)["metrics"]
    c = validation.compare(a, b)
    return s.createDataFrame([(k, *map(float, v)) for k, v in c.items()], "metric string, first double, second double")


@query("linear_regression", """SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem""", "slope intercept", 3)
def _(s, sf):
    m = validation.fit_linear(item(s, sf).withColumn("__t", F.col("l_extendedprice")), ["l_quantity"], "__t")
    return s.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double")


@query("ridge_regression", """WITH m AS (SELECT covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 100) AS b, avg(l_extendedprice) AS y, avg(l_quantity) AS x FROM lineitem) SELECT b AS slope, y - b * x AS intercept FROM m""", "slope intercept", 3)
def _(s, sf):
    m = validation.fit_linear(item(s, sf).withColumn("__t", F.col("l_extendedprice")), ["l_quantity"], "__t", alpha=100.0)
    return s.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double")


for _n in ("linear_regression", "ridge"):

    @query(f"holdout_{_n}")
    def _(s, sf, n=_n):
        t = item(s, sf)
        return getattr(validation, n)(feature.select(t, columns=["l_quantity", "l_discount"]), data.labels(t, column="l_extendedprice"))["prediction"]


HOLT = """WITH RECURSIVE o AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT *, n - greatest(1, round_even(n * 0.25, 0))::BIGINT AS k FROM o),
t AS (SELECT user_id, min_by(v, i) AS level, (max_by(v, i) - min_by(v, i)) / (count(*) - 1) AS trend FROM c WHERE i <= least(k, 5) GROUP BY user_id),
r(user_id, i, level, trend) AS (SELECT user_id, 1::BIGINT, level, trend FROM t UNION ALL
  SELECT user_id, i, level, 0.1 * (level - was) + 0.9 * trend FROM (SELECT c.user_id, c.i, r.level AS was, 0.3 * c.v + 0.7 * (r.level + r.trend) AS level, r.trend FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i + 1 AND c.i <= c.k))
SELECT c.user_id::VARCHAR AS series, c.i - c.k AS step, c.v AS actual, r.level + (c.i - c.k) * r.trend AS prediction FROM c JOIN r ON r.user_id = c.user_id AND r.i = c.k WHERE c.i > c.k"""


@query("holt", HOLT, "actual prediction", 4)
def _(s, sf):
    return validation.exponential_smoothing(events(s, sf), column="value", group_column="user_id", time_column="ts")["prediction"]


@query("arma")
def _(s, sf):
    return validation.arma(events(s, sf), column="value", group_column="user_id", time_column="ts")["prediction"]


@query("arima")
def _(s, sf):
    return validation.arima(events(s, sf), column="value", group_column="user_id", time_column="ts")["prediction"]


#: Distances of all pairs of standardised embeddings.
PAIRS = """u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT k, avg(x) AS m, coalesce(nullif(stddev_pop(x), 0), 1) AS s FROM u GROUP BY k),
z AS (SELECT vec_id, list((x - m) / s ORDER BY k) AS z FROM u JOIN s USING (k) GROUP BY vec_id),
p AS (SELECT a.vec_id, b.vec_id AS other, list_distance(a.z, b.z) AS d FROM z AS a, z AS b)"""
DBSCAN = """WITH {pairs}, near AS (SELECT * FROM p WHERE d <= {eps}), core AS (SELECT vec_id FROM near GROUP BY vec_id HAVING count(*) >= 5)
SELECT z.vec_id, coalesce(min(d), 'inf'::DOUBLE) AS score, min(d) IS NULL AS is_anomaly FROM z LEFT JOIN (SELECT near.* FROM near JOIN core ON other = core.vec_id) AS c ON c.vec_id = z.vec_id GROUP BY z.vec_id"""
DETECTORS = {
    "knn_detector": f"""WITH {PAIRS}, r AS (SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM p), t AS (SELECT vec_id, avg(d) AS score FROM r WHERE r <= 5 GROUP BY vec_id)
SELECT vec_id, score, score >= (SELECT quantile_cont(score, 0.95) FROM t) AS is_anomaly FROM t""",
    "dbscan_detector": DBSCAN.format(pairs=PAIRS, eps=1),
}
for _n in ("knn_detector", "isolation_forest_detector", "dbscan_detector", "pca_detector", "min_cluster_detector", "one_class_svm"):
    _p = {"min_cluster_detector": {"n_clusters": 4}, "pca_detector": {"n_components": 2}}.get(_n, {})

    @query(_n, DETECTORS.get(_n), "score", 4)
    def _(s, sf, n=_n, p=_p):
        e = embedded(s, sf)
        return keyed(getattr(validation, n)(e, columns=elements(e), **p)["prediction"], "vec_id").select("vec_id", "score", "is_anomaly")


@query("dbscan_wide", DBSCAN.format(pairs=PAIRS, eps=9.4), "score", 4)
def _(s, sf):
    e = embedded(s, sf)
    return keyed(validation.dbscan_detector(e, columns=elements(e), eps=9.4)["prediction"], "vec_id").select("vec_id", "score", "is_anomaly")


@query("kmeans")
def _(s, sf):
    e = embedded(s, sf)
    return keyed(validation.kmeans(e, columns=elements(e), n_clusters=4)["prediction"], "vec_id")


# --- evaluation -----------------------------------------------------------------------

PRED = "SELECT event_id, event_type AS actual, CASE WHEN value > 30 THEN 'click' WHEN event_id % 3 = 0 THEN 'error' ELSE 'view' END AS predicted, value FROM events"


def predicted(s, sf):
    e = events(s, sf)
    guess = F.when(F.col("value") > 30, "click").when(F.col("event_id") % 3 == 0, "error").otherwise("view")
    return e.select(RID, F.col("event_type").alias("actual"), guess.alias("prediction"), "value")


@query("confusion_matrix", f"SELECT actual, predicted, count(*) AS n FROM ({PRED}) GROUP BY ALL")
def _(s, sf):
    return evaluation.confusion(predicted(s, sf))


@query("class_metrics", f"""WITH p AS ({PRED}), k AS (SELECT actual AS class FROM p UNION SELECT predicted FROM p)
SELECT class, coalesce(tp / nullif(pr, 0), 0) AS precision, coalesce(tp / nullif(su, 0), 0) AS recall, coalesce(2 * tp / nullif(pr + su, 0), 0) AS f1, su::BIGINT AS support
FROM (SELECT class, (SELECT count(*) FROM p WHERE actual = class AND predicted = class) AS tp, (SELECT count(*) FROM p WHERE predicted = class) AS pr, (SELECT count(*) FROM p WHERE actual = class) AS su FROM k)""", "precision recall f1")
def _(s, sf):
    return evaluation.class_metrics(predicted(s, sf))


@query("ranking_metrics", """WITH p AS (SELECT (event_type = 'error')::INT AS y, value AS s FROM events), c AS (SELECT s, sum(y) AS p, count(*) AS n FROM p GROUP BY s),
r AS (SELECT *, sum(n) OVER (ORDER BY s) - (n - 1) / 2 AS k, sum(n) OVER (ORDER BY s DESC) AS seen, sum(p) OVER (ORDER BY s DESC) AS hit FROM c), t AS (SELECT sum(p) AS p, sum(n) AS n FROM c)
SELECT (sum(r.p * k) - any_value(t.p) * (any_value(t.p) + 1) / 2) / (any_value(t.p) * (any_value(t.n) - any_value(t.p))) AS roc_auc, sum(r.p / t.p * hit / seen) AS pr_auc FROM r, t""", "roc_auc pr_auc")
def _(s, sf):
    m = evaluation.ranking_metrics(events(s, sf).select((F.col("event_type") == "error").cast("int").alias("y"), F.col("value").alias("score")))
    return s.createDataFrame([(m["roc_auc"], m["pr_auc"])], "roc_auc double, pr_auc double")


@query("purge_overlap", f"""WITH {row_windows(20, 10)}, c AS (SELECT no, start, min(event_id) AS a, max(event_id) + 1 AS b FROM w GROUP BY no, start), h AS (SELECT * FROM c WHERE start >= 40)
SELECT {WID} FROM c WHERE start < 40 AND NOT EXISTS (SELECT 1 FROM h WHERE h.no = c.no AND c.a < h.b AND h.a < c.b)""")
def _(s, sf):
    f = feature.statistical(events(s, sf), columns=["value"], features=["mean"], window_size=20, step=10, **SPEC)
    start = F.regexp_extract("window_id", "_w([0-9]+)", 1).cast("long")
    dense = f.withColumns({RID: F.col("rid_start"), "rid_start": F.col("group_no") * 1_000_000 + start, "rid_stop": F.col("group_no") * 1_000_000 + start + 20})
    return windows.purge(dense.where(start < 40), dense.where(start >= 40)).select("window_id")


@query("split_class_aware")
def _(s, sf):
    f = feature.statistical(events(s, sf), columns=["value"], features=["mean"], label_column="event_type", label_policy="last", window_size=20, **SPEC)
    return evaluation.group_split(f, "group_label", "label", 0.25, 42)[1].select("window_id", "label")
