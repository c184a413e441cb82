"""Positions, quantiles and ordered frames of a whole table without a task that sees all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BUCKETS = 4096
FEW = 100_000


def nth_smallest(df: DataFrame, value: Column, n: int) -> int | None:
    """The n-th smallest (from 1) of a bigint column, by histograms of ever narrower ranges."""
    t = df.select(value.cast("long").alias("v")).where("v is not null")
    lo, hi, rows = t.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not rows or not 1 <= n <= rows:
        return None
    while rows > FEW and hi > lo:
        width = max(1, -(-(hi - lo + 1) // BUCKETS))
        slot = F.floor((F.col("v").cast("decimal(38,0)") - F.lit(lo)) / F.lit(width)).cast("long")
        counts = sorted((r["b"], r["n"]) for r in t.groupBy(slot.alias("b")).agg(F.count("*").alias("n")).collect())
        for b, k in counts:
            if n <= k:
                break
            n -= k
        lo, hi, rows = lo + b * width, min(hi, lo + (b + 1) * width - 1), k
        t = t.where(F.col("v").between(lo, hi))
    return lo if hi == lo else t.orderBy("v").limit(n).collect()[-1]["v"]


def exact_quantiles(df: DataFrame, columns: dict[str, Column], points) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several columns, as ``percentile`` gives them.

    That aggregate holds all distinct values in one task, so it serves up to ``FEW`` rows. Beyond
    them each round counts, in one scan for all columns, the rows of ``BUCKETS`` slots of every
    range that holds a wanted rank, and goes on inside the slots that hold one.
    """
    points = [float(p) for p in points]
    sizes = df.agg(*(f(v).alias(f"{k}{i}") for i, v in enumerate(columns.values()) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    if max(sizes[f"n{i}"] for i in range(len(columns))) <= FEW:
        one = df.agg(*(F.percentile(v, F.array(*map(F.lit, points))).alias(f"q{i}") for i, v in enumerate(columns.values()))).first()
        return {c: one[f"q{i}"] or [None] * len(points) for i, c in enumerate(columns)}
    found: dict[tuple[int, int], float] = {}
    todo = []  # (column, rank in the whole, rank in the range, lo, hi, rows)
    for i in range(len(columns)):
        n, lo, hi = (sizes[f"{k}{i}"] for k in ("n", "lo", "hi"))
        wanted = {r for p in points for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))} if n else ()
        todo += [(i, r, r, lo, hi, n) for r in wanted]
    values = list(columns.values())
    while todo:
        found |= {(i, r): lo for i, r, _, lo, hi, _ in todo if lo == hi}
        todo = [t for t in todo if t[3] != t[4]]
        ranges = sorted({(i, lo, hi, n) for i, _, _, lo, hi, n in todo})
        if not ranges:
            break
        last = all(n <= FEW // len(ranges) for *_, n in ranges)
        inside = [F.when(values[i].between(F.lit(lo), F.lit(hi)), F.struct(F.lit(k).alias("k"), values[i].alias("v"), (F.lit(0) if last else _slot(values[i], lo, hi)).alias("s"))) for k, (i, lo, hi, _) in enumerate(ranges)]
        rows = df.select(F.explode(F.array_compact(F.array(*inside))).alias("x")).select("x.*")
        by = rows.groupBy("k", "v" if last else "s").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        slots: dict[tuple, list] = {}
        for r in by:
            slots.setdefault(ranges[r["k"]][:3], []).append((r["lo"], r["hi"], r["n"]))
        nxt = []
        for i, rank, k, lo, hi, _ in todo:
            for a, b, n in sorted(slots[i, lo, hi]):
                if k < n:
                    break
                k -= n
            nxt.append((i, rank, k, a, b, n))
        todo = nxt
    out = {}
    for i, c in enumerate(columns):
        n = sizes[f"n{i}"]
        out[c] = []
        for p in points:
            at = (n - 1) * p
            a, b = math.floor(at), math.ceil(at)
            out[c].append(None if not n else found[i, a] if a == b else (b - at) * found[i, a] + (at - a) * found[i, b])
    return out


def _slot(v: Column, lo: float, hi: float) -> Column:
    """A slot of [lo, hi] that grows with v and differs at both ends."""
    if math.isinf(lo) or math.isinf(hi):
        scale, bend = F.atan, math.atan
    elif (wide := math.copysign(math.log1p(abs(hi)), hi) - math.copysign(math.log1p(abs(lo)), lo)) > 1 or not math.isfinite(hi - lo):
        scale, bend = (lambda x: F.signum(x) * F.log1p(F.abs(x))), (lambda x: math.copysign(math.log1p(abs(x)), x))
    else:
        scale, bend = (lambda x: x - F.lit(lo)), (lambda x: x - lo)
    a, b = bend(lo), bend(hi)
    place = F.floor((scale(v) - F.lit(a)) / F.lit(b - a) * F.lit(BUCKETS - 1))
    inner = F.least(F.greatest(place, F.lit(0)), F.lit(BUCKETS - 2)) if b > a else F.lit(0)
    return F.when(v >= F.lit(hi), F.lit(BUCKETS - 1)).otherwise(inner).cast("int")


def positioned(df: DataFrame, order: str | list[Column], name: str) -> DataFrame:
    """Adds the row's position (from 0) in a unique order: range partitions, then offsets."""
    from millrace.plans.durable import materialize

    order = [F.col(order)] if isinstance(order, str) else order
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ranged")
    base = placed.groupBy("__p").agg(F.count("*").alias("__c"))
    base = base.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__base"))  # one row per partition
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return placed.join(F.broadcast(base), "__p").withColumn(name, F.col("__base") + local).drop("__p", "__base")


# --- one sequence in bands ------------------------------------------------------------

#: Rows of a band, which one task orders.
BAND = 1 << 16


def banded(df: DataFrame, order: list[Column], back: int = 0, ahead: int = 0) -> tuple[DataFrame, WindowSpec]:
    """One sequence as bands of ``BAND`` rows, each with the rows that frames of its own rows reach.

    Adds ``__pos`` and ``__band``; the window is ordered inside a band. ``own_rows`` must follow.
    """
    placed = positioned(df, order, "__pos")
    first, last = F.greatest(F.lit(0), F.expr(f"(__pos - {ahead}) div {BAND}")), F.expr(f"(__pos + {back}) div {BAND}")
    return placed.withColumn("__band", F.explode(F.sequence(first, last))), Window.partitionBy("__band").orderBy("__pos")


def filled_bands(df: DataFrame, order: list[Column], columns: list[str]) -> tuple[DataFrame, WindowSpec]:
    """As ``banded``; a band also gets the last row before it and the first after it that has each column."""
    placed = positioned(df, order, "__pos").withColumn("__band", F.expr(f"__pos div {BAND}"))
    held = lambda f, c: f(F.when(F.col(c).isNotNull(), F.col("__pos")))
    ends = placed.groupBy("__band").agg(*(held(f, c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("a", F.max), ("b", F.min))))
    w = Window.orderBy("__band")  # one row per band
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    reach = [x for i in range(len(columns)) for x in (F.max(f"a{i}").over(before), F.min(f"b{i}").over(after))]
    more = ends.select("__band", F.array_distinct(F.array_compact(F.array(*reach))).alias("x")).select("__band", F.explode("x").alias("__pos"))
    extra = placed.drop("__band").join(more, "__pos").select(*placed.columns)
    return placed.unionByName(extra), Window.partitionBy("__band").orderBy("__pos")


def own_rows(df: DataFrame) -> DataFrame:
    """The bands' own rows, each once, without the columns of the bands."""
    return df.where(F.expr(f"__pos div {BAND} = __band")).drop("__pos", "__band")


def before_bands(df: DataFrame, **totals: Column) -> DataFrame:
    """(__band, totals): each band's aggregate over all earlier bands; ``totals`` are sum, min or max of one column."""
    per = df.groupBy("__band").agg(*(c.alias(n) for n, c in totals.items()))
    w = Window.orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)  # one row per band
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    return per.select("__band", *(fold[n.partition("_")[0]](n).over(w).alias(n) for n in totals))
