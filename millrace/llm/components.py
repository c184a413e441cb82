"""Connected components by alternating large-star and small-star rounds.

Edges are distinct pairs of 64-bit node names. Each round replaces a node's links by
links to its least neighbour; minima are pre-aggregated, the join back is salted by the
neighbour, and every round is written to the shared folder, so lineage stays short and
no node's links meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.durable import materialize

SALTS = 8


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m) with m the least v of each u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", "m", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("s"))
    return pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "s"]).drop("s")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, a: str, b: str, keep_for: str = "call") -> DataFrame:
    """(node, root) for every node that is not the least of its component."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e, "edges", keep_for)
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large)
        nxt = small.select("u", F.col("m").alias("v")).union(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        e = materialize(nxt.distinct(), "edges", keep_for)
        if (new := _mark(e)) == mark:
            break
        mark = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
