"""Exact neighbours within a table, without a task that sees all rows.

Distinct points fall into cells around pivots, and large cells into blocks. A query first
meets the block it would belong to; the k-th distance there bounds its search, and the
triangle inequality leaves out every cell that lies beyond the bound. What stays is exact; in many
dimensions little can be left out, and the work is quadratic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.durable import materialize

#: Pivots at most: their coordinates, radii and block counts are all that the driver holds.
PIVOTS = 1024
#: Bytes of the coordinates of a block, and queries that one task puts to a block at most.
BLOCK_BYTES, QUERIES = 1 << 22, 1 << 18
#: Queries whose distances to a block are held at once.
AT_ONCE = 512


METRICS = ("euclidean", "manhattan", "chebyshev")


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by products: fit to choose by, not to report."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0.0)


def _lengths(gaps: np.ndarray, metric: str) -> np.ndarray:
    """Lengths of vectors (the last axis)."""
    if metric == "euclidean":
        return np.sqrt((gaps**2).sum(-1))
    return np.abs(gaps).sum(-1) if metric == "manhattan" else np.abs(gaps).max(-1, initial=0.0)


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances; Euclidean ones by products, with their rounding."""
    if metric == "euclidean":
        return np.sqrt(squares(a, b))
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        gap = np.abs(a[:, i, None] - b[None, :, i])
        out = out + gap if metric == "manhattan" else np.maximum(out, gap)
    return out


def _room(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """More than the rounding of distances by products."""
    return 1e-6 * (1 + np.sqrt((a * a).sum(1))[:, None] + np.sqrt((b * b).sum(1)))


def count_in_block(x: np.ndarray, points: np.ndarray, copies: np.ndarray, eps: float, metric: str) -> np.ndarray:
    """How many rows lie within ``eps`` of every query; doubtful pairs are measured again."""
    out = np.zeros(len(x))
    for at in range(0, len(x), AT_ONCE):
        q = x[at : at + AT_ONCE]
        d = _distances(q, points, metric)
        near = d <= eps
        i, j = np.nonzero(np.abs(d - eps) <= _room(q, points))
        for cut in range(0, len(i), 1 << 16):
            m, n = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
            near[m, n] = _lengths(q[m] - points[n], metric) <= eps
        out[at : at + AT_ONCE] = near @ copies
    return out[:, None]


def nearest_in_block(x: np.ndarray, points: np.ndarray, copies: np.ndarray, k: int, metric: str) -> np.ndarray:
    """The k least distances of every query, ascending; a point counts once for each copy."""
    out = np.full((len(x), k), np.inf)
    few = min(k, len(points))
    for at in range(0, len(x) if few else 0, AT_ONCE):
        q = x[at : at + AT_ONCE]
        pick = np.argpartition(_distances(q, points, metric), few - 1, axis=1)[:, :few]
        d = _lengths(q[:, None, :] - points[pick], metric)
        order = np.argsort(d, axis=1)
        d, n = np.take_along_axis(d, order, 1), np.take_along_axis(np.minimum(copies, k)[pick], order, 1)
        upto = n.cumsum(1)
        which = (upto[:, None, :] <= np.arange(k)[None, :, None]).sum(-1)  # few where no copy is left
        out[at : at + AT_ONCE] = np.take_along_axis(np.c_[d, np.full(len(d), np.inf)], which, 1)
    return out


class Neighbours:
    """The rows of a table as a searchable set; ``rows`` has an array column ``x`` without nulls."""

    def __init__(self, rows: DataFrame, width: int, metric: str = "euclidean"):
        self.metric = metric
        points = materialize(rows.groupBy("x").agg(F.count("*").alias("n")), "points")
        total = points.count()
        size = max(256, BLOCK_BYTES // (8 * max(width, 1)))
        chosen = points.orderBy(F.xxhash64("x"), "x").limit(min(PIVOTS, math.ceil(math.sqrt(total) / 4))).collect()
        self.pivots = np.array([r["x"] for r in chosen], float).reshape(len(chosen), width)
        placed = materialize(self._place(points), "placed")
        self.radius, self.blocks = np.full(len(chosen), -np.inf), np.zeros(len(chosen), int)
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("r")).collect():
            self.radius[r["cell"]], self.blocks[r["cell"]] = r["r"], math.ceil(r["n"] / size)
        self.points = self._block(placed).select("cell", "sub", "x", "n")

    def _place(self, df: DataFrame) -> DataFrame:
        """The nearest pivot (``cell``) and the distance to it (``gap``)."""
        pivots, metric = self.pivots, self.metric

        @F.pandas_udf("cell int, gap double")
        def near(v: pd.Series) -> pd.DataFrame:
            cell, gap = np.zeros(len(v), np.int32), np.zeros(len(v))
            for at in range(0, len(v), AT_ONCE):
                x = np.array(v.iloc[at : at + AT_ONCE].tolist(), float)
                c = squares(x, pivots).argmin(1)
                cell[at : at + AT_ONCE], gap[at : at + AT_ONCE] = c, _lengths(x - pivots[c], metric)
            return pd.DataFrame({"cell": cell, "gap": gap})

        return df.withColumn("p", near("x")).select(*df.columns, "p.cell", "p.gap")

    def _block(self, df: DataFrame) -> DataFrame:
        """The block of a row inside its cell, by a hash of its coordinates."""
        counts = F.array(*(F.lit(int(max(b, 1))) for b in self.blocks))
        return df.withColumn("sub", F.pmod(F.xxhash64("x"), F.get(counts, F.col("cell"))).cast("int"))

    def _meet(self, queries: DataFrame, rows: int, points: DataFrame, of, none: float) -> DataFrame:
        """``best = of(x, points, copies)`` of every query (x, cell, sub) in the block it names, or ``none`` where it is empty.

        A task streams: the points of a block come first, then its queries. ``rows`` are at most put to one block.
        """
        salts = max(1, math.ceil(rows / QUERIES))
        sides = queries.select("cell", "sub", F.pmod(F.xxhash64("x", F.lit(1)), F.lit(salts)).alias("salt"), F.lit(1).alias("side"), "x", F.lit(0).cast("long").alias("n"))
        points = points.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        both = sides.unionByName(points.withColumn("side", F.lit(0)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, held, matrix = None, [], None
            for t in batches:
                for key, part in t.groupby(["cell", "sub", "salt"], sort=False):
                    if key != at:
                        at, held, matrix = key, [], None
                    p, q = part[part["side"] == 0], part[part["side"] == 1]
                    if len(p):
                        held.append((np.array(p["x"].tolist(), float), p["n"].to_numpy()))
                    if len(q):
                        if matrix is None and held:
                            matrix = tuple(np.concatenate(m) for m in zip(*held))
                        best = list(of(np.array(q["x"].tolist(), float), *matrix)) if matrix else [[none]] * len(q)
                        yield pd.DataFrame({"x": q["x"].to_numpy(), "best": best})

        return both.repartition("cell", "sub", "salt").sortWithinPartitions("cell", "sub", "salt", "side").mapInPandas(run, "x array<double>, best array<double>")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """The distinct queries with the block that each would belong to."""
        return materialize(self._block(self._place(queries.select("x").distinct())), "asked")

    def _visits(self, asked: DataFrame, far: Column, own: bool) -> DataFrame:
        """(x, cell, sub) for every block that may hold a point within ``far``; the query's own only if ``own``."""
        pivots, radius, blocks, metric = self.pivots, self.radius, self.blocks, self.metric

        @F.pandas_udf("array<struct<cell:int,sub:int>>")
        def reach(v: pd.Series, far: pd.Series, cell: pd.Series, sub: pd.Series) -> pd.Series:
            out = []
            for at in range(0, len(v), AT_ONCE):
                x = np.array(v.iloc[at : at + AT_ONCE].tolist(), float)
                limit = far.iloc[at : at + AT_ONCE].to_numpy(float)[:, None]
                visit = (blocks > 0) & (_distances(x, pivots, metric) - radius - _room(x, pivots) <= limit)
                for go, c, s in zip(visit, cell.iloc[at : at + AT_ONCE], sub.iloc[at : at + AT_ONCE]):
                    out.append([{"cell": int(i), "sub": b} for i in np.flatnonzero(go) for b in range(blocks[i]) if own or (i, b) != (c, s)])
            return pd.Series(out)

        return asked.withColumn("to", F.explode(reach("x", far, "cell", "sub"))).select("x", "to.cell", "to.sub")

    def mean_distance(self, queries: DataFrame, k: int) -> DataFrame:
        """(x, score) for the distinct ``x`` of the queries: the mean of their k least distances."""
        metric = self.metric
        of = lambda x, points, copies: nearest_in_block(x, points, copies, k, metric)
        asked = self._asked(queries)
        rows = asked.count()
        first = materialize(self._meet(asked, rows, self.points, of, math.inf), "first")
        more = self._visits(self._block(self._place(first)), F.when(F.size("best") < k, math.inf).otherwise(F.element_at("best", -1)), False)
        best = first.unionByName(self._meet(more, rows, self.points, of, math.inf)).groupBy("x").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("b"))
        return best.select("x", (F.aggregate("b", F.lit(0.0), lambda a, d: a + d) / k).alias("score"))

    def nearest_core(self, eps: float, least: int) -> tuple[DataFrame, int]:
        """(x, score): the distance of the points to the nearest core point, where it is within ``eps``; and the core rows.

        A core point has ``least`` rows within ``eps``, its own among them. No pair of points is written.
        """
        metric = self.metric
        asked = self._asked(self.points)
        rows = asked.count()
        visits = materialize(self._visits(asked, F.lit(float(eps)), True), "visits")
        counts = self._meet(visits, rows, self.points, lambda x, p, n: count_in_block(x, p, n, eps, metric), 0.0)
        core = counts.groupBy("x").agg(F.sum(F.get("best", F.lit(0))).alias("m")).where(F.col("m") >= least).select("x")
        core = materialize(self.points.join(core, "x", "left_semi").select(*self.points.columns), "core")
        near = self._meet(visits, rows, core, lambda x, p, n: nearest_in_block(x, p, n, 1, metric), math.inf)
        found = near.groupBy("x").agg(F.min(F.get("best", F.lit(0))).alias("score")).where(F.col("score") <= eps)
        return found, core.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
