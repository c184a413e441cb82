"""Structured Streaming: complete count windows per group, and event-time statistics.

State per group is the pending rows of the open window, bounded by the window size. Rows must
arrive in time order inside a group; one that is older than the last seen is counted and dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def count_windows(stream: DataFrame, group: str, time: str, value: str, size: int, step: int = 0) -> DataFrame:
    """(series, start, n, mean, std, rms, late) of each complete window, as it completes."""
    step = step or size
    source = stream.select(F.col(group).cast("string").alias("series"), F.col(time).cast("timestamp").alias("t"), F.col(value).cast("double").alias("x"))

    def run(key, batches, state: GroupState):
        held, base, last, late, skip = state.get if state.exists else ([], 0, None, 0, 0)
        held = list(held)
        out = []
        for batch in batches:
            batch = batch.sort_values("t", kind="stable")
            for t, x in zip(batch["t"], batch["x"]):
                stamp = t.value // 1000
                if last is not None and stamp < last:
                    late += 1
                    continue
                last = stamp
                if skip:  # rows between windows, where the step is longer than the window
                    skip -= 1
                    continue
                held.append(float(x))
                while len(held) >= size:
                    w = pd.Series(held[:size])
                    out.append((key[0], base, size, w.mean(), w.std(ddof=0), float((w * w).mean() ** 0.5), late))
                    base += step
                    skip = max(0, step - len(held))
                    held = held[step:]
        state.update((held, base, last, late, skip))
        yield pd.DataFrame(out, columns=["series", "start", "n", "mean", "std", "rms", "late"])

    return source.groupBy("series").applyInPandasWithState(
        run,
        "series string, start long, n long, mean double, std double, rms double, late long",
        "held array<double>, base long, last long, late long, skip long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def time_statistics(stream: DataFrame, group: str, time: str, value: str, window: str, slide: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Event-time windows with a watermark: rows, mean, spread and range per group."""
    x = F.col(value).cast("double")
    w = F.window(time, window, slide) if slide else F.window(time, window)
    t = stream.withWatermark(time, delay).groupBy(group, w.alias("w"))
    out = t.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select(group, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "std", "min", "max")
