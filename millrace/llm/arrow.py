"""Arrow-batched passes over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows and bytes that a function gets at once at most; a longer row comes alone.
ROWS, BYTES = 1000, 1 << 23


def parts(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in order, cut into parts within ``rows`` and ``BYTES``."""
    if batch.num_rows <= rows and (batch.num_rows <= 1 or batch.nbytes <= BYTES):
        yield batch
    else:
        half = batch.num_rows // 2
        yield from parts(batch.slice(0, half), rows)
        yield from parts(batch.slice(half), rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = ROWS) -> DataFrame:
    """``mapInArrow`` with one output batch for each part of an input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, rows):
                yield fn(part)

    return df.mapInArrow(run, schema)
