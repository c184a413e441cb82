"""Scans with a stable row id, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.base import RID, OperatorError

COMPARE = {"==": "=", "=": "=", "!=": "<>", ">": ">", ">=": ">=", "<": "<", "<=": "<="}


def _condition(column: str, op: str, value):
    c = F.col(f"`{column}`")
    if op == "in":
        return c.isin(list(value))
    if op == "not in":
        return ~c.isin(list(value))
    if op not in COMPARE:
        raise OperatorError(f"{op!r} is not a filter operator")
    v = F.lit(value)
    return {"=": c == v, "<>": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[COMPARE[op]]


def _parquet(spark: SparkSession, path: str, ordinal: int) -> DataFrame:
    """Row id: source ordinal, then file (in name order), then the file's row index."""
    df = spark.read.parquet(path)
    files = sorted(f.rsplit("/", 1)[-1] for f in df.inputFiles())
    index = F.col("_metadata.row_index")
    if len(files) > 1:
        place = spark.createDataFrame(list(enumerate(files)), "__n long, __f string")
        df = df.withColumn("__i", index).withColumn("__f", F.col("_metadata.file_name")).join(place, "__f")
        return df.withColumn(RID, F.lit(ordinal << 52) + F.shiftleft("__n", 32) + F.col("__i")).drop("__i", "__n", "__f")
    return df.withColumn(RID, F.lit(ordinal << 52) + index)


def _csv(spark: SparkSession, path: str, ordinal: int, encoding: str, separator: str) -> DataFrame:
    """Row id: source ordinal, then byte offset of the split plus the row's place in it (a row has a byte at least)."""
    charset = "UTF-8" if encoding.lower() in ("utf-8", "utf8", "utf-8-sig") else encoding
    df = spark.read.option("header", True).option("sep", separator).option("encoding", charset).option("inferSchema", True).csv(path)
    files = sorted(df.inputFiles())
    part = Window.partitionBy("__f", "__b").orderBy("__m")
    df = df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    n = F.array_position(F.array(*map(F.lit, files)), F.col("__f")) - 1
    rid = F.lit(ordinal << 52) + F.shiftleft(F.greatest(n, F.lit(0)).cast("long"), 40) + F.col("__b") + F.row_number().over(part)
    return df.withColumn(RID, rid).drop("__f", "__b", "__m")


def scan(spark: SparkSession, path: str, paths=(), *, source_column: str = "", format: str = "csv", encoding: str = "utf-8-sig", separator: str = ",", columns=(), max_rows: int = 0, filters=()) -> DataFrame:
    """One or several sources with one column set; the first names the column order.

    Filters apply before the projection, so they may use columns that are not returned; both
    reach the Parquet scan. ``max_rows`` takes the first rows in row-id order.
    """
    frames = []
    for k, p in enumerate([path, *paths]):
        kind = "parquet" if p.rstrip("/").endswith((".parquet", ".pq")) else "csv" if p.endswith((".csv", ".tsv", ".txt")) else format
        df = _parquet(spark, p, k) if kind == "parquet" else _csv(spark, p, k, encoding, separator)
        if source_column:
            if source_column in df.columns:
                raise OperatorError(f"{source_column!r} exists already")
            df = df.withColumn(source_column, F.lit(p))
        frames.append(df)
    first = frames[0]
    for p, df in zip(paths, frames[1:]):
        if set(df.columns) != set(first.columns):
            raise OperatorError(f"{p} has other columns: {sorted(set(df.columns) ^ set(first.columns))}")
    out = first
    for df in frames[1:]:
        out = out.unionByName(df)
    if bad := sorted(set(columns) - set(out.columns)):
        raise OperatorError(f"there are no columns {bad}")
    for column, op, value in filters:
        if column not in out.columns:
            raise OperatorError(f"there is no column {column!r}")
        out = out.where(_condition(column, op, value))
    if columns:
        out = out.select(*columns, *([source_column] if source_column and source_column not in columns else []), RID)
    return out.orderBy(RID).limit(max_rows) if max_rows else out


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A driver table; ``key`` is a unique ordered column that serves as the row id."""
    if key:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn(RID, F.col(key).cast("long"))
    return _parquet(spark, f"{sf_dir}/{name}.parquet", 0)


def write(df: DataFrame, path: str, format: str = "parquet", partition_by=()) -> None:
    """Sink: Parquet, CSV or JSON; the row id stays inside the engine."""
    out = df.drop(RID).write.mode("error")
    if partition_by:
        out = out.partitionBy(*partition_by)
    if format == "csv":
        out.option("header", True).csv(path)
    elif format in ("parquet", "json"):
        out.format(format).save(path)
    else:
        raise OperatorError(f"{format!r} is not a sink format")
