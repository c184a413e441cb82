"""Words as every contract of this subpackage defines them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a word is a maximal run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
FIND = re.compile(WORD)


def words(text: Column) -> Column:
    """The words of a text in order; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def documents(spark, sf_dir: str, *columns: str):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def column(name: str) -> Column:
    """A column by its whole name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(names: list[str]) -> Column:
    """The columns as one struct."""
    return F.struct(*map(column, names))


def unpacked(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from (row, text): all but the text from the struct, ``n_chars`` counted anew."""
    pick = {c: F.col("row").getField(c) for c in like.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in pick:
        pick["n_chars"] = F.length("text").cast(like.schema["n_chars"].dataType)
    return rows.select(*(pick[c].alias(c) for c in like.columns))
