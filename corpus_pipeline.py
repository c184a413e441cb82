"""The training-data pipeline: quality, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``. ``run`` writes every stage's
rows to the shared folder and reads them back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, packing, pii, quality, simhash
from millrace.plans.durable import materialize, release


def _stage(apply):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline")  # the stage before has been written: its own tables can go
        return apply(docs)

    return stage


STAGES = [
    ("quality_rules", _stage(quality.filter_documents)),
    ("simhash_near_dedup", _stage(simhash.keep_one)),
    ("pii_redaction", _stage(pii.redact_documents)),
    ("source_mixing", _stage(mixing.mix_documents)),
    ("packing", _stage(lambda docs: packing.pack(docs, "pipeline"))),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, "stages")
    return STAGES[-1][1](spark, docs, sf_dir)
