"""A training-corpus pipeline: quality, repeated lines, near copies, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import written
from tallyforge.llm.decontam import stage_decontaminate
from tallyforge.llm.linededup import stage_line_dedup
from tallyforge.llm.packing import stage_pack
from tallyforge.llm.quality import stage_quality
from tallyforge.llm.simhash import stage_near_dedup

STAGES = [
    ("quality", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("pack", stage_pack),
]

#: No SQL: the classifier, the fingerprints and the tokenizer are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
