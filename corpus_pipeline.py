"""A training corpus from the table ``documents``: language ID, near-dedup, substring dedup, mixing, packing.

Each stage is a function of (spark, docs, folder) and takes effect on the documents that the next one gets.  A stage's
result is written as Parquet to the shared folder and read again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketframe.llm import op02_substring_dedup, op04_source_mix, op05_retrieval_packing, op07_near_dup, op10_language_id
from marketframe.operators.landing import land

STAGES = [
    ("language_id", op10_language_id.stage),
    ("near_dup", op07_near_dup.stage),
    ("substring_dedup", op02_substring_dedup.stage),
    ("source_mix", op04_source_mix.stage),
    ("retrieval_packing", op05_retrieval_packing.stage),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
