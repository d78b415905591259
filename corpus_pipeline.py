"""Corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Null texts, empty tables, repeated rows and extra columns
are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldmark.llm._base import store, table
from fieldmark.llm.decontam import decontam_stage
from fieldmark.llm.jaccard import jaccard_stage
from fieldmark.llm.mixing import mixing_stage
from fieldmark.llm.quality import quality_stage
from fieldmark.llm.sharding import sharding_stage

STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", jaccard_stage),
    ("decontamination", decontam_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A conditional random field's fit and greedy packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
