"""A training-data pipeline over the documents table.

``STAGES`` are applied in order; each takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet to the shared folder and read again as
the next stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelake.llm.decontaminate import decontaminate_stage
from storelake.llm.jaccard import jaccard_stage
from storelake.llm.linededup import linededup_stage
from storelake.llm.packing import packing_stage
from storelake.llm.quality import quality_stage
from storelake.session import materialize

STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", linededup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("packing", packing_stage),
]

#: The classifier's training and the tokenizer's ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
