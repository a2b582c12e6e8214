"""A training corpus from raw documents: stages that each apply one operator to what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweft.llm.shared import written
from docweft.llm.stages import deduplicate, decontaminate, identify_language, pack_sequences, remove_toxic

STAGES = [
    ("toxicity", remove_toxic),
    ("language ID", identify_language),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: Learned models, alignment and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
