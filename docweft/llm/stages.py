"""Stages of the corpus pipeline: each applies one operator to the documents that the stage before kept.

All but the last return the columns of the documents they are given. Every stage judges rows by their text alone, so
null ids, shared ids and repeated rows need no rule of their own, except that near-duplicates (and so repeated rows)
become one row. Null and empty texts are not toxic, have no language and go with that stage. Texts of any length are
judged whole. Further columns are kept, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import decontamination, language, near_duplicates, packing, toxicity
from docweft.llm.shared import free_names

TOKENIZER = "byte_bpe_50k.json"
#: The lead among languages alone scores 0.25 and more; texts unlike the language picked for them fall below.
LEAST_LANGUAGE_SCORE = 0.15


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score reaches the operator's threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.toxicity_score(F.col("text"), model) < toxicity.THRESHOLD)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language; where none can be learned, those without a letter."""
    model = language.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    (name,) = free_names(docs, "found")
    found = docs.withColumn(name, language.language_of(F.col("text"), model))
    kept = (F.col(name)["lang_pred"] != language.UNDETERMINED) & (F.col(name)["score"] >= LEAST_LANGUAGE_SCORE)
    return found.filter(kept).drop(name)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near-duplicates: the text decides, whatever the ids; equal rows are one class."""
    return near_duplicates.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a passage of a benchmark item, row by row: a null or shared id changes nothing."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The boundary records of the packed token sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))
