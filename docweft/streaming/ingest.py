"""Incremental ingestion: new documents become blocks, chunks and terms, batch by batch, as in a full run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweft.operators import chunking, keyword_index
from docweft.sources.documents import line_blocks

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files that arrive below a path."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def chunk_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """What is kept of a batch of documents. Everything is within a document, so batches give what a full run gives."""
    blocks = line_blocks(docs).withColumn("document_id", F.col("doc_id").cast("string"))
    chunks = chunking.classify(chunking.fixed(blocks))
    terms = keyword_index.terms(chunks, "chunk_id", "content")
    return {"blocks": blocks, "chunks": chunks, "terms": terms}


def ingest(stream: DataFrame, out: str, checkpoint: str, tables: Callable[[DataFrame], dict[str, DataFrame]] = chunk_tables) -> StreamingQuery:
    """Writes the tables of each batch to a folder of its own; a batch that runs again overwrites what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for name, table in tables(kept).items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_counts(stream: DataFrame) -> DataFrame:
    """Document frequencies as a running aggregate over a stream of documents."""
    from docweft.functions.text import index_keywords

    return stream.select(F.explode(index_keywords(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
