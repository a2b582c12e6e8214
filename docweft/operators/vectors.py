"""Exact vector search: inner products in blocks of queries. Approximate indices are in ``vector_lists`` and ``vector_graph``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text

#: Queries that are sent to the executors at once, and products of queries and vectors held at once.
BLOCK = 20_000
CELLS = 4_000_000
#: Places to which products are told apart: sums of products differ behind these with the order of summing.
PLACES = 12
#: Vectors that centroids and code books are fitted on at most.
SAMPLE = 20_000


def matrix(column: pa.Array) -> np.ndarray:
    lists = column.cast(pa.list_(pa.float64()))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Numbers to so many places, halves away from zero as SQL has them."""
    scaled = x * 10.0**places
    whole = np.trunc(scaled)
    return (whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)) / 10.0**places


def top_k(vectors: DataFrame, key: str, queries: DataFrame, query: str, k: int = 10, places: int = PLACES) -> DataFrame:
    """For each query vector the ``k`` rows with the largest inner product, ranked from 0; products equal to so many places by key.

    Queries go to the executors in blocks of bounded size; every task keeps its own best ``k`` of each query, and
    only those are shuffled and ranked.
    """
    rows = vectors.filter(F.col("embedding").isNotNull()).select(F.col(key).cast("long").alias("key"), "embedding")
    asked = queries.filter(F.col("embedding").isNotNull()).select(F.col(query).cast("long").alias("query"), "embedding")
    count = asked.count()
    blocks = max(1, -(-count // BLOCK))
    parts = [_local_top(rows, asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b), k, places) for b in range(blocks)]
    best = parts[0]
    for more in parts[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("query").orderBy(F.col("near").desc(), "key")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
    names = {"key": key, "query": query} if key != query else {"key": key, "query": f"query_{query}"}
    return ranked.select(F.col("query").alias(names["query"]), F.col("key").alias(names["key"]), F.round("near" if places <= 6 else "score", 6).alias("score"), "rank")


def _local_top(rows: DataFrame, asked: DataFrame, k: int, places: int) -> DataFrame:
    """The best ``k`` rows of each task for each query of one block, with their products, whole (``score``) and rounded (``near``)."""
    table = asked.toArrow()  # one bounded block
    sent = rows.sparkSession.sparkContext.broadcast((table.column("query").to_numpy(), matrix(table.column("embedding").combine_chunks())))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = sent.value
        score = np.full((len(names), 0), -np.inf)
        found = np.zeros((len(names), 0), np.int64)
        rows = max(k, CELLS // max(len(names), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                product = asked @ matrix(part.column("embedding")).T
                score = np.hstack([score, product])
                found = np.hstack([found, np.broadcast_to(part.column("key").to_numpy(), (len(names), part.num_rows))])
                if score.shape[1] > k:
                    order = np.lexsort((found, -rounded(score, places)), axis=1)[:, :k]
                    score, found = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)
        if found.shape[1] and len(names):
            n = found.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(found.ravel()), pa.array(score.ravel()), pa.array(rounded(score, places).ravel())], names=["query", "key", "score", "near"])

    return rows.mapInArrow(search, "query long, key long, score double, near double")


def embed(rows: DataFrame, column: str, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Rows with unit-length embeddings of a text column by a model of the caller's choice, in batches."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()))

    # a step of its own: functions of Python cannot stand inside those that go through an array
    return rows.withColumn("embedding", run(F.col(column))).withColumn("embedding", text.normalised(F.col("embedding")))
