"""Rank fusion of hit lists (``query_id, source, rank, score, doc_key``) from several sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import rules

SCORE_PLACES = 6


def source_place(source: Column) -> Column:
    """The order in which sources are looked through."""
    chain = F
    for i, name in enumerate(rules.SOURCE_ORDER):
        chain = chain.when(source == name, F.lit(i))
    return chain.otherwise(len(rules.SOURCE_ORDER))


def ranked(fused: DataFrame, k: int | None = None) -> DataFrame:
    """Fused hits with their rank from 0: by score, then by which was seen first."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "place", "first_rank", "doc_key")
    out = fused.withColumn("rank", F.row_number().over(order) - 1)
    out = out.filter(F.col("rank") < k) if k else out
    return out.select("query_id", "doc_key", "score", "rank", "best_source")


def _fused(hits: DataFrame, part: Column, first_seen: bool = False) -> DataFrame:
    """Sums of a part over the hits of each document, which is shown as its best hit (or the first seen)."""
    seen = F.struct("place", "rank")
    pick = F.min_by("source", seen) if first_seen else F.max_by("source", F.struct("score", -F.col("place"), -F.col("rank")))
    placed = hits.withColumn("place", source_place(F.col("source")))
    grouped = placed.groupBy("query_id", "doc_key").agg(F.round(F.sum(part), SCORE_PLACES).alias("fused"), F.min(seen).alias("seen"), pick.alias("best_source"))
    return grouped.select("query_id", "doc_key", F.col("fused").alias("score"), F.col("seen.place").alias("place"), F.col("seen.rank").alias("first_rank"), "best_source")


def reciprocal_rank(hits: DataFrame, k: int | None = None, constant: int = rules.RRF_K) -> DataFrame:
    """Sum of 1 / (constant + rank + 1)."""
    return ranked(_fused(hits, 1.0 / (F.lit(constant) + F.col("rank") + 1)), k)


def weights(queries: DataFrame) -> DataFrame:
    """``query_id``, ``source``, ``weight``: base weights changed by query type and intent, then normalised and rounded."""
    columns = {}
    for source, base in rules.FUSION_WEIGHTS.items():
        weight = F.lit(base)
        for column, factors in (("query_type", rules.TYPE_FACTORS), ("intent", rules.INTENT_FACTORS)):
            factor = F
            for value, by_source in factors.items():
                factor = factor.when(F.col(column) == value, F.lit(by_source.get(source, 1.0)))
            weight = weight * factor.otherwise(1.0)
        columns[source] = weight
    total = sum(columns.values(), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(s).alias("source"), F.round(w / total, 6).alias("weight")) for s, w in columns.items()])
    return queries.select("query_id", F.explode(each).alias("x")).select("query_id", "x.*")


def _weighted(hits: DataFrame, queries: DataFrame) -> DataFrame:
    given = hits.join(weights(queries), ["query_id", "source"], "left")
    return given.withColumn("weight", F.coalesce("weight", F.lit(rules.OTHER_SOURCE_WEIGHT)))


def weighted(hits: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """Sum of weight * score / the source's best score (1 where that is not above 0)."""
    best = F.max("score").over(Window.partitionBy("query_id", "source"))
    rows = _weighted(hits, queries).withColumn("best", best)
    return ranked(_fused(rows, F.col("weight") * F.col("score") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0)), k)


def convex(hits: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """Sum of scores stretched to 0..1 in each source, by weights that add up to 1 over the sources with hits."""
    by = Window.partitionBy("query_id", "source")
    rows = _weighted(hits, queries).withColumns({"low": F.min("score").over(by), "high": F.max("score").over(by)})
    present = rows.select("query_id", "source", "weight").distinct().groupBy("query_id").agg(F.sum("weight").alias("total"))
    rows = rows.join(present, "query_id")
    stretched = (F.col("score") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    return ranked(_fused(rows, F.col("weight") / F.col("total") * stretched, first_seen=True), k)


def rerank(hits: DataFrame, pairs: Callable[[list[str], list[str]], list[float]] | None = None, most: int = 100) -> DataFrame:
    """Fused hits (with ``query_text``, ``content``, ``source``) scored anew by a model of text pairs.

    Only the first ``most`` hits of a query are scored, and of these only chunks stay. Without a model hits stay.
    """
    if pairs is None:
        return hits

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            yield pd.Series(pairs(queries.tolist(), texts.tolist()))

    chosen = hits.filter((F.col("rank") < most) & F.col("source").isin("text", "keyword")).withColumn("score", score("query_text", "content"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")
    return chosen.withColumn("rank", F.row_number().over(order) - 1)


def confidence(hits: DataFrame) -> DataFrame:
    """``query_id``, ``confidence``: from the best score, the scores' variance and the gap from first to last."""
    grouped = hits.groupBy("query_id").agg(F.min_by("score", "rank").alias("first"), F.max_by("score", "rank").alias("last"), F.var_pop("score").alias("var"), F.count("*").alias("n"))
    gap = F.when(F.col("n") > 1, F.col("first") - F.col("last")).otherwise(0.0)
    total = 0.5 * F.col("first") + 0.3 / (1 + F.coalesce("var", F.lit(0.0))) + 0.2 * F.least(F.lit(1.0), gap)
    return grouped.select("query_id", F.round(F.least(F.lit(1.0), total), 6).alias("confidence"))
