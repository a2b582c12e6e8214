"""The keyword index in blocks, and BM25 searches that skip blocks which cannot change the best ``k``.

A term's postings are cut into blocks by ranges of rows of about equal length; a block knows the highest score that any of
its postings gives. A search first scores a few postings of each query's rarest terms, which bounds its ``k``-th score
from below. Ranges whose blocks together stay under that bound are skipped, and so are terms whose highest scores
together do: they cannot bring in a row by themselves, and are read only for rows that may still be among the best.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.operators.keyword_index import BROADCAST_TERMS, K1, B, Index, top
from docweft.operators.storage import shared_place, written

#: Rows of a range, about; buckets that terms are stored in; ranges by length at most (longer indices split each further).
RANGE_ROWS, BUCKETS, LENGTHS = 16, 64, 1024
#: Postings scored for the first bound, for each row that is asked for.
SEED = 20
_NEAR = 1e-6  # scores are rounded to six digits


@dataclass(frozen=True)
class Blocks:
    """Blocks (``bucket``, ``term``, ``range``, ``share``, ``rows``), terms (``term``, ``idf``, ``best``, ``n``) and the mean length.

    A block's ``share`` is the highest of its postings, in parts of the term's ``idf``.
    """

    key: str
    table: DataFrame
    terms: DataFrame
    mean: float


def _share(dl: Column, mean: float) -> Column:
    """What a posting of a row of length ``dl`` gives, in parts of the term's ``idf``."""
    return (K1 + 1) / (1 + K1 * (1 - B + B * dl / F.lit(mean)))


def build(index: Index, range_rows: int = RANGE_ROWS) -> Blocks:
    """Writes the blocks of a keyword index, in folders by bucket of term; postings are shuffled once."""
    spark, key = index.postings.sparkSession, index.key
    totals = index.totals.first()  # one row
    n_docs, mean = totals["n_docs"], totals["avg_dl"] or 1.0
    ranges = max(1, -(-n_docs // range_rows))
    lengths = min(LENGTHS, ranges)
    pieces = -(-ranges // lengths)
    # distinct lengths of term sets, not rows: bounded by the longest row's number of terms
    sizes = index.stored.groupBy("dl").agg(F.count("*").alias("n")).orderBy("dl").toArrow()
    before = np.cumsum(sizes.column("n").to_numpy()) if sizes.num_rows else np.zeros(0)
    bins = (before * lengths // (before[-1] + 1)).astype(int).tolist() if sizes.num_rows else []
    binned = spark.createDataFrame(list(zip(sizes.column("dl").to_pylist(), bins, strict=True)), "dl int, length int")
    rows = index.stored.join(F.broadcast(binned), "dl")
    rows = rows.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), "term", (F.col("length") * pieces + F.pmod(F.xxhash64(key), F.lit(pieces)).cast("int")).alias("range"), F.col(key).alias("key"), "dl")
    # dealt by ranges of what they are grouped by, so that grouping and writing need no other shuffle
    blocks = rows.repartitionByRange("bucket", "term", "range").groupBy("bucket", "term", "range").agg(F.max(_share(F.col("dl"), mean)).alias("share"), F.collect_list(F.struct("key", "dl")).alias("rows"))
    path = f"{shared_place(spark)}/keyword-blocks-{uuid.uuid4().hex}"
    blocks.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(path, compression="zstd")
    table = spark.read.schema(blocks.select("term", "range", "share", "rows", "bucket").schema).parquet(path)
    idf = F.log((F.lit(n_docs) - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1)
    terms = table.groupBy("term").agg(F.max("share").alias("share"), F.sum(F.size("rows")).alias("n")).withColumn("idf", idf)
    terms = terms.select("term", "idf", (F.col("idf") * F.col("share")).alias("best"), "n")
    return Blocks(key, table, written(terms, "block-terms", "zstd"), float(mean))


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """The ``k``-th best score of each query that has so many rows."""
    best = Window.partitionBy("query").orderBy(F.col("score").desc())
    return scored.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))


def bm25(blocks: Blocks, queries: DataFrame, query: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The rows of ``keyword_index.bm25``, and what was skipped (one row).

    The second table counts blocks and postings of the queries' terms (``asked``), those joined for terms that can bring in
    rows (``joined``), and those read afterwards for rows that may still be among the best (``completed``).
    """
    asked = queries.select(F.col(query).alias("query"), F.explode("terms").alias("term")).distinct()
    asked = F.broadcast(asked) if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else asked
    order = Window.partitionBy("query").orderBy(F.col("best").desc(), "term")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = blocks.terms.join(asked, "term").withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "rest": F.sum("best").over(rest)})
    known = written(known, "asked-terms")
    buckets = [r[0] for r in known.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
    table = blocks.table.filter(F.col("bucket").isin(buckets)) if len(buckets) < BUCKETS else blocks.table
    part = F.col("idf") * _share(F.col("row.dl"), blocks.mean)

    def postings(chosen: DataFrame) -> DataFrame:
        """The postings of chosen blocks (``query``, ``term``, ``range``), which are broadcast if their number allows."""
        chosen = written(chosen.select("query", "term", "range", "idf"), "chosen-blocks")
        chosen = F.broadcast(chosen) if chosen.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else chosen
        each = table.select("term", "range", "rows").join(chosen, ["term", "range"]).select("query", "range", "idf", F.explode("rows").alias("row"))
        return each.select("query", "range", F.col("row.key").alias("key"), F.col("row.dl").alias("dl"), part.alias("part"))

    tried = table.select("term", "range", "share", F.size("rows").alias("n")).join(known.select("query", "term", "before", "rest", "idf"), "term")
    tried = written(tried.withColumn("block_best", F.col("idf") * F.col("share")), "asked-blocks")
    # rows that the rarest terms bring in are scored with all terms: the k-th score is no less than that of the k-th of them
    seeds = postings(tried.filter(F.col("before") < SEED * k)).groupBy("query", "key", "range").agg(F.sum("part").alias("score"))
    seeds = seeds.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "key"))).filter(F.col("_n") <= k)
    seeds = written(seeds.select("query", "key", "range"), "seeds")
    whole = postings(tried.join(seeds.select("query", "range").distinct(), ["query", "range"], "left_semi")).join(seeds.select("query", "key"), ["query", "key"], "left_semi")
    first = written(_kth(whole.groupBy("query", "key").agg(F.sum("part").alias("score")), k), "first-bounds")

    able = tried.groupBy("query", "range").agg(F.sum("block_best").alias("most")).join(first, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    able = able.filter(F.col("most") >= F.col("bound") - _NEAR).select("query", "range", "bound")
    kept = written(tried.join(able, ["query", "range"]).select("query", "term", "range", "idf", "n", (F.col("rest") >= F.col("bound") - _NEAR).alias("brings")), "able-blocks")
    bringing = kept.filter("brings")
    found = postings(bringing).groupBy("query", "key", "range").agg(F.sum("part").alias("score"), F.max("dl").alias("dl"))
    found = written(found, "partial-scores")
    others = known.join(first, "query", "left").filter(F.col("rest") < F.coalesce("bound", F.lit(0.0)) - _NEAR).groupBy("query").agg(F.sum("idf").alias("idf"))
    second = _kth(found, k).select("query", F.col("bound").alias("later"))
    limits = found.join(first, "query", "left").join(second, "query", "left").join(others, "query", "left")
    reach = F.col("score") + F.coalesce("idf", F.lit(0.0)) * _share(F.col("dl"), blocks.mean)
    alive = written(limits.filter(reach >= F.coalesce(F.greatest("bound", "later"), F.lit(0.0)) - _NEAR).select("query", "key", "range", "score"), "alive")
    completing = kept.filter(~F.col("brings")).join(alive.select("query", "range").distinct(), ["query", "range"], "left_semi")
    more = postings(completing).join(alive.select("query", "key"), ["query", "key"], "left_semi").groupBy("query", "key").agg(F.sum("part").alias("more"))
    scored = alive.join(more, ["query", "key"], "left").select(F.col("query").alias(query), F.col("key").alias(blocks.key), F.round(F.col("score") + F.coalesce("more", F.lit(0.0)), 6).alias("score"))
    counts = [rows.agg(F.count("*").alias(name), F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_postings")) for rows, name in ((tried, "asked"), (bringing, "joined"), (completing, "completed"))]
    work = counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # one row each
    return top(scored, query, blocks.key, k), work
