"""Approximate vector search in a graph: nearest neighbours by descent, and searches that hop from entry points.

The graph is built round by round with joins. Each node's neighbours, and the nodes that have it as one, meet each
other; a pair nearer than what either has so far becomes an edge. Pairs of two old acquaintances are not tried again,
and the rounds end when few edges change. A search starts at the nodes nearest to coarse centroids and hops to the
neighbours of the best nodes that it has seen, for all queries at once, one join for each hop. Nodes on the way are
scored by their codes; only the best are scored exactly. Equal vectors are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.operators.storage import discard, written
from docweft.operators.vector_lists import Quantiser, blocks_of, exactly, ranked, sample
from docweft.operators.vectors import matrix

#: Neighbours of a node while the graph grows; twice as many, both ways, when it is searched.
NEIGHBOURS = 16
#: Neighbours that a node keeps of those it met by chance: they join clusters whose nodes are all nearer to each other.
LINKS = 4
#: Nodes of a block that meet each other at the beginning, about.
FIRST_BLOCK = 200
#: The rounds end after so many, or when this share of the edges is new.
ROUNDS, LEAST_NEW = 10, 0.01

_EDGES = "node long, other long, score float"


@dataclass(frozen=True)
class Graph:
    """The rows it was built from (``key``, ``embedding``), the nodes (``node``, ``embedding``, ``code``, ``list_id``), the neighbours of each, entry points."""

    rows: DataFrame
    nodes: DataFrame
    neighbours: DataFrame
    quantiser: Quantiser
    entries: dict[int, int]
    #: Products computed for the graph.
    built_with: int


def _whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that are sorted by a column, never cutting a group, with the places where groups begin and the end."""
    held: pa.Table | None = None
    for batch in _with_end(batches):
        table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table is None or not table.num_rows:
            continue
        keys = table.column(column).to_numpy()
        cut = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
        if cut:
            starts = np.flatnonzero(np.concatenate([[True], keys[1:cut] != keys[: cut - 1]]))
            yield table.slice(0, cut).combine_chunks(), np.append(starts, cut)
        held = table.slice(cut)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of each group, of which one is fresh and that are nearer than the worst neighbour so far."""
    for table, bounds in _whole_groups(batches, "place"):
        x, nodes = matrix(_column(table, "embedding")).astype(np.float32), table.column("other").to_numpy()
        fresh, worst = table.column("fresh").to_numpy(), table.column("worst").to_numpy()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            score = x[a:b] @ x[a:b].T
            wanted = (fresh[a:b, None] | fresh[None, a:b]) & (score > worst[a:b, None])
            np.fill_diagonal(wanted, False)
            i, j = np.nonzero(wanted)
            tried = int(np.count_nonzero(fresh[a:b, None] | fresh[None, a:b])) // 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(nodes[a:b][i], -1)), pa.array(np.append(nodes[a:b][j], tried)), pa.array(np.append(score[i, j], -2).astype(np.float32))], names=["node", "other", "score"]
            )


def _local(met: DataFrame) -> DataFrame:
    """Pairs of the rows (``place``, ``other``, ``embedding``, ``fresh``, ``worst``) of each place; rows with score -2 count products."""
    return written(met.repartition("place").sortWithinPartitions("place").mapInArrow(_met, _EDGES), "met")


def _pairs(met: DataFrame) -> DataFrame:
    return met.filter("score >= -1.5")


def _products(met: DataFrame) -> int:
    return int(met.filter("score < -1.5").agg(F.coalesce(F.sum("other"), F.lit(0))).first()[0])


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node; equal scores in an order that differs from node to node, so that no node is everyone's."""
    order = Window.partitionBy("node").orderBy(F.col("score").desc(), F.xxhash64("node", "other"))
    return edges.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def build(vectors: DataFrame, key: str, k: int = NEIGHBOURS, rounds: int = ROUNDS, least_new: float = LEAST_NEW) -> Graph:
    """Builds and writes the graph of all vectors that are not null."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("embedding").isNotNull()).select(F.col(key).cast("long").alias("key"), "embedding")
    unique = rows.groupBy("embedding").agg(F.min("key").alias("node"))
    x = sample(rows, "key")
    if not len(x):
        empty = spark.createDataFrame([], "node long, others array<long>")
        return Graph(rows, unique, empty, Quantiser(x, np.zeros((0, 0, 0))), {}, 0)
    quantiser = Quantiser.fit(x, max(4, math.isqrt(len(x)) // 2))
    sent = spark.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"))
            at, codes = sent.value.encode(x)
            away = ((x - sent.value.centroids[at]) ** 2).sum(1)
            columns = [batch.column("node"), batch.column("embedding"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(at.astype(np.int32)), pa.array(away)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "embedding", "code", "list_id", "away"])

    kind = rows.schema["embedding"].dataType.simpleString()
    nodes = written(unique.select("node", "embedding").mapInArrow(encode, f"node long, embedding {kind}, code binary, list_id int, away double"), "nodes")
    lists = nodes.groupBy("list_id").agg(F.count("*").alias("n"), F.min_by("node", F.struct("away", "node")).alias("entry"))
    held = {r["list_id"]: r for r in lists.collect()}  # one row a centroid, fitted on a bounded sample

    # at the beginning nodes meet in blocks of their list, and in blocks by chance, which no list keeps apart
    count = sum(r["n"] for r in held.values())
    pieces = F.create_map(*[F.lit(v) for i, r in held.items() for v in (i, -(-r["n"] // FIRST_BLOCK))])
    near = F.xxhash64("list_id", F.pmod(F.xxhash64("node"), F.element_at(pieces, F.col("list_id"))))
    chance = F.xxhash64(F.lit("by chance"), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(-(-count // FIRST_BLOCK))))
    first = nodes.select(F.col("node").alias("other"), "embedding", near.alias("near"), chance.alias("chance"), F.lit(True).alias("fresh"), F.lit(-1e9).cast("float").alias("worst"))
    met, by_chance = _local(first.withColumnRenamed("near", "place")), _local(first.withColumnRenamed("chance", "place"))
    far = written(_best(_pairs(by_chance), LINKS).select("node", "other"), "far")
    both = _pairs(met).unionByName(_pairs(by_chance)).groupBy("node", "other").agg(F.max("score").alias("score"))
    edges = written(_best(both, k).withColumn("fresh", F.lit(True)), "edges")
    products = _products(met) + _products(by_chance)
    for _ in range(rounds):
        back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh")
        chosen = Window.partitionBy("node").orderBy(F.col("fresh").desc(), F.xxhash64("node", "other"))
        back = back.withColumn("_n", F.row_number().over(chosen)).filter(F.col("_n") <= k).drop("_n")
        around = edges.select("node", "other", "fresh").unionByName(back).groupBy("node", "other").agg(F.max("fresh").alias("fresh"))
        worst = edges.groupBy("node").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-1e9)).cast("float").alias("worst"))
        known = nodes.select("node", "embedding").join(worst, "node", "left").select(F.col("node").alias("other"), "embedding", F.coalesce("worst", F.lit(-1e9).cast("float")).alias("worst"))
        met = _local(around.withColumnRenamed("node", "place").join(known, "other").select("place", "other", "embedding", "fresh", "worst"))
        both = edges.select("node", "other", "score", F.lit(1).alias("old")).unionByName(_pairs(met).withColumn("old", F.lit(0)))
        both = both.groupBy("node", "other").agg(F.max("score").alias("score"), F.max("old").alias("old"))
        grown = written(_best(both, k).select("node", "other", "score", (F.col("old") == 0).alias("fresh")), "edges")
        products += _products(met)
        for superseded in (edges, met):
            discard(superseded)
        edges = grown
        new, every = edges.agg(F.coalesce(F.sum(F.col("fresh").cast("long")), F.lit(0)), F.count("*")).first()
        if new <= least_new * every:
            break
    both = edges.select("node", "other", "score").unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "score")).groupBy("node", "other").agg(F.max("score").alias("score"))
    both = _best(both, 2 * k).select("node", "other").unionByName(far)
    others = written(both.groupBy("node").agg(F.collect_set("other").alias("others")), "neighbours")
    return Graph(rows, nodes, others, quantiser, {i: r["entry"] for i, r in held.items()}, products)


def _near(pairs: DataFrame, graph: Graph, names: np.ndarray, asked: np.ndarray) -> DataFrame:
    """``query``, ``node`` and the product with what the node's code stands for."""
    order = np.argsort(names)
    sent = pairs.sparkSession.sparkContext.broadcast((names[order], asked[order], graph.quantiser))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, quantiser = sent.value
        for batch in batches:
            at = np.searchsorted(names, batch.column("query").to_numpy())
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            near = np.einsum("ij,ij->i", asked[at], quantiser.decode(batch.column("list_id").to_numpy(), codes)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(near)], names=["query", "node", "near"])

    coded = pairs.join(graph.nodes.select("node", "code", "list_id"), "node").select("query", "node", "code", "list_id")
    return coded.mapInArrow(score, "query long, node long, near double")


def _hops(graph: Graph, names: np.ndarray, asked: np.ndarray, beam: int, starts: int) -> DataFrame:
    """All nodes that the searches of a block of queries have seen: ``query``, ``node``, ``near``."""
    spark = graph.nodes.sparkSession
    lists = np.array(sorted(graph.entries))
    c = graph.quantiser.centroids[lists]
    nearest = np.argsort(-(asked @ c.T - (c * c).sum(1) / 2), axis=1, kind="stable")[:, :starts]
    entry = np.array([graph.entries[i] for i in lists.tolist()])
    table = pa.table({"query": np.repeat(names, nearest.shape[1]), "node": entry[nearest].ravel()})
    order = Window.partitionBy("query").orderBy(F.col("near").desc(), "node")
    pool = written(_near(spark.createDataFrame(table), graph, names, asked).withColumn("open", F.lit(True)), "pool")
    while True:
        placed = pool.withColumn("_n", F.row_number().over(order))
        frontier = written(placed.filter((F.col("_n") <= beam) & F.col("open")).select("query", "node"), "frontier")
        if frontier.isEmpty():
            return pool.select("query", "node", "near")
        onward = frontier.join(graph.neighbours, "node").select("query", F.explode("others").alias("node")).distinct()
        new = _near(onward.join(pool.select("query", "node"), ["query", "node"], "left_anti"), graph, names, asked)
        done = pool.join(frontier.withColumn("_done", F.lit(True)), ["query", "node"], "left")
        grown = done.select("query", "node", "near", (F.col("open") & F.col("_done").isNull()).alias("open")).unionByName(new.withColumn("open", F.lit(True)))
        grown = written(grown, "pool")
        for superseded in (pool, frontier):
            discard(superseded)
        pool = grown


def search(graph: Graph, key: str, queries: DataFrame, query: str, k: int = 10, beam: int = 64, starts: int = 4, rescored: int | None = None) -> tuple[DataFrame, DataFrame]:
    """For each query about the ``k`` rows with the largest inner product, and what the search has cost.

    A search keeps hopping until the neighbours of its ``beam`` best nodes are all seen; the ``rescored`` best (ten
    times ``k`` by default) are scored exactly. Equal vectors are one node and are told apart in the result. The second
    table has for each query the ``codes`` scored and the full ``products``. Null vectors are neither found nor asked.
    """
    spark, most = graph.nodes.sparkSession, rescored or 10 * k
    hits, costs = [spark.createDataFrame([], "query long, key long, score double")], [spark.createDataFrame([], "query long, codes long, products long")]
    order = Window.partitionBy("query").orderBy(F.col("near").desc(), "node")
    for names, asked in blocks_of(queries, query) if graph.entries else ():
        seen = _hops(graph, names, asked, beam, starts)
        best = seen.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
        hits.append(exactly(best.join(graph.nodes.select(F.col("node"), "embedding"), "node").withColumnRenamed("node", "key"), names, asked))
        costs.append(seen.groupBy("query").agg(F.count("*").alias("codes"), F.least(F.count("*"), F.lit(most)).alias("products")))
    scored, cost = hits[0], costs[0]
    for more, spent in zip(hits[1:], costs[1:], strict=True):
        scored, cost = scored.unionByName(more), cost.unionByName(spent)
    # of equal vectors the first k rows are enough; they are ranked before they are shuffled
    equal = Window.partitionBy("embedding").orderBy("key")
    copies = graph.rows.withColumn("_n", F.row_number().over(equal))
    copies = copies.filter(F.col("_n") <= k).join(graph.nodes.select("node", "embedding"), "embedding").select(F.col("node").alias("key"), F.col("key").alias("row"))
    whole = ranked(scored, "key", "query", k).select("query", "key").join(scored, ["query", "key"]).join(copies, "key").select("query", F.col("row").alias("key"), "score")
    return ranked(whole, key, query, k), cost.withColumnRenamed("query", query)
