"""Approximate vector search in lists: vectors stored by list, residuals as short codes, the best scored exactly.

A vector lies in the list of its nearest coarse centroid; what is left of it after that centroid (its residual) is
kept as a product-quantised code of a few bytes. A search reads only the lists that some query looks into (other files
are pruned by their partition) and of these only keys and codes, scores the codes, and reads full vectors for the best
candidates alone. Centroids and code books are fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.operators.storage import shared_place
from docweft.operators.vectors import BLOCK, CELLS, SAMPLE, matrix

#: Parts of a code (one byte each), values a part may have, rounds of k-means.
PARTS, VALUES, ROUNDS = 16, 256, 8


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a bounded sample; a centroid that loses all its points keeps its place."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - (c * c).sum(1) / 2).argmax(1)


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids, and for each part of a residual its code book."""

    centroids: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int = PARTS) -> Quantiser:
        """``parts`` is lowered to the dimensions, if these are fewer."""
        size = x.shape[1]
        parts = max(1, min(parts, size))
        centroids = k_means(x, lists)
        left = _cut(x - centroids[nearest(x, centroids)], parts)
        return cls(centroids, np.stack([k_means(left[:, p], min(VALUES, len(x))) for p in range(parts)]))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector and its code."""
        at = nearest(x, self.centroids)
        left = _cut(x - self.centroids[at], len(self.books))
        return at, np.stack([nearest(left[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def decode(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for: products with these are the scores that tables of the parts would sum."""
        left = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)
        return self.centroids[at] + left[:, : self.centroids.shape[1]]

    def looks(self, asked: np.ndarray, probes: int) -> np.ndarray:
        """Which lists each query looks into: those whose centroids are nearest."""
        out = np.zeros((len(asked), len(self.centroids)), bool)
        order = np.argsort(-(asked @ self.centroids.T - (self.centroids**2).sum(1) / 2), axis=1, kind="stable")
        np.put_along_axis(out, order[:, :probes], True, 1)
        return out


def _cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Vectors as ``parts`` of equal length, the last filled with zeros."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)


@dataclass(frozen=True)
class Lists:
    """A written index: ``list_id`` (the partition), ``key``, ``code`` and ``embedding``; rows of each list."""

    table: DataFrame
    quantiser: Quantiser
    sizes: dict[int, int]


def sample(vectors: DataFrame, key: str, rows: int = SAMPLE) -> np.ndarray:
    """At most ``rows`` vectors, chosen by a hash of their keys."""
    chosen = vectors.select(key, "embedding").orderBy(F.xxhash64(key), key).limit(rows).select("embedding").toArrow()
    return matrix(chosen.column("embedding").combine_chunks())


def build(vectors: DataFrame, key: str, lists: int | None = None, parts: int = PARTS, fitted_on: int = SAMPLE) -> Lists:
    """Writes the index of all vectors that are not null; by default as many lists as the square root of their number.

    Centroids and code books are fitted on at most ``fitted_on`` vectors. Large lists are written by several tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("embedding").isNotNull()).select(F.col(key).cast("long").alias("key"), "embedding")
    x = sample(rows, "key", fitted_on)
    if not len(x):
        return Lists(spark.createDataFrame([], "key long, code binary, embedding array<float>, list_id int"), Quantiser(x, np.zeros((0, 0, 0))), {})
    quantiser = Quantiser.fit(x, lists or max(16, math.isqrt(rows.count())), parts)
    sent = spark.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, codes = sent.value.encode(matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("embedding"), pa.array(at.astype(np.int32))],
                names=["key", "code", "embedding", "list_id"],
            )

    kind = rows.schema["embedding"].dataType.simpleString()
    path = f"{shared_place(spark)}/vector-lists-{uuid.uuid4().hex}"
    coded = rows.mapInArrow(encode, f"key long, code binary, embedding {kind}, list_id int")
    coded.repartitionByRange("list_id", F.xxhash64("key")).write.partitionBy("list_id").parquet(path)
    table = spark.read.schema(f"key long, code binary, embedding {kind}, list_id int").parquet(path)
    sizes = {r["list_id"]: r["n"] for r in table.groupBy("list_id").agg(F.count("*").alias("n")).collect()}  # one row a list
    return Lists(table, quantiser, sizes)


class Best:
    """The best rows of each query that a task has met: scores and keys, of bounded size."""

    def __init__(self, queries: int, most: int):
        self.most = most
        self.score = np.full((queries, most), -np.inf, np.float32)
        self.found = np.zeros((queries, most, 2), np.int64)

    def meet(self, queries: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        """Scores of some queries (rows) with some vectors (``found``: key and list)."""
        if score.shape[1] > self.most:
            at = np.argpartition(-score, self.most - 1, axis=1)[:, : self.most]
            score, found = np.take_along_axis(score, at, 1), found[at]
        else:
            found = np.broadcast_to(found, (len(queries), *found.shape))
        score = np.hstack([self.score[queries], score])
        at = np.argpartition(-score, self.most - 1, axis=1)[:, : self.most]
        self.score[queries] = np.take_along_axis(score, at, 1)
        self.found[queries] = np.take_along_axis(np.concatenate([self.found[queries], found], axis=1), at[:, :, None], 1)


def _scanned(index: Lists, names: np.ndarray, asked: np.ndarray, looks: np.ndarray, most: int) -> DataFrame:
    """The ``most`` best candidates of each query by code, of each task; lists that nobody looks into are not read."""
    wanted = [int(i) for i in np.flatnonzero(looks.any(axis=0))]
    spark = index.table.sparkSession
    sent = spark.sparkContext.broadcast((names, asked.astype(np.float32), looks, index.quantiser))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, looks, quantiser = sent.value
        best = Best(len(names), most)
        for batch in batches:
            at, keys = batch.column("list_id").to_numpy(), batch.column("key").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for one in np.unique(at):
                rows, queries = np.flatnonzero(at == one), np.flatnonzero(looks[:, one])
                step = max(1, CELLS // max(len(queries), 1))
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    x = quantiser.decode(at[part], codes[part]).astype(np.float32)
                    best.meet(queries, asked[queries] @ x.T, np.stack([keys[part], at[part]], axis=1))
        row, place = np.nonzero(best.score > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[row]), pa.array(best.found[row, place, 0]), pa.array(best.found[row, place, 1].astype(np.int32)), pa.array(best.score[row, place])],
            names=["query", "key", "list_id", "near"],
        )

    read = index.table.filter(F.col("list_id").isin(wanted)).select("key", "code", "list_id")
    order = Window.partitionBy("query").orderBy(F.col("near").desc(), "key")
    found = read.mapInArrow(scan, "query long, key long, list_id int, near float")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def exactly(candidates: DataFrame, names: np.ndarray, asked: np.ndarray) -> DataFrame:
    """``query``, ``key`` and the inner product of candidates (``query``, ``key``, ``embedding``) of a block of queries."""
    order = np.argsort(names)
    sent = candidates.sparkSession.sparkContext.broadcast((names[order], asked[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = sent.value
        for batch in batches:
            at = np.searchsorted(names, batch.column("query").to_numpy())
            product = np.einsum("ij,ij->i", asked[at], matrix(batch.column("embedding"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("key"), pa.array(product)], names=["query", "key", "score"])

    return candidates.select("query", "key", "embedding").mapInArrow(score, "query long, key long, score double")


def ranked(scored: DataFrame, key: str, query: str, k: int) -> DataFrame:
    """The ``k`` best of each query, ranked from 0; equal products by key."""
    order = Window.partitionBy("query").orderBy(F.round("score", 12).desc(), "key")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
    return best.select(F.col("query").alias(query), F.col("key").alias(key), F.round("score", 6).alias("score"), "rank")


def blocks_of(queries: DataFrame, query: str, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names and vectors of all queries, in blocks of bounded size."""
    asked = queries.filter(F.col("embedding").isNotNull()).select(F.col(query).cast("long").alias("query"), "embedding")
    blocks = max(1, -(-asked.count() // block))
    for b in range(blocks):
        table = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toArrow()
        if table.num_rows:
            yield table.column("query").to_numpy(), matrix(table.column("embedding").combine_chunks())


def search(index: Lists, key: str, queries: DataFrame, query: str, k: int = 10, share: float = 0.1, rescored: int | None = None) -> DataFrame:
    """For each query about the ``k`` rows with the largest inner product, ranked from 0.

    Each query looks into the ``share`` of lists nearest to it; of their rows the ``rescored`` best by code (ten times
    ``k`` by default) are scored exactly. Null vectors are neither found nor asked; an empty index finds nothing.
    """
    most = rescored or 10 * k
    parts = []
    for names, asked in blocks_of(queries, query) if index.sizes else ():
        looks = index.quantiser.looks(asked, max(1, math.ceil(share * len(index.quantiser.centroids))))
        near = _scanned(index, names, asked, looks, most)
        full = index.table.select("list_id", "key", "embedding")
        parts.append(exactly(near.join(full, ["list_id", "key"]), names, asked))
    if not parts:
        parts = [index.table.sparkSession.createDataFrame([], "query long, key long, score double")]
    scored = parts[0]
    for more in parts[1:]:
        scored = scored.unionByName(more)
    return ranked(scored, key, query, k)


def work(index: Lists, queries: DataFrame, query: str, k: int = 10, share: float = 0.1, rescored: int | None = None) -> DataFrame:
    """What a search costs each query: ``lists`` looked into, ``codes`` scored, full ``products``, and ``bytes`` of codes read."""
    rows = []
    for names, asked in blocks_of(queries, query) if index.sizes else ():
        looks = index.quantiser.looks(asked, max(1, math.ceil(share * len(index.quantiser.centroids))))
        size = np.array([index.sizes.get(i, 0) for i in range(looks.shape[1])])
        codes = looks @ size
        width = 8 + len(index.quantiser.books)
        rows += [(int(q), int(n), int(c), int(min(c, rescored or 10 * k)), int(c) * width) for q, n, c in zip(names, looks.sum(axis=1), codes, strict=True)]
    return index.table.sparkSession.createDataFrame(rows, f"{query} long, lists long, codes long, products long, bytes long")
