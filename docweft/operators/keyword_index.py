"""The keyword index: postings, statistics, BM25, exact and fuzzy search, each for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text
from docweft.operators import term_index
from docweft.operators.storage import written

K1, B = 1.5, 0.75
#: Terms of queries that are broadcast at most.
BROADCAST_TERMS = 200_000


def terms(rows: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Each row's key and its set of terms; null texts have none."""
    return rows.select(key, text.index_keywords(F.coalesce(F.col(column), F.lit(""))).alias("terms"))


def postings(indexed: DataFrame, key: str) -> DataFrame:
    return indexed.select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term"))


def document_frequency(indexed: DataFrame, key: str) -> DataFrame:
    return postings(indexed, key).groupBy("term").agg(F.count("*").alias("df"))


def top(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The ``k`` best rows of each query, ranked from 0; equal scores by key. Ranked before the shuffle, too."""
    best = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


@dataclass(frozen=True)
class Index:
    """A written keyword index: ``stored`` postings (``term``, key, ``dl``), each file in order of term, and the totals (one row).

    Files are segments: all postings of a row are in one, as it was read, and nothing is shuffled to write them.
    """

    key: str
    stored: DataFrame
    totals: DataFrame

    @property
    def postings(self) -> DataFrame:
        """The postings with the frequency of their term (``df``)."""
        return self.stored.join(frequencies(self), "term").select("term", self.key, "dl", "df")


def build(indexed: DataFrame, key: str) -> Index:
    """Writes the postings of rows with their terms once; searches then read only them.

    Frequencies are counted where they are asked for, as few terms are asked at once. A row has as many postings as
    terms, so the mean number of terms follows from the number of postings; rows without a term count, too.
    """
    stored = written(postings(indexed, key).select("term", key, "dl").sortWithinPartitions("term", key), "keyword-index", "zstd")
    totals = indexed.agg(F.count("*").alias("n_docs")).join(F.broadcast(stored.agg(F.count("*").alias("n"))))  # one row each
    totals = totals.select("n_docs", F.when(F.col("n_docs") > 0, F.col("n") / F.col("n_docs")).alias("avg_dl"))
    return Index(key, stored, written(totals, "keyword-totals"))


def frequencies(index: Index) -> DataFrame:
    """How many rows have each term of a written index."""
    return index.stored.groupBy("term").agg(F.count("*").alias("df"))


def bm25(index: Index, queries: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The ``k`` best rows for each query (``query`` and ``terms`` columns) by BM25 over term sets.

    Only postings that some query asks for are counted and scored, and a row's scores are summed where its postings
    are. Terms occur once in a set, so their frequency is 1. The queries' terms are broadcast if their number allows.
    """
    asked = queries.select(query, F.explode("terms").alias("term"))
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    sent = F.broadcast if few else lambda rows: rows
    wanted = sent(asked.select("term").distinct())
    frequency = index.stored.select("term").join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    asked = sent(asked.join(sent(frequency), "term"))
    scored = index.stored.join(asked, "term").join(F.broadcast(index.totals))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return top(scored.groupBy(query, index.key).agg(F.round(F.sum(part), 6).alias("score")), query, index.key, k)


def exact(indexed: DataFrame, key: str, phrase: str) -> DataFrame:
    """Rows of which every word of the phrase is part of some term."""
    asked = [w for w in phrase.lower().split() if w]
    within = lambda word: F.exists("terms", lambda t: F.contains(t, F.lit(word)))
    found = indexed
    for word in asked:
        found = found.filter(within(word))
    return found.select(key, F.lit(1.0).alias("score"))


def similar_terms(index: term_index.Terms, asked: DataFrame) -> DataFrame:
    """Pairs of asked terms (``term``) and vocabulary terms whose similarity reaches the threshold of the term index.

    Terms meet only where they can be alike: in a shortened form or a segment (see ``term_index``), or one inside the
    other, which shows in a shared three-letter sequence or in one being a part of the other. Each is an equi-join.
    """
    threshold, vocabulary = index.threshold, index.terms
    asked = asked.select(F.col("term").alias("asked")).distinct()
    grams = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("term") - n + 1, F.lit(1))), lambda i: F.substring(F.col("term"), i, F.lit(n))))
    # terms of one or two letters are asked for rarely, and only then is the vocabulary cut so finely
    short = sorted(r[0] for r in asked.filter("asked <> ''").select(F.least(F.length("asked"), F.lit(3))).distinct().collect())
    to = term_index.sent(asked)
    pieces = [vocabulary.select("term", F.explode(grams(n)).alias("gram")).join(to(asked.filter(F.least(F.length("asked"), F.lit(3)) == n).select("asked", F.substring("asked", 1, n).alias("gram"))), "gram") for n in short]
    near = term_index.near(index, asked)
    inside = near.limit(0)
    for piece in pieces:
        inside = inside.unionByName(piece.filter(F.contains("term", "asked")).select("asked", "term"))
    size = F.length("asked")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(F.col("asked"), i, n))))
    around = to(asked.select("asked", F.explode(F.array_distinct(parts)).alias("term"))).join(vocabulary, "term").select("asked", "term")
    pairs = near.union(inside).union(around).distinct()
    return pairs.withColumn("similarity", text.string_similarity(F.col("asked"), F.col("term"))).filter(F.col("similarity") >= threshold)


def fuzzy(index: Index, queries: DataFrame, query: str, k: int = 20, threshold: float = 0.7, known: term_index.Terms | None = None) -> DataFrame:
    """The ``k`` best rows for each query by the summed similarity of its terms to the row's terms.

    ``known`` is the index of the vocabulary, if it has been built before.
    """
    asked = queries.select(query, F.explode("terms").alias("asked"))
    known = known or term_index.build(index.stored.select("term"), threshold)
    alike = similar_terms(known, asked.select(F.col("asked").alias("term")))
    wanted = asked.join(alike, "asked").groupBy(query, "term").agg(F.sum("similarity").alias("weight"))
    scored = index.stored.join(wanted, "term").groupBy(query, index.key).agg(F.round(F.sum("weight"), 6).alias("score"))
    return top(scored, query, index.key, k)


def lookup(indexed: DataFrame, key: str, term: str) -> DataFrame:
    """The rows that have a term."""
    return indexed.filter(F.array_contains("terms", term.lower())).select(key)
