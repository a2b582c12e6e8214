"""The engine: documents in, tables and answers out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import latex, text
from docweft.operators import chunking, formulas, keyword_index, relations, vectors
from docweft.operators.storage import written
from docweft.plans import context, fusion, query, reports, search
from docweft.sources import documents, tables

Model = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[list[str], list[str]], list[float]]


@dataclass(frozen=True)
class Settings:
    """What a run may vary."""

    max_chunk_chars: int = chunking.MAX_CHARS
    min_chunk_chars: int = chunking.MIN_CHARS
    chunking: str = "hierarchical"
    top_k: int = 10
    fusion: str = "rrf"
    context_width: int = 2


@dataclass
class Engine:
    """A knowledge base of classified chunks, formulas and their indices, and the questions put to it.

    Embeddings and language models are the caller's: without a model, text search is by keywords alone and answers
    are structured from what is found.
    """

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    model: Model | None = None
    chunks: DataFrame | None = None
    formulas: DataFrame | None = None
    embedded: DataFrame | None = None
    #: Diagrams (``diagram_id, diagram_type, caption, page``) with their vectors, as ``take_diagrams`` wrote them.
    diagrams: DataFrame | None = None
    reranker: Reranker | None = None
    #: The keyword index, built when it is first searched.
    index: keyword_index.Index | None = None

    def process(self, docs: DataFrame) -> Engine:
        """Takes documents (``doc_id``, ``text``) into the knowledge base."""
        return self.process_blocks(documents.line_blocks(docs).withColumn("document_id", F.col("doc_id").cast("string")))

    def process_blocks(self, blocks: DataFrame) -> Engine:
        """Takes blocks (``document_id, page_number, block_idx, content`` and style columns)."""
        cut = chunking.chunk(blocks, self.settings.chunking, most=self.settings.max_chunk_chars, least=self.settings.min_chunk_chars)
        if "heading" not in cut.columns:
            cut = cut.withColumns({"heading": F.lit(None).cast("string"), "parent_id": F.lit(None).cast("string"), "section_hierarchy": F.array().cast("array<string>")})
        # written once, as every question reads them
        self.chunks = written(chunking.classify(cut).withColumn("page_numbers", F.array("page_number")), "chunks")
        self.formulas, self.index = written(formulas.extract(blocks), "formulas"), None
        if self.model:
            self.embedded = self._numbered(vectors.embed(self.chunks.select("chunk_id", "content"), "content", self.model))
        return self

    def take_diagrams(self, diagrams: DataFrame) -> Engine:
        """Takes diagrams into the knowledge base; without an ``embedding`` column the model embeds their captions.

        Without vectors and model diagrams are found by type alone.
        """
        if "embedding" not in diagrams.columns:
            diagrams = vectors.embed(diagrams, "caption", self.model) if self.model else diagrams.withColumn("embedding", F.lit(None).cast("array<double>"))
        self.diagrams = self._numbered(diagrams)
        return self

    @staticmethod
    def _numbered(rows: DataFrame) -> DataFrame:
        """Rows with a number each, given once where they are written."""
        return written(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")

    def save(self, path: str) -> None:
        kept = {"chunks": self.chunks, "formulas": self.formulas, "embedded": self.embedded, "diagrams": self.diagrams}
        tables.save_index({name: table for name, table in kept.items() if table is not None}, path)

    def load(self, path: str, embedded: bool = False, diagrams: bool = False) -> Engine:
        found = tables.load_index(self.spark, path, ["chunks", "formulas", *["embedded"] * embedded, *["diagrams"] * diagrams])
        self.chunks, self.formulas, self.embedded, self.diagrams = found["chunks"], found["formulas"], found.get("embedded"), found.get("diagrams")
        self.index = None
        return self

    def queries(self, texts: list[str]) -> DataFrame:
        return query.process(self.spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string"))

    def search(self, asked: DataFrame, k: int | None = None, indices: tuple[str, ...] = ("keyword", "formula", "text", "domain", "diagram")) -> DataFrame:
        """Fused hits (``query_id, doc_key, score, rank, source``) for processed queries, from the named indices.

        Texts and diagrams are searched by vectors, and so only with a model.
        """
        k = k or self.settings.top_k
        keywords = self._keyword_hits(asked, 2 * k)
        texts = self._text_hits(asked, 2 * k) if self.embedded is not None and self.model else keywords.limit(0)
        hits = keywords.filter(F.lit("keyword" in indices))
        if "text" in indices:
            hits = hits.unionByName(texts)
        if "formula" in indices:
            symbols = {"variables": latex.variables(F.col("raw_text")), "operators": latex.operators(F.col("raw_text"))}
            wanted = asked.filter(F.col("query_type").isin("formula", "mixed") | (F.size("formulas") > 0)).withColumns(symbols).withColumn("domain", F.lit(None).cast("string"))
            hits = hits.unionByName(search.formula_hits(self.formulas, wanted, 2 * k))
        if "diagram" in indices and self.diagrams is not None and self.model:
            hits = hits.unionByName(self._nearest(self.diagrams, "diagram", "diagram_id", asked, 2 * k))
        if "domain" in indices:
            hits = hits.unionByName(search.by_domain(asked, self.formulas, keywords, texts, k))
        fuse = {"rrf": lambda: fusion.reciprocal_rank(hits, k), "weighted": lambda: fusion.weighted(hits, asked, k), "convex": lambda: fusion.convex(hits, asked, k)}
        return fuse[self.settings.fusion]().withColumnRenamed("best_source", "source")

    def _keyword_hits(self, asked: DataFrame, k: int) -> DataFrame:
        if self.index is None:
            self.index = keyword_index.build(keyword_index.terms(self.chunks, "chunk_id", "content"), "chunk_id")
        wanted = asked.select("query_id", text.index_keywords(F.array_join("keywords", " ")).alias("terms"))
        return search.keyword_hits(self.index, wanted, k)

    def _text_hits(self, asked: DataFrame, k: int) -> DataFrame:
        return self._nearest(self.embedded, "text", "chunk_id", asked, k)

    def _nearest(self, rows: DataFrame, source: str, key: str, asked: DataFrame, k: int) -> DataFrame:
        """Hits among numbered rows with vectors, for the vectors of processed queries."""
        seen = vectors.embed(self._numbered(asked.select("query_id", "processed_text")), "processed_text", self.model)
        seen = written(seen.withColumnRenamed("number", "asked"), "asked-vectors")
        found = vectors.top_k(rows, "number", seen, "asked", k).join(rows.select("number", key), "number").join(seen.select("asked", "query_id"), "asked")
        return search.hits(found, source, "query_id", key)

    def expanded(self, found: DataFrame) -> DataFrame:
        """The chunks that hits name, each with its neighbours up to ``Settings.context_width``: ``query_id, position, chunk_id, content``."""
        placed = context.expand(found.filter(F.col("source").isin("text", "keyword", "domain")), self.chunks, self.settings.context_width)
        return placed.join(self.chunks.select("chunk_id", "content"), "chunk_id").select("query_id", "position", "chunk_id", "content")

    def explain(self, texts: list[str], k: int | None = None) -> DataFrame:
        """How each question is understood, and what is found for it."""
        asked = self.queries(texts)
        return context.explanation(self.search(asked, k), asked)

    def formula(self, formula_id: str) -> DataFrame:
        return self.formulas.filter(F.col("formula_id") == formula_id)

    def chunk(self, chunk_id: str) -> DataFrame:
        return self.chunks.filter(F.col("chunk_id") == chunk_id)

    def query(self, texts: list[str], k: int | None = None) -> DataFrame:
        """An answer for each question, with its confidence, context and the ids of the chunks of the expanded context.

        With a reranker the texts found are ranked anew by it before the answer is made.
        """
        asked = written(self.queries(texts), "asked")
        found = written(self.search(asked, k), "found")
        told = context.with_content(found, self.chunks, self.formulas.dropDuplicates(["formula_id"]), self.diagrams)
        if self.reranker:
            told = fusion.rerank(told.join(asked.select("query_id", F.col("raw_text").alias("query_text")), "query_id"), self.reranker)
        told = written(told, "told")
        answers = context.structured_answer(told, asked)
        around = self.expanded(told).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))).alias("around"))
        around = around.select("query_id", F.col("around.chunk_id").alias("context_chunks"))
        out = asked.select("query_id", "raw_text", "query_type", "intent", "domain").join(answers, "query_id", "left").join(fusion.confidence(told), "query_id", "left")
        return out.join(context.context_string(told), "query_id", "left").join(around, "query_id", "left").fillna(0.0, ["confidence"])

    def search_formulas(self, asked: str, k: int = 10) -> DataFrame:
        """Formulas like a formula (a text with ``=`` or a backslash), else those with the variable."""
        if "=" in asked or "\\" in asked:
            return formulas.by_latex(self.formulas, self.spark.createDataFrame([("0", asked)], "query_id string, latex string"), k)
        return formulas.by_variable(self.formulas, asked).select("formula_id").distinct().orderBy("formula_id").limit(k)

    def relations(self) -> DataFrame:
        return relations.proofs(self.chunks).unionByName(relations.examples(self.chunks))

    def book(self, path: str) -> None:
        """Writes the reports of the knowledge base below a path."""
        reports.table_of_contents(self.chunks).write.mode("overwrite").parquet(f"{path}/table_of_contents")
        reports.formula_handbook(self.formulas).write.mode("overwrite").parquet(f"{path}/formula_handbook")
        reports.concept_index(self.chunks).write.mode("overwrite").parquet(f"{path}/concept_index")
        reports.searchable_index(self.chunks, self.formulas).write.mode("overwrite").json(f"{path}/searchable_index")
        self.statistics().write.mode("overwrite").parquet(f"{path}/statistics")

    def statistics(self) -> DataFrame:
        return reports.statistics(self.chunks, self.formulas)
