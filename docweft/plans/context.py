"""From ranked hits to context and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import rules, text
from docweft.operators.storage import written


#: Keys of hits that are broadcast at most.
BROADCAST_KEYS = 200_000


def _named(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among the wanted ones, chosen before anything is shuffled if these are few."""
    few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(wanted) if few else wanted, key, "left_semi")


def with_content(hits: DataFrame, chunks: DataFrame, formulas: DataFrame | None = None, diagrams: DataFrame | None = None) -> DataFrame:
    """Hits with the content, page and section of what they name; unknown keys stay empty."""
    hits = written(hits, "hits")
    parts = _named(chunks, "chunk_id", hits.select(F.col("doc_key").alias("chunk_id")).distinct()).select(F.col("chunk_id").alias("doc_key"), F.struct("content", F.col("page_number").alias("page"), F.col("heading").alias("section")).alias("c"))
    out = hits.join(parts, "doc_key", "left")
    known = [F.col("c")]
    if formulas is not None:
        out = out.join(formulas.select(F.col("formula_id").alias("doc_key"), F.struct(F.col("latex").alias("content"), F.col("source_page").alias("page"), F.lit(None).cast("string").alias("section")).alias("f")), "doc_key", "left")
        known.append(F.col("f"))
    if diagrams is not None:
        out = out.join(diagrams.select(F.col("diagram_id").alias("doc_key"), F.struct(F.col("caption").alias("content"), F.col("page").alias("page"), F.lit(None).cast("string").alias("section")).alias("d")), "doc_key", "left")
        known.append(F.col("d"))
    found = F.coalesce(*known)
    return out.select(*hits.columns, found["content"].alias("content"), found["page"].alias("page"), found["section"].alias("section"))


def expand(hits: DataFrame, chunks: DataFrame, width: int = 2) -> DataFrame:
    """Each query's hit chunks, each followed by up to ``width`` chunks before and then after it; first come, once.

    Chunks stand in order of page and id (as text) within their document; only documents with a hit are put in order.
    """
    hits = written(hits.select("query_id", "doc_key", "rank"), "hits")
    found = written(_named(chunks, "chunk_id", hits.select(F.col("doc_key").alias("chunk_id")).distinct()).select("document_id").distinct(), "found-documents")
    chunks = _named(chunks, "document_id", found)
    order = Window.partitionBy("document_id").orderBy("page_number", "chunk_id")
    placed = chunks.select("document_id", "chunk_id", F.row_number().over(order).alias("n"))
    at = hits.join(placed, hits["doc_key"] == placed["chunk_id"]).select("query_id", F.col("rank").alias("hit_rank"), "document_id", F.col("n").alias("hit_n"))
    around = at.withColumn("n", F.explode(F.sequence(F.col("hit_n") - width, F.col("hit_n") + width)))
    turn = F.when(F.col("n") == F.col("hit_n"), 0).when(F.col("n") < F.col("hit_n"), 1).otherwise(2)
    shown = around.join(placed, ["document_id", "n"]).withColumn("turn", turn)
    first = shown.groupBy("query_id", "chunk_id").agg(F.min(F.struct("hit_rank", "turn", "n")).alias("first"))
    position = Window.partitionBy("query_id").orderBy("first", "chunk_id")
    return first.select("query_id", (F.row_number().over(position) - 1).alias("position"), "chunk_id")


def _first(rows: DataFrame, by: Column, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("rank")
    return rows.filter(by).withColumn("i", F.row_number().over(order)).filter(F.col("i") <= n)


def context_string(found: DataFrame) -> DataFrame:
    """The context of each query: up to five texts with their source, then up to three formulas."""
    texts = _first(found, F.col("source").isin("text", "keyword"), 5)
    line = F.concat(F.lit("[Source "), F.col("i").cast("string"), F.lit(" - Page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(", "), F.coalesce("section", F.lit("Unknown section")), F.lit("]\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    formulas = _first(found, F.col("source") == "formula", 3)
    shown = F.concat(F.lit("  $"), F.coalesce("content", F.lit("")), F.lit("$"))
    rows = texts.select("query_id", F.lit(0).alias("part"), "i", line.alias("line"))
    rows = rows.unionByName(formulas.filter("i = 1").select("query_id", F.lit(1).alias("part"), "i", F.lit("\n[Relevant Formulas]").alias("line")))
    rows = rows.unionByName(formulas.select("query_id", F.lit(2).alias("part"), "i", shown.alias("line")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "i", "line"))), lambda x: x["line"]), "\n").alias("context"))


def sources(found: DataFrame, n: int = 10) -> DataFrame:
    """The first sources of each query, with a preview of 200 characters."""
    return found.filter(F.col("rank") < n).select("query_id", "rank", "source", "doc_key", "score", "page", "section", text.preview(F.col("content"), 200).alias("preview"))


def instruction(intent: Column) -> Column:
    """What an answer to a query of this intent should do."""
    table = F.create_map(*[F.lit(x) for pair in rules.INTENT_INSTRUCTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, intent), F.lit(rules.INTENT_INSTRUCTIONS["general"]))


def structured_answer(found: DataFrame, queries: DataFrame) -> DataFrame:
    """An answer without a language model: by intent, formulas or the first texts, then formulas and sources."""
    texts, formulas, every = _first(found, F.col("source").isin("text", "keyword"), 3), _first(found, F.col("source") == "formula", 3), _first(found, F.lit(True), 5)
    body = F.coalesce("content", F.lit(""))
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit("\n*Source: Page "), F.col("page").cast("string"), F.lit("*\n")))
    intent = queries.select(F.col("query_id").cast("string").alias("query_id"), "intent")
    texts, formulas = texts.filter(body != "").join(intent, "query_id"), formulas.filter(body != "").join(intent, "query_id")
    is_formula, is_definition = F.col("intent") == "formula_lookup", F.col("intent") == "definition"

    def rows(frame: DataFrame, part: int, keep: Column, line: Column) -> DataFrame:
        return frame.filter(keep & line.isNotNull()).select("query_id", F.lit(part).alias("part"), "i", line.alias("line"))

    title = F.when(is_formula, "**Formula Response:**\n").when(is_definition, "**Definition:**\n").otherwise("**Answer:**\n")
    lines = intent.select("query_id", F.lit(0).alias("part"), F.lit(0).alias("i"), title.alias("line"))
    lines = lines.unionByName(rows(formulas, 1, is_formula, F.concat(F.lit("$$\n"), body, F.lit("\n$$"), F.coalesce(F.concat(F.lit("\n"), page), F.lit("")))))
    lines = lines.unionByName(rows(texts, 2, is_formula & (F.col("i") == 1), F.lit("\n**Context:**")))
    lines = lines.unionByName(rows(texts, 3, is_formula & (F.col("i") <= 2), F.concat(F.lit("\n"), text.preview(body, 300))))
    lines = lines.unionByName(rows(texts, 3, is_definition & (F.col("i") <= 2), F.concat(body, F.coalesce(F.concat(F.lit("\n"), page), F.lit("")))))
    lines = lines.unionByName(rows(texts, 3, ~is_formula & ~is_definition, F.concat(body, F.lit("\n"))))
    lines = lines.unionByName(rows(formulas, 4, F.col("i") == 1, F.lit("\n**Relevant Formulas:**")))
    lines = lines.unionByName(rows(formulas, 5, F.lit(True), F.concat(F.lit("  - $"), body, F.lit("$"))))
    lines = lines.unionByName(intent.select("query_id", F.lit(6).alias("part"), F.lit(0).alias("i"), F.lit("\n**Sources:**").alias("line")))
    where = F.concat(
        F.lit("  "), F.col("i").cast("string"), F.lit(". "), F.coalesce(F.concat(F.lit("Page "), F.col("page").cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit(", "), F.col("section")), F.lit("")), F.lit(" (relevance: "), F.format_string("%.2f", "score"), F.lit(")"),
    )
    lines = lines.unionByName(rows(every, 7, F.lit(True), where))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "i", "line"))), lambda x: x["line"]), "\n").alias("answer"))


def coverage(found: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """What the confidence rests on: the share of text hits in ``k``, and of three formulas where these are asked for."""
    counts = found.groupBy("query_id").agg(F.count_if(F.col("source").isin("text", "keyword")).alias("texts"), F.count_if(F.col("source") == "formula").alias("formulas"))
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), (F.col("query_type").isin("formula", "mixed") | (F.size("formulas") > 0)).alias("asks"))
    joined = asked.join(counts, "query_id", "left").fillna(0, ["texts", "formulas"])
    share = F.when(F.col("asks"), F.least(F.lit(1.0), F.col("formulas") / 3)).otherwise(1.0)
    return joined.select("query_id", F.round(F.col("texts") / k, 6).alias("text_coverage"), F.round(share, 6).alias("formula_coverage"))


def explanation(found: DataFrame, queries: DataFrame) -> DataFrame:
    """How each query was understood and what was found for it, in lines."""
    counts = found.groupBy("query_id", "source").agg(F.count("*").alias("n"))
    listed = counts.groupBy("query_id").agg(F.sum("n").alias("total"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "n"))), lambda x: F.concat(F.lit("  - "), x["source"], F.lit(": "), x["n"].cast("string"))), "\n").alias("by_source"))
    rows = queries.select(F.col("query_id").cast("string").alias("query_id"), "raw_text", "query_type", "intent", "keywords").join(listed, "query_id", "left")
    lines = [F.concat(F.lit("Query: "), "raw_text"), F.concat(F.lit("Type: "), "query_type"), F.concat(F.lit("Intent: "), "intent"), F.concat(F.lit("Keywords: "), F.array_join("keywords", ", "))]
    lines.append(F.concat(F.lit("Results: "), F.coalesce("total", F.lit(0)).cast("string")))
    return rows.select("query_id", F.concat_ws("\n", *lines, "by_source").alias("explanation"))


def pages(found: DataFrame) -> DataFrame:
    """The distinct pages of each query's hits, in order; hits without a page have none."""
    return found.filter(F.col("page") > 0).groupBy("query_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
