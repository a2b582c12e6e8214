"""Blocks of documents: from text lines, from web pages, and from files by a parser of the caller's choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import text

LINES_PER_PAGE = 40
#: Smaller images are decoration.
LEAST_IMAGE_AREA = 100
BLOCK_SCHEMA = "document_id string, page_number int, block_idx int, content string, font_size double, is_bold boolean, is_italic boolean, x0 double, y0 double, x1 double, y1 double"


def line_blocks(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """One block for each line that is not blank, numbered through the document, with its page and type.

    Plain text has no typography: the size is 12 and nothing is bold. Null texts have no block.
    """
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: F.trim(x) != "")
    blocks = docs.select("doc_id", F.posexplode(lines).alias("block_idx", "content"))
    return typed(blocks.select("doc_id", (1 + F.floor(F.col("block_idx") / lines_per_page)).cast("int").alias("page_number"), "block_idx", "content"))


def typed(blocks: DataFrame) -> DataFrame:
    """Blocks with their type; missing style columns are plain."""
    size = F.col("font_size") if "font_size" in blocks.columns else F.lit(12.0)
    bold = F.col("is_bold") if "is_bold" in blocks.columns else F.lit(False)
    return blocks.withColumn("block_type", text.block_type(F.col("content"), size, bold))


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of web pages: their ``h1``, ``p`` and ``li`` elements in order, without markup."""
    parts = F.filter(F.split("html", r"(?=<(?:h1|p|li)[\s>])", -1), lambda x: x.rlike(r"^<(?:h1|p|li)[\s>]"))
    rows = pages.select("page_id", F.posexplode(parts).alias("block_idx", "raw"))
    inner = F.regexp_replace("raw", r"(?s)</(?:h1|p|li)>.*$", "")
    content = F.trim(F.regexp_replace(F.regexp_replace(inner, r"<[^>]*>?", " "), r"\s+", " "))
    tag = F.regexp_extract("raw", r"^<(h1|p|li)", 1)
    rows = rows.select("page_id", "block_idx", tag.alias("tag"), content.alias("content")).filter("content <> ''")
    size = F.when(F.col("tag") == "h1", 20.0).otherwise(12.0)
    kind = F.when(F.col("tag") == "li", "list_item").otherwise(text.block_type(F.col("content"), size, F.col("tag") == "h1"))
    return rows.withColumn("block_type", kind)


def spans_to_blocks(spans: DataFrame) -> DataFrame:
    """Blocks from typeset spans (``document_id, page_number, block_idx, span_idx, content, font_size, font, flags``).

    Non-blank spans are joined by spaces; the size is their mean, the font that of the first; bit 4 of any span's
    flags means bold and bit 1 italic. Blocks without a non-blank span are dropped.
    """
    order = F.struct("span_idx", "content")
    ordered = F.transform(F.sort_array(F.collect_list(order)), lambda s: s["content"])
    return (
        spans.filter(F.trim("content") != "")
        .groupBy("document_id", "page_number", "block_idx")
        .agg(
            F.array_join(ordered, " ").alias("content"),
            F.avg("font_size").alias("font_size"),
            F.min_by("font", "span_idx").alias("font"),
            F.max(F.col("flags").bitwiseAND(16) > 0).alias("is_bold"),
            F.max(F.col("flags").bitwiseAND(2) > 0).alias("is_italic"),
        )
    )


def large_images(images: DataFrame, least: float = LEAST_IMAGE_AREA) -> DataFrame:
    """Images whose box covers at least ``least`` square points."""
    return images.filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= least)


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files below a path with their content and its hash; equal names in different folders stay apart."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return found.select("path", name.alias("filename"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.md5("content").alias("file_hash"), "content")


def parse_files(found: DataFrame, parser: Callable[[bytes], list[dict]]) -> DataFrame:
    """Blocks of files by a parser that yields dictionaries with the columns of ``BLOCK_SCHEMA``.

    A file that the parser fails on gives one row with its error; other files go on.
    """
    columns = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                try:
                    rows += [{c: block.get(c) for c in columns} | {"document_id": row.stem, "error": None} for block in parser(row.content)]
                except Exception as error:  # the caller's parser may fail in any way
                    rows.append(dict.fromkeys(columns) | {"document_id": row.stem, "error": str(error)})
            yield pd.DataFrame(rows, columns=[*columns, "error"])

    return found.select("stem", "content").mapInPandas(run, BLOCK_SCHEMA + ", error string")


def safe_filename(name: Column) -> Column:
    """A file name without special characters, at most 200 long."""
    return F.trim(F.substring(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_\s.-]", "_"), r"\s+", "_"), 1, 200), F.lit("_"))


def reading_order(blocks: DataFrame, *key: str) -> DataFrame:
    """Blocks with their place from top to bottom, then left to right; missing boxes come first."""
    from pyspark.sql import Window

    order = Window.partitionBy(*key).orderBy(F.coalesce("y0", F.lit(0.0)), F.coalesce("x0", F.lit(0.0)), "block_idx")
    return blocks.withColumn("position", F.row_number().over(order))


def document_hash(pages: DataFrame) -> DataFrame:
    """A document's hash: name, number of pages and the pages' texts in order, with no separator."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("page_number", "raw_text"))), lambda p: p["raw_text"])
    grouped = pages.groupBy("document_id", "filename").agg(F.array_join(texts, "").alias("all"), F.count("*").alias("total_pages"))
    whole = F.concat("filename", F.lit(":"), F.col("total_pages").cast("string"), "all")
    return grouped.select("document_id", "total_pages", F.substring(F.sha2(whole, 256), 1, 16).alias("content_hash"))
