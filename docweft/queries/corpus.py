"""Queries over blocks, chunks and their classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.functions import rules, text
from docweft.operators import chunking
from docweft.queries.base import SQL_BLOCKS, SQL_CHUNKS, SQL_CONCEPTS, SQL_STYLED, SQL_TYPED, Tables, quoted, registered, sql_any, sql_arg_max, sql_capitals, sql_count, sql_first
from docweft.sources import documents

_LOW = "lower(trim(content))"
_BLOCK_TYPE = f"""CASE WHEN font_size > 16 OR (font_size > 14 AND is_bold) THEN 'heading'
  WHEN ({" OR ".join(f"regexp_matches({_LOW}, {quoted(p)})" for p in rules.HEADING_PATTERNS)}) AND (font_size > 12 OR is_bold) THEN 'heading'
  WHEN substr({_LOW}, 1, 1) IN ({", ".join(map(quoted, rules.BULLETS))}) OR regexp_matches({_LOW}, {quoted(rules.NUMBERED_ITEM)}) THEN 'list_item'
  WHEN regexp_matches({_LOW}, {quoted(rules.CAPTION)}) THEN 'caption'
  WHEN {sql_any("content", rules.FORMULA_MARKS)} AND length(content) < {rules.FORMULA_BLOCK_CHARS} THEN 'formula' ELSE 'paragraph' END"""


@registered("block_split", f"WITH {SQL_BLOCKS} SELECT doc_id, page_number, block_idx, content FROM blocks")
def block_split(t: Tables) -> DataFrame:
    return t.blocks().select("doc_id", "page_number", "block_idx", "content")


@registered("block_classify", f"WITH {SQL_STYLED} SELECT doc_id, block_idx, {_BLOCK_TYPE} AS block_type FROM styled")
def block_classify(t: Tables) -> DataFrame:
    return documents.typed(t.styled()).select("doc_id", "block_idx", "block_type")


@registered(
    "heading_level",
    f"""WITH {SQL_STYLED}, kinds AS (SELECT doc_id, block_idx, trim(content) AS c, font_size, is_bold, {_BLOCK_TYPE} AS kind FROM styled)
    SELECT doc_id, block_idx, CAST(CASE WHEN kind = 'heading' THEN CASE WHEN font_size > 18 THEN 1 WHEN font_size > 14 THEN 2 ELSE 3 END
      WHEN regexp_matches(c, '(?i)^chapter\\s+\\d+') THEN 1
      WHEN regexp_matches(c, '^(\\d+)\\.(\\d+)?(\\.(\\d+))?') THEN CASE WHEN regexp_matches(c, '^\\d+\\.(\\d+)?\\.\\d') THEN 3 WHEN regexp_matches(c, '^\\d+\\.\\d') THEN 2 ELSE 1 END
      WHEN is_bold AND length(c) < 100 THEN 2 END AS INTEGER) AS level FROM kinds""",
)
def heading_level(t: Tables) -> DataFrame:
    typed = documents.typed(t.styled())
    return typed.select("doc_id", "block_idx", text.heading_level(F.col("content"), F.col("block_type"), F.col("font_size"), F.col("is_bold")).alias("level"))


@registered(
    "sentence_split",
    """SELECT doc_id, i AS pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM (
      SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))""",
)
def sentence_split(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@registered("reading_order", f"WITH {SQL_STYLED} SELECT doc_id, page_number, block_idx, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, block_idx) AS position FROM styled")
def reading_order(t: Tables) -> DataFrame:
    return documents.reading_order(t.styled(), "doc_id", "page_number").select("doc_id", "page_number", "block_idx", F.col("position").cast("long").alias("position"))


@registered(
    "page_full_text",
    f"WITH {SQL_BLOCKS} SELECT doc_id, page_number, string_agg(content, chr(10) ORDER BY block_idx) AS full_text, count(*) AS n_blocks FROM blocks GROUP BY ALL",
)
def page_full_text(t: Tables) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "content"))), lambda x: x["content"])
    return t.blocks().groupBy("doc_id", "page_number").agg(F.array_join(ordered, "\n").alias("full_text"), F.count("*").alias("n_blocks"))


@registered(
    "document_hash",
    f"""WITH {SQL_BLOCKS}, pages AS (SELECT doc_id, page_number, string_agg(content, chr(10) ORDER BY block_idx) AS raw FROM blocks GROUP BY ALL)
    SELECT doc_id::VARCHAR AS document_id, count(*) AS total_pages, substr(sha256(doc_id || '.txt:' || count(*) || string_agg(raw, '' ORDER BY page_number)), 1, 16) AS content_hash FROM pages GROUP BY doc_id""",
)
def document_hash(t: Tables) -> DataFrame:
    pages = page_full_text(t).select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "page_number", F.col("full_text").alias("raw_text"))
    return documents.document_hash(pages)


@registered("spans_to_blocks", f"""WITH {SQL_STYLED} SELECT doc_id::VARCHAR AS document_id, block_idx // 3 AS block_idx, string_agg(content, ' ' ORDER BY block_idx) AS content,
  round(avg(font_size), 6) AS font_size, bool_or(is_bold) AS is_bold FROM styled GROUP BY doc_id, block_idx // 3""".replace("GROUP BY doc_id, block_idx // 3", "GROUP BY doc_id, styled.block_idx // 3"))
def spans_to_blocks(t: Tables) -> DataFrame:
    spans = t.styled().select("document_id", F.lit(1).alias("page_number"), F.floor(F.col("block_idx") / 3).cast("int").alias("block_idx"), F.col("block_idx").alias("span_idx"), "content", "font_size", F.lit("serif").alias("font"), F.when(F.col("is_bold"), 16).otherwise(0).alias("flags"))
    return documents.spans_to_blocks(spans).select("document_id", "block_idx", "content", F.round("font_size", 6).alias("font_size"), "is_bold")


@registered("large_images", f"WITH {SQL_STYLED} SELECT doc_id, block_idx, (x1 - x0) * (y1 - y0) AS area FROM styled WHERE (x1 - x0) * (y1 - y0) >= 900")
def large_images(t: Tables) -> DataFrame:
    return documents.large_images(t.styled(), 900).select("doc_id", "block_idx", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


@registered("extraction_counts", f"""WITH {SQL_STYLED} SELECT doc_id::VARCHAR AS document_id, max(page_number) AS n_pages, count(*) AS n_blocks, count(*) FILTER ((x1 - x0) * (y1 - y0) >= 900) AS n_images FROM styled GROUP BY doc_id""")
def extraction_counts(t: Tables) -> DataFrame:
    from docweft.plans.reports import extraction_counts as counts

    return counts(t.blocks(), documents.large_images(t.styled(), 900))


@registered("safe_filename", "SELECT page_id, trim(substr(regexp_replace(regexp_replace(url, '[^\\p{L}\\p{N}_\\s.-]', '_', 'g'), '\\s+', '_', 'g'), 1, 200), '_') AS name FROM pages")
def safe_filename(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", documents.safe_filename(F.col("url")).alias("name"))


@registered(
    "page_blocks",
    f"""WITH raw AS (SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS block_idx FROM (SELECT page_id, list_filter(string_split(regexp_replace(html, '<(h1|p|li)([\\s>])', chr(1) || '<\\1\\2', 'g'), chr(1)), lambda x: regexp_matches(x, '^<(?:h1|p|li)[\\s>]')) AS l FROM pages)),
    styled AS (SELECT page_id, CAST(block_idx AS INTEGER) AS block_idx, tag, content, CASE tag WHEN 'h1' THEN 20.0 ELSE 12.0 END AS font_size, tag = 'h1' AS is_bold FROM (
      SELECT page_id, block_idx, regexp_extract(raw, '^<(h1|p|li)', 1) AS tag, trim(regexp_replace(regexp_replace(regexp_replace(raw, '(?s)</(?:h1|p|li)>.*$', ''), '<[^>]*>?', ' ', 'g'), '\\s+', ' ', 'g')) AS content FROM raw) WHERE content <> '')
    SELECT page_id, block_idx, tag, content, CASE WHEN tag = 'li' THEN 'list_item' ELSE {_BLOCK_TYPE} END AS block_type FROM styled""",
)
def page_blocks(t: Tables) -> DataFrame:
    return documents.page_blocks(t.read("pages"))


@registered(
    "bbox_iou",
    f"""WITH {SQL_STYLED} SELECT a.doc_id, a.block_idx AS left_id, b.block_idx AS right_id,
      round(coalesce(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / nullif((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0), 0), 0), 6) AS iou
    FROM styled a JOIN styled b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.block_idx < b.block_idx AND a.x1 >= b.x0 AND b.x1 >= a.x0 AND a.y1 >= b.y0 AND b.y1 >= a.y0""",
)
def bbox_iou(t: Tables) -> DataFrame:
    from docweft.operators.relations import overlaps

    paged = t.styled().withColumn("page_key", F.struct("doc_id", "page_number"))
    return overlaps(paged, "block_idx", "page_key").select("page_key.doc_id", "left_id", "right_id", "iou")


# Chunks


@registered(
    "chunk_fixed",
    f"""WITH RECURSIVE {SQL_BLOCKS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_idx) AS n FROM blocks),
    walk AS (
      SELECT doc_id, page_number, n, CASE WHEN length(content) >= {chunking.MAX_CHARS} THEN content END AS emitted, content AS held FROM numbered WHERE n = 1
      UNION ALL
      SELECT b.doc_id, b.page_number, b.n, CASE WHEN length(w.held) + 1 + length(b.content) >= {chunking.MAX_CHARS} THEN w.held END,
             CASE WHEN length(w.held) + 1 + length(b.content) >= {chunking.MAX_CHARS} THEN b.content ELSE w.held || chr(10) || b.content END
      FROM walk w JOIN numbered b ON b.doc_id = w.doc_id AND b.page_number = w.page_number AND b.n = w.n + 1),
    pieces AS (SELECT doc_id, page_number, n, 0 AS rest, emitted AS content FROM walk WHERE emitted IS NOT NULL
      UNION ALL SELECT doc_id, page_number, n, 1, held FROM walk QUALIFY n = max(n) OVER (PARTITION BY doc_id, page_number) AND length(held) >= {chunking.MIN_CHARS})
    SELECT 'C_' || doc_id || '_' || page_number || '_' || (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY n, rest) - 1) AS chunk_id, content FROM pieces""",
)
def chunk_fixed(t: Tables) -> DataFrame:
    return chunking.fixed(t.blocks()).select("chunk_id", "content")


@registered("chunk_hierarchical")
def chunk_hierarchical(t: Tables) -> DataFrame:
    return chunking.hierarchical(t.styled()).select("document_id", "chunk_id", "seq", "chunk_type", "heading", F.array_join("section_hierarchy", " > ").alias("sections"), "parent_id", "previous_id", "next_id", "content")


@registered("chunk_semantic")
def chunk_semantic(t: Tables) -> DataFrame:
    """Every sentence takes one of the given vectors, by its place, as its embedding."""
    sentences = t.read("documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(text.sentences(F.col("text"))).alias("sentence_idx", "content"))
    vectors = t.vectors().select(F.col("vec_id").alias("v"), "embedding")
    # ids count from 0; a sentence whose number no vector has is unlike none
    numbered = sentences.withColumn("v", F.pmod(F.xxhash64("document_id", F.floor(F.col("sentence_idx") / 4)), F.lit(vectors.count())))
    rows = numbered.join(vectors, "v", "left").withColumn("page_number", (1 + F.floor(F.col("sentence_idx") / 40)).cast("int"))
    return chunking.semantic(rows).select("document_id", "chunk_id", "content", F.array_join("page_numbers", ",").alias("pages"), "seq")


@registered("chunk_links", f"WITH {SQL_CHUNKS} SELECT chunk_id, seq, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")
def chunk_links(t: Tables) -> DataFrame:
    out = chunking.linked(t.chunks().drop("seq"), ["idx"])
    return out.select("chunk_id", F.col("seq").cast("long").alias("seq"), "previous_id", "next_id")


@registered("chunk_children", f"""WITH {SQL_CHUNKS} SELECT doc_id::VARCHAR AS document_id, 'C_' || doc_id || '_' || (1 + (idx // 5 * 5) * 10 // 40) || '_' || (idx // 5 * 5) AS parent_id,
  string_agg(chunk_id, ',' ORDER BY seq) AS children FROM chunks WHERE idx % 5 <> 0 GROUP BY doc_id, idx // 5""")
def chunk_children(t: Tables) -> DataFrame:
    return chunking.children(_nested(t)).select("document_id", "parent_id", F.array_join("children", ",").alias("children"))


def _nested(t: Tables) -> DataFrame:
    """Chunks of which every fifth is the parent of the next four."""
    head = F.floor(F.col("idx") / 5).cast("int") * 5
    parent = F.concat_ws("_", F.lit("C"), "doc_id", (1 + F.floor(head * 10 / 40)).cast("int"), head)
    return t.chunks().withColumn("parent_id", F.when(F.col("idx") % 5 != 0, parent))


@registered("chunk_ancestors")
def chunk_ancestors(t: Tables) -> DataFrame:
    return chunking.ancestors(chunking.hierarchical(t.styled()))


@registered("chunk_descendants", f"""WITH {SQL_CHUNKS} SELECT doc_id::VARCHAR AS document_id, 'C_' || doc_id || '_' || (1 + (idx // 5 * 5) * 10 // 40) || '_' || (idx // 5 * 5) AS chunk_id, chunk_id AS descendant_id, 1 AS distance FROM chunks WHERE idx % 5 <> 0""")
def chunk_descendants(t: Tables) -> DataFrame:
    return chunking.descendants(_nested(t))


@registered("chunk_context", f"""WITH {SQL_CHUNKS} SELECT c.doc_id::VARCHAR AS document_id, c.chunk_id, (c.idx % 5 <> 0)::INTEGER AS depth, CASE WHEN c.idx % 5 <> 0 THEN p.content || chr(10) || chr(10) ELSE '' END || c.content AS full_context
  FROM chunks c JOIN chunks p ON p.doc_id = c.doc_id AND p.idx = c.idx // 5 * 5""")
def chunk_context(t: Tables) -> DataFrame:
    return chunking.placed(_nested(t))


@registered("context_window", f"WITH {SQL_CHUNKS} SELECT chunk_id, array_to_string(list(chunk_id) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ',') AS window_ids FROM chunks")
def context_window(t: Tables) -> DataFrame:
    return chunking.context_window(t.chunks()).select("chunk_id", F.array_join("window_ids", ",").alias("window_ids"))


_CLASS = sql_first("lower(content)", rules.CHUNK_TYPES, f"CASE WHEN {sql_any('content', rules.CHUNK_FORMULA_MARKS)} THEN 'formula_block' ELSE 'paragraph' END")


@registered("classify_type", f"WITH {SQL_CHUNKS} SELECT chunk_id, {_CLASS} AS chunk_type FROM chunks")
def classify_type(t: Tables) -> DataFrame:
    return t.chunks().select("chunk_id", text.chunk_type(F.col("content"), F.lit("paragraph")).alias("chunk_type"))


@registered("content_type", f"""WITH {SQL_CHUNKS} SELECT chunk_id, {sql_first("lower(content)", rules.CONTENT_TYPES, "CASE WHEN doc_id % 3 = 0 THEN 'formula_block' ELSE 'paragraph' END")} AS chunk_type FROM chunks""")
def content_type(t: Tables) -> DataFrame:
    return t.chunks().select("chunk_id", text.content_type(F.col("content"), F.col("doc_id") % 3 == 0).alias("chunk_type"))


@registered("classify_domain", f"WITH {SQL_TYPED} SELECT chunk_id, domain FROM typed")
def classify_domain(t: Tables) -> DataFrame:
    return t.typed().select("chunk_id", "domain")


_SCORE = {level: sql_count("lower(content)", words) for level, words in rules.DIFFICULTY_WORDS.items()}
_SCORE["advanced"] = f"({_SCORE['advanced']} + CASE WHEN len(string_split(content, '=')) - 1 + len(string_split(content, '∫')) - 1 > 5 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(content), {quoted(rules.PROOF_MARKS)}) THEN 3 ELSE 0 END)"


@registered("classify_difficulty", f"WITH {SQL_CHUNKS} SELECT chunk_id, {sql_arg_max(_SCORE, quoted('intermediate'))} AS difficulty FROM chunks")
def classify_difficulty(t: Tables) -> DataFrame:
    return t.chunks().select("chunk_id", text.difficulty(F.col("content")).alias("difficulty"))


@registered("concepts", f"WITH {SQL_CONCEPTS} SELECT chunk_id, array_to_string(concepts, ',') AS concepts FROM known")
def concepts(t: Tables) -> DataFrame:
    return t.typed().select("chunk_id", F.array_join("concepts", ",").alias("concepts"))


_STOP = "[" + ", ".join(map(quoted, rules.CHUNK_STOPWORDS)) + "]"
_NOUNS = "list_filter(regexp_extract_all(content, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]+(?:tion|ment|ness|ity)'))"


@registered(
    "chunk_keywords",
    f"""WITH {SQL_CHUNKS} SELECT chunk_id, array_to_string(list_sort(list_filter(list_distinct(list_concat({sql_capitals("content")}, {_NOUNS})), lambda w: length(w) > 3 AND NOT list_contains({_STOP}, lower(w))))[1:20], ',') AS keywords FROM chunks""",
)
def chunk_keywords(t: Tables) -> DataFrame:
    return t.chunks().select("chunk_id", F.array_join(text.chunk_keywords(F.col("content")), ",").alias("keywords"))


@registered(
    "chunk_flags",
    f"""WITH {SQL_CHUNKS} SELECT chunk_id, regexp_matches(lower(content), {quoted(rules.word("def(?:ine|inition)"))}) AS is_definition, regexp_matches(lower(content), {quoted(rules.word("theorem|lemma"))}) AS is_theorem,
      regexp_matches(lower(content), {quoted(rules.word("example"))}) AS is_example, length(content)::INTEGER AS char_count, len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> ''))::INTEGER AS word_count FROM chunks""",
)
def chunk_flags(t: Tables) -> DataFrame:
    return chunking.flags(t.chunks()).drop("keywords")


@registered("chunk_hash", f"WITH {SQL_CHUNKS} SELECT chunk_id, 'C_' || substr(md5(content), 1, 8) AS content_id, substr(md5(content), 1, 12) AS content_hash FROM chunks")
def chunk_hash(t: Tables) -> DataFrame:
    return t.chunks().select("chunk_id", F.concat(F.lit("C_"), F.substring(F.md5("content"), 1, 8)).alias("content_id"), F.substring(F.md5("content"), 1, 12).alias("content_hash"))


@registered("find_by_page", f"WITH {SQL_TYPED} SELECT chunk_id, chunk_type FROM typed WHERE page_number = 2 AND chunk_type = 'theorem'")
def find_by_page(t: Tables) -> DataFrame:
    return t.typed().filter(F.array_contains("page_numbers", 2) & (F.col("chunk_type") == "theorem")).select("chunk_id", "chunk_type")


@registered("content_page", f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) BETWEEN 6 AND 10")
def content_page(t: Tables) -> DataFrame:
    """The second page of five chunks of each document."""
    return t.chunks().filter((F.col("seq") > 5) & (F.col("seq") <= 10)).select("doc_id", "chunk_id")


@registered("chunk_display", f"WITH {SQL_CHUNKS} SELECT chunk_id, CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END || CASE WHEN heading IS NOT NULL THEN ' [' || heading || ']' ELSE '' END AS shown, heading IS NOT NULL AS has_heading FROM chunks")
def chunk_display(t: Tables) -> DataFrame:
    shown = F.concat(text.preview(F.col("content"), 100), F.when(F.col("heading").isNotNull(), F.concat(F.lit(" ["), "heading", F.lit("]"))).otherwise(""))
    return t.chunks().select("chunk_id", shown.alias("shown"), F.col("heading").isNotNull().alias("has_heading"))


# Tables in text: five lines of a document are rows, their first four words cells

_ROWS = f"{SQL_BLOCKS}, cells AS (SELECT doc_id, block_idx // 5 AS tab, block_idx, (string_split(content, ' ') || ['', '', '', ''])[1:4] AS cells FROM blocks)"
_NUMERIC = "try_cast(regexp_replace(x, '[,%$]', '', 'g') AS DOUBLE) IS NOT NULL AND regexp_matches(x, '\\d')"


def _cells(t: Tables) -> DataFrame:
    cells = F.slice(F.concat(F.split("content", " ", -1), F.array(*[F.lit("")] * 4)), 1, 4)
    return t.blocks().select("doc_id", F.floor(F.col("block_idx") / 5).cast("int").alias("tab"), "block_idx", cells.alias("cells"))


@registered(
    "table_header_detect",
    f"""WITH {_ROWS}, counted AS (SELECT *, len(list_filter(cells, lambda x: trim(x) <> '')) AS n, len(list_filter(cells, lambda x: trim(x) <> '' AND {_NUMERIC})) AS m FROM cells)
    SELECT doc_id, tab, n >= 0.5 * 4 AND m <= 0.5 * n AS is_header FROM counted WHERE block_idx % 5 = 0""",
)
def table_header_detect(t: Tables) -> DataFrame:
    from docweft.operators.tabular import is_header

    return _cells(t).filter("block_idx % 5 = 0").select("doc_id", "tab", is_header(F.col("cells")).alias("is_header"))


@registered(
    "table_markdown",
    f"""WITH {_ROWS} SELECT doc_id, tab, string_agg('| ' || array_to_string(cells, ' | ') || ' |' || CASE WHEN block_idx % 5 = 0 THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END, chr(10) ORDER BY block_idx) AS markdown FROM cells GROUP BY doc_id, tab""",
)
def table_markdown(t: Tables) -> DataFrame:
    from docweft.operators.tabular import markdown

    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "cells"))), lambda x: x["cells"])
    tables = _cells(t).groupBy("doc_id", "tab").agg(ordered.alias("rows"))
    return tables.select("doc_id", "tab", markdown(F.element_at("rows", 1), F.slice("rows", F.lit(2), F.size("rows"))).alias("markdown"))


