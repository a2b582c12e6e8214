"""Cutting documents into chunks: fixed size, by headings, and by meaning; links between chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text

MAX_CHARS = 2000
MIN_CHARS = 100
SIMILARITY = 0.3
NONE = "cast(array() as array<string>)"


def _ordered(rows: DataFrame, key: list[str], order: str, *columns: str) -> DataFrame:
    """The rows of each key as one array in order."""
    return rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("items"))


def fixed(blocks: DataFrame, most: int = MAX_CHARS, least: int = MIN_CHARS, dedup_oversize: bool = False) -> DataFrame:
    """Greedy chunks of each page (``document_id, page_number, block_idx, content``).

    Blocks gather until their joined length reaches ``most``; then all but the last are emitted and the last begins
    the next chunk. A block that alone reaches ``most`` is emitted and also begins the next chunk, so it comes
    twice; ``dedup_oversize`` drops the repetition. A rest under ``least`` characters is dropped.
    """
    start = F.struct(F.lit("").alias("held"), F.lit(0).alias("n"), F.expr(NONE).alias("out"))

    def step(s: Column, block: Column) -> Column:
        joined = F.when(s["n"] == 0, block["content"]).otherwise(F.concat(s["held"], F.lit("\n"), block["content"]))
        full = F.length(joined) >= most
        alone = s["n"] == 0
        restart = full & alone & F.lit(dedup_oversize)
        return F.struct(
            F.when(restart, "").when(full, block["content"]).otherwise(joined).alias("held"),
            F.when(restart, 0).when(full, 1).otherwise(s["n"] + 1).alias("n"),
            F.when(full, F.array_append(s["out"], F.when(alone, joined).otherwise(s["held"]))).otherwise(s["out"]).alias("out"),
        )

    folded = F.aggregate("items", start, step)
    rest = F.when((folded["n"] > 0) & (F.length(folded["held"]) >= least), F.array(folded["held"])).otherwise(F.expr(NONE))
    pages = _ordered(blocks, ["document_id", "page_number"], "block_idx", "content").select("document_id", "page_number", F.concat(folded["out"], rest).alias("out"))
    chunks = pages.select("document_id", "page_number", F.posexplode("out").alias("idx", "content"))
    named = F.concat_ws("_", F.lit("C"), "document_id", "page_number", "idx")
    return linked(chunks.select("document_id", "page_number", "idx", named.alias("chunk_id"), "content", F.lit("paragraph").alias("chunk_type")), ["page_number", "idx"])


def linked(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Chunks with their place in the document and the ids of their neighbours."""
    within = Window.partitionBy("document_id").orderBy(*order)
    return chunks.select("*", F.row_number().over(within).alias("seq"), F.lag("chunk_id").over(within).alias("previous_id"), F.lead("chunk_id").over(within).alias("next_id"))


def hierarchical(blocks: DataFrame, most: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    """Chunks by headings (``document_id, page_number, block_idx, content`` and optional style columns).

    Every heading is a chunk and ends the section before it. Within a section blocks gather until their summed
    length reaches ``most``; what is shorter than ``least`` once stripped is dropped. Sections run across pages.
    A chunk's parent is the last heading; a heading's is the first chunk with the heading text of its nearest
    ancestor that has one. Ids count the chunks of the document so far.
    """
    if "block_type" not in blocks.columns:
        from docweft.sources.documents import typed

        blocks = typed(blocks)
    size = F.col("font_size") if "font_size" in blocks.columns else F.lit(None).cast("double")
    bold = F.col("is_bold") if "is_bold" in blocks.columns else F.lit(False)
    level = text.heading_level(F.col("content"), F.col("block_type"), size, bold)
    order = Window.partitionBy("document_id").orderBy("page_number", "block_idx")
    rows = blocks.select("document_id", "page_number", "block_idx", "content", "block_type", level.alias("level")).withColumn("pos", F.row_number().over(order))
    section = F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("section", section)

    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("group"), F.array().cast("array<int>").alias("groups"))

    def step(s: Column, x: Column) -> Column:
        chars = s["chars"] + F.length(x["content"])
        full = chars >= most
        return F.struct(F.when(full, 0).otherwise(chars).alias("chars"), (s["group"] + full.cast("int")).alias("group"), F.array_append(s["groups"], s["group"]).alias("groups"))

    body = rows.filter("level IS NULL")
    sections = _ordered(body, ["document_id", "section"], "pos", "content", "page_number", "block_type").withColumn("groups", F.aggregate("items", start, step)["groups"])
    grouped = sections.select("document_id", "section", F.explode(F.arrays_zip("items", "groups")).alias("x")).select("document_id", "section", F.col("x.groups").alias("part"), "x.items.*")
    parts = _ordered(grouped, ["document_id", "section", "part"], "pos", "content", "page_number", "block_type")
    content = F.trim(F.array_join(F.transform("items", lambda x: x["content"]), "\n"))
    parts = parts.select(
        "document_id", "section", F.expr("items[0].pos").alias("pos"), content.alias("content"), F.expr("items[0].page_number").alias("page_number"),
        text.content_type(F.array_join(F.transform("items", lambda x: x["content"]), " "), F.exists("items", lambda x: x["block_type"] == "formula")).alias("chunk_type"),
        F.lit(None).cast("int").alias("level"),
    ).filter(F.length("content") >= least)
    heads = rows.filter("level IS NOT NULL").select(
        "document_id", "section", "pos", F.trim("content").alias("content"), "page_number",
        F.element_at(F.array(F.lit("chapter"), F.lit("section"), F.lit("subsection")), F.col("level")).alias("chunk_type"), "level",
    )
    chunks = parts.unionByName(heads)
    within = Window.partitionBy("document_id").orderBy("pos")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.withColumn("n", F.row_number().over(within) - 1)
    chunks = chunks.withColumn("chunk_id", F.concat_ws("_", F.when(F.col("level").isNotNull(), "H").otherwise("C"), "document_id", "page_number", "n"))
    # headings that are open at each chunk: the last of each level that no later heading of a higher rank has closed
    for k in (1, 2, 3):
        last = F.last(F.when(F.col("level") == k, F.struct("pos", "content")), ignorenulls=True).over(upto)
        chunks = chunks.withColumn(f"open{k}", last)
    shut = lambda k: F.col(f"open{k}.pos") > F.greatest(*[F.coalesce(F.col(f"open{j}.pos"), F.lit(0)) for j in range(1, k)], F.lit(0), F.lit(0))
    stack = F.filter(F.array(*[F.when(shut(k), F.col(f"open{k}.content")) for k in (1, 2, 3)]), lambda x: x.isNotNull())
    chunks = chunks.withColumn("section_hierarchy", stack)
    chunks = chunks.withColumn("heading", F.when(F.col("level").isNotNull(), F.col("content")).otherwise(F.try_element_at("section_hierarchy", F.lit(-1))))
    chunks = chunks.withColumn("body_parent", F.last(F.when(F.col("chunk_type").isin("chapter", "section", "subsection"), F.col("chunk_id")), ignorenulls=True).over(before))
    first = chunks.filter("heading IS NOT NULL").groupBy("document_id", F.col("heading").alias("ancestor")).agg(F.min_by("chunk_id", "pos").alias("ancestor_id"), F.min("pos").alias("ancestor_pos"))
    above = F.slice("section_hierarchy", F.lit(1), F.greatest(F.size("section_hierarchy") - 1, F.lit(0)))
    wanted = chunks.filter("level IS NOT NULL").select("document_id", "chunk_id", "pos", F.posexplode(above).alias("depth", "ancestor"))
    parents = wanted.join(first, ["document_id", "ancestor"]).filter("ancestor_pos < pos").groupBy("document_id", "chunk_id").agg(F.max_by("ancestor_id", "depth").alias("head_parent"))
    chunks = chunks.join(parents, ["document_id", "chunk_id"], "left")
    parent = F.when(F.col("level").isNotNull(), F.col("head_parent")).otherwise(F.col("body_parent"))
    out = chunks.select("document_id", "chunk_id", "page_number", "n", "chunk_type", "content", "heading", "section_hierarchy", parent.alias("parent_id"))
    return linked(out, ["n"])


def boundaries(vectors: DataFrame, key: str, order: str, threshold: float = SIMILARITY) -> DataFrame:
    """Neighbouring vectors with their cosine, and whether it is under the threshold."""
    within = Window.partitionBy(key).orderBy(order)
    pairs = vectors.withColumn("before", F.lag("embedding").over(within)).filter("before IS NOT NULL")
    return pairs.select(key, order, text.cosine(F.col("before"), F.col("embedding")).alias("similarity")).withColumn("is_boundary", F.col("similarity") < threshold)


def semantic(sentences: DataFrame, most: int = MAX_CHARS, least: int = MIN_CHARS, threshold: float = SIMILARITY) -> DataFrame:
    """Chunks by meaning (``document_id, page_number, sentence_idx, content, embedding``).

    A chunk ends after a sentence that is unlike the one before it, or when its joined length reaches ``most``;
    shorter ones than ``least`` are dropped.
    """
    within = Window.partitionBy("document_id").orderBy("sentence_idx")
    unlike = F.coalesce(text.cosine(F.lag("embedding").over(within), F.col("embedding")) < threshold, F.lit(False))
    rows = sentences.select("document_id", "page_number", "sentence_idx", "content", unlike.alias("ends"))
    empty = F.expr("cast(array() as array<struct<content: string, pages: array<int>>>)")
    start = F.struct(F.lit("").alias("held"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("pages"), empty.alias("out"))

    def emitted(s_out: Column, content: Column, pages: Column) -> Column:
        return F.when(F.length(content) >= least, F.array_append(s_out, F.struct(content.alias("content"), F.array_sort(F.array_distinct(pages)).alias("pages")))).otherwise(s_out)

    def step(s: Column, x: Column) -> Column:
        joined = F.when(s["n"] == 0, x["content"]).otherwise(F.concat(s["held"], F.lit(" "), x["content"]))
        pages = F.array_append(s["pages"], x["page_number"])
        ends = x["ends"] | (F.length(joined) >= most)
        return F.struct(
            F.when(ends, "").otherwise(joined).alias("held"),
            F.when(ends, 0).otherwise(s["n"] + 1).alias("n"),
            F.when(ends, F.array().cast("array<int>")).otherwise(pages).alias("pages"),
            F.when(ends, emitted(s["out"], joined, pages)).otherwise(s["out"]).alias("out"),
        )

    documents = _ordered(rows, ["document_id"], "sentence_idx", "content", "page_number", "ends").withColumn("s", F.aggregate("items", start, step))
    done = F.when(F.col("s.n") > 0, emitted(F.col("s.out"), F.col("s.held"), F.col("s.pages"))).otherwise(F.col("s.out"))
    chunks = documents.select("document_id", F.posexplode(done).alias("idx", "c"))
    named = F.concat_ws("_", F.lit("SC"), "document_id", "idx")
    return linked(chunks.select("document_id", "idx", named.alias("chunk_id"), F.col("c.content"), F.col("c.pages").alias("page_numbers"), F.lit("paragraph").alias("chunk_type")), ["idx"])


def chunk(blocks: DataFrame, strategy: str = "hierarchical", **options) -> DataFrame:
    """Chunks by ``hierarchical`` or ``fixed`` cutting."""
    return {"hierarchical": hierarchical, "fixed": fixed}[strategy](blocks, **options)


def children(chunks: DataFrame) -> DataFrame:
    """Each parent with its children in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"])
    return chunks.filter("parent_id IS NOT NULL").groupBy("document_id", "parent_id").agg(ordered.alias("children"))


def ancestors(chunks: DataFrame, depth: int = 3) -> DataFrame:
    """Each chunk with each of its ancestors and how far up they are; headings nest at most three deep."""
    up = chunks.filter("parent_id IS NOT NULL").select("document_id", "chunk_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"))
    edges = up.select("document_id", F.col("chunk_id").alias("ancestor_id"), F.col("ancestor_id").alias("next_id"))
    found = level = up
    for k in range(2, depth + 1):
        level = level.join(edges, ["document_id", "ancestor_id"]).select("document_id", "chunk_id", F.col("next_id").alias("ancestor_id"), F.lit(k).alias("distance"))
        found = found.unionByName(level)
    return found


def descendants(chunks: DataFrame, depth: int = 3) -> DataFrame:
    """Each chunk with each chunk below it and how far down that is."""
    return ancestors(chunks, depth).select("document_id", F.col("ancestor_id").alias("chunk_id"), F.col("chunk_id").alias("descendant_id"), "distance")


def placed(chunks: DataFrame, depth: int = 3) -> DataFrame:
    """Each chunk with its depth and its full context: the contents of its ancestors, topmost first, and its own."""
    above = ancestors(chunks, depth).join(chunks.select("document_id", F.col("chunk_id").alias("ancestor_id"), F.col("content").alias("said")), ["document_id", "ancestor_id"])
    told = above.groupBy("document_id", "chunk_id").agg(F.max("distance").alias("depth"), F.transform(F.sort_array(F.collect_list(F.struct("distance", "said")), asc=False), lambda x: x["said"]).alias("said"))
    joined = chunks.select("document_id", "chunk_id", "content").join(told, ["document_id", "chunk_id"], "left")
    every = F.concat(F.coalesce("said", F.expr(NONE)), F.array("content"))
    return joined.select("document_id", "chunk_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.array_join(every, "\n\n").alias("full_context"))


def context_window(chunks: DataFrame, width: int = 2) -> DataFrame:
    """Each chunk with the ids of the chunks from ``width`` before to ``width`` after it."""
    around = Window.partitionBy("document_id").orderBy("seq").rowsBetween(-width, width)
    return chunks.select("document_id", "chunk_id", "seq", F.collect_list("chunk_id").over(around).alias("window_ids"))


def classify(chunks: DataFrame) -> DataFrame:
    """Chunks with their type by content, domain, difficulty and concepts."""
    out = chunks.withColumn("chunk_type", text.chunk_type(F.col("content"), F.col("chunk_type")))
    out = out.withColumn("domain", text.domain(F.col("content"))).withColumn("difficulty", text.difficulty(F.col("content")))
    return out.withColumn("concepts", text.concepts(F.col("content"), F.col("domain")))


def flags(chunks: DataFrame) -> DataFrame:
    """Keywords, definition, theorem and example flags, and counts."""
    low = F.lower("content")
    from docweft.functions import rules

    return chunks.select(
        "chunk_id",
        text.chunk_keywords(F.col("content")).alias("keywords"),
        low.rlike(rules.word("def(?:ine|inition)")).alias("is_definition"),
        low.rlike(rules.word("theorem|lemma")).alias("is_theorem"),
        low.rlike(rules.word("example")).alias("is_example"),
        F.length("content").alias("char_count"),
        F.size(text.words(F.col("content"))).alias("word_count"),
    )
