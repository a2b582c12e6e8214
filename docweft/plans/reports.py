"""Reports over chunks and formulas: statistics, indices, handbooks, cards and chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions import text

LEVELS = {"chapter": 1, "section": 2, "subsection": 3}


def statistics(chunks: DataFrame, formulas: DataFrame) -> DataFrame:
    """``metric``, ``key``, ``value``: counts by type and domain, totals and the mean length."""
    counted = lambda rows, metric, column: rows.groupBy(F.coalesce(F.col(column), F.lit("general")).alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(metric).alias("metric"), "key", "value")
    single = lambda rows, metric, value: rows.agg(value.cast("double").alias("value")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), F.round(F.coalesce("value", F.lit(0.0)), 6).alias("value"))
    parts = [counted(chunks, "chunk_types", "chunk_type"), counted(chunks, "domains", "domain"), counted(formulas, "formula_domains", "domain")]
    parts += [single(chunks, "total_chunks", F.count("*")), single(chunks, "avg_chunk_length", F.avg(F.length("content"))), single(formulas, "total_formulas", F.countDistinct("formula_id"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def metadata_report(statistics: DataFrame) -> DataFrame:
    """``statistics`` as lines of text, totals first."""
    name = F.replace("metric", F.lit("_"), F.lit(" "))
    line = F.concat(F.lit("- **"), name, F.when(F.col("key") != "", F.concat(F.lit(" ("), "key", F.lit(")"))).otherwise(""), F.lit("**: "), F.format_string("%.2f", "value"))
    return statistics.select("metric", "key", (F.col("key") == "").alias("is_total"), line.alias("line"))


def extraction_counts(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Pages, text blocks and images of each document."""
    texts = blocks.groupBy("document_id").agg(F.max("page_number").alias("n_pages"), F.count("*").alias("n_blocks"))
    drawn = images.groupBy("document_id").agg(F.count("*").alias("n_images"))
    return texts.join(drawn, "document_id", "left").withColumn("n_images", F.coalesce("n_images", F.lit(0)))


def table_of_contents(chunks: DataFrame) -> DataFrame:
    """A line for each heading of a document, indented by its level."""
    level = F.when(F.col("chunk_type") == "chapter", 1).when(F.col("chunk_type") == "section", 2).otherwise(3)
    heads = chunks.filter(F.col("chunk_type").isin(*LEVELS) & (F.coalesce("heading", F.lit("")) != ""))
    line = F.concat(F.repeat(F.lit("  "), level - 1), F.lit("- **"), "heading", F.lit("** (Page "), F.coalesce(F.col("page_number").cast("string"), F.lit("?")), F.lit(")"))
    order = Window.partitionBy("document_id").orderBy("seq")
    return heads.select("document_id", F.row_number().over(order).alias("line_no"), line.alias("line"))


def concept_index(chunks: DataFrame) -> DataFrame:
    """Each concept with its pages (the first five, and how many more) and its number of chunks."""
    each = chunks.select("page_number", "chunk_id", F.explode("concepts").alias("concept"))
    # one row for each concept and page, then a list of pages: bounded by the pages of the collection's longest document
    pages = each.groupBy("concept", "page_number").agg(F.count("*").alias("n"))
    grouped = pages.groupBy("concept").agg(F.array_sort(F.collect_list("page_number")).alias("pages"), F.sum("n").alias("n_chunks"))
    shown = F.array_join(F.transform(F.slice("pages", 1, 5), lambda p: p.cast("string")), ", ")
    more = F.when(F.size("pages") > 5, F.concat(F.lit(" (and "), (F.size("pages") - 5).cast("string"), F.lit(" more)"))).otherwise("")
    return grouped.select("concept", "n_chunks", F.concat(F.lit("- **"), "concept", F.lit("**: Pages "), shown, more).alias("line"))


def formula_handbook(formulas: DataFrame) -> DataFrame:
    """An entry for each formula of a document, by domain."""
    entry = F.concat(
        F.lit("### "), "formula_id", F.lit("\n\n$$\n"), "latex", F.lit("\n$$\n\n"),
        F.when(F.coalesce("plain_text", F.lit("")) != "", F.concat(F.lit("*"), "plain_text", F.lit("*\n\n"))).otherwise(""),
        F.lit("- **Type:** "), "formula_type", F.lit("\n- **Page:** "), F.coalesce(F.col("source_page").cast("string"), F.lit("?")),
        F.when(F.size("variables") > 0, F.concat(F.lit("\n- **Variables:** "), F.array_join("variables", ", "))).otherwise(""),
    )
    order = Window.partitionBy("document_id", F.coalesce("domain", F.lit("general"))).orderBy("formula_id", "source_page")
    return formulas.select("document_id", F.coalesce("domain", F.lit("general")).alias("domain"), F.row_number().over(order).alias("entry_no"), entry.alias("entry"))


def searchable_index(chunks: DataFrame, formulas: DataFrame) -> DataFrame:
    """Chunks and formulas as entries of one kind of table."""
    a = chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("type"), F.substring("content", 1, 200).alias("preview"), F.col("page_number").alias("page"), "domain", F.array_join("concepts", ",").alias("terms"))
    b = formulas.select(F.col("formula_id").alias("id"), F.lit("formula").alias("type"), F.col("latex").alias("preview"), F.col("source_page").alias("page"), "domain", F.array_join("variables", ",").alias("terms"))
    return a.unionByName(b)


def quick_reference(formulas: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` formulas by domain and id."""
    unique = formulas.groupBy("formula_id").agg(F.min(F.struct("domain", "latex", "plain_text")).alias("x")).select("formula_id", "x.*")
    line = F.concat(F.lit("- $"), "latex", F.lit("$"), F.when(F.coalesce("plain_text", F.lit("")) != "", F.concat(F.lit("\n  *"), "plain_text", F.lit("*"))).otherwise(""))
    return unique.orderBy(F.coalesce("domain", F.lit("z")), "formula_id").limit(n).select("formula_id", "domain", line.alias("line"))


def chapter_summaries(chunks: DataFrame) -> DataFrame:
    """Chapters with the first 300 characters of their content."""
    return chunks.filter("chunk_type = 'chapter'").select("document_id", F.coalesce("heading", F.lit("Unknown Chapter")).alias("heading"), text.preview(F.col("content"), 300).alias("summary"))


def difficulty_of(card: str, seed: str = "docweft"):
    """A level that follows from the card's id and a seed, where an author would draw one."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(card))), 1, 4), 16, 10).cast("int") % 3
    return F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), at + 1)


def flashcards(chunks: DataFrame, formulas: DataFrame, count: int = 10, seed: str = "docweft") -> DataFrame:
    """Cards of each document: up to ``count / 2`` formulas and as many stated concepts with a heading, mixed by hash."""
    order = lambda key: Window.partitionBy("document_id").orderBy(key)
    first = formulas.select("document_id", "formula_id", "latex", "plain_text", "domain").distinct().withColumn("n", F.row_number().over(order("formula_id"))).filter(F.col("n") <= count // 2)
    a = first.select("document_id", F.concat(F.lit("fc_"), "formula_id").alias("card_id"), F.lit("formula").alias("type"), F.concat(F.lit("What is the formula for: "), F.coalesce("plain_text", F.lit("this concept")), F.lit("?")).alias("front"), F.concat(F.lit("$$"), "latex", F.lit("$$")).alias("back"), "domain")
    stated = chunks.filter(F.col("chunk_type").isin("definition", "theorem", "concept")).withColumn("n", F.row_number().over(order("seq"))).filter(F.col("n") <= count // 2)
    stated = stated.filter(F.coalesce("heading", F.lit("")) != "")
    b = stated.select("document_id", F.concat(F.lit("fc_"), "chunk_id").alias("card_id"), F.lit("concept").alias("type"), F.concat(F.lit("Define or explain: "), "heading").alias("front"), text.preview(F.col("content"), 300).alias("back"), "domain")
    mixed = Window.partitionBy("document_id").orderBy(F.md5(F.concat(F.lit(seed), "card_id")), "card_id")
    cards = a.unionByName(b).withColumn("difficulty", difficulty_of("card_id", seed)).withColumn("position", F.row_number().over(mixed))
    return cards.filter(F.col("position") <= count)


def choices(formulas: DataFrame, count: int = 10, seed: str = "docweft") -> DataFrame:
    """Questions with one right formula and up to three of the document's first eleven others, mixed by hash.

    The eleven stand in a ring, in order of a hash; the wrong answers of each are the three after it.
    """
    unique = formulas.groupBy("document_id", "formula_id").agg(F.min(F.struct("source_page", "latex", "plain_text")).alias("x")).select("document_id", "formula_id", "x.latex", "x.plain_text")
    order = Window.partitionBy("document_id").orderBy("formula_id")
    listed = unique.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= 11).withColumn("h", F.md5(F.concat(F.lit(seed), "formula_id")))
    ring = Window.partitionBy("document_id").orderBy("h", "formula_id")
    ahead = [F.lead("latex", i).over(ring) for i in (1, 2, 3)]
    begin = [F.nth_value("latex", i).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for i in (1, 2, 3)]
    size, place = F.count("*").over(Window.partitionBy("document_id")), F.row_number().over(ring)
    placed = listed.withColumns({"size": size, "place": place, **{f"a{i}": c for i, c in enumerate(ahead, 1)}, **{f"b{i}": c for i, c in enumerate(begin, 1)}})

    def after(i: int) -> Column:
        """The i-th after a formula, round the ring, as far as there are so many others."""
        wrapped = F.col("place") + i - F.col("size")
        return F.when(F.lit(i) < F.col("size"), F.coalesce(f"a{i}", F.when(wrapped == 1, F.col("b1")).when(wrapped == 2, F.col("b2")).when(wrapped == 3, F.col("b3"))))

    options = F.array_sort(F.array_distinct(F.filter(F.array("latex", after(1), after(2), after(3)), lambda x: x.isNotNull())))
    question = F.concat(F.lit("Which formula represents "), F.coalesce("plain_text", F.lit("this concept")), F.lit("?"))
    asked = placed.filter(F.col("n") <= count // 2)
    return asked.select("document_id", F.concat(F.lit("mcq_"), "formula_id").alias("question_id"), question.alias("question"), F.array_join(options, " | ").alias("options"), (F.array_position(options, F.col("latex")) - 1).alias("correct"))


def chat_history(turns: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    last = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("back", F.row_number().over(last)).filter(F.col("back") <= n)


def chat_answers(chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """For each message (``message_id``, ``message``) the chunk with the most of its words of over three letters.

    Distinct words meet the distinct words of chunks that contain them; chunks are then scored by their words.
    """
    asked = messages.select("message_id", F.explode(F.filter(text.words(F.lower("message")), lambda w: F.length(w) > 3)).alias("word"))
    weights = asked.groupBy("message_id", "word").agg(F.count("*").alias("n"))
    tokens = chunks.select("chunk_id", "content", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"[^\s]+"), F.lit(0)))).alias("token"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.substring(c, i, F.lit(4))))
    vocabulary = tokens.select("token").distinct().select("token", F.explode(grams(F.col("token"))).alias("gram"))
    wanted = weights.select("word").distinct().select("word", F.substring("word", 1, 4).alias("gram"))
    inside = vocabulary.join(wanted, "gram").filter(F.contains("token", "word")).select("token", "word").distinct()
    found = tokens.select("chunk_id", "token").join(inside, "token").select("chunk_id", "word").distinct()
    scored = found.join(weights, "word").groupBy("message_id", "chunk_id").agg(F.sum("n").alias("score"))
    best = Window.partitionBy("message_id").orderBy(F.col("score").desc(), "chunk_id")
    top = scored.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return top.join(chunks.select("chunk_id", F.substring("content", 1, 400).alias("shown")), "chunk_id").select("message_id", "chunk_id", "score", F.concat(F.lit("Based on the document:\n\n"), "shown").alias("response"))


def graph_edges(chunks: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges of the chunk graph: to parents and along relations."""
    parents = chunks.filter("parent_id IS NOT NULL").select("document_id", F.col("parent_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("parent").alias("kind"))
    return parents.unionByName(relations.select("document_id", "src", "dst", "kind"))


def prompt(context: DataFrame, queries: DataFrame) -> DataFrame:
    """What a language model is asked: the intent's instruction, the question and its context."""
    from docweft.plans.context import instruction

    joined = queries.join(context, "query_id", "left")
    return joined.select("query_id", F.concat_ws("\n\n", instruction(F.col("intent")), F.concat(F.lit("Question: "), "raw_text"), F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")))).alias("prompt"))
