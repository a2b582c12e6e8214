"""Tables that the registered queries share, derived from the given ones, as DataFrames and as SQL.

The given documents have no typography, formulas or sections, so these are derived from the texts and positions by
plain rules: sizes and weights from the place of a line, formulas from the first words of each passage.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import latex as L
from docweft.functions import rules, text
from docweft.operators import block_index, keyword_index, term_index, vector_graph, vector_lists
from docweft.operators.storage import listed, written
from docweft.plans import query as Q
from docweft.sources import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LINES_PER_CHUNK = 10
TYPES = ("definition", "theorem", "proof", "example", "exercise", "paragraph", "chapter", "section", "subsection")
#: Formulas of one passage; a, b and c stand for the first letters of its first words.
TEMPLATES = (
    r"\frac{d<a>}{d<b>} = <c>^2",
    r"\int_0^1 <a>(<b>) dx = \pi",
    r"\lim_{<a> \to \infty} <b>_n",
    r"\sum_{i} <a>_i \cdot <b>",
    r"\prod <a> \times <b> != <c>",
    r"\begin{pmatrix} <a> & <b> \end{pmatrix}",
    r"\ce{<a>2 -> <b>O}",
    r"<a> = <b> + <c>",
    r"<a> \leq <b>_{<c>}",
    r"\nabla \cdot \vec{<a>} = \alpha \sin(<b>)",
    r"{<a>}  \left( <b> \right)\, \sqrt{<c>}",
    r"Var(<a>) = \sigma^2 <b> }",
)
#: What users' turns begin with when they are taken as queries.
OPENINGS = ("What is the ", "Explain ", "how to derive ", "give me an example of ", "Formula for ", "prove ", "Difference between ", "Apply ", "Draw a graph of ", "calculate ", "", "Newton's law of energy and  force ", "E = mc^2 in ", "$x$ and momentum of ", "the mean sample ")
ENDINGS = ("?", ".,", " ;:", "", "!")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def registered(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# SQL of rules


def sql_any(x: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(m)})" for m in marks) + ")"


def sql_count(x: str, marks: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({x}, {quoted(m)})::INTEGER" for m in marks) + ")"


def sql_first(x: str, patterns: tuple[tuple[str, str], ...], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {quoted(p)}) THEN {quoted(n)}" for n, p in patterns) + f" ELSE {otherwise} END"


def sql_arg_max(scores: dict[str, str], otherwise: str) -> str:
    best = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {best} = 0 THEN {otherwise} " + " ".join(f"WHEN {s} = {best} THEN {quoted(n)}" for n, s in scores.items()) + " END"


def sql_replaced(x: str, steps: tuple[tuple[str, str], ...]) -> str:
    for pattern, replacement in steps:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(replacement.replace('<', chr(92)).replace('>', ''))}, 'g')"
    return x


def sql_terms(x: str) -> str:
    """The index terms of a text."""
    tokens = f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
    stop = "[" + ", ".join(map(quoted, rules.INDEX_STOPWORDS)) + "]"
    single = f"list_filter(list_transform(ws, lambda w: trim(w, '-')), lambda w: length(w) > 2 AND NOT list_contains({stop}, w))"
    pairs = f"list_transform(list_filter(range(1, len(ws)), lambda i: NOT list_contains({stop}, ws[i]) AND NOT list_contains({stop}, ws[i + 1])), lambda i: ws[i] || '_' || ws[i + 1])"
    return f"(SELECT list_distinct(list_concat({single}, {pairs})) FROM (SELECT {tokens} AS ws))"


def sql_capitals(x: str) -> str:
    """Capitalised phrases between word edges: separators are doubled, so that each match can take one on each side."""
    doubled = f"regexp_replace({x}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    found = f"regexp_extract_all({doubled}, {quoted(rules.EDGE_LEFT + rules.CAPITALISED + rules.EDGE_RIGHT)}, 1)"
    return f"list_transform({found}, lambda p: replace(replace(p, '  ', ' '), chr(10) || chr(10), chr(10)))"


SQL_BLOCKS = """blocks AS (
  SELECT doc_id, CAST(1 + (i - 1) // 40 AS INTEGER) AS page_number, CAST(i - 1 AS INTEGER) AS block_idx, content
  FROM (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)))"""
SQL_STYLED = SQL_BLOCKS + """,
styled AS (SELECT *, CAST(12 + (doc_id + block_idx) % 8 AS DOUBLE) AS font_size, (doc_id + 3 * block_idx) % 4 = 0 AS is_bold,
  CAST(50 + 60 * (block_idx % 3) AS DOUBLE) AS x0, CAST(20 * (block_idx % 40) AS DOUBLE) AS y0,
  CAST(50 + 60 * (block_idx % 3) + least(length(content), 90) AS DOUBLE) AS x1, CAST(20 * (block_idx % 40) + 10 + length(content) % 25 AS DOUBLE) AS y1 FROM blocks)"""
SQL_CHUNKS = """chunks AS (
  SELECT doc_id, k AS idx, k + 1 AS seq, CAST(1 + k * 10 // 40 AS INTEGER) AS page_number,
         'C_' || doc_id || '_' || (1 + k * 10 // 40) || '_' || k AS chunk_id,
         array_to_string(l[k * 10 + 1 : k * 10 + 10], chr(10)) AS content,
         CASE WHEN length(trim(l[k * 10 + 1])) <= 60 THEN trim(l[k * 10 + 1]) END AS heading, 'S' || doc_id % 7 || '.' || k // 4 AS section
  FROM (SELECT doc_id, l, unnest(range(0, (len(l) + 9) // 10)) AS k
        FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)))"""
SQL_TYPED = SQL_CHUNKS + f""",
typed AS (SELECT *, [{", ".join(map(quoted, TYPES))}][1 + (doc_id + idx) % {len(TYPES)}] AS chunk_type,
  {sql_arg_max({d: sql_count("lower(content)", w) for d, w in rules.DOMAIN_KEYWORDS.items()}, "'general'")} AS domain FROM chunks)"""


def sql_concepts(content: str, domain: str) -> str:
    named = f"regexp_extract_all(lower({content}), {quoted(rules.NAMED_LAW)}, 1)"
    words = " ".join(f"WHEN {quoted(d)} THEN [{', '.join(map(quoted, w))}]" for d, w in rules.DOMAIN_KEYWORDS.items())
    keywords = f"list_filter(CASE {domain} {words} ELSE [] END, lambda w: contains(lower({content}), w))"
    people = f"list_filter([{', '.join(map(quoted, rules.CONCEPT_SCIENTISTS))}], lambda w: contains(lower({content}), lower(w)))"
    return f"list_sort(list_distinct(list_concat({named}, {keywords}, {people})))[1:10]"


SQL_CONCEPTS = SQL_TYPED + f""",
known AS (SELECT *, {sql_concepts("content", "domain")} AS concepts FROM typed)"""


def _sql_template(t: str) -> str:
    out = quoted(t)
    for letter in "abc":
        out = f"replace({out}, '<{letter}>', {letter})"
    return out


SQL_RAW_FORMULAS = SQL_CHUNKS + f""",
letters AS (SELECT doc_id, idx, page_number, chunk_id, seq, content, coalesce(substr(w[1], 1, 1), 'x') AS a, coalesce(substr(w[2], 1, 1), 'x') AS b, coalesce(substr(w[3], 1, 1), 'x') AS c
  FROM (SELECT *, regexp_extract_all(content, '[A-Za-z]{{2,}}') AS w FROM chunks)),
raw AS (SELECT doc_id, page_number AS source_page, idx, chunk_id, CASE (doc_id + idx) % {len(TEMPLATES)} {" ".join(f"WHEN {i} THEN {_sql_template(t)}" for i, t in enumerate(TEMPLATES))} END AS latex FROM letters)"""
_SQL_OPS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(latex, {quoted(p)}) THEN {quoted(n)} END" for n, p in rules.OPERATORS) + "], lambda x: x IS NOT NULL)"
_SQL_FUNCTIONS = "list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(latex, {quoted(p)}, 1)" for p in rules.FUNCTIONS) + ")))"
_SQL_KIND = "CASE " + " ".join(f"WHEN regexp_matches(latex, {quoted(f)})" + (f" AND NOT regexp_matches(latex, {quoted(a)})" if a else "") + f" THEN {quoted(n)}" for n, f, a in rules.FORMULA_TYPES) + " ELSE 'unknown' END"
_SQL_DOMAIN = "CASE " + " ".join(f"WHEN {sql_any('latex', m)} THEN {quoted(n)}" for n, m in rules.FORMULA_DOMAINS) + " ELSE 'general' END"
_SQL_PLAIN = f"trim({sql_replaced('latex', rules.PLAIN_TEXT)})"
SQL_FORMULAS = SQL_RAW_FORMULAS + f""",
formulas AS (SELECT *, 'F_' || substr(md5(latex), 1, 8) AS formula_id, {_SQL_OPS} AS operators, {_SQL_FUNCTIONS} AS functions,
  {_SQL_KIND} AS kind, {_SQL_DOMAIN} AS domain, {_SQL_PLAIN} AS plain_text, {sql_replaced("trim(latex)", rules.NORMAL_STEPS)} AS normal_form,
  list_sort(list_distinct([a, b, c])) AS variables FROM (SELECT raw.*, a, b, c FROM raw JOIN letters USING (doc_id, idx)))"""
SQL_QUERIES = f"""asked AS (SELECT conv_id || '_' || turn AS query_id, conv_id, turn,
  [{", ".join(map(quoted, OPENINGS))}][1 + (conv_id + turn) % {len(OPENINGS)}] || text || [{", ".join(map(quoted, ENDINGS))}][1 + conv_id % {len(ENDINGS)}] AS text
  FROM conversations WHERE role = 'user'),
cleaned AS (SELECT query_id, conv_id, text AS raw_text, CASE WHEN regexp_matches(t, '[?.!]$') THEN t ELSE regexp_replace(t, '[.,;:]+$', '') END AS q
  FROM (SELECT *, regexp_replace(trim(text), '\\s+', ' ', 'g') AS t FROM asked))"""
SQL_TERMS = f"terms AS (SELECT doc_id, {sql_terms('coalesce(text, chr(32))')} AS terms FROM documents)"
SQL_POSTINGS = SQL_TERMS + ", postings AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM terms)"


#: What has been written for the tables of one folder in one session: an index is built once and serves all queries, as
#: long as the names, sizes and times of the files that it was built from are the same.
_WRITTEN: dict[tuple[str, str, str], tuple[str, Any]] = {}


class Tables:
    """The given tables of one scale and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def once(self, name: str, make: Callable[[], Any], source: str = "documents") -> Any:
        key, files = (self.spark.sparkContext.applicationId, self.sf_dir, name), listed(self.spark, f"{self.sf_dir}/{source}.parquet")
        held = _WRITTEN.get(key)
        if held is None or held[0] != files:
            _WRITTEN[key] = held = (files, make())
        return held[1]

    def index(self) -> keyword_index.Index:
        """The keyword index of the documents."""
        return self.once("keyword-index", lambda: keyword_index.build(self.terms(), "doc_id"))

    def block_index(self) -> block_index.Blocks:
        """That index in blocks."""
        return self.once("block-index", lambda: block_index.build(self.index()))

    def term_index(self) -> term_index.Terms:
        """The vocabulary of the documents, whose forms and segments are made as it is read."""
        return self.once("term-index", lambda: term_index.over(written(self.index().stored.select("term").distinct(), "terms", "zstd")))

    def chunk_index(self) -> keyword_index.Index:
        """The keyword index of the chunks."""
        return self.once("chunk-index", lambda: keyword_index.build(keyword_index.terms(self.chunks(), "chunk_id", "content"), "chunk_id"))

    def vector_lists(self) -> vector_lists.Lists:
        return self.once("vector-lists", lambda: vector_lists.build(self.vectors(), "vec_id"), "embeddings")

    def vector_graph(self) -> vector_graph.Graph:
        return self.once("vector-graph", lambda: vector_graph.build(self.vectors(), "vec_id"), "embeddings")

    def known(self) -> DataFrame:
        """``typed`` chunks, written."""
        return self.once("typed-chunks", lambda: written(self.typed(), "typed-chunks"))

    def stored_formulas(self) -> DataFrame:
        """``formulas`` without the passages that they come from, written."""
        return self.once("formulas", lambda: written(self.formulas().drop("content", "heading", "section_hierarchy", "page_numbers"), "formulas"))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def blocks(self) -> DataFrame:
        return documents.line_blocks(self.read("documents")).withColumn("document_id", F.col("doc_id").cast("string"))

    def styled(self) -> DataFrame:
        i, d, n = F.col("block_idx"), F.col("doc_id"), F.length("content")
        x, y = 50 + 60 * (i % 3), 20 * (i % 40)
        styled = self.blocks().withColumns({"font_size": (12 + (d + i) % 8).cast("double"), "is_bold": (d + 3 * i) % 4 == 0})
        return styled.withColumns({"x0": x.cast("double"), "y0": y.cast("double"), "x1": (x + F.least(n, F.lit(90))).cast("double"), "y1": (y + 10 + n % 25).cast("double")})

    def chunks(self) -> DataFrame:
        lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
        docs = self.read("documents").select("doc_id", lines.alias("l")).filter(F.size("l") > 0)
        each = docs.select("doc_id", "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / LINES_PER_CHUNK).cast("int"))).alias("idx"))
        page = (1 + F.floor(F.col("idx") * LINES_PER_CHUNK / documents.LINES_PER_PAGE)).cast("int")
        first = F.trim(F.element_at("l", F.col("idx") * LINES_PER_CHUNK + 1))
        return each.select(
            "doc_id", F.col("doc_id").cast("string").alias("document_id"), "idx", (F.col("idx") + 1).alias("seq"), page.alias("page_number"), F.array(page).alias("page_numbers"),
            F.concat_ws("_", F.lit("C"), F.col("doc_id"), page, F.col("idx")).alias("chunk_id"),
            F.array_join(F.slice("l", F.col("idx") * LINES_PER_CHUNK + 1, LINES_PER_CHUNK), "\n").alias("content"),
            F.when(F.length(first) <= 60, first).alias("heading"),
            F.array(F.concat(F.lit("S"), (F.col("doc_id") % 7).cast("string"), F.lit("."), F.floor(F.col("idx") / 4).cast("string"))).alias("section_hierarchy"),
        )

    def typed(self) -> DataFrame:
        kind = F.element_at(F.array(*map(F.lit, TYPES)), (1 + (F.col("doc_id") + F.col("idx")) % len(TYPES)).cast("int"))
        out = self.chunks().withColumns({"chunk_type": kind, "domain": text.domain(F.col("content"))})
        return out.withColumn("concepts", text.concepts(F.col("content"), F.col("domain")))

    def raw_formulas(self) -> DataFrame:
        words = F.regexp_extract_all("content", F.lit("[A-Za-z]{2,}"), F.lit(0))
        letter = lambda n: F.coalesce(F.substring(F.try_element_at(F.col("w"), F.lit(n)), 1, 1), F.lit("x"))
        rows = self.chunks().withColumn("w", words).withColumns({"a": letter(1), "b": letter(2), "c": letter(3)}).drop("w")

        def filled(t: str) -> Column:
            out = F.lit(t)
            for x in "abc":
                out = F.replace(out, F.lit(f"<{x}>"), F.col(x))
            return out

        chain = F
        for i, t in enumerate(TEMPLATES):
            chain = chain.when((F.col("doc_id") + F.col("idx")) % len(TEMPLATES) == i, filled(t))
        return rows.withColumn("latex", chain).withColumn("source_page", F.col("page_number"))

    def formulas(self) -> DataFrame:
        x = F.col("latex")
        out = self.raw_formulas().withColumns({"formula_id": L.formula_id(x), "operators": L.operators(x), "functions": L.function_names(x), "kind": L.kind(x), "formula_type": L.stored_kind(x), "domain": L.domain(x), "plain_text": L.plain_text(x), "normal_form": L.normalize(x)})
        return out.withColumn("variables", F.array_sort(F.array_distinct(F.array("a", "b", "c"))))

    def asked(self) -> DataFrame:
        turns = self.read("conversations").filter("role = 'user'")
        pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (1 + n % len(words)).cast("int"))
        opening, ending = pick(OPENINGS, F.col("conv_id") + F.col("turn")), pick(ENDINGS, F.col("conv_id"))
        return turns.select(F.concat_ws("_", "conv_id", "turn").alias("query_id"), "conv_id", F.concat(opening, "text", ending).alias("text"))

    def processed(self) -> DataFrame:
        return Q.process(self.asked())

    def terms(self) -> DataFrame:
        return keyword_index.terms(self.read("documents"), "doc_id")

    def vectors(self) -> DataFrame:
        return self.read("embeddings")

    def vector_queries(self) -> DataFrame:
        """Every vector whose id is divisible by 20, searched against all."""
        return self.read("embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
