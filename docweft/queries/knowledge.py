"""Queries over formulas, relations, graphs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.functions import latex as L
from docweft.functions import rules
from docweft.operators import formulas as ops
from docweft.operators import relations
from docweft.plans import reports, search, summaries
from docweft.queries.base import SQL_CHUNKS, SQL_CONCEPTS, SQL_FORMULAS, SQL_RAW_FORMULAS, SQL_TYPED, Tables, quoted, registered, sql_terms

# Formulas


@registered("latex_normalize", f"WITH {SQL_FORMULAS} SELECT chunk_id, normal_form FROM formulas")
def latex_normalize(t: Tables) -> DataFrame:
    return t.formulas().select("chunk_id", "normal_form")


@registered("latex_short_normal", f"WITH {SQL_FORMULAS} SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(trim(latex), '\\s+', ' ', 'g'), '\\\\left|\\\\right', '', 'g'), '\\{{([^{{}}])\\}}', '\\1', 'g') AS normal_form FROM formulas")
def latex_short_normal(t: Tables) -> DataFrame:
    return t.raw_formulas().select("chunk_id", L.short_normal(F.col("latex")).alias("normal_form"))


@registered("latex_plain_text", f"WITH {SQL_FORMULAS} SELECT chunk_id, plain_text FROM formulas")
def latex_plain_text(t: Tables) -> DataFrame:
    return t.formulas().select("chunk_id", "plain_text")


#: Commands, letters with a subscript and runs of letters, of which the first counts: what the pattern that looks behind finds.
_SQL_VARIABLES = r"""list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(latex, '\\[a-zA-Z]+|[a-zA-Z]_\{?[a-zA-Z0-9]+\}?|[a-zA-Z]+'), lambda x: x[1] <> '\'),
  lambda x: CASE WHEN contains(x, '_') THEN x ELSE x[1] END)))"""


@registered("latex_variables", f"WITH {SQL_RAW_FORMULAS} SELECT chunk_id, array_to_string({_SQL_VARIABLES}, ',') AS variables FROM raw")
def latex_variables(t: Tables) -> DataFrame:
    return t.raw_formulas().select("chunk_id", F.array_join(L.variables(F.col("latex")), ",").alias("variables"))


@registered("latex_operators", f"WITH {SQL_FORMULAS} SELECT chunk_id, array_to_string(operators, ',') AS operators FROM formulas")
def latex_operators(t: Tables) -> DataFrame:
    return t.formulas().select("chunk_id", F.array_join("operators", ",").alias("operators"))


@registered("latex_functions", f"WITH {SQL_FORMULAS} SELECT chunk_id, array_to_string(functions, ',') AS functions, array_to_string(list_concat(list_sort(operators), functions), ':') AS signature FROM formulas")
def latex_functions(t: Tables) -> DataFrame:
    return t.formulas().select("chunk_id", F.array_join("functions", ",").alias("functions"), L.signature(F.col("operators"), F.col("functions")).alias("signature"))


def _plain(pattern: str) -> str:
    """A pattern without lookaround, which finds the same in a text if only finding counts."""
    for look, plain in (("(?<![a-zA-Z])", "(?:^|[^a-zA-Z])"), ("(?![a-zA-Z])", "(?:[^a-zA-Z]|$)"), ("(?<!\\\\)", "(?:^|[^\\\\])")):
        pattern = pattern.replace(look, plain)
    return pattern


_CONSTANTS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(latex, {quoted(_plain(p))}) THEN {quoted(n)} END" for n, p in rules.CONSTANTS) + "], lambda x: x IS NOT NULL)"


@registered("latex_constants", f"WITH {SQL_FORMULAS} SELECT chunk_id, array_to_string({_CONSTANTS}, ',') AS constants FROM formulas")
def latex_constants(t: Tables) -> DataFrame:
    return t.raw_formulas().select("chunk_id", F.array_join(L.constants(F.col("latex")), ",").alias("constants"))


@registered(
    "latex_valid",
    f"""WITH {SQL_FORMULAS}, b AS (SELECT chunk_id, latex, list_transform(string_split(latex, ''), lambda c: CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) AS d FROM formulas)
    SELECT chunk_id, list_min(list_transform(range(1, len(d) + 1), lambda i: list_sum(d[1:i]))) >= 0 AND list_sum(d) = 0 AND NOT regexp_matches(latex, {quoted(rules.INVALID_LATEX)}) AS is_valid FROM b""",
)
def latex_valid(t: Tables) -> DataFrame:
    return t.raw_formulas().select("chunk_id", L.is_valid(F.col("latex")).alias("is_valid"))


@registered("formula_classify", f"WITH {SQL_FORMULAS} SELECT chunk_id, kind, CASE kind WHEN 'product' THEN 'unknown' ELSE kind END AS formula_type FROM formulas")
def formula_classify(t: Tables) -> DataFrame:
    return t.formulas().select("chunk_id", "kind", "formula_type")


@registered("formula_domain", f"WITH {SQL_FORMULAS} SELECT chunk_id, domain FROM formulas")
def formula_domain(t: Tables) -> DataFrame:
    return t.formulas().select("chunk_id", "domain")


@registered("formula_extract")
def formula_extract(t: Tables) -> DataFrame:
    """Formulas are put between marks into the passages that they derive from, and found again."""
    mark = F.when(F.col("idx") % 3 == 0, F.concat(F.lit("$$"), "latex", F.lit("$$"))).when(F.col("idx") % 3 == 1, F.concat(F.lit("\\["), "latex", F.lit("\\]"))).otherwise(F.concat(F.lit("\\begin{align}"), "latex", F.lit("\\end{align}")))
    blocks = t.raw_formulas().select("document_id", "page_number", F.col("idx").alias("block_idx"), F.concat_ws(" ", "content", mark).alias("content"))
    return ops.extract(blocks).select("document_id", "formula_id", "source_page", "block_idx", "latex", "formula_type", "domain", "is_valid", F.array_join("variables", ",").alias("variables"))


@registered("formula_dedup", f"WITH {SQL_FORMULAS} SELECT doc_id, formula_id, chunk_id FROM formulas QUALIFY row_number() OVER (PARTITION BY doc_id, normal_form ORDER BY idx) = 1")
def formula_dedup(t: Tables) -> DataFrame:
    first = t.formulas().groupBy("doc_id", "normal_form").agg(F.min_by(F.struct("formula_id", "chunk_id"), "idx").alias("x"))
    return first.select("doc_id", "x.formula_id", "x.chunk_id")


@registered("formula_upsert", f"WITH {SQL_FORMULAS} SELECT formula_id, latex, max(doc_id * 1000 + idx) AS version FROM formulas GROUP BY ALL")
def formula_upsert(t: Tables) -> DataFrame:
    from docweft.sources.tables import latest

    # ids are short digests, which different formulas may share
    return latest(t.formulas().withColumn("version", F.col("doc_id") * 1000 + F.col("idx")), ["formula_id", "latex"], "version").select("formula_id", "latex", "version")


@registered("formula_by_variable", f"WITH {SQL_FORMULAS} SELECT DISTINCT formula_id FROM formulas WHERE list_contains(variables, 'T') OR len(list_filter(variables, lambda v: starts_with(lower(v), 't') AND length(v) > 1)) > 0")
def formula_by_variable(t: Tables) -> DataFrame:
    return ops.by_variable(t.formulas(), "T").select("formula_id").distinct()


@registered("formula_by_operator", f"WITH {SQL_FORMULAS} SELECT DISTINCT formula_id FROM formulas WHERE list_contains(operators, 'dot_product')")
def formula_by_operator(t: Tables) -> DataFrame:
    return ops.by_operator(t.formulas(), "dot_product").select("formula_id").distinct()


@registered("formula_by_domain", f"WITH {SQL_FORMULAS} SELECT DISTINCT formula_id, 1.0::DOUBLE AS score FROM formulas WHERE domain = 'physics' ORDER BY formula_id LIMIT 50")
def formula_by_domain(t: Tables) -> DataFrame:
    return ops.by_domain(t.stored_formulas(), "physics")


@registered("formula_alike")
def formula_alike(t: Tables) -> DataFrame:
    """The formulas of documents whose id is divisible by 20 against all, by signature and text."""
    every = t.stored_formulas().groupBy("formula_id").agg(F.min(F.struct("latex", "operators", "functions")).alias("x")).select("formula_id", "x.*")
    asked = t.stored_formulas().filter("doc_id % 20 = 0").select("formula_id").distinct()
    return ops.alike(every, every.join(asked, "formula_id", "left_semi"), 0.8)


@registered("formula_symbolic", f"WITH {SQL_FORMULAS} SELECT DISTINCT formula_id FROM formulas WHERE list_has_any(variables, ['a', 'T', 'e']) AND list_has_any(operators, ['sum', 'gradient']) AND domain = 'physics'")
def formula_symbolic(t: Tables) -> DataFrame:
    return ops.by_symbols(t.formulas(), ["a", "T", "e"], ["sum", "gradient"], "physics").select("formula_id").distinct()


_JACCARD = "coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"
_SIMILAR = f"round(0.6 * {_JACCARD.format(a='s.variables', b='o.variables')} + 0.4 * {_JACCARD.format(a='s.operators', b='o.operators')}, 6)"


def _unique(t: Tables) -> DataFrame:
    return t.stored_formulas().groupBy("formula_id").agg(F.min(F.struct("variables", "operators")).alias("x")).select("formula_id", "x.*")


@registered(
    "formula_similar",
    f"""WITH {SQL_FORMULAS}, u AS (SELECT formula_id, min({{'v': variables, 'o': list_sort(operators)}}) AS x FROM formulas GROUP BY 1), sets AS (SELECT formula_id, x.v AS variables, x.o AS operators FROM u),
    sources AS (SELECT * FROM sets WHERE formula_id IN (SELECT formula_id FROM formulas WHERE doc_id % 20 = 0))
    SELECT s.formula_id, o.formula_id AS similar_id, {_SIMILAR} AS score, row_number() OVER (PARTITION BY s.formula_id ORDER BY {_SIMILAR} DESC, o.formula_id) - 1 AS rank
    FROM sources s JOIN sets o ON s.formula_id <> o.formula_id WHERE {_SIMILAR} > 0.2 QUALIFY rank < 10""",
)
def formula_similar(t: Tables) -> DataFrame:
    """The formulas of documents whose id is divisible by 20 against all."""
    every, asked = _unique(t), t.stored_formulas().filter("doc_id % 20 = 0").select("formula_id").distinct()
    return ops.similar(every, every.join(asked, "formula_id", "left_semi")).withColumn("rank", F.col("rank").cast("long"))


@registered("formula_by_latex")
def formula_by_latex(t: Tables) -> DataFrame:
    """The formulas of documents whose id is divisible by 20 against all."""
    asked = t.stored_formulas().filter("doc_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "latex")
    return ops.by_latex(t.stored_formulas(), asked)


@registered(
    "formula_dependencies",
    f"""WITH {SQL_FORMULAS}, f AS (SELECT DISTINCT doc_id, formula_id, variables FROM formulas)
    SELECT DISTINCT a.doc_id::VARCHAR AS document_id, a.formula_id, b.formula_id AS depends_on FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.formula_id <> b.formula_id AND list_has_any(a.variables, b.variables) AND len(b.variables) < len(a.variables)""",
)
def formula_dependencies(t: Tables) -> DataFrame:
    return ops.dependencies(t.stored_formulas().select("document_id", "formula_id", "variables").distinct())


@registered(
    "formula_dependents",
    f"""WITH {SQL_FORMULAS}, f AS (SELECT DISTINCT doc_id, formula_id, variables FROM formulas),
    e AS (SELECT DISTINCT a.doc_id, a.formula_id, b.formula_id AS depends_on FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.formula_id <> b.formula_id AND list_has_any(a.variables, b.variables) AND len(b.variables) < len(a.variables))
    SELECT depends_on AS formula_id, count(*) AS n_dependents, min(formula_id) AS first_dependent FROM e GROUP BY 1""",
)
def formula_dependents(t: Tables) -> DataFrame:
    return formula_dependencies(t).groupBy(F.col("depends_on").alias("formula_id")).agg(F.count("*").alias("n_dependents"), F.min("formula_id").alias("first_dependent"))


_DEPENDS = f"""{SQL_FORMULAS}, f AS (SELECT DISTINCT doc_id, formula_id, variables FROM formulas),
    d AS (SELECT DISTINCT a.doc_id || ':' || a.formula_id AS src, b.doc_id || ':' || b.formula_id AS dst FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.formula_id <> b.formula_id AND list_has_any(a.variables, b.variables) AND len(b.variables) < len(a.variables))"""


@registered("dependency_closure", f"WITH RECURSIVE {_DEPENDS}, walk(src, dst) AS (SELECT src, dst FROM d UNION SELECT w.src, d.dst FROM walk w JOIN d ON w.dst = d.src) SELECT src, dst FROM walk")
def dependency_closure(t: Tables) -> DataFrame:
    """All that the formulas of a document depend on, directly or not."""
    named = lambda c: F.concat_ws(":", "document_id", c)
    return ops.closure(formula_dependencies(t).select(named("formula_id").alias("src"), named("depends_on").alias("dst")))


@registered(
    "formula_chunk_link",
    f"""WITH {SQL_FORMULAS}, f AS (SELECT DISTINCT doc_id, formula_id, source_page, latex, variables FROM formulas)
    SELECT f.doc_id::VARCHAR AS document_id, f.formula_id, f.source_page, count(*) AS n_chunks, arg_max(c.chunk_id, c.seq) AS source_chunk_id
    FROM f JOIN chunks c ON c.doc_id = f.doc_id AND c.page_number = f.source_page AND (contains(c.content, f.latex) OR len(list_filter(f.variables, lambda v: contains(c.content, v))) > 0) GROUP BY ALL""",
)
def formula_chunk_link(t: Tables) -> DataFrame:
    found = t.formulas().select("document_id", "formula_id", "source_page", "latex", "variables").distinct()
    return ops.link_to_chunks(found, t.chunks().select("document_id", "chunk_id", "seq", "content", "page_numbers"))


# Relations


@registered(
    "related_proofs",
    f"""WITH {SQL_TYPED}, p AS (SELECT a.doc_id::VARCHAR AS document_id, a.chunk_id AS x, b.chunk_id AS y FROM typed a JOIN typed b ON a.doc_id = b.doc_id AND a.chunk_type IN ('theorem', 'definition') AND b.chunk_type = 'proof' AND abs(a.page_number - b.page_number) <= 1)
    SELECT document_id, x AS src, y AS dst, 'proof' AS kind FROM p UNION SELECT document_id, y, x, 'proof' FROM p""",
)
def related_proofs(t: Tables) -> DataFrame:
    return relations.proofs(t.known())


@registered(
    "related_examples",
    f"""WITH {SQL_CONCEPTS} SELECT a.doc_id::VARCHAR AS document_id, a.chunk_id AS src, b.chunk_id AS dst, 'example' AS kind FROM known a JOIN known b
    ON a.doc_id = b.doc_id AND a.chunk_type IN ('theorem', 'definition') AND b.chunk_type = 'example' AND list_has_any(a.concepts, b.concepts)""",
)
def related_examples(t: Tables) -> DataFrame:
    return relations.examples(t.known())


_RELATED = "round(CASE WHEN a.domain = b.domain THEN 0.3 ELSE 0 END + 0.2 * len(list_intersect(a.concepts, b.concepts)) + CASE WHEN abs(a.page_number - b.page_number) <= 2 THEN 0.2 ELSE 0 END + CASE WHEN a.section = b.section THEN 0.15 ELSE 0 END, 6)"


@registered(
    "related_scored",
    f"""WITH {SQL_CONCEPTS} SELECT a.doc_id::VARCHAR AS document_id, a.chunk_id AS src, b.chunk_id AS dst, least({_RELATED}, 1.0)::DOUBLE AS score FROM known a JOIN known b ON a.doc_id = b.doc_id AND a.chunk_id <> b.chunk_id WHERE {_RELATED} >= 0.5""",
)
def related_scored(t: Tables) -> DataFrame:
    return relations.related(t.known())


@registered("graph_edges", f"""WITH {SQL_TYPED}, p AS (SELECT a.doc_id::VARCHAR AS document_id, a.chunk_id AS x, b.chunk_id AS y FROM typed a JOIN typed b ON a.doc_id = b.doc_id AND a.chunk_type IN ('theorem', 'definition') AND b.chunk_type = 'proof' AND abs(a.page_number - b.page_number) <= 1)
    SELECT document_id, x AS src, y AS dst, 'proof' AS kind FROM p UNION ALL SELECT document_id, y, x, 'proof' FROM p
    UNION ALL SELECT doc_id::VARCHAR, 'C_' || doc_id || '_' || (1 + (idx // 5 * 5) * 10 // 40) || '_' || (idx // 5 * 5), chunk_id, 'parent' FROM chunks WHERE idx % 5 <> 0""")
def graph_edges(t: Tables) -> DataFrame:
    from docweft.queries.corpus import _nested

    return reports.graph_edges(_nested(t), relations.proofs(t.known()))


# Reports


@registered(
    "kb_statistics",
    f"""WITH {SQL_FORMULAS}, t AS (WITH {SQL_TYPED} SELECT * FROM typed)
    SELECT 'chunk_types' AS metric, chunk_type AS key, count(*)::DOUBLE AS value FROM t GROUP BY 2 UNION ALL SELECT 'domains', domain, count(*)::DOUBLE FROM t GROUP BY 2
    UNION ALL SELECT 'formula_domains', domain, count(*)::DOUBLE FROM formulas GROUP BY 2 UNION ALL SELECT 'total_chunks', '', count(*)::DOUBLE FROM t
    UNION ALL SELECT 'avg_chunk_length', '', round(avg(length(content)), 6) FROM t UNION ALL SELECT 'total_formulas', '', count(DISTINCT formula_id)::DOUBLE FROM formulas""",
)
def kb_statistics(t: Tables) -> DataFrame:
    return reports.statistics(t.known(), t.stored_formulas())


@registered(
    "metadata_report",
    f"""WITH {SQL_FORMULAS}, t AS (WITH {SQL_TYPED} SELECT * FROM typed), s AS (
    SELECT 'chunk_types' AS metric, chunk_type AS key, count(*)::DOUBLE AS value FROM t GROUP BY 2 UNION ALL SELECT 'domains', domain, count(*)::DOUBLE FROM t GROUP BY 2
    UNION ALL SELECT 'formula_domains', domain, count(*)::DOUBLE FROM formulas GROUP BY 2 UNION ALL SELECT 'total_chunks', '', count(*)::DOUBLE FROM t
    UNION ALL SELECT 'avg_chunk_length', '', round(avg(length(content)), 6) FROM t UNION ALL SELECT 'total_formulas', '', count(DISTINCT formula_id)::DOUBLE FROM formulas)
    SELECT metric, key, key = '' AS is_total, '- **' || replace(metric, '_', ' ') || CASE WHEN key <> '' THEN ' (' || key || ')' ELSE '' END || '**: ' || printf('%.2f', value) AS line FROM s""",
)
def metadata_report(t: Tables) -> DataFrame:
    return reports.metadata_report(reports.statistics(t.known(), t.stored_formulas()))


@registered("formula_retrieve", f"""WITH {SQL_FORMULAS}, found AS (SELECT DISTINCT formula_id FROM formulas WHERE list_contains(variables, 'T') OR len(list_filter(variables, lambda v: starts_with(lower(v), 't') AND length(v) > 1)) > 0 ORDER BY formula_id LIMIT 20)
  SELECT formula_id, x.latex AS latex, x.plain_text AS plain_text, x.domain AS domain FROM found JOIN (SELECT formula_id, min({{'latex': latex, 'plain_text': plain_text, 'domain': domain}}) AS x FROM formulas GROUP BY 1) USING (formula_id)""")
def formula_retrieve(t: Tables) -> DataFrame:
    found = ops.by_variable(t.stored_formulas(), "T").select("formula_id").distinct().orderBy("formula_id").limit(20)
    return search.stored(found, t.stored_formulas().select("formula_id", "latex", "plain_text", "domain"), "formula_id")


@registered("table_of_contents", f"""WITH {SQL_TYPED} SELECT doc_id::VARCHAR AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS line_no,
  repeat('  ', CASE chunk_type WHEN 'chapter' THEN 0 WHEN 'section' THEN 1 ELSE 2 END) || '- **' || heading || '** (Page ' || page_number || ')' AS line FROM typed WHERE chunk_type IN ('chapter', 'section', 'subsection') AND heading <> ''""")
def table_of_contents(t: Tables) -> DataFrame:
    return reports.table_of_contents(t.known()).withColumn("line_no", F.col("line_no").cast("long"))


@registered("concept_index", f"""WITH {SQL_CONCEPTS}, e AS (SELECT page_number, unnest(concepts) AS concept FROM known), g AS (SELECT concept, count(*) AS n_chunks, list_sort(list(DISTINCT page_number)) AS p FROM e GROUP BY 1)
    SELECT concept, n_chunks, '- **' || concept || '**: Pages ' || array_to_string(p[1:5], ', ') || CASE WHEN len(p) > 5 THEN ' (and ' || (len(p) - 5) || ' more)' ELSE '' END AS line FROM g""")
def concept_index(t: Tables) -> DataFrame:
    return reports.concept_index(t.known())


@registered("formula_handbook", f"""WITH {SQL_FORMULAS} SELECT doc_id::VARCHAR AS document_id, domain, row_number() OVER (PARTITION BY doc_id, domain ORDER BY formula_id, source_page) AS entry_no,
  '### ' || formula_id || chr(10) || chr(10) || '$$' || chr(10) || latex || chr(10) || '$$' || chr(10) || chr(10) || CASE WHEN plain_text <> '' THEN '*' || plain_text || '*' || chr(10) || chr(10) ELSE '' END
  || '- **Type:** ' || CASE kind WHEN 'product' THEN 'unknown' ELSE kind END || chr(10) || '- **Page:** ' || source_page || chr(10) || '- **Variables:** ' || array_to_string(variables, ', ') AS entry FROM formulas""")
def formula_handbook(t: Tables) -> DataFrame:
    return reports.formula_handbook(t.formulas()).withColumn("entry_no", F.col("entry_no").cast("long"))


@registered("searchable_index", f"""WITH {SQL_FORMULAS}, k AS (WITH {SQL_CONCEPTS} SELECT * FROM known) SELECT chunk_id AS id, 'chunk' AS type, substr(content, 1, 200) AS preview, page_number AS page, domain, array_to_string(concepts, ',') AS terms FROM k
  UNION ALL SELECT formula_id, 'formula', latex, source_page, domain, array_to_string(variables, ',') FROM formulas""")
def searchable_index(t: Tables) -> DataFrame:
    return reports.searchable_index(t.known(), t.stored_formulas())


@registered("quick_reference", f"""WITH {SQL_FORMULAS} SELECT DISTINCT formula_id, domain, '- $' || latex || '$' || CASE WHEN plain_text <> '' THEN chr(10) || '  *' || plain_text || '*' ELSE '' END AS line FROM formulas ORDER BY domain, formula_id LIMIT 50""")
def quick_reference(t: Tables) -> DataFrame:
    return reports.quick_reference(t.formulas())


@registered("chapter_summaries", f"WITH {SQL_TYPED} SELECT doc_id::VARCHAR AS document_id, coalesce(heading, 'Unknown Chapter') AS heading, CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END AS summary FROM typed WHERE chunk_type = 'chapter'")
def chapter_summaries(t: Tables) -> DataFrame:
    return reports.chapter_summaries(t.known())


_SENTENCES = """SELECT doc_id, i AS pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))"""


@registered("key_sentences", summaries.oracle_sql(_SENTENCES, sql_terms("sentence"), "doc_id"))
def key_sentences(t: Tables) -> DataFrame:
    """A summary of every whole document."""
    return summaries.key_sentences(t.read("documents"), "doc_id")


@registered("flashcards", f"""WITH {SQL_FORMULAS}, k AS (WITH {SQL_TYPED} SELECT * FROM typed),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY formula_id) AS n FROM (SELECT DISTINCT doc_id, formula_id, latex, plain_text, domain FROM formulas)),
  s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM k WHERE chunk_type IN ('definition', 'theorem', 'concept')),
  cards AS (SELECT doc_id, 'fc_' || formula_id AS card_id, 'formula' AS type, 'What is the formula for: ' || plain_text || '?' AS front, '$$' || latex || '$$' AS back, domain FROM f WHERE n <= 5
    UNION ALL SELECT doc_id, 'fc_' || chunk_id, 'concept', 'Define or explain: ' || heading, CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END, domain FROM s WHERE n <= 5 AND heading <> '')
  SELECT doc_id::VARCHAR AS document_id, card_id, type, front, back, domain, ['easy', 'medium', 'hard'][1 + ('0x' || substr(md5('docweft' || card_id), 1, 4))::INTEGER % 3] AS difficulty,
    row_number() OVER (PARTITION BY doc_id ORDER BY md5('docweft' || card_id), card_id) AS position FROM cards QUALIFY position <= 10""")
def flashcards(t: Tables) -> DataFrame:
    return reports.flashcards(t.known(), t.stored_formulas()).withColumn("position", F.col("position").cast("long"))


@registered("multiple_choice", f"""WITH {SQL_FORMULAS}, u AS (SELECT doc_id, formula_id, min({{'p': source_page, 'l': latex, 't': plain_text}}) AS x FROM formulas GROUP BY ALL),
  l AS (SELECT doc_id, formula_id, x.l AS latex, x.t AS plain_text, row_number() OVER (PARTITION BY doc_id ORDER BY formula_id) AS n FROM u QUALIFY n <= 11),
  r AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY doc_id) AS size FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY md5('docweft' || formula_id), formula_id)),
  o AS (SELECT a.doc_id, a.formula_id, a.latex, a.plain_text, list_sort(list_distinct(list(b.latex))) AS options FROM r a JOIN r b ON a.doc_id = b.doc_id AND (b.place - a.place + a.size) % a.size <= 3 WHERE a.n <= 5 GROUP BY ALL)
  SELECT doc_id::VARCHAR AS document_id, 'mcq_' || formula_id AS question_id, 'Which formula represents ' || plain_text || '?' AS question, array_to_string(options, ' | ') AS options, (list_position(options, latex) - 1)::BIGINT AS correct FROM o""")
def multiple_choice(t: Tables) -> DataFrame:
    return reports.choices(t.stored_formulas())


@registered("chat_history", "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 20")
def chat_history(t: Tables) -> DataFrame:
    return reports.chat_history(t.read("conversations")).withColumn("back", F.col("back").cast("long"))


@registered(
    "chat_answer",
    f"""WITH {SQL_CHUNKS}, m AS (SELECT conv_id || '_' || turn AS message_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) > 3)) AS word FROM conversations WHERE role = 'user' AND conv_id % 20 = 0),
    w AS (SELECT message_id, word, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT message_id, chunk_id, sum(n)::BIGINT AS score FROM w JOIN chunks ON contains(lower(content), word) GROUP BY ALL)
    SELECT message_id, chunk_id, score, 'Based on the document:' || chr(10) || chr(10) || substr(content, 1, 400) AS response FROM s JOIN chunks USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY score DESC, chunk_id) = 1""",
)
def chat_answer(t: Tables) -> DataFrame:
    """The users' messages of conversations whose id is divisible by 20, against all chunks."""
    asked = t.read("conversations").filter("role = 'user' AND conv_id % 20 = 0").select(F.concat_ws("_", "conv_id", "turn").alias("message_id"), F.col("text").alias("message"))
    return reports.chat_answers(t.chunks(), asked)


@registered("web_search", f"""WITH {SQL_CHUNKS} SELECT chunk_id, substr(content, 1, 300) AS content, heading, ((length(content) - length(replace(lower(content), 'tion the', ''))) // 8 + 2 * (length(coalesce(heading, '')) - length(replace(lower(coalesce(heading, '')), 'tion the', ''))) // 8)::INTEGER AS relevance
  FROM chunks WHERE contains(lower(content), 'tion the') OR contains(lower(coalesce(heading, '')), 'tion the')""")
def web_search(t: Tables) -> DataFrame:
    return search.web_search(t.chunks(), "tion the")


@registered("web_search_formulas", f"""WITH {SQL_FORMULAS} SELECT DISTINCT formula_id AS chunk_id, latex AS content, plain_text AS heading, ((length(latex) - length(replace(lower(latex), 'sum', ''))) // 3 + (length(plain_text) - length(replace(lower(plain_text), 'sum', ''))) // 3)::INTEGER AS relevance
  FROM formulas WHERE contains(lower(latex), 'sum') OR contains(lower(plain_text), 'sum')
  UNION ALL SELECT chunk_id, substr(content, 1, 300), heading, ((length(content) - length(replace(lower(content), 'sum', ''))) // 3 + 2 * (length(coalesce(heading, '')) - length(replace(lower(coalesce(heading, '')), 'sum', ''))) // 3)::INTEGER
  FROM chunks WHERE contains(lower(content), 'sum') OR contains(lower(coalesce(heading, '')), 'sum')""")
def web_search_formulas(t: Tables) -> DataFrame:
    return search.web_search(t.chunks(), "sum", formulas=t.stored_formulas())


_DIAGRAMS = f"""{SQL_CHUNKS}, diagrams AS (SELECT 'D_' || doc_id || '_' || idx AS diagram_id, ['chart', 'graph', 'circuit', 'flowchart'][1 + (doc_id + idx) % 4] AS diagram_type, substr(content, 1, 80) AS caption FROM chunks WHERE idx % 3 = 0)"""


@registered("diagram_by_type", f"WITH {_DIAGRAMS} SELECT diagram_id, caption, 1.0::DOUBLE AS score FROM diagrams WHERE diagram_type = 'circuit' ORDER BY diagram_id LIMIT 20")
def diagram_by_type(t: Tables) -> DataFrame:
    """Every third passage is taken for a diagram with a caption."""
    kinds = F.array(*map(F.lit, ("chart", "graph", "circuit", "flowchart")))
    kind = F.element_at(kinds, (1 + (F.col("doc_id") + F.col("idx")) % 4).cast("int"))
    diagrams = t.chunks().filter("idx % 3 = 0").select(F.concat_ws("_", F.lit("D"), "doc_id", "idx").alias("diagram_id"), kind.alias("diagram_type"), F.substring("content", 1, 80).alias("caption"))
    return search.diagrams_of_type(diagrams, "circuit")


@registered("diagram_search", """SELECT q.vec_id::VARCHAR AS query_id, 'diagram' AS source, (row_number() OVER (PARTITION BY q.vec_id ORDER BY round(d, 6) DESC, e.vec_id) - 1)::INTEGER AS rank, round(d, 6) AS score, 'D_' || e.vec_id AS doc_key
  FROM (SELECT q.vec_id AS a, e.vec_id AS b, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) p JOIN embeddings q ON q.vec_id = a JOIN embeddings e ON e.vec_id = b QUALIFY rank < 10""")
def diagram_search(t: Tables) -> DataFrame:
    """The vectors are taken for those of diagrams."""
    diagrams = t.vectors().select(F.concat_ws("_", F.lit("D"), "vec_id").alias("diagram_id"), "embedding", F.col("vec_id").alias("number"))
    return search.diagram_hits(diagrams, t.vector_queries())


