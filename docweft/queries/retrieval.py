"""Queries over the keyword and vector indices, query understanding, fusion, context and answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.functions import rules, text
from docweft.operators import block_index, chunking, keyword_index, vector_graph, vector_lists, vectors
from docweft.operators.storage import remove, shared_place, written
from docweft.plans import context, fusion, reports, search
from docweft.plans import query as Q
from docweft.streaming import versions
from docweft.queries.base import SQL_CHUNKS, SQL_FORMULAS, SQL_POSTINGS, SQL_QUERIES, SQL_TERMS, Tables, quoted, registered, sql_any, sql_arg_max, sql_capitals, sql_first, sql_terms

# Keyword index

_ITEMS = f"items AS (SELECT item_id, unnest({sql_terms('text')}) AS term FROM benchmark)"
_BM25 = f"""WITH {SQL_POSTINGS}, {_ITEMS}, stats AS (SELECT count(*) AS n, avg(len(terms)) AS avg_dl FROM terms), freq AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
  s AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM items JOIN postings USING (term) JOIN freq USING (term), stats GROUP BY ALL)
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s QUALIFY rank < {{k}}"""


def _items(t: Tables) -> DataFrame:
    return keyword_index.terms(t.read("benchmark"), "item_id").withColumnRenamed("item_id", "query_id")


def _bm25(t: Tables, k: int) -> DataFrame:
    return keyword_index.bm25(t.index(), _items(t), "query_id", k)


@registered("bm25_topk", _BM25.replace("{k}", "10"))
def bm25_topk(t: Tables) -> DataFrame:
    return _bm25(t, 10).select(F.col("query_id").alias("item_id"), "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@registered("bm25_block_topk", _BM25.replace("{k}", "10"))
def bm25_block_topk(t: Tables) -> DataFrame:
    """The rows of ``bm25_topk`` from the index in blocks, most of which are skipped."""
    found, _ = block_index.bm25(t.block_index(), _items(t), "query_id", 10)
    return found.select(F.col("query_id").alias("item_id"), "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@registered("keyword_df", f"WITH {SQL_POSTINGS} SELECT term, count(*) AS df FROM postings GROUP BY 1")
def keyword_df(t: Tables) -> DataFrame:
    return keyword_index.frequencies(t.index())


@registered("keyword_df_incremental", f"WITH {SQL_POSTINGS} SELECT term, count(*) AS df FROM postings GROUP BY 1")
def keyword_df_incremental(t: Tables) -> DataFrame:
    """The same from an index that follows changing documents: every second one first came with another text."""
    place, docs = f"{shared_place(t.spark)}/versions-{uuid.uuid4().hex}", t.read("documents")
    earlier = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit(1).cast("long").alias("version"), F.concat_ws(" ", "lang", "source").alias("text"))
    now = docs.select("doc_id", F.lit(2).cast("long").alias("version"), F.coalesce("text", F.lit(" ")).alias("text"))
    for arrived in (earlier, now.unionByName(earlier)):
        arrived.write.mode("append").parquet(f"{place}/arrived")
        versions.follow(t.spark.readStream.schema(arrived.schema).parquet(f"{place}/arrived"), f"{place}/index")
    remove(t.spark, f"{place}/arrived")
    last = versions.compact(t.spark, f"{place}/index")
    for batch in range(0 if last is None else last + 1):  # the base holds what they had
        remove(t.spark, f"{place}/index/deltas/batch={batch}")
    return versions.document_frequency(t.spark, f"{place}/index")


@registered("keyword_postings_stats", f"WITH {SQL_TERMS} SELECT count(*) AS n_docs, round(avg(len(terms)), 6) AS avg_dl, max(len(terms))::INTEGER AS max_dl, (SELECT count(DISTINCT term) FROM (SELECT unnest(terms) AS term FROM terms)) AS vocabulary FROM terms")
def keyword_postings_stats(t: Tables) -> DataFrame:
    index = t.index()
    # one row each
    longest = index.stored.agg(F.coalesce(F.max("dl"), F.lit(0)).alias("max_dl"))
    vocabulary = index.stored.select("term").distinct().agg(F.count("*").alias("vocabulary"))
    return index.totals.select("n_docs", F.round("avg_dl", 6).alias("avg_dl")).join(F.broadcast(longest)).join(F.broadcast(vocabulary))


@registered("keyword_exact", f"WITH {SQL_TERMS} SELECT doc_id, 1.0::DOUBLE AS score FROM terms WHERE len(list_filter(terms, lambda x: contains(x, 'ention'))) > 0 AND len(list_filter(terms, lambda x: contains(x, 'tionth'))) > 0")
def keyword_exact(t: Tables) -> DataFrame:
    return keyword_index.exact(t.terms(), "doc_id", "Ention tionth")


@registered("keyword_lookup", f"WITH {SQL_TERMS} SELECT doc_id FROM terms WHERE list_contains(terms, 'tion_onth') OR list_contains(terms, 'anan')")
def keyword_lookup(t: Tables) -> DataFrame:
    terms = t.terms()
    return keyword_index.lookup(terms, "doc_id", "Tion_onth").union(keyword_index.lookup(terms, "doc_id", "anan")).distinct()


#: DuckDB's edit distance counts bytes, so letters of two bytes are given ones of one byte that the terms do not use.
_LETTERS = "'áéíóúñüäößçêèàùâîôûëï', 'ABCDEFGHIJKLMNOPQRSTU'"
_SIMILAR = """CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.8 WHEN abs(length(a) - length(b)) > greatest(length(a), length(b)) * 0.5 THEN 0.0 ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END"""


@registered(
    "keyword_fuzzy",
    f"""WITH {SQL_POSTINGS}, asked AS (SELECT item_id, translate(unnest(list_filter({sql_terms("text")}, lambda x: NOT contains(x, '_'))), {_LETTERS}) AS a FROM benchmark WHERE item_id % 20 = 0), v AS (SELECT DISTINCT term, translate(term, {_LETTERS}) AS b FROM postings),
    p AS (SELECT a, term, {_SIMILAR} AS similarity FROM (SELECT DISTINCT a FROM asked) CROSS JOIN v WHERE {_SIMILAR} >= 0.7), w AS (SELECT item_id, term, sum(similarity) AS weight FROM asked JOIN p USING (a) GROUP BY ALL),
    s AS (SELECT item_id, doc_id, round(sum(weight), 6)::DOUBLE AS score FROM w JOIN postings USING (term) GROUP BY ALL)
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s QUALIFY rank < 20""",
)
def keyword_fuzzy(t: Tables) -> DataFrame:
    """The words of benchmark items whose id is divisible by 20, against the whole vocabulary."""
    asked = keyword_index.terms(t.read("benchmark").filter("item_id % 20 = 0"), "item_id").withColumn("terms", F.filter("terms", lambda x: ~F.contains(x, F.lit("_"))))
    return keyword_index.fuzzy(t.index(), asked, "item_id", known=t.term_index()).withColumn("rank", F.col("rank").cast("long"))


# Vectors

_DOT = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _sql_vectors(k: int, condition: str = "true") -> str:
    return f"""SELECT q.vec_id AS query_id, e.vec_id, round({_DOT}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) - 1 AS rank
      FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND {condition} QUALIFY rank < {k}"""


@registered("vector_topk", _sql_vectors(10))
def vector_topk(t: Tables) -> DataFrame:
    return vectors.top_k(t.vectors(), "vec_id", t.vector_queries(), "query_id", 10).withColumn("rank", F.col("rank").cast("long"))


@registered("vector_topk_filtered", _sql_vectors(5, "e.label IN (1, 3)"))
def vector_topk_filtered(t: Tables) -> DataFrame:
    """The wanted rows are chosen before the search, so that it never comes short."""
    return vectors.top_k(t.vectors().filter("label IN (1, 3)"), "vec_id", t.vector_queries(), "query_id", 5).withColumn("rank", F.col("rank").cast("long"))


@registered("vector_ivf_topk")
def vector_ivf_topk(t: Tables) -> DataFrame:
    """The given vectors have no clusters, so that many lists have to be looked into; their codes are a twelfth of the vectors."""
    return vector_lists.search(t.vector_lists(), "vec_id", t.vector_queries(), "query_id", 10, share=0.7, rescored=60).withColumn("rank", F.col("rank").cast("long"))


@registered("vector_graph_topk")
def vector_graph_topk(t: Tables) -> DataFrame:
    found, _ = vector_graph.search(t.vector_graph(), "vec_id", t.vector_queries(), "query_id", 10, beam=32, rescored=60)
    return found.withColumn("rank", F.col("rank").cast("long"))


_COSINE = "list_inner_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_inner_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_inner_product(b::DOUBLE[], b::DOUBLE[])))"


@registered("vector_adjacent_similarity", f"""WITH p AS (SELECT label, vec_id, embedding AS b, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings)
  SELECT label, vec_id, round({_COSINE}, 6) AS similarity, {_COSINE} < 0.3 AS is_boundary FROM p WHERE a IS NOT NULL""")
def vector_adjacent_similarity(t: Tables) -> DataFrame:
    return chunking.boundaries(t.vectors(), "label", "vec_id").withColumn("similarity", F.round("similarity", 6))


@registered("vector_normalize", "SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS v FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda y: y * (1 + vec_id % 5)) AS x FROM embeddings))")
def vector_normalize(t: Tables) -> DataFrame:
    scaled = t.vectors().select("vec_id", F.transform("embedding", lambda y: y.cast("double") * (1 + F.col("vec_id") % 5)).alias("v"))
    unit = scaled.select("vec_id", text.normalised(F.col("v")).alias("v"))
    return unit.select("vec_id", F.round(F.sqrt(text.dot(F.col("v"), F.col("v"))), 6).alias("norm"), F.round(F.element_at("v", 1), 6).alias("first"))


# Query understanding

_FORMULAS = "list_concat(" + ", ".join(f"regexp_extract_all(raw_text, {quoted(p)}, 1)" for p in rules.QUERY_FORMULAS) + ")"
_INTENT = sql_first("lower(q)", tuple((n, "|".join(f"(?:{p})" for p in ps)) for n, ps in rules.INTENTS), "'general'")
_COUNT = "len(list_filter(string_split(q, ' '), lambda w: w <> ''))"
_TYPE = f"""CASE WHEN {sql_any("q", rules.QUERY_FORMULA_MARKS)} THEN 'formula' WHEN {sql_any("lower(q)", rules.DIAGRAM_WORDS)} THEN 'diagram' WHEN {_COUNT} <= 3 AND {_INTENT} = 'general' THEN 'keyword'
  WHEN len({_FORMULAS.replace("raw_text", "q")}) > 0 AND {_COUNT} > 2 THEN 'mixed' ELSE 'text' END"""
_STOP = "[" + ", ".join(map(quoted, rules.QUERY_STOPWORDS)) + "]"
_KEYWORDS = f"list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+') AND length(w) > 2 AND NOT list_contains({_STOP}, w)), list_transform({sql_capitals('q')}, lambda x: lower(x)))))"
_WORDS = f"list_distinct(list_concat({_KEYWORDS}, string_split(lower(q), ' ')))"
_DOMAIN = sql_arg_max({d: f"len(list_intersect([{', '.join(map(quoted, w))}], ws))" for d, w in rules.QUERY_DOMAINS.items()}, "NULL")
_EXPANDED = "list_sort(list_distinct(list_concat(k, " + ", ".join(f"CASE WHEN list_contains(k, {quoted(a)}) THEN [{', '.join(map(quoted, b))}] ELSE [] END" for a, b in rules.EXPANSIONS.items()) + ")))"


@registered("query_preprocess", f"WITH {SQL_QUERIES} SELECT query_id, q AS processed_text FROM cleaned")
def query_preprocess(t: Tables) -> DataFrame:
    return t.asked().select("query_id", Q.preprocess(F.col("text")).alias("processed_text"))


@registered("query_type", f"WITH {SQL_QUERIES} SELECT query_id, {_TYPE} AS query_type FROM cleaned")
def query_type(t: Tables) -> DataFrame:
    return t.processed().select("query_id", "query_type")


@registered("query_intent", f"WITH {SQL_QUERIES} SELECT query_id, {_INTENT} AS intent FROM cleaned")
def query_intent(t: Tables) -> DataFrame:
    return t.processed().select("query_id", "intent")


@registered("query_keywords", f"WITH {SQL_QUERIES} SELECT query_id, array_to_string({_KEYWORDS}, ',') AS keywords FROM cleaned")
def query_keywords(t: Tables) -> DataFrame:
    return t.processed().select("query_id", F.array_join("keywords", ",").alias("keywords"))


_DOUBLED = "regexp_replace(q, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g')"
_AFTER = "\\s+(?:law|equation|theorem|principle|constant|rule)"
_ENTITIES = [rules.EDGE_LEFT + "([A-Z][a-z]+(?:''s)?)" + _AFTER, rules.EDGE_LEFT + rules.CAPITALISED + "\\s+(?:formula|equation|theorem)", rules.EDGE_LEFT + "(" + "|".join(rules.ENTITY_SCIENTISTS) + ")" + rules.EDGE_RIGHT]
_ENTITIES = "list_concat(" + ", ".join(f"regexp_extract_all({_DOUBLED}, {quoted(p)}, 1)" for p in _ENTITIES) + ")"


@registered("query_entities", f"WITH {SQL_QUERIES} SELECT query_id, array_to_string(list_sort(list_distinct(list_transform({_ENTITIES}, lambda x: replace(replace(x, '  ', ' '), {quoted(chr(39) * 2)}, {quoted(chr(39))})))), ',') AS entities FROM cleaned")
def query_entities(t: Tables) -> DataFrame:
    return t.processed().select("query_id", F.array_join("entities", ",").alias("entities"))


@registered("query_formulas", f"WITH {SQL_QUERIES} SELECT query_id, array_to_string({_FORMULAS}, '|') AS formulas FROM cleaned")
def query_formulas(t: Tables) -> DataFrame:
    return t.processed().select("query_id", F.array_join("formulas", "|").alias("formulas"))


@registered("query_domain", f"WITH {SQL_QUERIES}, w AS (SELECT query_id, {_WORDS} AS ws FROM cleaned) SELECT query_id, {_DOMAIN} AS domain FROM w")
def query_domain(t: Tables) -> DataFrame:
    return t.processed().select("query_id", "domain")


@registered("query_expand", f"WITH {SQL_QUERIES}, w AS (SELECT query_id, {_KEYWORDS} AS k FROM cleaned) SELECT query_id, array_to_string({_EXPANDED}, ',') AS keywords FROM w")
def query_expand(t: Tables) -> DataFrame:
    return t.processed().select("query_id", F.array_join(Q.expand(F.col("keywords")), ",").alias("keywords"))


# Fusion: keyword hits of the documents and vector hits, for the queries of the benchmark and the vectors of their numbers

_HITS = f"""k AS ({_BM25.replace("{k}", "20")}), v AS (SELECT b.item_id, e.vec_id AS doc_id, round({_DOT}, 6) AS score, row_number() OVER (PARTITION BY b.item_id ORDER BY {_DOT} DESC, e.vec_id) - 1 AS rank
    FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings e QUALIFY rank < 20),
  hits AS (SELECT item_id::VARCHAR AS query_id, 'text' AS source, 0 AS place, rank, score, doc_id::VARCHAR AS doc_key FROM v UNION ALL SELECT item_id::VARCHAR, 'keyword', 3, rank, score, doc_id::VARCHAR FROM k)"""
_ASKED = f"qs AS (SELECT item_id::VARCHAR AS query_id, {_TYPE.replace('raw_text', 'q')} AS query_type, {_INTENT} AS intent FROM (SELECT item_id, {quoted('')} || [{', '.join(map(quoted, ('What is ', 'graph of ', '', 'formula for ')))}][1 + item_id % 4] || text AS q FROM benchmark))"
_FACTOR = {
    "text": "0.4 * CASE WHEN query_type IN ('formula', 'diagram') THEN 0.7 WHEN query_type = 'keyword' THEN 0.8 ELSE 1 END * CASE WHEN intent IN ('definition', 'explanation') THEN 1.3 ELSE 1 END",
    "formula": "0.3 * CASE WHEN query_type = 'formula' THEN 2.0 ELSE 1 END * CASE WHEN intent = 'formula_lookup' THEN 1.5 ELSE 1 END",
    "diagram": "0.2 * CASE WHEN query_type = 'diagram' THEN 2.0 ELSE 1 END * CASE WHEN intent = 'visualization' THEN 1.5 ELSE 1 END",
    "keyword": "0.1 * CASE WHEN query_type = 'keyword' THEN 1.5 ELSE 1 END",
}
_WEIGHTS = "w AS (" + " UNION ALL ".join(f"SELECT query_id, '{s}' AS source, round(({e})::DOUBLE / ({' + '.join(_FACTOR.values())}), 6) AS weight FROM qs" for s, e in _FACTOR.items()) + ")"
_FUSED = """SELECT query_id, doc_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc_key) - 1 AS rank, best_source FROM (
  SELECT query_id, doc_key, round(sum({part}), 6) AS score, min(place * 1000 + rank) AS seen, {best} AS best_source FROM {rows} GROUP BY query_id, doc_key) QUALIFY rank < 10"""
_TOP = "arg_max(source, {'s': score, 'p': -place, 'r': -rank})"


def _hits(t: Tables, keywords: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    known = t.read("benchmark").select(F.col("item_id").alias("query_id"))
    asked = t.vectors().select(F.col("vec_id").alias("query_id"), "embedding").join(known, "query_id")
    named = search.keyword_hits(t.index(), _items(t), 20) if keywords is None else search.hits(keywords, "keyword", "query_id", key)
    return named.unionByName(search.text_hits(t.vectors(), "vec_id", asked, 20))


def _asked(t: Tables) -> DataFrame:
    opening = F.element_at(F.array(F.lit("What is "), F.lit("graph of "), F.lit(""), F.lit("formula for ")), (1 + F.col("item_id") % 4).cast("int"))
    q = F.concat(opening, "text")
    return t.read("benchmark").select(F.col("item_id").cast("string").alias("query_id"), q.alias("raw_text"), Q.query_type(q).alias("query_type"), Q.intent(q).alias("intent"), Q.formulas(q).alias("formulas"), Q.keywords(q).alias("keywords"))


def _shown(fused: DataFrame) -> DataFrame:
    return fused.withColumn("rank", F.col("rank").cast("long"))


@registered("fusion_rrf", f"WITH {_HITS} " + _FUSED.format(part="1.0 / (61 + rank)", best=_TOP, rows="hits"))
def fusion_rrf(t: Tables) -> DataFrame:
    return _shown(fusion.reciprocal_rank(_hits(t), 10))


@registered("fusion_weights", f"WITH {_ASKED}, {_WEIGHTS} SELECT query_id, source, round(weight, 6) AS weight FROM w")
def fusion_weights(t: Tables) -> DataFrame:
    return fusion.weights(_asked(t)).withColumn("weight", F.round("weight", 6))


_ROWS = "rows AS (SELECT h.*, coalesce(weight, 0.1) AS weight, max(score) OVER s AS high, min(score) OVER s AS low FROM hits h LEFT JOIN w USING (query_id, source) WINDOW s AS (PARTITION BY query_id, source))"


@registered("fusion_weighted", f"WITH {_HITS}, {_ASKED}, {_WEIGHTS}, {_ROWS} " + _FUSED.format(part="weight * score / CASE WHEN high > 0 THEN high ELSE 1 END", best=_TOP, rows="rows"))
def fusion_weighted(t: Tables) -> DataFrame:
    return _shown(fusion.weighted(_hits(t), _asked(t), 10))


@registered(
    "fusion_convex",
    f"WITH {_HITS}, {_ASKED}, {_WEIGHTS}, {_ROWS}, total AS (SELECT query_id, sum(weight) AS total FROM (SELECT DISTINCT query_id, source, weight FROM rows) GROUP BY 1), scaled AS (SELECT * FROM rows JOIN total USING (query_id)) "
    + _FUSED.format(part="weight / total * (score - low) / CASE WHEN high > low THEN high - low ELSE 1 END", best="arg_min(source, place * 1000 + rank)", rows="scaled"),
)
def fusion_convex(t: Tables) -> DataFrame:
    return _shown(fusion.convex(_hits(t), _asked(t), 10))


@registered(
    "confidence",
    f"WITH {_HITS}, f AS (" + _FUSED.format(part="1.0 / (61 + rank)", best=_TOP, rows="hits") + """)
    SELECT query_id, round(least(1.0, 0.5 * arg_min(score, rank) + 0.3 / (1 + coalesce(var_pop(score), 0)) + 0.2 * least(1.0, arg_min(score, rank) - arg_max(score, rank))), 6) AS confidence FROM f GROUP BY 1""",
)
def confidence(t: Tables) -> DataFrame:
    return fusion.confidence(fusion.reciprocal_rank(_hits(t), 10))


# Domain search


def _mixed(t: Tables, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Keyword and text hits; where most domains need them, ``whole`` finds them once."""
    every = written(_hits(t), "hits") if whole else _hits(t)
    return every.filter("source = 'keyword'"), every.filter("source = 'text'")


@registered(
    "domain_search_physics",
    f"""WITH {SQL_FORMULAS}, first AS (SELECT DISTINCT formula_id, plain_text FROM formulas WHERE domain = 'physics' ORDER BY formula_id, plain_text LIMIT 20), {SQL_QUERIES},
    kw AS (SELECT query_id, unnest({_KEYWORDS}) AS keyword FROM cleaned), f AS (SELECT DISTINCT query_id, formula_id AS doc_key FROM kw JOIN first ON contains(lower(plain_text), keyword))
    SELECT query_id, 'domain' AS source, (row_number() OVER (PARTITION BY query_id ORDER BY doc_key) - 1)::INTEGER AS rank, 1.0::DOUBLE AS score, doc_key FROM f QUALIFY rank < 10""",
)
def domain_search_physics(t: Tables) -> DataFrame:
    return search.physics(t.stored_formulas(), t.processed())


@registered(
    "domain_search_chemistry",
    f"""WITH {_HITS}, first AS (WITH {SQL_FORMULAS} SELECT DISTINCT formula_id FROM formulas WHERE domain = 'chemistry' ORDER BY 1 LIMIT 10),
    r AS (SELECT item_id::VARCHAR AS query_id, 1.0::DOUBLE AS score, formula_id AS doc_key, 0 AS part, row_number() OVER (PARTITION BY item_id ORDER BY formula_id) AS n FROM benchmark CROSS JOIN first
      UNION ALL SELECT query_id, round(score * 0.9, 6), doc_key, 1, rank FROM hits WHERE source = 'text' AND rank < 10)
    SELECT query_id, 'domain' AS source, (row_number() OVER (PARTITION BY query_id ORDER BY part, n) - 1)::INTEGER AS rank, score, doc_key FROM r QUALIFY rank < 10""",
)
def domain_search_chemistry(t: Tables) -> DataFrame:
    return search.chemistry(t.stored_formulas(), _mixed(t)[1], _asked(t))


@registered(
    "domain_search_data_science",
    f"""WITH {_HITS}, r AS (SELECT query_id, score, doc_key, 0 AS part, rank AS n FROM hits WHERE source = 'keyword' UNION ALL SELECT query_id, round(score * 0.9, 6), doc_key, 1, rank FROM hits WHERE source = 'text' AND rank < 10),
    u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, doc_key ORDER BY part, n) = 1)
    SELECT query_id, 'domain' AS source, (row_number() OVER (PARTITION BY query_id ORDER BY part, n) - 1)::INTEGER AS rank, score, doc_key FROM u QUALIFY rank < 10""",
)
def domain_search_data_science(t: Tables) -> DataFrame:
    return search.data_science(*_mixed(t))


@registered(
    "domain_search_mathematics",
    f"WITH {_HITS} SELECT query_id, 'domain' AS source, rank::INTEGER AS rank, score, doc_key FROM hits WHERE source = 'text' AND rank < 10",
)
def domain_search_mathematics(t: Tables) -> DataFrame:
    return search.mathematics(_mixed(t)[1])


_NAMES = ("physics", "mathematics", "chemistry", "data_science", "statistics")


@registered(
    "domain_search_all",
    f"""WITH {_HITS}, d AS (SELECT item_id, item_id::VARCHAR AS query_id, [{", ".join(map(quoted, _NAMES))}][1 + item_id % 5] AS domain, text FROM benchmark), fs AS (WITH {SQL_FORMULAS} SELECT * FROM formulas),
    p1 AS (SELECT DISTINCT formula_id, plain_text FROM fs WHERE domain = 'physics' ORDER BY formula_id, plain_text LIMIT 20), c1 AS (SELECT DISTINCT formula_id FROM fs WHERE domain = 'chemistry' ORDER BY 1 LIMIT 10),
    p AS (SELECT DISTINCT query_id, formula_id AS doc_key FROM (SELECT query_id, unnest(string_split(lower(text), ' ')) AS keyword FROM d WHERE domain = 'physics') JOIN p1 ON contains(lower(plain_text), keyword)),
    r AS (SELECT query_id, 1.0::DOUBLE AS score, doc_key, 0 AS part, row_number() OVER (PARTITION BY query_id ORDER BY doc_key) AS n FROM p
      UNION ALL SELECT query_id, score, doc_key, 0, rank FROM hits SEMI JOIN (SELECT query_id FROM d WHERE domain = 'mathematics') USING (query_id) WHERE source = 'text'
      UNION ALL SELECT query_id, 1.0, formula_id, 0, row_number() OVER (PARTITION BY query_id ORDER BY formula_id) FROM d CROSS JOIN c1 WHERE domain = 'chemistry'
      UNION ALL SELECT query_id, round(score * 0.9, 6), doc_key, 1, rank FROM hits SEMI JOIN (SELECT query_id FROM d WHERE domain IN ('chemistry', 'data_science')) USING (query_id) WHERE source = 'text' AND rank < 10
      UNION ALL SELECT query_id, score, doc_key, 0, rank FROM hits SEMI JOIN (SELECT query_id FROM d WHERE domain = 'data_science') USING (query_id) WHERE source = 'keyword'),
    u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, doc_key ORDER BY part, n) = 1)
    SELECT query_id, 'domain' AS source, (row_number() OVER (PARTITION BY query_id ORDER BY part, n) - 1)::INTEGER AS rank, score, doc_key FROM u QUALIFY rank < 10""",
)
def domain_search_all(t: Tables) -> DataFrame:
    """The items of the benchmark take the domains in turn; their words are their keywords."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (1 + F.col("item_id") % 5).cast("int"))
    asked = t.read("benchmark").select(F.col("item_id").alias("query_id"), name.alias("domain"), F.split(F.lower("text"), " ", -1).alias("keywords"))
    return search.by_domain(asked, t.stored_formulas(), *_mixed(t, whole=True))


@registered("formula_search")
def formula_search(t: Tables) -> DataFrame:
    from docweft.functions import latex

    asked = t.processed().filter(F.size("formulas") > 0)
    return search.formula_hits(t.stored_formulas(), asked.withColumns({"variables": latex.variables(F.col("raw_text")), "operators": latex.operators(F.col("raw_text"))}))


# Context and answers: keyword hits among all chunks, vector hits as the first chunks of the documents of their numbers

_BM25_CHUNKS = _BM25.replace(SQL_POSTINGS, f"{SQL_CHUNKS}, terms AS (SELECT chunk_id AS doc_id, {sql_terms('content')} AS terms FROM chunks), postings AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM terms)")
_CHUNK_HITS = _HITS.replace(_BM25.replace("{k}", "20"), _BM25_CHUNKS.replace("{k}", "20")).replace("rank, score, doc_id::VARCHAR AS doc_key FROM v", "rank, score, 'C_' || doc_id || '_1_0' AS doc_key FROM v")
_FOUND = f"""{_CHUNK_HITS}, fused AS ({_FUSED.format(part="1.0 / (61 + rank)", best=_TOP, rows="hits")}), heads AS (SELECT *, doc_key AS chunk_key FROM fused)"""


def _found(t: Tables) -> DataFrame:
    every = _hits(t, keyword_index.bm25(t.chunk_index(), _items(t), "query_id", 20), "chunk_id")
    named = F.when(F.col("source") == "text", F.concat(F.lit("C_"), "doc_key", F.lit("_1_0"))).otherwise(F.col("doc_key"))
    return fusion.reciprocal_rank(every.withColumn("doc_key", named), 10).withColumnRenamed("best_source", "source")


def _told(t: Tables) -> DataFrame:
    return context.with_content(_found(t), t.chunks())


@registered(
    "context_expand",
    f"""WITH {_FOUND}, {SQL_CHUNKS}, placed AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, chunk_id) AS n FROM chunks),
    near AS (SELECT h.query_id, b.chunk_id, h.rank * 100000 + CASE WHEN b.n = a.n THEN 0 WHEN b.n < a.n THEN 20000 ELSE 40000 END + b.n AS o FROM heads h JOIN placed a ON a.chunk_id = h.chunk_key JOIN placed b ON b.doc_id = a.doc_id AND abs(b.n - a.n) <= 2)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o, chunk_id) - 1 AS position, chunk_id FROM (SELECT query_id, chunk_id, min(o) AS o FROM near GROUP BY ALL)""",
)
def context_expand(t: Tables) -> DataFrame:
    return context.expand(_found(t), t.chunks()).withColumn("position", F.col("position").cast("long"))


@registered(
    "sources_summary",
    f"""WITH {_FOUND}, {SQL_CHUNKS} SELECT query_id, rank, best_source AS source, chunk_key AS doc_key, score, page_number AS page, heading AS section, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview FROM heads LEFT JOIN chunks ON chunk_id = chunk_key""",
)
def sources_summary(t: Tables) -> DataFrame:
    return context.sources(_told(t)).withColumn("rank", F.col("rank").cast("long"))


@registered(
    "context_string",
    f"""WITH {_FOUND}, {SQL_CHUNKS}, n AS (SELECT query_id, rank, content, heading, page_number, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM heads LEFT JOIN chunks ON chunk_id = chunk_key)
    SELECT query_id, string_agg('[Source ' || i || ' - Page ' || coalesce(page_number::VARCHAR, '?') || ', ' || coalesce(heading, 'Unknown section') || ']' || chr(10) || coalesce(content, '') || chr(10), chr(10) ORDER BY i) AS context FROM n WHERE i <= 5 GROUP BY 1""",
)
def context_string(t: Tables) -> DataFrame:
    return context.context_string(_told(t))


@registered(
    "structured_answer",
    f"""WITH {_FOUND}, {_ASKED}, {SQL_CHUNKS}, n AS (SELECT query_id, score, coalesce(content, '') AS body, heading, page_number, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM heads LEFT JOIN chunks ON chunk_id = chunk_key),
    x AS (SELECT n.*, intent FROM n JOIN qs USING (query_id)), t AS (SELECT * FROM x WHERE i <= 3 AND body <> ''),
    l AS (SELECT query_id, 0 AS part, 0 AS i, CASE intent WHEN 'formula_lookup' THEN '**Formula Response:**' WHEN 'definition' THEN '**Definition:**' ELSE '**Answer:**' END || chr(10) AS line FROM qs
      UNION ALL SELECT query_id, 2, i, chr(10) || '**Context:**' FROM t WHERE intent = 'formula_lookup' AND i = 1
      UNION ALL SELECT query_id, 3, i, chr(10) || CASE WHEN length(body) > 300 THEN substr(body, 1, 300) || '...' ELSE body END FROM t WHERE intent = 'formula_lookup' AND i <= 2
      UNION ALL SELECT query_id, 3, i, body || coalesce(chr(10) || chr(10) || '*Source: Page ' || page_number || '*' || chr(10), '') FROM t WHERE intent = 'definition' AND i <= 2
      UNION ALL SELECT query_id, 3, i, body || chr(10) FROM t WHERE intent NOT IN ('formula_lookup', 'definition')
      UNION ALL SELECT query_id, 6, 0, chr(10) || '**Sources:**' FROM qs
      UNION ALL SELECT query_id, 7, i, '  ' || i || '. ' || coalesce('Page ' || page_number, '') || coalesce(', ' || heading, '') || ' (relevance: ' || printf('%.2f', score) || ')' FROM n WHERE i <= 5)
    SELECT query_id, string_agg(line, chr(10) ORDER BY part, i) AS answer FROM l GROUP BY 1""",
)
def structured_answer(t: Tables) -> DataFrame:
    # the found texts are used nine times
    return context.structured_answer(written(_told(t), "found"), _asked(t))


@registered(
    "confidence_breakdown",
    f"""WITH {_FOUND}, {_ASKED} SELECT query_id, round(coalesce(n, 0) / 10, 6) AS text_coverage, (CASE WHEN query_type IN ('formula', 'mixed') THEN 0 ELSE 1 END)::DOUBLE AS formula_coverage FROM qs LEFT JOIN (SELECT query_id, count(*) AS n FROM heads GROUP BY 1) USING (query_id)""",
)
def confidence_breakdown(t: Tables) -> DataFrame:
    return context.coverage(_told(t), _asked(t))


_INSTRUCTION = "CASE intent " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in rules.INTENT_INSTRUCTIONS.items()) + " END"
_CONTEXT = f"""{_FOUND}, {SQL_CHUNKS}, n AS (SELECT query_id, rank, content, heading, page_number, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM heads LEFT JOIN chunks ON chunk_id = chunk_key),
    told AS (SELECT query_id, string_agg('[Source ' || i || ' - Page ' || coalesce(page_number::VARCHAR, '?') || ', ' || coalesce(heading, 'Unknown section') || ']' || chr(10) || coalesce(content, '') || chr(10), chr(10) ORDER BY i) AS context FROM n WHERE i <= 5 GROUP BY 1)"""


@registered("prompts", f"""WITH {_CONTEXT}, {_ASKED.replace("AS intent FROM", "AS intent, q FROM")} SELECT query_id, {_INSTRUCTION} || chr(10) || chr(10) || 'Question: ' || q || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '') AS prompt FROM qs LEFT JOIN told USING (query_id)""")
def prompts(t: Tables) -> DataFrame:
    return reports.prompt(context.context_string(_told(t)), _asked(t))


@registered(
    "retrieval_explanation",
    f"""WITH {_FOUND}, {_ASKED.replace("AS intent FROM", "AS intent, q FROM")}, c AS (SELECT query_id, best_source AS source, count(*) AS n FROM heads GROUP BY ALL), l AS (SELECT query_id, sum(n)::BIGINT AS total, string_agg('  - ' || source || ': ' || n, chr(10) ORDER BY source) AS by_source FROM c GROUP BY 1)
    SELECT query_id, 'Query: ' || q || chr(10) || 'Type: ' || query_type || chr(10) || 'Intent: ' || intent || chr(10) || 'Keywords: ' || array_to_string({_KEYWORDS}, ', ') || chr(10) || 'Results: ' || coalesce(total, 0) || coalesce(chr(10) || by_source, '') AS explanation FROM qs LEFT JOIN l USING (query_id)""",
)
def retrieval_explanation(t: Tables) -> DataFrame:
    return context.explanation(_found(t), _asked(t))


@registered("retrieval_pages", f"WITH {_FOUND}, {SQL_CHUNKS} SELECT query_id, array_to_string(list_sort(list(DISTINCT page_number)), ',') AS pages FROM heads JOIN chunks ON chunk_id = chunk_key GROUP BY 1")
def retrieval_pages(t: Tables) -> DataFrame:
    return context.pages(_told(t)).select("query_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))
