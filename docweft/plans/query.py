"""Query understanding: one row of text becomes one row of type, intent, domain, keywords, entities and formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions import rules, text


def preprocess(raw: Column) -> Column:
    """Single spaces, no end punctuation but ``? . !``."""
    clean = F.regexp_replace(F.trim(raw), r"\s+", " ")
    return F.when(clean.rlike(r"[?.!]$"), clean).otherwise(F.regexp_replace(clean, r"[.,;:]+$", ""))


def formulas(raw: Column) -> Column:
    """Formula-like parts, repeated ones too, pattern by pattern."""
    return F.concat(*[F.regexp_extract_all(raw, F.lit(p), F.lit(1)) for p in rules.QUERY_FORMULAS])


def has_intent(query: Column) -> Column:
    low = F.lower(query)
    return F.lit(False) | F.exists(F.array(*[F.lit(p) for _, patterns in rules.INTENTS for p in patterns]), lambda p: F.regexp_like(low, p))


def intent(query: Column) -> Column:
    """The first intent of which a pattern is found."""
    low = F.lower(query)
    return text.first_match(low, [(name, "|".join(f"(?:{p})" for p in patterns)) for name, patterns in rules.INTENTS], F.lit("general"))


def query_type(query: Column) -> Column:
    """Formula, diagram, keyword, mixed or text."""
    count = F.size(text.words(query))
    return (
        F.when(text.contains_any(query, rules.QUERY_FORMULA_MARKS), "formula")
        .when(text.contains_any(F.lower(query), rules.DIAGRAM_WORDS), "diagram")
        .when((count <= 3) & (intent(query) == "general"), "keyword")
        .when((F.size(formulas(query)) > 0) & (count > 2), "mixed")
        .otherwise("text")
    )


def keywords(query: Column) -> Column:
    """Words of three and more letters that are no stopwords, and capitalised phrases, in lower case and order."""
    plain = F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z]+$") & (F.length(w) > 2) & ~w.isin(*rules.QUERY_STOPWORDS))
    names = F.transform(F.regexp_extract_all(query, F.lit(rules.BEFORE_WORD + rules.CAPITALISED + rules.AFTER_WORD), F.lit(1)), lambda x: F.lower(x))
    return F.array_sort(F.array_distinct(F.concat(plain, names)))


def entities(query: Column) -> Column:
    """Names before a law or formula, and scientists."""
    after = r"\s+(?:law|equation|theorem|principle|constant|rule)"
    found = [
        F.regexp_extract_all(query, F.lit(rules.BEFORE_WORD + r"([A-Z][a-z]+(?:'s)?)" + after), F.lit(1)),
        F.regexp_extract_all(query, F.lit(rules.BEFORE_WORD + rules.CAPITALISED + r"\s+(?:formula|equation|theorem)"), F.lit(1)),
        F.regexp_extract_all(query, F.lit(rules.BEFORE_WORD + "(" + "|".join(rules.ENTITY_SCIENTISTS) + ")" + rules.AFTER_WORD), F.lit(1)),
    ]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def domain(query: Column, terms: Column) -> Column:
    """The domain with the most of its words among the query's words and keywords; null if none has any."""
    every = F.array_union(terms, text.words(F.lower(query)))
    scores = {d: F.size(F.array_intersect(F.array(*[F.lit(w) for w in words]), every)) for d, words in rules.QUERY_DOMAINS.items()}
    return text.arg_max(scores, F.lit(None).cast("string"))


def expand(terms: Column) -> Column:
    """Keywords with their synonyms."""
    added = [F.when(F.array_contains(terms, k), F.array(*[F.lit(x) for x in more])).otherwise(F.array().cast("array<string>")) for k, more in rules.EXPANSIONS.items()]
    return F.array_sort(F.array_distinct(F.concat(terms, *added)))


def process(queries: DataFrame, query: str = "query_id", raw: str = "text") -> DataFrame:
    """All of the above for a table of queries; a null text is the empty query."""
    rows = queries.select(F.col(query).alias("query_id"), F.coalesce(F.col(raw), F.lit("")).alias("raw_text"))
    rows = rows.withColumn("processed_text", preprocess(F.col("raw_text")))
    q = F.col("processed_text")
    rows = rows.withColumns({"query_type": query_type(q), "intent": intent(q), "keywords": keywords(q), "entities": entities(q), "formulas": formulas(F.col("raw_text"))})
    return rows.withColumn("domain", domain(q, F.col("keywords")))
