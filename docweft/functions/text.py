"""Column functions over plain text: classification, keywords, sentences, similarity and previews."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.functions import rules

SPACES = r"\s+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def contains_any(text: Column, marks: Iterable[str]) -> Column:
    """Whether the text has any of the marks as a substring."""
    return functools.reduce(lambda x, y: x | y, [F.contains(text, F.lit(m)) for m in marks], F.lit(False))


def count_contained(text: Column, marks: Iterable[str]) -> Column:
    """How many of the marks the text has as substrings."""
    return functools.reduce(lambda x, y: x + y, [F.contains(text, F.lit(m)).cast("int") for m in marks], F.lit(0))


def occurrences(text: Column, part: Column) -> Column:
    """How often a part occurs in the text, not overlapping."""
    return F.when(part == "", F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))


def first_match(text: Column, patterns: Iterable[tuple[str, str]], otherwise: Column) -> Column:
    """The name of the first pattern that is found in the text."""
    chain = F
    for name, pattern in patterns:
        chain = chain.when(text.rlike(pattern), F.lit(name))
    return chain.otherwise(otherwise)


def arg_max(scores: dict[str, Column], otherwise: Column) -> Column:
    """The name with the highest score; of equals the first; ``otherwise`` if none is above 0."""
    ranked = F.array(*[F.struct(score.alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, score) in enumerate(scores.items())])
    # the array of one element binds the best score, so that every score is computed once
    best = F.transform(F.array(F.array_max(ranked)), lambda b: F.when(b["score"] > 0, b["name"]).otherwise(otherwise))
    return F.element_at(best, 1)


def block_type(content: Column, font_size: Column, bold: Column) -> Column:
    """Heading, list item, caption, formula or paragraph, from content and style."""
    low = F.lower(F.trim(content))
    numbered = F.exists(F.array(*[F.lit(p) for p in rules.HEADING_PATTERNS]), lambda p: F.regexp_like(low, p))
    bullet = F.substring(low, 1, 1).isin(*rules.BULLETS)
    return (
        F.when((font_size > 16) | ((font_size > 14) & bold), "heading")
        .when(numbered & ((font_size > 12) | bold), "heading")
        .when(bullet | low.rlike(rules.NUMBERED_ITEM), "list_item")
        .when(low.rlike(rules.CAPTION), "caption")
        .when(contains_any(content, rules.FORMULA_MARKS) & (F.length(content) < rules.FORMULA_BLOCK_CHARS), "formula")
        .otherwise("paragraph")
    )


def heading_level(content: Column, kind: Column, font_size: Column, bold: Column) -> Column:
    """1 to 3 for headings, null for other blocks."""
    content = F.trim(content)
    number = r"^(\d+)\.(\d+)?(\.(\d+))?"
    by_number = F.when(F.regexp_extract(content, number, 4) != "", 3).when(F.regexp_extract(content, number, 2) != "", 2).otherwise(1)
    by_size = F.when(F.coalesce(font_size, F.lit(0)) > 18, 1).when(F.coalesce(font_size, F.lit(0)) > 14, 2).otherwise(3)
    return (
        F.when(kind == "heading", by_size)
        .when(content.rlike(r"(?i)^chapter\s+\d+"), 1)
        .when(content.rlike(number), by_number)
        .when(F.coalesce(bold, F.lit(False)) & (F.length(content) < 100), 2)
    )


def content_type(content: Column, has_formula: Column) -> Column:
    """The type that a chunk gets when it is cut."""
    return first_match(F.lower(content), rules.CONTENT_TYPES, F.when(has_formula, "formula_block").otherwise("paragraph"))


def chunk_type(content: Column, prior: Column) -> Column:
    """The type that a chunk gets when it is enriched; ``prior`` if no rule fits."""
    return first_match(F.lower(content), rules.CHUNK_TYPES, F.when(contains_any(content, rules.CHUNK_FORMULA_MARKS), "formula_block").otherwise(prior))


def domain(content: Column) -> Column:
    """The domain with the most keywords among the text's substrings, else general."""
    return bound(F.lower(content), lambda low: arg_max({d: count_contained(low, words) for d, words in rules.DOMAIN_KEYWORDS.items()}, F.lit("general")))


def difficulty(content: Column) -> Column:
    """Introductory, intermediate or advanced, from indicator words and formulas."""

    def level(low: Column) -> Column:
        score = {name: count_contained(low, words) for name, words in rules.DIFFICULTY_WORDS.items()}
        marks = occurrences(low, F.lit("=")) + occurrences(low, F.lit("∫"))
        score["advanced"] = score["advanced"] + F.when(marks > 5, 2).otherwise(0) + F.when(low.rlike(rules.PROOF_MARKS), 3).otherwise(0)
        return arg_max(score, F.lit("intermediate"))

    return bound(F.lower(content), level)


def concepts(content: Column, domain_name: Column) -> Column:
    """Named laws, keywords of the domain and scientists of a chunk: the first ten in order."""
    none = F.array().cast("array<string>")
    by_domain = F.create_map(*[x for name, words in rules.DOMAIN_KEYWORDS.items() for x in (F.lit(name), F.array(*[F.lit(w) for w in words]))])
    known = F.concat(F.coalesce(F.try_element_at(by_domain, domain_name), none), F.array(*[F.lit(p) for p in rules.CONCEPT_SCIENTISTS]))

    def found(low: Column) -> Column:
        # the pattern is tried only where one of its last words occurs at all
        named = F.when(contains_any(low, rules.LAW_WORDS), F.regexp_extract_all(low, F.lit(rules.NAMED_LAW), F.lit(1))).otherwise(none)
        return F.slice(F.array_sort(F.array_distinct(F.concat(named, F.filter(known, lambda w: F.contains(low, F.lower(w)))))), 1, 10)

    return bound(F.lower(content), found)


def chunk_keywords(content: Column) -> Column:
    """Capitalised phrases and abstract nouns of a chunk: the first twenty in order."""
    found = F.concat(
        F.regexp_extract_all(content, F.lit(rules.BEFORE_WORD + rules.CAPITALISED + rules.AFTER_WORD), F.lit(1)),
        F.regexp_extract_all(content, F.lit(rules.BEFORE_WORD + rules.ABSTRACT_NOUN + rules.AFTER_WORD), F.lit(1)),
    )
    kept = F.filter(F.array_distinct(found), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*rules.CHUNK_STOPWORDS))
    return F.slice(F.array_sort(kept), 1, 20)


def words(text: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def index_keywords(text: Column) -> Column:
    """The set of index terms: words of three and more letters, and pairs of neighbours joined by ``_``; no stopwords."""
    stop = rules.INDEX_STOPWORDS

    def terms(tokens: Column) -> Column:
        single = F.filter(F.transform(tokens, lambda w: F.btrim(w, F.lit("-"))), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
        pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.when(b.isNotNull() & ~a.isin(*stop) & ~b.isin(*stop), F.concat(a, F.lit("_"), b)))
        return F.array_distinct(F.concat(single, F.filter(pairs, lambda p: p.isNotNull())))

    return bound(words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]", " ")), terms)


def sentences(text: Column) -> Column:
    """Sentences: cut after ``.!?`` where white space and a capital follow."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(s)), lambda s: s != "")


def string_similarity(a: Column, b: Column) -> Column:
    """1 for equal strings, 0.8 if one contains the other, else 1 - edit distance / longer length (0 if lengths differ by half)."""
    longer = F.greatest(F.length(a), F.length(b))
    gap = F.abs(F.length(a) - F.length(b))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.8).when(gap > longer * 0.5, 0.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def preview(text: Column, size: int) -> Column:
    """The text, cut to ``size`` characters and marked where it is longer."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalised(vector: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def jaccard(a: Column, b: Column) -> Column:
    """The share of common elements; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
