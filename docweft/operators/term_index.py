"""Terms like an asked one: an index of shortened forms for short terms and of segments for long ones.

Two terms are alike if few edits, for the longer one's length, make one of the other. Short terms that ``d`` edits part
have a form in common that leaves out at most ``d`` letters of each, so they are filed under such forms. A long term is
cut into one segment more than edits are allowed: one of them must stand unchanged in the other term, near its place.
Only terms that meet in one of these are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.operators.storage import written

#: Edits that shortened forms are made for; pairs that may have more are long.
LEFT_OUT = 2
#: Asked terms whose pieces (some hundred each) are broadcast at most.
FEW = 2_000
_SLACK = 1e-9


@dataclass(frozen=True)
class Terms:
    """The vocabulary (``term``), forms (``form``, ``term``) and segments (``size``, ``part``, ``segment``, ``term``) for a threshold."""

    threshold: float
    terms: DataFrame
    forms: DataFrame
    segments: DataFrame


def _edits(size: Column, threshold: float) -> Column:
    """Edits that a longer term of that length allows."""
    return F.floor(size * F.lit(1 - threshold) + F.lit(_SLACK)).cast("int")


def _short(threshold: float) -> int:
    """The greatest length of a longer term whose edits shortened forms cover."""
    return next(n for n in range(1, 1000) if int((n + 1) * (1 - threshold) + _SLACK) > LEFT_OUT)


def _longest(size: Column, threshold: float) -> Column:
    """The length of the longest term that can be like one of a length."""
    return F.floor(size / F.lit(threshold) + F.lit(_SLACK)).cast("int")


def shortened(term: Column, letters: Column) -> Column:
    """The term and its forms that leave out up to so many letters (two at most)."""
    each = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    one = F.when((letters >= 1) & (F.length(term) >= 1), each(term)).otherwise(F.array().cast("array<string>"))
    two = F.when((letters >= 2) & (F.length(term) >= 2), F.flatten(F.transform(each(term), each))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(term), one, two))


def _cuts(size: Column, edits: Column, part: Column) -> tuple[Column, Column]:
    """Where a part of a term begins (from 0) and how long it is: one part more than edits, the last ones a letter longer."""
    parts = edits + 1
    base = F.floor(size / parts).cast("int")
    shorter = parts - size % parts
    return part * base + F.greatest(F.lit(0), part - shorter), base + F.when(part >= shorter, 1).otherwise(0)


def over(vocabulary: DataFrame, threshold: float = 0.7) -> Terms:
    """The index of a vocabulary (``term``, repeated ones, too) as it is read: nothing is written, for searches of few terms."""
    if threshold < 0.6:
        raise ValueError("under a likeness of 0.6 terms may have no segment in common")
    terms = vocabulary.select("term").filter("term <> ''")
    size = F.length("term")
    most = _edits(F.least(_longest(size, threshold), F.lit(_short(threshold))), threshold)
    forms = terms.filter(size <= _short(threshold)).select(F.explode(shortened(F.col("term"), most)).alias("form"), "term")
    edits = _edits(_longest(size, threshold), threshold)
    long = terms.filter(_longest(size, threshold) > _short(threshold)).select("term", size.alias("size"), edits.alias("edits"))
    long = long.select("term", "size", "edits", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("part"))
    start, width = _cuts(F.col("size"), F.col("edits"), F.col("part"))
    segments = long.select("size", "part", F.substring(F.col("term"), start + 1, width).alias("segment"), "term")
    return Terms(threshold, terms, forms, segments)


def build(vocabulary: DataFrame, threshold: float = 0.7) -> Terms:
    """Writes the index of a vocabulary (``term``)."""
    read = over(written(vocabulary.select("term").filter("term <> ''").distinct(), "terms"), threshold)
    return Terms(threshold, read.terms, written(read.forms.repartitionByRange("form"), "term-forms"), written(read.segments.repartitionByRange("segment"), "term-segments"))


def sent(asked: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How pieces of asked terms go to a vocabulary: by broadcast where these are few, so that it is not shuffled."""
    return F.broadcast if asked.limit(FEW + 1).count() <= FEW else lambda rows: rows


def candidates(index: Terms, asked: DataFrame) -> DataFrame:
    """The pairs of an asked term and a vocabulary term (``asked``, ``term``) that have to be compared."""
    threshold, size = index.threshold, F.length("asked")
    each = asked.select("asked").filter("asked <> ''").distinct()
    short = each.filter(size <= _short(threshold))
    forms = short.select("asked", F.explode(shortened(F.col("asked"), _edits(F.least(_longest(size, threshold), F.lit(_short(threshold))), threshold))).alias("form"))
    to = sent(each)
    near = to(forms).join(index.forms, "form").select("asked", "term")
    # of each length that a term like the asked one may have, the places where its segments may stand in the asked one
    sizes = F.sequence(F.ceil(size * F.lit(threshold) - F.lit(_SLACK)).cast("int"), _longest(size, threshold))
    long = each.filter(_longest(size, threshold) > _short(threshold)).select("asked", F.explode(sizes).alias("size")).filter(F.greatest("size", F.length("asked")) > _short(threshold))
    long = long.withColumns({"edits": _edits(_longest(F.col("size"), threshold), threshold), "allowed": _edits(F.greatest("size", F.length("asked")), threshold)})
    long = long.select("*", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("part"))
    start, width = _cuts(F.col("size"), F.col("edits"), F.col("part"))
    long = long.withColumns({"start": start, "width": width})
    first, last = F.greatest(F.lit(0), F.col("start") - F.col("allowed")), F.least(F.length("asked") - F.col("width"), F.col("start") + F.col("allowed"))
    places = long.withColumns({"first": first, "last": last}).filter("first <= last").select("asked", "size", "part", "width", F.explode(F.sequence("first", "last")).alias("at"))
    places = places.select("asked", "size", "part", F.substring(F.col("asked"), F.col("at") + 1, F.col("width")).alias("segment")).distinct()
    sizes = each.agg(F.min(F.length("asked")), F.max(F.length("asked"))).first()  # one row
    least, most = ((sizes[0] or 0) * threshold - _SLACK, (sizes[1] or 0) / threshold + _SLACK)
    far = to(places).join(index.segments.filter(F.col("size").between(least, most)), ["size", "part", "segment"]).select("asked", "term")
    both = near.filter(F.greatest(F.length("asked"), F.length("term")) <= _short(threshold)).union(far)
    longer = F.greatest(F.length("asked"), F.length("term"))
    return both.filter(F.abs(F.length("asked") - F.length("term")) <= _edits(longer, threshold)).distinct()


def near(index: Terms, asked: DataFrame) -> DataFrame:
    """The pairs whose edits are within the threshold."""
    longer = F.greatest(F.length("asked"), F.length("term"))
    return candidates(index, asked).filter(F.levenshtein("asked", "term") <= (1 - index.threshold) * longer + _SLACK)
