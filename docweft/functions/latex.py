"""Column functions over LaTeX formulas."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.functions import rules
from docweft.functions.text import contains_any


def _replaced(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement.replace("<", "$").replace(">", ""))
    return text


def normalize(latex: Column) -> Column:
    """The form in which formulas are compared: single spaces, no sizing or spacing commands, no braces around one letter."""
    return _replaced(F.trim(latex), rules.NORMAL_STEPS)


def short_normal(latex: Column) -> Column:
    """The first three steps of ``normalize``: a formula's own normal form, which keeps spacing commands."""
    return _replaced(F.trim(latex), rules.NORMAL_STEPS[:3])


def plain_text(latex: Column) -> Column:
    """The formula in words."""
    return F.trim(_replaced(latex, rules.PLAIN_TEXT))


def variables(latex: Column) -> Column:
    """Distinct letters that no command or other letter precedes, with their subscripts, in order of text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(latex, F.lit(rules.VARIABLE), F.lit(1))))


def _named(latex: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    return F.filter(F.array(*[F.when(latex.rlike(p), F.lit(n)) for n, p in patterns]), lambda x: x.isNotNull())


def operators(latex: Column) -> Column:
    return _named(latex, rules.OPERATORS)


def constants(latex: Column) -> Column:
    return _named(latex, rules.CONSTANTS)


def function_names(latex: Column) -> Column:
    found = [F.regexp_extract_all(latex, F.lit(p), F.lit(1)) for p in rules.FUNCTIONS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def kind(latex: Column) -> Column:
    """The class of a formula by the first rule that fits."""
    chain = F
    for name, found, absent in rules.FORMULA_TYPES:
        fits = latex.rlike(found)
        chain = chain.when(fits & ~latex.rlike(absent) if absent else fits, F.lit(name))
    return chain.otherwise("unknown")


def stored_kind(latex: Column) -> Column:
    """``kind`` as formula records hold it."""
    return F.when(kind(latex) == rules.UNSTORED_FORMULA_TYPE, "unknown").otherwise(kind(latex))


def domain(latex: Column) -> Column:
    chain = F
    for name, marks in rules.FORMULA_DOMAINS:
        chain = chain.when(contains_any(latex, marks), F.lit(name))
    return chain.otherwise("general")


def is_valid(latex: Column) -> Column:
    """Braces balance and never close first, and no command has a foreign character."""
    braces = F.aggregate(
        F.split(F.regexp_replace(latex, r"[^{}]", ""), ""),
        F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok")),
        lambda s, c: F.struct(
            (s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"),
            (s["ok"] & (s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0) >= 0)).alias("ok"),
        ),
    )
    return braces["ok"] & (braces["depth"] == 0) & ~latex.rlike(rules.INVALID_LATEX)


def signature(operator_names: Column, functions: Column) -> Column:
    """Sorted operators, then sorted functions, joined by colons."""
    return F.array_join(F.concat(F.array_sort(operator_names), F.array_sort(functions)), ":")


def formula_id(latex: Column) -> Column:
    return F.concat(F.lit("F_"), F.substring(F.md5(latex), 1, 8))


def candidates(text: Column) -> Column:
    """Formulas in a text: delimited ones, then bare assignments and reactions; the first of equal forms."""
    delimited = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(g)), lambda x: F.trim(x)) for p, g in rules.DELIMITED_FORMULAS])
    delimited = F.array_distinct(F.filter(delimited, lambda x: F.length(x) > 2))
    bare = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda x: F.trim(x)) for p in rules.BARE_FORMULAS])
    bare = F.filter(bare, lambda x: (F.length(x) > 3) & ~F.array_contains(delimited, normalize(x)))
    # of bare forms that read alike once normalised, the first
    forms = F.transform(bare, lambda x: normalize(x))
    first = F.filter(F.transform(bare, lambda x, i: F.when(F.array_position(forms, normalize(x)) == i + 1, x)), lambda x: x.isNotNull())
    return F.concat(delimited, first)


#: From so many letters on, matching leaves out letters that are frequent; such texts are compared one by one.
LONG = 200
#: Pairs of short texts that are compared at once.
PAIRS = 2048


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of columns the longest common run: where it begins in both, first ones first, and its length."""
    width, n = b.shape
    run, size = np.zeros((width + 1, n), np.uint8), np.zeros(n, np.uint8)
    i, j = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at in range(len(a)):
        run[1:] = (run[:-1] + np.uint8(1)) * (b == a[at])
        found = run.max(0)
        better = np.flatnonzero(found > size)
        if len(better):
            size[better] = found[better]
            i[better] = at + 1 - found[better].astype(np.int64)
            j[better] = run[:, better].argmax(0) - found[better].astype(np.int64)
    return i, j, size.astype(np.int64)


def _matched(left: list[str], right: list[str]) -> np.ndarray:
    """How many letters the matching blocks of short texts have: the longest common run, then the same before and behind it."""
    letters = lambda texts: np.array(texts, dtype=f"U{max(1, *map(len, texts))}").view(np.uint32).reshape(len(texts), -1).T
    a, b, total = letters(left), letters(right), np.zeros(len(left), np.int64)
    known = np.unique(np.concatenate([a.ravel(), b.ravel()]))
    a, b = (np.searchsorted(known, x).astype(np.int32 if len(known) > 1 << 14 else np.int16) for x in (a, b))
    pair = np.arange(len(left))
    a_from, b_from = np.zeros_like(pair), np.zeros_like(pair)
    a_to, b_to = np.fromiter(map(len, left), np.int64), np.fromiter(map(len, right), np.int64)

    def parts(x: np.ndarray, first: np.ndarray, last: np.ndarray, none: int) -> np.ndarray:
        """The parts of columns, from the top."""
        at = first + np.arange((last - first).max())[:, None]
        return np.where(at < last, x[np.minimum(at, len(x) - 1), pair], x.dtype.type(none))

    while True:
        open_ = (a_from < a_to) & (b_from < b_to)
        pair, a_from, a_to, b_from, b_to = (x[open_] for x in (pair, a_from, a_to, b_from, b_to))
        if not len(pair):
            return total
        i, j, size = _longest(parts(a, a_from, a_to, -1), parts(b, b_from, b_to, -2))
        np.add.at(total, pair, size)
        some = size > 0
        i, j = i + a_from, j + b_from
        pair, i, j, size, a_from, a_to, b_from, b_to = (x[some] for x in (pair, i, j, size, a_from, a_to, b_from, b_to))
        pair = np.concatenate([pair, pair])
        a_from, a_to = np.concatenate([a_from, i + size]), np.concatenate([i, a_to])
        b_from, b_to = np.concatenate([b_from, j + size]), np.concatenate([j, b_to])


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """The ratios of matching blocks of pairs of texts, as ``difflib`` has them."""
    out = np.ones(len(left))
    size = np.fromiter((max(len(x), len(y)) for x, y in zip(left, right, strict=True)), np.int64, len(left))
    order = np.argsort(size, kind="stable")
    short = order[(size[order] > 0) & (size[order] < LONG)]
    for at in range(0, len(short), PAIRS):
        part = short[at : at + PAIRS]
        x, y = [left[i] for i in part], [right[i] for i in part]
        out[part] = 2.0 * _matched(x, y) / np.fromiter((len(u) + len(v) for u, v in zip(x, y, strict=True)), np.int64, len(part))
    for i in order[size[order] >= LONG]:
        out[i] = difflib.SequenceMatcher(None, left[i], right[i]).ratio()
    return out


def sequence_similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two strings (Ratcliff and Obershelp); no built-in function computes it."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series(ratios([x or "" for x in left], [y or "" for y in right]))

    return ratio(a, b)


def parsed(latex: Column, parser: Callable[[str], str | None] | None = None) -> Column:
    """The expression that a computer-algebra parser makes of a formula; null without a parser or where it fails."""
    if parser is None:
        return F.lit(None).cast("string")

    @F.pandas_udf("string")
    def parse(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else parser(text)
            except Exception:  # a parser may fail in any way on any input
                return None

        return texts.map(one)

    return parse(latex)
