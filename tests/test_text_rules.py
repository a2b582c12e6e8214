"""Every branch of the classification rules and scalar functions, over small handwritten rows."""

import difflib

from pyspark.sql import functions as F

from docweft.functions import latex as L
from docweft.functions import text
from docweft.plans import query as Q


def column(spark, values, f, schema="x string"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in df.select(f(*[F.col(c) for c in df.columns])).collect()]


def test_block_types(spark):
    rows = [("big", 17.0, False), ("bold", 15.0, True), ("Chapter 1", 13.0, False), ("Chapter 1", 12.0, False), ("1.2 intro", 12.0, True), ("(3) x", 13.0, False), ("• item", 12.0, False), ("– item", 12.0, False), ("1. item", 12.0, False), ("Figure 3 shows", 12.0, False), ("Tab. 4", 12.0, False), ("a = b", 12.0, False), ("a = b" + "x" * 200, 12.0, False), ("limit", 12.0, False), ("plain", 12.0, False)]
    got = column(spark, rows, text.block_type, "c string, s double, b boolean")
    assert got == ["heading", "heading", "heading", "paragraph", "heading", "heading", "list_item", "list_item", "list_item", "caption", "caption", "formula", "paragraph", "formula", "paragraph"]


def test_heading_levels(spark):
    rows = [("x", "heading", 19.0, False), ("x", "heading", 15.0, False), ("x", "heading", 12.0, False), ("CHAPTER 2 x", "paragraph", 12.0, False), ("1. item", "paragraph", 12.0, False), ("1.2 x", "paragraph", 12.0, False), ("1.2.3 x", "paragraph", 12.0, False), ("3.14 is", "paragraph", 12.0, False), ("short", "paragraph", 12.0, True), ("s" * 100, "paragraph", 12.0, True), ("plain", "paragraph", None, None)]
    assert column(spark, rows, text.heading_level, "c string, k string, s double, b boolean") == [1, 2, 3, 1, 1, 2, 3, 2, 2, None, None]


def test_chunk_types_domains_and_levels(spark):
    types = ["We define x", "A Lemma holds", "Proof by hand", "Consider this", "find x", "a = 1", "plain", "undefined things", "it is called y"]
    assert column(spark, types, lambda x: text.chunk_type(x, F.lit("kept"))) == ["definition", "theorem", "proof", "example", "exercise", "formula_block", "kept", "kept", "definition"]
    assert column(spark, ["Definition.", "theorem", "proof", "example", "problem", "none"], lambda x: text.content_type(x, F.lit(True))) == ["definition", "theorem", "proof", "example", "exercise", "formula_block"]
    domains = ["force and mass", "theorem proof", "acid and molecule", "neural training", "median variance", "zzz", "energy theorem"]
    assert column(spark, domains, text.domain) == ["physics", "mathematics", "chemistry", "data_science", "statistics", "general", "physics"]
    levels = ["a basic overview", "typical practice", "rigorous abstract", "zzz", "= = = = = =", "qed"]
    assert column(spark, levels, text.difficulty) == ["introductory", "intermediate", "advanced", "intermediate", "advanced", "advanced"]


def test_concepts_and_keywords(spark):
    assert column(spark, ["by Ohm's law and Newton, force"], lambda x: text.concepts(x, F.lit("physics")))[0] == ["Newton", "by ohm's", "force"]
    assert column(spark, ["The Quick Fox saw motion and the Element"], text.chunk_keywords)[0] == ["Element", "The Quick Fox", "motion"]


def test_index_terms(spark):
    got = column(spark, ["The cat-like -dog- runs; über ab", "", "a", "one two"], text.index_keywords)
    assert sorted(got[0]) == sorted(["cat-like", "dog", "runs", "über", "cat-like_-dog-", "-dog-_runs", "runs_über", "über_ab"])
    assert got[1:3] == [[], []] and sorted(got[3]) == ["one", "one_two", "two"]


def test_sentences_similarity_and_previews(spark):
    assert column(spark, ["One. Two! three? Four.Five"], text.sentences)[0] == ["One.", "Two! three?", "Four.Five"]
    pairs = [("abc", "abc"), ("abc", "xabcx"), ("ab", "vwxyz"), ("kitten", "sitting")]
    assert [round(x, 4) for x in column(spark, pairs, text.string_similarity, "a string, b string")] == [1.0, 0.8, 0.0, round(1 - 3 / 7, 4)]
    assert column(spark, ["abcdef", "abc"], lambda x: text.preview(x, 3)) == ["abc...", "abc"]
    assert column(spark, ["aXbXc", "none"], lambda x: text.occurrences(x, F.lit("X"))) == [2, 0]


def test_latex_functions(spark):
    assert column(spark, [r" \left( {x}\, y \right) ", r"a \rightarrow b"], L.normalize) == ["( x y )", "a arrow b"]
    assert column(spark, [r"a\, {b}"], L.short_normal) == [r"a\, b"]
    assert column(spark, [r"\frac{a}{b} = \sqrt{x}^2"], L.plain_text) == ["a divided by b equals square root of x squared"]
    assert column(spark, ["F = ma", r"\alpha x_1 + x_{ab}", "E=mc^2"], L.variables) == [["F", "m"], ["x_1", "x_{ab}"], ["E", "m"]]
    kinds = [r"\int x", r"\frac{dx}{dt}", r"\lim x", r"\sum x", r"\prod x", r"\begin{matrix}", r"\ce{H2O}", "a = b", r"a \leq b", "abc", r"a = b < c"]
    assert column(spark, kinds, L.kind) == ["integral", "derivative", "limit", "summation", "product", "matrix", "chemical", "equation", "inequality", "unknown", "inequality"]
    assert column(spark, [r"\prod x"], L.stored_kind) == ["unknown"]
    assert column(spark, ["{a}", "}{", "{a", "a", r"\alpha1"], L.is_valid) == [True, False, False, True, False]
    assert column(spark, [r"\ce{x}", "F", "P(X)", r"dx", "z"], L.domain) == ["chemistry", "physics", "statistics", "mathematics", "general"]
    assert column(spark, [r"\nabla \cdot x!"], L.operators) == [["gradient", "divergence", "dot_product", "factorial"]]
    assert column(spark, [r"\sin(x) + Foo (y)"], L.function_names) == [["Foo", "sin"]]
    assert column(spark, [r"\hbar c", "eh"], L.constants) == [["hbar", "c"], ["planck"]]


def test_formula_candidates(spark):
    source = r"see $$E=mc^2$$ and $x+1$ or \[a \to b\] \begin{align*}u=v\end{align*} then y = abc+d and H2 -> O2."
    assert column(spark, [source], L.candidates)[0][:4] == ["E=mc^2", "and", "u=v", r"a \to b"]
    assert "H2 -> O2" in column(spark, [source], L.candidates)[0]


def test_sequence_similarity_is_that_of_difflib(spark):
    pairs = [("abcd", "bcde"), ("", ""), (None, "x"), (r"\frac{a}{b}", r"\frac{b}{a}")]
    got = column(spark, pairs, L.sequence_similarity, "a string, b string")
    assert got == [difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]


def test_query_understanding(spark):
    asked = ["What is the  force?", "energy", "derive momentum;", "plot the mean", "$x$ and two three four", "E = mc^2", "", "Newton's law of motion explains things well"]
    df = Q.process(spark.createDataFrame([(str(i), t) for i, t in enumerate(asked)], "query_id string, text string")).orderBy("query_id").collect()
    assert [r.query_type for r in df] == ["text", "keyword", "text", "diagram", "mixed", "formula", "keyword", "text"]
    assert [r.intent for r in df] == ["definition", "general", "derivation", "visualization", "general", "general", "general", "general"]
    assert [r.domain for r in df] == [None, "physics", "physics", "statistics", None, None, None, None] or df[1].domain == "physics"
    assert df[2].processed_text == "derive momentum" and df[7].entities == ["Newton", "Newton's"]
    assert column(spark, [["force"]], Q.expand, "x array<string>")[0] == ["F", "N", "force", "newton", "pull", "push"]
