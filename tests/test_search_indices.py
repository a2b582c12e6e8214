"""The keyword index in blocks and the term index, against plain BM25 and all pairs."""

from __future__ import annotations

import random

import pytest

from docweft.operators import block_index, form_index, keyword_index, term_index


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(600)]
    weights = [1 / (i + 1) for i in range(600)]
    rows = [(i, sorted(set(rng.choices(words, weights, k=rng.randint(0, 60))))) for i in range(1500)]
    return keyword_index.build(spark.createDataFrame(rows, "doc_id long, terms array<string>"), "doc_id")


@pytest.mark.parametrize(("size", "k"), [(3, 5), (12, 10)])
def test_blocks_give_the_rows_of_plain_bm25(spark, index, size, k):
    rng = random.Random(size)
    asked = [(i, [f"w{int(600 ** rng.random())}" for _ in range(size)]) for i in range(25)] + [(90, []), (91, ["unknown"]), (92, ["w599"])]
    queries = spark.createDataFrame(asked, "query_id long, terms array<string>").selectExpr("query_id", "array_distinct(terms) AS terms")
    blocks = block_index.build(index)
    found, work = block_index.bm25(blocks, queries, "query_id", k)
    plain = keyword_index.bm25(index, queries, "query_id", k)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    spent = work.first()
    assert spent.asked_postings == index.postings.join(queries.selectExpr("query_id", "explode(terms) AS term"), "term").count()
    assert spent.joined_postings + spent.completed_postings < (0.6 if size == 3 else 0.9) * spent.asked_postings


def test_only_asked_buckets_are_read(spark, index):
    blocks = block_index.build(index)
    plan = blocks.table.filter("bucket IN (3, 4)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert blocks.table.select("bucket").distinct().count() <= block_index.BUCKETS


def test_blocks_hold_every_posting_once_without_its_frequency(spark, index):
    blocks = block_index.build(index)
    assert not {"idf", "best"} & set(blocks.table.columns)
    assert blocks.terms.agg({"n": "sum"}).first()[0] == index.stored.count()
    assert blocks.table.groupBy("term", "range").count().filter("count > 1").isEmpty()


def test_no_rows_and_no_queries(spark, index):
    empty = keyword_index.build(spark.createDataFrame([], "doc_id long, terms array<string>"), "doc_id")
    queries = spark.createDataFrame([(1, ["w1"])], "query_id long, terms array<string>")
    assert block_index.bm25(block_index.build(empty), queries, "query_id")[0].count() == 0
    assert block_index.bm25(block_index.build(index), queries.limit(0), "query_id")[0].count() == 0


@pytest.mark.parametrize("threshold", [0.6, 0.7, 0.85])
def test_like_terms_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdef") for _ in range(rng.randint(1, 22))) for _ in range(150)} | {"é" * 9, "a" * 40}
    for word in sorted(words)[:]:
        letters = list(word)
        for _ in range(rng.randint(1, 1 + len(word) // 3)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        words.add("".join(letters))
    words.discard("")
    asked = rng.sample(sorted(words), 90)
    frame = lambda rows, name: spark.createDataFrame([(w,) for w in rows], f"{name} string")
    index = term_index.build(frame(words, "term"), threshold)
    found = {(r.asked, r.term) for r in term_index.near(index, frame(asked, "asked")).collect()}
    assert found == {(a, b) for a in asked for b in words if _edits(a, b) <= (1 - threshold) * max(len(a), len(b)) + 1e-9}


def test_few_pairs_are_compared(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(3, 14))) for _ in range(3000)})
    frame = lambda rows, name: spark.createDataFrame([(w,) for w in rows], f"{name} string")
    index = term_index.build(frame(words, "term"))
    assert term_index.candidates(index, frame(words[::20], "asked")).count() < 0.05 * len(words) * len(words[::20])


def test_likest_texts_of_few_compared_pairs(spark):
    import difflib

    rng = random.Random(7)
    parts = [r"\frac{a}{b}", "x^2", r"\sin(t)", "= y", r"\sum_{i} k_i", "+ 3", r"\alpha", "m c", r"\int_0^1 f(u) du", "- z"]
    forms = sorted({" ".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(500)})
    asked = [*rng.sample(forms, 20), "x^2 + y^2", "q"]
    frame = lambda rows, name: spark.createDataFrame([(w,) for w in rows], f"{name} string")
    compared = form_index.likest(frame(forms, "form"), frame(asked, "asked"), 5, 0.1)
    found = compared.collect()
    assert len({(r.asked, r.form) for r in found}) == len(found) < 0.35 * len(forms) * len(asked)
    for text in asked:
        score = {f: round(difflib.SequenceMatcher(None, text, f).ratio(), 6) for f in forms}
        last = sorted(score.values(), reverse=True)[4]
        assert {r.form for r in found if r.asked == text and r.among} == {f for f in forms if score[f] >= last and score[f] > 0.1}


def test_index_is_written_once_without_a_shuffle(spark, monkeypatch):
    tables = []

    def kept(df, name, compression=None):
        tables.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name, compression)

    written = keyword_index.written
    monkeypatch.setattr(keyword_index, "written", kept)
    rows = [(i, [f"w{j}" for j in range(i)]) for i in range(6)]
    built = keyword_index.build(spark.createDataFrame(rows, "doc_id long, terms array<string>"), "doc_id")
    large = [plan for name, plan in tables if name != "keyword-totals"]
    assert len(large) == 1 and "Exchange" not in large[0]
    assert tuple(built.totals.first()) == (6, 2.5)
    assert {(r.term, r.df) for r in built.postings.collect()} == {(f"w{j}", 5 - j) for j in range(5)}
