"""The index that follows changing documents against a full build."""

from __future__ import annotations

import random

from docweft.operators import keyword_index
from docweft.streaming import versions

SCHEMA = "doc_id long, version long, text string, note string"


def _expected(rows):
    last = {}
    for doc_id, version, text, _ in rows:
        if doc_id is not None and version is not None and (doc_id not in last or version > last[doc_id][0]):
            last[doc_id] = (version, text)
    return [(i, t) for i, (_, t) in last.items() if t is not None]


def _postings(index):
    return {tuple(r) for r in index.postings.select("term", "doc_id", "dl", "df").collect()}


def test_changed_documents_give_what_a_full_build_gives(spark, tmp_path):
    rng = random.Random(1)
    words = ["momentum", "energy", "entropy", "field", "matrix", "acid", "tensor"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    rounds = [
        [(i, 1, text(), "n") for i in range(40)] + [(None, 1, "lost", "n"), (99, None, "lost", "n")],
        [(i, 1, None, "late") for i in range(0)] + [(i, 2, text(), "n") for i in range(0, 40, 3)] + [(5, 2, None, "deleted"), (6, 3, "", "empty")],
        [(5, 1, "energy again", "too late"), (6, 2, "matrix", "too late"), (7, 2, "acid", "n"), (50, 1, "tensor tensor field", "new")],
        [(7, 2, "acid", "twice"), (5, 4, "back field", "n")],
    ]
    folder, source, sent = f"file://{tmp_path}/index", f"{tmp_path}/in", []
    for n, rows in enumerate(rounds):
        sent += rows
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(source)
        # each round is a stream of its own that goes on from the checkpoint, as after a restart
        versions.follow(spark.readStream.schema(SCHEMA).parquet(source), folder)
        if n == 1:
            assert versions.compact(spark, folder) == versions.compact(spark, folder) == 1
        whole = keyword_index.build(keyword_index.terms(spark.createDataFrame(_expected(sent), "doc_id long, text string"), "doc_id"), "doc_id")
        held = versions.index(spark, folder)
        assert _postings(held) == _postings(whole)
        assert held.totals.first() == whole.totals.first()
    deltas = spark.read.schema(versions.POSTING + ", batch long").parquet(f"{folder}/deltas")
    assert deltas.filter("sign < 0").count() > 0 and deltas.filter("batch = 3 AND doc_id = 7").count() == 0
    asked = spark.createDataFrame([(1, ["field", "energy"])], "query_id long, terms array<string>")
    assert keyword_index.bm25(held, asked, "query_id").collect() == keyword_index.bm25(whole, asked, "query_id").collect()


def test_one_version_of_several_in_a_batch(spark, tmp_path):
    rows = [(1, 1, "energy", ""), (1, 3, "matrix", ""), (1, 2, "acid", ""), (2, 1, None, "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in")
    versions.follow(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/index")
    assert {r.term for r in versions.document_frequency(spark, f"file://{tmp_path}/index").collect()} == {"matrix"}


def test_a_changed_document_costs_its_new_postings_and_a_mark(spark, tmp_path):
    folder, source = f"file://{tmp_path}/index", f"{tmp_path}/in"
    for rows in ([(1, 1, "energy matrix acid", ""), (2, 1, "tensor", "")], [(1, 2, "field", ""), (2, 2, None, "")]):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
        versions.follow(spark.readStream.schema(SCHEMA).parquet(source), folder)
    deltas = spark.read.schema(versions.POSTING + ", batch long").parquet(f"{folder}/deltas")
    assert {(r.doc_id, r.term, r.sign) for r in deltas.filter("batch = 1").collect()} == {(1, None, 1), (1, "field", 1), (2, None, -1)}
    assert "terms" not in versions._STATE  # the state does not grow with the texts
    assert {tuple(r) for r in versions.document_frequency(spark, folder).collect()} == {("field", 1)}
    versions.compact(spark, folder)
    assert {tuple(r) for r in versions.live(spark, folder).collect()} == {(1, None, 1), (1, "field", 1)}
