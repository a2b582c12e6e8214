"""The entry file, plans of headline queries, and independence of the training-data subpackage."""

import ast
import pathlib

import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent
SF = "/root/testdata/sf0.001"

needs_data = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="the given tables are not here")


def test_names_of_queries_and_sql():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 70


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ["bm25_topk", "formula_dependencies", "related_scored", "related_proofs", "formula_chunk_link", "keyword_fuzzy", "bbox_iou", "chat_answer"])
def test_no_cartesian_product_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "Python" not in text and "Pandas" not in text


@needs_data
def test_top_k_is_ranked_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["bm25_topk"](spark, SF))


@needs_data
def test_scans_read_only_what_is_needed(spark):
    text = plan(entry.queries()["chunk_hash"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


@needs_data
@pytest.mark.parametrize("name", ["vector_ivf_topk", "vector_graph_topk"])
def test_approximate_search_reaches_its_recall(spark, name):
    exact = {(r.query_id, r.vec_id) for r in entry.queries()["vector_topk"](spark, SF).collect()}
    near = {(r.query_id, r.vec_id) for r in entry.queries()[name](spark, SF).collect()}
    assert len(near) == len(exact) and len(exact & near) >= 0.9 * len(exact)


def test_nothing_else_imports_the_training_data_package():
    for path in (ROOT / "docweft").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "docweft").parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n.split(".") for n in names), path


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, SF).toArrow().to_pylist()
    found = connection.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = [dict(zip(columns, row)) for row in found.fetchall()]
    rows = lambda table: sorted((repr([(k, round(v, 6) if isinstance(v, float) else v) for k, v in sorted(r.items())]) for r in table))
    assert rows(got) == rows(want)
