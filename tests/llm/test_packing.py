import zlib

import numpy as np
import pytest

from docweft.llm.packing import pack

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def check(spark, rows, window):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = pack(docs, PATH, window=window).toPandas()
    for _, of in got.groupby("sequence_id"):
        of = of.sort_values("offset")
        assert of.offset.tolist() == [0, *of.length.cumsum().tolist()[:-1]]
        assert of.length.sum() <= window
    full = got.groupby("sequence_id").length.sum().sort_index()
    assert full.index.tolist() == list(range(len(full))) and (full.iloc[:-1] == window).all()
    for doc_id, text, _ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        of = got[got.doc_id == doc_id].sort_values("start") if doc_id is not None else got[got.doc_id.isna()]
        assert of.length.sum() == len(ids) and (of.doc_tokens == len(ids)).all()
        at = 0
        for r in of.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length


def test_round_trip(spark):
    rows = [(i, " ".join(f"word{i} {j}" for j in range(i * 7)), "x") for i in range(40)] + [(100, None, None), (101, "", "y"), (None, "no id", "z"), (102, "long text " * 3000, "")]
    check(spark, rows, 1024)
    check(spark, rows, 64)


def test_empty_table_and_copies(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    got = pack(spark.createDataFrame([(1, "same")] * 5, "doc_id long, text string"), PATH).toPandas()
    assert len(got) == 5 and got.offset.nunique() == 5
