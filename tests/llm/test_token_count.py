import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import docweft.llm.token_count as tc

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ODD = ["", " ", "  ", "a", "don't we'll I'VE they're 's 'sx 't' ''s 'll'd", " 'tis  \n\n x", "a  <|endoftext|>  b<|endoftext|><|endoftext|>", "aaaaaaaaaaaaaaaaa" * 30, "x" * 70, "é ß 中文字 हिन्दी १२३ ½ 𝟘 👍🏽", "tab\t\tx y  z\r\n", "1234 5,6.7e-8", "​zero﻿", "é", "'", "a'", "\n'", "\n's b", " 　'll"]


def test_counts_and_ids_equal_the_library(library):
    bpe = tc.ByteBPE(PATH)
    for texts in (ODD, ODD[::-1], [t * 3 for t in ODD]):
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in bpe.encode(texts)] == want
        assert bpe.counts(texts).tolist() == list(map(len, want))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'strevmldaé1,<|>endofx"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40), max_size=6))
def test_any_text(library, texts):
    bpe = tc.vocabulary(PATH)
    assert [x.tolist() for x in bpe.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_slices_and_cache_limits(library, monkeypatch):
    monkeypatch.setattr(tc, "CACHE_IDS", 20)
    bpe = tc.ByteBPE(PATH)
    texts = ["the cat sat", "on the mat " * 20, "", "zebra<|endoftext|>"] * 5
    parts = [bpe.counts([t])[0] for t in texts]
    assert parts == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_equal_keys_do_not_mix_texts_up(library, monkeypatch):
    monkeypatch.setattr(tc.ByteBPE, "_keys", lambda self, points, begin, end: (end - begin).astype(tc.np.uint64) % tc.np.uint64(3) * tc.np.uint64(2) + tc.np.uint64(1))
    bpe = tc.ByteBPE(PATH)
    for texts in (ODD, ODD[::-1], ["the cat sat on a mat but the dog did not"] * 3):
        assert [x.tolist() for x in bpe.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_rows(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (None, "", "y"), (1, "a b c", "x"), (5, "word " * 600, None)]
    got = tc.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    assert sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got)) == [(0, 0, 0, False), (1, 5, 3, False), (1, 5, 3, False), (2, 0, 0, False), (5, 3000, 601, True)]
    assert tc.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
