"""Problem 7: exact round trip, offsets against the library, defined results of null and empty texts."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(T.FOLDER, "byte_bpe_50k.json")), reason="tokenizer files are not here")


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_and_offsets(text):
    ids = T.encode_texts([text])[0]
    assert T.decode(ids) == text
    spans = T.offsets(text, ids)
    assert len(spans) == len(ids)
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a < b for a, b in spans)


def test_offsets_equal_the_library():
    text = "Füße, naïve façade — 合計 9 箱 …"
    e = T.tokenizer().encode(text, add_special_tokens=False)
    assert [b for _, b in T.offsets(text, e.ids)][-1] == len(text)
    assert all(x[0] == y[0] for x, y in zip(T.offsets(text, e.ids), e.offsets))


def test_special_strings_are_text():
    ids = T.encode_texts(["<|endoftext|>"])[0]
    assert 50256 not in ids and T.decode(ids) == "<|endoftext|>"


def test_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, " ", "x", 1), (5, "w " * 20000, "x", 1)], "doc_id bigint, text string, k string, ids int")
    got = {r.doc_id: r.ids for r in T.encode_column(df).collect()}
    assert got[2] == got[3] == [] and len(got[4]) == 1 and len(got[5]) >= 20000 and T.decode(got[1]) == "a b"
    assert T.encode_column(df.where("doc_id < 0")).count() == 0
    assert {r.doc_id: r.n_tokens for r in T.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
