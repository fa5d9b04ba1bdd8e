import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import common
from textloom.llm import bpe

RANKS = bpe.read_ranks(bpe.VOCABULARY)
CODEC = bpe.Codec(RANKS)
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return np.frombuffer(CODEC.encode(text), np.int32).tolist()


def naive(piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
        if not ranked:
            return [RANKS[p] for p in parts]
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text) == OTHER.encode_ordinary(text)
    assert CODEC.decode(ids(text)).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\t'_-a1é²½ß\x1c\x85sтmrevl.,", max_size=30))
def test_awkward_texts(text):
    assert ids(text) == OTHER.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=30))
def test_merge_against_naive(piece):
    assert bpe.merge(piece, RANKS) == naive(piece)


def test_long_piece():
    assert ids("ab" * 20000) == OTHER.encode_ordinary("ab" * 20000)


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, extra):
    docs = common.odd_docs(spark, extra)
    out = bpe.encode_documents(docs)
    got = out.collect()
    texts = docs.select("doc_id", "text").collect()
    assert len(got) == len(texts)
    assert common.rows(bpe.decode_ids(out)) == common.rows(docs.select("doc_id", "text"))
    for r in got:
        assert (r.token_ids is None) == (r.n_tokens is None) == (r.round_trip is None)
        assert r.round_trip in (True, None)
    assert {r.n_tokens for r in got if r.doc_id == 3} == {0}
    assert bpe.encode_documents(common.empty_docs(spark)).count() == 0


def test_decode_bad_and_null_ids(spark):
    df = spark.createDataFrame([(1, [RANKS[b"a"], None, RANKS[b"\xff"]]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert common.rows(bpe.decode_ids(df)) == [(1, "a�"), (2, None), (3, "")]
