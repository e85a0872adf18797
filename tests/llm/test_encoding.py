import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinflow.llm import encoding as E

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def other():
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("alphabet", ["a", "ab", "etaoin", "=-", " \n", "é漢の", "ÃÂ"])
def test_long_pieces_are_streamed_exactly(other, alphabet):
    random.seed(1)
    text = "".join(random.choice(alphabet) for _ in range(9000))
    assert E.load().encode(text) == other.encode_ordinary(text)


def test_stream_in_parts_is_the_same():
    t = E.load()
    data = ("abcdefgh" * 700).encode()
    assert list(t.stream(data[i : i + 7] for i in range(0, len(data), 7))) == list(t.stream([data]))


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_round_trip_and_other_library(text):
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    k = test_round_trip_and_other_library.__dict__.setdefault("k", tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    t = E.load()
    ids = t.encode(text)
    assert ids == k.encode_ordinary(text) and t.decode(ids) == text and t.count(text) == len(ids)


def test_decoder_replaces_broken_bytes():
    d = E.Utf8Decoder()
    assert d.feed(b"\xe6\xbc") + d.feed(b"\xa2a\xff\xe6a") + d.close() == "漢a��a"
    assert E.Utf8Decoder().feed("é".encode()[:1]) == ""


def test_null_empty_and_special(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "<|endoftext|>", "z")], "doc_id long, text string, ids2 string")
    rows = {r.doc_id: r.ids for r in E.encode_texts(df).collect()}
    assert rows[1] == [] and rows[2] == [] and 50256 not in rows[3] and len(rows[3]) > 1
    assert [r.text for r in E.decode_ids(E.encode_texts(df).select("doc_id", "ids")).orderBy("doc_id").collect()] == ["", "", "<|endoftext|>"]
    assert E.encode_texts(df.limit(0)).collect() == []
