"""The matrices against the tiktoken library itself."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphflow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(texts):
    data = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(x) for x in data])).astype(np.int64)
    ids, at = bpe.ranks_of(PATH).encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


TEXTS = ["", " ", "a", "don't 'tis we'll I'VE they're 'sabc ''t x's's", "  a \n\n b\t c  ", "\n'll \n 've", "x" * 3000, "ab" * 500 + " " * 400, "naïve Ünïcödé 日本語 １２３ ½ 😀😀  x y", "É'd'", "'", "a'", "a' s", "Donaudampfschifffahrtsgesellschaftskapitänsmützenabzeichen" * 9, "12345 67 8", "ᲉꟜ\U000323b0 á"]


def test_texts_together_and_alone(library):
    want = [library.encode_ordinary(t) for t in TEXTS]
    assert ours(TEXTS) == want
    assert [ours([t])[0] for t in TEXTS] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab stvrelmd'’ \n\tÉ1½😀.,") | st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_any_text(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))} if not hasattr(test_any_text, "e") else None
    if ranks:
        test_any_text.e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ours(texts) == [test_any_text.e.encode_ordinary(t) for t in texts]


def test_long_random_rows(library):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdeéß"), 5000)) for _ in range(3)] + ["a" * 10001]
    assert ours(texts) == [library.encode_ordinary(t) for t in texts]


def test_round_trip_columns(spark, library):
    rows = [(1, "a b", "x"), (2, None, "y"), (2, None, "y"), (None, "Grüße  ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.round_trip(df, PATH).collect(), key=str)
    want = []
    for d, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    ids = bpe.encoded(df.drop("ids"), PATH)
    assert sorted(bytes(r.bytes) for r in bpe.decoded(ids, PATH).collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
