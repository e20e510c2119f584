"""Interval expansion and the whole removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from glyphflow.llm import bwt, textkit


def brute(rows, length=bwt.LENGTH):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for (d, _), x in zip(rows, data):
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        out.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [1, 3, 9, 30])
def test_borders(length):
    rng = random.Random(length)
    for _ in range(20):
        text = np.array([rng.randint(0, 2) for _ in range(rng.randint(1, 90))] + [0] * rng.randint(0, 3), np.int16)
        order = bwt.suffix_array(text, length + 1)
        turned = [tuple(np.roll(text, -i)[:length]) + (0,) * 0 for i in range(len(text))]
        got = bwt.borders(text, order, length)
        if length > len(text):
            continue
        assert [turned[i] for i in order] == sorted(turned)
        assert got.tolist() == [k == 0 or turned[order[k]] != turned[order[k - 1]] for k in range(len(text))]


def test_contexts_hold_every_string_once():
    rng = random.Random(2)
    data = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (0, 199, 200, 201, 900, 3, 1500)] + [b"x" * 800]
    buf, offsets = np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(x) for x in data])).astype(np.int64)
    a, b, _, gram = bwt.representatives(buf, offsets)
    got = sorted(s for x, y in zip(a, b) for s in range(x, y + 1))
    assert got == [o + i for o, x in zip(offsets, data) for i in range(len(x) - 199)]
    of = {}
    for x, y, g in zip(a, b, gram):
        for s in range(x, y + 1):
            assert of.setdefault(bytes(buf[s : s + 200]), g) == g


def test_rolling_is_the_hash_of_spans():
    buf = np.frombuffer(b"hello, hello world", np.uint8)
    at = np.arange(len(buf) - 4)
    assert (textkit.rolling(buf, 5) == textkit.hasher(buf)(at, at + 5)).all()


def corpus(seed):
    rng = random.Random(seed)
    sample = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [sample(n) for n in (150, 199, 200, 201, 260, 700)]
    rows = []
    for d in range(70):
        parts = [sample(rng.choice([0, 5, 120, 400]))]
        for _ in range(rng.choice([0, 1, 2])):
            p = rng.choice(passages)
            if rng.random() < 0.3:
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts += [p, sample(rng.choice([0, 1, 90]))]
        rows.append((d, "".join(parts)))
    rows += [(d + 100, t) for d, t in rows[:6]]
    return rows + [(200, None), (201, ""), (202, "z" * 500), (203, "ab" * 130), (204, passages[5] * 2), (204, passages[5] * 2), (None, passages[4])]


@pytest.mark.parametrize("members", [bwt.MEMBERS, 2])
def test_against_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(bwt, "MEMBERS", members)
    rows = corpus(7)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, rid int, spans string")
    got = bwt.without_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows)


def test_empty(spark):
    assert bwt.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
