"""Winnowing against brute force over all windows."""

import hashlib
import random
import re

import pytest

from glyphflow.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        size = min(13, len(w))
        for k in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    sizes, out = {len(k) for k in windows}, []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    ids |= own
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("short", [False, True])
def test_against_brute_force(spark, short):
    rng = random.Random(4 + short)
    pool = ["a", "b", "É", "é", "日本", "x1", "Of", "the"] + [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([13, 14, 20, 40])))) for i in range(12)] + [(50, "a b " * 15), (51, "a " * 20), (7, "clash of ids " * 6), (None, "no id here " * 7)]
    if short:
        items += [(60, "one Two, three"), (61, "w1 w2 w3 w4 w5 w6 w7"), (62, "x1"), (63, ""), (64, None), (65, "!!")]
    docs = []
    for d in range(60):
        parts = [" ".join(rng.choices(pool, k=rng.choice([0, 3, 30, 90])))]
        for _ in range(rng.choice([0, 1, 2, 3])):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 5))
            parts += [rng.choice([" ", ", ", "\n"]).join(w[a : a + rng.choice([5, 12, 13, 14, 40])]).upper(), rng.choice(pool)]
        docs.append((d, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "a " * 300), (102, "a " * 300), (None, items[0][1]), (103, " ".join(t or "" for _, t in items))]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in winnow.contamination(df, bench).drop("rid").collect()), key=str)
    assert got == brute(docs, items)
    kept = winnow.decontaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(x[0]) for x in brute(docs, items) if not x[5] and x[2] < 13)
    assert sorted((str(r.doc_id) for r in winnow.decontaminated(df, bench, most=1 << 30).collect())) == sorted(str(x[0]) for x in brute(docs, items) if not x[5])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in winnow.contamination(docs, bench).drop("rid").collect()] == [(3, 0, 0)]
    assert winnow.contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("broadcast", [0, winnow.BROADCAST_ROWS])
def test_a_common_passage_and_a_long_text(spark, monkeypatch, broadcast):
    """A third of the documents hold one passage, which every item holds, too; one text has 40,000 words."""
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", broadcast)
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(5000)]
    passage = " ".join(rng.sample(pool, 15))
    items = [(i, " ".join(rng.sample(pool, 10)) + " " + passage + " " + " ".join(rng.sample(pool, 10))) for i in range(20)]
    docs = [(d, " ".join(rng.sample(pool, 30)) + (" " + passage if d % 3 == 0 else "")) for d in range(90)]
    docs.append((1000, " ".join(rng.choices(pool, k=20_000)) + " " + items[4][1] + " " + " ".join(rng.choices(pool, k=20_000)) + " " + passage))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in winnow.contamination(df, bench).drop("rid").collect()), key=str) == brute(docs, items)
