"""The pipeline against its stages by brute force, over a small table with every case."""

import base64
import hashlib
import os
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from test_fertility import plain as base_rules
from test_partenum import brute as components
from test_secrets import plain as secret_spans
from test_winnow import brute as contamination


def redacted(text):
    spans = sorted((m, e) for k, s, e in secret_spans(text) for m in [text.index(text[s:e].split("=", 1)[1], s) if k == "assign" else s])
    out, done = "", 0
    for s, e in spans:
        if s >= done:
            out += text[done:s] + "[SECRET]"
        done = max(done, e)
    return out + text[done:]


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(8)
    words = [a + b + c for a in ("th", "an", "re", "in", "er") for b in ("tion", "ing", "ed", "ly", "ou") for c in ("", "er", "ea", "st")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(25)) for i in range(3)]
    docs = [(i, text(rng.choice([3, 30, 80])), "en", "s", 1) for i in range(40)]
    docs += [(100 + i, docs[i][1] + " extra", "en", "s", 1) for i in range(8)]
    docs += [(200, text(20) + " " + items[1][1], "en", "s", 1), (201, text(40) + " password=c1f6c02f845bf3028d " + text(5), "en", "s", 1), (202, text(30) + " " + "0123456789abcdef" * 2, "de", "s", 1)]
    docs += [(300, None, "en", "s", 0), (301, "", None, None, 0), (302, "a b " * 30, "en", "s", 1), (5, docs[5][1], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")

    kept = corpus_pipeline.quality_rules(spark, table, str(tmp_path))
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == table.columns
    assert all(not base_rules(t)["base_failed"] for _, t in rows)
    assert {d for d, t, *_ in docs if not base_rules(t)["base_failed"]} == {d for d, _ in rows}  # the bands keep this prose
    least = {d for d, _, c in components(rows) if d == c}
    rows = [x for x in rows if x[0] in least]
    dirty = {r[0] for r in contamination(rows, items) if r[5]}
    assert dirty == {200}
    rows = [(d, redacted(t)) for d, t in rows if d not in dirty]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows for ids in [library.encode_ordinary(t)]]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(want)


def test_columns_stay(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.names == docs.schema.names


@pytest.mark.parametrize("stage", range(5))
def test_empty(spark, stage):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, sf).count() == 0


def small_tables(spark, folder, n):
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(30)), "en", "s", 1) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, rows[3][1])] if n else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, small_tables(spark, f"{tmp_path}/none", 0)).count() == 0


def test_a_failed_run_can_be_repeated(spark, tmp_path, monkeypatch):
    folder = small_tables(spark, f"{tmp_path}/few", 6)
    stages = [(n, (lambda spark, docs, sf_dir: docs) if n == "quality_rules" else f) for n, f in corpus_pipeline.STAGES]

    def broken(spark, docs, sf_dir):
        raise OSError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, broken if n == "secret_scan" else f) for n, f in stages])
    with pytest.raises(OSError):
        corpus_pipeline.run(spark, folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == [0, 1, 2, 4, 5]


def test_dropped_tables_are_gone(spark):
    from glyphflow.llm import runtime

    table = runtime.written(spark.range(3), "gone")
    path = table.written_at.removeprefix("file://")
    assert os.path.isdir(path)
    runtime.drop(table, spark.range(1))
    runtime.drop(table)
    assert not os.path.exists(path)
