"""A quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow trees on random parts of a labelled sample give paths; each path is a conjunction of comparisons of statistics.
An L1-penalised logistic fit over all rules leaves few with a weight, and those are compiled into one Spark expression.

Defined cases: null and empty texts have statistics of 0 and a score like any other; without labels, or with those of one
class, every score is the share of label 1 (0.5 without any); texts are measured whole; equal rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm import runtime, textkit, training
from glyphflow.llm.fertility import CONTINUED, base_rules

#: Byte classes whose share of a text's characters is a statistic.
SHARES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "stop": b".,;:",
    "shout": b"!?",
    "bar": b"|",
    "mark": b"#*$%&<>=_~^@",
    "bracket": b"()[]{}\"'",
}
STATISTICS = ("log_words", "word_length", "line_words", "dup_lines", "repeat_words", "distinct_words", "pair_words", "long_words", *(f"{k}_share" for k in SHARES), "wide_share")
_TABLE = {k: np.isin(np.arange(256), list(v)) for k, v in SHARES.items()}


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(offsets) - 1
    base, (starts, ends, rows, hashes) = base_rules(buf, offsets)
    count = lambda flags: textkit.per_row(offsets, textkit.running(flags))
    chars = np.maximum(count(~CONTINUED[buf]), 1)
    words = np.maximum(base["n_words"], 1)
    keyed = textkit.by_row(rows, hashes)
    seen = np.bincount(rows, ~textkit.again(keyed), n) if len(rows) else np.zeros(n)
    same = np.zeros(len(rows), bool)
    same[1:] = keyed[1:] == keyed[:-1]
    lines = np.maximum(count(buf == 0x0A) + 1, 1)
    columns = [
        np.log1p(base["n_words"]),
        base["word_chars"] / words,
        base["n_words"] / lines,
        base["n_dup_lines"] / lines,
        base["n_repeat_words"] / words,
        seen / words,
        np.bincount(rows, same, n) / words,
        np.bincount(rows, ends - starts > 20, n) / words,
        *(count(_TABLE[k][buf]) / chars for k in SHARES),
        count(buf >= 0xC0) / chars,
    ]
    return np.column_stack(columns).astype(float) if n else np.zeros((0, len(STATISTICS)))


def with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns to keep and STATISTICS of each row."""
    runtime.small_batches(df.sparkSession)
    place = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textkit.texts_of(batch.column(place))
            for a, b in textkit.chunks(offsets):
                values = statistics(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(place)), *(pa.array(values[:, i]) for i in range(len(STATISTICS)))], [*keep, *STATISTICS])

    types = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{s} double" for s in STATISTICS)])
    return df.select(*keep, runtime.utf8(df[text]).alias("__text")).mapInArrow(run, types)


#: A comparison of a statistic: its index, whether it is above, and the threshold.
Test = tuple[int, bool, float]


def tree_paths(x: np.ndarray, y: np.ndarray, weight: np.ndarray, columns: np.ndarray, depth: int, least: int = 12) -> list[tuple[Test, ...]]:
    """The paths to all nodes of a tree that splits by weighted Gini impurity at quantiles."""
    paths: list[tuple[Test, ...]] = []

    def grow(rows: np.ndarray, path: tuple[Test, ...]) -> None:
        if path:
            paths.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            return
        w, t = weight[rows], y[rows]
        if (w * t).sum() in (0.0, w.sum()):
            return
        best = (1e-12, -1, 0.0)
        whole, good = w.sum(), (w * t).sum()
        parent = good * (whole - good) / whole
        for c in columns:
            values = x[rows, c]
            for cut in np.unique(np.quantile(values, np.linspace(0.04, 0.96, 24))):
                low = values <= cut
                k = int(low.sum())
                if k < least or len(rows) - k < least:
                    continue
                a, p = w[low].sum(), (w * t)[low].sum()
                gain = parent - p * (a - p) / a - (good - p) * (whole - a - good + p) / (whole - a)
                if gain > best[0]:
                    best = (gain, int(c), float(cut))
        if best[1] < 0:
            return
        _, c, cut = best
        low = x[rows, c] <= cut
        grow(rows[low], (*path, (c, False, cut)))
        grow(rows[~low], (*path, (c, True, cut)))

    grow(np.arange(len(x)), ())
    return paths


def holds(path: tuple[Test, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c, above, cut in path:
        out &= (x[:, c] > cut) == above
    return out


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[tuple[tuple[Test, ...], float], ...]
    intercept: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for path, w in self.rules:
            z += w * holds(path, x)
        return training.sigmoid(z)

    def expression(self) -> Column:
        """The score as a Spark expression over the columns of STATISTICS."""

        def one(path: tuple[Test, ...], w: float) -> Column:
            tests = [(F.col(STATISTICS[c]) > cut) if above else (F.col(STATISTICS[c]) <= cut) for c, above, cut in path]
            return F.when(reduce(lambda a, b: a & b, tests), F.lit(w)).otherwise(F.lit(0.0))

        total = reduce(lambda a, b: a + b, (one(*r) for r in self.rules), F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.002, seed: int = 5) -> RuleEnsemble:
    """Rules from trees on random halves of the rows and of the statistics, weighted by a lasso logistic fit."""
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        return RuleEnsemble((), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    paths: dict[tuple[Test, ...], None] = {}
    for _ in range(trees):
        rows = rng.choice(len(x), max(2, min(len(x) // 2, 2500)), replace=False)
        columns = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False))
        paths |= dict.fromkeys(tree_paths(x[rows], y[rows], weight[rows], columns, depth))
    kept, seen = [], set()
    for path in paths:
        flags = holds(path, x)
        mark = flags.tobytes() if flags.any() else None
        if mark and mark not in seen:
            seen.add(mark)
            kept.append((path, flags))
    if not kept:
        return RuleEnsemble((), float(np.log(max((weight * y).sum(), 1e-6) / max((weight * (1 - y)).sum(), 1e-6))))
    w, intercept = training.lasso_logistic(np.column_stack([f for _, f in kept]).astype(float), y, weight, penalty)
    return RuleEnsemble(tuple((p, float(v)) for (p, _), v in zip(kept, w) if abs(v) > 1e-6), intercept)


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> RuleEnsemble:
    picked, weights = training.sample(docs, labels, label, key, text)
    rows = with_statistics(picked, "text", ["key", "label"]).orderBy("key", *STATISTICS).toPandas()  # a bounded sample
    y = rows["label"].to_numpy(float)
    return fitted(rows[list(STATISTICS)].to_numpy(float), y, np.array([weights[int(v)] for v in y]))


def scored(df: DataFrame, model: RuleEnsemble, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score and predicted of each row."""
    source = df.select(df[key].alias("__key"), df[text].alias("__source"))
    out = with_statistics(source, "__source", ["__key"]).select(F.col("__key").alias(key), training.held_out(F.col("__key")).alias("held_out"), model.expression().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_rule_quality(spark, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, runtime.table(spark, sf_dir, "labels")))
