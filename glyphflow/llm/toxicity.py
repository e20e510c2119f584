"""Toxic passages: maximal scoring segments over the log-odds of words.

Tokens are words and their beginnings.  A labelled sample, of which one text of each kind of copies counts, gives each
token the log-odds of toxic over other texts under Dirichlet priors: the numbers of texts with it are shrunk towards its
share of the whole sample.  Tokens whose log-odds exceed Z standard errors form the lexicon.  A text's words score the
log-odds of their best token, all others DRIFT below 0, and a linear-time scan finds every maximal scoring segment.
Under chance the best segment of n words exceeds x with probability 1 - exp(-K n exp(-lambda x)); lambda solves the
equation of the word scores in clean texts, K is fitted to the best segments of these, and a logistic fit turns the significance of a text's segments into a score.

Defined cases: null and empty texts have no words, no passages and the score of a text without any; without labels, or
with those of one class, the lexicon is empty and every score is the share of label 1 (0.5 without any); texts are
scanned whole; equal rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm import runtime, textkit, training

U64 = np.uint64
WORD = np.zeros(256, bool)
WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
#: Standard errors of a lexicon word, prior counts as a share of the sample's, score of other words, and E-value of a
#: passage worth reporting.
Z, PRIOR, DRIFT, REPORTED = 3.0, 0.1, 0.25, 0.05
#: Bytes of the beginnings of words that are tokens besides the words, for stems with many endings.
STEMS = (4, 5, 6, 7, 8, 9)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and case-folded hashes of the words of each text."""
    starts, ends, rows = textkit.spans(WORD[buf], offsets)
    return starts, ends, rows, textkit.hasher(textkit.LOWER[buf])(starts, ends)


def tokens(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tokens of words: indices and hashes of the words, then of those that are longer than each stem."""
    yield np.arange(len(starts)), hashes
    hashed = textkit.hasher(textkit.LOWER[buf])
    for k in STEMS:
        at = np.flatnonzero(ends - starts > k)
        yield at, textkit.mix(hashed(starts[at], starts[at] + k) + U64(k))


def segments(scores: np.ndarray, at: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of words that score at their places and -drift elsewhere.

    The scan keeps candidates with the totals before and after each; a new word joins the nearest candidate that began
    lower and ended lower, and swallows what lies between.  `open_` holds the candidates that may still be joined, each
    beginning higher than the one before: one that begins as high as a later one never is.  Each candidate enters and
    leaves it once, so the scan is linear.
    """
    kept: list[tuple[int, int, float, float]] = []
    open_: list[int] = []
    total, last = 0.0, -1
    for score, place in zip(scores.tolist(), at.tolist()):
        total -= drift * (place - last - 1)
        last = place
        first, left, right = place, total, total + score
        total = right
        while True:
            while open_ and kept[open_[-1]][2] >= left:
                open_.pop()
            if not open_ or kept[open_[-1]][3] >= right:
                open_.append(len(kept))
                kept.append((first, place, left, right))
                break
            j = open_.pop()
            first, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, r - l) for a, b, l, r in kept]


@dataclass(frozen=True)
class ToxicModel:
    hashes: np.ndarray  # ascending
    scores: np.ndarray
    rate: float  # lambda
    size: float  # K
    weights: tuple[float, float]
    intercept: float

    def passages(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple[int, int, float, float]]], np.ndarray]:
        """Of each text its segments (start and end in bytes, score and E-value), and its number of words."""
        out: list[list[tuple[int, int, float, float]]] = [[] for _ in range(len(offsets) - 1)]
        starts, ends, rows, hashes = words(buf, offsets)
        if not len(self.hashes):
            return out, np.bincount(rows, minlength=len(out))
        best = np.full(len(starts), -np.inf)
        for at, keys in tokens(buf, starts, ends, hashes):
            place = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
            known = self.hashes[place] == keys
            best[at[known]] = np.maximum(best[at[known]], self.scores[place[known]])
        hits = np.flatnonzero(best > -np.inf)
        count = np.bincount(rows, minlength=len(out))
        first = np.cumsum(count) - count
        for part in np.split(hits, np.flatnonzero(np.diff(rows[hits])) + 1) if len(hits) else ():
            row = int(rows[part[0]])
            for a, b, s in segments(best[part], part - first[row], DRIFT):
                a, b = a + first[row], b + first[row]
                out[row].append((int(starts[a] - offsets[row]), int(ends[b] - offsets[row]), float(s), float(self.size * count[row] * np.exp(-self.rate * s))))
        return out, count

    def evidence(self, passages: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """-log10 of the chance of the best segment, and of all significant ones together; both at most 30."""
        if not passages:
            return 0.0, 0.0
        chances = [-np.expm1(-min(p[3], 50.0)) for p in passages]
        logs = [-np.log10(max(c, 1e-30)) for c in chances]
        return float(max(logs)), float(min(30.0, sum(x for x, p in zip(logs, passages) if p[3] < REPORTED)))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return training.sigmoid(evidence @ np.array(self.weights) + self.intercept)


def _kinds(picked: DataFrame) -> DataFrame:
    """key, label, text and the least hash of the text's 4-word runs, which most near copies share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textkit.texts_of(batch.column(2))
            _, _, rows, hashes = words(buf, offsets)
            found, at = textkit.grams(hashes, rows, 4)
            least = np.full(batch.num_rows, ~U64(0))
            np.minimum.at(least, rows[at], found)
            least = np.where(least == ~U64(0), textkit.hasher(buf)(offsets[:-1], offsets[1:]), least)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least.view(np.int64))], ["key", "label", "text", "kind"])

    return picked.select("key", "label", "text").mapInArrow(run, f"key {picked.schema['key'].dataType.simpleString()}, label int, text string, kind long")


def _counts(picked: DataFrame) -> DataFrame:
    """token (hash), toxic and other: in how many texts of the sample it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textkit.texts_of(batch.column(0))
            label = np.asarray(batch.column(1))
            for a, b in textkit.chunks(offsets):
                part = buf[offsets[a] : offsets[b]]
                starts, ends, rows, hashes = words(part, offsets[a : b + 1] - offsets[a])
                owners, keys = (np.concatenate(x) for x in zip(*((rows[at], h) for at, h in tokens(part, starts, ends, hashes))))
                once = ~textkit.again(textkit.by_row(owners, keys))
                keys, which = np.unique(keys[once], return_inverse=True)
                toxic = label[a:b][owners[once]] == 1
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(which, toxic, len(keys)).astype(np.int64)), pa.array(np.bincount(which, ~toxic, len(keys)).astype(np.int64))], ["token", "toxic", "other"])

    return picked.select("text", "label").mapInArrow(run, "token long, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def log_odds(toxic: np.ndarray, other: np.ndarray, n: float, m: float) -> tuple[np.ndarray, np.ndarray]:
    """The log-odds of each token under the prior, and how many standard errors they are; n and m are all counts."""
    a, prior = PRIOR * (toxic + other), PRIOR * (n + m)
    x, y = toxic + a, other + a
    odds = np.log(x / (n + prior - x)) - np.log(y / (m + prior - y))
    return odds, odds / np.sqrt(1 / x + 1 / y)


def rate_of(scores: np.ndarray, share: np.ndarray, drift: float) -> float:
    """The positive root of: the mean of exp(root * score) over words is 1."""
    rest = max(1 - share.sum(), 1e-9)
    mean = lambda r: float((share * np.exp(r * scores)).sum() + rest * np.exp(-r * drift)) - 1
    low, high = 1e-6, 1.0
    if mean(low) >= 0:
        return low
    while mean(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return low


def size_of(best: np.ndarray, words: np.ndarray, rate: float, least: float) -> float:
    """K, by maximum likelihood: clean texts of that many words have best segments of these scores, or none (0), which says
    that no segment reaches the least score of the lexicon."""
    words, found = np.maximum(words, 1), best > 0
    return float(max(found.sum(), 1) / (words * np.exp(-rate * np.where(found, best, least))).sum()) if len(best) else 1.0


def plain_model(share: float) -> ToxicModel:
    """Without a lexicon: every text has the score of that share."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return ToxicModel(np.zeros(0, U64), np.zeros(0), 1.0, 1.0, (0.0, 0.0), float(np.log(share / (1 - share))))


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> ToxicModel:
    runtime.small_batches(docs.sparkSession)
    picked, weights = training.sample(docs, labels, label, key, text)
    if set(weights) != {0, 1}:
        return plain_model({(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(weights)])
    picked = runtime.written(_kinds(picked.withColumn("label", F.col("label").cast("int"))), "picked")
    single = picked.groupBy("label", "kind").agg(F.min(F.struct("key", "text")).alias("of")).select("label", "of.text")
    counts = runtime.written(_counts(single), "counts")
    n, m = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("other")).first())
    if not n or not m:
        return plain_model(0.5)
    told = counts.where(F.col("toxic") > Z).orderBy("token").toPandas()  # of a bounded sample; fewer can't exceed Z
    toxic, other = told["toxic"].to_numpy(float), told["other"].to_numpy(float)
    odds, z = log_odds(toxic, other, n, m)
    chosen = z >= Z
    hashes, scores = told["token"].to_numpy(np.int64)[chosen].view(U64), odds[chosen]
    order = np.argsort(hashes)
    share = (other + PRIOR * (toxic + other))[chosen] / (m + PRIOR * (n + m))
    rate, scores = rate_of(scores, share, DRIFT), scores[order]
    model = ToxicModel(hashes[order], scores, rate, 1.0, (0.0, 0.0), 0.0)
    clean = _evidence(picked.where("label = 0").select("key", "text"), model, ["key"]).select("top", "words").orderBy("top", "words").toPandas()
    least = float(scores.min()) if len(scores) else 1.0
    model = replace(model, size=size_of(clean["top"].to_numpy(float), clean["words"].to_numpy(float), rate, least))
    rows = _evidence(picked.select("key", "label", "text"), model, ["key", "label"]).orderBy("key", "best", "all").toPandas()
    y = rows["label"].to_numpy(float)
    x = rows[["best", "all"]].to_numpy(float)
    w, intercept = training.lasso_logistic(x, y, np.array([weights[int(v)] for v in y]), 1e-5, 3000)
    return replace(model, weights=(float(w[0]), float(w[1])), intercept=intercept)


PASSAGE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))


def _evidence(df: DataFrame, model: ToxicModel, keep: list[str]) -> DataFrame:
    """The columns to keep, best, all, score, passages (byte spans), top (the best segment's score, 0 without any) and words
    of each row; the text is the last column."""
    place = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textkit.texts_of(batch.column(place))
            for a, b in textkit.chunks(offsets):
                found, count = model.passages(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                both = np.array([model.evidence(p) for p in found]).reshape(-1, 2)
                passages = [[{"start": s, "end": e, "score": v, "e_value": x} for s, e, v, x in p if x < REPORTED] for p in found]
                top = np.array([max((x[2] for x in p), default=0.0) for p in found])
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(place)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(model.score(both)), pa.array(passages, PASSAGE), pa.array(top, pa.float64()), pa.array(count, pa.int64())], [*keep, "best", "all", "score", "passages", "top", "words"])

    types = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "best double, all double, score double, passages array<struct<start:long,end:long,score:double,e_value:double>>, top double, words long"])
    return df.mapInArrow(run, types)


def scored(df: DataFrame, model: ToxicModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted and the significant passages of each row."""
    runtime.small_batches(df.sparkSession)
    out = _evidence(df.select(df[key].alias("__key"), runtime.utf8(df[text]).alias("__text")), model, ["__key"])
    return out.select(F.col("__key").alias(key), training.held_out(F.col("__key")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "passages")


def op4_toxic_segments(spark, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, runtime.table(spark, sf_dir, "labels"))).drop("passages")
