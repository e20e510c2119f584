"""Quality rules on tokeniser fertility: how well public vocabularies fit a text.

For each text two vocabularies measure characters per token; the one with byte fallback also gives the share of
fallback tokens and the entropy of its tokens.  Each distinct word is tokenised once and remembered, so a vocabulary
sees words, not running text.  A text is rejected when a measure leaves the band of its language, of its script when its
language has none, or of "other" when neither has one, or when one of the base rules fails.

Defined cases: null and empty texts have no words and fail the base rules; texts of any length are measured whole;
repeated rows get equal rows; a null or unknown language falls back on the script; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm import runtime, textkit
from glyphflow.llm.bpe import ranks_of

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
CONTINUED = (np.arange(256) & 0xC0) == 0x80
#: Distinct words that a worker remembers.
REMEMBERED = 250_000
#: Scripts by ranges of code points; a text's script is that of most of its letters.
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("hangul", 0xAC00, 0xD7A3), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF)]


@dataclass(frozen=True)
class Band:
    """What a text of a language or script may measure.

    least, most: characters per token of the byte-level vocabulary.  least_piece, most_piece: of the one with fallback.
    Means of n tokens scatter as 1/sqrt(n), so each lower bound gives way by its width over sqrt(n).
    fallback: share of fallback tokens at most.  entropy: of a text's tokens, in bits over the log of their number, at least.
    """

    least: float = 0.0
    width: float = 0.0
    least_piece: float = 0.0
    width_piece: float = 0.0
    most: float = 12.0
    most_piece: float = 12.0
    fallback: float = 0.25
    entropy: float = 0.3


@dataclass(frozen=True)
class FertilityConfig:
    byte_vocabulary: str = ""
    piece_vocabulary: str = ""
    bands: dict[str, Band] = field(default_factory=dict)
    #: With fewer tokens the measures say nothing, and only the base rules count.
    least_tokens: int = 8


#: Default bands of languages: fitted_bands() of the good rows of the labelled half of a sample corpus with even ids; another corpus may need its own.
BANDS = {
    "en": Band(2.243, 2.75, 2.219, 2.62),
    "de": Band(2.036, 2.68, 2.245, 2.76),
    "fr": Band(1.850, 3.17, 1.979, 2.62),
    "es": Band(1.766, 2.43, 1.941, 2.75),
    "latin": Band(1.0, 2.0, 1.0, 2.0),
    # Scripts: between the measures of clean texts and of random letters.  Most tokens are single characters there.
    "greek": Band(0.62, 0.8, 0.70, 0.8, fallback=0.15, entropy=0.2),
    "cyrillic": Band(0.62, 0.8, 0.90, 0.8, fallback=0.15, entropy=0.2),
    "hebrew": Band(0.60, 0.8, 0.70, 0.8, fallback=0.15, entropy=0.2),
    "arabic": Band(0.60, 0.8, 0.72, 0.8, fallback=0.15, entropy=0.2),
    "devanagari": Band(0.45, 0.8, 0.55, 0.8, fallback=0.25, entropy=0.2),
    "thai": Band(0.38, 0.8, 0.70, 0.8, fallback=0.2, entropy=0.2),
    "hangul": Band(0.30, 0.8, 0.45, 0.8, fallback=0.4, entropy=0.2),
    "kana": Band(0.60, 0.8, 0.65, 0.8, fallback=0.25, entropy=0.2),
    "han": Band(0.33, 0.8, 0.42, 0.8, fallback=0.4, entropy=0.2),
    # Also for what has no band otherwise.  Letters of other scripts take a token or more each; ASCII symbols and digits don't.
    "other": Band(0.25, 0.8, 0.25, 0.8, most=1.0, most_piece=1.05, fallback=0.5, entropy=0.2),
}


#: Standard deviations, for texts of one token, by which a fitted bound gives way.
GIVE = 3.0


def fitted_bands(rows: DataFrame, group: str, give: float = GIVE) -> dict[str, Band]:
    """Bands by language (or any group) from assessed() rows of good texts: all that pass the base rules count.

    Each lower bound is the median of its measure; it gives way by `give` standard deviations, where the deviation of a text
    of n tokens from the median counts sqrt(n)-fold, as means of n tokens scatter.  The standard deviation is taken from the
    median of the absolute ones, since some labels are wrong.
    """
    good = rows.where(~F.col("base_failed") & F.col(group).isNotNull())
    middle = good.groupBy(group).agg(F.median("chars_per_byte_token").alias("m0"), F.median("chars_per_piece").alias("m1"))
    off = lambda v, m: 1.4826 * F.median(F.abs(F.col(v) - F.col(m)) * F.sqrt("n_pieces"))
    told = good.join(middle, group).groupBy(group).agg(F.first("m0").alias("m0"), F.first("m1").alias("m1"), off("chars_per_byte_token", "m0").alias("s0"), off("chars_per_piece", "m1").alias("s1"))
    return {r[0]: Band(r.m0, give * r.s0, r.m1, give * r.s1) for r in told.collect()}  # a row for each language


def default_config() -> FertilityConfig:
    import public_tokenizers

    return FertilityConfig(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), BANDS)


class Words:
    """Token counts of words by both vocabularies."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece

        self.ranks = ranks_of(byte_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.size = self.pieces.get_piece_size()
        self.fallback = np.array([self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(self.size)])
        self.memo: dict[int, tuple[int, bytes]] = {}

    def distinct(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Of each distinct word the number of byte-level tokens and the pieces, and which of them each word is."""
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        names = keys.tolist()
        known = [self.memo.get(k) for k in names]
        new = [i for i, x in enumerate(known) if x is None]
        if new:
            data = buf.tobytes()
            words = [data[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            spaced = b"".join(b" " + w for w in words)
            offsets = np.append(0, np.cumsum([len(w) + 1 for w in words])).astype(np.int64)
            self.ranks.memo.clear()  # words are remembered here
            _, at = self.ranks.encode(np.frombuffer(spaced, np.uint8), offsets)
            for i, n, ids in zip(new, np.diff(at).tolist(), self.pieces.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)):
                known[i] = self.memo[names[i]] = (n, np.array(ids, "<i4").tobytes())
        return np.array([x[0] for x in known], np.int64), [x[1] for x in known], which


@lru_cache(2)
def words_of(byte_path: str, piece_path: str) -> Words:
    return Words(byte_path, piece_path)


def base_rules(buf: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
    """Counts of each text's words, their code points, symbols, repeated lines and words in repeated 5-word windows."""
    n = len(offsets) - 1
    inside = ~textkit.SPACE[buf]
    starts, ends, rows = textkit.spans(inside, offsets)
    hashed = textkit.hasher(buf)
    hashes = hashed(starts, ends)
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": textkit.per_row(offsets, textkit.running(inside & ~CONTINUED[buf])), "n_symbols": textkit.per_row(offsets, textkit.running(SYMBOLS[buf]))}
    line_starts, line_ends, line_rows = textkit.spans(buf != 0x0A, offsets)
    words_before = textkit.running(inside)
    full = words_before[line_ends] > words_before[line_starts]
    twice = textkit.again(textkit.by_row(line_rows[full], hashed(line_starts[full], line_ends[full])))
    out["n_dup_lines"] = np.bincount(line_rows[full], twice, n).astype(np.int64)
    windows, at = textkit.grams(hashes, rows, 5)
    common = at[textkit.repeated(textkit.by_row(rows[at], windows))]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, common, 1)
    np.add.at(cover, common + 5, -1)
    out["n_repeat_words"] = np.bincount(rows, np.cumsum(cover[:-1]) > 0, n).astype(np.int64)
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    return out, (starts, ends, rows, hashes)


def measures(buf: np.ndarray, offsets: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """The base counts and each text's fertility; a text without tokens measures 0."""
    n = len(offsets) - 1
    out, (starts, ends, rows, hashes) = base_rules(buf, offsets)
    counts, pieces, which = words.distinct(buf, starts, ends, hashes)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    flat = np.frombuffer(b"".join(pieces), "<i4")
    own = sizes[which] if len(which) else np.zeros(0, np.int64)
    ids = flat[textkit.take_ranges(np.append(0, np.cumsum(sizes))[which], own)] if len(which) else flat
    token_rows = np.repeat(rows, own)
    byte_tokens = np.bincount(rows, counts[which], n) if len(which) else np.zeros(n)
    piece_tokens = np.bincount(token_rows, minlength=n).astype(float)
    keys = np.sort(token_rows * words.size + ids)
    last = np.append(np.flatnonzero(keys[1:] != keys[:-1]), len(keys) - 1) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(-1, last)).astype(float)
    total = np.maximum(piece_tokens, 1)
    weighted = np.bincount(keys[last] // words.size, times * np.log2(times), n) if len(keys) else np.zeros(n)
    entropy = np.log2(total) - weighted / total
    out["chars_per_byte_token"] = out["word_chars"] / np.maximum(byte_tokens, 1)
    out["chars_per_piece"] = out["word_chars"] / total
    out["fallback_share"] = np.bincount(token_rows, words.fallback[ids], n) / total if len(ids) else np.zeros(n)
    out["token_entropy"] = np.maximum(entropy, 0)
    out["n_pieces"] = piece_tokens.astype(np.int64)
    return out


def scripts_of(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The script of most letters of each text, "other" without any."""
    n = len(offsets) - 1
    votes = np.zeros((len(SCRIPTS) + 1, n), np.int64)
    if (buf < 0x80).all():
        votes[0] = textkit.per_row(offsets, textkit.running((buf | 0x20) - np.uint8(0x61) < 26))
    else:
        points, at = textkit.code_points(buf)
        bounds = np.searchsorted(at, offsets)
        for i, (_, low, high) in enumerate(SCRIPTS):
            inside = (points >= low) & (points <= high)
            if i == 0:
                inside &= ~((points > 0x5A) & (points < 0x61) | (points > 0x7A) & (points < 0xC0))
            votes[i] = textkit.per_row(bounds, textkit.running(inside))
    best = votes.argmax(0)
    best[votes.max(0) == 0] = len(SCRIPTS)
    return np.array([s for s, _, _ in SCRIPTS] + ["other"], object)[best]


def verdicts(m: dict[str, np.ndarray], groups: list[str | None], scripts: np.ndarray, config: FertilityConfig) -> np.ndarray:
    """Whether each text stays: no base rule fails and every measure lies in its band."""
    names = [next((x for x in (g, s) if x in config.bands), "other") for g, s in zip(groups, scripts)]
    kept = ~m["base_failed"]
    spread = m["token_entropy"] / np.log2(np.maximum(m["n_pieces"], 2))
    told = m["n_pieces"] >= config.least_tokens
    for name in set(names):
        if band := config.bands.get(name):
            give = 1 / np.sqrt(np.maximum(m["n_pieces"], 1))
            good = (m["chars_per_byte_token"] >= band.least - band.width * give) & (m["chars_per_byte_token"] <= band.most)
            good &= (m["chars_per_piece"] >= band.least_piece - band.width_piece * give) & (m["chars_per_piece"] <= band.most_piece)
            good &= (m["fallback_share"] <= band.fallback) & (spread >= band.entropy)
            kept &= good | ~told | np.array([x != name for x in names])
    return kept


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "chars_per_byte_token": "double", "chars_per_piece": "double", "fallback_share": "double", "token_entropy": "double", "n_pieces": "long"}


def assessed(df: DataFrame, config: FertilityConfig, text: str = "text", key: str = "doc_id", lang: str | None = "lang") -> DataFrame:
    """key and COLUMNS for each row."""
    runtime.small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(config.byte_vocabulary, config.piece_vocabulary)
        for batch in batches:
            buf, offsets = textkit.texts_of(batch.column(1))
            groups = batch.column(2).to_pylist()
            for a, b in textkit.chunks(offsets):
                part, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                m = measures(part, at, words)
                m["kept"] = verdicts(m, groups[a:b], scripts_of(part, at), config)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(m[c], pa.type_for_alias({"long": "int64", "double": "float64", "boolean": "bool"}[t])) for c, t in COLUMNS.items())], ["key", *COLUMNS])

    language = df[lang].cast("string") if lang and lang in df.columns else F.lit(None).cast("string")
    source = df.select(df[key].alias("key"), runtime.utf8(df[text]).alias("text"), language.alias("lang"))
    return source.mapInArrow(run, ", ".join([f"key {df.schema[key].dataType.simpleString()}", *(f"{c} {t}" for c, t in COLUMNS.items())])).withColumnRenamed("key", key)


def kept_rows(df: DataFrame, config: FertilityConfig, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df whose text stays, with all their columns; one pass."""
    runtime.small_batches(df.sparkSession)
    place = df.columns.index(text)
    tongue = df.columns.index(lang) if lang in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(config.byte_vocabulary, config.piece_vocabulary)
        for batch in batches:
            buf, offsets = textkit.texts_of(batch.column(place))
            groups = batch.column(tongue).to_pylist() if tongue is not None else [None] * batch.num_rows
            for a, b in textkit.chunks(offsets):
                part, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                yield batch.slice(a, b - a).filter(pa.array(verdicts(measures(part, at, words), groups[a:b], scripts_of(part, at), config)))

    return df.mapInArrow(run, df.schema)


def op1_fertility_quality(spark, sf_dir: str, config: FertilityConfig | None = None) -> DataFrame:
    return assessed(runtime.table(spark, sf_dir, "documents"), config or default_config())
