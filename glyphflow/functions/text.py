"""Typography keys for comparing recognised text, and edit distances.

Everything is a Spark expression but the step over grapheme clusters, an Arrow UDF, since Spark can't compose Unicode.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Visually equal characters, and characters that stand for several.
CHARACTER_ALIASES = {
    "～": "〜", "~": "〜", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ", "·": "・", "◯": "○", "〝": '"', "〞": '"', "〟": '"', "“": '"', "”": '"',
    "‘": "'", "’": "'", "─": "ー", "―": "ー", "—": "ー", "︱": "ー", "﹘": "-", "−": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-",
    "﹣": "-", "︲": "-", "ｰ": "ー", "〰": "〜", "∼": "〜",
}
COMPATIBILITY_ALIASES = {
    "‥": "・・", "″": "′′", "‼": "!!", "⁈": "?!", "⁉": "!?", "℃": "°C", "Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅴ": "V", "Ⅵ": "VI",
    "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅹ": "X", "㈱": "(株)", "㎏": "kg", "㎜": "mm", "㎝": "cm", "㎞": "km", "㏄": "cc", "…": "・・・", "⋯": "・・・",
}
ALIASES = COMPATIBILITY_ALIASES | CHARACTER_ALIASES
#: Stands for a dot of a folded ellipsis, so that keys of keys don't fold again.
DOT = "\ue000"
TURNS = 4
#: Rows and bytes of an Arrow batch; 10,000 whole texts would otherwise fill a worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches() -> None:
    """Bound what one Arrow batch holds in the session at hand."""
    spark = SparkSession.active()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def adapted(text: Column) -> Column:
    """Without layout spaces; runs of three periods or more, of either width, as middle dots."""
    bare = F.translate(text, " 　\t\r\n", "")
    parts = F.regexp_extract_all(bare, F.lit(r"\.{3,}|．{3,}|\.{1,2}|．{1,2}|[^.．]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda u: F.when(u.rlike(r"^(\.{3,}|．{3,})$"), F.repeat(F.lit("・"), F.length(u))).otherwise(u)), "")


@lru_cache(1 << 16)
def _unit(unit: str) -> str:
    if unit in ALIASES:
        out = ALIASES[unit]
    elif unit == "￥":
        out = "¥"
    elif len(unit) == 1 and "！" <= unit <= "～" or all("｡" <= c <= "ﾟ" for c in unit) and any(c <= "ﾝ" for c in unit):
        out = unicodedata.normalize("NFKC", unit)
    else:
        out = unit
    return unicodedata.normalize("NFC", out)


#: What may change; two printable ASCII characters in a row never share a cluster.
_CLUSTERED = re.compile(r"[ -~]?(?:[^ -}]+[ -~]?)+")


def _folded_clusters(m: re.Match) -> str:
    import regex

    return "".join(map(_unit, regex.findall(r"\X", m[0])))


def folded_text(text: str) -> str | None:
    """Every cluster folded, again until nothing changes; None for forbidden characters or without a fixed point."""
    for _ in range(TURNS):
        bare = text.strip()
        if any(unicodedata.category(c) in ("Cc", "Cs") for c in set(bare)):
            return None
        new = bare.replace("~", "〜") if bare.isascii() else _CLUSTERED.sub(_folded_clusters, bare)
        if new == text:
            return text
        text = new
    return None


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else folded_text(t))


def folded(text: Column) -> Column:
    """folded_text() of each text."""
    small_batches()
    return _folded(text)


def simple(text: Column) -> Column:
    """folded() for text of printable ASCII, natively: only the tilde changes."""
    return F.translate(text, "~", "〜")


def quotes(text: Column) -> Column:
    return F.translate(text, "『』", "「」")


def long_marks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "ー{2,}", "ーー"), "〜{2,}", "〜〜")


def shouts(text: Column) -> Column:
    """Runs of ! and ?: mixed ones as one of each in order of appearance, others as two."""
    for pattern, to in ((r"!+\?[!?]*", "!?"), (r"\?+![!?]*", "?!"), (r"!{2,}", "!!"), (r"\?{2,}", "??")):
        text = F.regexp_replace(text, pattern, to)
    return text


def ellipses(text: Column) -> Column:
    """Runs of middle dots: up to two stay, up to six are three, more are six; as DOT."""
    return F.translate(F.regexp_replace(F.regexp_replace(text, "・{7,}", DOT * 6), "・{3,6}", DOT * 3), "・", DOT)


def key(text: Column, ascii_only: bool = False) -> Column:
    """The key by which two texts are compared; null for forbidden characters. ascii_only stays native."""
    core = simple(adapted(text)) if ascii_only else folded(adapted(text))
    return ellipses(shouts(long_marks(quotes(core))))


def shown(key_: Column) -> Column:
    return F.translate(key_, DOT, "・")


def display(text: Column) -> Column:
    return shown(key(text))


def next_row(row: Column, target: Column, emitted: Column) -> Column:
    """The next row of the edit-distance table of a target's characters after one emitted character."""
    chars = F.split(target, "")
    zero = F.array(F.element_at(row, 1) + 1)
    step = lambda out, i: F.concat(out, F.array(F.least(F.element_at(out, -1) + 1, F.element_at(row, i + 1) + 1, F.element_at(row, i) + F.when(F.element_at(chars, i) == emitted, 0).otherwise(1))))
    return F.aggregate(F.sequence(F.lit(1), F.length(target)), zero, step)


def _advanced(row: tuple[int, int, int], text: str, masks: dict[str, int], full: int) -> tuple[int, int, int]:
    """A row of the edit-distance table, as its first value and the bits of its rises and falls, after more characters (Myers)."""
    first, up, down = row
    for c in text:
        eq = masks.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        kept = eq | down
        rise, fall = down | (full & ~(across | up)), up & across
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(kept | rise)), rise & kept
    return first + len(text), up, down


def _packed(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _values(row: tuple[int, int, int], size: int) -> np.ndarray:
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(size // 8 + 1, "little"), np.uint8), count=size, bitorder="little").astype(np.int64)
    return np.append(row[0], row[0] + np.cumsum(bits(row[1]) - bits(row[2])))


def lattice_distance(options: list[list[str]], target: str) -> tuple[int, int]:
    """The least edit distance of a target to any path through option sets, and the target's length."""
    size = len(target)
    full = (1 << size) - 1
    points = np.frombuffer(target.encode("utf-32-le", "surrogatepass"), "<u4")
    masks = {c: _packed(points == ord(c)) for c in set().union(*(t for choices in options for t in choices)) & set(target)}
    row = (0, full, 0)
    for choices in options:
        rows = [_advanced(row, t, masks, full) for t in choices]
        if len(rows) > 1:  # neighbours in the least of several rows differ by one at most, too
            least = np.minimum.reduce([_values(r, size) for r in rows])
            steps = np.diff(least)
            rows = [(int(least[0]), _packed(steps > 0), _packed(steps < 0))]
        row = rows[0] if rows else row
    return row[0] + row[1].bit_count() - row[2].bit_count(), size


@F.pandas_udf(T.LongType())
def _lattice(options: pd.Series, target: pd.Series) -> pd.Series:
    def one(sets, goal) -> int:
        merged: list[list[str]] = []
        run = ""
        for choices in [*map(list, sets), None]:
            if choices is not None and len(choices) == 1:
                run += choices[0]
                continue
            if run:
                merged.append([folded_text(run) or ""])
                run = ""
            if choices is not None:
                merged.append([folded_text(c) or "" for c in choices])
        return lattice_distance(merged, goal)[0]

    return pd.Series([one(o, t) for o, t in zip(options, target)], dtype="int64")


def lattice(options: Column, target: Column) -> Column:
    """lattice_distance() of array<array<string>> options whose runs of single ones are joined and folded before."""
    small_batches()
    return _lattice(options, target)


@F.pandas_udf(T.LongType())
def _edits(one: pd.Series, other: pd.Series) -> pd.Series:
    def of(a: str | None, b: str | None) -> int | None:
        return None if a is None or b is None else lattice_distance([[min(a, b, key=len)]], max(b, a, key=len))[0]

    return pd.Series([of(a, b) for a, b in zip(one, other)], dtype="Int64")


def edits(one: Column | str, other: Column | str) -> Column:
    """The edit distance of two texts of any length; null if one is null."""
    small_batches()
    return _edits(one, other)
