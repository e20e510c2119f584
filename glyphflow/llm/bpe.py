"""Byte-level BPE by rank files, on length-bucketed padded numpy matrices.

A chunk of texts is cut into pieces by vectorised rules (the pattern of the rank files), each distinct piece is looked
up in a worker's memo, and the pieces not met before are merged together: pieces of like length form a padded matrix,
and in every round every row merges its leftmost pair of minimum rank, found in a hash table of pairs, and is compacted
by one column.  Rows wider than the buckets merge all occurrences of their minimum pair in one round, up to the first
after which a lower rank appears, which gives the same result in fewer rounds.

Defined cases: null and empty texts have no tokens; repeated rows are encoded alike; texts of any length are encoded
whole; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm import runtime, textkit

NONE = np.int32(2**31 - 1)
OTHER, LETTER, NUMBER, WHITE = range(4)
#: Widths of the matrices, in bytes; a longer piece is merged on its own.
WIDTHS = (4, 8, 12, 16, 24, 32, 64)
#: Cells of a matrix at most, and distinct pieces that a worker remembers.
CELLS, REMEMBERED = 1 << 18, 250_000

# Letters and numbers that the tokenizer library, with its older Unicode tables, takes for neither.
LATER_RANGES = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DF1), (0x1246F, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DFFF), (0x1E6C0, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x3FC3F),
]


@lru_cache(1)
def point_classes() -> np.ndarray:
    """The class of each code point, as the pattern's \\p{L}, \\p{N} and \\s have it."""
    import regex

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    classes = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
            classes[a:b] = kind
    classes[0xD800:0xE000] = OTHER
    for a, b in LATER_RANGES:
        classes[a : b + 1] = OTHER
    return classes


def cut(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of each text: starts and ends in bytes, and the rows."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    points, at = textkit.code_points(buf)
    n = len(points)
    bounds = np.searchsorted(at, offsets)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    kind = point_classes()[points]
    start = np.ones(n + 1, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | edge[1:n]
    runs = np.flatnonzero(start)
    first, last = runs[:-1], runs[1:]
    # The last white character before other text stands alone, or joins that text if it is a space.
    ends = last[(kind[first] == WHITE) & ~edge[last]]
    start[ends - 1] = True
    start[ends[points[ends - 1] == 0x20]] = False
    # A lone apostrophe that starts a piece takes the letters of a contraction.
    lone = first[(points[first] == 0x27) & (last - first == 1) & start[first] & ~edge[last]]
    if len(lone):
        padded = np.concatenate([points, [0, 0]])
        one, two = padded[lone + 1], np.where(edge[np.minimum(lone + 2, n)], 0, padded[lone + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(lone), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        took = short | long
        lone, stop = lone[took], (lone + np.where(short, 2, 3))[took]
        start[lone + 1] = False
        inner = stop[(stop < n) & ~edge[np.minimum(stop, n)]]
        inner = inner[kind[inner] == LETTER]
        start[inner] = True
    starts = np.flatnonzero(start[:n])
    first_bytes = at[starts]
    return first_bytes, np.append(first_bytes[1:], len(buf)), np.searchsorted(offsets, first_bytes, "right") - 1


class Ranks:
    """A rank file, the ids of its bytes, and a hash table from pairs of ids to the rank of what they make."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.of.values()) + 1
        self.token = np.full(self.size, b"", object)
        for token, rank in self.of.items():
            self.token[rank] = token
        self.text = np.array([str(i) for i in range(self.size)], object)
        self.byte = np.array([self.of[bytes([i])] for i in range(256)], np.int32)
        pairs = [(a << 32 | b, rank) for token, rank in self.of.items() for k in range(1, len(token)) if (a := self.of.get(token[:k])) is not None and (b := self.of.get(token[k:])) is not None]
        keys, values = (np.array(x, t) for x, t in zip(zip(*pairs), (np.uint64, np.int32)))
        self.bits = max(8, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, ~np.uint64(0)), np.full(1 << self.bits, NONE, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] == ~np.uint64(0)]
            _, winner = np.unique(slots[free], return_index=True)
            put = free[winner]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
        self.memo: dict[int, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (textkit.mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE if it makes no token; ids below 0 are padding."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != ~np.uint64(0)))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != ~np.uint64(0))]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def merge_matrix(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids, padded by -1, merged to the end."""
        out, rows = np.full_like(ids, -1), np.arange(len(ids))
        ranks = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows) and ids.shape[1] > 1:
            best = ranks.argmin(1)
            each = np.arange(len(rows))
            rank = ranks[each, best]
            going = rank < NONE
            if not going.all():
                out[rows[~going], : ids.shape[1]] = ids[~going]
                rows, ids, ranks, best, rank = rows[going], ids[going], ranks[going], best[going], rank[going]
                each = np.arange(len(rows))
            if not len(rows):
                break
            ids[each, best] = rank
            # Each row loses the cell after its merged pair, and the rank of that pair.
            keep = np.ones(ids.shape, bool)
            keep[each, best + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, bool)
            keep[each, best] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            for shift in (-1, 0):
                at = best + shift
                ok = (at >= 0) & (at < ranks.shape[1])
                r, a = each[ok], at[ok]
                ranks[r, a] = self.pair(ids[r, a], ids[r, a + 1])
        if len(rows):
            out[rows, : ids.shape[1]] = ids
        return out

    def merge_row(self, ids: np.ndarray) -> np.ndarray:
        """One long row, merged to the end."""
        ranks = self.pair(ids[:-1], ids[1:])
        while len(ranks) and (low := ranks.min()) < NONE:
            hits = np.flatnonzero(ranks == low)
            run = np.maximum.accumulate(np.where(np.append(True, hits[1:] != hits[:-1] + 1), np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
            made = np.full(len(hits), low, np.int32)
            before = np.where(hits > 0, ids[hits - 1], -1)
            before[1:][hits[1:] == hits[:-1] + 2] = low
            after = np.where(hits + 2 < len(ids), ids[np.minimum(hits + 2, len(ids) - 1)], -1)
            lower = np.flatnonzero(np.minimum(self.pair(before, made), self.pair(made, after)) < low)
            if len(lower):
                hits = hits[: lower[0] + 1]
            ids[hits] = low
            ids = np.delete(ids, hits + 1)
            ranks = self.pair(ids[:-1], ids[1:])
        return ids

    def merge(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of each span as the bytes of int32."""
        out: list[bytes | None] = [None] * len(starts)
        sizes = ends - starts
        data = buf.tobytes()
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            if (whole := self.of.get(data[a:b])) is not None:
                out[i] = whole.to_bytes(4, "little")
        left = np.flatnonzero([x is None for x in out])
        low = 0
        for width in WIDTHS:
            bucket = left[(sizes[left] > low) & (sizes[left] <= width)]
            low = width
            for k in range(0, len(bucket), step := CELLS // width):
                part = bucket[k : k + step]
                ids = np.full((len(part), width), -1, np.int32)
                at = np.repeat(np.arange(len(part)), sizes[part]), textkit.take_ranges(np.zeros(len(part), np.int64), sizes[part])
                ids[at] = self.byte[buf[textkit.take_ranges(starts[part], sizes[part])]]
                merged = self.merge_matrix(ids)
                lengths = (merged >= 0).sum(1)
                flat, bounds = merged[merged >= 0].astype("<i4").tobytes(), np.append(0, np.cumsum(lengths) * 4).tolist()
                for i, a, b in zip(part.tolist(), bounds, bounds[1:]):
                    out[i] = flat[a:b]
        for i in left[sizes[left] > low].tolist():
            out[i] = self.merge_row(self.byte[buf[starts[i] : ends[i]]]).astype("<i4").tobytes()
        return out

    def distinct(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The ids of each distinct span, and which of them each span is."""
        keys, first, which = np.unique(textkit.hasher(buf)(starts, ends), return_index=True, return_inverse=True)
        if len(self.memo) > REMEMBERED:
            self.memo.clear()
        names = keys.tolist()
        known = [self.memo.get(k) for k in names]
        new = np.flatnonzero([x is None for x in known])
        for i, ids in zip(new.tolist(), self.merge(buf, starts[first[new]], ends[first[new]])):
            known[i] = self.memo[names[i]] = ids
        return known, which

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, and the n + 1 offsets of the texts among them."""
        starts, ends, rows = cut(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        known, which = self.distinct(buf, starts, ends)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<i4")
        base = np.append(0, np.cumsum(lengths))[which]
        size = lengths[which]
        ids = flat[textkit.take_ranges(base, size)]
        count = np.bincount(rows, size, len(offsets) - 1).astype(np.int64)
        return ids, np.append(0, np.cumsum(count))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.token[ids].tolist())


@lru_cache(4)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoded(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ids array<int> of each row's whole text."""
    runtime.small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        for batch in batches:
            buf, offsets = textkit.texts_of(batch.column(1))
            for a, b in textkit.chunks(offsets):
                ids, at = ranks.encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["key", "ids"])

    source = df.select(df[key].alias("key"), runtime.utf8(df[text]).alias("text"))
    return source.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decoded(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and bytes of each row's ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        for batch in batches:
            out = [ranks.decode(np.asarray(x.values)) if x.is_valid else b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "bytes"])

    source = df.select(df[key].alias("key"), df[ids].alias("ids"))
    return source.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, bytes binary").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, the SHA-256 of the ids in decimal joined by spaces, and that of the bytes they decode to."""
    runtime.small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        for batch in batches:
            buf, offsets = textkit.texts_of(batch.column(1))
            for a, b in textkit.chunks(offsets):
                ids, at = ranks.encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                names, marks = [], []
                for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = ids[i:j]
                    names.append(hashlib.sha256(" ".join(ranks.text[own].tolist()).encode()).hexdigest())
                    marks.append(hashlib.sha256(ranks.decode(own)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(at), pa.int64()), pa.array(names), pa.array(marks)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = df.select(df[key].alias("key"), runtime.utf8(df[text]).alias("text"))
    return source.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op2_byte_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return round_trip(runtime.table(spark, sf_dir, "documents"), path or default_path())
