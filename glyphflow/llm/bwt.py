"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else in the corpus.  One transform of a whole
corpus fits no machine, so equal strings are brought together first:

1. Each string of LENGTH bytes is represented by its gram of least hash (the leftmost of equal ones), which depends on
   the string alone.  Neighbouring strings share their gram; the bytes of such a run are a context.
2. Contexts are counted by gram.  A gram met once has no repeated string; if all contexts of a gram are equal, all their
   strings are repeated.
3. The distinct contexts of the other grams are indexed, many grams to a transform: breadth-first backward extension of
   intervals sets the borders of the suffix array by increasing common prefix and stops at LENGTH.  Suffixes with no
   border between them share LENGTH bytes.  A gram with more than MEMBERS contexts, of which a hot passage has some, is
   dealt anew, since no one task could hold it: its strings are split by how far before the gram they start, in cells of
   CELL starts, and those of a cell are keyed by the bytes that all starts of the cell have in common.  What still has
   too many members, the edge of the passage, is settled by counting the hashes of its strings.
4. The runs of repeated strings go back to the documents.

Defined cases: null and empty texts have no bytes; matches don't cross documents; equal rows repeat one another; other
columns are not read.  Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm import runtime, textkit

U64 = np.uint64
#: Bytes of a repeated string, and of the grams that represent strings.
LENGTH, GRAM = 200, 64
#: Bits of a packed position; a longer buffer is taken in parts.
AT_BITS = 22
#: Contexts of a gram, and bytes of a transform, at most.
MEMBERS, INDEXED = 256, 1 << 17
#: Starts of a cell of a gram with too many contexts.
CELL = 16
#: Rows of at most about 40 bytes, and ids of 8 bytes, that may be broadcast.
BROADCAST_ROWS, BROADCAST_IDS = 50_000, 1_000_000


def representatives(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts that one gram represents: first and last start, where the gram is, and its hash."""
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    n = len(buf) - length + 1
    if n <= 0:
        return none, none, none, np.zeros(0, U64)
    hashes = textkit.rolling(buf, gram)
    out = []
    step = (1 << AT_BITS) - length
    for a in range(0, n, step):
        m = min(step, n - a)  # strings that start in this part
        packed = hashes[a : a + m + width - 1] & ~U64((1 << AT_BITS) - 1)
        packed |= np.arange(len(packed), dtype=U64)
        blocks = np.append(packed, np.full(-len(packed) % width, ~U64(0))).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])
        out.append((least & U64((1 << AT_BITS) - 1)).astype(np.int64) + a)
    at = np.concatenate(out)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    inside = np.arange(n) + length <= ends
    turn = np.append(True, at[1:] != at[:-1])
    first = inside & (turn | ~np.append(False, inside[:-1]))
    last = inside & (np.append(turn[1:], True) | ~np.append(inside[1:], False))
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last), at[starts], hashes[at[starts]]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The rotations of a text of small integers, ordered by their first depth symbols at least."""
    n = len(text)
    key = np.zeros(n, U64)
    wide = np.append(text, np.resize(text, 7)).astype(U64)
    for k in range(7):
        key = key << U64(9) | wide[k : k + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    slot = np.maximum.accumulate(np.where(np.append(True, ranked[1:] != ranked[:-1]), np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = slot
    have = 7
    while have < depth:
        alone = np.append(slot[1:] != slot[:-1], True) & (slot == np.arange(n))
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        at = order[open_]
        key = rank[at] * n + rank[(at + have) % n]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        slot[open_] = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), open_, 0))
        rank = rank.copy()
        rank[at] = slot[open_]
        have *= 2
    return order


def borders(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix has less than length symbols in common with the one before it.

    Breadth-first backward extension: the intervals of strings of one length give those of the strings one longer, and
    an interval sets the border after it if no shorter string has.
    """
    n = len(text)
    before = text[order - 1]
    steps = np.empty(n, np.int64)
    steps[np.argsort(before, kind="stable")] = np.arange(n)
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        one = high - low == 1
        to = steps[low[one]]
        wide_low, sizes = low[~one], (high - low)[~one]
        if len(sizes):
            at = textkit.take_ranges(wide_low, sizes)
            key = np.repeat(np.arange(len(sizes)) * 512, sizes) + before[at]
            by = np.argsort(key, kind="stable")
            key, at = key[by], at[by]
            turn = np.flatnonzero(key[1:] != key[:-1])
            lows, highs = steps[at[np.append(0, turn + 1)]], steps[at[np.append(turn, len(at) - 1)]] + 1
            low, high = np.append(to, lows), np.append(to + 1, highs)
        else:
            low, high = to, to + 1
        new = ~border[high]
        low, high = low[new], high[new]
        if not len(low):
            break
        border[high] = True
    return border[:n]


def repeated_starts(contexts: list[bytes], weights: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context whether the string at each start occurs twice or more, counting a context weight times."""
    sizes = np.array([len(c) for c in contexts])
    text = (np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int16) + 1).copy()
    ends = np.cumsum(sizes + 1)
    text[ends - 1] = 0
    order = suffix_array(text, length + 1)
    kind = np.empty(len(text), np.int64)
    kind[order] = np.cumsum(borders(text, order, length))
    counts = np.maximum(sizes - length + 1, 0)
    starts = textkit.take_ranges(ends - 1 - sizes, counts)
    owner = np.repeat(np.arange(len(contexts)), counts)
    weight = np.bincount(kind[starts], np.array(weights)[owner], len(text) + 1)
    flags = weight[kind[starts]] > 1
    return np.split(flags, np.cumsum(counts)[:-1])


def runs(flags: np.ndarray) -> list[dict[str, int]]:
    """The bytes that flagged starts cover, as spans from and to."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [{"s": int(a), "e": int(b) + LENGTH - 1} for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0))]


SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _contexts(docs: DataFrame) -> DataFrame:
    """gram, context, rid, a, b, at: the runs of strings with one gram, from start a to b of the row's text; the gram is at a + at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textkit.texts_of(batch.column(1))
            rid = np.asarray(batch.column(0))
            for i, j in textkit.chunks(offsets):
                part, at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                a, b, p, gram = representatives(part, at)
                context = textkit.hasher(part)(a, b + LENGTH)
                row = np.searchsorted(at, a, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(rid[i:j][row]), pa.array((a - at[row]).astype(np.int32)), pa.array((b - at[row]).astype(np.int32)), pa.array((p - a).astype(np.int32))], ["gram", "context", "rid", "a", "b", "at"])

    return docs.mapInArrow(run, "gram long, context long, rid long, a int, b int, at int")


def _cut(docs: DataFrame) -> DataFrame:
    """gram, context, times, hot, at, bytes of the contexts wanted of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            rows = [(w["gram"], w["context"], w["times"], w["hot"], w["at"], text[w["a"] : w["b"] + LENGTH]) for text, wanted in zip(texts, batch.column(1).to_pylist()) for w in wanted]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()))], ["gram", "context", "times", "hot", "at", "bytes"])

    return docs.select("text", "wanted").mapInArrow(run, "gram long, context long, times long, hot boolean, at int, bytes binary")


def _indexed(contexts: DataFrame, partitions: int) -> DataFrame:
    """gram, context, spans: the repeated bytes of each context, by the transform."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_starts([r[3] for r in rows], [min(r[2], 2) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([runs(f) for f in flags], SPANS)], ["gram", "context", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size > INDEXED and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield settle(held)

    dealt = contexts.select("gram", "context", "times", "bytes").repartition(partitions, "gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "gram long, context long, spans array<struct<s:int,e:int>>")


def _counted(contexts: DataFrame) -> DataFrame:
    """The same for grams of too many contexts, by the hash of each string."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textkit.texts_of(batch.column(3))
            hashes, counts = textkit.rolling(buf, LENGTH), np.maximum(np.diff(offsets) - LENGTH + 1, 0)
            row = np.repeat(np.arange(len(counts)), counts)
            start = textkit.take_ranges(np.zeros(len(counts), np.int64), counts)
            for k in range(0, len(row), 1 << 16):
                r, s = row[k : k + (1 << 16)], start[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[offsets[r] + s].view(np.int64)), *(pa.array(np.asarray(batch.column(i))[r]) for i in range(3)), pa.array(s.astype(np.int32))], ["string", "gram", "context", "times", "start"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for own in batch.column(2).to_pylist():
                flags = np.zeros(max(own) + 1, bool)
                flags[own] = True
                spans.append(runs(flags))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, SPANS)], ["gram", "context", "spans"])

    every = contexts.select("gram", "context", "times", "bytes").mapInArrow(strings, "string long, gram long, context long, times long, start int")
    common = runtime.written(every.groupBy("string").agg(F.sum("times").alias("times")).where("times > 1").select("string"), "strings")
    found = every.select("string", "gram", "context", "start").join(_small(common), "string", "left_semi").groupBy("gram", "context").agg(F.collect_list("start").alias("starts"))
    return found.mapInArrow(joined, "gram long, context long, spans array<struct<s:int,e:int>>")


def _cells(contexts: DataFrame) -> DataFrame:
    """gram, context, times and of each part of a context in one cell: key, part (its hash), first (its start), bytes."""
    most = LENGTH - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            buf, offsets = textkit.texts_of(batch.column(4))
            hashed = textkit.hasher(buf)
            for gram, context, times, at, data, base in zip(*(batch.column(i).to_pylist() for i in range(5)), offsets.tolist()):
                for cell in range(max(0, at - (len(data) - LENGTH)) // CELL, at // CELL + 1):
                    near, far = cell * CELL, min(cell * CELL + CELL - 1, most)  # bytes from a start to the gram
                    a, b = max(0, at - far), min(len(data) - LENGTH, at - near)
                    if a <= b:
                        rows.append((gram, context, times, cell, a, data[a : b + LENGTH], base + at - near, base + at - far + LENGTH, base + a, base + b + LENGTH))
            if rows:
                gram, context, times, cell, first, data, core_a, core_b, part_a, part_b = zip(*rows)
                key = textkit.mix(hashed(np.array(core_a), np.array(core_b)) ^ textkit.mix(np.array(cell, U64) + np.array(gram, np.int64).view(U64)))
                part = hashed(np.array(part_a), np.array(part_b))
                yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(context, pa.int64()), pa.array(times, pa.int64()), pa.array(key.view(np.int64)), pa.array(part.view(np.int64)), pa.array(first, pa.int32()), pa.array(data, pa.binary())], ["gram", "context", "times", "key", "part", "first", "bytes"])

    return contexts.select("gram", "context", "times", "at", "bytes").mapInArrow(run, "gram long, context long, times long, key long, part long, first int, bytes binary")


def _dealt(contexts: DataFrame, partitions: int) -> DataFrame:
    """gram, context, spans of the contexts of grams with too many."""
    cells = runtime.written(_cells(contexts), "cells")
    parts = cells.groupBy("key", "part").agg(F.sum("times").alias("times"), F.first("bytes").alias("bytes"))
    parts = runtime.written(parts.select(F.col("key").alias("gram"), F.col("part").alias("context"), "times", "bytes"), "parts")
    members = runtime.written(parts.groupBy("gram").agg(F.count("*").alias("members"), F.sum("times").alias("all")).where("all > 1"), "members")
    parts = parts.join(_small(members), "gram")
    whole = parts.where("members = 1").select("gram", "context", F.array(F.struct(F.lit(0).alias("s"), F.octet_length("bytes").alias("e"))).alias("spans"))
    some = _indexed(parts.where(f"members between 2 and {MEMBERS}"), partitions).unionByName(_counted(parts.where(f"members > {MEMBERS}")))
    settled = runtime.written(whole.unionByName(some.where(F.size("spans") > 0)).select(F.col("gram").alias("key"), F.col("context").alias("part"), "spans").dropDuplicates(["key", "part"]), "settled")
    back = cells.select("gram", "context", "key", "part", "first").join(_small(settled), ["key", "part"])
    shifted = F.transform("spans", lambda x: F.struct((x["s"] + F.col("first")).alias("s"), (x["e"] + F.col("first")).alias("e")))
    return back.select("gram", "context", shifted.alias("spans")).groupBy("gram", "context").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """rid, spans of each text (columns rid, text) with repeated bytes; spans may overlap."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = runtime.written(_contexts(docs), "contexts")
    grams = every.groupBy("gram").agg(F.count("*").alias("times"), F.min("context").alias("low"), F.max("context").alias("high"))
    grams = runtime.written(grams.where("times > 1").select("gram", (F.col("low") < F.col("high")).alias("several")), "grams")
    shared = runtime.written(every.join(_small(grams), "gram"), "shared")
    equal = shared.where("not several").select("rid", F.col("a").alias("s"), (F.col("b") + LENGTH).alias("e"))

    several = shared.where("several")
    distinct = several.groupBy("gram", "context").agg(F.count("*").alias("times"), F.min(F.struct("rid", "a", "b", "at")).alias("of"))
    distinct = runtime.written(distinct.select("gram", "context", "times", "of.*"), "distinct")
    hot = runtime.written(distinct.groupBy("gram").agg(F.count("*").alias("members")).where(F.col("members") > MEMBERS).select("gram", F.lit(True).alias("hot")), "hot")
    wanted = distinct.join(_small(hot), "gram", "left").groupBy("rid").agg(F.collect_list(F.struct("gram", "context", "times", F.coalesce("hot", F.lit(False)).alias("hot"), "a", "b", "at")).alias("wanted"))
    wanted = runtime.written(wanted, "wanted")
    texts = docs.join(_small(wanted.select("rid"), BROADCAST_IDS), "rid", "left_semi").join(wanted, "rid")
    cut = runtime.written(_cut(texts), "cut")
    settled = _indexed(cut.where("not hot"), partitions).unionByName(_dealt(cut.where("hot"), partitions))
    settled = runtime.written(settled.where(F.size("spans") > 0).dropDuplicates(["gram", "context"]), "settled")
    mixed = several.join(_small(settled), ["gram", "context"]).select("rid", "a", F.explode("spans").alias("span"))
    mixed = mixed.select("rid", (F.col("a") + F.col("span.s")).alias("s"), (F.col("a") + F.col("span.e")).alias("e"))
    spans = equal.unionByName(mixed).groupBy("rid").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return runtime.written(spans, "spans")


def without_repeats(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept (the bytes that stay, in order) of each row."""
    runtime.small_batches(df.sparkSession)
    docs = df.select(df[key].alias("doc_id"), F.xxhash64(df[key], df[text]).alias("rid"), runtime.utf8(df[text]).alias("text"))
    spans = repeated_spans(docs.where(F.octet_length("text") >= LENGTH).select("rid", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textkit.texts_of(batch.column(1))
            n = batch.num_rows
            flat, at = batch.column(2).flatten(), np.asarray(batch.column(2).value_lengths())
            base = np.repeat(offsets[:-1], at)
            cover = np.zeros(len(buf) + 1, np.int32)
            np.add.at(cover, base + np.asarray(flat.field("s")), 1)
            np.add.at(cover, base + np.asarray(flat.field("e")), -1)
            gone = np.cumsum(cover[:-1]) > 0
            stays = np.append(0, np.cumsum(~gone))
            bounds = stays[offsets]
            kept = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf[~gone]))]).cast(pa.binary())
            _, _, rows = textkit.spans(gone, offsets)
            sizes = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(sizes - np.diff(bounds)), pa.array(np.bincount(rows, minlength=n).astype(np.int64)), kept], ["key", "n_bytes", "n_removed", "n_spans", "kept"])

    hit = _small(spans.select("rid"), BROADCAST_IDS)
    told = docs.join(hit, "rid", "left_semi").join(spans, "rid").select(F.col("doc_id").alias("key"), "text", "spans")
    told = told.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
    data = F.encode("text", "UTF-8")
    zero = F.lit(0).cast("long")
    rest = docs.join(hit, "rid", "left_anti").select(F.col("doc_id").alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), data.alias("kept"))
    return told.unionByName(rest).withColumnRenamed("key", key)


def op7_bwt_dedup(spark, sf_dir: str) -> DataFrame:
    cleaned = without_repeats(runtime.table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
