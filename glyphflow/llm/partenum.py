"""Jaccard self-join of word-shingle sets by PartEnum signatures, and the components of its links.

Sets of like size fall into bands; linked sets lie in one band or in two neighbouring ones.  Each band has an instance
for pairs within it and with the band below, in which linked sets differ in at most h elements.  An instance partitions
the domain into parts of three pieces each and enumerates, in each part, the three subsets of two pieces: a signature is
the content of such a subset.  A difference spoils one piece, and a part whose set has two pieces or more filled needs two
spoilt pieces to lose all its signatures, a part with one filled piece needs one.  A set signs its parts in order until
these costs reach h + 2 s - 1, so linked sets share at least s signatures.  In bands of sets up to SMALL a part is a single
value of the domain, and a set signs its first h + s elements.

The steps, each a table in the shared folder:

1. Sets: size and identity of each text's set; equal sets are one node from here on.
2. Buckets: signatures, packed by range, meet in one task for each range, which labels each bucket of several sets with
   its member of least hash (a bucket of over MOST entries with its own signature) and counts, for each set, instance and
   label, the buckets.  A set with fewer than s shared signatures in an instance has no links there.  Linked sets share s
   buckets, hence labels, so each set may leave the labels of its fewest buckets, (s - 1) // 2 in all.
3. Verification: the sets under one label, with their elements, in blocks of at most BLOCK sets; each task intersects them
   by products of incidence matrices and returns a spanning forest of their links, fewer rows than sets.
4. Labels of more than one block: the sets outside the label's commonest tree visit all blocks.
5. Components: trees contracted until no link is left.

No task gathers a bucket, a label or a component whole: buckets over MOST stream through, labels are split into blocks.

Defined cases: null and blank texts have an empty set and no links; a document with fewer words than a shingle has their
sequence as its only element; equal rows are copies; a row with a null id is linked like others and doesn't give its
component's name (which is null if no row of it has an id); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphflow.llm import runtime, textkit

U64 = np.uint64
WORDS, NUM, DEN = 5, 75, 100
#: Bands up to this size have a part for each value of the domain.
SMALL = 156
#: Elements of a part, on average, in the largest sets of a band; one in SHARES of the least h is asked for in common.
CONTENT, SHARES = 2.6, 4
#: Signatures of a range, on average; signatures that a writing task packs at a time; entries of a bucket held by a task.
RANGE, PACK, MOST = 2_000_000, 4_000_000, 1_000_000
#: Sets and elements of a block; columns of an incidence matrix.
BLOCK, BLOCK_ELEMENTS, COLUMNS = 4096, 4_000_000, 2048
#: Edges (16 bytes each) that one task may contract; rows of a table that may be broadcast (8 to 24 bytes each).
ONE_TASK, BROADCAST_ROWS = 500_000, 1_000_000
#: Bits left of a signature, at least and at most; how many more than those that count the elements of all sets.
LEAST_BITS, MOST_BITS, SPARE_BITS = 40, 56, 10


def _bounds(most: int = 1 << 31) -> tuple[np.ndarray, np.ndarray]:
    low, lows, highs = 1, [], []
    while low < most:
        high = low * DEN * DEN // (NUM * NUM)
        lows.append(low)
        highs.append(high)
        low = high + 1
    return np.array(lows), np.array(highs)


LOWS, HIGHS = _bounds()


def shingles(buf: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and their rows."""
    buf = textkit.LOWER[buf]
    n = len(offsets) - 1
    starts, ends, rows = textkit.spans(~textkit.SPACE[buf], offsets)
    hashes = textkit.hasher(buf)(starts, ends)
    found, at = textkit.grams(hashes, rows, words)
    keys, owners = [found], [rows[at]]
    count = np.bincount(rows, minlength=n)
    for k in range(1, words):
        found, at = textkit.grams(hashes, rows, k)
        own = count[rows[at]] == k
        keys.append(textkit.mix(found[own] + U64(k)))
        owners.append(rows[at][own])
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(owners[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
    keys, owners = keys[order], owners[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[first], owners[first]


def shares(instance: np.ndarray) -> np.ndarray:
    """s: signatures that linked sets have in common at least."""
    least = (NUM * LOWS[instance] + DEN - 1) // DEN  # the smallest partner of the smallest set of the band
    return np.maximum(1, 2 * least // 7 // SHARES)


def kept_bits(total: int) -> int:
    """Bits left of a signature among those of `total` elements: other texts share about one in a thousand by chance.

    A chance hit joins two buckets, which loses no link and costs a comparison at most.
    """
    return min(MOST_BITS, max(LEAST_BITS, int(total).bit_length() + SPARE_BITS))


def signatures(keys: np.ndarray, n: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The signatures of sets (ascending elements one set after another, sizes), the set of each, whether it is of the
    instance of the band above, and which sets have too few filled pieces for the promise."""
    band, ends = np.searchsorted(LOWS, n, "right") - 1, np.cumsum(n)
    out, owners, steps, few = [], [], [], np.zeros(len(n), bool)
    spread, content = (U64(0x2545F4914F6CDD1D * (salt * 2 + 1) & (1 << 64) - 1), U64(0x9E6C63D0876A9A47))
    for step in (0, 1):
        instance = band + step
        used = np.ones(len(n), bool) if step == 0 else n * DEN // NUM >= LOWS[instance]
        h = (n + np.minimum(HIGHS[instance], n * DEN // NUM)) // 7
        s = shares(instance)
        small = HIGHS[instance] <= SMALL
        took = np.where(used & small, np.minimum(h + s, n), 0)
        row = np.repeat(np.arange(len(n)), took)
        singles = textkit.mix(keys[textkit.take_ranges(ends - n, took)] + (instance[row].astype(U64) << U64(40)) + U64(5))
        out.append(singles)
        owners.append(row)

        large = used & ~small
        parts = np.where(large, (HIGHS[instance] / CONTENT).astype(np.int64) + 2, 0)
        size = np.where(large, n, 0)
        row, key = np.repeat(np.arange(len(n)), size), keys[textkit.take_ranges(ends - n, size)]
        at = np.append(0, np.cumsum(parts))
        cell = 3 * at[row] + (textkit.mix(key + spread) % np.maximum(3 * parts, 1).astype(U64)[row]).astype(np.int64)
        pieces = np.zeros(3 * at[-1], U64)
        np.add.at(pieces, cell, textkit.mix(key ^ content))
        pieces = pieces.reshape(-1, 3)
        cost = np.minimum((pieces != 0).sum(1), 2)
        sums = np.append(0, np.cumsum(cost))
        owner = np.repeat(np.arange(len(n)), parts)
        need = h + 2 * s - 1
        few |= large & (sums[at[1:]] - sums[at[:-1]] < need)
        signed = np.flatnonzero((cost > 0) & (sums[:-1] - sums[at[owner]] < need[owner]))
        owner = owner[signed]
        place = textkit.mix((instance[owner].astype(U64) << U64(40)) + (signed - at[owner]).astype(U64))
        for code, (x, y) in enumerate(((0, 1), (0, 2), (1, 2)), 1):
            total = pieces[signed, x] + pieces[signed, y]
            filled = total != 0
            out.append(textkit.mix(total + place + U64(code))[filled])
            owners.append(owner[filled])
        steps.append(np.full(sum(map(len, out)) - sum(map(len, steps)), step, np.int64))
    return np.concatenate(out), np.concatenate(owners), np.concatenate(steps), few


def _identities(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The identity of each set."""
    sums = np.append(U64(0), np.cumsum(textkit.mix(keys ^ U64(0x5BD1E995))))
    ends = np.cumsum(n)
    return textkit.mix(sums[ends] - sums[ends - n] + n.astype(U64))


def _parsed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """first and last row, elements, sizes and identities of the sets of a column of texts, a chunk at a time."""
    buf, offsets = textkit.texts_of(column)
    for a, b in textkit.chunks(offsets):
        keys, rows = shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n = np.bincount(rows, minlength=b - a)
        yield a, b, keys, n, _identities(keys, n)


def _new(sid: np.ndarray, n: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which sets aren't empty and are met for the first time."""
    return np.array([bool(m) and not (s in seen or seen.add(s)) for s, m in zip(sid.tolist(), n.tolist())], bool)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, rid, n, sid (null for an empty set) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, n, sid in _parsed(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n, pa.int64()), pa.array(sid.view(np.int64), pa.int64(), mask=n == 0)], ["doc_id", "rid", "n", "sid"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rid long, n long, sid long")


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes before all second ones, so that the high ones of small numbers compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplaned(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _packed(docs: DataFrame, ranges: int, salt: int, bits: int) -> DataFrame:
    """range, sigs, refs, sids, sizes: the signatures of many sets in a range, ascending, as differences of their upper bits;
    refs hold the place of a signature's set among sids and sizes, twice, plus its step.  A range of -1 tells of a set with
    too few pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        first = total = 0

        def pack() -> pa.RecordBatch:
            sig, ref, sid, n = (np.concatenate([h[i] for h in held]) for i in range(4))
            order = np.argsort(sig)
            sig, ref = sig[order], ref[order]
            edges = np.searchsorted(sig, (np.arange(1, ranges) * ((1 << bits) / ranges)).astype(U64))
            rows = []
            for k, (a, b) in enumerate(zip(np.append(0, edges).tolist(), np.append(edges, len(sig)).tolist())):
                if a < b:
                    own, place = np.unique(ref[a:b] >> 1, return_inverse=True)
                    places = (place * 2 + (ref[a:b] & 1)).astype(np.uint32)
                    rows.append((k, _planes(np.diff(sig[a:b], prepend=U64(0))), _planes(places), sid[own].tobytes(), _planes(n[own].astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary()) for i in range(5)], names)

        names = ["range", "sigs", "refs", "sids", "sizes"]
        for batch in batches:
            for _, _, keys, n, sid in _parsed(batch.column(0)):
                new = _new(sid, n, seen)
                keys, n, sid = keys[np.repeat(new, n)], n[new], sid[new]
                sig, owner, step, few = signatures(keys, n, salt)
                if few.any():
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([b""], pa.binary()) for _ in range(4))], names)
                held.append((sig >> U64(64 - bits), (owner + first) * 2 + step, sid, n))
                first, total = first + len(n), total + len(sig)
                if total >= min(max(ranges * 4096, RANGE // 8), PACK):
                    yield pack()
                    held, first, total = [], 0, 0
        if total:
            yield pack()

    return docs.select("text").mapInArrow(run, "range int, sigs binary, refs binary, sids binary, sizes binary")


def _labelled(packed: DataFrame, most: int) -> DataFrame:
    """sid, n, instance, label, times: in how many buckets of several sets a set has a label.  Nulls tell of a range of -1.

    One task holds a range; of a bucket of over `most` entries it holds at most that many and the last batch.
    """

    schema = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("instance", pa.int32()), ("label", pa.int64()), ("times", pa.int64())])

    def rows(sid: np.ndarray, n: np.ndarray, step: np.ndarray, label: np.ndarray, times: np.ndarray | None = None) -> pa.RecordBatch:
        instance = np.searchsorted(LOWS, n, "right") - 1 + step
        times = np.ones(len(n), np.int64) if times is None else times
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((sid.view(np.int64), n.astype(np.int64), instance, label.view(np.int64), times), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        hot, limit, total = np.zeros(0, U64), 4 * most + RANGE, 0

        def joined() -> list[np.ndarray]:
            return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, U64) for i in range(4)]

        for batch in batches:
            for at, sigs, refs, sids, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                if at < 0:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in schema], schema=schema)
                    continue
                sig, ref = np.cumsum(_unplaned(sigs, U64), dtype=U64), _unplaned(refs, np.uint32)
                sid, n, step = np.frombuffer(sids, U64)[ref >> 1], _unplaned(sizes, np.uint32)[ref >> 1], (ref & 1).astype(np.uint8)
                known = np.isin(sig, hot) if len(hot) else np.zeros(len(sig), bool)
                if known.any():
                    yield rows(sid[known], n[known], step[known], textkit.mix(sig[known]))
                parts.append((sig[~known], sid[~known], n[~known], step[~known]))
                total += len(sig) - int(known.sum())
                if total > limit:
                    sig, sid, n, step = joined()
                    values, times = np.unique(sig, return_counts=True)
                    hot = np.union1d(hot, values[times > most])
                    known = np.isin(sig, hot)
                    yield rows(sid[known], n[known], step[known], textkit.mix(sig[known]))
                    parts = [(sig[~known], sid[~known], n[~known], step[~known])]
                    total = len(parts[0][0])
                    limit = max(limit, 2 * total)
        sig, sid, n, step = joined()
        if not len(sig):
            return
        order = np.argsort(sig, kind="stable")
        ranked = sig[order]
        bucket = np.cumsum(np.append(True, ranked[1:] != ranked[:-1])) - 1
        size = np.bincount(bucket)
        several = size[bucket] > 1
        order, bucket = order[several], bucket[several]
        own = textkit.mix(sid[order] + U64(0x1B873593))
        again = np.lexsort((own, bucket))
        order, bucket, own = order[again], bucket[again], own[again]  # by bucket, then by the hash of the set
        one = np.append(True, (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1]))[: len(order)]  # copies met by several tasks
        large = size[bucket] > most
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(order)])
        length = np.diff(np.append(first, len(order)))
        label = np.where(large, textkit.mix(sig[order]), np.repeat(sid[order][first], length))
        sets = np.add.reduceat(one, first) if len(first) else np.zeros(0, np.int64)
        keep = (one & (np.repeat(sets, length) > 1)) | large
        if not keep.any():
            return
        order, label = order[keep], label[keep]
        ranks = np.lexsort((label, step[order], sid[order]))
        order, label = order[ranks], label[ranks]
        start = np.flatnonzero(np.append(True, (sid[order][1:] != sid[order][:-1]) | (step[order][1:] != step[order][:-1]) | (label[1:] != label[:-1])))
        chosen = order[start]
        yield rows(sid[chosen], n[chosen], step[chosen], label[start], np.diff(np.append(start, len(order))))

    return packed.mapInArrow(run, "sid long, n long, instance int, label long, times long")


def _by_size(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcasting if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _members(docs: DataFrame, total: int) -> DataFrame:
    """sid, n, label, blocks: the labels under which each set is compared, and in how many blocks their sets are dealt."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(partitions, -(-total // RANGE))
    asked = F.lit([int(s) for s in shares(np.arange(len(LOWS)))])
    for salt in range(8):
        buckets = _labelled(_packed(docs, ranges, salt, kept_bits(total)).repartitionById(ranges, F.pmod("range", F.lit(ranges)).cast("int")), MOST)
        counted = buckets.repartition(partitions, "sid").groupBy("sid", "n", "instance", "label").agg(F.sum("times").alias("times"))
        own = Window.partitionBy("sid", "n", "instance")
        counted = counted.withColumn("all", F.sum("times").over(own)).withColumn("least", F.sum("times").over(own.orderBy("times", "label")))
        counted = counted.withColumn("s", F.element_at(asked, F.col("instance") + 1))
        kept = counted.where("sid is null or (all >= s and least > floor((s - 1) / 2))").select("sid", "n", "label").distinct()
        kept = runtime.written(kept, "labels")
        if not kept.where("sid is null").take(1):
            break
        runtime.drop(kept)
    else:
        raise RuntimeError("no partition of the domain suits all sets")
    size = kept.groupBy("label").agg(F.count("*").alias("sets"), F.sum("n").alias("elements")).where("sets > 1")
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK, F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    size = runtime.written(size.select("label", blocks.alias("blocks")), "sizes")
    members = runtime.written(kept.join(_by_size(size), "label").select("sid", "n", "label", "blocks"), "members")
    runtime.drop(kept, size)
    return members


def _elements(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """sid, elements (their upper 48 bits, 6 bytes each) of the sets of some rows, once each.

    Not a table: the shuffle that finds repeated rows serves the join with the sets' labels, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, keys, n, sid in _parsed(batch.column(0)):
                new = _new(sid, n, seen)
                size, took = n[new], keys[np.repeat(new, n)] >> U64(16)
                data = np.ascontiguousarray(took.view(np.uint8).reshape(-1, 8)[:, :6])
                offsets = np.append(0, np.cumsum(6 * size)).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(sid[new].view(np.int64), pa.int64()), binary], ["sid", "elements"])

    rows = docs.join(_by_size(rids), "rid", "left_semi")
    return rows.select("text").mapInArrow(run, "sid long, elements binary").dropDuplicates(["sid"])


def linked_pairs(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The matrix of which sets (distinct elements one set after another, sizes) are similar enough; its diagonal means nothing."""
    rows = np.repeat(np.arange(len(n)), n)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1
    rows, column = rows[order][common], column[common]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])[: len(column)]) - 1 if len(column) else column
    shared = np.zeros((len(n), len(n)), np.float32)  # whole numbers up to 2^24
    last = int(column[-1]) + 1 if len(column) else 0
    for k in range(0, last, COLUMNS):
        a, b = np.searchsorted(column, (k, k + COLUMNS))
        there = np.zeros((len(n), min(COLUMNS, last - k)), np.float32)
        there[rows[a:b], column[a:b] - k] = 1
        shared += there @ there.T
    out = np.zeros(shared.shape, bool)
    for k in range(0, len(n), 256):
        both = shared[k : k + 256].astype(np.int64)
        out[k : k + 256] = DEN * both >= NUM * (n[k : k + 256, None] + n[None, :] - both)
    return out


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric matrix: the first node of each component, with each other node of it."""
    left = np.ones(len(links), bool)
    roots, nodes = [], []
    for first in range(len(links)):
        if not left[first]:
            continue
        left[first] = False
        front = np.array([first])
        while len(front):
            front = np.flatnonzero(links[front].any(0) & left)
            left[front] = False
            roots.append(np.full(len(front), first))
            nodes.append(front)
    return np.concatenate([np.zeros(0, np.int64), *roots]), np.concatenate([np.zeros(0, np.int64), *nodes])


def _verified(members: DataFrame, elements: DataFrame, partitions: int) -> DataFrame:
    """a, b: a spanning forest of the links among the sets of one label, i and j, for members of sid, label, i, j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(group: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
            group = sorted(dict(group).items())
            sid, n = np.array([g[0] for g in group]), np.array([len(g[1]) // 6 for g in group])
            data = np.zeros((n.sum(), 8), np.uint8)
            data[:, :6] = np.frombuffer(b"".join(g[1] for g in group), np.uint8).reshape(-1, 6)
            a, b = forest(linked_pairs(data.view(U64).ravel(), n))
            return sid[a], sid[b]

        key, group, found = None, [], []
        for batch in batches:
            for sid, label, i, j, binary in zip(*(c.to_pylist() for c in batch.columns)):
                if (label, i, j) != key:
                    if len(group) > 1:
                        found.append(links(group))
                    key, group = (label, i, j), []
                group.append((sid, binary))
            if len(found) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (0, 1)], ["a", "b"])
                found = []
        if len(group) > 1:
            found.append(links(group))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (0, 1)], ["a", "b"])

    rows = members.join(elements, "sid").select("sid", "label", "i", "j", "elements")
    return rows.repartition(partitions, "label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(run, "a long, b long")


def _roots(parents: DataFrame, what: str) -> DataFrame:
    """node, root of a forest of written rows node, root (a smaller node), by pointer jumping."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = runtime.written(parents.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), what)
        parents = jumped.select("node", "root")
        if not jumped.where("moved").take(1):
            return parents


def _together(edges: DataFrame) -> DataFrame:
    """contracted() of at most ONE_TASK edges, by one task: dozens of small jobs would take longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        rows = [(x, r) for x in list(up) if (r := top(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def contracted(edges: DataFrame, what: str = "edges") -> DataFrame:
    """node, root for each node of the edges a, b that isn't the smallest of its component, which is its root.

    Each round every node hooks to its smallest neighbour if that is smaller, trees become nodes, and edges within a tree
    go; local minima are at most half of the nodes, so the rounds are logarithmic.
    """
    edges = runtime.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), what)
    if edges.count() <= ONE_TASK:
        return runtime.written(_together(edges.select("a", "b")), what)
    whole = None
    while edges.take(1):
        parents = runtime.written(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), what)
        roots = _roots(parents, what)
        up = lambda column, roots=roots: roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
        moved = edges.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        edges = runtime.written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), what)
        if whole is None:
            whole = roots
        else:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
            whole = runtime.written(whole.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(roots), what)
    return whole if whole is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _trees(links: DataFrame) -> DataFrame:
    """sid, tree of the sets that aren't the root of their tree."""
    return contracted(links).select(F.col("node").alias("sid"), F.col("root").alias("tree"))


def _visits(members: DataFrame, trees: DataFrame) -> DataFrame:
    """sid, label, i, j for the labels of several blocks: each block i of all sets with each block j of those outside the
    label's commonest tree."""
    large = members.where("blocks > 1").join(_by_size(trees), "sid", "left")
    large = large.select("sid", "label", "blocks", F.coalesce("tree", "sid").alias("tree"))
    trees = large.groupBy("label", "tree").agg(F.count("*").alias("sets"))
    common = trees.groupBy("label").agg(F.max_by("tree", F.struct("sets", "tree")).alias("common"), (F.sum("sets") - F.max("sets")).alias("others"))
    common = runtime.written(common.where("others > 0").select("label", "common", F.ceil(F.col("others") / BLOCK).cast("int").alias("turns")), "common")
    large = large.join(_by_size(common), "label")
    host, visitor = F.pmod(F.xxhash64("sid"), F.col("blocks")), F.pmod(F.xxhash64("sid", F.lit(1)), F.col("turns"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hosts = large.select("sid", "label", host.cast("int").alias("i"), upto("turns").alias("j"))
    visitors = large.where("tree <> common").select("sid", "label", upto("blocks").alias("i"), visitor.cast("int").alias("j"))
    return hosts.unionByName(visitors).distinct()


def components(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of each row."""
    return _placed(df, text, key)[0].drop("rid", "root")


def _placed(df: DataFrame, text: str, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """components() with rid and root, and the tables it reads."""
    spark = df.sparkSession
    runtime.prepare(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = df.select(df[key].alias("doc_id"), F.xxhash64(df[key], df[text]).alias("rid"), runtime.utf8(df[text]).alias("text"))
    docs = runtime.written(_sets(source), "sets")
    classes = docs.where("sid is not null").groupBy("sid").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"))
    classes = runtime.written(classes, "classes")

    members = _members(source, classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    def verified(compared: DataFrame) -> DataFrame:
        rids = runtime.written(compared.select("sid").distinct().join(classes, "sid").select("rid"), "wanted")
        links = runtime.written(_verified(compared, _elements(source, rids), partitions), "links")
        runtime.drop(rids)
        return links

    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("i")
    links = verified(members.select("sid", "label", own, F.lit(-1).alias("j")))
    trees = _trees(links)
    if members.where("blocks > 1").take(1):
        visits = runtime.written(_visits(members, trees), "visits")
        more = verified(visits)
        trees = _trees(links.unionByName(more))
        runtime.drop(visits, more)
    runtime.drop(members, links)

    # Sets in a tree or with copies, by the root of their tree, and the smallest key of each tree.
    roots = trees.select(F.col("tree").alias("sid")).distinct().withColumn("tree", F.col("sid"))
    placed = runtime.written(trees.unionByName(roots), "trees")
    named = classes.join(_by_size(placed), "sid", "left").where("copies > 1 or tree is not null")
    named = runtime.written(named.select("sid", "least", F.coalesce("tree", "sid").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = runtime.written(named.join(least, "root").select("sid", "component_id", "root"), "named")
    runtime.drop(placed, named, classes)
    told = docs.where("sid is not null").join(_by_size(final), "sid", "left").select("doc_id", "rid", "n", "component_id", "root")
    blank = docs.where("sid is null").select("doc_id", "rid", "n", F.col("doc_id").alias("component_id"), F.col("sid").alias("root"))
    out = told.unionByName(blank)
    return out.select("rid", F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root"), [docs, final]


def representatives(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of df for each component: of those with its smallest key, or of all if none has a key, one of the least hash.

    Blank texts have no links, so each of their rows is a component.
    """
    rows, tables = _placed(df, text, key)
    placed = runtime.written(rows.select("rid", "root", F.col(key).eqNullSafe(F.col("component_id")).alias("first")), "placed")
    runtime.drop(*tables)
    several = placed.where("first and root is not null").groupBy("root", "rid").agg(F.count("*").alias("times"))
    several = runtime.written(several, "several")
    chosen = several.groupBy("root").agg(F.min("rid").alias("chosen"), F.count("*").alias("rids")).where("rids > 1")
    chosen = runtime.written(chosen, "chosen")
    others = several.join(_by_size(chosen), "root").where("rid <> chosen").select("rid")
    gone = placed.where("not first").select("rid").unionByName(others).distinct().withColumnRenamed("rid", "__rid")
    gone = runtime.written(gone, "gone")
    again = runtime.written(several.where("times > 1").select(F.col("rid").alias("__rid")), "again")
    runtime.drop(placed, several, chosen)
    gone = _by_size(gone)
    left = df.withColumn("__rid", F.xxhash64(df[key], df[text])).join(gone, "__rid", "left_anti")
    if again.take(1):
        again = _by_size(again)
        left = left.join(again, "__rid", "left_anti").unionByName(left.join(again, "__rid", "left_semi").dropDuplicates(["__rid"]))
    return left.drop("__rid")


def op8_partenum_join(spark, sf_dir: str) -> DataFrame:
    return components(runtime.table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS to_id FROM documents UNION SELECT id, e.b FROM reach JOIN edges e ON e.a = reach.to_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""
