"""Vectorised kernels over the UTF-8 bytes of many texts at once.

Everything here works on one flat ``uint8`` buffer with the start and end of each text, so a chunk of documents costs
a fixed number of numpy calls whatever its number of rows.  Spans (words, lines, pieces) are pairs of byte offsets and
the row they belong to; no span crosses a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled in one go; bounds a worker's memory (about 100 bytes of scratch a byte).
CHUNK_BYTES = 1 << 20
#: Separators of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALT = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U64) | U64(1)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1024), base, U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of rows of at most that many bytes, or of a single longer row."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def per_row(offsets: np.ndarray, running: np.ndarray) -> np.ndarray:
    """Sums by row, given running sums with a leading 0."""
    return running[offsets[1:]] - running[offsets[:-1]]


def running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes: starts, ends, rows."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def hasher(buf: np.ndarray):
    """A function from arrays of starts and ends to the 64-bit hashes of the bytes between."""
    terms = _SALT[buf]
    terms *= _power("up", _BASE, len(buf)) if len(buf) else U64(1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(terms, out=sums[1:])
    down = _power("down", _INVERSE, len(buf) + 1)

    def hashed(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    return hashed


def rolling(buf: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n bytes from each position on, equal to what hasher() gives for them."""
    if len(buf) < n:
        return np.zeros(0, U64)
    terms = _SALT[buf]
    terms *= _power("up", _BASE, len(buf))
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(terms, out=sums[1:])
    out = sums[n:] - sums[:-n]
    out *= _power("down", _INVERSE, len(out))
    out += U64(n * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    return mix(out)


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of n consecutive spans of one row, and the index of its first span."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(m, U64)
    for k in range(n):
        out = out * U64(_BASE) + hashes[k : k + m]
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(out[at]), at


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    flag = np.zeros(len(keys), bool)
    flag[order[1:]] |= same
    flag[order[:-1]] |= same
    return flag


def again(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurred before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    flag = np.zeros(len(keys), bool)
    flag[order[1:]] = ranked[1:] == ranked[:-1]
    return flag


def by_row(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One key for a row and a hash."""
    return mix(hashes ^ mix(rows.astype(U64) + U64(1)))


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of valid UTF-8 and the byte each starts at."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.flatnonzero((buf & 0xC0) != 0x80)
