"""Secret scans: fixed patterns, and formats inferred from labelled credentials.

Base spans come from three patterns.  The method adds spans: for each labelled kind of credential a prefix tree of its
examples is merged, state by state, where the statistics of two states don't differ by more than chance (Hoeffding's
bound), into a probabilistic automaton over character classes; one more automaton is inferred from ordinary tokens.  In every
maximal run of token characters, each part of LEAST or more between separators or ends is scored by all automata, and is
a secret of the likeliest kind if that beats the ordinary automaton by MARGIN bits and no better parts overlap it.  A part must beat as well
the automata of single forms of ordinary tokens (identifiers, versions, serial numbers and the like), each by itself.

Defined cases: null and empty texts have no spans; texts of any length are scanned whole; spans of different kinds may
overlap, but a scored part inside a base span is dropped; equal rows get equal rows; other columns are kept apart.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm import runtime, textkit

BASE = ("assign", "access", "hex")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Characters of a scored run at least, and bits by which a kind must beat ordinary tokens.
LEAST, MARGIN = 12, 8.0
SEPARATORS = b"/.-_+"
TOKEN = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-"))
HEXES = np.isin(np.arange(256), list(b"0123456789abcdef"))
#: Character classes, the symbols of the automata.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "_", "-", ".", "/", "+")
SYMBOL = np.full(256, len(CLASSES), np.int64)
for _i, _chars in enumerate(CLASSES):
    SYMBOL[list(_chars.encode())] = _i


@dataclass(frozen=True)
class Automaton:
    """Next state and log2 of the probability by state and symbol, and log2 of the probability to end; the last state is a sink."""

    to: np.ndarray
    log: np.ndarray
    end: np.ndarray


def inferred(examples: list[str], alpha: float = 0.05, smooth: float = 0.05) -> Automaton:
    """Merge statistically compatible states of the prefix tree of examples (red states are kept, blue ones are next)."""
    size = len(CLASSES) + 1
    child: list[dict[int, int]] = [{}]
    passed: list[dict[int, float]] = [{}]
    ends, total = [0.0], [0.0]
    for text in sorted(examples):
        at = 0
        for symbol in SYMBOL[list(text.encode())].tolist():
            total[at] += 1
            passed[at][symbol] = passed[at].get(symbol, 0) + 1
            if symbol not in child[at]:
                child[at][symbol] = len(child)
                child.append({})
                passed.append({})
                ends.append(0.0)
                total.append(0.0)
            at = child[at][symbol]
        total[at] += 1
        ends[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f: float, n: float, g: float, m: float) -> bool:
        return abs(f / n - g / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if not total[p] or not total[q]:
                continue
            if differ(ends[p], total[p], ends[q], total[q]):
                return False
            for s in passed[p].keys() | passed[q].keys():
                if differ(passed[p].get(s, 0), total[p], passed[q].get(s, 0), total[q]):
                    return False
                if s in child[p] and s in child[q]:
                    todo.append((child[p][s], child[q][s]))
        return True

    def fold(p: int, q: int) -> None:
        """Add the subtree of q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if p == q:
                continue
            ends[p] += ends[q]
            total[p] += total[q]
            for s, n in passed[q].items():
                passed[p][s] = passed[p].get(s, 0) + n
            for s, r in child[q].items():
                if s in child[p]:
                    todo.append((child[p][s], r))
                else:
                    child[p][s] = r

    red = [0]
    while blue := sorted({c for r in red for c in child[r].values()} - set(red), key=lambda c: (-total[c], c)):
        q = blue[0]
        owner = next((r, s) for r in red for s, c in child[r].items() if c == q)
        for p in red:
            if compatible(p, q):
                child[owner[0]][owner[1]] = p
                fold(p, q)
                break
        else:
            red.append(q)
    index = {r: i for i, r in enumerate(red)}
    n = len(red)
    to = np.full((n + 1, size), n)
    log = np.full((n + 1, size), -math.log2(size + 1) - 2.0)
    end = np.full(n + 1, -math.log2(size + 1))
    for r, i in index.items():
        whole = total[r] + smooth * (size + 1)
        for s in range(size):
            log[i, s] = math.log2((passed[r].get(s, 0) + smooth) / whole)
            if s in child[r]:
                to[i, s] = index[child[r][s]]
        end[i] = math.log2((ends[r] + smooth) / whole)
    return Automaton(to, log, end)


def _forms(rng: random.Random) -> tuple[dict, list, list]:
    """Makers of credentials by kind, of common ordinary tokens, and of rarer ones that look more like credentials."""
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = upper + lower + digit
    some = lambda chars, k: "".join(rng.choices(chars, k=k))
    plain = lambda: "".join(some("bcdfghlmnprstvw", 1) + some("aeiou", 1) + some("lnrst", rng.randint(0, 1)) for _ in range(rng.randint(2, 9)))
    short = lambda: "".join(some("bcdfghlmnprstvw", 1) + some("aeiou", 1) + some("lnrst", rng.randint(0, 1)) for _ in range(rng.randint(1, 4)))
    cased = lambda: rng.choice([str.lower, str.upper, str.capitalize])(plain())
    ordinary = [
        lambda: cased(),
        lambda: cased() + cased(),
        lambda: rng.choice("-_./").join(cased() for _ in range(rng.randint(2, 5))),
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        lambda: some(digit, rng.randint(8, 20)),
        lambda: f"{rng.randint(1990, 2030)}-{some(digit, 2)}-{some(digit, 2)}",
        lambda: f"{plain()}{some(digit, rng.randint(1, 3))}.{plain()}.com",
        lambda: f"www.{plain()}.org/{plain()}/{plain()}{some(digit, 2)}.html",
        lambda: "-" * rng.randint(8, 40),
        lambda: "." * rng.randint(8, 40),
    ]
    rarer = [
        lambda: "".join(short().capitalize() for _ in range(rng.randint(2, 6))),
        lambda: short() + "".join(short().capitalize() for _ in range(rng.randint(1, 5))),
        lambda: "".join(short().capitalize() + some(digit, rng.randint(0, 3)) for _ in range(rng.randint(2, 4))),
        lambda: short() + "".join(short().capitalize() + some(digit, rng.randint(0, 2)) for _ in range(rng.randint(1, 3))),
        lambda: some(upper, rng.randint(2, 6)) + short().capitalize() + short().capitalize() + some(digit, rng.randint(0, 2)),
        lambda: "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        lambda: rng.choice("-_./").join(some(digit, rng.randint(1, 5)) for _ in range(rng.randint(3, 6))),
        *(lambda mark=mark: mark.join(rng.choice([cased(), short(), some(digit, rng.randint(1, 4)), short() + some(digit, rng.randint(1, 3)), some(upper, rng.randint(2, 4))]) for _ in range(rng.randint(2, 6))) for mark in "-_./+"),
        lambda: "".join(x + rng.choice("-_./+") for x in (rng.choice([short(), some(digit, rng.randint(1, 4)), some(upper, rng.randint(2, 4)), short() + some(digit, 1)]) for _ in range(rng.randint(2, 6)))) + short(),
        lambda: some(upper, rng.randint(1, 3)) + some(digit, rng.randint(6, 20)),
        lambda: some(digit, 1) + some(upper, 1) + some(digit, 3) + some(upper, 2) + some(digit, rng.randint(6, 10)),
    ]
    kinds = {
        "access": lambda: "AKIA" + some(upper + "234567", 16),
        "github": lambda: "gh" + rng.choice("pousr") + "_" + some(word, 36),
        "google": lambda: "AIza" + some(word + "_-", 35),
        "jwt": lambda: "eyJ" + some(word, rng.randint(17, 40)) + ".eyJ" + some(word, rng.randint(20, 60)) + "." + some(word + "_-", 43),
        "slack": lambda: f"xox{rng.choice('bp')}-{some(digit, 12)}-{some(digit, 12)}-{some(word, 24)}",
        "stripe": lambda: rng.choice(["sk_live_", "rk_live_"]) + some(word, 24),
    }
    return kinds, ordinary, rarer


def labelled(n: int = 250, seed: int = 11) -> dict[str, list[str]]:
    """Examples of public credential formats by kind, and ordinary tokens under "", made by rule."""
    kinds, ordinary, _ = _forms(random.Random(seed))
    return {k: [f() for _ in range(n)] for k, f in kinds.items()} | {"": [f() for f in ordinary for _ in range(n)]}


def ordinary_forms(n: int = 250, seed: int = 12) -> list[list[str]]:
    """Examples of each form of ordinary tokens by itself."""
    _, ordinary, rarer = _forms(random.Random(seed))
    return [[f() for _ in range(n)] for f in (*ordinary, *rarer)]


@dataclass(frozen=True)
class Formats:
    kinds: tuple[str, ...]
    automata: tuple[Automaton, ...]
    ordinary: Automaton  # of all ordinary tokens together
    forms: tuple[Automaton, ...] = ()  # of each form by itself, which a secret must beat, too


@lru_cache(1)
def default_formats() -> Formats:
    return formats_of(labelled(), ordinary_forms())


def formats_of(examples: dict[str, list[str]], forms: list[list[str]] | None = None) -> Formats:
    """examples: labelled credentials by kind, and ordinary tokens under the empty name; forms: ordinary tokens form by form."""
    kinds = tuple(sorted(k for k in examples if k))
    return Formats(kinds, tuple(inferred(examples[k]) for k in kinds), inferred(examples[""]), tuple(inferred(f) for f in forms or ()))


def likelihoods(automaton: Automaton, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log2 of the probability of each run of symbols."""
    state, out = np.zeros(len(starts), np.int64), np.zeros(len(starts))
    live = np.arange(len(starts))
    for k in range(int(sizes.max(initial=0))):
        live = live[sizes[live] > k]
        s = symbols[starts[live] + k]
        out[live] += automaton.log[state[live], s]
        state[live] = automaton.to[state[live], s]
    return out + automaton.end[state]


def stacked(automata: tuple[Automaton, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Automata as one table of states: to, log and end, and the first state of each."""
    first = np.append(0, np.cumsum([len(a.end) for a in automata]))
    return np.concatenate([a.to + n for a, n in zip(automata, first)]), np.concatenate([a.log for a in automata]), np.concatenate([a.end for a in automata]), first[:-1]


def scored(buf: np.ndarray, offsets: np.ndarray, formats: Formats) -> list[tuple[int, str, int, int]]:
    """row, kind, start and end in bytes of the parts of runs that are secrets by their format.

    A part starts where its run does or after a separator, and ends at one or with its run.  Of all choices of parts that
    don't overlap, the one with the greatest sum of gains over MARGIN is found in one pass over positions: of all starts
    that have led a run's automata into the same states, only the best can be part of it.
    """
    starts, ends, rows = textkit.spans(TOKEN[buf], offsets)
    long = np.flatnonzero(ends - starts >= LEAST)
    if not len(long):
        return []
    long = long[np.argsort(starts[long] - ends[long], kind="stable")]  # the longest first
    starts, rows, sizes = starts[long], rows[long], (ends - starts)[long]
    symbols = SYMBOL[buf]
    between = np.append(np.isin(buf, list(SEPARATORS)), True)
    to, log, end, first = stacked(formats.automata)
    plain, kinds = formats.ordinary, len(first)
    kind_of = np.repeat(np.arange(kinds), [len(a.end) for a in formats.automata])
    best, last = np.zeros(len(starts)), np.full(len(starts), -1)  # of each run so far: the sum, and the record it ends in
    records: list[tuple[int, int, int, int]] = []  # kind, start, end, record before
    run, state, usual, since, before = (np.zeros(0, np.int64) for _ in range(5))
    value, few = np.zeros(0), 0
    for k in range(int(sizes[0])):
        live = int(np.searchsorted(-sizes, -k))  # runs with more than k characters
        at = starts[:live] + k
        opened = np.flatnonzero(~between[at] & (between[at - 1] | (k == 0)) & (sizes[:live] - k >= LEAST))
        if len(opened):
            run, state, usual = np.append(run, np.repeat(opened, kinds)), np.append(state, np.tile(first, len(opened))), np.append(usual, np.zeros(len(opened) * kinds, np.int64))
            since, before = np.append(since, np.full(len(opened) * kinds, k)), np.append(before, np.repeat(last[opened], kinds))
            value = np.append(value, np.repeat(best[opened] - MARGIN, kinds))
        symbol = symbols[starts[run] + k]
        value += log[state, symbol] - plain.log[usual, symbol]
        state, usual = to[state, symbol], plain.to[usual, symbol]
        closed = ~between[at] & ((sizes[:live] == k + 1) | between[at + 1])
        if closed.any():
            done = np.flatnonzero(closed[run] & (k + 1 - since >= LEAST))
            total = value[done] + end[state[done]] - plain.end[usual[done]]
            done, total = done[better := total > best[run[done]]], total[better]
            for i in np.argsort(total, kind="stable").tolist():  # the best of a run comes last
                e = done[i]
                best[run[e]], last[run[e]] = total[i], len(records)
                records.append((int(kind_of[state[e]]), int(since[e]), k + 1, int(before[e])))
        keep = sizes[run] > k + 1
        if not keep.all():
            run, state, usual, since, before, value = (x[keep] for x in (run, state, usual, since, before, value))
        if len(run) > 2 * few + 64:
            order = np.lexsort((-value, usual, state, run))
            r, s, u = run[order], state[order], usual[order]
            order = order[np.append(True, (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (u[1:] != u[:-1]))]
            run, state, usual, since, before, value = (x[order] for x in (run, state, usual, since, before, value))
            few = len(run)
    out = []
    for i in np.flatnonzero(last >= 0).tolist():
        at = last[i]
        while at >= 0:
            kind, a, b, at = records[at]
            out.append((int(rows[i]), formats.kinds[kind], int(starts[i]) + a, int(starts[i]) + b))
    return sorted(_beating(out, symbols, formats), key=lambda x: x[2])


def _beating(parts: list[tuple[int, str, int, int]], symbols: np.ndarray, formats: Formats) -> list[tuple[int, str, int, int]]:
    """The parts that are likelier by MARGIN bits than any form of ordinary tokens makes them."""
    if not parts or not formats.forms:
        return parts
    starts, sizes = np.array([p[2] for p in parts]), np.array([p[3] - p[2] for p in parts])
    usual = np.max([likelihoods(a, symbols, starts, sizes) for a in formats.forms], 0)
    own = np.max([likelihoods(a, symbols, starts, sizes) for a in formats.automata], 0)
    return [p for p, more in zip(parts, own - usual >= MARGIN) if more]


def _masked(kind: str, m: re.Match) -> tuple[int, int]:
    return m.span(2) if kind == "assign" else m.span()


def base_spans(text: str, hinted: bool = True, runs: bool = True) -> list[tuple[str, int, int, int]]:
    """kind, start, end of the match and where its secret starts, in code points; by start, then kind."""
    out = []
    if hinted:
        out += [("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if runs:
        out += [("hex", *m.span(), m.start()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], BASE.index(x[0])))


def found(buf: np.ndarray, offsets: np.ndarray, formats: Formats) -> list[tuple[list[tuple[str, int, int, int]], list[tuple[str, int, int, int]]]]:
    """Of each text its base spans and all its spans, in code points."""
    n = len(offsets) - 1
    data, at = buf.tobytes(), offsets.tolist()
    starts, ends, rows = textkit.spans(HEXES[buf], offsets)
    hexed = set(rows[ends - starts >= 24].tolist())
    extra: dict[int, list] = {}
    for row, kind, a, b in scored(buf, offsets, formats):
        extra.setdefault(row, []).append((kind, a, b))
    out = []
    for i in range(n):
        raw = data[at[i] : at[i + 1]]
        low = raw.lower()
        hinted, runs = any(h in low for h in HINTS), i in hexed
        if not (hinted or runs or i in extra or b"AKIA" in raw):
            out.append(([], []))
            continue
        base = base_spans(raw.decode("utf-8", "surrogatepass"), hinted, runs)
        every = list(base)
        for kind, a, b in extra.get(i, ()):
            a, b = (len(data[at[i] : x].decode("utf-8", "surrogatepass")) for x in (a, b))
            if not any(x <= a and b <= y for _, x, y, _ in base):
                every.append((kind, a, b, a))
        order = [*BASE, *formats.kinds]
        out.append((base, sorted(every, key=lambda x: (x[1], order.index(x[0])))))
    return out


def joined(spans: list[tuple[str, int, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def scan(df: DataFrame, formats: Formats | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, base and spans (arrays of kind, start, end) of each row."""
    formats = formats or default_formats()
    runtime.small_batches(df.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textkit.texts_of(batch.column(1))
            for a, b in textkit.chunks(offsets):
                both = found(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], formats)
                columns = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e, _ in pair[i]] for pair in both], span) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *columns], ["key", "base", "spans"])

    source = df.select(df[key].alias("key"), runtime.utf8(df[text]).alias("text"))
    spans = "array<struct<kind:string,start:long,end:long>>"
    return source.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, base {spans}, spans {spans}").withColumnRenamed("key", key)


def redacted(df: DataFrame, formats: Formats | None = None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every secret of its text (of an assignment, the value) replaced by a mark; null texts stay null."""
    formats = formats or default_formats()
    runtime.small_batches(df.sparkSession)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = textkit.texts_of(batch.column(place))
            texts = batch.column(place).to_pylist()
            for a, b in textkit.chunks(offsets):
                for i, (_, spans) in enumerate(found(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], formats), a):
                    if spans:
                        parts, done = [], 0
                        for start, end in sorted((s, e) for _, _, e, s in spans):
                            if start >= done:
                                parts += [texts[i][done:start], mark]
                            done = max(done, end)
                        texts[i] = "".join([*parts, texts[i][done:]])
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return df.mapInArrow(run, df.schema)


def op10_pfa_secrets(spark, sf_dir: str) -> DataFrame:
    spans = scan(runtime.table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, BASE), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
