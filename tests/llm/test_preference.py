"""Prompts, completions and masks against plain Python."""

from pyspark.sql import functions as F

from glyphflow.llm import preference


def plain(a, b):
    show = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)

    def mask(turns):
        out, at = [], 0
        for r, t in turns:
            start, at = at + len(r) + 5, at + len(r) + len(t) + 13
            out += [f"{start}:{at}"] * (r == "assistant")
        return ",".join(out)

    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    status = "unpaired" if not a or not b else "equal" if n == len(a) == len(b) else "paired"
    return (status, n, show(a[:n]), show(a[n:]), show(b[n:]), mask(a[n:]), mask(b[n:]))


def test_pairs(spark):
    u, x, y = ("user", "hi é"), ("assistant", "x" * 30), ("assistant", "")
    talks = {0: [u, x], 1: [u, y], 2: [u, x, u, y], 3: [u, x], 4: [u, x], 5: [u, x], 6: [x], 9: [y, u], 10: [("unknown", "")], 11: [("system", "s"), u, x]}
    rows = [(c, i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)] + [(0, 0, *u), (None, 0, "user", "lost")]
    rows = [(c, i, None if r == "unknown" else r, None if (r, t) == ("unknown", "") else t) for c, i, r, t in rows]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, a string").repartition(5)
    got = preference.preferences(df, F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(1) == 0).collect()
    assert {r.pair_id: tuple(r)[1:] for r in got} == {k: plain(talks.get(2 * k, []), talks.get(2 * k + 1, [])) for k in {c >> 1 for c in talks}}
    for r in got:
        for text, spans in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            for s in filter(None, spans.split(",")):
                a, b = map(int, s.split(":"))
                assert text[:a].endswith("<|assistant|>\n") and text[:b].endswith("<|end|>\n")


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.preferences(df, F.col("conv_id"), F.lit(True)).count() == 0


def test_swapped_last_turns(spark):
    u, x, y = ("user", "hi é"), ("assistant", "x" * 30), ("assistant", "")
    talks = {0: [u, x], 1: [u, y], 2: [u, x, u, y], 3: [u, x], 4: [u, x], 5: [u, x], 6: [x], 9: [y, u, x], 10: [("unknown", "")], 11: [u]}
    rows = [(c, None if c == 9 and i == 2 else i, None if r == "unknown" else r, None if (r, t) == ("unknown", "") else t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame([*rows, rows[0], (None, 0, "user", "lost")], "conv_id long, turn long, role string, text string")
    both = preference.swapped(df)
    got = {r.pair_id: tuple(r)[1:] for r in preference.formatted(both, F.col("alone")).collect()}
    want = {}
    for c, turns in talks.items():
        partner = talks.get(c ^ 1)
        want[c] = plain(turns, turns[:-1] + (partner[-1:] if partner else []))
        if not partner:
            want[c] = ("unpaired", *want[c][1:])
    assert got == want
    assert any(n for _, n, *_ in got.values())
    assert preference.formatted(preference.swapped(df.limit(0)), F.col("alone")).count() == 0
