"""The signature join against brute force over all pairs."""

import random

import numpy as np
import pytest

from glyphflow.llm import partenum


def plain_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted(((d, len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, groups=25, copies=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.sample(words, 30)
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([1, 2, 4, 5, 6, 9, 14, 25, 60, 150]))
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own = own[: rng.randint(1, len(own))]
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (904, "a B"), (None, "a b"), (905, "É x"), (906, "é x")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, sid string, n int")
    got = sorted((tuple(r) for r in partenum.components(df).collect()), key=str)
    assert got == brute(rows)
    assert any(c != d for d, _, c in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert partenum.components(df).count() == 0


def similar_pairs(sizes, rng):
    for size in sizes:
        for _ in range(20):
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            drop = rng.integers(0, size // 4 + 1)
            one, two = np.unique(base), np.unique(np.append(base[drop:], rng.integers(0, 1 << 63, rng.integers(0, max(1, size // 4 - drop + 1)), dtype=np.uint64)))
            both = len(np.intersect1d(one, two))
            if 100 * both >= 75 * (len(one) + len(two) - both):
                yield one, two


def test_linked_sets_share_signatures():
    for one, two in similar_pairs([1, 2, 3, 8, 20, 50, 87, 88, 120, 156, 157, 160, 279, 280, 400, 900, 5000], np.random.default_rng(5)):
        sig, owner, step, few = partenum.signatures(np.concatenate([one, two]), np.array([len(one), len(two)]))
        assert not few.any()
        band = np.searchsorted(partenum.LOWS, [len(one), len(two)], "right") - 1
        asked = partenum.shares(band.max())
        assert len(set(sig[owner == 0]) & set(sig[owner == 1])) >= asked
        instance = max(band)
        for i in (0, 1):
            assert asked <= len(set(sig[(owner == i) & (band[owner] + step == instance)]))


def test_signatures_are_subsets_of_pieces():
    keys = np.unique(np.random.default_rng(8).integers(0, 1 << 63, 400, dtype=np.uint64))
    sig, _, _, _ = partenum.signatures(keys, np.array([len(keys)]))
    assert len(np.unique(sig)) == len(sig) and len(sig) < 1.6 * len(keys)


def test_too_few_pieces_are_told():
    keys = np.unique(np.random.default_rng(9).integers(0, 1 << 63, 40_000, dtype=np.uint64))
    cells = partenum.textkit.mix(keys + np.uint64(0x2545F4914F6CDD1D)) % np.uint64(3 * (int(partenum.HIGHS[8] / partenum.CONTENT) + 2))
    crowded = keys[cells < 30][:200]  # all in ten parts
    assert len(crowded) == 200 and partenum.LOWS[8] <= 200 <= partenum.HIGHS[8]
    assert partenum.signatures(crowded, np.array([200]))[3].all()
    assert not partenum.signatures(crowded, np.array([200]), 1)[3].any()


def test_pairs_and_forests():
    rng = np.random.default_rng(6)
    sets = [s for pair in similar_pairs([5, 40, 300], rng) for s in pair]
    got = partenum.linked_pairs(np.concatenate(sets), np.array([len(s) for s in sets]))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            assert i == j or got[i, j] == (100 * both >= 75 * (len(x) + len(y) - both))
    links = np.eye(7, dtype=bool)
    for i, j in ((0, 3), (3, 5), (2, 6)):
        links[i, j] = links[j, i] = True
    assert sorted(zip(*map(list, partenum.forest(links)))) == [(0, 3), (0, 5), (2, 6)]


@pytest.mark.parametrize("what", [{"BLOCK": 8}, {"BLOCK_ELEMENTS": 500}, {"MOST": 20, "RANGE": 50}, {"PACK": 300, "RANGE": 500, "COLUMNS": 16}, {"BROADCAST_ROWS": 0}])
def test_a_large_group_in_blocks(spark, monkeypatch, what):
    """Near copies whose links are few, copies, a passage that many share, blocks, streams and shuffles in place of broadcasts."""
    for name, value in what.items():
        monkeypatch.setattr(partenum, name, value)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    base, passage = rng.sample(words, 60), rng.sample(words, 40)
    rows = []
    for _ in range(90):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            own[rng.randrange(60)] = rng.choice(words)
        rows.append(" ".join(own))
    rows += [" ".join(base)] * 40 + [" ".join(passage + rng.sample(words, rng.randint(5, 60))) for _ in range(60)]
    rows += [" ".join(base[k:]) for k in range(0, 40, 3)]
    rng.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    got = sorted((tuple(r) for r in partenum.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()), key=str)
    assert got == brute(rows)


def test_long_texts(spark):
    """Texts beyond one chunk and sets of many thousand elements, in the bands of large sets."""
    rng = random.Random(7)
    words = [f"word{i}" for i in range(50_000)]
    base = rng.choices(words, k=160_000)  # 1.4 MB
    near, far = list(base), list(base)
    for i in rng.sample(range(len(base)), 3000):
        near[i] = "x"
    for i in rng.sample(range(len(base)), 16_000):
        far[i] = "y"
    middle = rng.choices(words, k=4000)
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(middle)), (5, " ".join(middle[:3300])), (6, " ".join(middle[:2800]))]
    got = sorted(tuple(r) for r in partenum.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("one_task", [0, partenum.ONE_TASK])
def test_components_of_a_long_path(spark, monkeypatch, one_task):
    monkeypatch.setattr(partenum, "ONE_TASK", one_task)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (150, 200)], "a long, b long")
    got = {r.node: r.root for r in partenum.contracted(edges).collect()}
    assert {k: got.get(k, k) for k in [*range(61), 100, 150, 200]} == {**{k: 0 for k in range(61)}, 100: 100, 150: 100, 200: 100}


def test_one_representative_of_each_component(spark):
    words = [f"w{i}" for i in range(300)]
    near = lambda a, i: " ".join(words[a : a + 40] + [f"x{i}"])
    rows = [(1, near(0, 0), "a"), (1, near(0, 0), "a"), (1, near(0, 0), "b"), (2, near(0, 1), "a")]  # a repeated row
    rows += [(3, near(60, 0), "a"), (3, near(60, 1), "a"), (4, near(60, 2), "a")]  # near texts of one id
    rows += [(None, near(120, 0), "a"), (None, near(120, 0), "a"), (None, near(120, 1), "a")]  # ids that are null
    rows += [(None, near(180, 0), "a"), (5, near(180, 1), "a"), (6, near(240, 0), "a"), (3, "another text of the id three", "a"), (7, "", "a"), (8, None, "a")]
    got = partenum.representatives(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    group = lambda r: (r[1] or "").rsplit(" ", 1)[0] or r[0]
    assert sorted(map(str, map(group, got))) == sorted(map(str, {group(r) for r in rows}))
    assert {r.doc_id for r in got} == {1, 3, None, 5, 6, 7, 8}
    assert all(tuple(r) in rows for r in got)


def exchanges_of_binaries(plan):
    """The shuffles in a physical plan whose rows have a binary column: signatures or elements."""
    nodes, found = [plan], 0
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        found += node.nodeName() == "Exchange" and "binary" in node.schema().simpleString()
    return found


def test_elements_are_shuffled_twice_at_most(spark, monkeypatch):
    """Once by set, to leave out repeated rows and to find the labels, and once by label; also without any broadcast."""
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    written, seen = partenum.runtime.written, []

    def watched(df, what):
        seen.append((what, exchanges_of_binaries(df._jdf.queryExecution().executedPlan())))
        return written(df, what)

    monkeypatch.setattr(partenum.runtime, "written", watched)
    rows = corpus(3, groups=6)
    rows += rows[:5]  # repeated rows, in other partitions
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        got = sorted((tuple(r) for r in partenum.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(rows)
    assert dict(seen)["labels"] == 1  # the signatures
    assert sum(n for what, n in seen if what != "labels") == 2


def test_bytes_of_a_packed_signature(spark):
    """A signature keeps few more bits than tell those of all sets apart; its differences from one to the next compress."""
    rng = random.Random(11)
    texts = [" ".join(f"v{rng.randrange(10**9)}" for _ in range(300)) for _ in range(800)]
    total = 800 * 296
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)

    def sent(bits):
        rows = partenum._packed(docs, 4, 0, bits).collect()
        size = sum(len(partenum.pa.compress(bytes(x), "lz4")) for r in rows for x in (r.sigs, r.refs, r.sids, r.sizes))
        return size / sum(len(r.refs) // 4 for r in rows)

    assert sent(partenum.kept_bits(total)) < 5.5 < 7 < sent(56)
    assert [partenum.kept_bits(n) for n in (0, 10**9, 7 * 10**9, 10**12, 10**18)] == [40, 40, 43, 50, 56]


def test_signatures_that_collide_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(partenum, "LEAST_BITS", 8)
    monkeypatch.setattr(partenum, "SPARE_BITS", -4)
    rows = corpus(5)
    got = sorted((tuple(r) for r in partenum.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == brute(rows)
