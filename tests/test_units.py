"""Boundaries, invariants and sources that the queries over tables don't reach."""

import itertools
import json
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.functions import geometry as g
from glyphflow.functions import text
from glyphflow.operators import boxes, correct, ctc, images, pixels
from glyphflow.plans import recognition, reports
from glyphflow.sources import readers
from glyphflow.streaming import scores


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_thresholds(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 0.2), (0, 1, 0, 1, 0.2000001)], "image_id long, p int, y int, x int, v double")
    assert pixels.foreground(rows).count() == 1 and pixels.support(rows).count() == 2


def test_components_of_a_ring_and_a_diagonal(spark):
    ring = [(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (3, 3)]
    line = [(5, 5), (6, 6), (7, 5)]
    rows = [(0, y * 8 + x, y, x, 1.0) for y, x in ring + line] + [(1, 0, 0, 0, 1.0)]
    random.Random(1).shuffle(rows)
    got = pixels.components(spark.createDataFrame(rows, "image_id long, p int, y int, x int, v double"))
    assert {(r.image_id, r.root): r.n for r in got.groupBy("image_id", "root").agg(F.count("*").alias("n")).collect()} == {(0, 9): 8, (0, 45): 3, (1, 0): 1}


def test_decoded_rectangle(spark):
    rows = [(0, y * 32 + x, y, x, 0.9 if 8 <= x < 24 and 10 <= y < 16 else 0.0) for y in range(32) for x in range(32)]
    got = pixels.decoded(spark.createDataFrame(rows, "image_id long, p int, y int, x int, v double"), 32, 32).collect()
    assert len(got) == 1 and got[0].score == pytest.approx(0.9)
    d = 15 * 5 * 1.5 / 40
    assert [(round(p.x, 4), round(p.y, 4)) for p in got[0].quad] == [(round(x, 4), round(y, 4)) for x, y in ((8 - d, 10 - d), (23 + d, 10 - d), (23 + d, 15 + d), (8 - d, 15 + d))]


def test_geometry(spark):
    lit = lambda *points: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))
    q = lit((3, 2), (0, 0), (0, 2), (3, 0))
    r = one(spark, g.ordered(q).alias("q"), g.area(g.ordered(q)).alias("a"), g.aspect(g.ordered(q)).alias("r"), g.touches(g.ordered(q), 100, 100, 1.5).alias("t"), g.projective(lit((0, 0), (1, 1), (1, 1), (0, 0)), F.lit(1.0), F.lit(1.0)).alias("none"))
    assert [(p.x, p.y) for p in r.q] == [(0, 0), (3, 0), (3, 2), (0, 2)]
    assert (r.a, r.r, r.t, r.none) == (6.0, 1.5, True, None)


def test_tracks_and_reading_order(spark):
    def box(slot, x, y, w, h):
        return (0, slot, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], 0.9, False)

    rows = [box(0, 100.0, 10.0, 10.0, 40.0), box(1, 100.0, 60.0, 11.0, 40.0), box(2, 60.0, 10.0, 10.0, 60.0), box(3, 61.0, 80.0, 10.0, 30.0)]
    df = spark.createDataFrame(rows, "image_id long, slot int, quad array<struct<x:double,y:double>>, score double, supplemental boolean")
    placed = boxes.projected(df, boxes.orientation(df))
    for robust in (True, False):
        got = {r.slot: (r.track, r.place) for r in boxes.reading_order(boxes.tracks(placed, robust)).collect()}
        assert got == {0: (0, 0), 1: (0, 1), 2: (1, 2), 3: (1, 3)}
    assert sorted(r.place for r in boxes.ordered_by_predecessors(placed).collect()) == [0, 1, 2, 3]


def test_gates_at_their_bounds(spark):
    rows = [([1, 2], 0.70, True, False, 0.075, 50.0), ([1, 2], 0.699, True, False, 0.075, 50.0), ([1, 9], 0.9, True, False, 0.2, 1.0), ([], 0.0, True, True, 0.0, 0.0), ([9], 0.1, True, True, 0.0, 99.0), ([], 0.0, False, False, 0.0, None), ([1], 0.9, True, False, 0.2, None)]
    df = spark.createDataFrame(rows, "token_ids array<int>, confidence double, supplemental boolean, fallback boolean, area_ratio double, distance double")
    assert [bool(r.accepted) for r in ctc.supplement_gate(df, [1, 2]).collect()] == [True, False, False, False, True, True, False]


def test_calibration_totals():
    cells = ctc.calibration()
    assert len(cells) == 32 and sum(r[3] for r in cells) == 91 and sum(r[4] for r in cells) == 1333


def test_hallucination_wants_a_prior(spark):
    with pytest.raises(ValueError):
        ctc.hallucination(spark.range(1), spark.range(1), prior=1.0)


def test_shouts_follow_the_policy(spark):
    def policy(run):
        if len(run) < 2:
            return run
        return run[0] + ("?" if run[0] == "!" else "!") if len(set(run)) > 1 else run[0] * 2

    texts = ["".join(t) for n in range(7) for t in itertools.product("!?a", repeat=n)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.shouts(F.col("t")).alias("s")).collect()
    assert all(r.s == re.sub(r"[!?]+", lambda m: policy(m[0]), r.t) for r in got)


def test_vectors_and_folding(spark):
    got = recognition.norm_punct_vectors(spark, "").collect()
    assert all(r.display == recognition.VECTORS[r.source] and r.idempotent for r in got)
    cases = {"ﾍﾟﾝ": "ぺン", "ＡＢ１": "AB1", "￥": "¥", "“x”": '"x"', "ｶﾞ": "ガ", "e\u0301": "é", "Ⅳ": "IV", "…": "・・・", " a ": "a", "": ""}
    assert {k: text.folded_text(k) for k in cases} == cases
    assert text.folded_text("a\x07b") is None
    for k in cases:
        assert text.folded_text(text.folded_text(k)) == text.folded_text(k)


def test_lattice_and_rows(spark):
    assert text.lattice_distance([["a", "ab"], ["c"]], "abc") == (0, 3)
    assert text.lattice_distance([], "abc") == (3, 3)
    r = one(spark, text.next_row(F.array(*map(F.lit, range(4))), F.lit("abc"), F.lit("b")).alias("row"))
    assert r.row == [1, 1, 1, 2]


def test_characters(spark):
    chars = "aア々ー〜①1漢あー\u30fb é"
    got = spark.createDataFrame([(c,) for c in sorted(set(chars))], "c string").select("c", correct.editable(F.col("c")).alias("e"), correct.family(F.col("c")).alias("f")).collect()
    assert {r.c for r in got if r.e} == set("aア々①1漢あé")
    assert {r.c: r.f for r in got if r.c in "aア1漢あ"} == {"a": "latin", "ア": "katakana", "1": "digit", "漢": "han", "あ": "hiragana"}


def test_replacement_threshold(spark):
    rows = [(0, c, 1, k, s, True) for c, other in ((0, 2.0), (1, 2.5)) for k, s in ((1, 0.0), (2, other))] + [(0, 2, 1, 1, 0.0, True), (0, 2, 1, 3, 9.0, False)]
    df = spark.createDataFrame(rows, "block int, cell int, keep int, cls int, score double, can boolean")
    decided = correct.replacements(df)
    assert {r.cell: r.replaced for r in decided.collect()} == {0: False, 1: True, 2: False}
    assert not any(r.replaced for r in correct.replacements(df, most=2).collect())
    r = correct.assembled(decided).first()
    assert (r.token_ids, r.token_count, r.edited) == ([1, 2, 1], 3, True)


def test_reports(spark):
    empty = spark.createDataFrame([], "reference string, prediction string")
    r = reports.score(empty, F.col("reference"), F.col("prediction")).first()
    assert (r.samples, r.edit_distance, r.em, r.cer) == (0, 0, None, None)
    values = spark.range(1, 12).select(F.col("id").cast("double").alias("v"))
    assert [reports.nearest_p90(values.where(f"v <= {n}"), "v").first().p90 for n in (1, 2, 10, 11)] == [1.0, 1.0, 9.0, 9.0]
    with pytest.raises(Exception, match="a key has no row"):
        reports.matched(spark.range(3), spark.createDataFrame([(0, 1.0), (1, 2.0)], "k long, o double"), "id", "k", "o").collect()


def png(pixels_, kinds):
    h, w, n = pixels_.shape
    raw, up = b"", np.zeros((w, n), int)
    for row, kind in zip(pixels_.astype(int), kinds):
        out = np.zeros((w, n), int)
        for x in range(w):
            left, corner = (row[x - 1], up[x - 1]) if x else (np.zeros(n, int), np.zeros(n, int))
            p = left + up[x] - corner
            paeth = np.where((abs(p - left) <= abs(p - up[x])) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up[x]) <= abs(p - corner), up[x], corner))
            out[x] = row[x] - [0, left, up[x], (left + up[x]) // 2, paeth][kind]
        raw += bytes([kind]) + (out & 255).astype(np.uint8).tobytes()
        up = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(2)
    rgb, gray = rng.integers(0, 256, (5, 7, 3)), rng.integers(0, 256, (4, 6, 1))
    (tmp_path / "a.png").write_bytes(png(rgb, [0, 1, 2, 3, 4]))
    (tmp_path / "b.png").write_bytes(png(gray, [4, 3, 2, 1]))
    (tmp_path / "c.png").write_bytes(b"broken")
    df = readers.images(spark, str(tmp_path))
    got = {r.path[-5]: r for r in df.collect()}
    assert np.array_equal(np.frombuffer(got["a"].pixels, np.uint8).reshape(5, 7, 3), rgb[:, :, ::-1])
    assert np.array_equal(np.frombuffer(got["b"].pixels, np.uint8).reshape(4, 6, 3), np.repeat(gray, 3, 2))
    assert got["c"].error and got["c"].pixels is None
    shown = {(r.y, r.x): (r.r, r.g, r.b) for r in readers.image_pixels(df.where("path like '%a.png'")).collect()}
    assert shown == {(y, x): tuple(rgb[y, x]) for y in range(5) for x in range(7)}
    box = images.letterbox(df, 8).collect()
    assert len(box) == 2 and all(len(r.tensor) == 3 * 8 * 8 for r in box)


def test_resampling():
    image = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    assert np.array_equal(images.resized(image, 4, 6), image)
    assert np.unique(images.resized(np.full((5, 9, 3), 77, np.uint8), 13, 4)).tolist() == [77]
    crop = images.cropped(image, [1, 0, 1, 0, 1, 2, 0, 0], 3, 2, 5)
    assert np.allclose((crop[:, :, :3] + 1) * 127.5, image[2:4, 1:4].transpose(2, 0, 1)) and not crop[:, :, 3:].any()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"image_path": "a", "text": "x", "id": "1"}\n\n{"image_path": "b", "sample_id": "2", "id": "9"}\n')
    assert [(r.image_path, r.sample_id) for r in readers.manifest(spark, str(tmp_path / "m.jsonl")).where("image_path is not null").collect()] == [("a", "1"), ("b", "2")]
    (tmp_path / "ids.txt").write_text("a\n\n b \na\n")
    assert sorted(r.value for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    (tmp_path / "dict.txt").write_text("あ\n!\n")
    assert [(r.id, r.ch) for r in readers.dictionary(spark, str(tmp_path / "dict.txt"), True).collect()] == [(0, "blank"), (1, "あ"), (2, "!"), (3, " ")]
    assert readers.preset('x:\n  aliases:\n    "～": "〜"\n    a: b\n') == {"aliases": {"～": "〜", "a": "b"}}
    (tmp_path / "r.json").write_text('{\n "a": {"b": 1}\n}\n')
    assert readers.report(spark, str(tmp_path / "r.json")).first().a.b == 1
    readers.write_report(spark.createDataFrame([(1, "é")], "n int, t string"), str(tmp_path / "out"))
    assert json.loads("".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "out")).collect())) == {"n": 1, "t": "é"}
    readers.write_predictions(spark.createDataFrame([("1", None)], "sample_id string, prediction string"), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).columns == ["prediction", "sample_id"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"sample_id": str(i), "reference": "ab!!!", "prediction": "ab!!" if i else "xb"}) + "\n")
    stream = scores.pairs_stream(spark, str(tmp_path / "in"), 1)
    query = scores.each_batch(stream, scores.running, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = spark.read.json(str(tmp_path / "out"))
    assert got.agg(F.sum("samples"), F.sum("exact_matches"), F.sum("edit_distance")).first()[:] == (3, 2, 3)


def test_model_contract(spark):
    out = images.scored(spark.range(5), lambda pdf: pdf.assign(v=pdf["id"] * 2), "id long, v long")
    assert sorted(r.v for r in out.collect()) == [0, 2, 4, 6, 8]


def test_sample_is_stable(spark):
    a = reports.sampled(spark.range(1000), F.col("id"), 20).collect()
    assert a == reports.sampled(spark.range(1000).repartition(7).orderBy(F.rand(1)), F.col("id"), 20).collect()


QUAD = "image_id long, slot int, quad array<struct<x:double,y:double>>, score double, supplemental boolean"


def turned(cx, cy, w, h, angle):
    cos, sin = np.cos(angle), np.sin(angle)
    return [(float(cx + (x * w * cos - y * h * sin) / 2), float(cy + (x * w * sin + y * h * cos) / 2)) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def test_components_against_a_walk(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for image in (3, 9, 4):
        on = {(y, x) for y in range(40) for x in range(30) if rng.random() < 0.42}
        rows += [(image, y * 30 + x, y, x, 1.0) for y, x in on]
        while on:
            todo, seen = [next(iter(on))], set()
            on.discard(todo[0])
            while todo:
                y, x = todo.pop()
                seen.add((y, x))
                near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & on
                on -= near
                todo += near
            want.update({(image, y, x): min(b * 30 + a for b, a in seen) for y, x in seen})
    rng.shuffle(rows)
    got = pixels.components(spark.createDataFrame(rows, "image_id long, p int, y int, x int, v double")).collect()
    assert {(r.image_id, r.y, r.x): r.root for r in got} == want
    assert pixels.components(spark.createDataFrame([], "image_id long, p int, y int, x int, v double")).count() == 0


def test_base_boxes_alone_give_the_median(spark):
    rows = [(0, 0, turned(20, 20, 10, 10, 0), 0.9, False), (0, 1, turned(60, 60, 100, 100, 0), 0.9, True), (0, 2, turned(60, 60, 90, 90, 0), 0.9, True), (1, 0, turned(9, 9, 4, 4, 0), 0.9, True)]
    got = {(r.image_id, r.slot): r.area_ratio for r in boxes.with_area_ratio(spark.createDataFrame(rows, QUAD)).collect()}
    assert got == pytest.approx({(0, 0): 1.0, (0, 1): 100.0, (0, 2): 81.0, (1, 0): 16.0})


def test_a_fallback_is_never_optional(spark):
    images = spark.createDataFrame([(0, 50.0, 40.0), (1, 50.0, 40.0)], "image_id long, w double, h double")
    few = spark.createDataFrame([(1, 0, turned(25, 20, 10, 10, 0), 0.5, False)], QUAD)
    got = {r.image_id: r.optional for r in boxes.with_flags(boxes.with_area_ratio(boxes.with_fallback(images, few)), 50, 40).collect()}
    assert got == {0: False, 1: True}


def test_without_a_base_box_a_supplement_is_refused(spark):
    df = spark.createDataFrame([(0, 0, turned(9, 9, 4, 4, 0.3), 0.9, True)], QUAD)
    row = boxes.nearest(df.where("not supplemental"), df)
    assert row.first().distance == float("inf")
    regions = row.select("distance", F.array(F.lit(1)).alias("token_ids"), F.lit(0.9).alias("confidence"), "supplemental", F.lit(False).alias("fallback"), F.lit(1.0).alias("area_ratio"))
    assert ctc.supplement_gate(regions, [1]).first().accepted is False


@pytest.mark.parametrize("angle", [0.0, 0.4, -0.7])
@pytest.mark.parametrize("ratio, end", [(1.04, 0.85), (1.06, 0.35)])
def test_expansion_turns_with_the_box(spark, angle, ratio, end):
    """A box of 20 by 20 * ratio, with two lit pixels 1 and 9 beyond its right side: a cap of 0.85 or 0.35 short sides."""
    centre = np.array([50.0, 50.0])
    axis = np.array([np.cos(angle), np.sin(angle)])
    cross = np.array([-np.sin(angle), np.cos(angle)])
    lit = [tuple(np.round(centre + (10 + far) * axis + off * cross).astype(int).tolist()) for far, off in ((1.2, 0), (1.2, 2), (9, 0), (5, -2))]
    rows = [(0, y * 100 + x, y, x, 0.9) for x, y in set(lit)]
    df = spark.createDataFrame([(0, 0, turned(50, 50, 20, 20 * ratio, angle), 0.9, False)], QUAD)
    got = boxes.expanded(df, spark.createDataFrame(rows, "image_id long, p int, y int, x int, v double"), 100, 100).first()
    far = [float((np.array(p) - centre) @ axis) - 10 for p in set(lit)]
    cap = min(max(end * 20, 2.0), 18.0)
    seen = [f for f in far if 0 < f <= cap]
    move = min(max(seen) + 0.75, cap)
    assert list(got.sides) == [False, True, False, False]
    want = [centre + u * axis + v * cross for u, v in ((-10, -10 * ratio), (10 + move, -10 * ratio), (10 + move, 10 * ratio), (-10, 10 * ratio))]
    assert [(round(p.x, 6), round(p.y, 6)) for p in got.quad] == [(round(float(x), 6), round(float(y), 6)) for x, y in want]


def test_expansion_stops_at_the_edge(spark):
    df = spark.createDataFrame([(0, 0, turned(5, 5, 8, 8, 0), 0.9, False), (0, 1, turned(50, 50, 8, 8, 0), 0.9, False)], QUAD)
    rows = [(0, 0, y, x, 0.9) for y in (4, 5) for x in (0,)]
    got = {r.slot: r for r in boxes.expanded(df, spark.createDataFrame(rows, "image_id long, p int, y int, x int, v double"), 100, 100).collect()}
    assert got[0].quad[0].x == 0.0 and list(got[0].sides) == [True, False, False, False]
    assert [tuple(p) for p in got[1].quad] == turned(50, 50, 8, 8, 0) and not any(got[1].sides)


@pytest.mark.parametrize("angle", [0.0, 0.5])
def test_narrow_boxes_take_their_peers_width(spark, angle):
    sizes = [(8, 40), (12.1, 40), (13, 40), (11.9, 44)]
    rows = [(0, i, turned(100 * i, 50, w, h, angle), 0.9, False) for i, (w, h) in enumerate(sizes)]
    got = {r.slot: r for r in boxes.repaired(spark.createDataFrame(rows, QUAD)).collect()}
    assert [got[i].repaired for i in range(4)] == [True, False, False, False]
    assert [(round(p.x, 6), round(p.y, 6)) for p in got[0].quad] == [(round(x, 6), round(y, 6)) for x, y in turned(0, 50, 12.1, 40, angle)]


def test_primary_boxes_of_a_looser_decode(spark):
    rows = [(0, 0, turned(50, 50, 5, 30, 0.2), 0.45, False), (0, 1, turned(50, 50, 4.99, 30, 0.2), 0.9, False), (0, 2, turned(1, 50, 2, 30, 0), 0.9, False), (0, 3, turned(50, 50, 9, 9, 0), 0.4499, False)]
    got = pixels.primary_of(spark.createDataFrame(rows, QUAD), 100, 100)
    assert sorted(r.slot for r in got.collect()) == [0, 2]
    assert boxes.large_enough(spark.createDataFrame([(0, 0, turned(9, 9, 4, 4, 0), 0.9, False), (0, 1, turned(9, 9, 4, 3.99, 0), 0.9, False)], QUAD)).count() == 1
    assert {r.image_id: r.boxes for r in boxes.valid_counts(spark.createDataFrame([(0,), (7,)], "image_id long"), got).collect()} == {0: 2, 7: 0}


def plain_order(quads, robust):
    """Place of each box, by matrices of pairs."""
    q = np.array(quads)
    w, h = np.hypot(*(q[:, 1] - q[:, 0]).T), np.hypot(*(q[:, 3] - q[:, 0]).T)
    area = np.maximum(w * h, 1)
    use = np.ones(len(q), bool)
    if robust:
        sure = (np.maximum(w, h) / np.minimum(w, h) >= 1.25) & (area >= 0.15 * np.sort(area)[(len(q) - 1) // 2])
        use = sure if sure.any() else use
    vertical = (area * np.log((h + 1) / (w + 1)))[use].sum() >= 0
    axes = q[:, 3] - q[:, 0] + q[:, 2] - q[:, 1] if vertical else q[:, 1] - q[:, 0] + q[:, 2] - q[:, 3]
    axes = axes / np.hypot(*axes.T)[:, None]
    axes = np.where((axes[:, int(vertical)] < 0)[:, None], -axes, axes)
    read = (axes * area[:, None])[use].sum(0)
    read /= np.hypot(*read)
    cross = np.array([read[1], -read[0]]) if vertical else np.array([-read[1], read[0]])
    r, c, rm, cm = q @ read, q @ cross, q.mean(1) @ read, q.mean(1) @ cross
    share = lambda p: np.maximum(np.minimum.outer(p.max(1), p.max(1)) - np.maximum.outer(p.min(1), p.min(1)), 0)
    least = lambda p: np.minimum.outer(np.ptp(p, 1), np.ptp(p, 1))
    gap = np.maximum(np.maximum.outer(r.min(1), r.min(1)) - np.minimum.outer(r.max(1), r.max(1)), 0)
    a, b, d = (0.25, 0.65, 0.35) if robust else (0.35, 0.50, 0.20)
    same = ((share(c) >= a * least(c)) | (np.abs(np.subtract.outer(cm, cm)) <= b * least(c))) & (share(r) <= d * least(r))
    if not robust:
        same &= gap <= 0.75 * least(r)
    root = list(range(len(q)))
    for i in range(len(q)):
        if robust:
            fits = [(abs(cm[t] - cm[i]), t) for t in range(i) if root[t] == t and all(same[i, m] for m in range(i) if root[m] == t)]
            root[i] = min(fits)[1] if fits else i
        else:
            low = min([root[j] for j in range(i) if same[i, j]] + [i])
            joined = {root[j] for j in range(i) if same[i, j]}
            root = [low if j == i or (j < i and root[j] in joined) else root[j] for j in range(len(q))]
    mean = {t: round(float(np.mean([cm[i] for i in range(len(q)) if root[i] == t])), 9) for t in set(root)}
    lines = sorted(mean, key=lambda t: (-mean[t] if vertical else mean[t], t))
    places = sorted(range(len(q)), key=lambda i: (lines.index(root[i]), rm[i], i))
    return {i: (lines.index(root[i]), places.index(i)) for i in range(len(q))}


@pytest.mark.parametrize("robust", [True, False])
def test_reading_order_against_matrices(spark, robust):
    rng = random.Random(3)
    images = []
    for k in range(25):
        lean = rng.uniform(-0.3, 0.3)
        images.append([turned(rng.uniform(0, 120), rng.uniform(0, 120), rng.uniform(4, 30), rng.uniform(4, 60 if k % 2 else 20), lean + rng.uniform(-0.1, 0.1)) for _ in range(rng.randint(1, 9))])
    df = spark.createDataFrame([(k, i, q, 0.9, False) for k, quads in enumerate(images) for i, q in enumerate(quads)], QUAD)
    placed = boxes.projected(df, boxes.orientation(df, robust))
    got = {}
    for r in boxes.reading_order(boxes.tracks(placed, robust)).collect():
        got.setdefault(r.image_id, {})[r.slot] = (r.track, r.place)
    assert got == {k: plain_order(quads, robust) for k, quads in enumerate(images)}


def test_offline_correction_and_reports(spark):
    rows = [(0, 0, 1, 1, 1.0), (0, 0, 1, 2, 3.5), (0, 1, 4, 4, 2.0), (0, 2, 5, 5, 0.0), (0, 2, 5, 6, 1.9), (0, 2, 5, 3, 1.9)]
    got = correct.offline(spark.createDataFrame(rows, "block long, cell int, keep int, cls int, score double"), 2.0, 1.0).first()
    assert (list(got.token_ids), got.edits, got.cells) == ([2, 4, 5], 1, 3)
    assert [tuple(p) for p in got.proposals] == [(0, 2, 2.5), (2, 3, 1.9)]
    with pytest.raises(Exception, match="no candidate"):
        correct.offline(spark.createDataFrame([(0, 0, 9, 1, 1.0)], "block long, cell int, keep int, cls int, score double")).collect()
    assert reports.series({"65+": {"mean_ms": 2}, "01": {"mean_ms": 1.5}, "02": {}}) == [("01", 1.5), ("65+", 2.0)]
    assert [r.id for r in reports.first_rows(spark.range(9), 3, "id").collect()] == [0, 1, 2]


def test_margins_round_as_in_sql(spark):
    import duckdb

    rng = random.Random(11)
    places = [(k, round(-rng.uniform(0, 16), 6), rng.randint(0, 3000)) for k in range(2000)]
    pairs = [(k, a, round(a + n / 1000 + 0.000495, 6)) for k, a, n in places]
    rows = [r for k, a, b in pairs for r in ((k, 0, 1, 1, a, True), (k, 0, 1, 2, b, True))]
    df = spark.createDataFrame(rows, "block long, cell int, keep int, cls int, score double, can boolean")
    want = {k: duckdb.execute("SELECT round(?::DOUBLE - ?::DOUBLE, 5)", [b, a]).fetchone()[0] for k, a, b in pairs}
    assert {r.block: r.proposals[0].margin for r in correct.offline(df, 1.0, 0.0).collect()} == want
    assert {r.block: r.margin for r in correct.replacements(df, 1.0, digits=5).collect()} == want


def test_margins_at_the_threshold(spark):
    pairs = [(k, -k / 13, 1 - k / 13) for k in range(1, 200)]
    rows = [r for k, a, b in pairs for r in ((k, 0, 1, 1, a, True), (k, 0, 1, 2, b, True))]
    df = spark.createDataFrame(rows, "block long, cell int, keep int, cls int, score double, can boolean")
    scored = df.withColumn("score", correct.rounded(F.col("score"), 6))
    assert {r.block for r in correct.replacements(scored, 1.0, digits=6).collect() if r.replaced} == set()
