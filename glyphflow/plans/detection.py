"""Queries over probability maps and boxes, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from glyphflow.functions import geometry as g
from glyphflow.operators import boxes as b
from glyphflow.operators import pixels as px
from glyphflow.plans.fixtures import BOXES, PIXELS, SIDE, boxes, pixels, table

LOW = 0.05

LABELS = f"""{PIXELS},
fg AS (SELECT * FROM px WHERE v > {LOW}),
reach AS (
  SELECT image_id, p, y, x, p AS root FROM fg
  UNION SELECT f.image_id, f.p, f.y, f.x, r.root FROM reach r JOIN fg f ON f.image_id = r.image_id AND abs(f.y - r.y) <= 1 AND abs(f.x - r.x) <= 1),
labels_ AS (SELECT image_id, p, y, x, min(root) AS root FROM reach GROUP BY ALL),
sizes AS (SELECT image_id, root, count(*) AS size FROM labels_ GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY size DESC, root) - 1 AS slot, count(*) OVER (PARTITION BY image_id) AS raw_count FROM sizes),
big AS (SELECT image_id, root FROM ranked WHERE CHOSEN),
moments AS (
  SELECT image_id, root, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM labels_ GROUP BY ALL),
axes AS (
  SELECT image_id, root, 0.5::DOUBLE * atan2((2 * (n * sxy - sx * sy))::DOUBLE, ((n * sxx - sx * sx) - (n * syy - sy * sy))::DOUBLE) AS angle FROM moments)"""


def _tried(name: str, source: str, degrees) -> str:
    offsets = ", ".join(f"({i}, {math.radians(d)!r}::DOUBLE)" for i, d in enumerate(degrees))
    return f"""{name}_tried AS (
  SELECT a.image_id, a.root, o.i, a.angle + o.offs AS angle FROM {source} a JOIN big USING (image_id, root), (VALUES {offsets}) AS o(i, offs)),
{name}_each AS (
  SELECT t.image_id, t.root, i, angle, min(cos(angle) * x + sin(angle) * y) AS u0, max(cos(angle) * x + sin(angle) * y) AS u1,
    min(cos(angle) * y - sin(angle) * x) AS v0, max(cos(angle) * y - sin(angle) * x) AS v1
  FROM {name}_tried t JOIN labels_ l ON t.image_id = l.image_id AND t.root = l.root GROUP BY ALL),
{name} AS (
  SELECT * EXCLUDE (r) FROM (SELECT *, round((u1 - u0) * (v1 - v0), 9) AS area, row_number() OVER (PARTITION BY image_id, root ORDER BY round((u1 - u0) * (v1 - v0), 9), i) AS r FROM {name}_each) WHERE r = 1)"""


SMALL = LABELS.replace("CHOSEN", "size >= 4")
FITTED = LABELS + ",\n" + _tried("coarse", "axes", px.COARSE) + ",\n" + _tried("rect", "coarse", px.FINE)
RECTS = FITTED.replace("CHOSEN", "size >= 4")
SCORING = f"""
scored AS (
  SELECT r.image_id, r.root, any_value(angle) AS angle, any_value(u0) AS u0, any_value(u1) AS u1, any_value(v0) AS v0, any_value(v1) AS v1, any_value(u1 - u0) AS du, any_value(v1 - v0) AS dv, avg(v) AS score FROM rect r JOIN px p ON p.image_id = r.image_id
    AND cos(angle) * x + sin(angle) * y BETWEEN u0 - {px.EDGE}::DOUBLE AND u1 + {px.EDGE}::DOUBLE AND cos(angle) * y - sin(angle) * x BETWEEN v0 - {px.EDGE}::DOUBLE AND v1 + {px.EDGE}::DOUBLE
  GROUP BY r.image_id, r.root)"""


SCORED = RECTS + "," + SCORING


def ordered_sql(points: str) -> str:
    """The corners, in order, of a list of four structs (x, y), as a list."""
    level = f"list_sort(list_transform({points}, lambda p: {{'level': round(p.x, 6), 'rank': round(p.y, 6), 'x': p.x, 'y': p.y}}))"
    by = lambda part: f"list_sort(list_transform({level}[{part}], lambda p: {{'rank': p.rank, 'x': p.x, 'y': p.y}}))"
    return f"[{by('1:2')}[1], {by('3:4')}[1], {by('3:4')}[2], {by('1:2')}[2]]"


def _flat(q, places: int = 6):
    """The corners of a quad as columns x0, y0, ..."""
    return [(F.round(q[i][k], places) + 0.0).alias(f"{k}{i}") for i in range(4) for k in ("x", "y")]


def _flat_sql(q: str, places: int = 6) -> str:
    return ", ".join(f"round({q}[{i + 1}].{k}, {places}) + 0.0 AS {k}{i}" for i in range(4) for k in ("x", "y"))


CORNERS = "[{'x': ax, 'y': ay}, {'x': jx, 'y': jy}, {'x': cx, 'y': cy}, {'x': dx, 'y': dy}]"


def _unclipped_sql(most: float, threshold: float) -> str:
    cut = lambda v: f"greatest(0, least({v}, {most}::DOUBLE))"
    point = lambda u, v: f"{{'x': {cut(f'{u} * cos(angle) - {v} * sin(angle)')}, 'y': {cut(f'{u} * sin(angle) + {v} * cos(angle)')}}}"
    low, high, left, right = "(v0 - d)", "(v1 + d)", "(u0 - d)", "(u1 + d)"
    points = f"[{point(left, low)}, {point(right, low)}, {point(right, high)}, {point(left, high)}]"
    return f"""s AS (SELECT *, du * dv * 1.5::DOUBLE / greatest(2 * (du + dv), 1e-6) AS d FROM scored WHERE least(du, dv) >= 1.0 AND round(score, 6) >= {threshold}::DOUBLE),
o AS (SELECT image_id, root, round(score, 6) AS score, {ordered_sql(points)} AS q FROM s WHERE least(du, dv) + 2 * d >= 3.0)"""


def _lines(spark, sf_dir):
    return px.lines(px.components(px.foreground(pixels(spark, sf_dir), LOW)))


def _large(spark, sf_dir):
    return px.at_least(_lines(spark, sf_dir), 4)


def pixel_thresholds(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("v", F.round("v", 2))
    a = px.foreground(rows, 0.20).groupBy("image_id").agg(F.count("*").alias("above"))
    return px.support(rows, 0.20).groupBy("image_id").agg(F.count("*").alias("support")).join(a, "image_id", "left").select("image_id", "support", F.coalesce("above", F.lit(0)).cast("long").alias("above"))


def ccl_sizes(spark, sf_dir):
    return px.sizes(_lines(spark, sf_dir))


def ccl_topk_overflow(spark, sf_dir):
    return px.largest(px.sizes(_lines(spark, sf_dir)), 4).select("image_id", "root", "size", "slot", "raw_count", "overflow")


def component_moments(spark, sf_dir):
    return px.axes(_lines(spark, sf_dir)).select("image_id", "root", F.round("angle", 9).alias("angle"))


def min_area_rect(spark, sf_dir):
    return px.rectangles(_large(spark, sf_dir)).select("image_id", "root", F.round("area", 6).alias("area"), (F.round("angle", 6) + 0.0).alias("angle"))


def box_score(spark, sf_dir):
    return px.scores(px.rectangles(_large(spark, sf_dir)), pixels(spark, sf_dir)).select("image_id", "root", F.round("score", 6).alias("score"))


def unclip_filter(spark, sf_dir):
    found = px.scores(px.rectangles(_large(spark, sf_dir)), pixels(spark, sf_dir))
    out = px.unclipped(found.withColumn("score", F.round("score", 6)), 1000, 1000, 1.0, 0.06, 1.5)
    return out.select("image_id", "root", "score", *_flat(F.col("quad")))


def _decoded(spark, sf_dir):
    return px.decoded(pixels(spark, sf_dir), SIDE, SIDE, LOW, 8, min_size=1.0, threshold=0.05, ratio=1.5)


def box_decode(spark, sf_dir):
    return _decoded(spark, sf_dir).select("image_id", "slot", F.round("score", 6).alias("score"), "overflow", *_flat(F.col("quad")))


def primary_mask(spark, sf_dir):
    """The boxes of a stricter decode, from a looser one, with an area in a source twice as large of 16 or more."""
    out = px.primary_of(_decoded(spark, sf_dir).withColumn("score", F.round("score", 6)), SIDE, SIDE, 0.1, 2.0)
    out = b.large_enough(out.withColumn("quad", g.rescaled(F.col("quad"), F.lit(2.0), F.lit(2.0))))
    return out.select("image_id", "slot", "score", F.round(g.area(F.col("quad")), 6).alias("area"))


def valid_counts(spark, sf_dir):
    return b.valid_counts(pixels(spark, sf_dir), _decoded(spark, sf_dir))


def _parts(spark, sf_dir):
    every = boxes(spark, sf_dir)
    return every.where("not supplemental"), every.where("supplemental")


def supplement_dedup(spark, sf_dir):
    """Supplements, every third of which is put on the image's first base box."""
    base, extra = _parts(spark, sf_dir)
    first = base.where("slot = 0").select("image_id", F.col("quad").alias("q"))
    moved = extra.join(first, "image_id", "left").withColumn("quad", F.when((F.col("slot") % 3 == 2) & F.col("q").isNotNull(), F.col("q")).otherwise(F.col("quad"))).drop("q")
    return b.deduplicated(base, moved).select("image_id", "slot")


def nearest_base(spark, sf_dir):
    return b.nearest(*_parts(spark, sf_dir)).select("image_id", "slot", F.round("distance", 6).alias("distance"))


def merged_boxes(spark, sf_dir):
    return b.merged(*_parts(spark, sf_dir), most=5).select("image_id", F.col("slot").cast("long").alias("slot"), "score", "supplemental")


def median_area_ratio(spark, sf_dir):
    return b.with_area_ratio(boxes(spark, sf_dir)).select("image_id", "slot", F.round("area", 6).alias("area"), F.round("area_ratio", 6).alias("area_ratio"))


def optional_flags(spark, sf_dir):
    """Flags of the boxes of an image of 200 x 200, and of fallbacks where a quarter of the images lost theirs."""
    every = boxes(spark, sf_dir)
    images = every.select("image_id").distinct().select("image_id", F.lit(200.0).alias("w"), F.lit(200.0).alias("h"))
    out = b.with_flags(b.with_area_ratio(b.with_fallback(images, every.where("image_id % 4 <> 1"))), 200, 200)
    return out.select("image_id", "slot", "fallback", "border_contact", F.round("aspect", 6).alias("aspect"), F.round("area_ratio", 6).alias("area_ratio"), "optional")


def fallback_rows(spark, sf_dir):
    every = boxes(spark, sf_dir)
    images = every.select("image_id").distinct().select("image_id", F.lit(640.0).alias("w"), F.lit(480.0).alias("h"))
    few = every.where("image_id % 4 <> 1")
    return b.with_fallback(images, few).select("image_id", "slot", "score", "fallback", F.col("quad")[2]["x"].alias("x"))


def orientation_vote(spark, sf_dir):
    return b.orientation(boxes(spark, sf_dir)).select("image_id", "vertical", (F.round("skew", 6) + 0.0).alias("skew"))


def _ordered(spark, sf_dir, robust=True):
    every = boxes(spark, sf_dir)
    placed = b.projected(every, b.orientation(every, robust))
    return b.reading_order(b.tracks(placed, robust))


def reading_order(spark, sf_dir):
    return _ordered(spark, sf_dir).select("image_id", "slot", F.col("track").cast("long").alias("track"), F.col("place").cast("long").alias("place"))


def reading_order_lines(spark, sf_dir):
    return _ordered(spark, sf_dir, False).select("image_id", "slot", F.col("track").cast("long").alias("track"), F.col("place").cast("long").alias("place"))


def predecessor_order(spark, sf_dir):
    every = boxes(spark, sf_dir)
    out = b.ordered_by_predecessors(b.projected(every, b.orientation(every)))
    return out.select("image_id", "slot", F.col("before").cast("long").alias("before"), F.col("place").cast("long").alias("place"))


def narrow_peer_repair(spark, sf_dir):
    out = b.repaired(boxes(spark, sf_dir), 1.5, 1.2)
    return out.select("image_id", "slot", "repaired", *_flat(F.col("quad")))


def adaptive_expand(spark, sf_dir):
    """The bounds of an image's bright pixels, turned by a multiple of 0.15."""
    small = pixels(spark, sf_dir)
    cores = small.where("v > 0.12").groupBy("image_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    cores = cores.select("image_id", *((F.col(f"{k}1") + F.col(f"{k}0") + 1.0).alias(k) for k in ("x", "y")), (F.col("x1") - F.col("x0") + 1.0).alias("w"), (F.col("y1") - F.col("y0") + 1.0).alias("h"), (0.15 * (F.col("image_id") % 3)).alias("turn"))
    cos, sin = F.cos("turn"), F.sin("turn")
    corner = lambda x, y: ((F.col("x") + (x * F.col("w") * cos - y * F.col("h") * sin)) / 2, (F.col("y") + (x * F.col("w") * sin + y * F.col("h") * cos)) / 2)
    cores = cores.select("image_id", F.lit(0).alias("slot"), g.quad(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("quad"))
    out = b.expanded(cores, small, SIDE, SIDE, 0.03)
    return out.select("image_id", "slot", F.array_join(F.transform("sides", lambda m: m.cast("int").cast("string")), "").alias("sides"), *_flat(F.col("quad")))


def crop_sizes(spark, sf_dir):
    out = b.crops(boxes(spark, sf_dir))
    return out.select("image_id", "slot", "w", "h", "turned", "width", b.bucketed(F.col("width")).alias("bucket"))


def bucket_width(spark, sf_dir):
    return b.required_width(b.crops(boxes(spark, sf_dir)))


def quad_geometry(spark, sf_dir):
    """Corner order, letterbox and the map back to the source, and projective coefficients."""
    q = F.col("quad")
    box = g.letterbox(F.lit(301.0) + F.col("slot"), F.lit(97.0), 224)
    back = g.mapped(q, box["scale"], box["left"], box["top"], F.lit(301.0), F.lit(97.0))
    skewed = F.array(q[0], q[1], F.struct((q[2]["x"] + 9).alias("x"), (q[2]["y"] + F.col("slot")).alias("y")), q[3])
    coefficients = g.projective(skewed, F.lit(48.0), F.lit(32.0))
    named = lambda quad, name: [F.round(quad[i][k], 9).alias(f"{name}_{k}{i}") for i in range(4) for k in ("x", "y")]
    return boxes(spark, sf_dir).select("image_id", "slot", box["top"].alias("top"), box["height"].alias("height"), *named(g.ordered(F.array(q[2], q[0], q[3], q[1])), "ordered"), *named(back, "mapped"), *named(g.rescaled(q, F.lit(0.5), F.lit(2.0)), "rescaled"), *((F.round(coefficients[i], 8) + 0.0).alias(f"p{i}") for i in range(8)))


QUERIES = {f.__name__: f for f in (pixel_thresholds, primary_mask, valid_counts, ccl_sizes, ccl_topk_overflow, component_moments, min_area_rect, box_score, unclip_filter, box_decode, supplement_dedup, nearest_base, merged_boxes, median_area_ratio, optional_flags, fallback_rows, orientation_vote, reading_order, reading_order_lines, predecessor_order, narrow_peer_repair, adaptive_expand, crop_sizes, bucket_width, quad_geometry)}

_LENGTH = lambda p, q: f"sqrt(({q}x - {p}x) * ({q}x - {p}x) + ({q}y - {p}y) * ({q}y - {p}y))"
_SIZES = f"""({_LENGTH('a', 'j')} + {_LENGTH('d', 'c')}) / 2 AS w, ({_LENGTH('a', 'd')} + {_LENGTH('j', 'c')}) / 2 AS h,
  abs((ax * jy - jx * ay) + (jx * cy - cx * jy) + (cx * dy - dx * cy) + (dx * ay - ax * dy)) / 2 AS area"""
_RATIO = "area / greatest(coalesce(median(area) FILTER (NOT supplemental) OVER (PARTITION BY image_id), 1), 1e-6) AS area_ratio"
_SIZED = f"""{BOXES},
sized AS (SELECT *, {_SIZES} FROM boxes),
ratio AS (SELECT *, {_RATIO} FROM sized)"""
_AXES = """sqrt((jx - ax + cx - dx) ** 2 + (jy - ay + cy - dy) ** 2) AS hn, sqrt((dx - ax + cx - jx) ** 2 + (dy - ay + cy - jy) ** 2) AS vn"""
_VOTE = f"""{BOXES},
edges AS (SELECT *, {_LENGTH('a', 'j')} AS w, {_LENGTH('a', 'd')} AS h, {_AXES} FROM boxes),
sided AS (
  SELECT *, greatest(w * h, 1) AS size, CASE WHEN jx - ax + cx - dx < 0 THEN -1 ELSE 1 END AS hs, CASE WHEN dy - ay + cy - jy < 0 THEN -1 ELSE 1 END AS vs FROM edges),
told AS (
  SELECT s.*, greatest(w, h) / least(w, h) >= 1.25 AND size >= 0.15::DOUBLE * m.middle AS sure FROM sided s
  JOIN (SELECT image_id, quantile_disc(size, 0.5) AS middle FROM sided GROUP BY image_id) m USING (image_id)),
summed AS (
  SELECT image_id, sum(size * ln((h + 1) / (w + 1))) >= 0 AS vertical, sum(size * hs * (jx - ax + cx - dx) / hn) AS along_x, sum(size * hs * (jy - ay + cy - dy) / hn) AS along_y,
    sum(size * vs * (dx - ax + cx - jx) / vn) AS down_x, sum(size * vs * (dy - ay + cy - jy) / vn) AS down_y
  FROM (SELECT *, bool_or(sure) OVER (PARTITION BY image_id) AS any_ FROM told) WHERE sure OR NOT any_ GROUP BY image_id),
votes AS (SELECT image_id, vertical, CASE WHEN vertical THEN atan2(down_x, down_y) ELSE atan2(along_y, along_x) END AS skew FROM summed)"""
_LINE = """CASE WHEN vertical THEN {0}x * sin(skew) + {0}y * cos(skew) ELSE {0}x * cos(skew) + {0}y * sin(skew) END"""
_CROSS = """CASE WHEN vertical THEN {0}x * cos(skew) - {0}y * sin(skew) ELSE {0}y * cos(skew) - {0}x * sin(skew) END"""
_CROPS = f"""{BOXES}, c AS (
  SELECT image_id, slot, greatest(round_even(greatest({_LENGTH('a', 'j')}, {_LENGTH('d', 'c')}), 0), 2) AS w, greatest(round_even(greatest({_LENGTH('a', 'd')}, {_LENGTH('j', 'c')}), 0), 2) AS h FROM boxes),
k AS (SELECT *, h / w >= 1.05 AS turned, least(ceil(greatest(w, h) * 48 / least(w, h)), 640)::INT AS width FROM c)"""
_CENTRED = "*, (ax + jx + cx + dx) / 4 AS mx, (ay + jy + cy + dy) / 4 AS my"


def _expand_sql() -> str:
    turned = lambda name, x, y: f"(x + ({x} * w * cos(turn) - {y} * h * sin(turn))) / 2 AS {name}x, (y + ({x} * w * sin(turn) + {y} * h * cos(turn))) / 2 AS {name}y"
    place = lambda p, k: f"(({p}x - mx) * {k}x + ({p}y - my) * {k}y)"
    ends = ", ".join(f"{f}({', '.join(place(p, k) for p in 'ajcd')}) AS {k}{i}" for k in "uv" for i, f in ((0, "least"), (1, "greatest")))
    corridor = lambda k: f"p{k} BETWEEN {k}0 + 0.05::DOUBLE * ({k}1 - {k}0) AND {k}1 - 0.05::DOUBLE * ({k}1 - {k}0)"
    sides = {"l": ("u0 - pu", "v", "cap_u"), "r": ("pu - u1", "v", "cap_u"), "t": ("v0 - pv", "u", "cap_v"), "b": ("pv - v1", "u", "cap_v")}
    stats = ", ".join(f"{f}({far}) FILTER ({far} > 0 AND {far} <= {cap} AND {corridor(o)}) AS {s}_{n}" for s, (far, o, cap) in sides.items() for f, n in (("count", "n"), ("min", "near"), ("max", "far")))
    moved = lambda s: f"coalesce({s}_n >= 2 AND {s}_n <= 0.25::DOUBLE * short * short AND {s}_near <= 2.5 AND {s}_far >= 0.5, FALSE)"
    moves = ", ".join(f"{moved(s)} AS {s}_moved, CASE WHEN {moved(s)} THEN least({s}_far + 0.75, {cap}) ELSE 0 END AS {s}_move" for s, (_, _, cap) in sides.items())
    new = {"u0": "(u0 - l_move)", "u1": "(u1 + r_move)", "v0": "(v0 - t_move)", "v1": "(v1 + b_move)"}
    out = []
    for i, (u, v, p) in enumerate((("u0", "v0", "a"), ("u1", "v0", "j"), ("u1", "v1", "c"), ("u0", "v1", "d"))):
        for k in "xy":
            out.append(f"round(CASE WHEN any_ THEN greatest(0, least(m{k} + {new[u]} * u{k} + {new[v]} * v{k}, {SIDE})) ELSE {p}{k} END, 6) + 0.0 AS {k}{i}")
    return f"""WITH {PIXELS}, core AS (
  SELECT image_id, min(x) + max(x) + 1.0::DOUBLE AS x, min(y) + max(y) + 1.0::DOUBLE AS y, max(x) - min(x) + 1.0::DOUBLE AS w, max(y) - min(y) + 1.0::DOUBLE AS h, 0.15::DOUBLE * (image_id % 3) AS turn
  FROM px WHERE v > 0.12 GROUP BY image_id),
q AS (SELECT image_id, {turned('a', -1, -1)}, {turned('j', 1, -1)}, {turned('c', 1, 1)}, {turned('d', -1, 1)} FROM core),
m AS (SELECT {_CENTRED}, {_AXES} FROM q),
f AS (SELECT *, (jx - ax + cx - dx) / hn AS ux, (jy - ay + cy - dy) / hn AS uy, (dx - ax + cx - jx) / vn AS vx, (dy - ay + cy - jy) / vn AS vy FROM m),
e AS (SELECT *, {ends} FROM f),
k AS (SELECT *, least(u1 - u0, v1 - v0) AS short, v1 - v0 > 1.05::DOUBLE * (u1 - u0) AS upright FROM e),
c AS (
  SELECT *, least(greatest(CASE WHEN upright THEN 0.35::DOUBLE ELSE 0.85::DOUBLE END * short, 2), 18) AS cap_u, least(greatest(CASE WHEN upright THEN 0.85::DOUBLE ELSE 0.35::DOUBLE END * short, 2), 18) AS cap_v FROM k),
near AS (SELECT c.*, (p.x - mx) * ux + (p.y - my) * uy AS pu, (p.x - mx) * vx + (p.y - my) * vy AS pv FROM c JOIN px p ON p.image_id = c.image_id AND p.v >= 0.03),
stats AS (SELECT image_id, {stats} FROM near GROUP BY image_id),
moves AS (SELECT c.*, {moves} FROM c LEFT JOIN stats USING (image_id)),
done AS (SELECT *, l_moved OR r_moved OR t_moved OR b_moved AS any_ FROM moves)
SELECT image_id, 0 AS slot, concat(l_moved::INT, r_moved::INT, t_moved::INT, b_moved::INT) AS sides, {', '.join(out)} FROM done"""


def _repair_sql() -> str:
    corner = lambda i, k: f"o[{i}].{k}"
    length = lambda i, j: f"sqrt((o[{j}].x - o[{i}].x) ** 2 + (o[{j}].y - o[{i}].y) ** 2)"
    axis = lambda k: f"CASE WHEN w <= h THEN (o[2].{k} - o[1].{k} + o[3].{k} - o[4].{k}) ELSE (o[4].{k} - o[1].{k} + o[3].{k} - o[2].{k}) END"
    moved = lambda p, k: f"{p}{k} + CASE WHEN repaired THEN (middle / least(w, h) - 1) * (({p}x - mx) * ex + ({p}y - my) * ey) * e{k} ELSE 0 END"
    out = ", ".join(f"round({moved(p, k)}, 6) + 0.0 AS {k}{i}" for i, p in enumerate("ajcd") for k in "xy")
    return f"""WITH {BOXES}, q AS (SELECT {_CENTRED}, {ordered_sql(CORNERS)} AS o FROM boxes),
s AS (SELECT *, ({length(1, 2)} + {length(4, 3)}) / 2 AS w, ({length(1, 4)} + {length(2, 3)}) / 2 AS h FROM q),
t AS (SELECT *, h > 1.05::DOUBLE * w AS vertical, CASE WHEN h > 1.05::DOUBLE * w THEN w ELSE h END AS cross_, {axis('x')} AS rx, {axis('y')} AS ry FROM s),
m AS (SELECT a.image_id, a.slot, median(p.cross_) AS middle FROM t a JOIN t p ON a.image_id = p.image_id AND a.vertical = p.vertical AND a.slot <> p.slot GROUP BY ALL),
f AS (
  SELECT t.*, middle, coalesce(greatest(w, h) / greatest(least(w, h), 1e-6) >= 1.5 AND middle >= 1.2::DOUBLE * cross_, FALSE) AS repaired, rx / sqrt(rx * rx + ry * ry) AS ex, ry / sqrt(rx * rx + ry * ry) AS ey
  FROM t LEFT JOIN m ON t.image_id = m.image_id AND t.slot = m.slot)
SELECT image_id, slot, repaired, {out} FROM f"""


def _geometry_sql() -> str:
    named = lambda name, value: ", ".join(f"round({value(p, k)}, 9) AS {name}_{k}{i}" for i, p in enumerate("ajcd") for k in "xy")
    back = {"x": "(({0}x - floor((224 - greatest(round_even((301 + slot) * scale, 0), 1)) / 2)) / scale)", "y": "(({0}y - floor((224 - height) / 2)) / scale)"}
    mapped = lambda p, k: f"greatest(0, least({back[k].format(p)}, {300 if k == 'x' else 96}))"
    ordered = ", ".join(f"round(o[{i + 1}].{k}, 9) AS ordered_{k}{i}" for i in range(4) for k in "xy")
    rows = ["(jx - ax + u * jx) / 48", "(dx - ax + v * dx) / 32", "ax", "(jy - ay + u * jy) / 48", "(dy - ay + v * dy) / 32", "ay", "u / 48", "v / 32"]
    return f"""WITH {BOXES}, l AS (
  SELECT *, 224::DOUBLE / (301 + slot) AS scale, greatest(round_even(97 * 224::DOUBLE / (301 + slot), 0), 1) AS height, {ordered_sql("[{'x': cx, 'y': cy}, {'x': ax, 'y': ay}, {'x': dx, 'y': dy}, {'x': jx, 'y': jy}]")} AS o, cx + 9 AS ex, cy + slot AS ey FROM boxes),
d AS (SELECT *, jx - ex AS x1, dx - ex AS x2, ax - jx + ex - dx AS x3, jy - ey AS y1, dy - ey AS y2, ay - jy + ey - dy AS y3 FROM l),
n AS (SELECT *, x1 * y2 - x2 * y1 AS below FROM d),
z AS (SELECT *, (x3 * y2 - x2 * y3) / below AS u, (x1 * y3 - x3 * y1) / below AS v FROM n)
SELECT image_id, slot, floor((224 - height) / 2) AS top, height, {ordered}, {named('mapped', mapped)}, {named('rescaled', lambda p, k: f"{p}{k} * {0.5 if k == 'x' else 2}")},
  {', '.join(f'CASE WHEN abs(below) > 1e-8 THEN round({r}, 8) + 0.0 END AS p{i}' for i, r in enumerate(rows))} FROM z"""


_DECODED = f"""{FITTED.replace('CHOSEN', 'slot < 8')},{SCORING}, {_unclipped_sql(SIDE, 0.05)},
decoded AS (SELECT o.*, r.slot::INT AS slot, r.raw_count > 8 AS overflow FROM o JOIN ranked r USING (image_id, root))"""
_CORNERED = ", ".join(f"q[{i + 1}].{k} AS {p}{k}" for i, p in enumerate("ajcd") for k in "xy")
_TOUCH = " OR ".join(f"{p}{k} <= 1.5 OR {p}{k} >= 197.5" for p in "ajcd" for k in "xy")
_EDGE = " OR ".join(f"{p}{k} <= 1e-4 OR {p}{k} >= {SIDE} - 1e-4" for p in "ajcd" for k in "xy")
_MOVED = ", ".join(f"CASE WHEN s.slot % 3 = 2 AND f.image_id IS NOT NULL THEN f.{p}{k} ELSE s.{p}{k} END AS {p}{k}" for p in "ajcd" for k in "xy")
_APART = ", ".join(f"abs(b.{p}{k} - e.{p}{k})" for p in "ajcd" for k in "xy")

ORACLE_SQL = {
    "pixel_thresholds": f"""WITH {PIXELS}, r AS (SELECT image_id, round(v, 2) AS v FROM px)
SELECT image_id, count(*) FILTER (v >= 0.20::DOUBLE)::BIGINT AS support, count(*) FILTER (v > 0.20::DOUBLE)::BIGINT AS above FROM r GROUP BY image_id HAVING count(*) FILTER (v >= 0.20::DOUBLE) > 0""",
    "ccl_sizes": f"WITH RECURSIVE {SMALL} SELECT image_id, root, size::BIGINT AS size FROM sizes",
    "ccl_topk_overflow": f"""WITH RECURSIVE {SMALL}
SELECT image_id, root, size::BIGINT AS size, slot::INT AS slot, raw_count::BIGINT AS raw_count, raw_count > 4 AS overflow FROM ranked WHERE slot < 4""",
    "component_moments": f"WITH RECURSIVE {SMALL} SELECT image_id, root, round(angle, 9) AS angle FROM axes",
    "min_area_rect": f"WITH RECURSIVE {RECTS} SELECT image_id, root, round(area, 6) AS area, round(angle, 6) + 0.0 AS angle FROM rect",
    "box_score": f"WITH RECURSIVE {SCORED} SELECT image_id, root, round(score, 6) AS score FROM scored",
    "unclip_filter": f"WITH RECURSIVE {SCORED}, {_unclipped_sql(1000, 0.06)} SELECT image_id, root, score, {_flat_sql('q')} FROM o",
    "box_decode": f"WITH RECURSIVE {_DECODED} SELECT image_id, slot, score, overflow, {_flat_sql('q')} FROM decoded",
    "primary_mask": f"""WITH RECURSIVE {_DECODED}, boxes AS (SELECT image_id, slot, score, {_CORNERED} FROM decoded), sized AS (SELECT *, {_SIZES} FROM boxes)
SELECT image_id, slot, score, round(area * 4, 6) AS area FROM sized WHERE score >= 0.1::DOUBLE AND (least(w, h) >= 4 OR {_EDGE}) AND area * 4 >= 16""",
    "valid_counts": f"""WITH RECURSIVE {_DECODED}, n AS (SELECT image_id, count(*) AS n FROM decoded GROUP BY image_id)
SELECT vec_id AS image_id, coalesce(n, 0)::BIGINT AS boxes FROM embeddings LEFT JOIN n ON n.image_id = vec_id""",
    "supplement_dedup": f"""WITH {BOXES}, base AS (SELECT * FROM boxes WHERE NOT supplemental), f AS (SELECT * FROM base WHERE slot = 0),
e AS (SELECT s.image_id, s.slot, {_MOVED} FROM boxes s LEFT JOIN f USING (image_id) WHERE s.supplemental)
SELECT image_id, slot FROM e WHERE image_id IN (SELECT image_id FROM base) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.image_id = e.image_id AND greatest({_APART}) <= 1e-3)""",
    "nearest_base": f"""WITH {BOXES}, c AS (SELECT {_CENTRED} FROM boxes)
SELECT s.image_id, s.slot, round(coalesce(min(sqrt((b.mx - s.mx) * (b.mx - s.mx) + (b.my - s.my) * (b.my - s.my))), 'infinity'::DOUBLE), 6) AS distance
FROM c s LEFT JOIN c b ON b.image_id = s.image_id AND NOT b.supplemental WHERE s.supplemental GROUP BY s.image_id, s.slot""",
    "merged_boxes": f"""WITH {BOXES}, r AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score + CASE WHEN supplemental THEN 0 ELSE 2 END DESC, slot) - 1 AS place FROM boxes)
SELECT image_id, place::BIGINT AS slot, score, supplemental FROM r WHERE place < 5""",
    "median_area_ratio": f"WITH {_SIZED} SELECT image_id, slot, round(area, 6) AS area, round(area_ratio, 6) AS area_ratio FROM ratio",
    "optional_flags": f"""WITH {BOXES}, few AS (SELECT *, FALSE AS fallback FROM boxes WHERE image_id % 4 <> 1),
whole AS (
  SELECT image_id, 0 AS slot, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, 199.0::DOUBLE AS jx, 0.0::DOUBLE AS jy, 199.0::DOUBLE AS cx, 199.0::DOUBLE AS cy, 0.0::DOUBLE AS dx, 199.0::DOUBLE AS dy, 0.0::DOUBLE AS score,
    FALSE AS supplemental, TRUE AS fallback FROM (SELECT DISTINCT image_id FROM boxes WHERE image_id NOT IN (SELECT image_id FROM few))),
sized AS (SELECT *, {_SIZES} FROM (SELECT * FROM few UNION ALL SELECT * FROM whole)),
ratio AS (SELECT *, {_RATIO}, greatest(w, h) / greatest(least(w, h), 1e-6) AS aspect, {_TOUCH} AS border_contact FROM sized)
SELECT image_id, slot, fallback, border_contact, round(aspect, 6) AS aspect, round(area_ratio, 6) AS area_ratio,
  NOT supplemental AND NOT fallback AND (area_ratio <= 0.13 OR (border_contact AND area_ratio <= 0.50) OR aspect >= 12 OR score <= 0.55) AS optional FROM ratio""",
    "fallback_rows": f"""WITH {BOXES}, few AS (SELECT * FROM boxes WHERE image_id % 4 <> 1)
SELECT image_id, slot, score, FALSE AS fallback, cx AS x FROM few
UNION ALL SELECT DISTINCT image_id, 0, 0::DOUBLE, TRUE, 639::DOUBLE FROM boxes WHERE image_id NOT IN (SELECT image_id FROM few)""",
    "orientation_vote": f"WITH {_VOTE} SELECT image_id, vertical, round(skew, 6) + 0.0 AS skew FROM votes",
    "predecessor_order": f"""WITH {_VOTE}, m AS (SELECT {_CENTRED} FROM boxes JOIN votes USING (image_id)), j AS (
  SELECT image_id, slot, vertical, {_LINE.format('m')} AS r, least({', '.join(_CROSS.format(p) for p in 'ajcd')}) AS lo, greatest({', '.join(_CROSS.format(p) for p in 'ajcd')}) AS hi, {_CROSS.format('m')} AS c FROM m),
n AS (
  SELECT a.image_id, a.slot, count(*) FILTER (a.slot <> b.slot AND ((CASE WHEN a.vertical THEN b.c > a.hi ELSE b.c < a.lo END) OR (b.c BETWEEN a.lo AND a.hi AND b.r < a.r))) AS before
  FROM j a JOIN j b ON a.image_id = b.image_id GROUP BY ALL)
SELECT image_id, slot, before::BIGINT AS before, (row_number() OVER (PARTITION BY image_id ORDER BY before, slot) - 1)::BIGINT AS place FROM n""",
    "narrow_peer_repair": _repair_sql(),
    "adaptive_expand": _expand_sql(),
    "crop_sizes": f"WITH {_CROPS} SELECT image_id, slot, w, h, turned, width, CASE WHEN width <= 320 THEN 320 WHEN width <= 480 THEN 480 ELSE 640 END AS bucket FROM k",
    "bucket_width": f"""WITH {_CROPS}, r AS (SELECT coalesce(max(width), 0) AS required FROM k)
SELECT required, (SELECT c FROM (VALUES (320), (480), (640)) AS z(c) ORDER BY abs(c - required), c LIMIT 1) AS nearest FROM r""",
    "quad_geometry": _geometry_sql(),
}
