"""Boxes of images: supplements, flags, fallbacks, reading order, repair and crops.

Boxes are rows (image_id, slot, quad, score, supplemental); quad is an array of four corners from the left top on,
clockwise.  Pairs are formed within an image alone, whose boxes are limited by the top-k of decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphflow.functions import geometry as g
from glyphflow.operators import pixels as pixel_rows


def deduplicated(base: DataFrame, supplement: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Supplements of images with base boxes, but those whose corners all lie within tolerance of a base box's."""
    other = base.select(F.col("image_id").alias("__image"), F.col("quad").alias("__quad"))
    same = (F.col("image_id") == F.col("__image")) & (g.corner_difference(F.col("quad"), F.col("__quad")) <= tolerance)
    return supplement.join(base.select("image_id").distinct(), "image_id", "left_semi").join(other, same, "left_anti")


def nearest(base: DataFrame, supplement: DataFrame) -> DataFrame:
    """supplement with distance: of its centre to that of the nearest base box of its image, infinity without any."""
    centre = lambda q: g.centre(q)
    other = base.select("image_id", centre(F.col("quad")).alias("c"))
    pairs = supplement.select("image_id", "slot", centre(F.col("quad")).alias("o")).join(other, "image_id")
    least = pairs.groupBy("image_id", "slot").agg(F.min(F.hypot(F.col("c.x") - F.col("o.x"), F.col("c.y") - F.col("o.y"))).alias("distance"))
    return supplement.join(least, ["image_id", "slot"], "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))


def merged(base: DataFrame, supplement: DataFrame, most: int = 64) -> DataFrame:
    """The best boxes of each image: base ones before supplements, by score, then slot; slot is their new place."""
    both = base.withColumn("supplemental", F.lit(False)).unionByName(supplement.withColumn("supplemental", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("image_id").orderBy(F.desc(F.col("score") + F.when(F.col("supplemental"), 0.0).otherwise(2.0)), "slot")
    return both.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < most)


def with_area_ratio(boxes: DataFrame) -> DataFrame:
    """boxes with area and area_ratio, to the median area of the image's boxes that aren't supplemental (1 without any, at least 1e-6)."""
    sized = boxes.withColumn("area", g.area(F.col("quad")))
    middle = sized.groupBy("image_id").agg(F.greatest(F.coalesce(F.median(F.when(~F.col("supplemental"), F.col("area"))), F.lit(1.0)), F.lit(1e-6)).alias("__middle"))
    return sized.join(middle, "image_id").withColumn("area_ratio", F.col("area") / F.col("__middle")).drop("__middle")


def with_flags(boxes: DataFrame, width: float | Column, height: float | Column, small: float = 0.13, border: float = 0.50, aspect: float = 12.0, score: float = 0.55, contact: float = 1.5) -> DataFrame:
    """boxes of with_area_ratio() with border_contact, aspect and optional; a fallback (of with_fallback()) never is optional."""
    out = boxes.withColumn("aspect", g.aspect(F.col("quad"))).withColumn("border_contact", g.touches(F.col("quad"), width, height, contact))
    doubtful = (F.col("area_ratio") <= small) | (F.col("border_contact") & (F.col("area_ratio") <= border)) | (F.col("aspect") >= aspect) | (F.col("score") <= score)
    spared = F.coalesce("fallback", F.lit(False)) if "fallback" in boxes.columns else F.lit(False)
    return out.withColumn("optional", ~F.col("supplemental") & ~spared & doubtful)


def large_enough(boxes: DataFrame, least: float = 16.0) -> DataFrame:
    """Boxes whose area, in the source, is at least that."""
    return boxes.where(g.area(F.col("quad")) >= least)


def valid_counts(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """image_id, boxes: how many boxes each image has, 0 without any."""
    count = boxes.groupBy("image_id").agg(F.count("*").alias("boxes"))
    return images.select("image_id").distinct().join(count, "image_id", "left").select("image_id", F.coalesce("boxes", F.lit(0)).cast("long").alias("boxes"))


def with_fallback(images: DataFrame, boxes: DataFrame, mapped: bool = True) -> DataFrame:
    """boxes and, for images (image_id, w, h) without any, a box of the whole image with score 0; fallback marks those."""
    less = 1.0 if mapped else 0.0
    x, y, zero = F.col("w") - less, F.col("h") - less, F.lit(0.0)
    whole = images.join(boxes, "image_id", "left_anti").select("image_id", F.lit(0).alias("slot"), g.quad((zero, zero), (x, zero), (x, y), (zero, y)).alias("quad"), zero.alias("score"), F.lit(False).alias("supplemental"), F.lit(True).alias("fallback"))
    return boxes.select("image_id", "slot", "quad", "score", "supplemental", F.lit(False).alias("fallback")).unionByName(whole)


def orientation(boxes: DataFrame, robust: bool = True, aspect: float = 1.25, area: float = 0.15) -> DataFrame:
    """image_id, vertical and skew: a vote of the boxes, weighted by the product of their upper and left edges (at least 1).

    A robust vote is of the boxes long enough, and large enough against the lower median, or of all where none is.
    """
    q = F.col("quad")
    w, h = F.greatest(g.side(q, 0, 1), F.lit(1e-6)), F.greatest(g.side(q, 0, 3), F.lit(1e-6))
    used = boxes.select("image_id", w.alias("w"), h.alias("h"), F.greatest(w * h, F.lit(1.0)).alias("area"), g.down(q).alias("down"), g.along(q).alias("along"))
    if robust:
        middle = used.groupBy("image_id").agg(F.expr("percentile_disc(0.5) within group (order by area)").alias("middle"))
        sure = (F.greatest("w", "h") / F.least("w", "h") >= aspect) & (F.col("area") >= area * F.col("middle"))
        used = used.join(middle, "image_id").withColumn("sure", sure).withColumn("any", F.max("sure").over(Window.partitionBy("image_id"))).where(F.col("sure") | ~F.col("any"))
    votes = used.groupBy("image_id").agg(F.sum(F.col("area") * F.log((F.col("h") + 1) / (F.col("w") + 1))).alias("vote"), *(F.sum(F.col("area") * F.col(f"{a}.{c}")).alias(f"{a}_{c}") for a in ("down", "along") for c in ("x", "y")))
    vertical = F.col("vote") >= 0
    skew = F.when(vertical, F.atan2("down_x", "down_y")).otherwise(F.atan2("along_y", "along_x"))
    return votes.select("image_id", vertical.alias("vertical"), skew.alias("skew"))


def projected(boxes: DataFrame, turned: DataFrame) -> DataFrame:
    """Boxes with the least and greatest place of their corners, and the place of their centre, along the line of reading (r) and across it (c)."""
    sin, cos = F.sin("skew"), F.cos("skew")
    along = lambda p: F.when(F.col("vertical"), p["x"] * sin + p["y"] * cos).otherwise(p["x"] * cos + p["y"] * sin)
    across = lambda p: F.when(F.col("vertical"), p["x"] * cos - p["y"] * sin).otherwise(p["y"] * cos - p["x"] * sin)
    out = boxes.join(turned, "image_id")
    for name, f in (("r", along), ("c", across)):
        places = F.transform("quad", f)
        out = out.withColumn(f"{name}_low", F.array_min(places)).withColumn(f"{name}_high", F.array_max(places))
        out = out.withColumn(f"{name}_mid", f(g.centre(F.col("quad"))))
    return out


def compatible(a: dict, b: dict, overlap: float = 0.25, centre: float = 0.65, read: float = 0.35, gap: float | None = None) -> bool:
    """Whether two boxes may share a line: they overlap across it, or lie near, and hardly overlap along it."""
    shared = lambda k: max(0.0, min(a[f"{k}_high"], b[f"{k}_high"]) - max(a[f"{k}_low"], b[f"{k}_low"]))
    least = lambda k: max(1e-6, min(a[f"{k}_high"] - a[f"{k}_low"], b[f"{k}_high"] - b[f"{k}_low"]))
    near = shared("c") >= overlap * least("c") or abs(a["c_mid"] - b["c_mid"]) <= centre * least("c")
    apart = max(a["r_low"], b["r_low"]) - min(a["r_high"], b["r_high"])
    return near and shared("r") <= read * least("r") and (gap is None or apart <= gap * least("r"))


def tracks(placed: DataFrame, robust: bool = True) -> DataFrame:
    """placed with root: the slot of the first box of its line.

    Robust lines are built greedily in slot order: a box joins the nearest line (by centre, then slot) all of whose boxes
    are compatible with it.  Otherwise lines are the components of compatible pairs.  Order decides, so an image is one
    group; it has at most the boxes that decoding lets through.
    """
    columns = ["r_low", "r_high", "r_mid", "c_low", "c_high", "c_mid"]

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("slot").to_dict("records")
        lines: dict[int, list[dict]] = {}
        for row in rows:
            if robust:
                fits = [(abs(members[0]["c_mid"] - row["c_mid"]), root) for root, members in lines.items() if all(compatible(row, m) for m in members)]
                root = min(fits)[1] if fits else row["slot"]
                lines.setdefault(root, []).append(row)
            else:
                hits = [root for root, members in lines.items() if any(compatible(row, m, 0.35, 0.50, 0.20, 0.75) for m in members)]
                root = min([*hits, row["slot"]])
                lines[root] = [m for h in hits for m in lines.pop(h)] + [row]
        return pd.DataFrame([(pdf["image_id"].iloc[0], m["slot"], root) for root, members in lines.items() for m in members], columns=["image_id", "slot", "root"])

    found = placed.select("image_id", "slot", *columns).groupBy("image_id").applyInPandas(of, "image_id long, slot int, root int")
    return placed.join(found, ["image_id", "slot"])


def reading_order(lined: DataFrame) -> DataFrame:
    """lined (of tracks()) with track (rank of the line, from the right if vertical) and place in the order of reading."""
    mean = F.avg("c_mid").over(Window.partitionBy("image_id", "root"))
    out = lined.withColumn("line", F.round(F.when(F.col("vertical"), -mean).otherwise(mean), 9))
    out = out.withColumn("track", F.dense_rank().over(Window.partitionBy("image_id").orderBy("line", "root")) - 1)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("track", "r_mid", "slot")) - 1)


def ordered_by_predecessors(placed: DataFrame) -> DataFrame:
    """placed with place: by how many boxes of the image come before (a line further, or earlier in its line), then slot."""
    a, b = placed.alias("a"), placed.select("image_id", "slot", "r_mid", "c_low", "c_high", "c_mid").alias("b")
    aside = F.when(F.col("a.vertical"), F.col("b.c_mid") > F.col("a.c_high")).otherwise(F.col("b.c_mid") < F.col("a.c_low"))
    level = F.col("b.c_mid").between(F.col("a.c_low"), F.col("a.c_high"))
    before = (F.col("a.slot") != F.col("b.slot")) & (aside | (level & (F.col("b.r_mid") < F.col("a.r_mid"))))
    count = a.join(b, F.col("a.image_id") == F.col("b.image_id")).groupBy("a.image_id", "a.slot").agg(F.count_if(before).alias("before"))
    out = placed.join(count, ["image_id", "slot"])
    return out.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("before", "slot")) - 1)


def expanded(boxes: DataFrame, pixels: DataFrame, w: int, h: int, threshold: float = 0.20, read: float = 0.85, across: float = 0.35, low: float = 2.0, high: float = 18.0, share: float = 0.25, count: int = 2, gap: float = 2.5, extent: float = 0.5, margin: float = 0.75) -> DataFrame:
    """image_id, slot, quad and sides (whether left, right, top and bottom moved): boxes whose sides move out to the support just outside them.

    Everything is measured along the box's own axes.  A side looks at pixels of at least the threshold within its cap, in
    the inner 90 % of its length; it moves if `count` to a share of the squared short side are there, the nearest within
    the gap and the farthest at the extent or beyond.  A box without a moved side stays as it is, others become rectangles
    along their axes, cut at the map's edges.
    """
    q, c = F.col("quad"), F.col("centre")
    dot = lambda p, axis: (p["x"] - c["x"]) * F.col(axis)["x"] + (p["y"] - c["y"]) * F.col(axis)["y"]
    local = boxes.select("image_id", "slot", "quad", g.centre(q).alias("centre"), g.horizontal(q).alias("u"), g.vertical(q).alias("v"))
    for axis in ("u", "v"):
        places = F.array(*(dot(q[i], axis) for i in range(4)))
        local = local.withColumn(f"{axis}0", F.array_min(places)).withColumn(f"{axis}1", F.array_max(places))
    wide, tall = F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")
    cap = lambda ratio: F.least(F.greatest(F.lit(ratio) * F.least(wide, tall), F.lit(low)), F.lit(high))
    upright = tall > 1.05 * wide
    local = local.withColumns({"short": F.least(wide, tall), "cap_u": F.when(upright, cap(across)).otherwise(cap(read)), "cap_v": F.when(upright, cap(read)).otherwise(cap(across))})

    # The box that holds all that the sides look at, cut at the map's edges.
    reach = F.lit(high + 1.0)
    bound = lambda f, k: f(F.transform("quad", lambda p: p[k]))
    inside = lambda value, most: F.greatest(F.lit(0.0), F.least(value, F.lit(float(most))))
    edges = [inside(bound(F.array_min, "x") - reach, w), inside(bound(F.array_min, "y") - reach, h), inside(bound(F.array_max, "x") + reach, w), inside(bound(F.array_max, "y") + reach, h)]
    place = F.struct(F.col("px").alias("x"), F.col("py").alias("y"))
    near = pixel_rows.near(local, pixels.where(F.col("v") >= threshold), *edges).withColumns({"pu": dot(place, "u"), "pv": dot(place, "v")})
    corridor = lambda k: F.col(f"p{k}").between(F.col(f"{k}0") + 0.05 * (F.col(f"{k}1") - F.col(f"{k}0")), F.col(f"{k}1") - 0.05 * (F.col(f"{k}1") - F.col(f"{k}0")))
    sides = {"left": (F.col("u0") - F.col("pu"), "v", "cap_u"), "right": (F.col("pu") - F.col("u1"), "v", "cap_u"), "top": (F.col("v0") - F.col("pv"), "u", "cap_v"), "bottom": (F.col("pv") - F.col("v1"), "u", "cap_v")}
    stats = []
    for side, (far, other, most) in sides.items():
        seen = F.when((far > 0) & (far <= F.col(most)) & corridor(other), far)
        stats += [F.count(seen).alias(f"{side}_n"), F.min(seen).alias(f"{side}_near"), F.max(seen).alias(f"{side}_far")]
    out = local.join(near.groupBy("image_id", "slot").agg(*stats), ["image_id", "slot"], "left")
    for side, (_, _, most) in sides.items():
        moved = (F.col(f"{side}_n") >= count) & (F.col(f"{side}_n") <= share * F.col("short") * F.col("short")) & (F.col(f"{side}_near") <= gap) & (F.col(f"{side}_far") >= extent)
        moved = F.coalesce(moved, F.lit(False))
        out = out.withColumn(side, moved).withColumn(f"{side}_move", F.when(moved, F.least(F.col(f"{side}_far") + margin, F.col(most))).otherwise(0.0))
    ends = {"u0": F.col("u0") - F.col("left_move"), "u1": F.col("u1") + F.col("right_move"), "v0": F.col("v0") - F.col("top_move"), "v1": F.col("v1") + F.col("bottom_move")}

    def corner(a: str, b: str) -> tuple[Column, Column]:
        at = lambda k: c[k] + ends[a] * F.col("u")[k] + ends[b] * F.col("v")[k]
        return inside(at("x"), w), inside(at("y"), h)

    moved = F.col("left") | F.col("right") | F.col("top") | F.col("bottom")
    quad = F.when(moved, g.quad(corner("u0", "v0"), corner("u1", "v0"), corner("u1", "v1"), corner("u0", "v1"))).otherwise(q)
    return out.select("image_id", "slot", quad.alias("quad"), F.array("left", "right", "top", "bottom").alias("sides"))


def repaired(boxes: DataFrame, aspect: float = 4.0, wider: float = 1.5, upright: float = 1.05) -> DataFrame:
    """image_id, slot, quad, repaired: a box that is long, and much narrower than the median of its peers, is stretched to
    their width along its own short axis.

    Peers are the other boxes of the image with the same orientation.
    """
    axis = lambda q: F.when(g.width(q) <= g.height(q), g.horizontal(q)).otherwise(g.vertical(q))
    told = g.let(g.ordered(F.col("quad")), lambda q: F.struct(g.width(q).alias("w"), g.height(q).alias("h"), axis(q).alias("axis")))
    sized = boxes.select("image_id", "slot", "quad", told.alias("told"), g.centre(F.col("quad")).alias("c")).select("image_id", "slot", "quad", "c", "told.*")
    sized = sized.withColumn("vertical", F.col("h") > upright * F.col("w")).withColumn("cross", F.when(F.col("vertical"), F.col("w")).otherwise(F.col("h")))
    peers = sized.select("image_id", "vertical", F.col("slot").alias("__slot"), F.col("cross").alias("__cross"))
    middle = sized.join(peers, ["image_id", "vertical"]).where(F.col("slot") != F.col("__slot")).groupBy("image_id", "slot").agg(F.median("__cross").alias("middle"))
    out = sized.join(middle, ["image_id", "slot"], "left")
    short = F.least("w", "h")
    fix = F.coalesce((F.greatest("w", "h") / F.greatest(short, F.lit(1e-6)) >= aspect) & (F.col("middle") >= wider * F.col("cross")), F.lit(False))
    out = out.withColumns({"fix": fix, "scale": F.greatest("middle", F.lit(1e-6)) / short - 1})
    along = lambda p: (p["x"] - F.col("c")["x"]) * F.col("axis")["x"] + (p["y"] - F.col("c")["y"]) * F.col("axis")["y"]
    stretched = F.transform("quad", lambda p: F.struct(*((p[k] + F.col("scale") * along(p) * F.col("axis")[k]).alias(k) for k in ("x", "y"))))
    return out.select("image_id", "slot", F.when(F.col("fix"), stretched).otherwise(F.col("quad")).alias("quad"), F.col("fix").alias("repaired"))


def crops(boxes: DataFrame, side: int = 48, most: int = 640) -> DataFrame:
    """image_id, slot, w, h (of the crop, at least 2), turned and width (of the crop scaled to the side)."""
    w, h = (F.greatest(F.bround(f(F.col("quad"))), F.lit(2.0)) for f in (g.longest_width, g.longest_height))
    out = boxes.select("image_id", "slot", w.alias("w"), h.alias("h"))
    out = out.withColumn("turned", F.col("h") / F.col("w") >= 1.05)
    return out.withColumn("width", F.least(F.ceil(F.greatest("w", "h") * side / F.least("w", "h")), F.lit(most)).cast("int"))


def required_width(cropped: DataFrame, choices: tuple[int, ...] = (320, 480, 640)) -> DataFrame:
    """required (the greatest width, 0 without crops), nearest (choice) and each crop's bucket is bucketed()."""
    total = cropped.agg(F.coalesce(F.max("width"), F.lit(0)).alias("required"))
    best = F.array_min(F.array(*(F.struct(F.abs(F.lit(c) - F.col("required")).alias("d"), F.lit(c).alias("c")) for c in choices)))
    return total.select("required", best["c"].alias("nearest"))


def bucketed(width: Column, choices: tuple[int, ...] = (320, 480, 640)) -> Column:
    """The smallest choice that is wide enough, else the widest."""
    out = F.lit(choices[-1])
    for c in reversed(choices[:-1]):
        out = F.when(width <= c, c).otherwise(out)
    return out
