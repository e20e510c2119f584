"""Probability maps as pixel rows (image_id, p, y, x, v): components, rotated rectangles, scores and unclipped boxes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphflow.functions import geometry as g

# Degrees tried around a component's axis, then around the best of them.
COARSE = tuple(range(-44, 45, 4))
FINE = tuple(x / 2 for x in range(-6, 7))
#: Slack at the edges of a rectangle, for rounding.
EDGE = 1e-6
#: Side of the tiles by which pixels and boxes meet.
TILE = 32


def foreground(pixels: DataFrame, threshold: float = 0.20) -> DataFrame:
    return pixels.where(F.col("v") > threshold)


def support(pixels: DataFrame, threshold: float = 0.20) -> DataFrame:
    return pixels.where(F.col("v") >= threshold)


def _roots(image: np.ndarray, p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The least p of each pixel's component, for the pixels of many images: runs of pixels, joined to those of the next line."""
    order = np.lexsort((x, y, image))
    i, q, r, c = image[order], p[order], y[order], x[order]
    line = np.append(True, (i[1:] != i[:-1]) | (r[1:] != r[:-1]))
    first = np.flatnonzero(line | np.append(True, c[1:] != c[:-1] + 1))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c))))
    low, high, least = c[first].astype(np.int64), c[np.append(first[1:], len(c)) - 1].astype(np.int64), np.minimum.reduceat(q, first).astype(np.int64)
    row = (np.cumsum(line) - 1)[first]
    lines = np.flatnonzero(line)
    below = np.append((i[lines][1:] == i[lines][:-1]) & (r[lines][1:] == r[lines][:-1] + 1), False)[row]
    wide, start = int(high.max()) + 3, int(low.min())
    key = lambda n, column: n * wide + np.clip(column - start + 1, 0, wide - 1)
    a = np.searchsorted(key(row, high), key(row + 1, low - 1))  # the first run of the next line that ends there or later
    b = np.searchsorted(key(row, low), key(row + 1, high + 1), "right")
    count = np.where(below, np.maximum(b - a, 0), 0)
    one = np.repeat(np.arange(len(first)), count)
    two = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
    up = np.arange(len(first))
    while len(one):
        one, two = up[one], up[two]
        apart = one != two
        one, two = one[apart], two[apart]
        np.minimum.at(up, np.maximum(one, two), np.minimum(one, two))
        while (up[up] != up).any():
            up = up[up]
    np.minimum.at(least, up, least.copy())
    out = np.empty(len(p), np.int64)
    out[order] = least[up][run]
    return out


def components(pixels: DataFrame) -> DataFrame:
    """image_id, p, y, x, v, root: 8-connected components of the rows, named by their least p.

    Connectivity is a walk, not a join: a task labels the images of a batch together, and holds at most one image more.
    """
    rows = pixels.select("image_id", "p", "y", "x", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def labelled(table: pa.Table) -> Iterator[pa.RecordBatch]:
            root = _roots(*(table.column(k).to_numpy() for k in ("image_id", "p", "y", "x")))
            yield from table.append_column("root", pa.array(root, pa.int32())).to_batches()

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            image = held.column("image_id").to_numpy()
            whole = int(np.searchsorted(image, image[-1])) if len(image) else 0
            if whole:
                yield from labelled(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from labelled(held.combine_chunks())

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return rows.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(run, f"{kinds}, root int")


def lines(labelled: DataFrame) -> DataFrame:
    """Of each component's line y: its first and last x, the number of pixels and the sums of x and of its square.

    All that follows needs no more, and every use shares the one exchange by component.
    """
    x = F.col("x").cast("long")
    dealt = labelled.select("image_id", "root", "y", "x").repartition("image_id", "root")
    return dealt.groupBy("image_id", "root", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))


def sizes(lined: DataFrame) -> DataFrame:
    """size of each component of lines()."""
    return lined.groupBy("image_id", "root").agg(F.sum("n").alias("size"))


def at_least(lined: DataFrame, size: int) -> DataFrame:
    """The lines of components of at least that many pixels."""
    return lined.withColumn("size", F.sum("n").over(Window.partitionBy("image_id", "root"))).where(F.col("size") >= size).drop("size")


def largest(sized: DataFrame, most: int = 64) -> DataFrame:
    """slot of the largest components of each image (ties to the lower root), with raw_count and overflow."""
    order = Window.partitionBy("image_id").orderBy(F.desc("size"), "root")
    out = sized.withColumn("slot", (F.row_number().over(order) - 1).cast("int")).withColumn("raw_count", F.count("*").over(Window.partitionBy("image_id")))
    return out.withColumn("overflow", F.col("raw_count") > most).where(F.col("slot") < most)


def axes(lined: DataFrame) -> DataFrame:
    """image_id, root, angle: of the principal axis, from sums of integers, so that symmetric components don't depend on rounding."""
    y = F.col("y").cast("long")
    sums = lined.groupBy("image_id", "root").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum(y * F.col("n")).alias("sy"), F.sum("sxx").alias("sxx"), F.sum(y * y * F.col("n")).alias("syy"), F.sum(y * F.col("sx")).alias("sxy"))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = (n * F.col("sxx") - sx * sx) - (n * F.col("syy") - sy * sy)
    return sums.select("image_id", "root", (0.5 * F.atan2((2 * (n * F.col("sxy") - sx * sy)).cast("double"), spread.cast("double"))).alias("angle"))


def _fitted(lined: DataFrame, angles: DataFrame, degrees: tuple[float, ...]) -> DataFrame:
    """The least rectangle of each component over angles plus degrees; the first of equal ones."""
    offsets = F.posexplode(F.array(*(F.lit(math.radians(d)) for d in degrees))).alias("i", "offset")
    tried = angles.select("image_id", "root", "angle", offsets).select("image_id", "root", "i", (F.col("angle") + F.col("offset")).alias("angle"))
    ends = lined.select("image_id", "root", F.explode(F.array_distinct(F.array("x0", "x1"))).alias("x"), "y")  # no other pixel is extreme
    rows = ends.join(tried, ["image_id", "root"])
    u = F.cos("angle") * F.col("x") + F.sin("angle") * F.col("y")
    v = F.cos("angle") * F.col("y") - F.sin("angle") * F.col("x")
    each = rows.groupBy("image_id", "root", "i", "angle").agg(F.min(u).alias("u0"), F.max(u).alias("u1"), F.min(v).alias("v0"), F.max(v).alias("v1"))
    area = F.round((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0")), 9)
    best = F.min(F.struct(area.alias("area"), "i", "angle", "u0", "u1", "v0", "v1"))
    return each.groupBy("image_id", "root").agg(best.alias("b")).select("image_id", "root", "b.*")


def rectangles(lined: DataFrame) -> DataFrame:
    """image_id, root, angle, extents u0 to u1 along and v0 to v1 across it, and area of each component's least rectangle."""
    coarse = _fitted(lined, axes(lined), COARSE)
    return _fitted(lined, coarse.select("image_id", "root", "angle"), FINE).drop("i")


def near(boxes: DataFrame, pixels: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """boxes with px, py and value of each pixel of their image from (x0, y0) to (x1, y1), joined by tile and not by image."""
    tile = lambda c: F.floor(c / TILE).cast("int")
    dealt = boxes.withColumns({"__x0": x0, "__y0": y0, "__x1": x1, "__y1": y1})
    dealt = dealt.withColumn("__tx", F.explode(F.sequence(tile(F.col("__x0")), tile(F.col("__x1"))))).withColumn("__ty", F.explode(F.sequence(tile(F.col("__y0")), tile(F.col("__y1")))))
    close = pixels.select("image_id", tile(F.col("x")).alias("__tx"), tile(F.col("y")).alias("__ty"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), F.col("v").alias("value"))
    out = dealt.join(close, ["image_id", "__tx", "__ty"]).where(F.col("px").between(F.col("__x0"), F.col("__x1")) & F.col("py").between(F.col("__y0"), F.col("__y1")))
    return out.drop("__tx", "__ty", "__x0", "__y0", "__x1", "__y1")


def scores(rects: DataFrame, pixels: DataFrame) -> DataFrame:
    """rects with score: the mean over all pixels of the image inside the rectangle."""
    corners = [(u * F.cos("angle") - v * F.sin("angle"), u * F.sin("angle") + v * F.cos("angle")) for u in (F.col("u0"), F.col("u1")) for v in (F.col("v0"), F.col("v1"))]
    low = lambda k: F.greatest(F.least(*(c[k] for c in corners)) - 1, F.lit(0.0))
    high = lambda k: F.greatest(F.greatest(*(c[k] for c in corners)) + 1, F.lit(0.0))
    u = F.cos("angle") * F.col("px") + F.sin("angle") * F.col("py")
    v = F.cos("angle") * F.col("py") - F.sin("angle") * F.col("px")
    inside = u.between(F.col("u0") - EDGE, F.col("u1") + EDGE) & v.between(F.col("v0") - EDGE, F.col("v1") + EDGE)
    found = near(rects, pixels, low(0), low(1), high(0), high(1)).where(inside)
    return found.groupBy(*rects.columns).agg(F.avg("value").alias("score"))


def unclipped(scored: DataFrame, w: int, h: int, min_size: float = 3.0, threshold: float = 0.45, ratio: float = 1.5) -> DataFrame:
    """image_id, root, score, quad of rectangles that are large and likely enough, their sides moved out."""
    du, dv = F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")
    out = scored.where(F.least(du, dv) >= min_size).where(F.col("score") >= threshold)
    out = out.withColumn("d", du * dv * ratio / F.greatest(2 * (du + dv), F.lit(1e-6)))
    out = out.where(F.least(du, dv) + 2 * F.col("d") >= min_size + 2)
    cos, sin = F.cos("angle"), F.sin("angle")

    def corner(u, v):
        return F.greatest(F.lit(0.0), F.least(u * cos - v * sin, F.lit(float(w)))), F.greatest(F.lit(0.0), F.least(u * sin + v * cos, F.lit(float(h))))

    u0, u1, v0, v1 = F.col("u0") - F.col("d"), F.col("u1") + F.col("d"), F.col("v0") - F.col("d"), F.col("v1") + F.col("d")
    return out.select("image_id", "root", "score", g.ordered(g.quad(corner(u0, v0), corner(u1, v0), corner(u1, v1), corner(u0, v1))).alias("quad"))


def decoded(pixels: DataFrame, w: int, h: int, pixel: float = 0.20, most: int = 64, **filters: float) -> DataFrame:
    """image_id, slot, score, quad, overflow: the boxes of probability maps, components through to corners."""
    lined = lines(components(foreground(pixels, pixel)))
    top = largest(sizes(lined), most).select("image_id", "root", "slot", "overflow")
    kept = lined.join(top.select("image_id", "root"), ["image_id", "root"])
    return unclipped(scores(rectangles(kept), pixels), w, h, **filters).join(top, ["image_id", "root"]).drop("root")


def primary_of(supplement: DataFrame, w: int, h: int, threshold: float = 0.45, min_size: float = 3.0) -> DataFrame:
    """Of the boxes of a looser decode those that a stricter one of the same map has: likely enough, and as large as its
    unclipped boxes are or touching the map's edge, where boxes are cut."""
    q = F.col("quad")
    edge = F.exists(q, lambda p: (p["x"] <= 1e-4) | (p["y"] <= 1e-4) | (p["x"] >= w - 1e-4) | (p["y"] >= h - 1e-4))
    return supplement.where((F.col("score") >= threshold) & ((g.let(q, lambda q: F.least(g.width(q), g.height(q))) >= min_size + 2) | edge))
