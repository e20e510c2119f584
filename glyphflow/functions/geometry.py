"""Expressions over quads: arrays of four corners (struct x, y), from the left top on, clockwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row and not once for each use."""
    return F.transform(F.array(value), then)[0]


def quad(*corners: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners))


def ordered(corners: Column) -> Column:
    """Any four corners as a quad: the two leftmost, then the two rightmost, each by height; places within 1e-6 are level."""
    by_x = F.array_sort(F.transform(corners, lambda p: F.struct(F.round(p["x"], 6).alias("level"), F.round(p["y"], 6).alias("rank"), p["x"].alias("x"), p["y"].alias("y"))))
    by_y = lambda part: F.array_sort(F.transform(part, lambda p: F.struct(p["rank"].alias("rank"), p["x"].alias("x"), p["y"].alias("y"))))
    sides = lambda s: F.array(by_y(F.slice(s, 1, 2)), by_y(F.slice(s, 3, 2)))
    return let(let(by_x, sides), lambda s: quad(*((p["x"], p["y"]) for p in (s[0][0], s[1][0], s[1][1], s[0][1]))))


def area(q: Column) -> Column:
    turned = lambda q: F.concat(F.slice(q, 2, 3), F.slice(q, 1, 1))
    cross = let(q, lambda q: F.zip_with(q, turned(q), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def side(q: Column, i: int, j: int) -> Column:
    return F.hypot(q[j]["x"] - q[i]["x"], q[j]["y"] - q[i]["y"])


def width(q: Column) -> Column:
    return (side(q, 0, 1) + side(q, 3, 2)) / 2


def height(q: Column) -> Column:
    return (side(q, 0, 3) + side(q, 1, 2)) / 2


def longest_width(q: Column) -> Column:
    return F.greatest(side(q, 0, 1), side(q, 3, 2))


def longest_height(q: Column) -> Column:
    return F.greatest(side(q, 0, 3), side(q, 1, 2))


def aspect(q: Column) -> Column:
    return let(q, lambda q: F.greatest(width(q), height(q)) / F.greatest(F.least(width(q), height(q)), F.lit(1e-6)))


def centre(q: Column) -> Column:
    mean = lambda q, c: F.aggregate(F.transform(q, lambda p: p[c]), F.lit(0.0), lambda s, v: s + v) / 4
    return let(q, lambda q: F.struct(mean(q, "x").alias("x"), mean(q, "y").alias("y")))


def _unit(x: Column, y: Column) -> Column:
    n = F.greatest(F.hypot(x, y), F.lit(1e-6))
    return F.struct((x / n).alias("x"), (y / n).alias("y"))


def horizontal(q: Column) -> Column:
    """The unit vector of the upper and lower edges together, from left to right."""
    return _unit(q[1]["x"] - q[0]["x"] + q[2]["x"] - q[3]["x"], q[1]["y"] - q[0]["y"] + q[2]["y"] - q[3]["y"])


def vertical(q: Column) -> Column:
    """The unit vector of the left and right edges together, from the top down."""
    return _unit(q[3]["x"] - q[0]["x"] + q[2]["x"] - q[1]["x"], q[3]["y"] - q[0]["y"] + q[2]["y"] - q[1]["y"])


def along(q: Column) -> Column:
    """horizontal(), turned to point right."""
    axis = horizontal(q)
    sign = F.when(axis["x"] < 0, -1.0).otherwise(1.0)
    return F.struct((axis["x"] * sign).alias("x"), (axis["y"] * sign).alias("y"))


def down(q: Column) -> Column:
    """vertical(), turned to point down."""
    axis = vertical(q)
    sign = F.when(axis["y"] < 0, -1.0).otherwise(1.0)
    return F.struct((axis["x"] * sign).alias("x"), (axis["y"] * sign).alias("y"))


def corner_difference(a: Column, b: Column) -> Column:
    """The largest difference of a coordinate."""
    return F.array_max(F.zip_with(a, b, lambda p, q: F.greatest(F.abs(p["x"] - q["x"]), F.abs(p["y"] - q["y"]))))


def touches(q: Column, w: float, h: float, margin: float) -> Column:
    return F.exists(q, lambda p: (p["x"] <= margin) | (p["y"] <= margin) | (p["x"] >= w - 1 - margin) | (p["y"] >= h - 1 - margin))


def mapped(q: Column, scale: Column, left: Column, top: Column, w: Column, h: Column) -> Column:
    """Corners of a letterboxed image in the source, clamped to it."""
    return F.transform(q, lambda p: F.struct(F.greatest(F.lit(0.0), F.least((p["x"] - left) / scale, w - 1)).alias("x"), F.greatest(F.lit(0.0), F.least((p["y"] - top) / scale, h - 1)).alias("y")))


def rescaled(q: Column, x: Column, y: Column) -> Column:
    return F.transform(q, lambda p: F.struct((p["x"] * x).alias("x"), (p["y"] * y).alias("y")))


def letterbox(w: Column, h: Column, size: int) -> Column:
    """scale, left, top, width and height of an image fitted into a square."""
    scale = F.lit(float(size)) / F.greatest(w, h)
    fit = lambda n: F.greatest(F.bround(n * scale), F.lit(1.0))
    edge = lambda n: F.floor((F.lit(size) - fit(n)) / 2).cast("double")
    return F.struct(scale.alias("scale"), edge(w).alias("left"), edge(h).alias("top"), fit(w).alias("width"), fit(h).alias("height"))


def projective(q: Column, w: Column, h: Column) -> Column:
    """The eight coefficients that map the rectangle w x h to a quad; null if it is degenerate."""
    x, y = [q[i]["x"] for i in range(4)], [q[i]["y"] for i in range(4)]
    dx1, dx2, dx3 = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
    dy1, dy2, dy3 = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
    below = dx1 * dy2 - dx2 * dy1
    u, v = (dx3 * dy2 - dx2 * dy3) / below, (dx1 * dy3 - dx3 * dy1) / below
    rows = [(x[1] - x[0] + u * x[1]) / w, (x[3] - x[0] + v * x[3]) / h, x[0], (y[1] - y[0] + u * y[1]) / w, (y[3] - y[0] + v * y[3]) / h, y[0], u / w, v / h]
    return F.when(F.abs(below) > 1e-8, F.array(*rows))
