"""Polylines, segments and boxes in pixels. Points are arrays of x and y; boxes are x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PT_PER_INCH = 72.0


def pixels(points: float, dpi: float = 350) -> float:
    """A length in points as pixels."""
    return points * dpi / PT_PER_INCH


def length(points: Column) -> Column:
    """Length of a polyline, array<array<number>>; 0 for fewer than two points."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.sqrt(F.pow(b[0] - a[0], 2.0) + F.pow(b[1] - a[1], 2.0)))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def edges(points: Column) -> Column:
    """The straight edges of a polyline: array<struct(x1, y1, x2, y2)>."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    both = lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    return F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), both)


def chord(points: Column) -> Column:
    """Distance between the ends of a polyline."""
    a, b = points[0], F.element_at(points, -1)
    return F.sqrt(F.pow(b[0] - a[0], 2.0) + F.pow(b[1] - a[1], 2.0))


def bbox(points: Column) -> Column:
    """struct(x1, y1, x2, y2) of a polyline."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))


def axis(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """H if a segment is wider than high, else V."""
    return F.when(F.abs(x2 - x1) >= F.abs(y2 - y1), "H").otherwise("V")


def midpoint(points: Column) -> Column:
    """struct(x, y) half way along a polyline by arc length."""
    total = length(points)
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: F.struct(a[0].cast("double").alias("x"), a[1].cast("double").alias("y"), b[0].cast("double").alias("u"), b[1].cast("double").alias("v"), F.sqrt(F.pow(b[0] - a[0], 2.0) + F.pow(b[1] - a[1], 2.0)).alias("n")))
    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def step(s: Column, e: Column) -> Column:
        hit = s.x.isNull() & (s.done + e.n >= total / 2) & (e.n > 0)
        t = (total / 2 - s.done) / e.n
        return F.struct((s.done + e.n).alias("done"), F.when(hit, e.x + t * (e.u - e.x)).otherwise(s.x).alias("x"), F.when(hit, e.y + t * (e.v - e.y)).otherwise(s.y).alias("y"))

    end = F.aggregate(steps, start, step)
    return F.struct(F.coalesce(end.x, points[0][0].cast("double")).alias("x"), F.coalesce(end.y, points[0][1].cast("double")).alias("y"))


def point_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    vx, vy = x2 - x1, y2 - y1
    l2 = vx * vx + vy * vy
    t = F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * vx + (py - y1) * vy) / F.when(l2 > 0, l2)))).otherwise(0.0)
    return F.sqrt(F.pow(x1 + t * vx - px, 2.0) + F.pow(y1 + t * vy - py, 2.0))


def point_polyline(px: Column, py: Column, points: Column) -> Column:
    """Distance of a point from a polyline."""
    n = F.size(points)
    return F.array_min(F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: point_segment(px, py, a[0], a[1], b[0], b[1])))


def overlap_1d(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Shared length of two intervals."""
    return F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1))


def area(b: str = "") -> Column:
    """Area of a box whose columns start with a prefix."""
    return F.greatest(F.lit(0), F.col(f"{b}x2") - F.col(f"{b}x1")) * F.greatest(F.lit(0), F.col(f"{b}y2") - F.col(f"{b}y1"))


def intersection(a: str, b: str) -> Column:
    """Shared area of two boxes."""
    return overlap_1d(*(F.col(f"{p}{c}") for p in (a, b) for c in ("x1", "x2"))) * overlap_1d(*(F.col(f"{p}{c}") for p in (a, b) for c in ("y1", "y2")))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes; 0 for two empty boxes."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / F.when(union > 0, union)).otherwise(0.0)


def rotate(x: Column, y: Column, rot: Column, w: Column, h: Column) -> Column:
    """struct(x, y) of a pixel after a sheet of w by h pixels is turned clockwise by 0, 90, 180 or 270 degrees."""
    r = F.pmod(rot, F.lit(360))
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.when(r == 90, point(h - 1 - y, x)).when(r == 180, point(w - 1 - x, h - 1 - y)).when(r == 270, point(y, w - 1 - x)).otherwise(point(x, y))


def bezier(p0: Column, p1: Column, p2: Column, p3: Column, steps: int = 8) -> Column:
    """Points of a cubic curve, array<struct(x, y)>, steps + 1 of them."""

    def at(i: Column) -> Column:
        t = i / F.lit(float(steps))
        s = 1 - t
        value = lambda c: s * s * s * p0[c] + 3 * s * s * t * p1[c] + 3 * s * t * t * p2[c] + t * t * t * p3[c]
        return F.struct(value("x").alias("x"), value("y").alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def is_furniture(x1: Column, y1: Column, x2: Column, y2: Column, run_length: Column, w: float, h: float) -> Column:
    """Whether a segment is frame or title block by its place: too long for the sheet, or in a margin band."""
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    return (run_length > 0.80 * max(w, h)) | (cy > 0.849 * h) | (cy < 0.026 * h) | (cx < 0.024 * w) | (cx > 0.977 * w)


def page_edge(x: Column, y: Column, w: float, h: float, margin: float = 0.18) -> Column:
    """The page edge in whose margin a point lies: left, right, top, bottom in this order, else null."""
    return F.when(x <= w * margin, "left").when(x >= w * (1 - margin), "right").when(y <= h * margin, "top").when(y >= h * (1 - margin), "bottom")


def tile_offsets(size: Column, tile: int, overlap: int) -> Column:
    """Starts of tiles along a side; the last tile ends with the side."""
    step = tile - overlap
    regular = F.sequence(F.lit(0), F.greatest(size - tile, F.lit(0)), F.lit(step))
    return F.when(size <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, F.array(size - tile))))
