"""Polylines as arrays: straight pieces, gradual curves, and spatial choices between boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.functions import geometry as g
from isoline.operators.spatial import in_cells


def headings(points: Column) -> Column:
    """Heading in degrees of every edge of a polyline that has a length."""
    real = F.filter(g.edges(points), lambda e: (e.x1 != e.x2) | (e.y1 != e.y2))
    return F.transform(real, lambda e: F.degrees(F.atan2((e.y2 - e.y1).cast("double"), (e.x2 - e.x1).cast("double"))))


def turns(points: Column) -> Column:
    """Turn in degrees, -180 to 180, at every inner vertex."""
    h = headings(points)
    n = F.greatest(F.size(h) - 1, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0)


def straight_pieces(points: Column, tolerance: float = 12.0) -> Column:
    """Pieces of a polyline that keep their heading: array<struct(x1, y1, x2, y2)>.

    A piece ends where the next edge turns by more than tolerance from the piece's way so far, start to end.
    """
    point = lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))
    piece = lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2"))
    first = point(points[0])
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    start = F.struct(none.alias("done"), first.alias("a"), first.alias("b"))

    def step(s: Column, p: Column) -> Column:
        c = point(p)
        ux, uy, vx, vy = s.b.x - s.a.x, s.b.y - s.a.y, c.x - s.b.x, c.y - s.b.y
        same, fresh = (vx == 0) & (vy == 0), (ux == 0) & (uy == 0)
        cosine = (ux * vx + uy * vy) / F.nullif(F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy), F.lit(0.0))
        bends = ~fresh & (F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) > tolerance)
        on = F.struct(F.when(bends, F.concat(s.done, F.array(piece(s.a, s.b)))).otherwise(s.done).alias("done"), F.when(bends, s.b).otherwise(s.a).alias("a"), c.alias("b"))
        return F.when(same, s).otherwise(on)

    end = F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), start, step)
    last = F.when((end.a.x != end.b.x) | (end.a.y != end.b.y), F.array(piece(end.a, end.b))).otherwise(none)
    return F.when(F.size(points) < 2, none).otherwise(F.concat(end.done, last))


def is_gradual(points: Column, sharp: float = 25.0, total: float = 8.0, least: float = 26.0) -> Column:
    """A curve of four points or more and `least` long that turns by `total` degrees or more, nowhere by over `sharp`."""
    t = F.transform(turns(points), F.abs)
    return (F.size(points) >= 4) & (g.length(points) >= least) & (F.coalesce(F.array_max(t), F.lit(0.0)) <= sharp) & (F.aggregate(t, F.lit(0.0), lambda s, x: s + x) >= total)


#: How much longer than its chord a smooth curve may be, its sharpest turn, and the turns that count as
#: changes of side; a loop's longest chord and least length; what makes an edge slanting, and their share in a cloud.
WINDING, SHARP, SIDE = 2.8, 35.0, 3.0
LOOP_CHORD, LOOP_LENGTH = 60.0, 120.0
SLANT_PX, SLANT_RATIO, SLANT_SHARE = 3, 0.35, 0.50


def is_smooth(points: Column) -> Column:
    """An open, gradual polyline, neither loop nor scallop: no sharp turn, and it changes its side once at most."""
    t = turns(points)
    sides = F.transform(F.filter(t, lambda x: F.abs(x) >= SIDE), lambda x: x > 0)
    n = F.greatest(F.size(sides) - 1, F.lit(0))
    changes = F.size(F.filter(F.zip_with(F.slice(sides, 1, n), F.slice(sides, 2, n), lambda a, b: a != b), lambda x: x))
    straight = g.chord(points)
    return (F.size(points) >= 4) & (straight > 1e-9) & (g.length(points) <= WINDING * straight) & ~F.exists(t, lambda x: F.abs(x) > SHARP) & (changes <= 1)


def is_cloud(points: Column) -> Column:
    """A loop, a winding line or a line of scallops: five points or more, and nearly closed, or far longer than its
    chord, or (from seven points on) mostly slanting without being smooth."""
    n, straight, way = F.size(points), g.chord(points), g.length(points)
    dx, dy = (lambda e: F.abs(e.x2 - e.x1)), (lambda e: F.abs(e.y2 - e.y1))
    slanting = F.size(F.filter(g.edges(points), lambda e: (dx(e) > SLANT_PX) & (dy(e) > SLANT_PX) & (F.least(dx(e), dy(e)) > SLANT_RATIO * F.greatest(dx(e), dy(e)))))
    loop = (straight < LOOP_CHORD) & (way > LOOP_LENGTH)
    scallops = (n >= 7) & (slanting > SLANT_SHARE * (n - 1)) & ~is_smooth(points)
    return (n >= 5) & (loop | ((straight > 0) & (way > WINDING * straight)) | scallops)


def best_match(boxes: DataFrame, others: DataFrame, least: float, keys: tuple[str, ...] = ("sheet_id",), cell: float = 128.0) -> DataFrame:
    """(keys, box_id, other_id, iou): for every box the other that overlaps it best, if by more than `least`."""
    cols = ("box_id", "x1", "y1", "x2", "y2")
    a = in_cells(boxes.select(*keys, *cols), cell).select(*keys, "cx", "cy", *(F.col(c).alias(f"a_{c}") for c in cols))
    b = in_cells(others.select(*keys, *cols), cell).select(*keys, "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in cols))
    near = a.join(b, [*keys, "cx", "cy"]).where("a_x1 < b_x2 and b_x1 < a_x2 and a_y1 < b_y2 and b_y1 < a_y2").withColumn("iou", g.iou("a_", "b_")).where(F.col("iou") > least)
    best = F.max(F.struct("iou", (-F.col("b_box_id")).alias("other"))).alias("m")
    return near.groupBy(*keys, F.col("a_box_id").alias("box_id")).agg(best).select(*keys, "box_id", (-F.col("m.other")).alias("other_id"), "m.iou")


def swallow(boxes: DataFrame, big: DataFrame, keys: tuple[str, ...] = ("sheet_id",), cell: float = 128.0) -> DataFrame:
    """Boxes whose centre lies in no big box."""
    b = in_cells(big.select(*keys, "x1", "y1", "x2", "y2"), cell).select(*keys, "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    c = boxes.withColumn("_mx", F.expr("(x1 + x2) / 2")).withColumn("_my", F.expr("(y1 + y2) / 2")).withColumn("cx", F.floor(F.col("_mx") / cell)).withColumn("cy", F.floor(F.col("_my") / cell))
    on = [c[k] == b[k] for k in (*keys, "cx", "cy")]
    return c.join(b, [*on, F.expr("_mx between b_x1 and b_x2 and _my between b_y1 and b_y2")], "left_anti").drop("cx", "cy", "_mx", "_my")


def nearest_text(symbols: DataFrame, texts: DataFrame, pattern: str, reach: float, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, box_id, text): of the texts that match a pattern the one nearest to a symbol's centre by |dx| + |dy|."""
    t = texts.where(F.col("text").rlike(pattern)).select(*keys, F.col("x").alias("tx"), F.col("y").alias("ty"), "text")
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / reach) - 1, F.floor(F.col(c) / reach) + 1))
    t = t.withColumn("cx", around("tx")).withColumn("cy", around("ty"))
    s = symbols.select(*keys, "box_id", F.expr("(x1 + x2) / 2").alias("sx"), F.expr("(y1 + y2) / 2").alias("sy")).withColumn("cx", F.floor(F.col("sx") / reach)).withColumn("cy", F.floor(F.col("sy") / reach))
    d = F.abs(F.col("sx") - F.col("tx")) + F.abs(F.col("sy") - F.col("ty"))
    near = s.join(t, [*keys, "cx", "cy"]).withColumn("d", d).where(F.col("d") <= reach)
    return near.groupBy(*keys, "box_id").agg(F.min(F.struct("d", "text")).alias("m")).select(*keys, "box_id", "m.text")
