"""Spatial joins by grid buckets: equal cells make an equi-join, an exact predicate decides.

A row is put into every cell that its bounding box touches, so cells are as wide as the largest search distance; a
sheet's own key is part of the join key, which keeps candidates within one sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoline.functions import geometry as g


def cells(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> Column:
    """The grid cells that a box touches, array<struct(cx, cy)>."""
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(span(x1, x2), lambda cx: F.transform(span(y1, y2), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def in_cells(rows: DataFrame, size: float, pad: float = 0.0, box: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Rows once per cell, with columns cx and cy."""
    x1, y1, x2, y2 = (F.col(c) for c in box)
    return rows.withColumn("_c", F.explode(cells(x1 - pad, y1 - pad, x2 + pad, y2 + pad, size))).select(*rows.columns, "_c.cx", "_c.cy")


def cell_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows joined by cell, never by broadcast.

    Spark takes rows that explode into cells for as few as before and would send them through the driver.
    """
    return a.join(b.hint("merge"), on, how)


def _named(rows: DataFrame, prefix: str, keys: tuple[str, ...]) -> DataFrame:
    return rows.select(*keys, "cx", "cy", *(F.col(c).alias(f"{prefix}{c}") for c in rows.columns if c not in (*keys, "cx", "cy")))


def edges_of(runs: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, run_id, edge, x1, y1, x2, y2): the straight edges of pipes with points, or pipes without as one edge each."""
    if "points" not in runs.columns:
        return runs.select(*keys, "run_id", F.lit(0).alias("edge"), "x1", "y1", "x2", "y2")
    both = F.arrays_zip(F.expr("slice(points, 1, size(points) - 1)").alias("a"), F.expr("slice(points, 2, size(points) - 1)").alias("b"))
    rows = runs.where("size(points) >= 2").select(*keys, "run_id", F.posexplode(both).alias("edge", "e"))
    return rows.select(*keys, "run_id", "edge", *(F.col(f"e.{p}")[k].alias(f"{c}{n}") for n, p in ((1, "a"), (2, "b")) for k, c in enumerate("xy")))


def ends_of(runs: DataFrame, *others: str, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, run_id, others, which, x, y): both ends of every pipe, which is 1 or 2."""
    at = [(F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))]
    if "points" in runs.columns:
        at = [(F.col("points")[0][0], F.col("points")[0][1]), (F.element_at("points", -1)[0], F.element_at("points", -1)[1])]
    both = F.array(*(F.struct(F.lit(k).alias("which"), x.alias("x"), y.alias("y")) for k, (x, y) in enumerate(at, 1)))
    return runs.select(*keys, "run_id", *others, F.explode(both).alias("e")).select(*keys, "run_id", *others, "e.*")


#: Squared distance of (x, y) from the edge (x1, y1) - (x2, y2) in SQL, exact for edges along an axis.
EDGE_DISTANCE_2 = """if(x1 = x2 or y1 = y2,
  pow(greatest(least(x1, x2) - x, x - greatest(x1, x2), 0), 2) + pow(greatest(least(y1, y2) - y, y - greatest(y1, y2), 0), 2),
  pow(x1 + greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (x2 - x1) - x, 2)
  + pow(y1 + greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (y2 - y1) - y, 2))"""


def ends_on_edges(ends: DataFrame, edges: DataFrame, tol: float, keys: tuple[str, ...] = ("sheet_id",), cell: float = 64.0) -> DataFrame:
    """(keys, run_id, which, other): ends within tol of an edge of another pipe; a point is in one cell only."""
    e = edges.withColumnsRenamed({"run_id": "other"}).withColumns({"lx": F.least("x1", "x2"), "ly": F.least("y1", "y2"), "hx": F.greatest("x1", "x2"), "hy": F.greatest("y1", "y2")})
    e = in_cells(e, cell, tol, ("lx", "ly", "hx", "hy")).drop("edge", "lx", "ly", "hx", "hy")
    p = ends.select(*keys, "run_id", "which", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    near = p.join(e, [*keys, "cx", "cy"]).where(f"run_id <> other and {EDGE_DISTANCE_2} <= {tol * tol}")
    return near.select(*keys, "run_id", "which", "other")


def end_pairs(ends: DataFrame, reach: float, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, a, b, all columns of both ends as a_ and b_): ends of two pipes, a < b, within reach on both axes."""
    own = [c for c in ends.columns if c not in keys]
    size = max(reach, 1.0)
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size) + 1))
    a = ends.select(*keys, *(F.col(c).alias(f"a_{c}") for c in own)).withColumn("cx", F.floor(F.col("a_x") / size)).withColumn("cy", F.floor(F.col("a_y") / size))
    b = ends.select(*keys, *(F.col(c).alias(f"b_{c}") for c in own)).withColumn("cx", around("b_x")).withColumn("cy", around("b_y"))
    near = cell_join(a, b, [*keys, "cx", "cy"]).where(f"a_run_id < b_run_id and abs(a_x - b_x) <= {reach} and abs(a_y - b_y) <= {reach}")
    return near.drop("cx", "cy").withColumnsRenamed({"a_run_id": "a", "b_run_id": "b"})


def adjacency(
    runs: DataFrame, tol: float, bridge: float = 0.0, corner: float = 0.0, noise: float | None = None, symbols: DataFrame | None = None,
    inset: float = 4.0, pad: float = 4.0, blocked: DataFrame | None = None, keys: tuple[str, ...] = ("sheet_id",), cell: float = 64.0,
) -> DataFrame:
    """(keys, a, b), a < b: pipes that touch, or whose ends a bend or a gap in one line parts.

    runs: keys, run_id, axis (H, V or poly), x1 .. y2 or points; rows with a true `underline` are no pipes. Touching: an
    end of one within tol of the other. Bend: pipes of unlike axes, or of none, with ends within `corner`. Gap: ends
    within tol across one axis and at most `noise` along it, or at most `bridge` if an in-line symbol (symbols: keys,
    coarse, box) holds its middle, give or take pad. Neither leads through equipment: the middle must not lie deeper
    than inset in such a box. Without symbols `noise` is `bridge`. blocked: keys, a, b pairs that a spec break parts.
    """
    pipes = runs.where("not coalesce(underline, false)") if "underline" in runs.columns else runs
    noise = (bridge if symbols is None else 0.0) if noise is None else noise
    ends = ends_of(pipes, "axis", keys=keys)
    touch = ends_on_edges(ends, edges_of(pipes, keys), tol, keys, cell).select(*keys, F.least("run_id", "other").alias("a"), F.greatest("run_id", "other").alias("b"))
    out = touch
    if max(bridge, corner) > 0:
        gaps = end_pairs(ends.drop("which"), max(bridge, corner), keys)
        gaps = gaps.withColumns({"dx": F.expr("abs(a_x - b_x)"), "dy": F.expr("abs(a_y - b_y)"), "mx": F.expr("(a_x + b_x) / 2"), "my": F.expr("(a_y + b_y) / 2")})
        bend = f"(a_axis <> b_axis or a_axis = 'poly') and dx * dx + dy * dy <= {corner * corner}"
        line = f"least(dx, dy) <= {tol} and greatest(dx, dy) <= {bridge}"
        gaps = gaps.where(f"({bend}) or ({line})").select(*keys, "a", "b", "mx", "my", F.expr(f"({bend}) or ({line} and greatest(dx, dy) <= {noise})").alias("near"))
        if symbols is not None:
            box = in_cells(symbols.select(*keys, "coarse", "x1", "y1", "x2", "y2"), cell, pad)
            gaps = gaps.withColumn("cx", F.floor(F.col("mx") / cell)).withColumn("cy", F.floor(F.col("my") / cell)).join(box, [*keys, "cx", "cy"], "left")
            held = lambda by: F.expr(f"mx between x1 - ({by}) and x2 + ({by}) and my between y1 - ({by}) and y2 + ({by})")
            inside = F.coalesce((F.col("coarse") == "equipment") & held(-inset), F.lit(False))
            inline = F.coalesce((F.col("coarse") != "equipment") & held(pad), F.lit(False))
            gaps = gaps.groupBy(*keys, "a", "b", "mx", "my", "near").agg(F.bool_or(inside).alias("inside"), F.bool_or(inline).alias("inline")).where("not inside and (near or inline)")
        else:
            gaps = gaps.where("near")
        out = out.unionByName(gaps.select(*keys, "a", "b"))
    out = out.distinct()
    if blocked is not None:
        parted = blocked.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = out.join(parted, [*keys, "a", "b"], "left_anti")
    return out


def nearest_run(points: DataFrame, runs: DataFrame, radius: float, keys: tuple[str, ...] = ("sheet_id",), prefer_axis: str | None = None, same_axis_weight: float = 0.6) -> DataFrame:
    """(keys, point_id, run_id, distance) of the nearest pipe within radius; ties go to the longer, then smaller id.

    prefer_axis: a column of points; a pipe on that axis weighs less, as class codes sit beside their own pipe.
    """
    spread = runs.select(*keys, "run_id", "axis", "x1", "y1", "x2", "y2", F.least("x1", "x2").alias("lx"), F.least("y1", "y2").alias("ly"), F.greatest("x1", "x2").alias("hx"), F.greatest("y1", "y2").alias("hy"))
    p = points.withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    near = p.join(_named(in_cells(spread, radius, radius, ("lx", "ly", "hx", "hy")), "r_", keys), [*keys, "cx", "cy"])
    d = g.point_segment(F.col("x"), F.col("y"), *(F.col(f"r_{c}") for c in ("x1", "y1", "x2", "y2")))
    near = near.withColumn("distance", d).where(F.col("distance") <= radius)
    score = F.col("distance")
    if prefer_axis:
        score = score * F.when(F.col(prefer_axis) == F.col("r_axis"), same_axis_weight).otherwise(1.0)
    size = F.pow(F.col("r_x2") - F.col("r_x1"), 2.0) + F.pow(F.col("r_y2") - F.col("r_y1"), 2.0)
    best = F.min(F.struct(score.alias("score"), (-size).alias("size"), F.col("r_run_id").alias("run_id"), F.col("distance"))).alias("m")
    return near.groupBy(*keys, "point_id").agg(best).select(*keys, "point_id", "m.run_id", "m.distance")


def tokens_near(ends: DataFrame, tokens: DataFrame, radius: float, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Texts around each pipe end, joined in reading order (y, then x): (keys, run_id, text)."""
    t = tokens.withColumn("cx", F.explode(F.sequence(F.floor((F.col("x") - radius) / radius), F.floor((F.col("x") + radius) / radius))))
    t = t.withColumn("cy", F.explode(F.sequence(F.floor((F.col("y") - radius) / radius), F.floor((F.col("y") + radius) / radius))))
    e = ends.select(*keys, "run_id", F.col("x").alias("ex"), F.col("y").alias("ey"), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    near = cell_join(e, t, [*keys, "cx", "cy"]).where(F.pow(F.col("x") - F.col("ex"), 2.0) + F.pow(F.col("y") - F.col("ey"), 2.0) <= radius * radius)
    return near.groupBy(*keys, "run_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda s: s.text)).alias("text"))


def duplicate_runs(candidates: DataFrame, runs: DataFrame, tol: float = 4.0, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Candidates (cand_id, x1..y2) whose both ends lie within tol of one existing pipe."""
    spread = runs.select(*keys, "run_id", "x1", "y1", "x2", "y2", F.least("x1", "x2").alias("lx"), F.least("y1", "y2").alias("ly"), F.greatest("x1", "x2").alias("hx"), F.greatest("y1", "y2").alias("hy"))
    c = candidates.withColumn("cx", F.floor(F.col("x1") / 64)).withColumn("cy", F.floor(F.col("y1") / 64))
    near = c.join(_named(in_cells(spread, 64.0, tol, ("lx", "ly", "hx", "hy")), "r_", keys), [*keys, "cx", "cy"])
    seg = [F.col(f"r_{k}") for k in ("x1", "y1", "x2", "y2")]
    hit = (g.point_segment(F.col("x1"), F.col("y1"), *seg) <= tol) & (g.point_segment(F.col("x2"), F.col("y2"), *seg) <= tol)
    found = near.where(hit).select(*keys, "cand_id").distinct()
    return candidates.join(found, [*keys, "cand_id"], "left_semi")


def outside_boxes(rows: DataFrame, boxes: DataFrame, keys: tuple[str, ...] = ("sheet_id",), pad: float = 0.0, cell: float = 128.0) -> DataFrame:
    """Rows (with x, y) that lie in no box: the left-anti join of the point filters."""
    b = _named(in_cells(boxes, cell, pad), "b_", keys)
    inside = F.expr(f"x >= b_x1 - {pad} and x <= b_x2 + {pad} and y >= b_y1 - {pad} and y <= b_y2 + {pad}")
    p = rows.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    on = [p[k] == b[k] for k in (*keys, "cx", "cy")]
    return p.join(b, [*on, inside], "left_anti").drop("cx", "cy")


def merge_intervals(rows: DataFrame, keys: tuple[str, ...], lo: str, hi: str, gap: float) -> DataFrame:
    """Intervals of one line joined where they overlap or are at most `gap` apart: (keys, lo, hi, n)."""
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(before.isNull() | (F.col(lo) > before + gap), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("n")).drop("_island")


def subtract_intervals(base: DataFrame, holes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What is left of base intervals (keys, id, lo, hi) without holes (keys, h_lo, h_hi): (keys, id, lo, hi)."""
    touch = F.expr("h_lo < hi and h_hi > lo")
    b, h = base.alias("b"), holes.alias("h")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"b.{k}") == F.col(f"h.{k}"))
    cut = b.join(h, same & touch, "left").select("b.*", "h_lo", "h_hi")
    hole = F.when(F.col("h_lo").isNotNull(), F.struct(F.greatest("h_lo", "lo").alias("a"), F.least("h_hi", "hi").alias("b")))
    per = cut.groupBy(*keys, "id", "lo", "hi").agg(F.array_sort(F.collect_list(hole)).alias("holes"))
    start = F.struct(F.col("lo").alias("at"), F.array().cast(f"array<struct<lo:{dict(base.dtypes)['lo']},hi:{dict(base.dtypes)['lo']}>>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        return F.struct(F.greatest(s.at, h.b).alias("at"), F.when(h.a > s.at, F.concat(s.out, F.array(F.struct(s.at.alias("lo"), h.a.alias("hi"))))).otherwise(s.out).alias("out"))

    end = F.aggregate("holes", start, step)
    pieces = F.when(end.at < F.col("hi"), F.concat(end.out, F.array(F.struct(end.at.alias("lo"), F.col("hi").alias("hi"))))).otherwise(end.out)
    return per.select(*keys, "id", F.explode(pieces).alias("p")).select(*keys, "id", "p.lo", "p.hi")


def split_at_tees(runs: DataFrame, tol: float, min_piece: float, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Pieces of straight pipes cut where an end of a pipe on the other axis meets their inside: run_id, piece, lo, hi.

    lo and hi run along the pipe's axis; cuts nearer than min_piece to an end or to the cut before are left out.
    """
    flat = runs.select(*keys, "run_id", "axis", *(F.when(F.col("axis") == "H", F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("u1", "x1", "y1"), ("u2", "x2", "y2"), ("v", "y1", "x1"))))
    flat = flat.withColumn("lo", F.least("u1", "u2")).withColumn("hi", F.greatest("u1", "u2")).select(*keys, "run_id", "axis", "lo", "hi", "v")
    other = F.when(F.col("axis") == "H", "V").otherwise("H")
    ends = flat.select(*keys, other.alias("axis"), F.col("v").alias("at"), F.explode(F.array("lo", "hi")).alias("e"))
    size = max(tol, 1.0) * 8
    e = ends.withColumn("cell", F.explode(F.sequence(F.floor((F.col("e") - tol) / size), F.floor((F.col("e") + tol) / size))))
    f = flat.withColumn("cell", F.floor(F.col("v") / size))
    hits = cell_join(f, e, [*keys, "axis", "cell"]).where(f"abs(e - v) <= {tol} and at > lo + {min_piece} and at < hi - {min_piece}")
    cuts = hits.groupBy(*keys, "run_id").agg(F.array_sort(F.collect_set("at")).alias("cuts"))
    kind = dict(flat.dtypes)["lo"]
    rows = flat.join(cuts, [*keys, "run_id"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast(f"array<{kind}>")))
    kept = F.aggregate("cuts", F.array().cast(f"array<{kind}>"), lambda s, c: F.when((F.size(s) == 0) | (c - F.try_element_at(s, F.lit(-1)) >= min_piece), F.concat(s, F.array(c))).otherwise(s))
    rows = rows.withColumn("stops", F.concat(F.array("lo"), kept, F.array("hi")))
    pieces = F.transform(F.sequence(F.lit(1), F.size("stops") - 1), lambda i: F.struct(i.alias("piece"), F.get("stops", i - 1).alias("lo"), F.get("stops", i).alias("hi")))
    return rows.select(*keys, "run_id", "axis", "v", F.explode(pieces).alias("p")).select(*keys, "run_id", "axis", "v", "p.piece", "p.lo", "p.hi")
