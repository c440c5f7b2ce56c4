"""From drawing paths to pipes: merging pieces, symbol regions, splitting at them, tables, and the whole chain.

Segments have keys, seg_id, x1 .. y2 in points of the page. Pipes made of them keep the smallest seg_id as run_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoline.functions import geometry as g
from isoline.operators import shapes, tracing
from isoline.operators.graph import connected_components
from isoline.operators.spatial import cell_join, in_cells, split_at_tees, subtract_intervals
from isoline.session import cut

KEYS = ("sheet_id",)
_BOX = ("x1", "y1", "x2", "y2")
#: Fixed values, in points: how far a level line may slope, the gap that merging closes, the shortest pipe, the shortest
#: piece that is no stroke of a letter, the longest pipe that may be one, and how near the ends of a closed path lie.
AXIS_TOL, MERGE_GAP, MIN_RUN, MIN_PIECE, GLYPH, CLOSED = 1.2, 42.0, 10.0, 14.0, 26.0, 1.0
#: How near the ends of two strokes of a symbol lie, the sizes of symbols, how level two tips are, how
#: far an apex lies from them, and the margin around a region.
APEX, SMALLEST, V_LARGEST, X_LARGEST, LEVEL, EDGE = 1.5, 4.0, 24.0, 30.0, 2.5, 1.5
#: Two strokes oppose below this cosine; fragments of a bar are this near and this parallel; a bar stands
#: this upright on a pipe that is this much longer, and reaches this far on either side.
OPPOSED, BAR_GAP, BAR_OFF, PARALLEL, UPRIGHT, LONGER, REACH = -0.45, 8.0, 1.5, 3.0, 15.0, 2.0, 3.0
#: A table's rows, the gap between them, how much two rows share, and how much of its width they fill.
ROWS, ROW_GAP, ROW_OVERLAP, FILL = 3, 12.0, 0.35, 0.5
#: Fixed value: points by which a pipe stops short of a symbol.
STOP = 0.75


def is_closed(paths: Column) -> Column:
    """A path (struct of closed, items) that returns to its start: a symbol, not a pipe.

    items: array<struct(kind, points)> with kinds l, c, re and qu; a path of one rectangle is closed.
    """
    points = F.flatten(F.transform(paths.items, lambda i: i.points))
    first, last = F.get(points, F.lit(0)), F.try_element_at(points, F.lit(-1))
    gap = F.sqrt(F.pow(first[0] - last[0], 2.0) + F.pow(first[1] - last[1], 2.0))
    box = (F.size(paths.items) == 1) & (F.get(paths.items, F.lit(0)).kind == "re")
    return F.coalesce(paths.closed, F.lit(False)) | F.coalesce(box, F.lit(False)) | F.coalesce(gap <= CLOSED, F.lit(False))


def is_stroked(color: Column, fill: Column, kind: Column) -> Column:
    """A path that is drawn as a line, not a filled shape."""
    return color.isNotNull() & ~F.coalesce(fill.isNotNull() & (kind == "f"), F.lit(False))


def path_segments(paths: DataFrame, curves: bool = True, closed: bool = False, keys: tuple[str, ...] = KEYS, straight: float = 1.5) -> DataFrame:
    """(keys, path_id, seg, x1 .. y2): straight pieces of stroked paths, closed ones left out unless they are asked for.

    paths: keys, path_id, color, fill, type, closed, items: array<struct(kind, points)>. l is a line between two points,
    re a rectangle between two corners, qu a quadrilateral of four, c a cubic curve of four, which is sampled and cut
    where it turns by more than `straight` degrees.
    """
    rows = paths.where(is_stroked(F.col("color"), F.col("fill"), F.col("type")))
    if not closed:
        rows = rows.where(~is_closed(F.struct(F.col("closed"), F.col("items"))))
    rows = rows.select(*keys, "path_id", F.posexplode("items").alias("item", "i"))
    p = lambda k: F.get("i.points", F.lit(k))
    corner = lambda a, b: F.array(a[0], b[1])
    at = lambda k: F.struct(p(k)[0].alias("x"), p(k)[1].alias("y"))
    way = F.when(F.col("i.kind") == "l", F.array(p(0), p(1))).when(F.col("i.kind") == "re", F.array(p(0), corner(p(1), p(0)), p(1), corner(p(0), p(1)), p(0)))
    way = way.when(F.col("i.kind") == "qu", F.array(p(0), p(1), p(2), p(3), p(0)))
    if curves:
        way = way.when(F.col("i.kind") == "c", F.transform(g.bezier(at(0), at(1), at(2), at(3)), lambda q: F.array(q.x, q.y)))
    rows = rows.withColumn("way", way).where("way is not null")
    as_is = F.col("i.kind").isin("l", "re")
    parts = rows.where(as_is).select(*keys, "path_id", "item", F.posexplode(g.edges(F.col("way"))).alias("n", "s"))
    rows = parts.unionByName(rows.where(~as_is).select(*keys, "path_id", "item", F.posexplode(shapes.straight_pieces(F.col("way"), straight)).alias("n", "s")))
    rank = Window.partitionBy(*keys, "path_id").orderBy("item", "n")
    return rows.select(*keys, "path_id", (F.row_number().over(rank) - 1).alias("seg"), "s.*")


def merge_segments(segs: DataFrame, min_piece: float = MIN_PIECE, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, run_id, axis, x1 .. y2): level and upright pieces joined along their line, and longer slanting ones.

    Pieces under min_piece are dropped. Pieces of one axis whose place falls into one band of AXIS_TOL join over gaps of
    MERGE_GAP at most; a pipe lies at the mean of its pieces' places, weighted by their length.
    """
    n = F.expr("sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))")
    rows = segs.withColumn("n", n).where(F.col("n") >= min_piece)
    axis = F.when(F.expr(f"abs(y1 - y2) <= {AXIS_TOL} and abs(x1 - x2) > {AXIS_TOL}"), "H").when(F.expr(f"abs(x1 - x2) <= {AXIS_TOL} and abs(y1 - y2) > {AXIS_TOL}"), "V").otherwise("D")
    rows = rows.withColumn("axis", axis)
    flat = rows.where("axis <> 'D'").select(*keys, "seg_id", "axis", F.expr("double(if(axis = 'H', y1, x1))").alias("mid"), F.expr("double(if(axis = 'H', least(x1, x2), least(y1, y2)))").alias("lo"), F.expr("double(if(axis = 'H', greatest(x1, x2), greatest(y1, y2)))").alias("hi"))
    flat = flat.withColumn("band", F.bround(F.col("mid") / AXIS_TOL))
    order = Window.partitionBy(*keys, "axis", "band").orderBy("lo", "seg_id")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flat = flat.withColumn("new", F.when(before.isNull() | (F.col("lo") - before > MERGE_GAP), 1).otherwise(0)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.greatest(F.lit(1e-9), F.col("hi") - F.col("lo"))
    out = flat.groupBy(*keys, "axis", "band", "island").agg(F.min("seg_id").alias("run_id"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum(F.col("mid") * size) / F.sum(size)).alias("mid")).where(f"hi - lo >= {MIN_RUN}")
    side = lambda h, v: F.when(F.col("axis") == "H", F.col(h)).otherwise(F.col(v))
    out = out.select(*keys, "run_id", "axis", side("lo", "mid").alias("x1"), side("mid", "lo").alias("y1"), side("hi", "mid").alias("x2"), side("mid", "hi").alias("y2"))
    slant = rows.where("axis = 'D'").where(F.col("n") >= max(MIN_RUN, 2 * min_piece)).select(*keys, F.col("seg_id").alias("run_id"), "axis", *(F.col(c).cast("double").alias(c) for c in _BOX))
    return out.unionByName(slant)


def _arms(segs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Both ends of every slanting stroke: keys, seg_id, which, (x, y), and the tip (u, v) at its other end."""
    slant = segs.where(f"abs(x1 - x2) > {APEX} and abs(y1 - y2) > {APEX}")
    both = F.array(*(F.struct(F.lit(k).alias("which"), *(F.col(f"{c}{n}").cast("double").alias(m) for c, n, m in z)) for k, z in ((1, (("x", 1, "x"), ("y", 1, "y"), ("x", 2, "u"), ("y", 2, "v"))), (2, (("x", 2, "x"), ("y", 2, "y"), ("x", 1, "u"), ("y", 1, "v"))))))
    return slant.select(*keys, "seg_id", F.explode(both).alias("e")).select(*keys, "seg_id", "e.*")


def _close_ends(ends: DataFrame, reach: float, keys: tuple[str, ...]) -> DataFrame:
    """Pairs of ends within reach of each other, as a_ and b_ columns; each pair once, a's (seg_id, which) being smaller."""
    own = [c for c in ends.columns if c not in keys]
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / reach) - 1, F.floor(F.col(c) / reach) + 1))
    a = ends.select(*keys, *(F.col(c).alias(f"a_{c}") for c in own)).withColumn("cx", F.floor(F.col("a_x") / reach)).withColumn("cy", F.floor(F.col("a_y") / reach))
    b = ends.select(*keys, *(F.col(c).alias(f"b_{c}") for c in own)).withColumn("cx", around("b_x")).withColumn("cy", around("b_y"))
    return cell_join(a, b, [*keys, "cx", "cy"]).where(f"a_seg_id < b_seg_id and pow(a_x - b_x, 2) + pow(a_y - b_y, 2) <= {reach * reach}").drop("cx", "cy")


def v_regions(segs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, a, b, axis, x1 .. y2): compact pairs of strokes that share an apex and have level tips, as open valves."""
    pairs = _close_ends(_arms(segs, keys), APEX, keys)
    first = Window.partitionBy(*keys, "a_seg_id", "b_seg_id").orderBy("a_which", "b_which")
    pairs = pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumns({"sx": F.expr("(a_x + b_x) / 2"), "sy": F.expr("(a_y + b_y) / 2")})

    def kind(p: str, q: str, u: str, v: str) -> tuple[str, str]:
        size = f"abs(a_{u} - b_{u}) between {SMALLEST} and {V_LARGEST} and abs(a_{v} - b_{v}) <= {LEVEL}"
        apex = f"s{p} between least(a_{u}, b_{u}) - {LEVEL} and greatest(a_{u}, b_{u}) + {LEVEL} and abs(s{q} - (a_{v} + b_{v}) / 2) >= {LEVEL}"
        return size, apex

    (level, over), (upright, beside) = kind("x", "y", "u", "v"), kind("y", "x", "v", "u")
    pairs = pairs.withColumn("axis", F.expr(f"case when {level} then if({over}, 'h', null) when {upright} then if({beside}, 'v', null) end")).where("axis is not null")
    lo = lambda c, t: F.expr(f"if(axis = '{'h' if c == 'x' else 'v'}', least(a_{t}, b_{t}), least(a_{t}, b_{t}, s{c})) - {EDGE}")
    hi = lambda c, t: F.expr(f"if(axis = '{'h' if c == 'x' else 'v'}', greatest(a_{t}, b_{t}), greatest(a_{t}, b_{t}, s{c})) + {EDGE}")
    return pairs.select(*keys, F.col("a_seg_id").alias("a"), F.col("b_seg_id").alias("b"), "axis", lo("x", "u").alias("x1"), lo("y", "v").alias("y1"), hi("x", "u").alias("x2"), hi("y", "v").alias("y2"))


def cross_regions(segs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, a, b, axis, x1 .. y2): places where exactly four slanting strokes meet in two opposed pairs."""
    arms = _arms(segs, keys).withColumn("node", F.struct(*keys, "seg_id", "which"))
    pairs = cut(_close_ends(arms, APEX, keys).select("a_node", "b_node"), "arms")
    # two arms that only meet each other are no cross, which is what most pairs are; the rest are joined
    n = pairs.select(F.col("a_node").alias("node")).unionByName(pairs.select(F.col("b_node").alias("node"))).groupBy("node").agg(F.count("*").alias("n"))
    for side in "ab":
        pairs = pairs.join(n.select(F.col("node").alias(f"{side}_node"), F.col("n").alias(f"{side}_n")), f"{side}_node")
    home = connected_components(pairs.where("a_n > 1 or b_n > 1"), "a_node", "b_node")
    met = arms.join(home, "node").groupBy(*keys, "component").agg(F.array_sort(F.collect_list(F.struct("seg_id", "which", "x", "y", "u", "v"))).alias("s")).where("size(s) = 4")
    met = met.withColumns({"px": F.expr("s[0].x"), "py": F.expr("s[0].y")})
    unit = "transform(s, t -> named_struct('x', (t.u - px) / sqrt(pow(t.u - px, 2) + pow(t.v - py, 2)), 'y', (t.v - py) / sqrt(pow(t.u - px, 2) + pow(t.v - py, 2))))"
    met = met.withColumn("d", F.expr(unit))
    facing = lambda i, j: f"get(d, {i}).x * get(d, {j}).x + get(d, {i}).y * get(d, {j}).y <= {OPPOSED}"
    met = met.where(" or ".join(f"({facing(0, j)} and {facing(*[k for k in (1, 2, 3) if k != j])})" for j in (1, 2, 3)))
    for c, t in (("x", "u"), ("y", "v")):
        met = met.withColumn(f"{c}1", F.expr(f"least(p{c}, array_min(transform(s, t -> t.{t})))")).withColumn(f"{c}2", F.expr(f"greatest(p{c}, array_max(transform(s, t -> t.{t})))"))
    met = met.where(f"x2 - x1 between {SMALLEST} and {X_LARGEST} and y2 - y1 between {SMALLEST} and {X_LARGEST}").withColumn("a", F.expr("s[0].seg_id")).withColumn("b", F.expr("s[1].seg_id"))
    # a level or upright stroke through the middle tells the direction, else the longer side does
    cell = 64.0
    through = in_cells(segs.select(*keys, F.least("x1", "x2").alias("l"), F.least("y1", "y2").alias("t"), F.greatest("x1", "x2").alias("r"), F.greatest("y1", "y2").alias("u"), F.col("x1").alias("ox"), F.col("y1").alias("oy")), cell, APEX, ("l", "t", "r", "u"))
    at = cell_join(met.select(*keys, "a", "b", "px", "py", F.floor(F.col("px") / cell).alias("cx"), F.floor(F.col("py") / cell).alias("cy")), through, [*keys, "cx", "cy"])
    level = f"u - t <= {APEX} and px between l and r and abs(oy - py) <= {APEX}"
    upright = f"r - l <= {APEX} and py between t and u and abs(ox - px) <= {APEX}"
    way = at.groupBy(*keys, "a", "b").agg(F.bool_or(F.expr(level)).alias("h"), F.bool_or(F.expr(upright)).alias("v"))
    met = met.join(way, [*keys, "a", "b"], "left")
    axis = F.when(F.coalesce("h", F.lit(False)) | (~F.coalesce("v", F.lit(False)) & (F.col("x2") - F.col("x1") >= F.col("y2") - F.col("y1"))), "h").otherwise("v")
    return met.select(*keys, "a", "b", axis.alias("axis"), *(F.expr(f"{c} {'-' if c[1] == '1' else '+'} {EDGE}").alias(c) for c in _BOX))


def bar_regions(segs: DataFrame, keys: tuple[str, ...] = KEYS, cell: float = 64.0) -> DataFrame:
    """(keys, a, b, axis, x1 .. y2): short bars across the inside of a longer pipe; near ones count once.

    A bar is one short stroke, or the two far ends of two that continue each other.
    """
    ends = ("x1", "y1", "x2", "y2")
    rows = segs.select(*keys, "seg_id", *(F.col(c).cast("double").alias(c) for c in ends)).withColumn("n", F.expr("sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))"))
    short = rows.where(f"n between {SMALLEST} and {V_LARGEST}")
    one = short.select(*keys, F.col("seg_id").alias("a"), F.col("seg_id").alias("b"), *ends, "n")
    tips = short.select(*keys, "seg_id", "n", *(F.col(c).alias(f"o{c}") for c in ends), F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e")).select(*keys, "seg_id", "n", *(f"o{c}" for c in ends), "e.*")
    pair = _close_ends(tips, BAR_GAP, keys)
    along = "abs((a_ox2 - a_ox1) * (b_ox2 - b_ox1) + (a_oy2 - a_oy1) * (b_oy2 - b_oy1)) / (a_n * b_n)"
    off = "abs((a_ox2 - a_ox1) * (b_y - a_oy1) - (a_oy2 - a_oy1) * (b_x - a_ox1)) / a_n"
    pair = pair.where(f"{along} >= {math.cos(math.radians(PARALLEL))} and {off} <= {BAR_OFF}")
    far = ["named_struct('x', a_ox1, 'y', a_oy1)", "named_struct('x', a_ox2, 'y', a_oy2)", "named_struct('x', b_ox1, 'y', b_oy1)", "named_struct('x', b_ox2, 'y', b_oy2)"]
    spans = [f"named_struct('n', sqrt(pow({p}.x - {q}.x, 2) + pow({p}.y - {q}.y, 2)), 'k', {-k}, 'p', {p}, 'q', {q})" for k, (p, q) in enumerate((p, q) for i, p in enumerate(far) for q in far[i + 1 :])]
    two = pair.select(*keys, F.col("a_seg_id").alias("a"), F.col("b_seg_id").alias("b"), F.expr(f"greatest({', '.join(spans)})").alias("m")).dropDuplicates([*keys, "a", "b"])
    two = two.select(*keys, "a", "b", F.col("m.p.x").alias("x1"), F.col("m.p.y").alias("y1"), F.col("m.q.x").alias("x2"), F.col("m.q.y").alias("y2"), F.col("m.n").alias("n"))
    bars = one.unionByName(two.where(f"n between {SMALLEST} and {V_LARGEST}"))
    pipes = rows.where("n >= 8").select(*keys, *(F.col(c).alias(f"p{c}") for c in ends), F.col("n").alias("pn"), F.least("x1", "x2").alias("l"), F.least("y1", "y2").alias("t"), F.greatest("x1", "x2").alias("r"), F.greatest("y1", "y2").alias("u"))
    mid = bars.withColumns({"mx": F.expr("(x1 + x2) / 2"), "my": F.expr("(y1 + y2) / 2")})
    mid = mid.withColumn("cx", F.floor(F.col("mx") / cell)).withColumn("cy", F.floor(F.col("my") / cell))
    near = cell_join(mid, in_cells(pipes, cell, V_LARGEST, ("l", "t", "r", "u")), [*keys, "cx", "cy"])
    dx, dy = "(px2 - px1)", "(py2 - py1)"
    s0, s1 = (f"({dx} * (y{k} - py1) - {dy} * (x{k} - px1)) / pn" for k in "12")
    onto = f"(mx - px1) * {dx} + (my - py1) * {dy}"
    hit = near.where(f"pn >= {LONGER} * n and abs(((x2 - x1) * {dx} + (y2 - y1) * {dy}) / (n * pn)) <= {math.sin(math.radians(UPRIGHT))} and {s0} * {s1} < 0 and least(abs({s0}), abs({s1})) >= {REACH} and {onto} > 0 and {onto} < pn * pn")
    found = hit.select(*keys, "a", "b", "mx", "my", *ends).distinct()
    once = Window.partitionBy(*keys, F.bround(F.col("mx") / 3), F.bround(F.col("my") / 3)).orderBy("a", "b")
    found = found.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return found.select(*keys, "a", "b", F.lit("both").alias("axis"), *(F.expr(f"{'least' if c[1] == '1' else 'greatest'}({c[0]}1, {c[0]}2) {'-' if c[1] == '1' else '+'} {EDGE}").alias(c) for c in _BOX))


def symbol_regions(segs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All three kinds of regions: keys, axis, x1 .. y2. Of open valves and crosses that overlap along one axis the first
    stays (pairs before crosses, then by seg_id); bars stay all."""
    named = v_regions(segs, keys).withColumn("kind", F.lit(0)).unionByName(cross_regions(segs, keys).withColumn("kind", F.lit(1)))
    box = "named_struct('axis', r.axis, 'x1', r.x1, 'y1', r.y1, 'x2', r.x2, 'y2', r.y2)"
    sheet = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind", "a", "b", "axis", *_BOX))).alias("rs"))
    over = "exists(s, k -> k.axis = r.axis and greatest(k.x1, r.x1) <= least(k.x2, r.x2) and greatest(k.y1, r.y1) <= least(k.y2, r.y2))"
    kept = sheet.select(*keys, F.expr(f"inline(aggregate(rs, cast(array() as array<struct<axis:string,x1:double,y1:double,x2:double,y2:double>>), (s, r) -> if({over}, s, concat(s, array({box})))))"))
    return kept.unionByName(bar_regions(segs, keys).select(*keys, "axis", *_BOX))


def split_at_regions(runs: DataFrame, regions: DataFrame, keys: tuple[str, ...] = KEYS, cell: float = 64.0) -> DataFrame:
    """(keys, run_id, piece, axis, x1 .. y2): straight pipes without what lies in regions, stopped short of them.

    Pieces under MIN_RUN are dropped.
    """
    rows = runs.withColumns({"l": F.least("x1", "x2"), "t": F.least("y1", "y2"), "r": F.greatest("x1", "x2"), "u": F.greatest("y1", "y2")})
    near = in_cells(rows.select(*keys, "run_id", *_BOX, "l", "t", "r", "u"), cell, 0.0, ("l", "t", "r", "u"))
    near = cell_join(near, in_cells(regions.select(*keys, *_BOX), cell).select(*keys, "cx", "cy", *(F.col(c).alias(f"b{c}") for c in _BOX)), [*keys, "cx", "cy"])

    def side(c: str) -> tuple[str, str]:
        d, a, b = f"({c}2 - {c}1)", f"(b{c}1 - {c}1)", f"(b{c}2 - {c}1)"
        inside = f"{c}1 between b{c}1 and b{c}2"
        return f"if({d} = 0, if({inside}, 0.0D, 2.0D), least({a} / nullif({d}, 0), {b} / nullif({d}, 0)))", f"if({d} = 0, if({inside}, 1.0D, -1.0D), greatest({a} / nullif({d}, 0), {b} / nullif({d}, 0)))"

    (xl, xh), (yl, yh) = side("x"), side("y")
    holes = near.select(*keys, "run_id", F.expr(f"greatest(0.0D, {xl}, {yl})").alias("h_lo"), F.expr(f"least(1.0D, {xh}, {yh})").alias("h_hi")).where("h_hi > h_lo + 1e-9").distinct()
    base = runs.select(*keys, "run_id", F.col("run_id").alias("id"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    left = subtract_intervals(base, holes, (*keys, "run_id")).where("hi > lo + 1e-9").drop("id").join(runs.select(*keys, "run_id", "axis", *_BOX), [*keys, "run_id"])
    n = F.expr("sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))")
    left = left.withColumn("n", n).withColumn("lo", F.expr(f"if(lo > 1e-9, lo + {STOP} / ((hi - lo) * n) * (hi - lo), lo)"))
    left = left.withColumn("hi", F.expr(f"if(hi < 1 - 1e-9, hi - {STOP} / n, hi)")).where(f"(hi - lo) * n >= {MIN_RUN}")
    rank = Window.partitionBy(*keys, "run_id").orderBy("lo")
    at = lambda c, t: F.expr(f"{c}1 + {t} * ({c}2 - {c}1)")
    return left.select(*keys, "run_id", (F.row_number().over(rank) - 1).alias("piece"), "axis", at("x", "lo").alias("x1"), at("y", "lo").alias("y1"), at("x", "hi").alias("x2"), at("y", "hi").alias("y2"))


def table_regions(runs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, axis, x1 .. y2): where ROWS or more parallel lines lie close above each other and share their extent.

    Lines of an axis go by place, start, end; each joins the cluster that it shares most with, measured on the shorter
    share of both, the first of equals. A cluster whose lines do not fill half its extent is no table.
    """
    side = lambda h, v: F.expr(f"double(if(axis = 'H', {h}, {v}))")
    rows = runs.where("axis <> 'D'").select(*keys, "axis", "run_id", side("y1", "x1").alias("at"), side("least(x1, x2)", "least(y1, y2)").alias("lo"), side("greatest(x1, x2)", "greatest(y1, y2)").alias("hi"))
    sheet = rows.groupBy(*keys, "axis").agg(F.array_sort(F.collect_list(F.struct("at", "lo", "hi", "run_id"))).alias("rs"))
    share = "(least(r.hi, c.hi) - greatest(r.lo, c.lo)) / greatest(1e-9, r.hi - r.lo, c.hi - c.lo)"
    score = f"transform(s, c -> if(r.at - c.b > {ROW_GAP} or {share} <= 0 or {share} < {ROW_OVERLAP}, 0.0D, {share}))"
    fresh = "named_struct('a', r.at, 'b', r.at, 'lo', r.lo, 'hi', r.hi, 'n', 1, 'way', r.hi - r.lo)"
    grown = "named_struct('a', least(c.a, r.at), 'b', greatest(c.b, r.at), 'lo', least(c.lo, r.lo), 'hi', greatest(c.hi, r.hi), 'n', c.n + 1, 'way', c.way + (r.hi - r.lo))"
    step = f"get(transform(array({score}), v -> if(coalesce(array_max(v), 0.0D) <= 0, concat(s, array({fresh})), transform(s, (c, i) -> if(i = array_position(v, array_max(v)) - 1, {grown}, c)))), 0)"
    kind = "array<struct<a:double,b:double,lo:double,hi:double,n:int,way:double>>"
    found = sheet.select(*keys, "axis", F.expr(f"inline(aggregate(rs, cast(array() as {kind}), (s, r) -> {step}))")).where(f"n >= {ROWS} and way >= {FILL} * greatest(1e-9, hi - lo) * n")
    place = lambda h, v: F.expr(f"if(axis = 'H', {h}, {v})")
    return found.select(*keys, "axis", place("lo", "a").alias("x1"), place("a", "lo").alias("y1"), place("hi", "b").alias("x2"), place("b", "hi").alias("y2"))


def extract(segs: DataFrame, tee_tol: float, tee_piece: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """From segments to pipes: merged, stopped at symbols, without letters and tables, cut where branches end.

    (keys, run_id, axis, v, piece, lo, hi) of level and upright pipes; ids of pieces are stable digests of their pipe.
    Stages that later ones read several times are written to the shared folder.
    """
    runs = split_at_regions(cut(merge_segments(segs, keys=keys), "merged"), cut(symbol_regions(segs, keys), "regions"), keys)
    runs = cut(runs.withColumn("run_id", F.xxhash64("run_id", "piece")).drop("piece"), "stopped")
    runs = cut(tracing.drop_glyph_noise(runs, GLYPH, 2.0, keys), "real")
    runs = cut(tracing.drop_inside(runs, table_regions(runs, keys).select(*keys, *_BOX), 1.0, keys), "pipes")
    return split_at_tees(runs.where("axis <> 'D'"), tee_tol, tee_piece, keys)
