"""Rules on traced polylines: drafting furniture, slanting lines, stubs, outlines of boxes, cuts and underlines.

Pipes have keys, run_id and points (array of x and y). Every rule that looks at boxes is a grid join on the pipe's or the
edge's own box; nothing compares all pipes with all boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoline.functions import geometry as g
from isoline.operators.spatial import edges_of, end_pairs, ends_of, ends_on_edges, in_cells

KEYS = ("sheet_id",)
_BOX = ("x1", "y1", "x2", "y2")
#: Margin band in which a frame's pieces lie, and the least share of the sheet that they cover; band of
#: title blocks; length of a header and of a whole frame, as shares of the longer side.
FRAME_BAND, FRAME_LENGTH, TITLE_BAND, HEADER, SPAN = 0.032, 0.10, 0.151, 0.10, 0.80
#: An edge slants if it moves this far on both axes and not much less on one; what makes it an artifact.
SLANT, SLANT_RATIO = 50, 0.3
SLANT_LONGEST, SLANT_SHARE, SLANT_SIDE = 300.0, 0.10, 0.08
SLANT_LOW, SLANT_LEFT, SLANT_RIGHT = 0.85, 0.05, 0.20


def _boxed(runs: DataFrame) -> DataFrame:
    """Pipes with their box as x1 .. y2."""
    return runs.withColumn("_b", g.bbox(F.col("points"))).select(*runs.columns, *(F.col(f"_b.{c}").alias(c) for c in _BOX))


def _near(rows: DataFrame, boxes: DataFrame, when: str, reach: float, keys: tuple[str, ...], cell: float = 128.0) -> DataFrame:
    """(keys, run_id) of rows (with a box) that fulfil a condition with a box of the others (b_x1 .. b_y2)."""
    b = in_cells(boxes.select(*keys, *_BOX), cell, reach).select(*keys, "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in _BOX))
    return in_cells(rows.select(*keys, "run_id", *_BOX), cell).join(b, [*keys, "cx", "cy"]).where(when).select(*keys, "run_id").distinct()


def furniture_free(
    runs: DataFrame, w: float, h: float, symbols: DataFrame, furniture: DataFrame, labels: DataFrame, pad: float, margin: float, near: float, label_near: float, keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Pipes that are no frame, title block or table.

    Always dropped: pipes longer than SPAN of the sheet, pipes with an edge along the paper's margin, and pipes wholly
    within furniture (give or take pad). A pipe in a title band at the top or the bottom, or on the outermost ticks, is
    dropped unless it runs into a symbol outside furniture, is as long as a header, or a label that is itself outside
    furniture stands beside it. Boxes: keys, x1 .. y2.
    """
    side = max(w, h)
    rows = _boxed(runs).withColumn("n", g.length(F.col("points")))

    def frame(e: Column) -> Column:
        upright = F.abs(e.x1 - e.x2) <= F.abs(e.y1 - e.y2)
        low = lambda a, b, size: (F.greatest(a, b) < FRAME_BAND * size) | (F.least(a, b) > (1 - FRAME_BAND) * size)
        return F.when(upright, low(e.x1, e.x2, w) & (F.abs(e.y1 - e.y2) > FRAME_LENGTH * h)).otherwise(low(e.y1, e.y2, h) & (F.abs(e.x1 - e.x2) > FRAME_LENGTH * w))

    rows = rows.where((F.col("n") <= SPAN * side) & ~F.exists(g.edges(F.col("points")), frame))
    within = lambda by: f"x1 >= b_x1 - {by} and x2 <= b_x2 + {by} and y1 >= b_y1 - {by} and y2 <= b_y2 + {by}"
    rows = rows.join(_near(rows, furniture, within(pad), pad, keys), [*keys, "run_id"], "left_anti")
    first, last = F.col("points")[0], F.element_at("points", -1)
    by_place = g.is_furniture(first[0], first[1], last[0], last[1], F.col("n"), w, h)
    flagged = by_place | ((first[1] + last[1]) / 2 < TITLE_BAND * h)
    rows = rows.withColumn("_flag", flagged)
    odd = rows.where("_flag")
    dx, dy = "least(x2, b_x2) - greatest(x1, b_x1)", "least(y2, b_y2) - greatest(y1, b_y1)"
    into = f"{dx} >= -{near} and {dy} >= -{near} and (({dx} > {near} and {dy} > {near}) or (({dx} > {near} or {dy} > {near}) and ((x1 > b_x1 + {near} and x2 < b_x2 - {near}) or (y1 > b_y1 + {near} and y2 < b_y2 - {near}))))"
    crossing = _near(odd, symbols, into, near, keys).join(_near(odd, furniture, within(margin), margin, keys), [*keys, "run_id"], "left_anti")
    outside = labels.select(*keys, *_BOX).withColumn("run_id", F.monotonically_increasing_id())
    outside = outside.join(_near(outside, furniture, within(margin), margin, keys), [*keys, "run_id"], "left_anti")
    beside = f"({dx} > -{label_near} and (y1 - b_y2 between 0 and {label_near} or b_y1 - y2 between 0 and {label_near})) or ({dy} > -{label_near} and (x1 - b_x2 between 0 and {label_near} or b_x1 - x2 between 0 and {label_near}))"
    guarded = crossing.unionByName(_near(odd, outside, beside, label_near, keys)).unionByName(odd.where(F.col("n") > HEADER * side).select(*keys, "run_id")).distinct()
    kept = rows.where("not _flag").unionByName(odd.join(guarded, [*keys, "run_id"], "left_semi"))
    return kept.select(*runs.columns)


def slanting_artifacts(points: Column, w: float, h: float) -> Column:
    """Whether a polyline has a slanting edge that is too long, too wide or too high for a pipe, lies at the foot of the
    sheet, or starts in its left margin and leaves it. Never on sheets under 800 pixels."""
    longest = min(SLANT_LONGEST, SLANT_SHARE * max(w, h))

    def bad(e: Column) -> Column:
        dx, dy = F.abs(e.x2 - e.x1), F.abs(e.y2 - e.y1)
        slants = (dx > SLANT) & (dy > SLANT) & (F.least(dx, dy) > SLANT_RATIO * F.greatest(dx, dy))
        big = (dx * dx + dy * dy > longest * longest) | (dx > SLANT_SIDE * w) | (dy > SLANT_SIDE * h)
        return slants & (big | (F.least(e.y1, e.y2) >= SLANT_LOW * h) | ((F.least(e.x1, e.x2) <= SLANT_LEFT * w) & (F.greatest(e.x1, e.x2) >= SLANT_RIGHT * w)))

    return F.lit(False) if min(w, h) < 800 else F.exists(g.edges(points), bad)


def axis_of(points: Column) -> Column:
    """h or v if a polyline is three times as wide as high or the other way round by its ends, else d."""
    a, b = points[0], F.element_at(points, -1)
    dx, dy = F.abs(b[0] - a[0]), F.abs(b[1] - a[1])
    return F.when(dx >= 3 * dy, "h").when(dy >= 3 * dx, "v").otherwise("d")


def drop_floating_stubs(runs: DataFrame, symbols: DataFrame, longest: float, near: float, keys: tuple[str, ...] = KEYS, whole: bool = False) -> DataFrame:
    """Pipes without short slanting ones that no symbol is near; sheets without symbols keep all.

    A pipe is near a symbol if a vertex or the middle of an edge lies within `near` of its box. With whole, middles are
    put on whole pixels, halves to the even one.
    """
    short = runs.where((axis_of(F.col("points")) == "d") & (g.length(F.col("points")) <= longest)).select(*keys, "run_id", "points")
    half = lambda a, b: F.bround((a + b) / 2) if whole else (a + b) / 2
    middles = F.transform(g.edges(F.col("points")), lambda e: F.array(half(e.x1, e.x2), half(e.y1, e.y2)))
    places = short.select(*keys, "run_id", F.explode(F.concat(F.transform("points", lambda p: F.array(p[0].cast("double"), p[1].cast("double"))), middles)).alias("p"))
    places = places.select(*keys, "run_id", *(F.col("p")[k].alias(c) for c, k in (("x1", 0), ("y1", 1), ("x2", 0), ("y2", 1))))
    held = _near(places, symbols, f"x1 between b_x1 - {near} and b_x2 + {near} and y1 between b_y1 - {near} and b_y2 + {near}", near, keys)
    gone = short.join(symbols.select(*keys).distinct(), list(keys), "left_semi").join(held, [*keys, "run_id"], "left_anti")
    return runs.join(gone.select(*keys, "run_id"), [*keys, "run_id"], "left_anti")


def drop_faint_slants(runs: DataFrame, ink: DataFrame, least_ink: float, least_length: float, junction: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Pipes without lone slanting edges that the drawing hardly shows.

    ink: keys, run_id, edge, ink, the measured share of each edge that is inked. An edge counts if it is least_length
    long and moves over 30 pixels on both axes, not much less on one. A pipe with an end within `junction` of another
    pipe's end is never dropped.
    """
    pairs = end_pairs(ends_of(runs, keys=keys), junction, keys).where(f"pow(a_x - b_x, 2) + pow(a_y - b_y, 2) <= {junction * junction}")
    joined = pairs.select(*keys, F.col("a").alias("run_id")).unionByName(pairs.select(*keys, F.col("b").alias("run_id"))).distinct()
    e = edges_of(runs, keys).withColumns({"dx": F.expr("abs(x2 - x1)"), "dy": F.expr("abs(y2 - y1)")})
    slant = e.where(f"dx > 30 and dy > 30 and least(dx, dy) > 0.25 * greatest(dx, dy) and dx * dx + dy * dy >= {least_length * least_length}")
    faint = slant.join(ink.where(F.col("ink") < least_ink), [*keys, "run_id", "edge"], "left_semi").select(*keys, "run_id").distinct()
    return runs.join(faint.join(joined, [*keys, "run_id"], "left_anti"), [*keys, "run_id"], "left_anti")


def without_outlines(runs: DataFrame, boxes: DataFrame, symbols: DataFrame, band: float, keys: tuple[str, ...] = KEYS, cell: float = 128.0) -> DataFrame:
    """(keys, run_id, part, points, axis): what is left of polylines without the edges that lie on the side of a box.

    An edge that touches a symbol, give or take band, is never taken. The rest of a pipe falls into parts where edges
    went; parts under a pixel are dropped.
    """
    e = edges_of(runs, keys).withColumns({"lx": F.least("x1", "x2"), "ly": F.least("y1", "y2"), "hx": F.greatest("x1", "x2"), "hy": F.greatest("y1", "y2")})

    def hits(other: DataFrame, when: str) -> DataFrame:
        b = in_cells(other.select(*keys, *_BOX), cell, band).select(*keys, "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in _BOX))
        return in_cells(e, cell, 0.0, ("lx", "ly", "hx", "hy")).join(b, [*keys, "cx", "cy"]).where(when).select(*keys, "run_id", "edge").distinct()

    side = lambda p, q: f"h{q} - l{q} <= {band} and (abs(({q}1 + {q}2) / 2 - b_{q}1) <= {band} or abs(({q}1 + {q}2) / 2 - b_{q}2) <= {band}) and l{p} >= b_{p}1 - {band} and h{p} <= b_{p}2 + {band}"
    touch = f"hx >= b_x1 - {band} and lx <= b_x2 + {band} and hy >= b_y1 - {band} and ly <= b_y2 + {band}"
    on = hits(boxes, f"({side('x', 'y')}) or ({side('y', 'x')})").join(hits(symbols.where("x2 > x1 and y2 > y1"), touch), [*keys, "run_id", "edge"], "left_anti")
    rest = e.join(on, [*keys, "run_id", "edge"], "left_anti")
    order = Window.partitionBy(*keys, "run_id").orderBy("edge")
    rest = rest.withColumn("_island", F.col("edge") - F.row_number().over(order))
    parts = rest.groupBy(*keys, "run_id", "_island").agg(F.min("edge").alias("first"), F.array_sort(F.collect_list(F.struct("edge", *_BOX))).alias("es"))
    points = F.concat(F.array(F.array(F.col("es")[0].x1, F.col("es")[0].y1)), F.transform("es", lambda x: F.array(x.x2, x.y2)))
    parts = parts.withColumn("points", points).where(g.length(F.col("points")) >= 1.0)
    rank = Window.partitionBy(*keys, "run_id").orderBy("first")
    return parts.select(*keys, "run_id", (F.row_number().over(rank) - 1).alias("part"), "points", axis_of(F.col("points")).alias("axis"))


def split_at_points(runs: DataFrame, cuts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, run_id, part, points): pipes cut in two (a, b) at the place nearest to a point; cuts: keys, run_id, x, y.

    The cut is a whole pixel. It is not repeated where it falls within 1.5 pixels of a vertex. A pipe too short for two
    parts of two points is cut in the middle between its ends. Keys stay, so nothing that refers to a pipe is renumbered.
    """
    e = edges_of(runs, keys).join(cuts.select(*keys, "run_id", "x", "y"), [*keys, "run_id"])
    l2 = F.expr("double((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))")
    t = F.when(l2 > 1e-6, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr("(x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)") / F.nullif(l2, F.lit(0.0))))).otherwise(0.0)
    e = e.withColumn("t", t).withColumns({"fx": F.expr("x1 + t * (x2 - x1)"), "fy": F.expr("y1 + t * (y2 - y1)")})
    best = e.groupBy(*keys, "run_id").agg(F.min(F.struct(F.expr("pow(x - fx, 2) + pow(y - fy, 2)").alias("d"), "edge", "fx", "fy")).alias("m"))
    at = best.select(*keys, "run_id", F.col("m.edge").alias("edge"), F.bround("m.fx").cast("bigint").alias("cx"), F.bround("m.fy").cast("bigint").alias("cy"))
    rows = runs.select(*keys, "run_id", F.transform("points", lambda p: F.transform(p, lambda c: c.cast("bigint"))).alias("points")).join(at, [*keys, "run_id"])
    place = F.array("cx", "cy")
    apart = lambda p: F.pow(p[0] - F.col("cx"), 2.0) + F.pow(p[1] - F.col("cy"), 2.0) > 1.5 * 1.5
    head, tail = F.expr("slice(points, 1, edge + 1)"), F.expr("slice(points, edge + 2, size(points))")
    rows = rows.withColumn("a", F.when(apart(F.element_at(head, -1)), F.concat(head, F.array(place))).otherwise(head)).withColumn("b", F.when(apart(tail[0]), F.concat(F.array(place), tail)).otherwise(tail))
    ends = [F.col("points")[0], F.element_at("points", -1)]
    mid = F.array(*(F.bround((ends[0][k] + ends[1][k]) / 2).cast("bigint") for k in (0, 1)))
    few_a, few_b = F.size("a") < 2, F.size("b") < 2
    a = F.when(few_a & (F.size("b") > 2), F.concat("a", F.array(F.get("b", F.lit(1))))).when(few_a | (few_b & (F.size("a") <= 2)), F.array(ends[0], mid)).otherwise(F.col("a"))
    b = F.when(few_b & (F.size("a") > 2), F.concat(F.array(F.get("a", F.size("a") - 2)), F.col("b"))).when((few_a & (F.size("b") <= 2)) | few_b, F.array(mid, ends[1])).otherwise(F.col("b"))
    parts = F.array(F.struct(F.lit("a").alias("part"), a.alias("points")), F.struct(F.lit("b").alias("part"), b.alias("points")))
    return rows.select(*keys, "run_id", F.explode(parts).alias("p")).select(*keys, "run_id", "p.part", "p.points")


def tags_of_parts(parts: DataFrame, tags: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, pid_idx, run_id, part): tags of cut pipes go to the part whose vertices' mean is nearest to the label's
    middle, the first of equals. tags: keys, pid_idx, run_id, x1 .. y2."""
    mean = lambda k: F.aggregate("points", F.lit(0.0), lambda s, p: s + p[k]) / F.size("points")
    middle = parts.select(*keys, "run_id", "part", mean(0).alias("mx"), mean(1).alias("my"))
    near = tags.select(*keys, "pid_idx", "run_id", F.expr("(x1 + x2) / 2").alias("tx"), F.expr("(y1 + y2) / 2").alias("ty")).join(middle, [*keys, "run_id"])
    best = near.groupBy(*keys, "pid_idx", "run_id").agg(F.min(F.struct(F.expr("pow(tx - mx, 2) + pow(ty - my, 2)").alias("d"), "part")).alias("m"))
    return best.select(*keys, "pid_idx", "run_id", "m.part")


def text_underlines(runs: DataFrame, edges: DataFrame, covered: DataFrame, flat: float, level: float, reach: float, cover: float = 0.72, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, run_id): level straight pipes (x1 .. y2) that are lines under texts.

    They touch no pipe (edges: keys, a, b), have text above on `cover` of their length (covered: keys, run_id, share,
    measured on the drawing) and no other level pipe at their height within reach.
    """
    straight = runs.where(f"abs(y1 - y2) <= {flat}").select(*keys, "run_id", F.least("x1", "x2").alias("lo"), F.greatest("x1", "x2").alias("hi"), F.expr("(y1 + y2) / 2").alias("at"))
    linked = edges.select(*keys, F.col("a").alias("run_id")).unionByName(edges.select(*keys, F.col("b").alias("run_id"))).distinct()
    lone = straight.where("hi - lo >= 8").join(linked, [*keys, "run_id"], "left_anti").join(covered.where(F.col("share") >= cover), [*keys, "run_id"], "left_semi")
    size = max(level, 1.0)
    around = F.explode(F.sequence(F.floor(F.col("v") / size) - 1, F.floor(F.col("v") / size) + 1))
    other = straight.select(*keys, F.col("run_id").alias("other"), F.col("lo").alias("l"), F.col("hi").alias("h"), F.col("at").alias("v")).withColumn("band", around)
    mates = lone.withColumn("band", F.floor(F.col("at") / size)).join(other, [*keys, "band"]).where(f"run_id <> other and abs(at - v) <= {level} and greatest(lo - h, l - hi) <= {reach}")
    return lone.join(mates.select(*keys, "run_id").distinct(), [*keys, "run_id"], "left_anti").select(*keys, "run_id")


def keep_short(runs: DataFrame, bodies: DataFrame, least_length: float, junction: float, link: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Pipes of least_length and more, and shorter ones with an end within `junction` of another pipe or within `link`
    of a point on a symbol's body (bodies: keys, x, y)."""
    short = runs.where(g.length(F.col("points")) < least_length).select(*keys, "run_id", "points")
    ends = ends_of(short, keys=keys)
    met = ends_on_edges(ends, edges_of(runs, keys), junction, keys).select(*keys, "run_id")
    size = max(link, 1.0)
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size) + 1))
    b = bodies.select(*keys, F.col("x").alias("u"), F.col("y").alias("v")).withColumn("cx", around("u")).withColumn("cy", around("v"))
    at = ends.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size)).join(b, [*keys, "cx", "cy"])
    held = at.where(f"pow(x - u, 2) + pow(y - v, 2) <= {link * link}").select(*keys, "run_id")
    gone = short.select(*keys, "run_id").join(met.unionByName(held).distinct(), [*keys, "run_id"], "left_anti")
    return runs.join(gone, [*keys, "run_id"], "left_anti")


def text_islands(parts: DataFrame, protect: DataFrame, largest: float, longest: float, aspect: float = 4.0, speck: int = 8, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Connected parts of a drawing (keys, part_id, x, y, w, h, area) that are specks or as small and compact as letters.

    A compact part whose middle lies in a box of protect is none.
    """
    rows = parts.withColumn("_speck", F.col("area") < speck)
    small = f"area <= {largest} and greatest(w, h) <= {longest} and greatest(w, h) < {aspect} * greatest(1, least(w, h))"
    rows = rows.where(f"_speck or ({small})").withColumn("mx", F.expr("x + w / 2")).withColumn("my", F.expr("y + h / 2"))
    cell = 128.0
    b = in_cells(protect.select(*keys, *_BOX), cell)
    at = rows.where("not _speck").withColumn("cx", F.floor(F.col("mx") / cell)).withColumn("cy", F.floor(F.col("my") / cell))
    held = at.join(b, [*keys, "cx", "cy"]).where("mx between x1 and x2 and my between y1 and y2").select(*keys, "part_id").distinct()
    return rows.join(held, [*keys, "part_id"], "left_anti").select(*parts.columns)
