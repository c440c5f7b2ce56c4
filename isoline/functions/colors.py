"""Colours of fluids: the palette, distances, shades, and the choice of a free colour far from those in use."""

from __future__ import annotations

import colorsys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first colours of the palette, and of pipes without a fluid.
PALETTE = (
    (230, 25, 75), (60, 180, 75), (0, 130, 200), (245, 130, 48), (145, 30, 180),
    (0, 158, 158), (240, 50, 230), (128, 128, 0), (70, 130, 180), (170, 110, 40),
    (188, 20, 90), (0, 100, 60), (85, 85, 200), (210, 160, 0), (100, 60, 140),
)
NEUTRAL = (150, 160, 175)
#: Strong colours that a fluid may be given when the palette is crowded.
STRONG = (
    (150, 20, 160), (130, 40, 210), (200, 20, 120), (230, 90, 160), (255, 120, 0),
    (0, 90, 200), (170, 60, 30), (0, 140, 190), (190, 0, 0), (110, 90, 0),
)
#: Hue of the first colour beyond the list and the step from one to the next; saturation and brightness
#: and how they alternate; the distance below which two colours look alike, and how much more is plenty.
HUE, HUE_STEP = 0.083, 0.6180339887
SATURATION, VALUE = (0.90, 0.18, 3), (0.78, 0.16, 2)
ALIKE, PLENTY = 95.0, 1.5
#: Colours that are looked at when a free one is chosen.
TRIED = 400


def palette(n: int = TRIED) -> list[tuple[int, int, int]]:
    """The first n colours: the list, then hues a golden section apart."""
    made = []
    for k in range(n - len(PALETTE)):
        s = SATURATION[0] - SATURATION[1] * (k % SATURATION[2])
        v = VALUE[0] - VALUE[1] * (k // 3 % VALUE[2])
        made.append(tuple(int(c * 255) for c in colorsys.hsv_to_rgb((HUE + k * HUE_STEP) % 1.0, s, v)))
    return [*PALETTE[:n], *made]


def rgb(color: tuple[int, int, int]) -> Column:
    """A colour as an array."""
    return F.array(*(F.lit(int(c)) for c in color))


def hex_to_rgb(color: Column) -> Column:
    """#rrggbb as an array of three numbers; null for anything else."""
    part = lambda k: F.conv(F.substring(color, k, 2), 16, 10).cast("int")
    return F.when(color.rlike("^#[0-9A-Fa-f]{6}$"), F.array(part(2), part(4), part(6)))


def shade(color: Column, f: float) -> Column:
    """A colour moved towards white (f > 0) or black, each channel cut to a whole number."""
    move = (lambda c: (c + (255 - c) * f).cast("int")) if f >= 0 else (lambda c: (c * (1 + f)).cast("int"))
    return F.transform(color, move)


def distance(a: Column, b: Column) -> Column:
    """Distance of two colours weighted by how red they are."""
    red = (a[0] + b[0]) / 2
    d = [F.pow((a[k] - b[k]).cast("double"), 2.0) for k in range(3)]
    return F.sqrt((2 + red / 256) * d[0] + 4 * d[1] + (2 + (255 - red) / 256) * d[2])


def nearest_used(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Add the distance of each candidate's colour from the nearest one in use (null if none is).

    candidates: n, color; used: color. Both are dimensions: a few hundred colours, a few dozen fluids.
    """
    held = used.agg(F.collect_list("color").alias("_used"))
    rows = candidates.join(held, F.lit(True))
    return rows.withColumn("away", F.array_min(F.transform("_used", lambda u: distance(F.col("color"), u)))).drop("_used")


def choose(fluids: DataFrame, known: DataFrame, tried: int = TRIED) -> DataFrame:
    """(fluid, n): palette numbers of all fluids; a known fluid keeps its own.

    New fluids are served in order of `place`: each takes the first free number whose colour is plenty away from all in
    use, or the one furthest from them. fluids: fluid, place; known: fluid, n. The dimension is folded as one row.
    """
    spark = fluids.sparkSession
    table = spark.range(1).select(F.array(*(rgb(c) for c in palette(tried))).alias("pal"))
    old = known.agg(F.coalesce(F.array_sort(F.collect_list(F.struct("n", "fluid"))), F.array().cast("array<struct<n:int,fluid:string>>")).alias("old"))
    new = fluids.where("fluid <> ''").join(known, "fluid", "left_anti").groupBy("fluid").agg(F.min("place").alias("place"))
    new = new.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "fluid"))), lambda x: x.fluid).alias("new"))
    row = table.join(old, F.lit(True)).join(new, F.lit(True))
    away = "array_min(transform(used, u -> {0}))".format(_SQL_DISTANCE.format(a="get(pal, k)", b="get(pal, u.n)"))
    free = f"""transform(filter(sequence(0, {tried - 1}), k -> not exists(used, u -> u.n = k)), k -> named_struct('k', k, 'away', coalesce({away}, 1e9)))"""
    pick = f"coalesce(get(filter(free, c -> c.away >= {ALIKE * PLENTY}), 0), get(filter(free, c -> c.away = array_max(transform(free, x -> x.away))), 0)).k"
    # one fluid after the other; `get(transform(array(x), ...), 0)` names a value that is used more than once
    step = f"concat(used, array(named_struct('n', get(transform(array({free}), free -> {pick}), 0), 'fluid', fluid)))"
    out = row.select(F.expr(f"explode(aggregate(new, transform(old, o -> named_struct('n', int(o.n), 'fluid', o.fluid)), (used, fluid) -> {step}))").alias("c"))
    return out.select("c.fluid", "c.n")


_SQL_DISTANCE = "sqrt((2 + ({a}[0] + {b}[0]) / 2 / 256) * pow({a}[0] - {b}[0], 2) + 4 * pow({a}[1] - {b}[1], 2) + (2 + (255 - ({a}[0] + {b}[0]) / 2) / 256) * pow({a}[2] - {b}[2], 2))"


def recolour(fluid: str, known: DataFrame, tried: int = TRIED) -> DataFrame:
    """(n, color): the colour that a fluid moves to when it looks like another: the palette's choice as for a new fluid
    among the others, or the strong colour furthest from them if it is further away (n is then null)."""
    spark = known.sparkSession
    others = known.where(F.col("fluid") != fluid)
    number = choose(spark.createDataFrame([(fluid, 0)], "fluid string, place int"), others, tried).where(F.col("fluid") == fluid).select("n")
    table = spark.createDataFrame(list(enumerate(map(list, palette(tried)))), "n int, color array<int>")
    used = others.join(table, "n").select("color")
    strong = spark.createDataFrame([(k, list(c)) for k, c in enumerate(STRONG, 1)], "place int, color array<int>")
    rows = table.join(number, "n").select("n", F.lit(0).alias("place"), "color").unionByName(strong.select(F.lit(None).cast("int").alias("n"), "place", "color"))
    best = nearest_used(rows, used).agg(F.max_by(F.struct("n", "color"), F.struct(F.coalesce("away", F.lit(1e9)).alias("away"), (-F.col("place")).alias("place"))).alias("b"))
    return best.select("b.*")
