"""Tags to pipes: the pipe under horizontal text or beside vertical text, label underlines, and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoline.functions import tags
from isoline.operators.spatial import in_cells

#: Shares of overlap and length of label underlines and covered text.
COVER, UNDERLINE_LENGTH = 0.55, 1.9


def _pairs(labels: DataFrame, runs: DataFrame, reach: float, keys: tuple[str, ...], cell: float) -> DataFrame:
    """Labels with the pipes of their own direction whose boxes come within reach, once per pair."""
    lab = labels.withColumn("axis", F.expr("if(x2 - x1 >= y2 - y1, 'H', 'V')"))
    lab = in_cells(lab, cell, reach).select(*keys, "axis", "cx", "cy", "pid_idx", *(F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")))
    flat = runs.select(*keys, "run_id", "axis", F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"))
    near = lab.join(in_cells(flat, cell), [*keys, "axis", "cx", "cy"]).drop("cx", "cy").distinct()
    # along (lo, hi) and across (c) the common direction, for text (t) and pipe
    swap = lambda a, b: F.when(F.col("axis") == "H", F.col(a)).otherwise(F.col(b))
    near = near.select("*", swap("x1", "y1").alias("lo"), swap("x2", "y2").alias("hi"), swap("y1", "x1").alias("c"), swap("tx1", "ty1").alias("tlo"), swap("tx2", "ty2").alias("thi"))
    return near.withColumn("ov", F.least("hi", "thi") - F.greatest("lo", "tlo"))


def direct(labels: DataFrame, runs: DataFrame, gap: float, pad: float, main_length: float, keys: tuple[str, ...] = ("sheet_id",), cell: float = 128.0) -> DataFrame:
    """(keys, pid_idx, run_id, cost): the pipe that a label names.

    Horizontal text names a horizontal pipe below it: within `gap` under its lower edge, or through the text, or (last)
    above its lower edge. Vertical text names a vertical pipe beside it. The pipe must pass the text's middle (give or
    take pad) or cover 55 percent of it. Pipes of main_length and more come first. labels: keys, pid_idx, box.
    """
    near = _pairs(labels, runs, gap + pad, keys, cell)
    middle = (F.col("tlo") + F.col("thi")) / 2
    shades = ((F.col("lo") - pad <= middle) & (middle <= F.col("hi") + pad)) | (F.col("ov") >= COVER * F.greatest(F.lit(1.0), F.col("thi") - F.col("tlo")))
    d, tall = F.col("c") - F.col("ty2"), F.col("ty2") - F.col("ty1")
    under = F.when(d >= 0, d).when(d >= -tall, -d).otherwise(-d * 3.0 + 500.0)
    beside = F.abs(F.col("c") - (F.col("tx1") + F.col("tx2")) / 2)
    flat = F.col("axis") == "H"
    fits = shades & F.when(flat, (F.col("c") >= F.col("ty1") - pad) & (d <= gap)).otherwise(beside <= gap)
    cost = F.when(flat, under).otherwise(beside).cast("double")
    best = F.min(F.struct((F.col("hi") - F.col("lo") < main_length).alias("stub"), cost.alias("cost"), F.col("run_id"))).alias("m")
    return near.where(fits).groupBy(*keys, "pid_idx").agg(best).select(*keys, "pid_idx", "m.run_id", "m.cost")


def underlines(labels: DataFrame, runs: DataFrame, near_lo: float, near_hi: float, keys: tuple[str, ...] = ("sheet_id",), cell: float = 128.0) -> DataFrame:
    """(keys, pid_idx, run_id) of short lines drawn under (beside) a label: no pipes, but where leaders start."""
    near = _pairs(labels, runs, near_lo + near_hi, keys, cell).where("thi > tlo")
    edge = lambda low, high: (F.col("c") >= low) & (F.col("c") <= high)
    flat = edge(F.col("ty2") - near_lo, F.col("ty2") + near_hi)
    side = edge(F.col("tx1") - near_hi, F.col("tx1") + near_lo) | edge(F.col("tx2") - near_lo, F.col("tx2") + near_hi)
    # whole multiples: a share as a binary fraction would miss lines of just that share (0.55 * 100 > 55)
    covers = F.col("ov") * 100 >= (F.col("hi") - F.col("lo")) * round(COVER * 100)
    short = (F.col("hi") - F.col("lo")) * 10 <= (F.col("thi") - F.col("tlo")) * round(UNDERLINE_LENGTH * 10)
    hit = F.when(F.col("axis") == "H", flat).otherwise(side) & (F.col("ov") > 0) & covers
    return near.where(hit & short).select(*keys, "pid_idx", "run_id")


def resolve(labels: DataFrame, picks: DataFrame, leaders: DataFrame, key: str = "sheet_id", rounds: int = 3) -> DataFrame:
    """(key, pid_idx, run_id, state): labels with their pipe, no pipe claimed by two different tags.

    labels: key, pid_idx, pid. picks: what `direct` found. leaders: key, pid_idx, run_id, score, candidates along
    pointer lines, whose ink the caller has measured. A label without pick takes its best leader. In each round the
    claims of every pipe are ranked: where tags differ, the nearest label (then the first) keeps the pipe, and the others
    are served in order of the pipe's first claim, then their own: each takes its best leader to a pipe that is free at
    the time, else none.
    """
    lines = leaders.groupBy(key, "pid_idx").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("run_id").alias("r")))).alias("lines"))
    lines = lines.select(key, "pid_idx", F.transform("lines", lambda x: x.r).alias("lines"))
    rows = labels.select(key, "pid_idx", "pid").join(picks.select(key, "pid_idx", "run_id", "cost"), [key, "pid_idx"], "left").join(lines, [key, "pid_idx"], "left")
    led = F.get("lines", F.lit(0))
    state = F.when(F.col("run_id").isNotNull(), "attached").when(led.isNotNull(), "leader").otherwise("none")
    rows = rows.select(key, "pid_idx", "pid", "lines", F.coalesce("run_id", led).alias("run_id"), F.when(F.col("run_id").isNotNull(), F.col("cost")).alias("cost"), state.alias("state"))
    claim = Window.partitionBy(key, "run_id")
    for _ in range(rounds):
        rank = F.row_number().over(claim.orderBy(F.col("cost").asc_nulls_last(), "pid_idx"))
        fought = F.col("run_id").isNotNull() & (F.min("pid").over(claim) != F.max("pid").over(claim))
        rows = rows.withColumn("lost", fought & (rank > 1)).withColumn("turn", F.min("pid_idx").over(claim))
        sheet = rows.groupBy(key).agg(F.collect_set("run_id").alias("used"), F.array_sort(F.collect_list(F.when(F.col("lost"), F.struct("turn", "pid_idx", "lines")))).alias("losers")).where("size(losers) > 0")
        free = "get(filter(l.lines, x -> not array_contains(s.used, x)), 0)"
        step = f"get(transform(array({free}), f -> named_struct('used', if(f is null, s.used, concat(s.used, array(f))), 'got', concat(s.got, array(named_struct('pid_idx', l.pid_idx, 'new', f))))), 0)"
        start = "named_struct('used', used, 'got', cast(array() as array<struct<pid_idx:bigint,new:bigint>>))"
        moved = sheet.select(key, F.expr(f"inline(aggregate(losers, {start}, (s, l) -> {step}).got)"))
        rows = rows.join(moved, [key, "pid_idx"], "left")
        pick = lambda new, old: F.when(F.col("lost"), new).otherwise(old)
        rows = rows.select(key, "pid_idx", "pid", "lines", pick(F.col("new"), F.col("run_id")).alias("run_id"), pick(F.lit(None), F.col("cost")).alias("cost"), pick(F.when(F.col("new").isNotNull(), "leader").otherwise("none"), F.col("state")).alias("state"))
    return rows.select(key, "pid_idx", "run_id", "state")


def two_line_pairs(fragments: DataFrame, keys: tuple[str, ...] = ("sheet_id",), cell: float = 96.0) -> DataFrame:
    """(keys, upper, lower, text): fragments stacked as the two lines of one label.

    The gap is -0.6 to 1.8 text heights, and they share 40 percent of the narrower one. fragments: keys, frag_id, text,
    box. Text is joined with a dash, for the caller to match.
    """
    # every fragment reaches up and down by twice its own height, so the taller one of a pair reaches the other
    tall = F.expr("2 * greatest(y2 - y1, 1)")
    f = in_cells(fragments.withColumn("_lo", F.col("y1") - tall).withColumn("_hi", F.col("y2") + tall), cell, 0.0, ("x1", "_lo", "x2", "_hi"))
    a, b = (f.select(*keys, "cx", "cy", *(F.col(c).alias(f"{p}_{c}") for c in ("frag_id", "text", "x1", "y1", "x2", "y2"))) for p in "ab")
    h = "greatest(a_y2 - a_y1, b_y2 - b_y1, 1)"
    near = a.join(b, [*keys, "cx", "cy"]).where(f"a_frag_id <> b_frag_id and b_y1 - a_y2 >= -0.6 * {h} and b_y1 - a_y2 <= 1.8 * {h} and least(a_x2, b_x2) - greatest(a_x1, b_x1) >= 0.4 * least(a_x2 - a_x1, b_x2 - b_x1)")
    return near.select(*keys, F.col("a_frag_id").alias("upper"), F.col("b_frag_id").alias("lower"), F.concat("a_text", F.lit("-"), "b_text").alias("text")).distinct()


def tags_of_pairs(pairs: DataFrame, schemas: tuple[tags.Schema, ...] = tags.SCHEMAS) -> DataFrame:
    """Pairs of fragments whose joined text a schema fits, with the tag and its weight; other pairs are two texts."""
    found = pairs.withColumn("_m", tags.match(tags.normalise(F.col("text")), schemas)).where("_m.weight > 1")
    return found.select(*pairs.columns, F.col("_m.pid").alias("pid"), F.col("_m.weight").alias("weight"))
