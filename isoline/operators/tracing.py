"""Cleaning and joining of traced segments: filters as anti joins, elbows and headers per sheet, region stitching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoline.operators.spatial import cell_join, in_cells
from isoline.session import prepare

_BOX = ("x1", "y1", "x2", "y2")


def _flat(runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return runs.select(*keys, "run_id", F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"))


def _hits(runs: DataFrame, boxes: DataFrame, when: Column, pad: float, keys: tuple[str, ...], cell: float) -> DataFrame:
    """Keys of pipes that fulfil a condition with any box (columns b_x1 .. b_y2)."""
    b = in_cells(boxes.select(*keys, *_BOX), cell, pad).select(*keys, "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in _BOX))
    return cell_join(in_cells(_flat(runs, keys), cell), b, [*keys, "cx", "cy"]).where(when).select(*keys, "run_id").distinct()


def drop_box_edges(runs: DataFrame, boxes: DataFrame, margin: float, keys: tuple[str, ...] = ("sheet_id",), cell: float = 128.0) -> DataFrame:
    """Pipes that do not run along an edge of a symbol's box."""

    def along(p: str, q: str) -> Column:
        flat = F.col(f"{q}2") - F.col(f"{q}1") <= margin
        near = (F.abs(F.col(f"{q}1") - F.col(f"b_{q}1")) <= margin) | (F.abs(F.col(f"{q}1") - F.col(f"b_{q}2")) <= margin)
        return flat & near & (F.col(f"{p}1") >= F.col(f"b_{p}1") - margin) & (F.col(f"{p}2") <= F.col(f"b_{p}2") + margin)

    return runs.join(_hits(runs, boxes, along("x", "y") | along("y", "x"), margin, keys, cell), [*keys, "run_id"], "left_anti")


def drop_inside(runs: DataFrame, regions: DataFrame, pad: float, keys: tuple[str, ...] = ("sheet_id",), cell: float = 128.0) -> DataFrame:
    """Pipes that do not lie wholly within a region."""
    inside = F.expr(f"x1 >= b_x1 - {pad} and x2 <= b_x2 + {pad} and y1 >= b_y1 - {pad} and y2 <= b_y2 + {pad}")
    return runs.join(_hits(runs, regions, inside, pad, keys, cell), [*keys, "run_id"], "left_anti")


def drop_furniture(runs: DataFrame, furniture: DataFrame, keys: tuple[str, ...] = ("sheet_id",), cell: float = 128.0) -> DataFrame:
    """Pipes whose middle (between their ends) lies in no furniture box."""
    middle = F.expr("(x1 + x2) / 2 between b_x1 and b_x2 and (y1 + y2) / 2 between b_y1 and b_y2")
    return runs.join(_hits(runs, furniture, middle, 0.0, keys, cell), [*keys, "run_id"], "left_anti")


def drop_glyph_noise(runs: DataFrame, most: float, tol: float, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Pipes longer than `most`, and shorter ones of which an end meets an end of another pipe."""
    ends = runs.select(*keys, "run_id", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e")).select(*keys, "run_id", "e.x", "e.y")
    size = max(tol, 1.0)
    a = ends.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size) + 1))
    b = ends.select(*keys, F.col("run_id").alias("other"), F.col("x").alias("u"), F.col("y").alias("v")).withColumn("cx", around("u")).withColumn("cy", around("v"))
    met = cell_join(a, b, [*keys, "cx", "cy"]).where(f"run_id <> other and abs(x - u) <= {tol} and abs(y - v) <= {tol}").select(*keys, "run_id").distinct()
    long = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) > most
    return runs.where(long).unionByName(runs.where(~long).join(met, [*keys, "run_id"], "left_semi"))


#: How much longer a pipe's way must be on one axis to count as heading along it; how far beside a wall
#: (as a share of the reach) it may end; how far it may be bent across its way.
HEADING, BESIDE, BEND = 1.2, 0.5, 8


def snap_ends(runs: DataFrame, boxes: DataFrame, reach: float, keys: tuple[str, ...] = ("sheet_id",), cell: float = 128.0) -> DataFrame:
    """Pipes whose ends near an equipment wall are put onto it, on whole pixels.

    An end outside a box goes straight on to the wall that its pipe heads for, else to the nearest point of the box
    unless that bends the pipe by more than BEND across its way; an end inside goes to the nearest side (left, right,
    top, bottom). Of several boxes the nearest within reach counts, then the smaller box_id.
    """
    struct = lambda k, x, y, px, py: F.struct(F.lit(k).alias("which"), F.col(x).alias("x"), F.col(y).alias("y"), (F.col(x) - F.col(px)).alias("vx"), (F.col(y) - F.col(py)).alias("vy"))
    ends = runs.select(*keys, "run_id", F.explode(F.array(struct(1, "x1", "y1", "x2", "y2"), struct(2, "x2", "y2", "x1", "y1"))).alias("e")).select(*keys, "run_id", "e.*")
    b = in_cells(boxes.select(*keys, "box_id", *_BOX), cell, reach).select(*keys, "cx", "cy", "box_id", *(F.col(c).alias(f"b_{c}") for c in _BOX))
    at = ends.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).join(b, [*keys, "cx", "cy"])
    at = at.withColumns({"wx": F.expr("greatest(b_x1, least(x, b_x2))"), "wy": F.expr("greatest(b_y1, least(y, b_y2))"), "gap": F.expr("least(x - b_x1, b_x2 - x, y - b_y1, b_y2 - y)")})
    level, upright = f"abs(vx) >= {HEADING} * abs(vy)", f"abs(vy) >= {HEADING} * abs(vx)"
    on_x, on_y = f"y between b_y1 - {BESIDE * reach} and b_y2 + {BESIDE * reach}", f"x between b_x1 - {BESIDE * reach} and b_x2 + {BESIDE * reach}"
    to = lambda d, x, y: f"named_struct('d', double({d}), 'x', double({x}), 'y', double({y}))"
    best = f"""case
      when x between b_x1 and b_x2 and y between b_y1 and b_y2 then case gap when x - b_x1 then {to("gap", "b_x1", "y")} when b_x2 - x then {to("gap", "b_x2", "y")} when y - b_y1 then {to("gap", "x", "b_y1")} else {to("gap", "x", "b_y2")} end
      when {level} and {on_x} and vx > 0 and b_x1 - x between 0 and {reach} then {to("b_x1 - x", "b_x1", "wy")}
      when {level} and {on_x} and vx < 0 and x - b_x2 between 0 and {reach} then {to("x - b_x2", "b_x2", "wy")}
      when not ({level} and {on_x}) and {upright} and {on_y} and vy > 0 and b_y1 - y between 0 and {reach} then {to("b_y1 - y", "wx", "b_y1")}
      when not ({level} and {on_x}) and {upright} and {on_y} and vy < 0 and y - b_y2 between 0 and {reach} then {to("y - b_y2", "wx", "b_y2")}
      when ({level} and abs(y - wy) > {BEND}) or (not ({level}) and {upright} and abs(x - wx) > {BEND}) then null
      else {to("sqrt(pow(x - wx, 2) + pow(y - wy, 2))", "wx", "wy")} end"""
    at = at.withColumn("to", F.expr(best)).where(f"to.d <= {reach}")
    near = at.groupBy(*keys, "run_id", "which").agg(F.min(F.struct(F.col("to.d").alias("d"), "box_id", F.col("to.x").alias("x"), F.col("to.y").alias("y"))).alias("m"))
    out = runs
    for k in (1, 2):
        out = out.join(near.where(f"which = {k}").select(*keys, "run_id", F.bround("m.x").alias(f"_x{k}"), F.bround("m.y").alias(f"_y{k}")), [*keys, "run_id"], "left")
    kinds = dict(runs.dtypes)
    for c in ("x1", "y1", "x2", "y2"):
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}").cast(kinds[c]), F.col(c)))
    return out.drop("_x1", "_y1", "_x2", "_y2")


def merge_elbows(runs: DataFrame, tol: float, key: str = "sheet_id") -> DataFrame:
    """Pipes joined at places where exactly two ends meet: key, run_id (the smallest), points, n_runs.

    Ends within tol (on both axes) are one place, transitively; its coordinates are their mean. Branches end a pipe.
    """
    prepare(runs.sparkSession)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("run_id")
        ids = rows["run_id"].tolist()
        ends = [p for r in rows.itertuples(index=False) for p in ((r.x1, r.y1), (r.x2, r.y2))]
        up = list(range(len(ends)))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        grid: dict[tuple[int, int], list[int]] = {}
        size = max(tol, 1.0)
        for k, (x, y) in enumerate(ends):
            cx, cy = int(x // size), int(y // size)
            for n in (n for i in (-1, 0, 1) for j in (-1, 0, 1) for n in grid.get((cx + i, cy + j), ())):
                if abs(ends[n][0] - x) <= tol and abs(ends[n][1] - y) <= tol:
                    up[root(k)] = root(n)
            grid.setdefault((cx, cy), []).append(k)
        group: dict[int, list[int]] = {}
        for k in range(len(ends)):
            group.setdefault(root(k), []).append(k)
        place = {g: (sum(ends[k][0] for k in ks) / len(ks), sum(ends[k][1] for k in ks) / len(ks)) for g, ks in group.items()}
        loose = {g for g, ks in group.items() if len(ks) != 2 or ks[0] // 2 == ks[1] // 2}
        used, out = [False] * len(ids), []

        def follow(end: int) -> list[int]:
            """Ends passed from an end onwards, two per pipe, until a branch or a free end."""
            way = [end]
            while (g := root(way[-1])) not in loose:
                other = next(k for k in group[g] if k != way[-1])
                if used[other // 2]:
                    break
                used[other // 2] = True
                way += [other, other ^ 1]
            return way

        for s, run_id in enumerate(ids):
            if used[s]:
                continue
            used[s] = True
            back, on = follow(2 * s), follow(2 * s + 1)
            path = [*reversed(back[::2]), *on[::2]]
            members = {run_id, *(ids[k // 2] for k in (*back, *on))}
            out.append((frame[key].iloc[0], min(members), [list(map(float, place[root(k)])) for k in path], len(members)))
        return pd.DataFrame(out, columns=[key, "run_id", "points", "n_runs"])

    return runs.select(key, "run_id", *_BOX).groupBy(key).applyInPandas(merge, f"{key} {dict(runs.dtypes)[key]}, run_id bigint, points array<array<double>>, n_runs int")


def bridge_headers(runs: DataFrame, max_gap: int, tol: int, blocks: DataFrame | None = None, key: str = "sheet_id") -> DataFrame:
    """Straight pipes of one axis and nearly one height joined over gaps: key, axis, lo, hi, at, n_runs.

    Heights within a band of tol + 1 belong together; the height moves to the middle with every pipe that joins, which
    makes the order (start, then id) part of the result: a band's pipes are one sorted array, folded from the left. A gap
    that a box of blocks (key, x1 .. y2) crosses stays open.
    """
    flat = F.col("axis") == "H"
    lo, hi, at = (F.when(flat, F.expr(a)).otherwise(F.expr(b)) for a, b in (("least(x1, x2)", "least(y1, y2)"), ("greatest(x1, x2)", "greatest(y1, y2)"), ("y1", "x1")))
    rows = runs.select(key, "run_id", "axis", lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), at.cast("bigint").alias("at"))
    bands = rows.groupBy(key, "axis", F.floor(F.col("at") / (tol + 1)).alias("band")).agg(F.array_sort(F.collect_list(F.struct("lo", "run_id", "hi", "at"))).alias("rs"))
    none = F.array().cast("array<struct<lo:double,hi:double,from:double,to:double>>")
    if blocks is None:
        bands = bands.withColumn("stops", none)
    else:
        side = F.expr("explode(array(named_struct('axis', 'H', 'lo', double(x1), 'hi', double(x2), 'from', double(y1), 'to', double(y2)), named_struct('axis', 'V', 'lo', double(y1), 'hi', double(y2), 'from', double(x1), 'to', double(x2))))")
        held = blocks.select(key, side.alias("b")).groupBy(key, F.col("b.axis").alias("axis")).agg(F.collect_list(F.struct("b.lo", "b.hi", "b.from", "b.to")).alias("stops"))
        bands = bands.join(held, [key, "axis"], "left").withColumn("stops", F.coalesce("stops", none))
    stopped = "exists(stops, b -> l.at between b.from and b.to and l.hi < b.hi and r.lo > b.lo)"
    grown = "named_struct('lo', l.lo, 'hi', greatest(l.hi, r.hi), 'at', bigint(bround((l.at + r.at) / 2)), 'n_runs', l.n_runs + 1)"
    fresh = "named_struct('lo', r.lo, 'hi', r.hi, 'at', r.at, 'n_runs', 1)"
    step = f"get(transform(array(try_element_at(s, -1)), l -> if(l is not null and r.lo - l.hi <= {max_gap} and not {stopped}, concat(slice(s, 1, size(s) - 1), array({grown})), concat(s, array({fresh})))), 0)"
    out = bands.select(key, "axis", F.expr(f"inline(aggregate(rs, cast(array() as array<struct<lo:bigint,hi:bigint,at:bigint,n_runs:int>>), (s, r) -> {step}))"))
    return out.select(key, "axis", "lo", "hi", "at", "n_runs")


def stitch(new: DataFrame, existing: DataFrame, radius: float, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """How each newly traced pipe joins the existing ones: (keys, new_id, kind, run_a, run_b).

    extend: one end has exactly one existing end within radius; bridge: both have, of different pipes; new: neither;
    ambiguous: an end has several, or both meet the same pipe. Existing ends are counted with a grid join.
    """
    size = max(radius, 1.0)

    def ends(df: DataFrame, name: str) -> DataFrame:
        pair = F.explode(F.array(F.struct(F.lit(1).alias("which"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(2).alias("which"), F.col("x2").alias("x"), F.col("y2").alias("y"))))
        return df.select(*keys, name, pair.alias("e")).select(*keys, name, "e.*")

    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size) + 1))
    n = ends(new, "new_id").withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    old = ends(existing, "run_id").select(*keys, "run_id", F.col("x").alias("u"), F.col("y").alias("v")).withColumn("cx", around("u")).withColumn("cy", around("v"))
    near = cell_join(n, old, [*keys, "cx", "cy"]).where(f"pow(x - u, 2) + pow(y - v, 2) <= {radius * radius}")
    per = near.groupBy(*keys, "new_id", "which").agg(F.count("*").alias("c"), F.min("run_id").alias("r"))
    per = per.groupBy(*keys, "new_id").agg(*(F.max(F.when(F.col("which") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("c", "r")))
    out = new.select(*keys, "new_id").join(per, [*keys, "new_id"], "left")
    c1, c2 = (F.coalesce(c, F.lit(0)) for c in ("c1", "c2"))
    kind = F.when((c1 > 1) | (c2 > 1) | ((c1 == 1) & (c2 == 1) & (F.col("r1") == F.col("r2"))), "ambiguous").when((c1 == 1) & (c2 == 1), "bridge").when(c1 + c2 == 1, "extend").otherwise("new")
    return out.select(*keys, "new_id", kind.alias("kind"), F.when(kind.isin("extend", "bridge"), F.coalesce("r1", "r2")).alias("run_a"), F.when(kind == "bridge", F.col("r2")).alias("run_b"))


def junctions(ends: DataFrame, keys: tuple[str, ...] = ("sheet_id", "node_id")) -> DataFrame:
    """(keys, degree, kind) of junctions from the unit vectors of the pipes that leave them (arm, dx, dy).

    endpoint; straight or corner of two; tee of three whose most opposed two oppose; of four the pairing that opposes
    most decides: crossover if both its pairs oppose, partial if one does; else complex.
    """
    a = ends.groupBy(*keys).agg(F.count("*").alias("degree"), F.array_sort(F.collect_list(F.struct("arm", "dx", "dy"))).alias("v"))
    dot = lambda i, j: F.get("v", F.lit(i)).dx * F.get("v", F.lit(j)).dx + F.get("v", F.lit(i)).dy * F.get("v", F.lit(j)).dy
    pairing = F.array_min(F.array(*(F.struct((dot(*p) + dot(*q)).alias("s"), F.lit(k).alias("k"), F.greatest(dot(*p), dot(*q)).alias("hi"), F.least(dot(*p), dot(*q)).alias("lo")) for k, (p, q) in enumerate((((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))))))
    four = F.when(pairing.hi <= -0.3, "crossover").when(pairing.lo <= -0.35, "partial").otherwise("complex")
    three = F.when(F.least(dot(0, 1), dot(0, 2), dot(1, 2)) <= -0.35, "tee").otherwise("complex")
    kind = F.when(F.col("degree") == 1, "endpoint").when(F.col("degree") == 2, F.when(dot(0, 1) <= -0.7, "straight").otherwise("corner")).when(F.col("degree") == 3, three).when(F.col("degree") == 4, four)
    return a.select(*keys, "degree", F.coalesce(kind, F.lit("complex")).alias("kind"))


def renumber(runs: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Display rank of pipes after edits; keys stay, so nothing that refers to a pipe changes."""
    return runs.withColumn("run_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("run_id")) - 1)


def edit(runs: DataFrame, changes: DataFrame, fields: list[str], keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Pipes with changed fields (null leaves a field as it is) and without deleted ones.

    changes: keys, run_id, deleted, and any of the fields.
    """
    c = changes.select(*keys, "run_id", F.coalesce("deleted", F.lit(False)).alias("_gone"), *(F.col(f).alias(f"_{f}") for f in fields))
    out = runs.join(c, [*keys, "run_id"], "left").where("not coalesce(_gone, false)")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"_{f}", f))
    return out.drop("_gone", *(f"_{f}" for f in fields))
