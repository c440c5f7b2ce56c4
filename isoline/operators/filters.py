"""Filters on rows, arrays of points and merges that keep what people have edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoline.functions import geometry as g
from isoline.operators.spatial import in_cells


def contains_text(rows: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows of which any field contains the query, without regard to case; an empty query keeps all."""
    hit: Column = F.lit(not query)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(f).cast("string")), F.lit(query.lower())), F.lit(False))
    return rows.where(hit)


def is_manual(cls: str = "cls", manual: str = "manual") -> Column:
    """A symbol that a person added or moved."""
    name = F.lower(F.coalesce(F.col(cls), F.lit("")))
    return F.coalesce(F.col(manual), F.lit(False)) | name.contains("manual") | name.contains("box")


def backfill_marked(runs: DataFrame) -> DataFrame:
    """marked from manual where it was never set."""
    return runs.withColumn("marked", F.coalesce("marked", "manual", F.lit(False)))


def keep_manual(new: DataFrame, old: DataFrame, iou: float = 0.45, keys: tuple[str, ...] = ("sheet_id",), cell: float = 128.0) -> DataFrame:
    """New symbols, and the manual old ones that overlap none of the new by `iou` or more."""
    box = ("x1", "y1", "x2", "y2")
    manual = old.where(is_manual())
    n = in_cells(new.select(*keys, *box), cell).select(*keys, "cx", "cy", *(F.col(c).alias(f"n_{c}") for c in box))
    o = in_cells(manual.select(*keys, "box_id", *box), cell).select(*keys, "cx", "cy", "box_id", *(F.col(c).alias(f"o_{c}") for c in box))
    touch = F.expr("o_x1 < n_x2 and n_x1 < o_x2 and o_y1 < n_y2 and n_y1 < o_y2")
    hit = o.join(n, [*keys, "cx", "cy"]).where(touch & (g.iou("o_", "n_") >= iou)).select(*keys, "box_id").distinct()
    return new.unionByName(manual.join(hit, [*keys, "box_id"], "left_anti").select(*old.columns), allowMissingColumns=True)


def prefer_manual(new: DataFrame, old: DataFrame, reach: float = 30.0, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Manual old symbols, and the new ones that none of them of the same class starts nearer to than reach on both axes."""
    manual = old.where("manual")
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / reach) - 1, F.floor(F.col(c) / reach) + 1))
    m = manual.select(*keys, "cls", F.col("x1").alias("_x"), F.col("y1").alias("_y")).withColumn("cx", around("_x")).withColumn("cy", around("_y"))
    at = new.withColumn("cx", F.floor(F.col("x1") / reach)).withColumn("cy", F.floor(F.col("y1") / reach))
    near = F.expr(f"abs(x1 - _x) < {reach} and abs(y1 - _y) < {reach}")
    on = [at[c].eqNullSafe(m[c]) if c == "cls" else at[c] == m[c] for c in (*keys, "cls", "cx", "cy")]
    return manual.unionByName(at.join(m, [*on, near], "left_anti").drop("cx", "cy"), allowMissingColumns=True)


def may_enrich(runs: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Sheets on which a person has marked a pipe: only those may be enriched."""
    return runs.where("marked").select(*keys).distinct()


def merge_enrichment(current: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Names found anew reach only marked pipes without a label of their own, and fluids only marked pipes without one.

    current: keys, run_id, marked, label, pid and, if fluids are to be filled, fluid; found: keys, run_id, pid, fluid.
    """
    fluids = "fluid" in current.columns and "fluid" in found.columns
    new = found.select(*keys, "run_id", F.nullif("pid", F.lit("")).alias("_pid"), *([F.nullif("fluid", F.lit("")).alias("_fluid")] if fluids else []))
    rows = current.join(new, [*keys, "run_id"], "left")
    marked = F.coalesce("marked", F.lit(False))
    named = marked & (F.coalesce("label", F.lit("")) == "") & F.col("_pid").isNotNull()
    rows = rows.withColumn("pid", F.when(named, F.col("_pid")).otherwise(F.col("pid"))).withColumn("label", F.when(named, F.col("_pid")).otherwise(F.col("label")))
    if fluids:
        rows = rows.withColumn("fluid", F.when(marked & (F.coalesce("fluid", F.lit("")) == "") & F.col("_fluid").isNotNull(), F.col("_fluid")).otherwise(F.col("fluid")))
    return rows.drop("_pid", "_fluid")


def add_tags(current: DataFrame, found: DataFrame, runs: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Tags, and those found anew on marked pipes whose name, without regard to case, the sheet does not have; of equal
    names the one with the smallest pid_idx."""
    name = F.lower(F.trim(F.coalesce("pid", F.lit(""))))
    known = current.select(*keys, name.alias("_name")).distinct()
    fresh = found.join(runs.where("marked").select(*keys, "run_id"), [*keys, "run_id"], "left_semi").withColumn("_name", name).where("_name <> ''")
    fresh = fresh.join(known, [*keys, "_name"], "left_anti")
    first = Window.partitionBy(*keys, "_name").orderBy("pid_idx")
    fresh = fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_name")
    return current.unionByName(fresh.select(*current.columns))


def margin_runs(runs: DataFrame, w: float, h: float, ratio: float = 0.02) -> DataFrame:
    """Pipes that do not lie wholly within a page margin."""
    box = g.bbox(F.col("points"))
    rows = runs.withColumn("_b", box)
    inside = F.expr(f"_b.x2 < {w * ratio} or _b.x1 > {w * (1 - ratio)} or _b.y2 < {h * ratio} or _b.y1 > {h * (1 - ratio)}")
    return rows.where(~inside).drop("_b")


def furniture_free(runs: DataFrame, w: float, h: float) -> DataFrame:
    """Straight pipes that are no frame or title block by their place."""
    size = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    return runs.where(~g.is_furniture(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), size, w, h))


def tier(pages: DataFrame) -> DataFrame:
    """Reading tier of a page by its paths: raster under 50, A1 if 50 contain a line, else A2.

    pages: page_id, has_line; one row per path.
    """
    n = pages.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("has_line").alias("lines"))
    return n.select("page_id", F.when(F.col("n") < 50, "raster").when(F.col("lines") >= 50, "A1").otherwise("A2").alias("tier"))
