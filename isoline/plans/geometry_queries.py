"""Queries on geometry expressions and spatial joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.functions import geometry as g
from isoline.operators import filters, spatial
from isoline.plans.derive import derived, with_

W, H, TOL = 1900.0, 1400.0, 6.0


def _seg(px: str, py: str, r: str) -> str:
    """SQL for the distance of a point from an axis-parallel segment r."""
    return f"sqrt(pow(greatest({r}.x1 - {px}, {px} - {r}.x2, 0), 2) + pow(greatest({r}.y1 - {py}, {py} - {r}.y2, 0), 2))"


def run_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, box, axis and middle of three-point pipes."""
    r = derived(spark, sf_dir, "d_runs")
    points = F.array(F.array("x1", "y1"), F.array("x2", "y2"), F.array(F.expr("x2 + 30"), F.expr("y2 + 40")))
    box, mid = g.bbox(points), g.midpoint(points)
    return r.select("run_id", F.bround(g.length(points), 6).alias("length"), box.x1.alias("bx1"), box.y1.alias("by1"), box.x2.alias("bx2"), box.y2.alias("by2"), g.axis(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("ax"), F.bround(mid.x, 6).alias("mx"), F.bround(mid.y, 6).alias("my"))


RUN_GEOMETRY = f"""{with_('d_runs')}, l AS (SELECT *, greatest(x2 - x1, y2 - y1) AS n FROM d_runs), m AS (SELECT *, (n + 50.0::double) / 2 AS half FROM l)
SELECT run_id, cast(n + 50 AS double) AS length, x1 AS bx1, y1 AS by1, x2 + 30 AS bx2, y2 + 40 AS by2, CASE WHEN x2 - x1 >= y2 - y1 THEN 'H' ELSE 'V' END AS ax,
  round_even(CASE WHEN half <= n THEN x1 + half / n * (x2 - x1) ELSE x2 + (half - n) / 50 * 30 END, 6) AS mx, round_even(CASE WHEN half <= n THEN y1 + half / n * (y2 - y1) ELSE y2 + (half - n) / 50 * 40 END, 6) AS my FROM m"""


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes that touch, or that a bend, a short gap or an in-line symbol parts, but no equipment."""
    return spatial.adjacency(derived(spark, sf_dir, "d_runs"), TOL, bridge=60.0, corner=20.0, noise=24.0, symbols=derived(spark, sf_dir, "d_boxes"))


_ADJACENCY = f"""WITH pend AS (SELECT sheet_id, run_id, axis, x1 AS x, y1 AS y FROM d_runs UNION ALL SELECT sheet_id, run_id, axis, x2, y2 FROM d_runs),
touch AS (SELECT p.sheet_id, least(p.run_id, r.run_id) AS a, greatest(p.run_id, r.run_id) AS b FROM pend p JOIN d_runs r ON p.sheet_id = r.sheet_id AND p.run_id <> r.run_id AND {_seg('p.x', 'p.y', 'r')} <= {TOL}),
gap AS (SELECT p.sheet_id, p.run_id AS a, q.run_id AS b, (p.x + q.x) / 2 AS mx, (p.y + q.y) / 2 AS my, abs(p.x - q.x) AS dx, abs(p.y - q.y) AS dy, p.axis <> q.axis AS bend FROM pend p JOIN pend q ON p.sheet_id = q.sheet_id AND p.run_id < q.run_id AND abs(p.x - q.x) <= 60 AND abs(p.y - q.y) <= 60),
link AS (SELECT sheet_id, a, b FROM gap g WHERE ((bend AND dx * dx + dy * dy <= 400) OR (least(dx, dy) <= {TOL} AND greatest(dx, dy) <= 60 AND (greatest(dx, dy) <= 24 OR EXISTS (SELECT 1 FROM d_boxes s WHERE s.sheet_id = g.sheet_id AND s.coarse <> 'equipment' AND mx BETWEEN s.x1 - 4 AND s.x2 + 4 AND my BETWEEN s.y1 - 4 AND s.y2 + 4))))
  AND NOT EXISTS (SELECT 1 FROM d_boxes s WHERE s.sheet_id = g.sheet_id AND s.coarse = 'equipment' AND mx BETWEEN s.x1 + 4 AND s.x2 - 4 AND my BETWEEN s.y1 + 4 AND s.y2 - 4))
SELECT sheet_id, a, b FROM touch UNION SELECT sheet_id, a, b FROM link"""
ADJACENCY = f"{with_('d_runs', 'd_boxes')} SELECT * FROM ({_ADJACENCY})"


def nearest_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest pipe of every point within 40 pixels."""
    return spatial.nearest_run(derived(spark, sf_dir, "d_points"), derived(spark, sf_dir, "d_runs"), 40.0).select("sheet_id", "point_id", "run_id", F.bround("distance", 6).alias("distance"))


NEAREST_PIPE = f"""{with_('d_points', 'd_runs')}, d AS (SELECT p.sheet_id, point_id, run_id, {_seg('p.x', 'p.y', 'r')} AS distance, greatest(x2 - x1, y2 - y1) AS n FROM d_points p JOIN d_runs r ON p.sheet_id = r.sheet_id)
SELECT sheet_id, point_id, run_id, round_even(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, n DESC, run_id) AS k FROM d WHERE distance <= 40) WHERE k = 1"""


def snap_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class codes put on pipes, their own axis preferred."""
    points = derived(spark, sf_dir, "d_points").withColumn("orient", F.expr("if(point_id % 8 < 3, 'H', 'V')"))
    return spatial.nearest_run(points, derived(spark, sf_dir, "d_runs"), 107.0, prefer_axis="orient").select("sheet_id", "point_id", "run_id", F.bround("distance", 6).alias("distance"))


SNAP_CODES = f"""{with_('d_points', 'd_runs')}, d AS (SELECT p.sheet_id, point_id, run_id, {_seg('p.x', 'p.y', 'r')} AS distance, greatest(x2 - x1, y2 - y1) AS n, axis = CASE WHEN point_id % 8 < 3 THEN 'H' ELSE 'V' END AS same FROM d_points p JOIN d_runs r ON p.sheet_id = r.sheet_id)
SELECT sheet_id, point_id, run_id, round_even(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance * CASE WHEN same THEN 0.6 ELSE 1.0 END, n DESC, run_id) AS k FROM d WHERE distance <= 107) WHERE k = 1"""


def end_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts around pipe ends in reading order."""
    tokens = derived(spark, sf_dir, "d_points").select("sheet_id", "x", "y", F.concat(F.lit("T"), F.col("point_id").cast("string")).alias("text"))
    return spatial.tokens_near(derived(spark, sf_dir, "d_runs").select("sheet_id", "run_id", F.col("x2").alias("x"), F.col("y2").alias("y")), tokens, 180.0)


END_TEXTS = f"""{with_('d_points', 'd_runs')}
SELECT r.sheet_id, run_id, string_agg('T' || cast(point_id AS varchar), ' ' ORDER BY p.y, p.x, 'T' || cast(point_id AS varchar)) AS text FROM d_runs r JOIN d_points p ON r.sheet_id = p.sheet_id AND pow(p.x - r.x2, 2) + pow(p.y - r.y2, 2) <= 32400 GROUP BY ALL"""


def duplicate_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted parts of pipes that lie on an existing pipe."""
    runs = derived(spark, sf_dir, "d_runs")
    cand = runs.select("sheet_id", F.col("run_id").alias("cand_id"), *(F.expr(f"{c} + run_id % 7").alias(c) for c in ("x1", "y1", "x2", "y2")))
    return spatial.duplicate_runs(cand, runs, 4.0).select("sheet_id", "cand_id")


DUPLICATE_PIPES = f"""{with_('d_runs')}, c AS (SELECT sheet_id, run_id AS cand_id, x1 + run_id % 7 AS x1, y1 + run_id % 7 AS y1, x2 + run_id % 7 AS x2, y2 + run_id % 7 AS y2 FROM d_runs)
SELECT DISTINCT c.sheet_id, cand_id FROM c JOIN d_runs r ON c.sheet_id = r.sheet_id AND {_seg('c.x1', 'c.y1', 'r')} <= 4 AND {_seg('c.x2', 'c.y2', 'r')} <= 4"""


def points_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in no equipment box."""
    boxes = derived(spark, sf_dir, "d_boxes").where("coarse = 'equipment'").select("sheet_id", "x1", "y1", "x2", "y2")
    return spatial.outside_boxes(derived(spark, sf_dir, "d_points"), boxes).select("sheet_id", "point_id")


POINTS_OUTSIDE = f"{with_('d_points', 'd_boxes')} SELECT sheet_id, point_id FROM d_points p WHERE NOT EXISTS (SELECT 1 FROM d_boxes b WHERE b.coarse = 'equipment' AND b.sheet_id = p.sheet_id AND p.x BETWEEN b.x1 AND b.x2 AND p.y BETWEEN b.y1 AND b.y2)"


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal pieces of one height joined over gaps up to 12."""
    rows = derived(spark, sf_dir, "d_runs").where("axis = 'H'").select("sheet_id", F.expr("y1 div 100").alias("band"), "x1", "x2")
    return spatial.merge_intervals(rows, ("sheet_id", "band"), "x1", "x2", 12)


INTERVAL_MERGE = f"""{with_('d_runs')}, r AS (SELECT sheet_id, y1 // 100 AS band, x1, x2 FROM d_runs WHERE axis = 'H'), m AS (SELECT *, max(x2) OVER (PARTITION BY sheet_id, band ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR x1 > b + 12 THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id, band ORDER BY x1, x2 ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT sheet_id, band, min(x1) AS lo, max(x2) AS hi, count(*) AS n FROM i GROUP BY sheet_id, band, k"""


def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What equipment leaves of horizontal pipes, by bands."""
    base = derived(spark, sf_dir, "d_runs").where("axis = 'H'").select("sheet_id", F.expr("y1 div 300").alias("band"), F.col("run_id").alias("id"), F.col("x1").alias("lo"), F.col("x2").alias("hi"))
    holes = derived(spark, sf_dir, "d_boxes").where("coarse = 'equipment'").select("sheet_id", F.expr("y1 div 300").alias("band"), F.col("x1").alias("h_lo"), F.col("x2").alias("h_hi"))
    return spatial.subtract_intervals(base, holes, ("sheet_id", "band")).groupBy("sheet_id", "id").agg(F.count("*").alias("n"), F.sum(F.expr("hi - lo")).alias("left_over"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


INTERVAL_SUBTRACT = f"""{with_('d_runs', 'd_boxes')}, b AS (SELECT sheet_id, y1 // 300 AS band, run_id AS id, x1 AS lo, x2 AS hi FROM d_runs WHERE axis = 'H'), u AS (SELECT id, sheet_id, band, unnest(range(lo, hi)) AS x FROM b),
h AS (SELECT sheet_id, y1 // 300 AS band, x1 AS h_lo, x2 AS h_hi FROM d_boxes WHERE coarse = 'equipment'),
f AS (SELECT u.sheet_id, id, x FROM u WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sheet_id = u.sheet_id AND h.band = u.band AND x >= h_lo AND x < h_hi)), g AS (SELECT *, x - row_number() OVER (PARTITION BY id ORDER BY x) AS k FROM f)
SELECT sheet_id, id, count(DISTINCT k) AS n, count(*) AS left_over, min(x) AS lo, max(x) + 1 AS hi FROM g GROUP BY ALL"""


def tee_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes cut where a branch ends on them."""
    out = spatial.split_at_tees(derived(spark, sf_dir, "d_runs"), TOL, 8)
    return out.groupBy("sheet_id", "run_id").agg(F.count("*").alias("n_pieces"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.expr("hi - lo")).alias("longest"))


TEE_SPLIT = f"""{with_('d_runs')}, f AS (SELECT sheet_id, run_id, axis, CASE WHEN axis = 'H' THEN x1 ELSE y1 END AS lo, CASE WHEN axis = 'H' THEN x2 ELSE y2 END AS hi, CASE WHEN axis = 'H' THEN y1 ELSE x1 END AS v FROM d_runs),
cuts AS (SELECT run_id, pos, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS k FROM (SELECT DISTINCT r.run_id, b.v AS pos FROM f r JOIN f b ON r.sheet_id = b.sheet_id AND r.axis <> b.axis AND (abs(b.lo - r.v) <= {TOL} OR abs(b.hi - r.v) <= {TOL}) AND b.v > r.lo + 8 AND b.v < r.hi - 8)),
walk AS (SELECT run_id, k, pos AS last, [pos] AS kept FROM cuts WHERE k = 1 UNION ALL SELECT c.run_id, c.k, CASE WHEN c.pos - w.last >= 8 THEN c.pos ELSE w.last END, CASE WHEN c.pos - w.last >= 8 THEN list_append(w.kept, c.pos) ELSE w.kept END FROM walk w JOIN cuts c ON c.run_id = w.run_id AND c.k = w.k + 1),
last AS (SELECT run_id, arg_max(kept, k) AS kept FROM walk GROUP BY 1), stops AS (SELECT sheet_id, f.run_id, lo, hi, unnest(list_concat(list_concat([lo], coalesce(kept, [])), [hi])) AS p FROM f LEFT JOIN last USING (run_id)),
pieces AS (SELECT *, lead(p) OVER (PARTITION BY run_id ORDER BY p) - p AS n FROM stops)
SELECT sheet_id, run_id, count(n) AS n_pieces, any_value(lo) AS lo, any_value(hi) AS hi, max(n) AS longest FROM pieces GROUP BY ALL"""


def furniture_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes that are no frame or title block."""
    return filters.furniture_free(derived(spark, sf_dir, "d_runs"), 1600.0, 1100.0).select("sheet_id", "run_id")


FURNITURE_FREE = f"{with_('d_runs')} SELECT sheet_id, run_id FROM d_runs WHERE NOT (greatest(x2 - x1, y2 - y1) > 1280 OR (y1 + y2) / 2 > 0.849 * 1100 OR (y1 + y2) / 2 < 0.026 * 1100 OR (x1 + x2) / 2 < 0.024 * 1600 OR (x1 + x2) / 2 > 0.977 * 1600)"


def terminal_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe ends in the page margin and the edge that they face."""
    ends = derived(spark, sf_dir, "d_runs").select("sheet_id", "run_id", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(1).alias("which"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e")).select("sheet_id", "run_id", "e.*")
    return ends.withColumn("edge", g.page_edge(F.col("x"), F.col("y"), W, H)).where("edge is not null")


TERMINAL_ENDS = f"""{with_('d_runs')}, e AS (SELECT sheet_id, run_id, 0 AS which, x1 AS x, y1 AS y FROM d_runs UNION ALL SELECT sheet_id, run_id, 1, x2, y2 FROM d_runs)
SELECT *, CASE WHEN x <= {W} * 0.18::double THEN 'left' WHEN x >= {W} * (1 - 0.18::double) THEN 'right' WHEN y <= {H} * 0.18::double THEN 'top' ELSE 'bottom' END AS edge FROM e WHERE x <= {W} * 0.18::double OR x >= {W} * (1 - 0.18::double) OR y <= {H} * 0.18::double OR y >= {H} * (1 - 0.18::double)"""


def manual_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual symbols of an earlier run that the new run does not cover."""
    b = derived(spark, sf_dir, "d_boxes")
    old = b.where("box_id % 5 = 0").withColumn("cls", F.when(F.col("box_id") % 2 == 0, "manual_box").otherwise("valve")).withColumn("manual", F.col("box_id") % 15 == 0)
    return filters.keep_manual(b.where("box_id % 5 <> 0"), old).select("sheet_id", "box_id")


MANUAL_SYMBOLS = f"""{with_('d_boxes')}, n AS (SELECT * FROM d_boxes WHERE box_id % 5 <> 0), o AS (SELECT * FROM d_boxes WHERE box_id % 10 = 0 OR box_id % 15 = 0)
SELECT sheet_id, box_id FROM n UNION ALL SELECT sheet_id, box_id FROM o WHERE NOT EXISTS (SELECT 1 FROM (SELECT n.*, greatest(0, least(o.x2, n.x2) - greatest(o.x1, n.x1)) * greatest(0, least(o.y2, n.y2) - greatest(o.y1, n.y1)) AS i FROM n WHERE n.sheet_id = o.sheet_id) q WHERE i::double / ((o.x2 - o.x1) * (o.y2 - o.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) - i) >= 0.45)"""

QUERIES = {f.__name__: f for f in (run_geometry, adjacency, nearest_pipe, snap_codes, end_texts, duplicate_pipes, points_outside, interval_merge, interval_subtract, tee_split, furniture_free, terminal_ends, manual_symbols)}
SQL = {
    "run_geometry": RUN_GEOMETRY, "adjacency": ADJACENCY, "nearest_pipe": NEAREST_PIPE, "snap_codes": SNAP_CODES, "end_texts": END_TEXTS, "duplicate_pipes": DUPLICATE_PIPES, "points_outside": POINTS_OUTSIDE, "interval_merge": INTERVAL_MERGE, "interval_subtract": INTERVAL_SUBTRACT, "tee_split": TEE_SPLIT,
    "furniture_free": FURNITURE_FREE, "terminal_ends": TERMINAL_ENDS, "manual_symbols": MANUAL_SYMBOLS,
}
