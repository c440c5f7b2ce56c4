"""Queries on cleaning and joining traced segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.operators import tracing
from isoline.plans.derive import derived, with_


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "d_runs").select("sheet_id", "run_id", "axis", "x1", "y1", "x2", "y2")


def _boxes(spark: SparkSession, sf_dir: str, coarse: str) -> DataFrame:
    return derived(spark, sf_dir, "d_boxes").where(F.col("coarse") == coarse).select("sheet_id", "box_id", "x1", "y1", "x2", "y2")


def no_box_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes that do not run along a symbol's box."""
    wide = _boxes(spark, sf_dir, "equipment").select("sheet_id", F.expr("x1 * 3").alias("x1"), F.expr("y1 * 3").alias("y1"), F.expr("x1 * 3 + 300").alias("x2"), F.expr("y1 * 3 + 300").alias("y2"))
    return tracing.drop_box_edges(_runs(spark, sf_dir), wide, 6.0).select("sheet_id", "run_id")


_WIDE = "wide AS (SELECT sheet_id, x1 * 3 AS x1, y1 * 3 AS y1, x1 * 3 + 300 AS x2, y1 * 3 + 300 AS y2 FROM d_boxes WHERE coarse = 'equipment')"
NO_BOX_EDGES = f"""{with_('d_runs', 'd_boxes')}, {_WIDE} SELECT sheet_id, run_id FROM d_runs r WHERE NOT EXISTS (SELECT 1 FROM wide b WHERE b.sheet_id = r.sheet_id AND (
  (r.y2 - r.y1 <= 6 AND (abs(r.y1 - b.y1) <= 6 OR abs(r.y1 - b.y2) <= 6) AND r.x1 >= b.x1 - 6 AND r.x2 <= b.x2 + 6) OR (r.x2 - r.x1 <= 6 AND (abs(r.x1 - b.x1) <= 6 OR abs(r.x1 - b.x2) <= 6) AND r.y1 >= b.y1 - 6 AND r.y2 <= b.y2 + 6)))"""


def not_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes that lie in no table region."""
    wide = _boxes(spark, sf_dir, "equipment").select("sheet_id", F.expr("x1 * 3").alias("x1"), F.expr("y1 * 3").alias("y1"), F.expr("x1 * 3 + 300").alias("x2"), F.expr("y1 * 3 + 300").alias("y2"))
    return tracing.drop_inside(_runs(spark, sf_dir), wide, 3.0).select("sheet_id", "run_id")


NOT_INSIDE = f"{with_('d_runs', 'd_boxes')}, {_WIDE} SELECT sheet_id, run_id FROM d_runs r WHERE NOT EXISTS (SELECT 1 FROM wide b WHERE b.sheet_id = r.sheet_id AND r.x1 >= b.x1 - 3 AND r.x2 <= b.x2 + 3 AND r.y1 >= b.y1 - 3 AND r.y2 <= b.y2 + 3)"


def no_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes whose middle lies in no furniture."""
    return tracing.drop_furniture(_runs(spark, sf_dir), _boxes(spark, sf_dir, "instrument")).select("sheet_id", "run_id")


NO_FURNITURE = f"{with_('d_runs', 'd_boxes')} SELECT sheet_id, run_id FROM d_runs r WHERE NOT EXISTS (SELECT 1 FROM d_boxes b WHERE b.coarse = 'instrument' AND b.sheet_id = r.sheet_id AND (r.x1 + r.x2) / 2 BETWEEN b.x1 AND b.x2 AND (r.y1 + r.y2) / 2 BETWEEN b.y1 AND b.y2)"


def no_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pipes, and short ones that meet another."""
    return tracing.drop_glyph_noise(_runs(spark, sf_dir), 120.0, 25.0).select("sheet_id", "run_id")


NO_GLYPHS = f"""{with_('d_runs')}, e AS (SELECT sheet_id, run_id, x1 AS x, y1 AS y FROM d_runs UNION ALL SELECT sheet_id, run_id, x2, y2 FROM d_runs)
SELECT sheet_id, run_id FROM d_runs r WHERE greatest(x2 - x1, y2 - y1) > 120 OR EXISTS (SELECT 1 FROM e a JOIN e b ON a.sheet_id = b.sheet_id AND a.run_id = r.run_id AND b.run_id <> r.run_id AND abs(a.x - b.x) <= 25 AND abs(a.y - b.y) <= 25)"""


def snapped_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes with their ends put onto near equipment walls."""
    return tracing.snap_ends(_runs(spark, sf_dir), _boxes(spark, sf_dir, "equipment"), 25.0).select("sheet_id", "run_id", "x1", "y1", "x2", "y2")


_LEVEL, _UPRIGHT = "abs(vx) >= 1.2 * abs(vy)", "abs(vy) >= 1.2 * abs(vx)"
_ON_X, _ON_Y = "e.y BETWEEN b.y1 - 12.5 AND b.y2 + 12.5", "e.x BETWEEN b.x1 - 12.5 AND b.x2 + 12.5"


def _to(d: str, x: str, y: str) -> str:
    return f"{{'d': ({d})::double, 'x': ({x})::double, 'y': ({y})::double}}"


_CX, _CY = "greatest(b.x1, least(e.x, b.x2))", "greatest(b.y1, least(e.y, b.y2))"
_GAP = "least(e.x - b.x1, b.x2 - e.x, e.y - b.y1, b.y2 - e.y)"
SNAPPED_ENDS = f"""{with_('d_runs', 'd_boxes')}, e AS (SELECT sheet_id, run_id, 1 AS which, x1 AS x, y1 AS y, x1 - x2 AS vx, y1 - y2 AS vy FROM d_runs UNION ALL SELECT sheet_id, run_id, 2, x2, y2, x2 - x1, y2 - y1 FROM d_runs),
c AS (SELECT run_id, which, box_id, CASE WHEN e.x BETWEEN b.x1 AND b.x2 AND e.y BETWEEN b.y1 AND b.y2 THEN CASE WHEN {_GAP} = e.x - b.x1 THEN {_to(_GAP, 'b.x1', 'e.y')} WHEN {_GAP} = b.x2 - e.x THEN {_to(_GAP, 'b.x2', 'e.y')} WHEN {_GAP} = e.y - b.y1 THEN {_to(_GAP, 'e.x', 'b.y1')} ELSE {_to(_GAP, 'e.x', 'b.y2')} END
  WHEN {_LEVEL} AND {_ON_X} AND vx > 0 AND b.x1 - e.x BETWEEN 0 AND 25 THEN {_to('b.x1 - e.x', 'b.x1', _CY)} WHEN {_LEVEL} AND {_ON_X} AND vx < 0 AND e.x - b.x2 BETWEEN 0 AND 25 THEN {_to('e.x - b.x2', 'b.x2', _CY)}
  WHEN NOT ({_LEVEL} AND {_ON_X}) AND {_UPRIGHT} AND {_ON_Y} AND vy > 0 AND b.y1 - e.y BETWEEN 0 AND 25 THEN {_to('b.y1 - e.y', _CX, 'b.y1')} WHEN NOT ({_LEVEL} AND {_ON_X}) AND {_UPRIGHT} AND {_ON_Y} AND vy < 0 AND e.y - b.y2 BETWEEN 0 AND 25 THEN {_to('e.y - b.y2', _CX, 'b.y2')}
  WHEN ({_LEVEL} AND abs(e.y - {_CY}) > 8) OR (NOT ({_LEVEL}) AND {_UPRIGHT} AND abs(e.x - {_CX}) > 8) THEN NULL ELSE {_to(f'sqrt(pow(e.x - {_CX}, 2) + pow(e.y - {_CY}, 2))', _CX, _CY)} END AS t FROM e JOIN d_boxes b ON b.coarse = 'equipment' AND b.sheet_id = e.sheet_id),
m AS (SELECT run_id, which, t FROM c WHERE t.d <= 25 QUALIFY row_number() OVER (PARTITION BY run_id, which ORDER BY t.d, box_id) = 1)
SELECT sheet_id, r.run_id, coalesce(round_even(a.t.x, 0)::bigint, x1) AS x1, coalesce(round_even(a.t.y, 0)::bigint, y1) AS y1, coalesce(round_even(z.t.x, 0)::bigint, x2) AS x2, coalesce(round_even(z.t.y, 0)::bigint, y2) AS y2 FROM d_runs r LEFT JOIN m a ON a.run_id = r.run_id AND a.which = 1 LEFT JOIN m z ON z.run_id = r.run_id AND z.which = 2"""


def stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How new pipes of a region join the existing ones."""
    runs = _runs(spark, sf_dir)
    new = runs.where("run_id % 4 = 0").withColumnRenamed("run_id", "new_id")
    return tracing.stitch(new, runs.where("run_id % 4 <> 0"), 40.0)


STITCHED = f"""{with_('d_runs')}, n AS (SELECT sheet_id, run_id AS new_id, 1 AS which, x1 AS x, y1 AS y FROM d_runs WHERE run_id % 4 = 0 UNION ALL SELECT sheet_id, run_id, 2, x2, y2 FROM d_runs WHERE run_id % 4 = 0), o AS (SELECT sheet_id, run_id, x1 AS u, y1 AS v FROM d_runs WHERE run_id % 4 <> 0 UNION ALL SELECT sheet_id, run_id, x2, y2 FROM d_runs WHERE run_id % 4 <> 0),
p AS (SELECT n.sheet_id, new_id, which, count(o.run_id) AS c, min(o.run_id) AS r FROM n LEFT JOIN o ON n.sheet_id = o.sheet_id AND pow(x - u, 2) + pow(y - v, 2) <= 1600 GROUP BY ALL),
k AS (SELECT a.sheet_id, a.new_id, a.r AS r1, b.r AS r2, CASE WHEN a.c > 1 OR b.c > 1 OR (a.c = 1 AND b.c = 1 AND a.r = b.r) THEN 'ambiguous' WHEN a.c = 1 AND b.c = 1 THEN 'bridge' WHEN a.c + b.c = 1 THEN 'extend' ELSE 'new' END AS kind FROM p a JOIN p b ON a.new_id = b.new_id AND a.which = 1 AND b.which = 2)
SELECT sheet_id, new_id, kind, CASE WHEN kind IN ('extend', 'bridge') THEN coalesce(r1, r2) END AS run_a, CASE WHEN kind = 'bridge' THEN r2 END AS run_b FROM k"""


def elbows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes joined at bends."""
    return tracing.merge_elbows(_runs(spark, sf_dir), 20.0).select("sheet_id", "run_id", "n_runs", F.size("points").alias("n_points"))


ELBOWS = f"""{with_('d_runs')}, e AS (SELECT sheet_id, run_id, run_id * 2 AS n, x1 AS x, y1 AS y FROM d_runs UNION ALL SELECT sheet_id, run_id, run_id * 2 + 1, x2, y2 FROM d_runs),
p AS (SELECT a.n AS a, b.n AS b FROM e a JOIN e b ON a.sheet_id = b.sheet_id AND abs(a.x - b.x) <= 20 AND abs(a.y - b.y) <= 20), r AS (SELECT n, n AS o FROM e UNION SELECT r.n, p.b FROM r JOIN p ON r.o = p.a), place AS (SELECT n, min(o) AS g FROM r GROUP BY 1),
two AS (SELECT min(n // 2) AS a, max(n // 2) AS b FROM place GROUP BY g HAVING count(*) = 2 AND min(n // 2) <> max(n // 2)), s AS (SELECT a, b FROM two UNION SELECT b, a FROM two),
c AS (SELECT run_id AS n, run_id AS o FROM d_runs UNION SELECT c.n, s.b FROM c JOIN s ON c.o = s.a), m AS (SELECT n, min(o) AS run_id FROM c GROUP BY 1)
SELECT sheet_id, m.run_id, cast(count(*) AS int) AS n_runs, cast(count(*) + 1 AS int) AS n_points FROM m JOIN d_runs d ON d.run_id = m.n GROUP BY ALL"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers joined over gaps that no valve crosses."""
    return tracing.bridge_headers(_runs(spark, sf_dir), 45, 24, _boxes(spark, sf_dir, "valve"))


HEADERS = f"""{with_('d_runs', 'd_boxes')}, f AS (SELECT sheet_id, run_id, axis, CASE WHEN axis = 'H' THEN x1 ELSE y1 END AS lo, CASE WHEN axis = 'H' THEN x2 ELSE y2 END AS hi, CASE WHEN axis = 'H' THEN y1 ELSE x1 END AS pos FROM d_runs),
o AS (SELECT *, pos // 25 AS band, row_number() OVER (PARTITION BY sheet_id, axis, pos // 25 ORDER BY lo, run_id) AS k FROM f),
w AS (SELECT sheet_id, axis, band, k, lo, hi, pos, 1 AS n_runs, 1 AS island FROM o WHERE k = 1 UNION ALL
  SELECT sheet_id, axis, band, k, CASE WHEN j THEN lo ELSE lo2 END, CASE WHEN j THEN greatest(hi, hi2) ELSE hi2 END, CASE WHEN j THEN cast(round_even((pos + pos2) / 2, 0) AS bigint) ELSE pos2 END, CASE WHEN j THEN n_runs + 1 ELSE 1 END, CASE WHEN j THEN island ELSE island + 1 END
  FROM (SELECT o.sheet_id, o.axis, o.band, o.k, w.lo, w.hi, w.pos, w.n_runs, w.island, o.lo AS lo2, o.hi AS hi2, o.pos AS pos2, o.lo - w.hi <= 45 AND NOT EXISTS (SELECT 1 FROM d_boxes b WHERE b.coarse = 'valve' AND b.sheet_id = o.sheet_id AND
    CASE WHEN o.axis = 'H' THEN w.pos BETWEEN b.y1 AND b.y2 AND w.hi < b.x2 AND o.lo > b.x1 ELSE w.pos BETWEEN b.x1 AND b.x2 AND w.hi < b.y2 AND o.lo > b.y1 END) AS j FROM w JOIN o ON o.sheet_id = w.sheet_id AND o.axis = w.axis AND o.band = w.band AND o.k = w.k + 1))
SELECT sheet_id, axis, lo, hi, pos AS "at", n_runs FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, axis, band, island ORDER BY k DESC) AS r FROM w) WHERE r = 1"""


QUERIES = {f.__name__: f for f in (no_box_edges, not_inside, no_furniture, no_glyphs, snapped_ends, stitched, elbows, headers)}
SQL = {"no_box_edges": NO_BOX_EDGES, "not_inside": NOT_INSIDE, "no_furniture": NO_FURNITURE, "no_glyphs": NO_GLYPHS, "snapped_ends": SNAPPED_ENDS, "stitched": STITCHED, "elbows": ELBOWS, "headers": HEADERS}
