"""Queries on strokes of drawings: merging, symbol regions, splitting, tables, and the whole chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.operators import vector
from isoline.plans.derive import derived, with_

_BOX = ("x1", "y1", "x2", "y2")


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({c: F.bround(c, 6) for c in names})


def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight pieces of stroked open paths made of lines, rectangles, quadrilaterals and curves."""
    p = derived(spark, sf_dir, "d_points")
    items = F.expr("""filter(array(
      named_struct('kind', 'l', 'points', array(array(double(x), double(y)), array(double(x + 9), double(y + 4)))),
      if(point_id % 3 = 0, named_struct('kind', 're', 'points', array(array(double(x), double(y)), array(double(x + 20), double(y + 10)))), null),
      if(point_id % 4 = 0, named_struct('kind', 'qu', 'points', array(array(double(x), double(y)), array(double(x + 20), double(y)), array(double(x + 25), double(y + 30)), array(double(x - 5), double(y + 30)))), null),
      named_struct('kind', 'c', 'points', array(array(double(x), double(y)), array(double(x + 30), double(y + 30)), array(double(x + 60), double(y + 60)), array(double(x + 90), double(y + 90)))),
      named_struct('kind', 'l', 'points', array(array(double(x), double(y)), array(double(x + if(point_id % 5 = 0, 0, 7)), double(y))))), i -> i is not null)""")
    paths = p.select("sheet_id", F.col("point_id").alias("path_id"), F.expr("if(point_id % 7 = 0, null, 'k')").alias("color"), F.expr("if(point_id % 2 = 0, 'w', null)").alias("fill"), F.expr("if(point_id % 6 = 0, 'f', 's')").alias("type"), F.expr("point_id % 11 = 0").alias("closed"), items.alias("items"))
    return vector.path_segments(paths).select("sheet_id", "path_id", "seg", *_BOX)


_OWN = "point_id % 7 <> 0 AND point_id % 6 <> 0 AND point_id % 11 <> 0 AND point_id % 5 <> 0"
_PIECES = [("1 = 1", 0, 0, 9, 4), ("point_id % 3 = 0", 0, 0, 20, 0), ("point_id % 3 = 0", 20, 0, 20, 10), ("point_id % 3 = 0", 20, 10, 0, 10), ("point_id % 3 = 0", 0, 10, 0, 0), ("point_id % 4 = 0", 0, 0, 20, 0), ("point_id % 4 = 0", 20, 0, 25, 30), ("point_id % 4 = 0", 25, 30, -5, 30), ("point_id % 4 = 0", -5, 30, 0, 0), ("1 = 1", 0, 0, 90, 90), ("1 = 1", 0, 0, 7, 0)]
PATH_SEGMENTS = f"{with_('d_points')}, s AS (" + " UNION ALL ".join(f"SELECT sheet_id, point_id, {k} AS k, x + {a} AS x1, y + {b} AS y1, x + {c} AS x2, y + {d} AS y2 FROM d_points WHERE {_OWN} AND {when}" for k, (when, a, b, c, d) in enumerate(_PIECES)) + ") SELECT sheet_id, point_id AS path_id, row_number() OVER (PARTITION BY point_id ORDER BY k) - 1 AS seg, x1::double AS x1, y1::double AS y1, x2::double AS x2, y2::double AS y2 FROM s"


def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces joined along their line at their weighted mean place."""
    return _rounded(vector.merge_segments(derived(spark, sf_dir, "d_segs")), *_BOX)


_MERGED = """long AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS n, CASE WHEN abs(y1 - y2) <= 1.2 AND abs(x1 - x2) > 1.2 THEN 'H' WHEN abs(x1 - x2) <= 1.2 AND abs(y1 - y2) > 1.2 THEN 'V' ELSE 'D' END AS axis FROM d_segs WHERE sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) >= 14),
flat AS (SELECT sheet_id, seg_id, axis, CASE WHEN axis = 'H' THEN y1 ELSE x1 END::double AS mid, CASE WHEN axis = 'H' THEN least(x1, x2) ELSE least(y1, y2) END::double AS lo, CASE WHEN axis = 'H' THEN greatest(x1, x2) ELSE greatest(y1, y2) END::double AS hi FROM long WHERE axis <> 'D'),
band AS (SELECT *, round_even(mid / 1.2::double, 0) AS band FROM flat), mark AS (SELECT *, max(hi) OVER (PARTITION BY sheet_id, axis, band ORDER BY lo, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM band),
isle AS (SELECT *, sum(CASE WHEN before IS NULL OR lo - before > 42 THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id, axis, band ORDER BY lo, seg_id ROWS UNBOUNDED PRECEDING) AS i FROM mark),
mrg AS (SELECT sheet_id, axis, min(seg_id) AS run_id, min(lo) AS lo, max(hi) AS hi, sum(mid * greatest(1e-9, hi - lo)) / sum(greatest(1e-9, hi - lo)) AS mid FROM isle GROUP BY sheet_id, axis, band, i HAVING max(hi) - min(lo) >= 10),
runs AS (SELECT sheet_id, run_id, axis, CASE WHEN axis = 'H' THEN lo ELSE mid END AS x1, CASE WHEN axis = 'H' THEN mid ELSE lo END AS y1, CASE WHEN axis = 'H' THEN hi ELSE mid END AS x2, CASE WHEN axis = 'H' THEN mid ELSE hi END AS y2 FROM mrg
  UNION ALL SELECT sheet_id, seg_id, axis, x1::double, y1::double, x2::double, y2::double FROM long WHERE axis = 'D' AND n >= 28)"""
MERGED_SEGMENTS = f"{with_('d_segs')}, {_MERGED} SELECT sheet_id, run_id, axis, round_even(x1, 6) AS x1, round_even(y1, 6) AS y1, round_even(x2, 6) AS x2, round_even(y2, 6) AS y2 FROM runs"


def symbol_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open valves, crosses and bars in the strokes."""
    return vector.symbol_regions(derived(spark, sf_dir, "d_segs"))


_REGIONS = """arm AS (SELECT sheet_id, seg_id, 1 AS which, x1 AS x, y1 AS y, x2 AS u, y2 AS v FROM d_segs WHERE abs(x1 - x2) > 1.5 AND abs(y1 - y2) > 1.5 UNION ALL SELECT sheet_id, seg_id, 2, x2, y2, x1, y1 FROM d_segs WHERE abs(x1 - x2) > 1.5 AND abs(y1 - y2) > 1.5),
met AS (SELECT a.sheet_id, a.seg_id AS a, b.seg_id AS b, a.which AS aw, b.which AS bw, (a.x + b.x) / 2 AS sx, (a.y + b.y) / 2 AS sy, a.u AS pu, a.v AS pv, b.u AS qu, b.v AS qv FROM arm a JOIN arm b ON a.sheet_id = b.sheet_id AND a.seg_id < b.seg_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 2.25),
vee AS (SELECT *, CASE WHEN abs(pu - qu) BETWEEN 4 AND 24 AND abs(pv - qv) <= 2.5 THEN CASE WHEN sx BETWEEN least(pu, qu) - 2.5 AND greatest(pu, qu) + 2.5 AND abs(sy - (pv + qv) / 2) >= 2.5 THEN 'h' END
  WHEN abs(pv - qv) BETWEEN 4 AND 24 AND abs(pu - qu) <= 2.5 THEN CASE WHEN sy BETWEEN least(pv, qv) - 2.5 AND greatest(pv, qv) + 2.5 AND abs(sx - (pu + qu) / 2) >= 2.5 THEN 'v' END END AS axis FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY aw, bw) AS k FROM met) WHERE k = 1),
vr AS (SELECT sheet_id, 0 AS kind, a, b, axis, CASE WHEN axis = 'h' THEN least(pu, qu) ELSE least(pu, qu, sx) END - 1.5 AS x1, CASE WHEN axis = 'v' THEN least(pv, qv) ELSE least(pv, qv, sy) END - 1.5 AS y1, CASE WHEN axis = 'h' THEN greatest(pu, qu) ELSE greatest(pu, qu, sx) END + 1.5 AS x2, CASE WHEN axis = 'v' THEN greatest(pv, qv) ELSE greatest(pv, qv, sy) END + 1.5 AS y2 FROM vee WHERE axis IS NOT NULL),
tie AS (SELECT sheet_id, a * 2 + aw AS m, b * 2 + bw AS n FROM met), tied AS (SELECT m, n FROM tie UNION SELECT n, m FROM tie), reach AS (SELECT DISTINCT m AS node, m AS other FROM tied UNION SELECT r.node, t.n FROM reach r JOIN tied t ON r.other = t.m),
home AS (SELECT node, min(other) AS c FROM reach GROUP BY 1), four AS (SELECT c, any_value(sheet_id) AS sheet_id, list({'s': seg_id, 'x': x, 'y': y, 'u': u, 'v': v} ORDER BY seg_id, which) AS s FROM arm JOIN home ON node = seg_id * 2 + which GROUP BY c HAVING count(*) = 4),
dir AS (SELECT *, s[1].x AS px, s[1].y AS py, list_transform(s, lambda t: {'x': (t.u - s[1].x) / sqrt(pow(t.u - s[1].x, 2) + pow(t.v - s[1].y, 2)), 'y': (t.v - s[1].y) / sqrt(pow(t.u - s[1].x, 2) + pow(t.v - s[1].y, 2))}) AS d, list_min(list_transform(s, lambda t: t.u)) AS u1, list_max(list_transform(s, lambda t: t.u)) AS u2, list_min(list_transform(s, lambda t: t.v)) AS v1, list_max(list_transform(s, lambda t: t.v)) AS v2 FROM four),
fit AS (SELECT *, least(px, u1) AS x1, greatest(px, u2) AS x2, least(py, v1) AS y1, greatest(py, v2) AS y2 FROM dir WHERE FACING),
xr AS (SELECT sheet_id, 1 AS kind, s[1].s AS a, s[2].s AS b, CASE WHEN EXISTS (SELECT 1 FROM d_segs g WHERE g.sheet_id = fit.sheet_id AND abs(g.y1 - g.y2) <= 1.5 AND px BETWEEN least(g.x1, g.x2) AND greatest(g.x1, g.x2) AND abs(g.y1 - py) <= 1.5)
  OR (NOT EXISTS (SELECT 1 FROM d_segs g WHERE g.sheet_id = fit.sheet_id AND abs(g.x1 - g.x2) <= 1.5 AND py BETWEEN least(g.y1, g.y2) AND greatest(g.y1, g.y2) AND abs(g.x1 - px) <= 1.5) AND x2 - x1 >= y2 - y1) THEN 'h' ELSE 'v' END AS axis, x1 - 1.5 AS x1, y1 - 1.5 AS y1, x2 + 1.5 AS x2, y2 + 1.5 AS y2 FROM fit WHERE x2 - x1 BETWEEN 4 AND 30 AND y2 - y1 BETWEEN 4 AND 30),
ord AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY kind, a, b) AS k FROM (SELECT * FROM vr UNION ALL SELECT * FROM xr)),
walk AS (SELECT sheet_id, k, [{'axis': axis, 'x1': x1::double, 'y1': y1::double, 'x2': x2::double, 'y2': y2::double}] AS kept FROM ord WHERE k = 1 UNION ALL
  SELECT o.sheet_id, o.k, CASE WHEN len(list_filter(w.kept, lambda q: q.axis = o.axis AND greatest(q.x1, o.x1) <= least(q.x2, o.x2) AND greatest(q.y1, o.y1) <= least(q.y2, o.y2))) = 0 THEN list_append(w.kept, {'axis': o.axis, 'x1': o.x1::double, 'y1': o.y1::double, 'x2': o.x2::double, 'y2': o.y2::double}) ELSE w.kept END FROM walk w JOIN ord o ON o.sheet_id = w.sheet_id AND o.k = w.k + 1),
uniq AS (SELECT sheet_id, unnest(kept) AS q FROM (SELECT sheet_id, arg_max(kept, k) AS kept FROM walk GROUP BY 1)),
sized AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS n FROM d_segs), short AS (SELECT * FROM sized WHERE n BETWEEN 4 AND 24), tip AS (SELECT sheet_id, seg_id, x1 AS x, y1 AS y FROM short UNION ALL SELECT sheet_id, seg_id, x2, y2 FROM short),
cont AS (SELECT DISTINCT p.sheet_id, a.seg_id AS a, b.seg_id AS b, a.x1 AS ax, a.y1 AS ay, a.x2 AS cx, a.y2 AS cy, b.x1 AS bx, b.y1 AS by_, b.x2 AS dx, b.y2 AS dy FROM tip p JOIN tip q ON p.sheet_id = q.sheet_id AND p.seg_id < q.seg_id AND pow(p.x - q.x, 2) + pow(p.y - q.y, 2) <= 64 JOIN short a ON a.seg_id = p.seg_id JOIN short b ON b.seg_id = q.seg_id
  WHERE abs((a.x2 - a.x1) * (b.x2 - b.x1) + (a.y2 - a.y1) * (b.y2 - b.y1)) / (a.n * b.n) >= cos(radians(3)) AND abs((a.x2 - a.x1) * (q.y - a.y1) - (a.y2 - a.y1) * (q.x - a.x1)) / a.n <= 1.5),
span AS (SELECT sheet_id, a, b, unnest([{'k': 0, 'p': [ax, ay], 'q': [cx, cy]}, {'k': 1, 'p': [ax, ay], 'q': [bx, by_]}, {'k': 2, 'p': [ax, ay], 'q': [dx, dy]}, {'k': 3, 'p': [cx, cy], 'q': [bx, by_]}, {'k': 4, 'p': [cx, cy], 'q': [dx, dy]}, {'k': 5, 'p': [bx, by_], 'q': [dx, dy]}]) AS z FROM cont),
two AS (SELECT sheet_id, a, b, z.p[1] AS x1, z.p[2] AS y1, z.q[1] AS x2, z.q[2] AS y2, sqrt(pow(z.p[1] - z.q[1], 2) + pow(z.p[2] - z.q[2], 2)) AS n FROM span QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY sqrt(pow(z.p[1] - z.q[1], 2) + pow(z.p[2] - z.q[2], 2)) DESC, z.k) = 1),
bar AS (SELECT sheet_id, seg_id AS a, seg_id AS b, x1, y1, x2, y2, n FROM short UNION ALL SELECT sheet_id, a, b, x1, y1, x2, y2, n FROM two WHERE n BETWEEN 4 AND 24),
side AS (SELECT t.*, p.n AS pn, (p.x2 - p.x1) AS px, (p.y2 - p.y1) AS py, ((p.x2 - p.x1) * (t.y1 - p.y1) - (p.y2 - p.y1) * (t.x1 - p.x1)) / p.n AS s0, ((p.x2 - p.x1) * (t.y2 - p.y1) - (p.y2 - p.y1) * (t.x2 - p.x1)) / p.n AS s1, ((t.x1 + t.x2) / 2 - p.x1) * (p.x2 - p.x1) + ((t.y1 + t.y2) / 2 - p.y1) * (p.y2 - p.y1) AS onto
  FROM bar t JOIN sized p ON t.sheet_id = p.sheet_id AND p.n >= 8 AND p.n >= 2 * t.n),
cross_ AS (SELECT DISTINCT sheet_id, a, b, x1, y1, x2, y2 FROM side WHERE abs(((x2 - x1) * px + (y2 - y1) * py) / (n * pn)) <= sin(radians(15)) AND s0 * s1 < 0 AND least(abs(s0), abs(s1)) >= 3 AND onto > 0 AND onto < pn * pn),
br AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, round_even((x1 + x2) / 2 / 3, 0), round_even((y1 + y2) / 2 / 3, 0) ORDER BY a, b) AS k FROM cross_),
regions AS (SELECT sheet_id, q.axis AS axis, q.x1 AS x1, q.y1 AS y1, q.x2 AS x2, q.y2 AS y2 FROM uniq UNION ALL SELECT sheet_id, 'both', least(x1, x2) - 1.5::double, least(y1, y2) - 1.5::double, greatest(x1, x2) + 1.5::double, greatest(y1, y2) + 1.5::double FROM br WHERE k = 1)""".replace(
    "FACING", " OR ".join(f"(d[1].x * d[{j}].x + d[1].y * d[{j}].y <= -0.45 AND d[{m}].x * d[{n}].x + d[{m}].y * d[{n}].y <= -0.45)" for j, m, n in ((2, 3, 4), (3, 2, 4), (4, 2, 3)))
)
SYMBOL_REGIONS = f"{with_('d_segs')}, {_REGIONS} SELECT * FROM regions"


def split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes stopped short of symbols."""
    segs = derived(spark, sf_dir, "d_segs")
    return _rounded(vector.split_at_regions(vector.merge_segments(segs), vector.symbol_regions(segs)), *_BOX)


_SPLIT = """hole AS (SELECT DISTINCT run_id, lo, hi FROM (SELECT r.run_id, greatest(0, CASE WHEN r.x1 = r.x2 THEN CASE WHEN r.x1 BETWEEN g.x1 AND g.x2 THEN 0 ELSE 2 END ELSE least((g.x1 - r.x1) / (r.x2 - r.x1), (g.x2 - r.x1) / (r.x2 - r.x1)) END, CASE WHEN r.y1 = r.y2 THEN CASE WHEN r.y1 BETWEEN g.y1 AND g.y2 THEN 0 ELSE 2 END ELSE least((g.y1 - r.y1) / (r.y2 - r.y1), (g.y2 - r.y1) / (r.y2 - r.y1)) END) AS lo,
  least(1, CASE WHEN r.x1 = r.x2 THEN CASE WHEN r.x1 BETWEEN g.x1 AND g.x2 THEN 1 ELSE -1 END ELSE greatest((g.x1 - r.x1) / (r.x2 - r.x1), (g.x2 - r.x1) / (r.x2 - r.x1)) END, CASE WHEN r.y1 = r.y2 THEN CASE WHEN r.y1 BETWEEN g.y1 AND g.y2 THEN 1 ELSE -1 END ELSE greatest((g.y1 - r.y1) / (r.y2 - r.y1), (g.y2 - r.y1) / (r.y2 - r.y1)) END) AS hi FROM runs r JOIN regions g ON r.sheet_id = g.sheet_id) WHERE hi > lo + 1e-9),
cut AS (SELECT run_id, lo, hi, max(hi) OVER (PARTITION BY run_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hole), stop AS (SELECT run_id, coalesce(before, 0) AS lo, lo AS hi FROM cut UNION ALL SELECT run_id, max(hi), 1 FROM hole GROUP BY 1 UNION ALL SELECT run_id, 0, 1 FROM runs WHERE run_id NOT IN (SELECT run_id FROM hole)),
rest AS (SELECT r.*, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS n, lo, hi FROM stop JOIN runs r USING (run_id) WHERE hi > lo + 1e-9), drawn AS (SELECT *, CASE WHEN lo > 1e-9 THEN lo + 0.75 / n ELSE lo END AS a, CASE WHEN hi < 1 - 1e-9 THEN hi - 0.75 / n ELSE hi END AS b FROM rest),
pieces AS (SELECT sheet_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY a) - 1 AS piece, axis, x1 + a * (x2 - x1) AS x1, y1 + a * (y2 - y1) AS y1, x1 + b * (x2 - x1) AS x2, y1 + b * (y2 - y1) AS y2 FROM drawn WHERE (b - a) * n >= 10)"""
SPLIT_RUNS = f"{with_('d_segs')}, {_MERGED}, {_REGIONS}, {_SPLIT} SELECT sheet_id, run_id, piece, axis, round_even(x1, 6) AS x1, round_even(y1, 6) AS y1, round_even(x2, 6) AS x2, round_even(y2, 6) AS y2 FROM pieces"


def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of close parallel lines."""
    return _rounded(vector.table_regions(vector.merge_segments(derived(spark, sf_dir, "d_segs"))), *_BOX)


_TABLES = """row_ AS (SELECT sheet_id, axis, run_id, CASE WHEN axis = 'H' THEN y1 ELSE x1 END AS pos, CASE WHEN axis = 'H' THEN least(x1, x2) ELSE least(y1, y2) END AS lo, CASE WHEN axis = 'H' THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS hi FROM LINES WHERE axis <> 'D'),
line_ AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, axis ORDER BY pos, lo, hi, run_id) AS k FROM row_),
grow AS (SELECT sheet_id, axis, k, [{'a': pos, 'b': pos, 'lo': lo, 'hi': hi, 'n': 1, 'way': hi - lo}] AS c FROM line_ WHERE k = 1 UNION ALL
  SELECT sheet_id, axis, k, CASE WHEN coalesce(list_max(v), 0) <= 0 THEN list_append(c, {'a': pos, 'b': pos, 'lo': lo, 'hi': hi, 'n': 1, 'way': hi - lo}) ELSE list_transform(c, lambda g, i: CASE WHEN i = list_position(v, list_max(v)) THEN {'a': least(g.a, pos), 'b': greatest(g.b, pos), 'lo': least(g.lo, lo), 'hi': greatest(g.hi, hi), 'n': g.n + 1, 'way': g.way + (hi - lo)} ELSE g END) END
  FROM (SELECT l.*, w.c, list_transform(w.c, lambda g: CASE WHEN l.pos - g.b > 12 OR (least(l.hi, g.hi) - greatest(l.lo, g.lo)) / greatest(1e-9, l.hi - l.lo, g.hi - g.lo) < 0.35 THEN 0 ELSE (least(l.hi, g.hi) - greatest(l.lo, g.lo)) / greatest(1e-9, l.hi - l.lo, g.hi - g.lo) END) AS v FROM grow w JOIN line_ l ON l.sheet_id = w.sheet_id AND l.axis = w.axis AND l.k = w.k + 1)),
found AS (SELECT sheet_id, axis, unnest(c) AS g FROM (SELECT sheet_id, axis, arg_max(c, k) AS c FROM grow GROUP BY sheet_id, axis)),
tables_ AS (SELECT sheet_id, axis, CASE WHEN axis = 'H' THEN g.lo ELSE g.a END AS x1, CASE WHEN axis = 'H' THEN g.a ELSE g.lo END AS y1, CASE WHEN axis = 'H' THEN g.hi ELSE g.b END AS x2, CASE WHEN axis = 'H' THEN g.b ELSE g.hi END AS y2 FROM found WHERE g.n >= 3 AND g.way >= 0.5 * greatest(1e-9, g.hi - g.lo) * g.n)"""
TABLE_REGIONS = f"{with_('d_segs')}, {_MERGED}, {_TABLES.replace('LINES', 'runs')} SELECT sheet_id, axis, round_even(x1, 6) AS x1, round_even(y1, 6) AS y1, round_even(x2, 6) AS x2, round_even(y2, 6) AS y2 FROM tables_"


def vector_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From strokes to pipes: how many pieces lie on each line."""
    out = vector.extract(derived(spark, sf_dir, "d_segs"), 3.0, 6.0)
    return out.groupBy("sheet_id", "axis", F.bround("v", 3).alias("place")).agg(F.count("*").alias("n_pieces"), F.bround(F.sum(F.expr("hi - lo")), 3).alias("way"))


VECTOR_CHAIN = f"""{with_('d_segs')}, {_MERGED}, {_REGIONS}, {_SPLIT}, own AS (SELECT row_number() OVER (ORDER BY run_id, piece) AS id, * FROM pieces), tips AS (SELECT sheet_id, id, x1 AS x, y1 AS y FROM own UNION ALL SELECT sheet_id, id, x2, y2 FROM own),
kin AS (SELECT DISTINCT a.id FROM tips a JOIN tips b ON a.sheet_id = b.sheet_id AND a.id <> b.id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2), real_ AS (SELECT sheet_id, id AS run_id, axis, x1, y1, x2, y2 FROM own WHERE greatest(abs(x2 - x1), abs(y2 - y1)) > 26 OR id IN (SELECT id FROM kin)),
{_TABLES.replace('LINES', 'real_')}, free AS (SELECT sheet_id, axis, run_id, CASE WHEN axis = 'H' THEN y1 ELSE x1 END AS v, CASE WHEN axis = 'H' THEN least(x1, x2) ELSE least(y1, y2) END AS lo, CASE WHEN axis = 'H' THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS hi FROM real_ r WHERE axis <> 'D' AND NOT EXISTS (SELECT 1 FROM tables_ t WHERE t.sheet_id = r.sheet_id
  AND least(r.x1, r.x2) >= t.x1 - 1 AND greatest(r.x1, r.x2) <= t.x2 + 1 AND least(r.y1, r.y2) >= t.y1 - 1 AND greatest(r.y1, r.y2) <= t.y2 + 1)),
tee AS (SELECT run_id, p, row_number() OVER (PARTITION BY run_id ORDER BY p) AS k FROM (SELECT DISTINCT r.run_id, b.v AS p FROM free r JOIN free b ON r.sheet_id = b.sheet_id AND r.axis <> b.axis AND (abs(b.lo - r.v) <= 3 OR abs(b.hi - r.v) <= 3) AND b.v > r.lo + 6 AND b.v < r.hi - 6)),
step AS (SELECT run_id, k, p AS last, 1 AS n FROM tee WHERE k = 1 UNION ALL SELECT t.run_id, t.k, CASE WHEN t.p - s.last >= 6 THEN t.p ELSE s.last END, CASE WHEN t.p - s.last >= 6 THEN s.n + 1 ELSE s.n END FROM step s JOIN tee t ON t.run_id = s.run_id AND t.k = s.k + 1), cuts AS (SELECT run_id, max(n) AS n FROM step GROUP BY 1)
SELECT sheet_id, axis, round_even(v, 3) AS place, cast(sum(1 + coalesce(n, 0)) AS bigint) AS n_pieces, round_even(sum(hi - lo), 3) AS way FROM free LEFT JOIN cuts USING (run_id) GROUP BY sheet_id, axis, round_even(v, 3)"""

QUERIES = {f.__name__: f for f in (path_segments, merged_segments, symbol_regions, split_runs, table_regions, vector_chain)}
SQL = {"path_segments": PATH_SEGMENTS, "merged_segments": MERGED_SEGMENTS, "symbol_regions": SYMBOL_REGIONS, "split_runs": SPLIT_RUNS, "table_regions": TABLE_REGIONS, "vector_chain": VECTOR_CHAIN}
