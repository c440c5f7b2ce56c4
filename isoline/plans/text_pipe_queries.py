"""Queries on texts beside pipes: association, underlines, code pairs, breaks and connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.operators import association, breaks
from isoline.plans.derive import CLASSES, derived, pick, with_
from isoline.plans.geometry_queries import terminal_ends

#: Boxes of labels: even ones lie, odd ones stand.
_BOX = [f"CASE WHEN pid_idx % 2 = 0 THEN {a} ELSE {b} END AS {c}" for a, b, c in (("x - 30", "x - 6", "x1"), ("y - 8", "y - 34", "y1"), ("x + 34", "x + 8", "x2"), ("y + 4", "y + 36", "y2"))]
_LABELS = f"lab AS (SELECT sheet_id, pid_idx, pid, {', '.join(_BOX)} FROM d_tags)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "d_tags").select("sheet_id", "pid_idx", "pid", *(F.expr(c) for c in _BOX))


def tag_to_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipe under or beside every label."""
    return association.direct(_labels(spark, sf_dir), derived(spark, sf_dir, "d_runs"), 34.0, 12.0, 100.0)


def _direct(gap: int, pad: int, main: int) -> str:
    """SQL for the pipe under or beside every label."""
    return f"""SELECT sheet_id, pid_idx, run_id, cost FROM (SELECT *, row_number() OVER (PARTITION BY pid_idx ORDER BY n < {main}, cost, run_id) AS k FROM (
  SELECT *, CASE WHEN NOT h THEN abs(c - mx) WHEN c >= ty2 THEN c - ty2 WHEN c >= ty1 THEN ty2 - c ELSE (ty2 - c) * 3.0 + 500 END::double AS cost FROM near
  WHERE ((lo - {pad} <= (tlo + thi) / 2 AND (tlo + thi) / 2 <= hi + {pad}) OR least(hi, thi) - greatest(lo, tlo) >= 0.55 * greatest(1, thi - tlo)) AND CASE WHEN h THEN c >= ty1 - {pad} AND c - ty2 <= {gap} ELSE abs(c - mx) <= {gap} END)) WHERE k = 1"""


_NEAR = """near AS (SELECT l.sheet_id, pid_idx, run_id, l.x2 - l.x1 >= l.y2 - l.y1 AS h, greatest(r.x2 - r.x1, r.y2 - r.y1) AS n,
  CASE WHEN h THEN r.x1 ELSE r.y1 END AS lo, CASE WHEN h THEN r.x2 ELSE r.y2 END AS hi, CASE WHEN h THEN l.x1 ELSE l.y1 END AS tlo, CASE WHEN h THEN l.x2 ELSE l.y2 END AS thi, CASE WHEN h THEN r.y1 ELSE r.x1 END AS c, l.y1 AS ty1, l.y2 AS ty2, (l.x1 + l.x2) / 2 AS mx
  FROM lab l JOIN d_runs r ON l.sheet_id = r.sheet_id AND (r.axis = 'H') = (l.x2 - l.x1 >= l.y2 - l.y1))"""
TAG_TO_PIPE = f"{with_('d_tags', 'd_runs')}, {_LABELS}, {_NEAR} {_direct(34, 12, 100)}"


def tag_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after contested pipes are settled."""
    labels, picks = _labels(spark, sf_dir), tag_to_pipe(spark, sf_dir)
    leaders = association.direct(labels, derived(spark, sf_dir, "d_runs"), 80.0, 60.0, 0.0).select("sheet_id", "pid_idx", "run_id", (-F.col("cost")).alias("score"))
    return association.resolve(labels.select("sheet_id", "pid_idx", "pid"), picks, leaders)


def _round(k: int) -> str:
    """SQL of a round: t{k} to t{k + 1}; every label has one leader at most here."""
    return f"""f{k} AS (SELECT *, run_id IS NOT NULL AND min(pid) OVER c <> max(pid) OVER c AND row_number() OVER (PARTITION BY sheet_id, run_id ORDER BY cost NULLS LAST, pid_idx) > 1 AS lost, min(pid_idx) OVER c AS turn FROM t{k} WINDOW c AS (PARTITION BY sheet_id, run_id)),
n{k} AS (SELECT sheet_id, pid_idx, led AS got FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, led ORDER BY turn, pid_idx) AS r FROM f{k} WHERE lost AND led IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t{k} u WHERE u.sheet_id = f{k}.sheet_id AND u.run_id = f{k}.led)) WHERE r = 1),
t{k + 1} AS (SELECT sheet_id, pid_idx, pid, led, CASE WHEN lost THEN got ELSE run_id END AS run_id, CASE WHEN lost THEN NULL ELSE cost END AS cost, CASE WHEN NOT lost THEN state WHEN got IS NOT NULL THEN 'leader' ELSE 'none' END AS state FROM f{k} LEFT JOIN n{k} USING (sheet_id, pid_idx))"""


TAG_CONFLICTS = f"""{with_('d_tags', 'd_runs')}, {_LABELS}, {_NEAR}, own AS ({_direct(34, 12, 100)}), lead AS ({_direct(80, 60, 0)}),
t0 AS (SELECT l.sheet_id, l.pid_idx, pid, e.run_id AS led, coalesce(o.run_id, e.run_id) AS run_id, o.cost, CASE WHEN o.run_id IS NOT NULL THEN 'attached' WHEN e.run_id IS NOT NULL THEN 'leader' ELSE 'none' END AS state FROM lab l LEFT JOIN own o USING (sheet_id, pid_idx) LEFT JOIN lead e USING (sheet_id, pid_idx)),
{_round(0)}, {_round(1)}, {_round(2)} SELECT sheet_id, pid_idx, run_id, state FROM t3"""


def label_underlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines drawn under labels."""
    return association.underlines(_labels(spark, sf_dir), derived(spark, sf_dir, "d_runs"), 8.0, 9.0)


LABEL_UNDERLINES = f"""{with_('d_tags', 'd_runs')}, {_LABELS}, p AS (SELECT l.sheet_id, pid_idx, run_id, l.x2 - l.x1 >= l.y2 - l.y1 AS h, CASE WHEN h THEN r.x1 ELSE r.y1 END AS lo, CASE WHEN h THEN r.x2 ELSE r.y2 END AS hi,
  CASE WHEN h THEN l.x1 ELSE l.y1 END AS tlo, CASE WHEN h THEN l.x2 ELSE l.y2 END AS thi, CASE WHEN h THEN r.y1 ELSE r.x1 END AS c, l.x1 AS tx1, l.x2 AS tx2, l.y2 AS ty2 FROM lab l JOIN d_runs r ON l.sheet_id = r.sheet_id AND (r.axis = 'H') = (l.x2 - l.x1 >= l.y2 - l.y1))
SELECT sheet_id, pid_idx, run_id FROM p WHERE hi - lo <= 1.9 * (thi - tlo) AND least(hi, thi) > greatest(lo, tlo) AND least(hi, thi) - greatest(lo, tlo) >= 0.55 * (hi - lo)
  AND CASE WHEN h THEN c BETWEEN ty2 - 8 AND ty2 + 9 ELSE c BETWEEN tx1 - 9 AND tx1 + 8 OR c BETWEEN tx2 - 8 AND tx2 + 9 END"""

_TOKEN = f"SELECT sheet_id, point_id AS token_id, {pick(CLASSES, 'point_id % 13 % 10')} AS text, x, y FROM d_points"
_TOKENS = f"tok AS (SELECT sheet_id, token_id, text, x AS x1, y AS y1, x + 28 AS x2, y + 10 + token_id % 5 AS y2 FROM ({_TOKEN}))"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(pick(CLASSES, "point_id % 13 % 10"))
    p = derived(spark, sf_dir, "d_points")
    return p.select("sheet_id", F.col("point_id").alias("token_id"), text.alias("text"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.expr("x + 28").alias("x2"), F.expr("y + 10 + point_id % 5").alias("y2"))


def code_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring class codes: candidates for spec breaks."""
    vocab = spark.createDataFrame([(c,) for c in CLASSES if c not in ("CPA", "ACC")], "code string")
    return breaks.code_pairs(_tokens(spark, sf_dir), vocab, 90.0, 60.0)


CODE_PAIRS = f"""{with_('d_points')}, {_TOKENS}, v AS (SELECT * FROM tok WHERE text NOT IN ('CPA', 'ACC')), p AS (SELECT a.sheet_id, a.token_id AS a, b.token_id AS b, a.text AS code_a, b.text AS code_b,
  CASE WHEN b.x1 - a.x2 > 0 AND b.x1 - a.x2 <= 90 AND greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) >= 0.45 * least(a.y2 - a.y1, b.y2 - b.y1) THEN 'H' WHEN b.y1 - a.y2 > 0 AND b.y1 - a.y2 <= 60 AND greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) >= 0.45 * least(a.x2 - a.x1, b.x2 - b.x1) THEN 'V' END AS orient,
  (a.x2 + b.x1) / 2 AS hx, (a.y2 + b.y1) / 2 AS vy, (a.x1 + a.x2 + b.x1 + b.x2) / 4 AS mx, (a.y1 + a.y2 + b.y1 + b.y2) / 4 AS my FROM v a JOIN v b ON a.sheet_id = b.sheet_id AND a.text <> b.text AND (a.y2 - a.y1) >= 0.6 * (b.y2 - b.y1) AND (a.y2 - a.y1) <= 1.7 * (b.y2 - b.y1))
SELECT sheet_id, a, b, code_a, code_b, orient, CASE WHEN orient = 'H' THEN hx ELSE mx END AS x, CASE WHEN orient = 'V' THEN vy ELSE my END AS y FROM p WHERE orient IS NOT NULL"""


def split_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes cut at spec breaks."""
    runs = derived(spark, sf_dir, "d_runs").select("sheet_id", "run_id", "x1", "y1", "x2", "y2")
    at = runs.where("run_id % 3 = 0").select("sheet_id", "run_id", F.expr("x1 + (x2 - x1) div 4 * (run_id % 5)").alias("x"), F.expr("y1 + (y2 - y1) div 4 * (run_id % 5) + 3").alias("y"))
    at = at.unionByName(runs.where("run_id % 6 = 0").select("sheet_id", "run_id", F.expr("x1 + (x2 - x1) div 2").alias("x"), F.expr("y1 + (y2 - y1) div 2").alias("y")))
    out = breaks.split_at_breaks(runs, at, 8.0)
    return out.select("sheet_id", "run_id", "piece", *(F.bround(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


SPLIT_BREAKS = f"""{with_('d_runs')}, r AS (SELECT *, greatest(x2 - x1, y2 - y1) AS n FROM d_runs), b AS (SELECT run_id, x1 + (x2 - x1) // 4 * (run_id % 5) - x1 + y1 + (y2 - y1) // 4 * (run_id % 5) + CASE WHEN axis = 'V' THEN 3 ELSE 0 END - y1 AS pos, n FROM r WHERE run_id % 3 = 0
  UNION SELECT run_id, (x2 - x1) // 2 + (y2 - y1) // 2, n FROM r WHERE run_id % 6 = 0), c AS (SELECT DISTINCT run_id, least(greatest(pos, 0), n) AS pos FROM b), k AS (SELECT c.* FROM c JOIN r USING (run_id) WHERE pos > 8 AND pos < n - 8),
s AS (SELECT run_id, 0 AS pos FROM r UNION ALL SELECT run_id, pos FROM k), p AS (SELECT *, row_number() OVER w AS piece, lead(pos) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY run_id ORDER BY pos))
SELECT sheet_id, run_id, piece, CASE WHEN axis = 'H' THEN x1 + pos ELSE x1 END::double AS x1, CASE WHEN axis = 'V' THEN y1 + pos ELSE y1 END::double AS y1, CASE WHEN axis = 'H' THEN x1 + coalesce(nxt, n) ELSE x1 END::double AS x2, CASE WHEN axis = 'V' THEN y1 + coalesce(nxt, n) ELSE y1 END::double AS y2 FROM p JOIN r USING (run_id)"""

_SAYS = "CASE run_id % 6 WHEN 0 THEN 'TO DWG 1-' || lpad(cast(run_id % 900 as string), 3, '0') || ', SH. ' || cast(run_id % 40 as string) WHEN 1 THEN 'from BCD3-605-42-PID-1-' || cast(run_id % 70 as string) || ')' WHEN 2 THEN 'Continued on the next sheet 7b' WHEN 3 THEN '605-6\"-GF-CCB-' || cast(run_id % 50 as string) WHEN 4 THEN 'DWG. No. 12-A;' END"


def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off-page connectors at pipe ends in the margin."""
    texts = derived(spark, sf_dir, "d_runs").select("sheet_id", "run_id", F.expr(_SAYS).alias("text")).where("text is not null")
    return breaks.connectors(terminal_ends(spark, sf_dir), texts, derived(spark, sf_dir, "d_tags"))


def _drawing() -> str:
    out = "''"
    for p in reversed(breaks.DRAWINGS):
        q = "'" + p.replace("'", "''") + "'"
        found = f"regexp_replace(regexp_extract(text, {q}, 1), '[,;:\")]+$', '')"
        out = f"CASE WHEN len({found}) >= 3 AND NOT regexp_matches(lower({found}), '^(the|and|line)') THEN {found} ELSE {out} END"
    return out


_LINE = "'" + breaks.LINE.replace("'", "''") + "'"
_EDGE = "CASE WHEN x <= 1900.0 * 0.18::double THEN 'left' WHEN x >= 1900.0 * (1 - 0.18::double) THEN 'right' WHEN y <= 1400.0 * 0.18::double THEN 'top' WHEN y >= 1400.0 * (1 - 0.18::double) THEN 'bottom' END"
_ENDS = f"SELECT *, {_EDGE} AS edge FROM (SELECT sheet_id, run_id, 0 AS which, x1 AS x, y1 AS y FROM d_runs UNION ALL SELECT sheet_id, run_id, 1, x2, y2 FROM d_runs) WHERE {_EDGE} IS NOT NULL"
CONNECTORS = f"""{with_('d_runs', 'd_tags')}, ends AS ({_ENDS}),
f AS (SELECT sheet_id, run_id, arg_min(edge, which) AS edge FROM ends GROUP BY ALL), t AS (SELECT f.*, coalesce({_SAYS}, '') AS text FROM f), g AS (SELECT sheet_id, run_id, arg_min(pid, pid_idx) AS piping_id FROM d_tags WHERE run_id IS NOT NULL GROUP BY ALL)
SELECT t.sheet_id, t.run_id, edge, CASE WHEN regexp_matches(text, '(?i)\\bFROM\\b') THEN 'incoming' WHEN regexp_matches(text, '(?i)\\bTO\\b') OR edge IN ('right', 'bottom') THEN 'outgoing' ELSE 'incoming' END AS direction, {_drawing()} AS target_drawing, regexp_extract(text, '{breaks.SHEET}', 1) AS target_sheet_number,
  CASE WHEN nullif(regexp_extract(text, {_LINE}, 1), '') IS DISTINCT FROM piping_id THEN nullif(regexp_extract(text, {_LINE}, 1), '') END AS target_line, piping_id, CASE WHEN {_drawing()} <> '' THEN 0.9 ELSE 0.75 END::double AS confidence FROM t LEFT JOIN g USING (sheet_id, run_id)"""


def token_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of one text at one place as one."""
    t = _tokens(spark, sf_dir)
    twin = t.select("sheet_id", (F.col("token_id") + 1_000_000_000).alias("token_id"), "text", *(F.expr(f"{c} + token_id % 19").alias(c) for c in ("x1", "y1", "x2", "y2")))
    out = breaks.merge_tokens(t.unionByName(twin))
    return out.select("sheet_id", "text", *(F.bround(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")), "n")


TOKEN_MERGE = f"""{with_('d_points')}, {_TOKENS}, u AS (SELECT * FROM tok UNION ALL SELECT sheet_id, token_id + 1000000000, text, x1 + token_id % 19, y1 + token_id % 19, x2 + token_id % 19, y2 + token_id % 19 FROM tok),
o AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, text ORDER BY x1, y1, token_id) AS k FROM u),
w AS (SELECT sheet_id, text, k, [{{'x1': x1::double, 'y1': y1::double, 'x2': x2::double, 'y2': y2::double, 'n': 1}}] AS c FROM o WHERE k = 1 UNION ALL
  SELECT sheet_id, text, k, CASE WHEN h = 0 THEN list_append(c, {{'x1': x1::double, 'y1': y1::double, 'x2': x2::double, 'y2': y2::double, 'n': 1}}) ELSE list_transform(c, lambda g, i: CASE WHEN i = h THEN {{'x1': g.x1 + x1, 'y1': g.y1 + y1, 'x2': g.x2 + x2, 'y2': g.y2 + y2, 'n': g.n + 1}} ELSE g END) END
  FROM (SELECT o.sheet_id, o.text, o.k, w.c, o.x1, o.y1, o.x2, o.y2, coalesce(list_position(list_transform(w.c, lambda g: abs((g.x1 + g.x2) / (2 * g.n) - (o.x1 + o.x2) / 2) < 14 AND abs((g.y1 + g.y2) / (2 * g.n) - (o.y1 + o.y2) / 2) < 14), true), 0) AS h FROM w JOIN o ON o.sheet_id = w.sheet_id AND o.text = w.text AND o.k = w.k + 1)),
m AS (SELECT sheet_id, text, arg_max(c, k) AS c FROM w GROUP BY sheet_id, text), l AS (SELECT sheet_id, text, unnest(c) AS g FROM m)
SELECT sheet_id, text, round_even(g.x1 / g.n, 6) AS x1, round_even(g.y1 / g.n, 6) AS y1, round_even(g.x2 / g.n, 6) AS x2, round_even(g.y2 / g.n, 6) AS y2, g.n AS n FROM l"""


def two_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text fragments stacked as two lines of one label."""
    return association.two_line_pairs(_tokens(spark, sf_dir).withColumnRenamed("token_id", "frag_id"))


TWO_LINES = f"""{with_('d_points')}, {_TOKENS} SELECT a.sheet_id, a.token_id AS upper, b.token_id AS lower, a.text || '-' || b.text AS text FROM tok a JOIN tok b ON a.sheet_id = b.sheet_id AND a.token_id <> b.token_id
  AND b.y1 - a.y2 >= -0.6 * greatest(a.y2 - a.y1, b.y2 - b.y1, 1) AND b.y1 - a.y2 <= 1.8 * greatest(a.y2 - a.y1, b.y2 - b.y1, 1) AND least(a.x2, b.x2) - greatest(a.x1, b.x1) >= 0.4 * least(a.x2 - a.x1, b.x2 - b.x1)"""

QUERIES = {f.__name__: f for f in (tag_to_pipe, tag_conflicts, label_underlines, code_pairs, split_breaks, connectors, token_merge, two_lines)}
SQL = {"tag_to_pipe": TAG_TO_PIPE, "tag_conflicts": TAG_CONFLICTS, "token_merge": TOKEN_MERGE, "label_underlines": LABEL_UNDERLINES, "code_pairs": CODE_PAIRS, "split_breaks": SPLIT_BREAKS, "connectors": CONNECTORS, "two_lines": TWO_LINES}
