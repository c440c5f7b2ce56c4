"""Queries on the pipe graph: components, label propagation, spec breaks, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.operators import propagation, spatial
from isoline.operators.graph import connected_components
from isoline.plans.derive import derived, with_
from isoline.plans.geometry_queries import _ADJACENCY, adjacency


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency(spark, sf_dir)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "d_runs").withColumn("length", F.greatest(F.expr("x2 - x1"), F.expr("y2 - y1")))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "d_tags").where("run_id is not null and fluid <> ''").select("sheet_id", "run_id", F.col("pid_idx").alias("source"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected pipes, by the smallest pipe of each component."""
    return connected_components(_edges(spark, sf_dir), "a", "b")


COMPONENTS = f"""{with_('d_runs', 'd_boxes')}, e AS (SELECT a, b FROM ({_ADJACENCY})), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS other FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.other = s.a)
SELECT node, min(other) AS component FROM r GROUP BY node"""


def propagation_by_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all pipes from all tags, sheet by sheet (shortest paths; tests hold it against the loop)."""
    return propagation.propagate_by_sheet(_runs(spark, sf_dir), _edges(spark, sf_dir), _seeds(spark, sf_dir))


def propagation_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a DataFrame loop, for graphs that span sheets."""
    return propagation.propagate(_runs(spark, sf_dir), _edges(spark, sf_dir), _seeds(spark, sf_dir))


#: Ways along the pipes from every seed that visit no pipe twice; the shortest wins.
_LABELS = f"""e AS ({_ADJACENCY}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), seed AS (SELECT sheet_id, run_id, min(pid_idx) AS source FROM d_tags WHERE run_id IS NOT NULL AND fluid <> '' GROUP BY ALL),
way AS (SELECT sheet_id, run_id, source, 0.0::double AS dist, 0 AS hops, [run_id] AS path FROM seed UNION ALL
  SELECT w.sheet_id, s.b, w.source, w.dist + greatest(r.x2 - r.x1, r.y2 - r.y1), w.hops + 1, list_append(w.path, s.b) FROM way w JOIN s ON w.run_id = s.a JOIN d_runs r ON r.run_id = s.b WHERE NOT list_contains(w.path, s.b) AND s.b NOT IN (SELECT run_id FROM seed)),
best AS (SELECT sheet_id, run_id, source, dist, hops, hops > 0 AS inferred FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dist, hops, source) AS k FROM way) WHERE k = 1)"""
PROPAGATION = f"{with_('d_runs', 'd_tags', 'd_boxes')}, {_LABELS} SELECT * FROM best"


def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes labelled directly and by propagation, per sheet."""
    runs = _runs(spark, sf_dir)
    return propagation.coverage(runs, propagation.propagate_by_sheet(runs, _edges(spark, sf_dir), _seeds(spark, sf_dir)))


LABEL_COVERAGE = f"""{with_('d_runs', 'd_tags', 'd_boxes')}, e AS ({_ADJACENCY}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), t AS (SELECT run_id FROM d_tags WHERE run_id IS NOT NULL AND fluid <> ''),
r AS (SELECT run_id AS n FROM t UNION SELECT s.b FROM r JOIN s ON r.n = s.a)
SELECT sheet_id, count(*) FILTER (run_id IN (SELECT run_id FROM t)) AS n_direct, count(*) FILTER (run_id IN (SELECT n FROM r) AND run_id NOT IN (SELECT run_id FROM t)) AS n_inferred, count(*) AS n_runs FROM d_runs GROUP BY 1"""


def spec_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that spec breaks state for the halves that meet there."""
    runs = derived(spark, sf_dir, "d_runs")
    labels = runs.select("sheet_id", "run_id", (F.col("run_id") % 3 == 0).alias("inferred"), F.lit("CCB").alias("pclass"))
    breaks = runs.where("run_id % 2 = 0").select("sheet_id", F.col("run_id").alias("cp_id"), F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit("H").alias("orient"), F.lit("CDA").alias("code_a"), F.lit("ASA").alias("code_b"))
    return propagation.break_classes(labels, runs, breaks, 30.0)


SPEC_BREAKS = f"""{with_('d_runs')}, h AS (SELECT DISTINCT b.sheet_id, b.run_id AS cp, r.run_id, (r.x1 + r.x2) / 2 AS mx FROM d_runs b JOIN d_runs r ON b.sheet_id = r.sheet_id AND b.run_id % 2 = 0 AND ((abs(r.x1 - b.x2) <= 30 AND abs(r.y1 - b.y2) <= 30) OR (abs(r.x2 - b.x2) <= 30 AND abs(r.y2 - b.y2) <= 30))),
k AS (SELECT *, count(*) OVER (PARTITION BY cp) AS n, row_number() OVER (PARTITION BY cp ORDER BY mx, run_id) AS side FROM h), c AS (SELECT run_id, arg_max(CASE WHEN side = 1 THEN 'CDA' ELSE 'ASA' END, cp) AS code FROM k WHERE n = 2 GROUP BY 1)
SELECT sheet_id, run_id, run_id % 3 = 0 AS inferred, CASE WHEN run_id % 3 = 0 AND code IS NOT NULL THEN code ELSE 'CCB' END AS pclass FROM d_runs LEFT JOIN c USING (run_id)"""


def fallback_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags without pipe that light up an unlabelled component, one each."""
    tags = derived(spark, sf_dir, "d_tags").where("run_id is null and fluid <> ''")
    runs = _runs(spark, sf_dir)
    near = spatial.nearest_run(tags.select("sheet_id", F.col("pid_idx").alias("point_id"), "x", "y"), runs, 60.0).withColumnRenamed("point_id", "pid_idx")
    parts = connected_components(_edges(spark, sf_dir), "a", "b").select(F.col("node").alias("run_id"), "component")
    parts = runs.select("sheet_id", "run_id").join(parts, "run_id", "left").withColumn("component", F.coalesce("component", "run_id"))
    return propagation.fallback_seeds(tags, near, parts, _seeds(spark, sf_dir))


_NEAR = "sqrt(pow(greatest(r.x1 - t.x, t.x - r.x2, 0), 2) + pow(greatest(r.y1 - t.y, t.y - r.y2, 0), 2))"
FALLBACK_SEEDS = f"""{with_('d_runs', 'd_tags', 'd_boxes')}, e AS ({_ADJACENCY}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT run_id AS node, run_id AS other FROM d_runs UNION SELECT reach.node, s.b FROM reach JOIN s ON reach.other = s.a),
part AS (SELECT node AS run_id, min(other) AS component FROM reach GROUP BY 1), taken AS (SELECT DISTINCT component FROM d_tags JOIN part USING (run_id) WHERE fluid <> ''),
near AS (SELECT t.sheet_id, t.pid_idx, r.run_id, {_NEAR} AS d, row_number() OVER (PARTITION BY t.pid_idx ORDER BY {_NEAR}, greatest(r.x2 - r.x1, r.y2 - r.y1) DESC, r.run_id) AS k FROM d_tags t JOIN d_runs r ON t.sheet_id = r.sheet_id WHERE t.run_id IS NULL AND fluid <> '' AND {_NEAR} <= 60)
SELECT sheet_id, run_id, pid_idx FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, component ORDER BY d, run_id, pid_idx) AS n FROM near JOIN part USING (run_id) WHERE k = 1 AND component NOT IN (SELECT component FROM taken)) WHERE n = 1"""

QUERIES = {f.__name__: f for f in (components, propagation_by_sheet, propagation_loop, label_coverage, spec_breaks, fallback_seeds)}
SQL = {"components": COMPONENTS, "propagation_by_sheet": PROPAGATION, "propagation_loop": PROPAGATION, "label_coverage": LABEL_COVERAGE, "spec_breaks": SPEC_BREAKS, "fallback_seeds": FALLBACK_SEEDS}
