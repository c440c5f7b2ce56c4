"""Queries on systems, circuits, validation, review, registers, topology and job states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.functions import tags as t
from isoline.operators import greedy, grouping, registers, topology, validation
from isoline.plans.derive import derived, with_
from isoline.streaming import progress

_SPEC = ", ".join(f"('{k}', '{v}')" for k, v in grouping.MATERIAL_SPEC.items())
_KNOWN = ", ".join(f"'{k}'" for k in grouping.MATERIAL_SPEC)


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes by fluid, ranked per sheet."""
    return grouping.systems(grouping.direct_labels(derived(spark, sf_dir, "d_tags")))


_SYSTEMS = "SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY n_pipes DESC, fluid) AS system_no FROM (SELECT sheet_id, upper(fluid) AS fluid, count(*) AS n_pipes FROM d_tags WHERE run_id IS NOT NULL AND fluid <> '' GROUP BY sheet_id, upper(fluid))"
SYSTEMS = f"{with_('d_tags')} {_SYSTEMS}"


def circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuits of every system, with codes, operating summary and provenance."""
    tags = derived(spark, sf_dir, "d_tags")
    return grouping.circuits(grouping.direct_labels(tags), tags, grouping.material_spec(spark))


_CIRCUITS = f"""spec(c, m) AS (VALUES {_SPEC}), k AS (SELECT d_tags.*, coalesce(nullif(upper(material), ''), m, substr(pclass, 2, 1)) AS mat FROM d_tags LEFT JOIN spec ON pclass = c WHERE fluid <> ''),
p AS (SELECT sheet_id, fluid, mat, fluid_phase, corrosion_loop, count(*) AS n_pipes, list_sort(list(DISTINCT pclass)) AS cl FROM k WHERE run_id IS NOT NULL GROUP BY ALL),
g AS (SELECT sheet_id, fluid, mat, fluid_phase, corrosion_loop, count(*) AS n_tags, round_even(avg(operating_temperature), 1) AS avg_temperature_c, round_even(avg(operating_pressure), 1) AS avg_pressure_barg, min(corrosion_allowance) AS corrosion_allowance_mm FROM k GROUP BY ALL),
sy AS ({_SYSTEMS}), circ AS (
SELECT p.sheet_id, lpad(cast(system_no AS varchar), 2, '0') || '.' || lpad(cast(row_number() OVER (PARTITION BY p.sheet_id, p.fluid ORDER BY p.n_pipes DESC, p.mat, p.fluid_phase, p.corrosion_loop) AS varchar), 2, '0') AS code, p.fluid, p.mat AS material, p.fluid_phase, p.corrosion_loop, p.n_pipes, coalesce(n_tags, 0) AS n_tags, array_to_string(cl, ',') AS classes,
  avg_temperature_c, avg_pressure_barg, corrosion_allowance_mm, CASE WHEN p.corrosion_loop <> '' THEN 'LINE_LIST_CORROSION_LOOP' WHEN p.fluid_phase <> '' THEN 'API_RP_970_PHASE_BOUNDARY' WHEN list_has_any(cl, [{_KNOWN}]) THEN 'API_RP_970_MATERIAL_SPEC' ELSE 'API_RP_970_MATERIAL_SPLIT' END AS rule,
  CASE WHEN p.corrosion_loop <> '' THEN 1.0 WHEN p.fluid_phase <> '' OR list_has_any(cl, [{_KNOWN}]) THEN 0.95 ELSE 0.85 END::double AS confidence
FROM p JOIN sy ON p.sheet_id = sy.sheet_id AND p.fluid = sy.fluid LEFT JOIN g ON p.sheet_id = g.sheet_id AND p.fluid = g.fluid AND p.mat = g.mat AND p.fluid_phase = g.fluid_phase AND p.corrosion_loop = g.corrosion_loop)"""
CIRCUITS = f"{with_('d_tags')}, {_CIRCUITS} SELECT * FROM circ"


def project_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuits over all sheets, ranked anew."""
    return topology.project_circuits(circuits(spark, sf_dir))


PROJECT_CIRCUITS = f"""{with_('d_tags')}, {_CIRCUITS}, a AS (SELECT fluid, material, fluid_phase, corrosion_loop, count(DISTINCT sheet_id) AS n_sheets, cast(sum(n_pipes) AS bigint) AS n_pipes, cast(sum(n_tags) AS bigint) AS n_tags, min(corrosion_allowance_mm) AS corrosion_allowance_mm FROM circ GROUP BY ALL),
f AS (SELECT fluid, row_number() OVER (ORDER BY sum(n_pipes) DESC, fluid) AS k FROM a GROUP BY fluid)
SELECT lpad(cast(k AS varchar), 2, '0') || '.' || lpad(cast(row_number() OVER (PARTITION BY fluid ORDER BY n_pipes DESC, material, fluid_phase, corrosion_loop) AS varchar), cast(greatest(2, len(cast(row_number() OVER (PARTITION BY fluid ORDER BY n_pipes DESC, material, fluid_phase, corrosion_loop) AS varchar))) AS int), '0') AS code, a.* FROM a JOIN f USING (fluid)"""


def tag_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per line key over the whole plant, votes summed and pipes united."""
    rows = derived(spark, sf_dir, "d_tags").withColumn("sheet_id", F.lit(0)).withColumn("pid", F.regexp_replace("pid", r"-\d+$", ""))
    out = grouping.dedup_tags(rows, t.key_a(F.col("pid")), merge_runs=True)
    return out.select("line_key", "pid", "conf", "run_id", F.size("extra_runs").alias("n_extra"))


TAG_DEDUP = f"""{with_('d_tags')}, r AS (SELECT regexp_replace(pid, '-\\d+$', '') AS pid, conf, run_id, pid_idx FROM d_tags), k AS (SELECT *, upper(regexp_replace(pid, '[" ]', '', 'g')) AS line_key FROM r)
SELECT line_key, arg_max(pid, (contains(pid, '"'), len(pid), conf, -pid_idx)) AS pid, cast(sum(conf) AS bigint) AS conf, coalesce((array_agg(run_id ORDER BY contains(pid, '"') DESC, len(pid) DESC, conf DESC, pid_idx))[1], min(run_id)) AS run_id, cast(greatest(count(DISTINCT run_id) - 1, 0) AS int) AS n_extra FROM k GROUP BY line_key"""


def tag_dedup_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal tags the one with most votes."""
    rows = derived(spark, sf_dir, "d_tags").withColumn("pid", F.regexp_replace("pid", r"-\d+$", ""))
    return grouping.dedup_tags(rows, t.key_a(F.col("pid"))).select("sheet_id", "pid", "pid_idx", "conf")


TAG_DEDUP_SIMPLE = f"""{with_('d_tags')} SELECT sheet_id, pid, pid_idx, conf FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, pid ORDER BY conf DESC, pid_idx) AS k FROM (SELECT * REPLACE (regexp_replace(pid, '-\\d+$', '') AS pid) FROM d_tags)) WHERE k = 1"""


def _suspect_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of which a few codes are misread by one letter."""
    odd = F.expr("pid_idx % 37 = 1 and length(fluid) > 1")
    return derived(spark, sf_dir, "d_tags").withColumn("fluid", F.when(odd, F.concat(F.substring("fluid", 1, 1), F.lit("X"))).otherwise(F.col("fluid")))


def fluid_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes used once that are one edit from a common code."""
    return validation.fluid_suspects(_suspect_tags(spark, sf_dir))


_SUSPECT = """s AS (SELECT * REPLACE (CASE WHEN pid_idx % 37 = 1 AND len(fluid) > 1 THEN substr(fluid, 1, 1) || 'X' ELSE fluid END AS fluid) FROM d_tags), n AS (SELECT sheet_id, fluid, count(*) AS n FROM s WHERE fluid <> '' GROUP BY ALL),
sus AS (SELECT a.sheet_id, a.fluid, arg_min(b.fluid, (-b.n, b.fluid)) AS suggest FROM n a JOIN n b ON a.sheet_id = b.sheet_id AND a.n = 1 AND b.n >= 3 AND levenshtein(a.fluid, b.fluid) = 1 GROUP BY ALL)"""
FLUID_SUSPECTS = f"{with_('d_tags')}, {_SUSPECT} SELECT * FROM sus"


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derived(spark, sf_dir, "d_runs").withColumn("length", F.greatest(F.expr("x2 - x1"), F.expr("y2 - y1")))
    return runs.where("length >= 270").join(derived(spark, sf_dir, "d_tags").where("run_id is not null"), ["sheet_id", "run_id"], "left_anti").select("sheet_id", "run_id", "length")


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every sheet, in the order in which they are listed."""
    equipment = derived(spark, sf_dir, "d_boxes").where("coarse = 'equipment'").select("sheet_id", "x1", "y1", "x2", "y2")
    tags = _suspect_tags(spark, sf_dir).withColumn("run_id", F.expr("if(pid_idx % 3 = 1, null, run_id)"))
    return validation.review(tags, equipment, _orphans(spark, sf_dir))


REVIEW = f"""{with_('d_tags', 'd_runs', 'd_boxes')}, {_SUSPECT}, f AS (SELECT * REPLACE (CASE WHEN pid_idx % 3 = 1 THEN NULL ELSE run_id END AS run_id) FROM s),
i AS (SELECT sheet_id, pid_idx, EXISTS (SELECT 1 FROM d_boxes b WHERE b.coarse = 'equipment' AND b.sheet_id = f.sheet_id AND f.x BETWEEN b.x1 AND b.x2 AND f.y BETWEEN b.y1 AND b.y2) AS inside FROM f WHERE run_id IS NULL)
SELECT sheet_id, 0 AS kind_no, 'fluid_suspect' AS kind, fluid || '>' || suggest AS subject FROM sus UNION ALL SELECT sheet_id, CASE WHEN inside THEN 2 ELSE 1 END, CASE WHEN inside THEN 'pid_in_equipment' ELSE 'pid_none' END, cast(pid_idx AS varchar) FROM i
UNION ALL SELECT sheet_id, 3, 'fluid_empty', cast(pid_idx AS varchar) FROM f WHERE run_id IS NOT NULL AND fluid = ''
UNION ALL SELECT sheet_id, 5, 'orphan_run', cast(run_id AS varchar) FROM d_runs r WHERE greatest(x2 - x1, y2 - y1) >= 270 AND NOT EXISTS (SELECT 1 FROM d_tags t WHERE t.sheet_id = r.sheet_id AND t.run_id = r.run_id)"""


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six checks of every sheet."""
    return validation.digitization(_suspect_tags(spark, sf_dir), derived(spark, sf_dir, "d_boxes"), _orphans(spark, sf_dir))


_VALIDATION = f"""{_SUSPECT}, a AS (SELECT sheet_id, count(*) AS n, count(run_id) AS linked, count(*) FILTER (trim(fluid) <> '') AS fluided, count(*) FILTER (conf >= 2) AS voted FROM s GROUP BY 1),
b AS (SELECT sheet_id, count(*) AS ns, count(*) FILTER (score >= 0.35) AS sure FROM d_boxes GROUP BY 1), u AS (SELECT sheet_id, count(*) AS suspect FROM sus GROUP BY 1),
o AS (SELECT sheet_id, count(*) AS orphans FROM d_runs r WHERE greatest(x2 - x1, y2 - y1) >= 270 AND NOT EXISTS (SELECT 1 FROM d_tags t WHERE t.sheet_id = r.sheet_id AND t.run_id = r.run_id) GROUP BY 1),
j AS (SELECT a.*, coalesce(ns, 0) AS ns, coalesce(sure, 0) AS sure, coalesce(suspect, 0) AS suspect, coalesce(orphans, 0) AS orphans FROM a LEFT JOIN b USING (sheet_id) LEFT JOIN u USING (sheet_id) LEFT JOIN o USING (sheet_id)),
c AS (SELECT sheet_id, 'pipe_link' AS "check", linked AS n_ok, n AS n_all FROM j UNION ALL SELECT sheet_id, 'fluid_parsed', fluided, n FROM j UNION ALL SELECT sheet_id, 'fluid_consistency', n - suspect, n FROM j UNION ALL SELECT sheet_id, 'symbol_conf', sure, ns FROM j
  UNION ALL SELECT sheet_id, 'pid_conf', voted, n FROM j UNION ALL SELECT sheet_id, 'pipe_labeled', CASE WHEN orphans = 0 THEN 1 ELSE 0 END, 1 FROM j)"""
VALIDATION_REPORT = f"""{with_('d_tags', 'd_runs', 'd_boxes')}, {_VALIDATION}
SELECT sheet_id, "check", round_even(CASE WHEN n_all > 0 THEN 100.0::double * n_ok / n_all ELSE 100.0 END, 1) AS value, n_ok, n_all, n_ok = n_all AS passed FROM c"""


def line_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered by tag within their sheet, with unlisted lines last."""
    tags = derived(spark, sf_dir, "d_tags")
    listed = tags.where("run_id is not null and fluid <> ''").select("sheet_id", "pid_idx", F.concat(F.col("fluid"), F.lit("."), F.col("pclass")).alias("code"))
    return registers.line_register(listed, tags)


LINE_REGISTER = f"""{with_('d_tags')}, j AS (SELECT *, CASE WHEN run_id IS NOT NULL AND fluid <> '' THEN fluid || '.' || pclass END AS c FROM d_tags)
SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY c NULLS LAST, pid, pid_idx) AS line_no, coalesce(c, '-') AS code, pid, fluid, pclass, pid_idx FROM j"""


def symbol_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols numbered per class in reading order."""
    return registers.symbol_register(derived(spark, sf_dir, "d_boxes"))


SYMBOL_REGISTER = f"{with_('d_boxes')} SELECT sheet_id, coarse, row_number() OVER (PARTITION BY sheet_id, coarse ORDER BY y1, x1, box_id) AS item_no, box_id FROM d_boxes"


def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols per class, the most frequent first."""
    return registers.counts(derived(spark, sf_dir, "d_boxes"), "coarse")


SYMBOL_COUNTS = f"{with_('d_boxes')} SELECT sheet_id, coarse, count(*) AS n, row_number() OVER (PARTITION BY sheet_id ORDER BY count(*) DESC, coarse) AS rank FROM d_boxes GROUP BY sheet_id, coarse"


def yolo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of boxes."""
    return registers.yolo_labels(derived(spark, sf_dir, "d_boxes"), 512, 512, ["equipment", "valve"]).select("sheet_id", "box_id", "cls", "label")


YOLO_LABELS = f"""{with_('d_boxes')} SELECT sheet_id, box_id, CASE coarse WHEN 'equipment' THEN 0 ELSE 1 END AS cls, printf('%d %.6f %.6f %.6f %.6f', CASE coarse WHEN 'equipment' THEN 0 ELSE 1 END, (x1 + x2) / 2 / 512, (y1 + y2) / 2 / 512, (x2 - x1) / 512, (y2 - y1) / 512) AS label
FROM d_boxes WHERE coarse IN ('equipment', 'valve')"""


def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of an image pyramid per sheet."""
    sheets = derived(spark, sf_dir, "d_sheets").select("sheet_id", (F.lit(900) + F.col("sheet_id") % 40 * 37).alias("width"), (F.lit(600) + F.col("sheet_id") % 40 * 11).alias("height"))
    return registers.tiles(sheets).groupBy("sheet_id", "level").agg(F.count("*").alias("n_tiles"))


TILE_INDEX = """WITH s AS (SELECT page_id AS sheet_id, 900 + page_id % 40 * 37 AS w, 600 + page_id % 40 * 11 AS h FROM pages), t AS (SELECT *, cast(ceil(log2(greatest(w, h))) AS int) AS top FROM s), l AS (SELECT *, unnest(range(0, top + 1)) AS level FROM t)
SELECT sheet_id, cast(level AS int) AS level, cast(ceil(ceil(w / pow(2, top - level)) / 256) * ceil(ceil(h / pow(2, top - level)) / 256) AS bigint) AS n_tiles FROM l"""


def opc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between sheets from their off-page connectors."""
    opcs = derived(spark, sf_dir, "d_opcs")
    return topology.edges(opcs, derived(spark, sf_dir, "d_sheets"), opcs.select("sheet_id", F.col("piping_id").alias("pid")))


_DRAW = "upper(regexp_replace(regexp_replace(upper(trim(coalesce({0}, ''))), '\\.(PNG|JPG|JPEG|PDF)$', ''), '[\\s_\\-]', '', 'g'))"
OPC_EDGES = f"""{with_('d_sheets', 'd_opcs')}, refs AS (SELECT ref, arg_max(sheet_id, (sheet_number, filename, sheet_id)) AS s FROM (SELECT *, unnest([{_DRAW.format('sheet_number')}, {_DRAW.format('filename')}]) AS ref FROM d_sheets) WHERE ref <> '' GROUP BY ref),
home AS (SELECT DISTINCT piping_id, o.sheet_id, sheet_number, filename FROM d_opcs o JOIN d_sheets USING (sheet_id)),
o AS (SELECT d.*, coalesce(a.s, b.s, (SELECT arg_min(h.sheet_id, (h.sheet_number, h.filename, h.sheet_id)) FROM home h WHERE h.piping_id = d.piping_id AND h.sheet_id <> d.sheet_id)) AS target FROM d_opcs d
  LEFT JOIN refs a ON {_DRAW.format('d.target_sheet_number')} = a.ref AND a.s <> d.sheet_id LEFT JOIN refs b ON {_DRAW.format('d.target_drawing')} = b.ref AND b.s <> d.sheet_id),
back AS (SELECT sheet_id AS target, piping_id, min(opc_id) AS target_opc FROM d_opcs GROUP BY ALL)
SELECT sheet_id AS source, target, opc_id, target_opc, piping_id, CASE WHEN target_opc IS NOT NULL THEN 0.95 ELSE 0.85 END::double AS confidence FROM (
  SELECT o.*, target_opc, row_number() OVER (PARTITION BY least(o.sheet_id, o.target), greatest(o.sheet_id, o.target), o.piping_id ORDER BY o.sheet_id, opc_id) AS k FROM o LEFT JOIN back USING (target, piping_id) WHERE target IS NOT NULL) WHERE k = 1"""


def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state of every job."""
    return progress.job_state(derived(spark, sf_dir, "d_progress"))


JOB_STATE = f"""{with_('d_progress')}, e AS (SELECT *, lower(message) AS m, least(CASE WHEN total > 0 THEN cast(round_even(100.0::double * current / total, 0) AS int) ELSE 0 END, 100) AS own FROM d_progress),
p AS (SELECT *, CASE WHEN contains(m, 'ocr') THEN 'ocr_tiled' WHEN contains(m, 'symbol') OR contains(m, 'equipment') THEN 'symbol_detection' WHEN contains(m, 'tracing') OR contains(m, 'lines') THEN 'line_tracing' WHEN contains(m, 'tags') THEN 'association' WHEN contains(m, 'system') THEN 'grouping' WHEN contains(m, 'completed') THEN 'completed' WHEN contains(m, 'failed') THEN 'failed' ELSE 'processing' END AS step,
  CASE WHEN contains(m, 'ocr') THEN own WHEN contains(m, 'symbol') OR contains(m, 'equipment') THEN 65 WHEN contains(m, 'tracing') OR contains(m, 'lines') THEN 80 WHEN contains(m, 'tags') THEN 85 WHEN contains(m, 'system') THEN 95 WHEN contains(m, 'completed') OR contains(m, 'failed') THEN 100 ELSE own END AS pct FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY step IN ('completed', 'failed') DESC, ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY job_id) AS n_events FROM p)
SELECT job_id, step, pct, CASE WHEN step IN ('completed', 'failed') THEN step WHEN m = 'queued' THEN 'queued' ELSE 'processing' END AS status, n_events FROM l WHERE k = 1"""


def _kept(order: str, hit: str) -> str:
    """SQL that walks the boxes of every sheet in an order and keeps those that hit none kept before (k: kept, o: own)."""
    return f"""{with_('d_boxes')}, a AS (SELECT *, (x2 - x1) * (y2 - y1) AS size FROM d_boxes), o AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY {order}) AS n FROM a),
w AS (SELECT sheet_id, n, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'size': size, 'box_id': box_id, 'score': score}}] AS kept FROM o WHERE n = 1 UNION ALL
  SELECT o.sheet_id, o.n, CASE WHEN len(list_filter(w.kept, lambda k: {hit})) = 0 THEN list_append(w.kept, {{'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2, 'size': o.size, 'box_id': o.box_id, 'score': o.score}}) ELSE w.kept END FROM w JOIN o ON o.sheet_id = w.sheet_id AND o.n = w.n + 1),
l AS (SELECT sheet_id, unnest(arg_max(kept, n)) AS b FROM w GROUP BY 1)"""


_SHARED = "(greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1)))"


def box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that survive non-maximum suppression."""
    return greedy.nms(derived(spark, sf_dir, "d_boxes"), 0.3).select("sheet_id", "box_id", "score")


BOX_NMS = f"{_kept('score DESC, box_id', f'{_SHARED} / (k.size + o.size - {_SHARED} + 1e-9) > 0.3')} SELECT sheet_id, b.box_id AS box_id, b.score AS score FROM l"


def box_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of overlapping equipment boxes (rounds of components; tests hold it against brute force)."""
    return greedy.merge_boxes(derived(spark, sf_dir, "d_boxes").where("coarse = 'equipment'"))


def box_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of instrument boxes at most four pixels apart (rounds of components; tests hold it against brute force)."""
    return greedy.merge_boxes(derived(spark, sf_dir, "d_boxes").where("coarse = 'instrument'"), gap=4)


def box_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes not held by a larger one."""
    return greedy.suppress_nested(derived(spark, sf_dir, "d_boxes")).select("sheet_id", "box_id")


BOX_NESTED = f"{_kept('size DESC, box_id', f'o.size > 0 AND {_SHARED} / o.size > 0.55')} SELECT sheet_id, b.box_id AS box_id FROM l"


def tag_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of labels clustered around running means."""
    rows = derived(spark, sf_dir, "d_tags").select("sheet_id", "pid_idx", F.regexp_replace("pid", r"-\d+$", "").alias("pid"), "x", "y", F.col("conf").alias("weight"))
    return greedy.cluster_tags(rows, 150.0)


TAG_CLUSTERS = f"""{with_('d_tags')}, o AS (SELECT sheet_id, pid_idx, regexp_replace(pid, '-\\d+$', '') AS pid, x, y, conf, row_number() OVER (PARTITION BY sheet_id ORDER BY conf DESC, pid_idx) AS k FROM d_tags),
w AS (SELECT sheet_id, k, [{{'x': x::double, 'y': y::double, 'n': 1}}] AS c, 1::bigint AS home FROM o WHERE k = 1 UNION ALL
  SELECT sheet_id, k, CASE WHEN h = 0 THEN list_append(c, {{'x': x::double, 'y': y::double, 'n': 1}}) ELSE list_transform(c, lambda g, i: CASE WHEN i = h THEN {{'x': g.x + x, 'y': g.y + y, 'n': g.n + 1}} ELSE g END) END, CASE WHEN h = 0 THEN len(c) + 1 ELSE h END
  FROM (SELECT o.sheet_id, o.k, w.c, o.x, o.y, coalesce(list_position(list_transform(w.c, lambda g: abs(o.x - g.x / g.n) <= 150 AND abs(o.y - g.y / g.n) <= 150), true), 0) AS h FROM w JOIN o ON o.sheet_id = w.sheet_id AND o.k = w.k + 1)),
m AS (SELECT o.*, home FROM o JOIN w USING (sheet_id, k)), v AS (SELECT sheet_id, home, pid, sum(conf) AS votes, min(k) AS met FROM m GROUP BY ALL),
t AS (SELECT sheet_id, home, pid, row_number() OVER (PARTITION BY sheet_id, home ORDER BY votes DESC, len(pid) DESC, met) AS r FROM v)
SELECT sheet_id, t.pid, quantile_cont(x::double, 0.5) AS x, quantile_cont(y::double, 0.5) AS y, cast(sum(conf) AS int) AS conf FROM m JOIN t USING (sheet_id, home) WHERE r = 1 GROUP BY sheet_id, home, t.pid HAVING sum(conf) >= 2"""


QUERIES = {f.__name__: f for f in (systems, circuits, project_circuits, tag_dedup, tag_dedup_simple, fluid_suspects, review, validation_report, line_register, symbol_register, symbol_counts, yolo_labels, tile_index, opc_edges, job_state, box_nms, box_merge, box_gaps, box_nested, tag_clusters)}
SQL = {
    "systems": SYSTEMS, "circuits": CIRCUITS, "project_circuits": PROJECT_CIRCUITS, "tag_dedup": TAG_DEDUP, "tag_dedup_simple": TAG_DEDUP_SIMPLE, "fluid_suspects": FLUID_SUSPECTS, "review": REVIEW, "validation_report": VALIDATION_REPORT,
    "line_register": LINE_REGISTER, "symbol_register": SYMBOL_REGISTER, "symbol_counts": SYMBOL_COUNTS, "yolo_labels": YOLO_LABELS, "tile_index": TILE_INDEX, "opc_edges": OPC_EDGES, "job_state": JOB_STATE,
    "box_nms": BOX_NMS, "box_nested": BOX_NESTED, "tag_clusters": TAG_CLUSTERS,
}
