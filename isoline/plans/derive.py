"""Plant-shaped tables derived from the driver's tables, as SQL text that Spark and DuckDB read alike.

The driver's tables hold no pipes, so every query of the plant operators runs on rows made deterministically from
orders, parts, events and pages. Names start with d_ to say that the rows are derived. Geometry is in whole pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isoline.session import table

#: Codes of the derived plant.
FLUIDS = ("GF", "GT", "GR", "LO", "DO", "AI", "VRE", "CWS")
CLASSES = ("CCB", "CDA", "ASA", "DSA", "CPA", "CDE", "ACC", "DSE", "APA", "CCC")


def _pick(codes: tuple[str, ...], k: str) -> str:
    """SQL for the code at a position counted from 0."""
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(codes)) + " END"


pick = _pick


#: One pipe per order, 100 to a sheet: a horizontal or vertical segment.
RUNS = """
SELECT cast(floor(o_orderkey / 100) as bigint) AS sheet_id, o_orderkey AS run_id, x1, y1,
  CASE WHEN o_orderkey % 2 = 0 THEN x1 + n ELSE x1 END AS x2, CASE WHEN o_orderkey % 2 = 0 THEN y1 ELSE y1 + n END AS y2,
  CASE WHEN o_orderkey % 2 = 0 THEN 'H' ELSE 'V' END AS axis
FROM (SELECT o_orderkey, o_custkey, cast((o_orderkey * 7919 + o_custkey * 31) % 1600 as bigint) AS x1, cast((o_orderkey * 104729 + o_custkey * 17) % 1100 as bigint) AS y1, cast(40 + (o_orderkey * 131) % 260 as bigint) AS n FROM orders)
"""

#: One tag per order; it names its own pipe, but every third and every eleventh names none.
TAGS = f"""
SELECT cast(floor(o_orderkey / 100) as bigint) AS sheet_id, o_orderkey AS pid_idx,
  cast(cast(600 + floor(o_orderkey / 1000) % 90 as bigint) as string) || '-' || cast(1 + o_custkey % 12 as string) || '"-' || {_pick(FLUIDS, "o_custkey % 8")} || '-' || {_pick(CLASSES, "(o_custkey * 7 + o_orderkey % 3) % 10")} || '-' || lpad(cast(o_orderkey % 1000 as string), 3, '0') AS pid,
  CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE {_pick(FLUIDS, "o_custkey % 8")} END AS fluid, {_pick(CLASSES, "(o_custkey * 7 + o_orderkey % 3) % 10")} AS pclass,
  CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS run_id,
  CASE WHEN o_orderstatus = 'F' THEN 'L' WHEN o_orderstatus = 'O' THEN 'G' ELSE '' END AS fluid_phase,
  CASE WHEN o_orderkey % 17 = 0 THEN 'CL-' || cast(o_custkey % 5 as string) ELSE '' END AS corrosion_loop,
  CASE WHEN o_orderkey % 29 = 0 THEN 'TITANIUM' ELSE '' END AS material,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(o_orderkey * 13 % 4000 as double) / 8 END AS operating_temperature,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(o_orderkey * 11 % 640 as double) / 16 END AS operating_pressure,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_custkey % 13 as double) / 4 END AS corrosion_allowance,
  cast(1 + o_orderkey % 4 as int) AS conf, cast((o_orderkey * 7919 + o_custkey * 31) % 1600 as bigint) + 20 AS x, cast((o_orderkey * 104729 + o_custkey * 17) % 1100 as bigint) - 6 AS y
FROM orders
"""

#: Raw texts of tags with the damage that text recognition does.
RAW_TAGS = f"""
SELECT l_orderkey, l_linenumber, CASE cast(l_partkey % 9 as int)
  WHEN 0 THEN tag WHEN 1 THEN lower(tag) WHEN 2 THEN replace(tag, '"', '''') WHEN 3 THEN replace(tag, '-', ' - ')
  WHEN 4 THEN unit || '-' || size || '-' || fluid || '-' || pclass || '-' || 'O' || substr(seq, 2, 2)
  WHEN 5 THEN unit || '-P' || cast(l_linenumber % 9 as string) || '-1' || seq || '-A1A2-' || size || '"-H-50'
  WHEN 6 THEN unit || '-X-' || seq WHEN 7 THEN unit || '_' || size || '!2"_' || substr(fluid, 1, 1) || '0_' || pclass || '_' || seq ELSE unit || '-' || fluid || '-' || seq || '-Q9-7' END AS raw
FROM (SELECT *, unit || '-' || size || '"-' || fluid || '-' || pclass || '-' || seq AS tag FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, cast(100 + l_suppkey % 800 as string) AS unit, cast(1 + l_partkey % 12 as string) AS size,
    {_pick(FLUIDS, "l_partkey % 8")} AS fluid, {_pick(CLASSES, "l_suppkey % 10")} AS pclass, lpad(cast(l_orderkey % 1000 as string), 3, '0') AS seq FROM lineitem))
"""

#: Cells of line lists as they are typed.
CELLS = """
SELECT event_id, user_id, CASE cast(event_id % 8 as int)
  WHEN 0 THEN cast(cast(floor(value * 10) as bigint) as string) || '.5 barg' WHEN 1 THEN ' ' || cast(cast(floor(value) as bigint) as string) || ',25 C'
  WHEN 2 THEN '-' WHEN 3 THEN 'N/A' WHEN 4 THEN '-' || cast(cast(floor(value) as bigint) as string) WHEN 5 THEN '.75 kg' WHEN 6 THEN 'approx ' || cast(cast(floor(value) as bigint) as string) ELSE 'NaN' END AS number_cell,
  CASE cast(event_id % 7 as int) WHEN 0 THEN ' liq ' WHEN 1 THEN 'Steam' WHEN 2 THEN 'two phase' WHEN 3 THEN 'slurry' WHEN 4 THEN '' WHEN 5 THEN 'v' ELSE NULL END AS phase_cell,
  CASE cast(event_id % 6 as int) WHEN 0 THEN ' none ' WHEN 1 THEN 'NaN' WHEN 2 THEN 'hot insulated' WHEN 3 THEN NULL WHEN 4 THEN ' p ' ELSE 'nil' END AS text_cell,
  event_type FROM events
"""

#: Line-list rows: several per line number, with blanks, four in ten all blank; row_no gives their order.
LINE_LIST = """
SELECT o_orderkey % 4000 AS line_no, o_orderkey AS row_no, 'L ' || lpad(cast(o_orderkey % 4000 as string), 4, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '"' ELSE '-' END AS line_number,
  CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 10 >= 6 THEN NULL ELSE cast(o_custkey % 500 as double) / 4 END AS operating_pressure,
  CASE WHEN o_orderkey % 4 = 1 OR o_orderkey % 10 >= 6 THEN NULL ELSE cast(o_custkey % 333 as double) / 2 END AS operating_temperature,
  CASE WHEN o_orderkey % 5 < 2 OR o_orderkey % 10 >= 6 THEN '' ELSE substr('LG', cast(1 + o_custkey % 2 as int), 1) END AS fluid_phase,
  CASE WHEN o_orderkey % 6 < 3 OR o_orderkey % 10 >= 6 THEN '' ELSE 'CL-' || cast(o_custkey % 7 as string) END AS corrosion_loop
FROM orders
"""

#: Points to be put on pipes, one per order.
POINTS = """
SELECT cast(floor(o_orderkey / 100) as bigint) AS sheet_id, o_orderkey AS point_id, cast((o_orderkey * 613 + o_custkey) % 1600 as bigint) AS x, cast((o_orderkey * 1021 + o_custkey * 3) % 1100 as bigint) AS y
FROM orders
"""

#: Boxes with scores and classes, from order rows.
BOXES = """
SELECT cast(floor(o_orderkey / 100) as bigint) AS sheet_id, o_orderkey AS box_id, x1, y1, x1 + 20 + o_orderkey % 60 AS x2, y1 + 20 + o_custkey % 60 AS y2, cast(1 + (o_orderkey * 37) % 997 as double) / 1000 AS score,
  CASE o_orderkey % 3 WHEN 0 THEN 'valve' WHEN 1 THEN 'equipment' ELSE 'instrument' END AS coarse
FROM (SELECT o_orderkey, o_custkey, cast((o_orderkey * 271 + o_custkey) % 500 as bigint) AS x1, cast((o_orderkey * 883 + o_custkey * 5) % 400 as bigint) AS y1 FROM orders)
"""

#: Progress messages of jobs, from events.
PROGRESS = """
SELECT event_id, user_id AS job_id, ts, CASE cast(event_id % 9 as int) WHEN 0 THEN 'queued' WHEN 1 THEN 'Reading text (OCR) tile' WHEN 2 THEN 'Detecting symbols' WHEN 3 THEN 'Tracing lines'
  WHEN 4 THEN 'Associating tags' WHEN 5 THEN 'Grouping systems' WHEN 6 THEN 'completed' WHEN 7 THEN 'failed' ELSE 'Loading drawing' END AS message,
  cast(event_id % 40 as int) AS current, cast(event_id % 3 * 20 as int) AS total FROM events
"""

#: Sheets and off-page connectors.
SHEETS = """
SELECT page_id AS sheet_id, lpad(cast(page_id % 1000 as string), 3, '0') AS sheet_number, 'BCD3-605-42-PID-1-' || lpad(cast(page_id as string), 5, '0') || '.pdf' AS filename FROM pages
"""
OPCS = f"""
SELECT page_id AS sheet_id, page_id * 10 + k AS opc_id, CASE WHEN (page_id + k) % 3 = 0 THEN '' ELSE lpad(cast((page_id * 3 + k) % 1000 as string), 3, '0') END AS target_sheet_number,
  CASE WHEN (page_id + k) % 4 = 1 THEN 'bcd3 605_42-pid-1-' || lpad(cast((page_id + 7 * k) % 700 as string), 5, '0') ELSE '' END AS target_drawing,
  '605-6"-' || {_pick(FLUIDS, "(page_id + k) % 8")} || '-CCB-' || lpad(cast((page_id * 5 + k) % 400 as string), 3, '0') AS piping_id
FROM pages CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2)
"""

#: Corners of polylines, k from 0: straight, bent, slanting, zigzag, nearly closed, curved and long slanting ones.
VERTICES = """
SELECT sheet_id, run_id, k, x1 + CASE shape WHEN 0 THEN 60 * k WHEN 1 THEN 80 * least(k, 1) WHEN 2 THEN n + 3 * k * n WHEN 3 THEN 30 * k WHEN 4 THEN CASE k WHEN 1 THEN 70 WHEN 2 THEN 70 WHEN 4 THEN 5 ELSE 0 END WHEN 5 THEN 20 * k ELSE 120 * k END AS x,
  y1 + CASE shape WHEN 0 THEN 0 WHEN 1 THEN 40 * greatest(k - 1, 0) WHEN 2 THEN 3 * k * n - n WHEN 3 THEN 45 * (k % 2) WHEN 4 THEN CASE k WHEN 2 THEN 70 WHEN 3 THEN 70 WHEN 4 THEN 10 ELSE 0 END WHEN 5 THEN 2 * k * k ELSE 90 * k END AS y
FROM (SELECT cast(floor(o_orderkey / 100) as bigint) AS sheet_id, o_orderkey AS run_id, o_orderkey % 7 AS shape, 1 + o_custkey % 17 AS n,
    cast((o_orderkey * 7919 + o_custkey * 31) % 1600 as bigint) AS x1, cast((o_orderkey * 104729 + o_custkey * 17) % 1300 as bigint) AS y1 FROM orders) r
  CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) v
WHERE k < CASE shape WHEN 0 THEN 2 + run_id % 3 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 8 WHEN 4 THEN 5 WHEN 5 THEN 9 ELSE 3 END
"""

#: Strokes of drawings: of eight in a row two level pieces, an upright one, a bar, an open valve's two arms, a table's
#: row and an arm of a cross.
SEGMENTS = """
SELECT sheet_id, seg_id, CASE kind WHEN 0 THEN bx WHEN 1 THEN bx + 130 WHEN 2 THEN bx + 200 WHEN 3 THEN bx + 60 WHEN 4 THEN bx + 300 WHEN 5 THEN bx + 300 WHEN 6 THEN gx ELSE gx + 400 END AS x1,
  CASE kind WHEN 2 THEN cy - 80 WHEN 3 THEN cy - 6 WHEN 4 THEN cy + 10 WHEN 5 THEN cy + 10 WHEN 6 THEN gy + 8 * r WHEN 7 THEN gy ELSE cy END AS y1,
  CASE kind WHEN 0 THEN bx + 120 WHEN 1 THEN bx + 260 WHEN 2 THEN bx + 200 WHEN 3 THEN bx + 60 WHEN 4 THEN bx + 294 WHEN 5 THEN bx + 306 WHEN 6 THEN gx + 150 + r ELSE gx + 400 + CASE WHEN r % 2 = 0 THEN 8 ELSE -8 END END AS x2,
  CASE kind WHEN 2 THEN cy + 80 WHEN 3 THEN cy + 6 + b % 2 WHEN 4 THEN cy + 2 WHEN 5 THEN cy + 2 + b % 4 WHEN 6 THEN gy + 8 * r WHEN 7 THEN gy + CASE WHEN r < 2 THEN 7 ELSE -7 END ELSE cy END AS y2
FROM (SELECT sheet_id, seg_id, kind, b, b % 4 AS r, (b * 797) % 1500 AS bx, (b * 1049) % 1000 + 100 AS cy, (g * 563) % 1200 AS gx, (g * 337) % 900 + 50 AS gy FROM (
  SELECT cast(floor(o_orderkey / 100) as bigint) AS sheet_id, o_orderkey AS seg_id, o_orderkey % 8 AS kind, cast(floor(o_orderkey / 8) as bigint) AS b, cast(floor(o_orderkey / 32) as bigint) AS g FROM orders) i) j
"""

DERIVED = {"d_segs": SEGMENTS, "d_vertices": VERTICES, "d_runs": RUNS, "d_tags": TAGS, "d_raw_tags": RAW_TAGS, "d_cells": CELLS, "d_line_list": LINE_LIST, "d_points": POINTS, "d_boxes": BOXES, "d_progress": PROGRESS, "d_sheets": SHEETS, "d_opcs": OPCS}
_FROM = {"d_segs": "orders", "d_vertices": "orders", "d_runs": "orders", "d_tags": "orders", "d_raw_tags": "lineitem", "d_cells": "events", "d_line_list": "orders", "d_points": "orders", "d_boxes": "orders", "d_progress": "events", "d_sheets": "pages", "d_opcs": "pages"}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    base = _FROM[name]
    text = DERIVED[name].replace(f"FROM {base}", f"FROM {{{base}}}")
    return spark.sql(text, **{base: table(spark, sf_dir, base)})


def with_(*names: str) -> str:
    """The WITH clause that defines derived tables in DuckDB."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({DERIVED[n]})" for n in names)
