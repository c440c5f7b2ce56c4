"""Queries on listings, names, shapes and choices between boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.functions import colors as colours
from isoline.functions import naming
from isoline.operators import filters, metrics, shapes
from isoline.operators import listings as ordered
from isoline.plans.derive import derived, with_
from isoline.plans.geometry_queries import _ADJACENCY, adjacency
from isoline.session import table
from isoline.streaming import progress


def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty most recent jobs: the limit is the listing's own."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("sheet_id"), F.col("o_orderdate").alias("created_at"))
    return progress.latest_jobs(jobs).select("job_id", "sheet_id")


LATEST_JOBS = "SELECT o_orderkey AS job_id, o_custkey AS sheet_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50"


def latest_per_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest job of every sheet."""
    return progress.latest_per_sheet(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("sheet_id"), F.col("o_orderdate").alias("created_at")))


LATEST_PER_SHEET = "SELECT o_custkey AS sheet_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS job_id FROM orders GROUP BY 1"


def sheet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of each project in order of number and file."""
    s = derived(spark, sf_dir, "d_sheets").withColumn("project_id", F.col("sheet_id") % 7)
    return ordered.sheets_by_number(s).select("project_id", "sheet_id", "place")


SHEET_ORDER = f"{with_('d_sheets')} SELECT sheet_id % 7 AS project_id, sheet_id, row_number() OVER (PARTITION BY sheet_id % 7 ORDER BY sheet_number, filename) AS place FROM d_sheets"


def dominant_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent colour along a pipe; of equals the first seen."""
    v = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5000).alias("run_id"), (F.col("l_partkey") % 4).alias("color"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return metrics.dominant_vote(v, ("run_id",), "color", "pos")


DOMINANT_COLORS = """WITH v AS (SELECT l_orderkey % 5000 AS run_id, l_partkey % 4 AS color, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2)
SELECT run_id, arg_max(color, (n, -f, color)) AS color, max(n) AS n_votes FROM v GROUP BY run_id"""


def median_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median of box widths per sheet and class."""
    return derived(spark, sf_dir, "d_boxes").groupBy("sheet_id", "coarse").agg(F.percentile(F.expr("x2 - x1"), 0.5).alias("median_width"))


MEDIAN_WIDTH = f"{with_('d_boxes')} SELECT sheet_id, coarse, quantile_cont((x2 - x1)::double, 0.5) AS median_width FROM d_boxes GROUP BY ALL"


def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of connections against those whose two pipes share a parity of customers."""
    e = metrics.boundary_edges(adjacency(spark, sf_dir), "b", "a")
    found = e.select(((F.col("lo") + F.col("hi")) % 3 != 0).alias("truth"), ((F.col("lo") + F.col("hi")) % 5 != 0).alias("found"))
    return metrics.precision_recall(found, "truth", "found")


BOUNDARY_SCORES = f"""{with_('d_runs', 'd_boxes')}, n AS (SELECT count(*) FILTER ((a + b) % 3 <> 0 AND (a + b) % 5 <> 0) AS tp, count(*) FILTER ((a + b) % 3 = 0 AND (a + b) % 5 <> 0) AS fp, count(*) FILTER ((a + b) % 3 <> 0 AND (a + b) % 5 = 0) AS fn FROM ({_ADJACENCY}))
SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM n"""


def fine_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valve box that fits every equipment box best."""
    b = derived(spark, sf_dir, "d_boxes")
    return shapes.best_match(b.where("coarse = 'equipment'"), b.where("coarse = 'valve'"), 0.25).select("sheet_id", "box_id", "other_id", F.bround("iou", 9).alias("iou"))


FINE_CLASSES = f"""{with_('d_boxes')}, p AS (SELECT a.sheet_id, a.box_id, b.box_id AS other_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM d_boxes a JOIN d_boxes b ON a.sheet_id = b.sheet_id AND a.coarse = 'equipment' AND b.coarse = 'valve')
SELECT sheet_id, box_id, other_id, round_even(iou, 9) AS iou FROM (SELECT *, i::double / (s - i) AS iou, row_number() OVER (PARTITION BY box_id ORDER BY i::double / (s - i) DESC, other_id) AS k FROM p WHERE i::double / (s - i) > 0.25) WHERE k = 1"""


def swallowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes whose centre lies in no equipment."""
    b = derived(spark, sf_dir, "d_boxes")
    return shapes.swallow(b.where("coarse <> 'equipment'"), b.where("coarse = 'equipment'")).select("sheet_id", "box_id")


SWALLOWED = f"{with_('d_boxes')} SELECT sheet_id, box_id FROM d_boxes a WHERE coarse <> 'equipment' AND NOT EXISTS (SELECT 1 FROM d_boxes b WHERE b.coarse = 'equipment' AND b.sheet_id = a.sheet_id AND (a.x1 + a.x2) / 2 BETWEEN b.x1 AND b.x2 AND (a.y1 + a.y2) / 2 BETWEEN b.y1 AND b.y2)"


def equipment_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text nearest to every equipment box."""
    texts = derived(spark, sf_dir, "d_points").select("sheet_id", "x", "y", F.expr("if(point_id % 5 = 0, 'note', concat('P-', point_id))").alias("text"))
    return shapes.nearest_text(derived(spark, sf_dir, "d_boxes").where("coarse = 'equipment'"), texts, "^P-", 150.0)


EQUIPMENT_TAGS = f"""{with_('d_boxes', 'd_points')}, t AS (SELECT sheet_id, x, y, 'P-' || point_id AS text FROM d_points WHERE point_id % 5 <> 0), p AS (SELECT b.sheet_id, box_id, text, abs((x1 + x2) / 2 - x) + abs((y1 + y2) / 2 - y) AS d FROM d_boxes b JOIN t ON b.sheet_id = t.sheet_id AND coarse = 'equipment')
SELECT sheet_id, box_id, arg_min(text, (d, text)) AS text FROM p WHERE d <= 150 GROUP BY ALL"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File stems, cache keys and measured variables."""
    s = derived(spark, sf_dir, "d_sheets")
    return s.select("sheet_id", naming.safe_stem(F.concat(F.lit("in/dir/"), F.col("filename"))).alias("stem"), naming.cache_key(F.col("filename"), F.lit(None).cast("string"), F.col("sheet_number")).alias("key"), naming.describe_instrument(F.expr("substr('FLPTXyz', cast(sheet_id % 7 + 1 as int), 1) || 'IC'")).alias("measures"))


NAMES = f"""{with_('d_sheets')} SELECT sheet_id, replace(regexp_replace(filename, '\\.[^.]*$', ''), '.', '_') AS stem, sha256(filename || '||' || sheet_number) AS key,
  CASE substr('FLPTXyz', cast(sheet_id % 7 + 1 AS int), 1) WHEN 'F' THEN 'Flow Indicating Controller' WHEN 'L' THEN 'Level Indicating Controller' WHEN 'P' THEN 'Pressure Indicating Controller' WHEN 'T' THEN 'Temperature Indicating Controller' WHEN 'X' THEN 'Multivariable instrument' WHEN 'z' THEN 'Position instrument' ELSE 'Instrument' END AS measures FROM d_sheets"""


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour arithmetic."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.format_string("#%06x", (F.col("p_partkey") * 7919) % 16777216).alias("c"))
    rgb = colours.hex_to_rgb(F.col("c"))
    return p.select("p_partkey", colours.shade(rgb, 0.5)[0].alias("light"), colours.shade(rgb, -0.4)[1].alias("dark"), F.bround(colours.distance(rgb, F.array(F.lit(150), F.lit(20), F.lit(160))), 6).alias("distance"))


COLORS = """WITH c AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part), r AS (SELECT p_partkey, v // 65536 AS r, v // 256 % 256 AS g, v % 256 AS b FROM c)
SELECT p_partkey, cast(floor(r + (255 - r) * 0.5::double) AS int) AS light, cast(floor(g * (1 + -0.4::double)) AS int) AS dark,
  round_even(sqrt((2 + (r + 150) / 2 / 256) * pow(r - 150, 2) + 4 * pow(g - 20, 2) + (2 + (255 - (r + 150) / 2) / 256) * pow(b - 160, 2)), 6) AS distance FROM r"""


def enriched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found anew reach only marked pipes without a label."""
    r = derived(spark, sf_dir, "d_runs")
    current = r.select("sheet_id", "run_id", F.expr("run_id % 3 = 0").alias("marked"), F.expr("if(run_id % 4 = 0, 'own', '')").alias("label"), F.lit("old").alias("pid"))
    found = r.where("run_id % 5 <> 0").select("sheet_id", "run_id", F.lit("new").alias("pid"))
    return filters.merge_enrichment(current, found).select("sheet_id", "run_id", "pid")


ENRICHED_NAMES = f"{with_('d_runs')} SELECT sheet_id, run_id, CASE WHEN run_id % 3 = 0 AND run_id % 4 <> 0 AND run_id % 5 <> 0 THEN 'new' ELSE 'old' END AS pid FROM d_runs"


def page_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading tier of pages by their paths."""
    return filters.tier(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 211 + F.col("l_linenumber") * 1000).alias("page_id"), (F.col("l_quantity") > 25).alias("has_line")))


PAGE_TIERS = "SELECT l_suppkey % 211 + l_linenumber * 1000 AS page_id, CASE WHEN count(*) < 50 THEN 'raster' WHEN count(*) FILTER (l_quantity > 25) >= 50 THEN 'A1' ELSE 'A2' END AS tier FROM lineitem GROUP BY 1"


def drawing_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawing that each source file's key starts or lies in."""
    src = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("605-42-PID-1-"), F.format_string("%03d", F.col("n_nationkey"))).alias("key"))
    stems = derived(spark, sf_dir, "d_sheets").select(F.concat(F.lit("BCD3-605-42-PID-1-"), F.col("sheet_number"), F.expr("if(sheet_id % 2 = 0, '-REV', '')")).alias("stem")).distinct()
    return metrics.match_stems(src, stems)


DRAWING_MATCHES = f"""{with_('d_sheets')}, s AS (SELECT n_nationkey, '605-42-PID-1-' || lpad(cast(n_nationkey AS varchar), 3, '0') AS key FROM nation), t AS (SELECT DISTINCT 'BCD3-605-42-PID-1-' || sheet_number || CASE WHEN sheet_id % 2 = 0 THEN '-REV' ELSE '' END AS stem FROM d_sheets)
SELECT n_nationkey, key, arg_min(stem, (abs(len(stem) - len(key)), stem)) AS stem FROM s LEFT JOIN t ON contains(stem, key) GROUP BY ALL"""

QUERIES = {f.__name__: f for f in (latest_jobs, latest_per_sheet, sheet_order, dominant_colors, median_width, boundary_scores, fine_classes, swallowed, equipment_tags, names, colors, enriched_names, page_tiers, drawing_matches)}
SQL = {
    "latest_jobs": LATEST_JOBS, "latest_per_sheet": LATEST_PER_SHEET, "sheet_order": SHEET_ORDER, "dominant_colors": DOMINANT_COLORS, "median_width": MEDIAN_WIDTH, "boundary_scores": BOUNDARY_SCORES, "fine_classes": FINE_CLASSES, "swallowed": SWALLOWED,
    "equipment_tags": EQUIPMENT_TAGS, "names": NAMES, "colors": COLORS, "enriched_names": ENRICHED_NAMES, "page_tiers": PAGE_TIERS, "drawing_matches": DRAWING_MATCHES,
}
