"""Queries on tag texts, line-list cells, line lists and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.functions import measures, tags
from isoline.operators import linelist, metrics
from isoline.plans.derive import derived, with_
from isoline.session import table

_A, _B = (s.pattern for s in tags.SCHEMAS)
_L = tags.LOOSE


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def tag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, match and parse damaged tag texts; the three line keys."""
    raw = derived(spark, sf_dir, "d_raw_tags").withColumn("norm", tags.normalise(F.col("raw"))).withColumn("m", tags.read(F.col("norm")))
    fields = [F.coalesce(F.col(f"m.fields.{f}"), F.lit("")).alias(f) for f in tags.FIELDS]
    return raw.select("l_orderkey", "l_linenumber", "raw", "norm", "m.pid", "m.weight", *fields, tags.key_a(F.col("raw")).alias("key_a"), tags.key_b(F.col("raw")).alias("key_b"), tags.key_c(F.col("raw")).alias("key_c"))


_NORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(upper(raw), '”″’‘''`!|', '\"\"\"\"\"\"11'), '\\s+', '', 'g'), '[^A-Z0-9\"/]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
_FIX = f"translate(regexp_extract(norm, {_q(_L)}, 3), '{tags.FLUID_REPAIR[0]}', '{tags.FLUID_REPAIR[1]}')"
_FIXSEQ = f"translate(regexp_extract(norm, {_q(_L)}, 5), '{tags.SEQ_REPAIR[0]}', '{tags.SEQ_REPAIR[1]}')"
_LOOSE_OK = f"regexp_matches(norm, {_q(_L)}) AND regexp_matches({_FIX}, '^[A-Z]{{1,4}}$') AND regexp_matches({_FIXSEQ}, '^\\d{{1,3}}[A-Z]?$')"
_SHAPE = "regexp_matches(norm, '^\\d{2,4}-') AND len(string_split(norm, '-')) >= 4 AND regexp_matches(norm, '[A-Z]{2,}') AND (contains(norm, '\"') OR regexp_matches(string_split(norm, '-')[-1], '\\d'))"


def _field(name: str) -> str:
    a, b = (s.groups[name] for s in tags.SCHEMAS)
    return f"CASE WHEN regexp_matches(coalesce(pid, ''), {_q(_A)}) THEN regexp_extract(pid, {_q(_A)}, {a}) WHEN regexp_matches(coalesce(pid, ''), {_q(_B)}) THEN regexp_extract(pid, {_q(_B)}, {b}) ELSE '' END AS {name}"


TAG_PARSE = f"""{with_('d_raw_tags')}, n AS (SELECT *, {_NORM} AS norm FROM d_raw_tags), m AS (
  SELECT *, CASE WHEN regexp_matches(norm, {_q(_A)}) THEN regexp_extract(norm, {_q(_A)}, 0) WHEN regexp_matches(norm, {_q(_B)}) THEN regexp_extract(norm, {_q(_B)}, 0)
    WHEN {_LOOSE_OK} THEN regexp_extract(norm, {_q(_L)}, 1) || '-' || regexp_extract(norm, {_q(_L)}, 2) || '"-' || {_FIX} || '-' || regexp_extract(norm, {_q(_L)}, 4) || '-' || {_FIXSEQ} || regexp_extract(norm, {_q(_L)}, 6)
    WHEN {_SHAPE} THEN norm END AS pid,
    CASE WHEN regexp_matches(norm, {_q(_A)}) OR regexp_matches(norm, {_q(_B)}) THEN 3 WHEN ({_LOOSE_OK}) OR ({_SHAPE}) THEN 1 END AS weight FROM n)
SELECT l_orderkey, l_linenumber, raw, norm, pid, weight, {', '.join(_field(f) for f in tags.FIELDS)}, upper(regexp_replace(raw, '[" ]', '', 'g')) AS key_a, upper(regexp_replace(raw, '[\\s"''\\-_]', '', 'g')) AS key_b,
  replace(regexp_replace(upper(trim(raw)), '"|''''|”|’|\\s+', '', 'g'), '--', '-') AS key_c FROM m"""


def clean_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with units, phases and texts of typed cells."""
    c = derived(spark, sf_dir, "d_cells")
    return c.select("event_id", measures.number(F.col("number_cell")).alias("number"), measures.phase(F.col("phase_cell")).alias("phase"), measures.text(F.col("text_cell")).alias("text"))


CLEAN_MEASURES = f"""{with_('d_cells')}
SELECT event_id, CASE WHEN lower(s) NOT IN ('', '-', '--', 'n/a', 'na', 'none', 'null', 'nil', 'nan') THEN try_cast(nullif(regexp_extract(s, '^[-+]?[0-9]*\\.?[0-9]+'), '') AS double) END AS number,
  CASE WHEN p IN ('L', 'LIQ', 'LIQUID') THEN 'L' WHEN p IN ('G', 'GAS', 'V', 'VAP', 'VAPOR', 'STEAM') THEN 'G' WHEN p IN ('2P', '2-PHASE', '2 PHASE', 'TWO PHASE', 'MIX', 'MIXED') THEN '2P' ELSE p END AS phase,
  CASE WHEN lower(t) IN ('none', 'nan', 'null', 'nil') THEN '' ELSE t END AS text
FROM (SELECT event_id, replace(trim(number_cell), ',', '.') AS s, upper(trim(coalesce(phase_cell, ''))) AS p, trim(coalesce(text_cell, '')) AS t FROM d_cells)"""


def linelist_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First value that is there, per field and line."""
    rows = derived(spark, sf_dir, "d_line_list")
    return linelist.merge_entries(rows, "row_no", ("operating_pressure", "operating_temperature"), ("fluid_phase", "corrosion_loop"))


_MERGED = """SELECT upper(regexp_replace(line_number, '[\\s"''\\-_]', '', 'g')) AS line_key, arg_min(line_number, row_no) AS line_number,
  arg_min(operating_pressure, row_no) FILTER (operating_pressure IS NOT NULL) AS operating_pressure, arg_min(operating_temperature, row_no) FILTER (operating_temperature IS NOT NULL) AS operating_temperature,
  coalesce(arg_min(fluid_phase, row_no) FILTER (fluid_phase <> ''), '') AS fluid_phase, coalesce(arg_min(corrosion_loop, row_no) FILTER (corrosion_loop <> ''), '') AS corrosion_loop, count(*) AS n_rows
  FROM d_line_list GROUP BY 1 HAVING line_key <> ''"""
LINELIST_MERGE = f"{with_('d_line_list')} {_MERGED}"


def _line_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.concat(F.lit("l"), F.lpad((F.col("o_custkey") % 5000).cast("string"), 4, "0")).alias("pid"), F.lit("").alias("fluid_phase"), F.lit("").alias("corrosion_loop"), (F.col("o_orderkey") % 9).cast("double").alias("operating_pressure"), F.lit(None).cast("double").alias("operating_temperature"))


def linelist_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with what the line list says of them."""
    fields = {c: c for c in ("operating_pressure", "operating_temperature", "fluid_phase", "corrosion_loop")}
    return linelist.enrich(_line_tags(spark, sf_dir), linelist_merge(spark, sf_dir), fields)


LINELIST_ENRICH = f"""{with_('d_line_list')}, merged AS ({_MERGED})
SELECT o_orderkey, pid, coalesce(nullif(m.fluid_phase, ''), '') AS fluid_phase, coalesce(nullif(m.corrosion_loop, ''), '') AS corrosion_loop, coalesce(m.operating_pressure, cast(o_orderkey % 9 AS double)) AS operating_pressure, m.operating_temperature, m.line_key IS NOT NULL AS matched
FROM (SELECT o_orderkey, 'l' || lpad(cast(o_custkey % 5000 AS varchar), 4, '0') AS pid FROM orders) t LEFT JOIN merged m ON upper(regexp_replace(t.pid, '[\\s"''\\-_]', '', 'g')) = m.line_key"""


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise agreement of two partitions of documents, per language."""
    d = table(spark, sf_dir, "documents").select("lang", "source", (F.col("n_chars") % 7).alias("bin"))
    return metrics.agreement(d, ("lang",), "source", "bin")


AGREEMENT = """WITH d AS (SELECT lang, source, n_chars % 7 AS bin FROM documents), c AS (SELECT lang, source, bin, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT lang, sum(n) AS n_items, sum(n * (n - 1) // 2) AS together FROM c GROUP BY lang), a AS (SELECT lang, sum(n * (n - 1) // 2) AS sa FROM (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) GROUP BY lang),
b AS (SELECT lang, sum(n * (n - 1) // 2) AS sb FROM (SELECT lang, bin, sum(n) AS n FROM c GROUP BY ALL) GROUP BY lang)
SELECT lang, cast(n_items AS bigint) AS n_items, cast(n_items * (n_items - 1) // 2 AS bigint) AS n_pair, cast(n_items * (n_items - 1) // 2 - sa - sb + 2 * together AS bigint) AS agree, cast(sa - together AS bigint) AS first_only, cast(sb - together AS bigint) AS second_only,
  CASE WHEN n_items > 1 THEN 100.0::double * cast(n_items * (n_items - 1) // 2 - sa - sb + 2 * together AS bigint) / cast(n_items * (n_items - 1) // 2 AS bigint) ELSE 0.0 END AS pct FROM x JOIN a USING (lang) JOIN b USING (lang)"""


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of long documents as a sign of quality, per language."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.precision_recall(d.select("lang", (F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 900).alias("found")), "truth", "found", ("lang",))


PRECISION_RECALL = """WITH n AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 900) AS tp, count(*) FILTER (quality <> 1 AND n_chars > 900) AS fp, count(*) FILTER (quality = 1 AND NOT n_chars > 900) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM n"""


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of document length as a score of quality, per language."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "doc_id", "n_chars", (F.col("quality") == 1).alias("tp"))
    gt = d.groupBy("lang").agg(F.count_if("tp").alias("n_gt"))
    return metrics.average_precision(d, "lang", "n_chars", "doc_id", "tp", gt).select("lang", F.bround("ap50", 9).alias("ap50"), "recall", "n_gt")


AVERAGE_PRECISION = """WITH d AS (SELECT lang, doc_id, n_chars, cast(quality = 1 AS int) AS tp FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, sum(tp) OVER w / count(*) OVER w AS p, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, max(p) OVER (PARTITION BY lang ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS best FROM r), g AS (SELECT lang, sum(tp) AS n_gt FROM d GROUP BY lang)
SELECT lang, round_even(CASE WHEN n_gt > 0 THEN coalesce(sum(best) FILTER (tp = 1), 0) / n_gt ELSE 0 END, 9) AS ap50, CASE WHEN n_gt > 0 THEN cast(sum(tp) AS double) / n_gt ELSE 0 END AS recall, cast(n_gt AS bigint) AS n_gt FROM e JOIN g USING (lang) GROUP BY lang, n_gt"""


def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text filter over several fields."""
    from isoline.operators.filters import contains_text

    return contains_text(table(spark, sf_dir, "part"), "Gear", ["p_name", "p_type", "p_brand"]).select("p_partkey", "p_name", "p_type", "p_brand")


TEXT_FILTER = "SELECT p_partkey, p_name, p_type, p_brand FROM part WHERE lower(p_name) LIKE '%gear%' OR lower(p_type) LIKE '%gear%' OR lower(p_brand) LIKE '%gear%'"


def snap_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units one digit off the drawing's most frequent unit."""
    from isoline.operators.grouping import snap_units as snap

    raw = derived(spark, sf_dir, "d_raw_tags").withColumn("m", tags.match(tags.normalise(F.col("raw")))).where("m is not null")
    rows = raw.select((F.col("l_orderkey") % 300).alias("sheet_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid_idx"), F.regexp_replace("m.pid", r"^(\d)\d+-", "$14$1-").alias("pid"), F.col("m.weight").alias("weight"))
    return snap(rows)


SNAP_UNITS = TAG_PARSE[: TAG_PARSE.rindex("SELECT l_orderkey")] + """, r AS (SELECT l_orderkey % 300 AS sheet_id, l_orderkey * 10 + l_linenumber AS pid_idx, regexp_replace(pid, '^(\\d)\\d+-', '\\14\\1-') AS pid, weight FROM m WHERE pid IS NOT NULL),
v AS (SELECT sheet_id, split_part(pid, '-', 1) AS unit, count(*) AS n, min(pid_idx) AS f FROM r WHERE weight >= 3 GROUP BY ALL), t AS (SELECT sheet_id, unit AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY n DESC, f) AS k FROM v) WHERE k = 1)
SELECT sheet_id, pid_idx, CASE WHEN u <> dominant AND abs(len(dominant) - len(u)) <= 1 AND (ends_with(dominant, u) OR ends_with(u, dominant)) THEN dominant || substr(pid, len(u) + 1) ELSE pid END AS pid, weight
FROM (SELECT r.*, dominant, split_part(pid, '-', 1) AS u FROM r LEFT JOIN t USING (sheet_id))"""

QUERIES = {f.__name__: f for f in (tag_parse, clean_measures, linelist_merge, linelist_enrich, agreement, precision_recall, average_precision, text_filter, snap_units)}
SQL = {"tag_parse": TAG_PARSE, "clean_measures": CLEAN_MEASURES, "linelist_merge": LINELIST_MERGE, "linelist_enrich": LINELIST_ENRICH, "agreement": AGREEMENT, "precision_recall": PRECISION_RECALL, "average_precision": AVERAGE_PRECISION, "text_filter": TEXT_FILTER, "snap_units": SNAP_UNITS}
