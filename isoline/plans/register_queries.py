"""Queries on registers, names, reports, topology, listings and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.functions import colors, geometry, naming, tags
from isoline.operators import breaks, filters, greedy, grouping, linelist, metrics, propagation, registers, topology, tracing, validation
from isoline.operators import listings as ordered
from isoline.plans import line_queries as lines
from isoline.plans.derive import CLASSES, derived, pick, with_
from isoline.plans.geometry_queries import _ADJACENCY, adjacency
from isoline.plans.graph_queries import _LABELS, propagation_by_sheet
from isoline.session import cut, shared_path, table
from isoline.sources import linelists
from isoline.streaming import progress


def _cases(values: dict[str, str], c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


#: Codes of instruments and what was typed beside symbols, by box.
_CODES = (*list(naming.INSTRUMENTS)[::4], "QT", "PX", "x", "")
_CODE = pick(_CODES, f"box_id % {len(_CODES)}")
_SUB = "CASE box_id % 7 WHEN 0 THEN ' Ball Valve ' WHEN 1 THEN 'Gate Valve' WHEN 3 THEN '610 - V - 202A' WHEN 5 THEN 'Big drum' ELSE '' END"


def _symbols(spark: SparkSession, sf_dir: str, coarse: str) -> DataFrame:
    b = derived(spark, sf_dir, "d_boxes").where(F.col("coarse") == coarse)
    return b.select("sheet_id", "box_id", "x1", "y1", "x2", "y2", F.expr(_SUB).alias("subtype"), F.expr(_CODE).alias("func"), F.expr("cast(100 + box_id % 90 as string)").alias("loop"), F.expr("if(box_id % 4 = 0, concat('610-', substr('VDTCEKPFRHSBXQ', cast(box_id % 14 + 1 as int), 1), '-20'), '')").alias("tag"), F.expr("if(box_id % 9 = 0, 'read', '')").alias("desc"))


def instrument_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments numbered from the top, with tag and description."""
    units = derived(spark, sf_dir, "d_tags").select("sheet_id", "pid_idx", F.substring_index("pid", "-", 1).alias("unit"))
    return registers.instrument_register(_symbols(spark, sf_dir, "instrument"), units)


INSTRUMENT_REGISTER = f"""{with_('d_boxes', 'd_tags')}, u AS (SELECT sheet_id, split_part(pid, '-', 1) AS unit, count(*) AS n, min(pid_idx) AS f FROM d_tags GROUP BY ALL), t AS (SELECT sheet_id, arg_max(unit, (n, -f)) AS unit FROM u GROUP BY 1),
b AS (SELECT *, {_CODE} AS func FROM d_boxes WHERE coarse = 'instrument')
SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY y1, x1, box_id) AS no, CASE WHEN func = '' THEN '(not read)' ELSE unit || '-' || func || '-' || (100 + box_id % 90) END AS tag, CASE WHEN func = '' THEN '(not read)' ELSE func END AS func,
  CASE WHEN func = '' THEN 'Instrument' ELSE coalesce({_cases(naming.INSTRUMENTS, 'upper(func)')}, {_cases(naming.MEASURED, 'upper(substr(func, 1, 1))')} || ' instrument', 'Instrument') END AS "desc", (x1 + x2) // 2 AS x, (y1 + y2) // 2 AS y FROM b LEFT JOIN t USING (sheet_id)"""


def equipment_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipment numbered from the top, with what was read or typed."""
    return registers.equipment_register(_symbols(spark, sf_dir, "equipment"))


EQUIPMENT_REGISTER = f"""{with_('d_boxes')}, b AS (SELECT *, trim({_SUB}) AS typed, CASE WHEN box_id % 4 = 0 THEN '610-' || substr('VDTCEKPFRHSBXQ', cast(box_id % 14 + 1 AS int), 1) || '-20' ELSE '' END AS tag, CASE WHEN box_id % 9 = 0 THEN 'read' ELSE '' END AS d FROM d_boxes WHERE coarse = 'equipment')
SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY y1, x1, box_id) AS no, CASE WHEN tag <> '' THEN tag WHEN typed LIKE '610%' THEN '610-V-202A' ELSE '(not read)' END AS tag, CASE WHEN d <> '' THEN d WHEN typed <> '' AND typed NOT LIKE '610%' THEN typed ELSE 'Equipment' END AS "desc",
  CASE WHEN typed = '' THEN 'detected' ELSE 'manual' END AS source, (x1 + x2) // 2 AS x, (y1 + y2) // 2 AS y FROM b"""


def valve_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valves per class and sheet, the most frequent first."""
    return registers.counts(registers.valve_items(_symbols(spark, sf_dir, "valve")), "type")


VALVE_REGISTER = f"""{with_('d_boxes')}, b AS (SELECT sheet_id, coalesce(nullif(trim({_SUB}), ''), 'Other valve') AS type FROM d_boxes WHERE coarse = 'valve')
SELECT sheet_id, type, count(*) AS n, row_number() OVER (PARTITION BY sheet_id ORDER BY count(*) DESC, type) AS rank FROM b GROUP BY sheet_id, type"""


def _breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived(spark, sf_dir, "d_points")
    return p.select("sheet_id", F.col("point_id").alias("cp_id"), F.expr("if(point_id % 4 = 0, null, point_id)").alias("run_id"), F.expr(pick(CLASSES, "point_id % 10")).alias("code_a"), F.expr(pick(CLASSES, "(point_id + 3) % 10")).alias("code_b"), "x", "y")


_BREAKS = f"brk AS (SELECT sheet_id, point_id AS cp_id, CASE WHEN point_id % 4 = 0 THEN NULL ELSE point_id END AS run_id, {pick(CLASSES, 'point_id % 10')} AS code_a, {pick(CLASSES, '(point_id + 3) % 10')} AS code_b, x, y FROM d_points)"


def break_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spec breaks of every sheet."""
    return registers.break_register(_breaks(spark, sf_dir))


BREAK_REGISTER = f"{with_('d_points')}, {_BREAKS} SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY cp_id) AS no, code_a || ' | ' || code_b AS codes, CASE WHEN run_id IS NULL THEN 'no' ELSE 'yes' END AS attached, x, y FROM brk"


def barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of spec breaks per pipe of ten."""
    b = _breaks(spark, sf_dir).withColumn("run_id", F.expr("run_id div 10"))
    return breaks.barriers(b).select("sheet_id", "run_id", F.size("points").alias("n"), F.col("points")[0].x.alias("x"), F.element_at("points", -1).y.alias("y"))


BARRIERS = f"""{with_('d_points')}, {_BREAKS} SELECT sheet_id, run_id // 10 AS run_id, count(*) AS n, arg_min(x, (x, y)) AS x, arg_max(y, (x, y)) AS y FROM brk WHERE run_id IS NOT NULL GROUP BY sheet_id, run_id // 10"""


def register_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each register table per sheet."""
    c = cut(lines.circuits(spark, sf_dir), "circuits")
    parts = {"Equipment": _symbols(spark, sf_dir, "equipment"), "Valve": _symbols(spark, sf_dir, "valve"), "Piping line": derived(spark, sf_dir, "d_tags"), "Corrosion system": registers.system_register(c), "Corrosion circuit": c, "Connection point": _breaks(spark, sf_dir)}
    return registers.register_summary(parts)


REGISTER_SUMMARY = f"""{with_('d_boxes', 'd_tags', 'd_points')}, {lines._CIRCUITS}, {_BREAKS}, r AS (SELECT sheet_id, 'Equipment' AS item FROM d_boxes WHERE coarse = 'equipment' UNION ALL SELECT sheet_id, 'Valve' FROM d_boxes WHERE coarse = 'valve' UNION ALL SELECT sheet_id, 'Piping line' FROM d_tags
  UNION ALL SELECT DISTINCT sheet_id, 'Corrosion system' || fluid FROM circ UNION ALL SELECT sheet_id, 'Corrosion circuit' FROM circ UNION ALL SELECT sheet_id, 'Connection point' FROM brk),
kk AS (SELECT unnest(['Equipment', 'Valve', 'Piping line', 'Corrosion system', 'Corrosion circuit', 'Connection point']) AS item), s AS (SELECT DISTINCT sheet_id FROM r) SELECT s.sheet_id, kk.item, (SELECT count(*) FROM r WHERE r.sheet_id = s.sheet_id AND starts_with(r.item, kk.item)) AS n FROM s CROSS JOIN kk"""


def system_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrosion systems with their lines, pipes, circuits and classes."""
    return registers.system_register(lines.circuits(spark, sf_dir))


SYSTEM_REGISTER = f"""{with_('d_tags')}, {lines._CIRCUITS}, c AS (SELECT *, unnest(string_split(classes, ',')) AS cl FROM circ), l AS (SELECT sheet_id, fluid, string_agg(DISTINCT cl, ', ' ORDER BY cl) AS classes FROM c WHERE cl <> '' GROUP BY ALL),
a AS (SELECT sheet_id, '#' || split_part(code, '.', 1) AS code, fluid, cast(sum(n_tags) AS bigint) AS n_lines, cast(sum(n_pipes) AS bigint) AS n_pipes, count(*) AS n_circuits FROM circ GROUP BY ALL) SELECT a.*, coalesce(classes, '') AS classes FROM a LEFT JOIN l USING (sheet_id, fluid)"""


def circuit_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrosion circuits with their classes and lines."""
    return registers.circuit_register(lines.circuits(spark, sf_dir))


CIRCUIT_REGISTER = f"{with_('d_tags')}, {lines._CIRCUITS} SELECT sheet_id, code, fluid, coalesce(nullif(material, ''), '-') AS material, replace(classes, ',', ', ') AS classes, n_tags AS n_lines FROM circ"


def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function and loop number of instrument bubbles, mended by a second look."""
    b = derived(spark, sf_dir, "d_boxes").where("coarse = 'instrument'")
    first = b.select("sheet_id", "box_id", F.explode(F.expr("array(named_struct('y', 0, 't', if(box_id % 5 = 0, 'pi - 129', 'Pt')), named_struct('y', 5, 't', cast(1000 + box_id % 400 as string)), named_struct('y', 9, 't', 'NOTE 7 B'))")).alias("e"))
    closer = b.select("sheet_id", "box_id", F.explode(F.expr("array(named_struct('y', 0, 't', 'LT'), named_struct('y', 5, 't', cast(1000 + box_id % 400 - 1000 + 100 as string)))")).alias("e"))
    one, two = (registers.read_bubbles(x.select("sheet_id", "box_id", F.lit(0).alias("x"), F.col("e.y").alias("y"), F.col("e.t").alias("text"))) for x in (first, closer))
    return registers.mend_loops(one, two)


BUBBLES = f"""{with_('d_boxes')}, b AS (SELECT sheet_id, box_id, CASE WHEN box_id % 5 = 0 THEN 'PI' ELSE 'PT' END AS func, CASE WHEN box_id % 5 = 0 THEN '129' ELSE cast(1000 + box_id % 400 AS varchar) END AS loop, cast(100 + box_id % 400 AS varchar) AS again FROM d_boxes WHERE coarse = 'instrument')
SELECT sheet_id, box_id, func, CASE WHEN len(loop) >= 4 AND ends_with(loop, again) THEN again ELSE loop END AS loop FROM b"""


def typed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lenient reading of damaged tags."""
    r = derived(spark, sf_dir, "d_raw_tags")
    return r.select("l_orderkey", "l_linenumber", tags.parse_typed(F.col("raw")).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _typed(f: str) -> str:
    out = f"g.{f}"
    for pattern, groups in reversed(tags.TYPED):
        own = f"regexp_extract(s, {_q(pattern)}, {groups[f]})"
        out = f"CASE WHEN regexp_matches(s, {_q(pattern)}) THEN {'upper(' + own + ')' if f in ('fluid', 'pclass') else own} ELSE {out} END"
    return f"{out} AS {f}"


_M = {n: f"regexp_matches(x, {_q(p)})" for n, p in (("size", tags.SIZE_PART), ("fluid", tags.FLUID_PART), ("pclass", tags.CLASS_PART), ("seq", tags.SEQ_PART), ("unit", tags.UNIT_PART))}
_SIZE = f"(contains(x, '\"') OR ({_M['size']} AND g.size = '' AND k > 1))"
_FLU = f"(NOT {_SIZE} AND {_M['fluid']} AND g.fluid = '')"
_CLS = f"(NOT {_SIZE} AND NOT {_FLU} AND {_M['pclass']} AND g.pclass = '')"
_SEQ = f"(NOT {_SIZE} AND NOT {_FLU} AND NOT {_CLS} AND {_M['seq']} AND g.seq = '')"
_UNI = f"(NOT {_SIZE} AND NOT {_FLU} AND NOT {_CLS} AND NOT {_SEQ} AND {_M['unit']} AND g.unit = '' AND k = 1)"
_INCHES = '"' * 6
TYPED_TAGS = f"""{with_('d_raw_tags')}, n AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, regexp_replace(translate(trim(raw), '”″’‘''`', '{_INCHES}'), '\\s+', '', 'g') AS s FROM d_raw_tags), p AS (SELECT *, list_filter(string_split(s, '-'), lambda x: x <> '') AS xs FROM n),
w AS (SELECT id, 0 AS k, xs, {{'unit': '', 'size': '', 'fluid': '', 'pclass': '', 'seq': ''}} AS g FROM p UNION ALL SELECT id, k, xs, {{'unit': CASE WHEN {_UNI} THEN x ELSE g.unit END, 'size': CASE WHEN {_SIZE} AND g.size = '' THEN x ELSE g.size END,
  'fluid': CASE WHEN {_FLU} THEN upper(x) ELSE g.fluid END, 'pclass': CASE WHEN {_CLS} THEN upper(x) ELSE g.pclass END, 'seq': CASE WHEN {_SEQ} THEN x ELSE g.seq END}} FROM (SELECT id, k + 1 AS k, xs, g, xs[k + 1] AS x FROM w WHERE k < len(xs))),
l AS (SELECT id, g FROM w WHERE k = len(xs)) SELECT l_orderkey, l_linenumber, {', '.join(_typed(f) for f in tags.FIELDS)} FROM n JOIN l USING (id)"""


def learned_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of formats that an example has taught."""
    known = spark.createDataFrame([], "n_tokens int, field string, idx int")
    known = tags.teach(known, "100-X-001", {"unit": 0, "fluid": 1, "seq": 2})
    r = derived(spark, sf_dir, "d_raw_tags").select("l_orderkey", "l_linenumber", tags.normalise(F.col("raw")).alias("pid"))
    return tags.parse_learned(r, known).select("l_orderkey", "l_linenumber", *tags.FIELDS)


_PA, _PB = (x.pattern for x in tags.SCHEMAS)


def _learned(f: str, at: int | None) -> str:
    a, b = (x.groups[f] for x in tags.SCHEMAS)
    other = "''" if at is None else f"CASE WHEN len(ts) = 3 THEN ts[{at + 1}] ELSE '' END"
    return f"CASE WHEN regexp_matches(norm, {_q(_PA)}) THEN regexp_extract(norm, {_q(_PA)}, {a}) WHEN regexp_matches(norm, {_q(_PB)}) THEN regexp_extract(norm, {_q(_PB)}, {b}) ELSE {other} END AS {f}"


def _norm_sql() -> str:
    from isoline.plans.text_queries import _NORM

    return _NORM


LEARNED_TAGS = f"""{with_('d_raw_tags')}, n AS (SELECT l_orderkey, l_linenumber, {_norm_sql()} AS norm FROM d_raw_tags), t AS (SELECT *, list_filter(string_split(norm, '-'), lambda x: x <> '') AS ts FROM n)
SELECT l_orderkey, l_linenumber, {', '.join(_learned(f, {'unit': 0, 'fluid': 1, 'seq': 2}.get(f)) for f in tags.FIELDS)} FROM t"""


def coarse_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse class, kind of equipment and identity of files."""
    names = (*naming.COARSE, *naming.COARSE_NAMES, "Gate", "unknown")
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(pick(names, f"p_partkey % {len(names)}")).alias("name"))
    tag = F.expr("concat('610-', substr('VDTCEKPFRHSBXQ', cast(p_partkey % 14 + 1 as int), 1), '-202')")
    return p.select("p_partkey", naming.coarse_of(F.col("name")).alias("coarse"), naming.describe_equipment(tag).alias("kind"), naming.describe_equipment(F.col("name")).alias("none"), naming.etag(F.col("name"), F.col("p_partkey"), F.lit(7)).alias("etag"), naming.display_class(F.expr("if(p_partkey % 3 = 0, ' x ', null)"), naming.coarse_of(F.col("name"))).alias("shown"))


_NAMES = (*naming.COARSE, *naming.COARSE_NAMES, "Gate", "unknown")
_COARSE = f"coalesce({_cases(naming.COARSE | {c: c for c in naming.COARSE_NAMES}, 'name')}, 'other')"
COARSE_CLASSES = f"""WITH p AS (SELECT p_partkey, {pick(_NAMES, f'p_partkey % {len(_NAMES)}')} AS name FROM part)
SELECT p_partkey, {_COARSE} AS coarse, coalesce({_cases(naming.EQUIPMENT, "substr('VDTCEKPFRHSBXQ', cast(p_partkey % 14 + 1 AS int), 1)")}, 'Equipment') AS kind, '' AS none, substr(sha256(name || '|' || p_partkey || '|7'), 1, 32) AS etag,
  CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE coalesce({_cases(naming.OTHER, _COARSE)}, 'Other') END AS shown FROM p"""


def fluid_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of all fluids, each far from those before it."""
    f = derived(spark, sf_dir, "d_tags").where("fluid <> ''").groupBy("fluid").agg(F.min("pid_idx").alias("place"))
    return colors.choose(f, spark.createDataFrame([("GF", 2)], "fluid string, n int"))


_PAL = "[" + ", ".join(f"[{r}, {g}, {b}]" for r, g, b in colors.palette()) + "]"
_FAR = "sqrt((2 + (p[1] + u[1]) / 2 / 256) * pow(p[1] - u[1], 2) + 4 * pow(p[2] - u[2], 2) + (2 + (255 - (p[1] + u[1]) / 2) / 256) * pow(p[3] - u[3], 2))"
FLUID_COLORS = f"""{with_('d_tags')}, pal AS (SELECT k - 1 AS n, {_PAL}[k] AS p FROM range(1, {colors.TRIED + 1}) t(k)), f AS (SELECT fluid, row_number() OVER (ORDER BY min(pid_idx), fluid) AS k FROM d_tags WHERE fluid NOT IN ('', 'GF') GROUP BY fluid),
w AS (SELECT 0::bigint AS k, [{{'fluid': 'GF', 'n': 2::bigint}}] AS used UNION ALL SELECT f.k, list_append(w.used, {{'fluid': f.fluid, 'n': (SELECT coalesce(min(n) FILTER (away >= {colors.ALIKE * colors.PLENTY}), arg_max(n, (away, -n))) FROM (SELECT pal.n, list_min(list_transform(w.used, lambda z: list_extract(list_transform([{_PAL}[z.n + 1]], lambda u: {_FAR}), 1))) AS away FROM pal WHERE NOT list_contains(list_transform(w.used, lambda z: z.n), pal.n)))}}) FROM w JOIN f ON f.k = w.k + 1)
SELECT unnest(used).fluid AS fluid, unnest(used).n AS n FROM (SELECT used FROM w ORDER BY k DESC LIMIT 1)"""


def linelist_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line lists from CSV files, whose headers and units are a contractor's, merged per line."""
    rows = derived(spark, sf_dir, "d_line_list").withColumn("part", F.lit(0))
    cells = rows.select("row_no", F.col("line_number").alias("Line No."), F.concat(F.col("operating_pressure").cast("string"), F.lit(" barg")).alias("Oper. Press"), F.col("operating_temperature").cast("string").alias("Oprt Temp (C)"), F.col("fluid_phase").alias("Phase"), F.col("corrosion_loop").alias("Corr. Loop"))
    path = shared_path(spark, "line-lists")
    # one line list is one document, in the order of its rows
    cells.coalesce(1).sortWithinPartitions("row_no").drop("row_no").write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="")
    return linelist.merge_entries(linelists.read_csv(spark, f"{path}/*.csv"), "row_no", ("operating_pressure_barg", "operating_temperature_c"), ("fluid_phase", "corrosion_loop"))


def _merged_sql() -> str:
    from isoline.plans.text_queries import _MERGED

    return _MERGED.replace("AS operating_pressure,", "AS operating_pressure_barg,").replace("AS operating_temperature,", "AS operating_temperature_c,")


LINELIST_FILES = f"{with_('d_line_list')} {_merged_sql()}"


def grouping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six checks of the grouping of every sheet, on members of which a few are wrong."""
    t = derived(spark, sf_dir, "d_tags")
    labels = grouping.direct_labels(t).select("sheet_id", "run_id", "pclass")
    held = grouping.with_material(t.where("fluid <> ''"), grouping.material_spec(spark))
    members = held.select("sheet_id", "pid_idx", F.expr("if(pid_idx % 401 = 0, 'ZZ', fluid)").alias("system_fluid"), F.expr("if(pid_idx % 307 = 0, 'XX', effective_material)").alias("circuit_material"), "effective_material")
    members = members.unionByName(members.where("pid_idx % 203 = 0").withColumn("system_fluid", F.lit("YY")))
    systems = t.where("fluid <> ''").select("sheet_id", "fluid").distinct().withColumn("color", F.expr("if(sheet_id % 3 = 0, 'c', fluid)"))
    return validation.grouping(t, members, systems, _breaks(spark, sf_dir), labels)


_PCT = "CASE WHEN {1} > 0 THEN round_even(100.0::double * ({0}) / ({1}), 1) ELSE 100.0 END"
_GROUPING = f"""{_BREAKS}, spec0(c, m) AS (VALUES {lines._SPEC}), mem0 AS (SELECT sheet_id, pid_idx, fluid, CASE WHEN pid_idx % 401 = 0 THEN 'ZZ' ELSE fluid END AS sf, CASE WHEN pid_idx % 307 = 0 THEN 'XX' ELSE coalesce(nullif(upper(material), ''), m, substr(pclass, 2, 1)) END AS cm, coalesce(nullif(upper(material), ''), m, substr(pclass, 2, 1)) AS em FROM d_tags LEFT JOIN spec0 ON pclass = c WHERE fluid <> ''),
mem AS (SELECT * FROM mem0 UNION ALL SELECT sheet_id, pid_idx, fluid, 'YY', cm, em FROM mem0 WHERE pid_idx % 203 = 0), g1 AS (SELECT sheet_id, count(*) AS n, count(*) FILTER (fluid <> '') AS f FROM d_tags GROUP BY 1), g2 AS (SELECT sheet_id, count(*) FILTER (fluid <> sf) AS bf, count(*) FILTER (cm <> em) AS bm FROM mem GROUP BY 1),
g3 AS (SELECT sheet_id, count(*) FILTER (s > 1) AS dup, count(*) AS seen FROM (SELECT sheet_id, pid_idx, count(DISTINCT sf) AS s FROM mem GROUP BY ALL) GROUP BY 1), g4 AS (SELECT sheet_id, count(DISTINCT fluid) - count(DISTINCT CASE WHEN sheet_id % 3 = 0 THEN 'c' ELSE fluid END) AS clash FROM d_tags WHERE fluid <> '' GROUP BY 1),
g5 AS (SELECT b.sheet_id, count(*) AS met, count(*) FILTER (t.pclass IN (code_a, code_b)) AS ok FROM brk b JOIN d_tags t ON t.run_id = b.run_id AND t.sheet_id = b.sheet_id GROUP BY 1), gg AS (SELECT * FROM g1 LEFT JOIN g2 USING (sheet_id) LEFT JOIN g3 USING (sheet_id) LEFT JOIN g4 USING (sheet_id) LEFT JOIN g5 USING (sheet_id)),
grp AS (SELECT sheet_id, 'one_fluid' AS "check", CASE WHEN bf = 0 THEN 100.0 ELSE 0.0 END::double AS value, bf = 0 AS passed FROM gg UNION ALL SELECT sheet_id, 'partition', {_PCT.format('f - dup - (f - seen)', 'f')}, dup = 0 AND f = seen FROM gg UNION ALL SELECT sheet_id, 'one_material', CASE WHEN bm = 0 THEN 100.0 ELSE 0.0 END, bm = 0 FROM gg
  UNION ALL SELECT sheet_id, 'coverage', {_PCT.format('f', 'n')}, f = n FROM gg UNION ALL SELECT sheet_id, 'colors', CASE WHEN clash = 0 THEN 100.0 ELSE 0.0 END, clash = 0 FROM gg UNION ALL SELECT sheet_id, 'specbreak', {_PCT.format('ok', 'met')}, ok = met FROM gg WHERE met > 0)"""
GROUPING_REPORT = f"""{with_('d_tags', 'd_points')}, {_GROUPING} SELECT sheet_id, "check", value::double AS value, passed FROM grp"""


def marking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five checks of the marking of every sheet, on marks of which a few are wrong."""
    t = derived(spark, sf_dir, "d_tags").where("run_id is not null and fluid <> ''")
    runs = derived(spark, sf_dir, "d_runs").select("sheet_id", "run_id", F.greatest(F.expr("x2 - x1"), F.expr("y2 - y1")).alias("length"), F.expr("run_id % 53 = 0").alias("underline"))
    painted = t.select("sheet_id", F.expr("if(run_id % 211 = 0, -run_id, run_id)").alias("run_id"), "fluid", F.expr("if(run_id % 97 = 0, 'odd', fluid)").alias("color"))
    systems = t.select("sheet_id", "fluid", F.col("fluid").alias("color")).distinct()
    c = lines.circuits(spark, sf_dir).select("sheet_id", F.expr("if(sheet_id % 5 = 0, substr(code, 1, 2), code)").alias("code"), "fluid", F.expr("if(sheet_id % 4 = 0, material, concat(fluid, code))").alias("color"))
    return validation.marking(runs, painted, systems, c)


_MARKING = f"""{lines._CIRCUITS}, pt AS (SELECT sheet_id, CASE WHEN run_id % 211 = 0 THEN -run_id ELSE run_id END AS run_id, run_id % 97 = 0 AS odd FROM d_tags WHERE run_id IS NOT NULL AND fluid <> ''), m1 AS (SELECT sheet_id, count(DISTINCT run_id) AS n, count(*) FILTER (odd) AS odd, count(*) FILTER (run_id < 0) AS ghosts FROM pt GROUP BY 1),
m2 AS (SELECT r.sheet_id, sum(greatest(x2 - x1, y2 - y1)) AS total, coalesce(sum(greatest(x2 - x1, y2 - y1)) FILTER (EXISTS (SELECT 1 FROM pt WHERE pt.run_id = r.run_id)), 0) AS done FROM d_runs r WHERE run_id % 53 <> 0 GROUP BY 1),
m3 AS (SELECT sheet_id, cast(sum(n) AS bigint) AS clash FROM (SELECT sheet_id, fluid, count(*) - count(DISTINCT CASE WHEN sheet_id % 4 = 0 THEN material ELSE fluid || code END) AS n FROM circ GROUP BY ALL) GROUP BY 1), m4 AS (SELECT sheet_id, count(*) - count(DISTINCT CASE WHEN sheet_id % 5 = 0 THEN substr(code, 1, 2) ELSE code END) AS dup FROM circ GROUP BY 1),
m AS (SELECT s.sheet_id, coalesce(n, 0) AS n, coalesce(odd, 0) AS odd, coalesce(ghosts, 0) AS ghosts, coalesce(clash, 0) AS clash, coalesce(dup, 0) AS dup, total, done FROM (SELECT DISTINCT sheet_id FROM d_runs) s LEFT JOIN m1 USING (sheet_id) LEFT JOIN m2 USING (sheet_id) LEFT JOIN m3 USING (sheet_id) LEFT JOIN m4 USING (sheet_id)),
mrk AS (SELECT sheet_id, 'color_match' AS "check", {_PCT.format('n - odd', 'n')}::double AS value, odd = 0 AS passed FROM m UNION ALL SELECT sheet_id, 'refs', CASE WHEN ghosts = 0 THEN 100.0 ELSE 0.0 END, ghosts = 0 FROM m UNION ALL SELECT sheet_id, 'circuit_colors', CASE WHEN clash = 0 THEN 100.0 ELSE 0.0 END, clash = 0 FROM m
  UNION ALL SELECT sheet_id, 'legend', CASE WHEN dup = 0 THEN 100.0 ELSE 0.0 END, dup = 0 FROM m UNION ALL SELECT sheet_id, 'coverage', {_PCT.format('done', 'total')}, done >= 0.75 * total FROM m WHERE total > 0)"""
MARKING_REPORT = f"""{with_('d_tags', 'd_runs')}, {_MARKING} SELECT sheet_id, "check", value::double AS value, passed FROM mrk"""


def validation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of every sheet as one report."""
    return validation.combined(lines.validation_report(spark, sf_dir), grouping_report(spark, sf_dir), marking_report(spark, sf_dir))


VALIDATION_SCORE = f"""{with_('d_tags', 'd_runs', 'd_boxes', 'd_points')}, {lines._VALIDATION}, {_GROUPING}, {_MARKING}, every AS (SELECT sheet_id, round_even(CASE WHEN n_all > 0 THEN 100.0::double * n_ok / n_all ELSE 100.0 END, 1) AS value, n_ok = n_all AS passed FROM c UNION ALL SELECT sheet_id, value, passed FROM grp UNION ALL SELECT sheet_id, value, passed FROM mrk)
SELECT sheet_id, count(*) AS n_checks, count(*) FILTER (NOT passed) AS n_failed, round_even(avg(value::double), 1) AS score, count(*) FILTER (NOT passed) = 0 AS passed FROM every GROUP BY 1"""


def report_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that a report lists, twelve a sheet: the limit is the report's own."""
    equipment = derived(spark, sf_dir, "d_boxes").where("coarse = 'equipment'").select("sheet_id", "x1", "y1", "x2", "y2")
    found = validation.review(lines._suspect_tags(spark, sf_dir), equipment, lines._orphans(spark, sf_dir), _breaks(spark, sf_dir))
    return validation.first_flags(found).select("sheet_id", "kind", "subject", "place")


REPORT_FLAGS = f"""{with_('d_tags', 'd_runs', 'd_boxes', 'd_points')}, {lines._SUSPECT}, {_BREAKS}, i AS (SELECT sheet_id, pid_idx, EXISTS (SELECT 1 FROM d_boxes b WHERE b.coarse = 'equipment' AND b.sheet_id = s.sheet_id AND s.x BETWEEN b.x1 AND b.x2 AND s.y BETWEEN b.y1 AND b.y2) AS inside FROM s WHERE run_id IS NULL),
r AS (SELECT sheet_id, 0 AS kind_no, 'fluid_suspect' AS kind, fluid || '>' || suggest AS subject FROM sus UNION ALL SELECT sheet_id, CASE WHEN inside THEN 2 ELSE 1 END, CASE WHEN inside THEN 'pid_in_equipment' ELSE 'pid_none' END, cast(pid_idx AS varchar) FROM i
  UNION ALL SELECT sheet_id, 3, 'fluid_empty', cast(pid_idx AS varchar) FROM s WHERE run_id IS NOT NULL AND fluid = '' UNION ALL SELECT sheet_id, 4, 'cp_unattached', cast(cp_id AS varchar) FROM brk WHERE run_id IS NULL
  UNION ALL SELECT sheet_id, 5, 'orphan_run', cast(run_id AS varchar) FROM d_runs o WHERE greatest(x2 - x1, y2 - y1) >= 270 AND NOT EXISTS (SELECT 1 FROM d_tags t WHERE t.sheet_id = o.sheet_id AND t.run_id = o.run_id))
SELECT sheet_id, kind, subject, place FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY kind_no, subject) AS place FROM r) WHERE place <= 12"""


def merged_fluids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags after suspect codes are replaced."""
    t = lines._suspect_tags(spark, sf_dir)
    return validation.merge_fluids(t, validation.fluid_suspects(t)).select("sheet_id", "pid_idx", "fluid")


MERGED_FLUIDS = f"{with_('d_tags')}, {lines._SUSPECT} SELECT s.sheet_id, pid_idx, coalesce(suggest, s.fluid) AS fluid FROM s LEFT JOIN sus ON s.sheet_id = sus.sheet_id AND s.fluid = sus.fluid"


def spread_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems of all pipes that a label reaches along the pipes."""
    return grouping.systems(grouping.propagated_labels(derived(spark, sf_dir, "d_tags"), propagation_by_sheet(spark, sf_dir)))


SPREAD_SYSTEMS = f"""{with_('d_runs', 'd_tags', 'd_boxes')}, {_LABELS} SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY n_pipes DESC, fluid) AS system_no FROM (SELECT b.sheet_id, t.fluid, count(*) AS n_pipes FROM best b JOIN d_tags t ON t.pid_idx = b.source GROUP BY ALL)"""


def project_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and operating summary of project circuits."""
    t = grouping.with_material(derived(spark, sf_dir, "d_tags").where("fluid <> ''").drop("material").withColumn("material", F.lit("")), grouping.material_spec(spark))
    out = topology.circuit_members(t.drop("material").withColumnRenamed("effective_material", "material"))
    return out.withColumn("first", F.col("member_pids")[0]).withColumn("n_sheets", F.size("sheet_ids")).drop("member_pids", "sheet_ids")


PROJECT_MEMBERS = f"""{with_('d_tags')}, spec0(c, m) AS (VALUES {lines._SPEC}), k AS (SELECT * REPLACE (coalesce(m, substr(pclass, 2, 1)) AS material) FROM d_tags LEFT JOIN spec0 ON pclass = c WHERE fluid <> '')
SELECT fluid, material, fluid_phase, corrosion_loop, count(DISTINCT pid) AS n_members, round_even(avg(operating_temperature), 1) AS avg_temperature_c, round_even(avg(operating_pressure), 1) AS avg_pressure_barg, min(corrosion_allowance) AS corrosion_allowance_mm, min(pid) AS first, count(DISTINCT sheet_id) AS n_sheets FROM k GROUP BY ALL"""


def topology_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the project's topology."""
    return topology.nodes(derived(spark, sf_dir, "d_sheets"), lines.project_circuits(spark, sf_dir))


TOPOLOGY_NODES = f"""WITH RECURSIVE circuits_ AS ({lines.PROJECT_CIRCUITS.replace('WITH RECURSIVE', 'WITH')}), d_sheets AS ({with_('d_sheets').split('d_sheets AS (', 1)[1]}
SELECT cast(sheet_id AS varchar) AS id, 'sheet' AS type, coalesce(nullif(trim(sheet_number), ''), filename) AS label FROM d_sheets UNION ALL SELECT 'circ-' || code || '-' || fluid || '-' || material || '-' || fluid_phase || '-' || corrosion_loop, 'circuit', 'Circuit ' || code || ' (' || fluid || ' - ' || material || ')' FROM circuits_"""


def topology_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the project's topology."""
    return topology.summary(derived(spark, sf_dir, "d_sheets"), lines.opc_edges(spark, sf_dir), lines.project_circuits(spark, sf_dir))


TOPOLOGY_SUMMARY = f"""SELECT (SELECT count(*) FROM pages) AS total_sheets, (SELECT count(*) FROM ({lines.OPC_EDGES})) AS total_opc_edges, (SELECT count(*) FROM ({lines.PROJECT_CIRCUITS})) AS total_unified_circuits, (SELECT count(*) FROM ({lines.PROJECT_CIRCUITS}) WHERE n_sheets > 1) AS multi_sheet_circuits"""


def break_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of cut pipes that pass no label, and how many labels lie on each piece."""
    runs = derived(spark, sf_dir, "d_runs").select("sheet_id", "run_id", "x1", "y1", "x2", "y2")
    at = runs.select("sheet_id", "run_id", F.expr("x1 + (x2 - x1) div 3").alias("x"), F.expr("y1 + (y2 - y1) div 3").alias("y"))
    pieces = breaks.split_at_breaks(runs, at, 8.0)
    label = derived(spark, sf_dir, "d_tags").selectExpr("sheet_id", "pid_idx", "run_id", "x + pid_idx % 160 - 30 AS x1", "y - 8 AS y1", "x + pid_idx % 160 + 34 AS x2", "y + pid_idx % 90 AS y2")
    n = breaks.tags_on_pieces(pieces, label).groupBy("sheet_id", "run_id").agg(F.sum(F.when(F.col("piece") == 1, 1).otherwise(0)).alias("on_first"), F.sum(F.when(F.col("piece") == 2, 1).otherwise(0)).alias("on_second"))
    return breaks.parted(pieces).join(n, ["sheet_id", "run_id"], "left").fillna(0)


BREAK_SIDES = f"""{with_('d_runs', 'd_tags')}, r AS (SELECT *, CASE WHEN axis = 'H' THEN x1 + (x2 - x1) // 3 ELSE x1 END AS cx, CASE WHEN axis = 'V' THEN y1 + (y2 - y1) // 3 ELSE y1 END AS cy FROM d_runs),
l AS (SELECT pid_idx, run_id, x + pid_idx % 160 + 2 AS lx, (y - 8 + y + pid_idx % 90) / 2 AS ly FROM d_tags WHERE run_id IS NOT NULL),
d AS (SELECT r.run_id, pow(greatest(x1 - lx, lx - cx, 0), 2) + pow(greatest(y1 - ly, ly - cy, 0), 2) AS a, pow(greatest(cx - lx, lx - x2, 0), 2) + pow(greatest(cy - ly, ly - y2, 0), 2) AS b FROM l JOIN r ON l.run_id = r.run_id), n AS (SELECT run_id, count(*) FILTER (a <= b) AS on_first, count(*) FILTER (a > b) AS on_second FROM d GROUP BY 1)
SELECT sheet_id, r.run_id, 1 AS a, 2 AS b, coalesce(on_first, 0) AS on_first, coalesce(on_second, 0) AS on_second FROM r LEFT JOIN n ON n.run_id = r.run_id WHERE greatest(x2 - x1, y2 - y1) // 3 > 8"""


def marked_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets that may be enriched, after marks are filled in from manual pipes."""
    r = derived(spark, sf_dir, "d_runs").select("sheet_id", "run_id", F.expr("if(run_id % 3 = 0, null, run_id % 401 = 0)").alias("marked"), F.expr("run_id % 303 = 0").alias("manual"))
    return filters.may_enrich(filters.backfill_marked(r))


MARKED_SHEETS = f"{with_('d_runs')} SELECT DISTINCT sheet_id FROM d_runs WHERE CASE WHEN run_id % 3 = 0 THEN run_id % 303 = 0 ELSE run_id % 401 = 0 END"


def new_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with those found anew on marked pipes under a name that the sheet does not have."""
    t = derived(spark, sf_dir, "d_tags").select("sheet_id", "pid_idx", F.regexp_replace("pid", r"-\d+$", "").alias("pid"), F.col("run_id"))
    found = t.select("sheet_id", (F.col("pid_idx") + 10_000_000).alias("pid_idx"), F.expr("if(pid_idx % 2 = 0, lower(pid), concat(substr(pid, 1, 9), '-new'))").alias("pid"), F.col("pid_idx").alias("run_id"))
    runs = derived(spark, sf_dir, "d_runs").select("sheet_id", "run_id", F.expr("run_id % 5 <> 0").alias("marked"))
    return filters.add_tags(t, found, runs)


NEW_TAGS = f"""{with_('d_tags')}, t AS (SELECT sheet_id, pid_idx, regexp_replace(pid, '-\\d+$', '') AS pid, run_id FROM d_tags), f AS (SELECT sheet_id, pid_idx + 10000000 AS pid_idx, substr(pid, 1, 9) || '-new' AS pid, pid_idx AS run_id FROM t WHERE pid_idx % 2 = 1 AND pid_idx % 5 <> 0)
SELECT * FROM t UNION ALL SELECT sheet_id, pid_idx, pid, run_id FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, lower(pid) ORDER BY pid_idx) AS k FROM f) WHERE k = 1"""


def manual_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual symbols, and new ones that none of the same class starts near."""
    b = derived(spark, sf_dir, "d_boxes").select("sheet_id", "box_id", F.col("coarse").alias("cls"), "x1", "y1", F.expr("box_id % 6 = 0").alias("manual"))
    return filters.prefer_manual(b.where("not manual"), b).select("sheet_id", "box_id")


MANUAL_FIRST = f"{with_('d_boxes')} SELECT sheet_id, box_id FROM d_boxes n WHERE box_id % 6 = 0 OR NOT EXISTS (SELECT 1 FROM d_boxes m WHERE m.box_id % 6 = 0 AND m.sheet_id = n.sheet_id AND m.coarse = n.coarse AND abs(m.x1 - n.x1) < 30 AND abs(m.y1 - n.y1) < 30)"


def project_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most recent jobs of one project: project and limit are the listing's own."""
    o = table(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("sheet_id"), F.col("o_orderdate").alias("created_at"))
    sheets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sheet_id"), F.col("c_nationkey").alias("project_id"))
    return progress.jobs_of_project(jobs, sheets, 7).select("job_id", "sheet_id")


PROJECT_JOBS = "SELECT o_orderkey AS job_id, o_custkey AS sheet_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of every tenant, newest first, and their sheets by time and page number, as places in the lists."""
    p = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 4).alias("tenant_id"), F.col("c_custkey").alias("project_id"), F.expr("c_custkey * 37 % 101").alias("created_at"))
    projects = ordered.ordered_projects(p).withColumnRenamed("place", "project_place")
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("sheet_id"), F.col("o_orderdate").alias("created_at"), F.expr("concat(o_orderkey % 12, if(o_orderkey % 5 = 0, 'x', ''), '/12')").alias("sheet_number"))
    sheets = ordered.ordered_sheets(s)
    return sheets.join(projects.drop("created_at"), "project_id").select("tenant_id", "project_id", "project_place", "sheet_id", "place")


LISTINGS = """WITH p AS (SELECT c_nationkey % 4 AS tenant_id, c_custkey AS project_id, row_number() OVER (PARTITION BY c_nationkey % 4 ORDER BY c_custkey * 37 % 101 DESC, c_custkey) AS project_place FROM customer),
s AS (SELECT o_custkey AS project_id, o_orderkey AS sheet_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 12 END, o_orderkey) AS place FROM orders) SELECT tenant_id, project_id, project_place, sheet_id, place FROM s JOIN p USING (project_id)"""


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows of a line list: the limit is the preview's own."""
    return ordered.preview(derived(spark, sf_dir, "d_line_list")).select("row_no", "line_number")


def tenant_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project by its key, for the tenant that owns it and not for another: the key is the listing's own."""
    p = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 4).alias("tenant_id"), F.col("c_custkey").alias("project_id"))
    both = ordered.by_key(p, "project_id", 5, 0).withColumn("asked", F.lit(0))
    for tenant in (1, 2, 3):
        both = both.unionByName(ordered.by_key(p, "project_id", 5, tenant).withColumn("asked", F.lit(tenant)))
    return both


TENANT_PROJECT = "SELECT c_nationkey % 4 AS tenant_id, c_custkey AS project_id, cast(c_nationkey % 4 AS int) AS asked FROM customer WHERE c_custkey = 5"
PREVIEW = f"{with_('d_line_list')} SELECT row_no, line_number FROM d_line_list ORDER BY row_no LIMIT 100"


def id_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision of the tags read on each sheet."""
    t = derived(spark, sf_dir, "d_tags").select("sheet_id", "pid_idx", "pid")
    found = t.withColumn("pid", F.expr("if(pid_idx % 6 = 0, concat(pid, 'x'), pid)"))
    return metrics.id_sets(found, t, ("sheet_id",), "pid")


ID_RECALL = f"""{with_('d_tags')}, f AS (SELECT DISTINCT sheet_id, CASE WHEN pid_idx % 6 = 0 THEN pid || 'x' ELSE pid END AS pid FROM d_tags), e AS (SELECT DISTINCT sheet_id, pid FROM d_tags), j AS (SELECT coalesce(f.sheet_id, e.sheet_id) AS sheet_id, f.pid AS f, e.pid AS e FROM f FULL JOIN e ON f.sheet_id = e.sheet_id AND f.pid = e.pid)
SELECT sheet_id, count(f) AS n_found, count(e) AS n_expected, count(*) FILTER (f IS NOT NULL AND e IS NOT NULL) AS n_correct, 100.0::double * count(*) FILTER (f IS NOT NULL AND e IS NOT NULL) / count(e) AS recall, 100.0::double * count(*) FILTER (f IS NOT NULL AND e IS NOT NULL) / count(f) AS precision FROM j GROUP BY 1"""


def known_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class codes read on sheets that the vocabulary has, and those that it lacks."""
    read = derived(spark, sf_dir, "d_tags").select("pclass").distinct()
    known = table(spark, sf_dir, "nation").select(F.expr(pick(CLASSES, "n_nationkey % 7")).alias("pclass"))
    return read.intersect(known).withColumn("known", F.lit(True)).unionByName(read.exceptAll(known.distinct()).withColumn("known", F.lit(False)))


KNOWN_CODES = f"{with_('d_tags')}, k AS (SELECT DISTINCT {pick(CLASSES, 'n_nationkey % 7')} AS pclass FROM nation) SELECT DISTINCT pclass, pclass IN (SELECT pclass FROM k) AS known FROM d_tags"


def matched_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that match a truth, each truth used once, in order of score."""
    b = derived(spark, sf_dir, "d_boxes")
    found = b.withColumns({"x1": F.expr("x1 + box_id % 13"), "y1": F.expr("y1 + box_id % 7")})
    return greedy.match_boxes(b, found, 0.5).select("sheet_id", "box_id", "tp")


_MI = "(greatest(0, least(t.x2, p.x2) - greatest(t.x1, p.x1)) * greatest(0, least(t.y2, p.y2) - greatest(t.y1, p.y1)))::double"
_MIOU = f"CASE WHEN (t.x2 - t.x1) * (t.y2 - t.y1) + greatest(0, p.x2 - p.x1) * greatest(0, p.y2 - p.y1) - {_MI} > 0 THEN {_MI} / ((t.x2 - t.x1) * (t.y2 - t.y1) + greatest(0, p.x2 - p.x1) * greatest(0, p.y2 - p.y1) - {_MI}) ELSE -1 END"
MATCHED_BOXES = f"""{with_('d_boxes')}, pr AS (SELECT sheet_id, box_id, coarse, score, x1 + box_id % 13 AS x1, y1 + box_id % 7 AS y1, x2, y2, row_number() OVER (PARTITION BY sheet_id, coarse ORDER BY score DESC, box_id) AS k FROM d_boxes),
cand AS (SELECT p.sheet_id, p.coarse, p.k, t.box_id AS t, {_MIOU} AS v FROM pr p JOIN d_boxes t ON t.sheet_id = p.sheet_id AND t.coarse = p.coarse WHERE {_MI} > 0), lst AS (SELECT p.sheet_id, p.coarse, p.k, p.box_id, coalesce(list({{'t': c.t, 'v': c.v}} ORDER BY c.v DESC, c.t) FILTER (c.t IS NOT NULL), []) AS ts FROM pr p LEFT JOIN cand c ON c.sheet_id = p.sheet_id AND c.coarse = p.coarse AND c.k = p.k GROUP BY ALL),
w AS (SELECT sheet_id, coarse, k, box_id, coalesce(ts[1].v >= 0.5, false) AS tp, CASE WHEN ts[1].v >= 0.5 THEN [ts[1].t] ELSE []::bigint[] END AS used FROM lst WHERE k = 1 UNION ALL SELECT sheet_id, coarse, k, box_id, coalesce(b.v >= 0.5, false), CASE WHEN b.v >= 0.5 THEN list_append(used, b.t) ELSE used END FROM (
  SELECT l.sheet_id, l.coarse, l.k, l.box_id, w.used, list_filter(l.ts, lambda z: NOT list_contains(w.used, z.t))[1] AS b FROM w JOIN lst l ON l.sheet_id = w.sheet_id AND l.coarse = w.coarse AND l.k = w.k + 1)) SELECT sheet_id, box_id, tp FROM w"""


def thinned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of which no stronger kept one lies near on both axes."""
    p = derived(spark, sf_dir, "d_points").select("sheet_id", "point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.expr("point_id * 37 % 11 / 10").cast("double").alias("conf"))
    return breaks.thin(p, 125.0).select("sheet_id", "point_id")


THINNED_POINTS = f"""{with_('d_points')}, o AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY point_id * 37 % 11 DESC, point_id) AS k FROM d_points), w AS (SELECT sheet_id, k, [{{'x': x, 'y': y, 'p': point_id}}] AS kept FROM o WHERE k = 1 UNION ALL
  SELECT o.sheet_id, o.k, CASE WHEN len(list_filter(w.kept, lambda q: abs(q.x - o.x) < 125 AND abs(q.y - o.y) < 125)) = 0 THEN list_append(w.kept, {{'x': o.x, 'y': o.y, 'p': o.point_id}}) ELSE w.kept END FROM w JOIN o ON o.sheet_id = w.sheet_id AND o.k = w.k + 1),
l AS (SELECT sheet_id, unnest(kept) AS q FROM (SELECT sheet_id, arg_max(kept, k) AS kept FROM w GROUP BY 1)) SELECT sheet_id, q.p AS point_id FROM l"""


def turned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points after sheets are turned, and starts of tiles along their places."""
    p = derived(spark, sf_dir, "d_points")
    r = geometry.rotate(F.col("x"), F.col("y"), F.expr("point_id % 6 * 90"), F.lit(1700), F.lit(1200))
    starts = geometry.tile_offsets(F.col("x") + 1, 256, 64)
    return p.select("sheet_id", "point_id", r.x.alias("u"), r.y.alias("v"), F.size(starts).alias("n_tiles"), F.element_at(starts, -1).alias("last"))


TURNED_POINTS = f"""{with_('d_points')} SELECT sheet_id, point_id, CASE point_id % 4 * 1 + CASE WHEN point_id % 6 >= 4 THEN 0 ELSE 0 END WHEN -1 THEN 0 ELSE CASE (point_id % 6) % 4 WHEN 1 THEN 1200 - 1 - y WHEN 2 THEN 1700 - 1 - x WHEN 3 THEN y ELSE x END END::double AS u,
  CASE (point_id % 6) % 4 WHEN 1 THEN x WHEN 2 THEN 1200 - 1 - y WHEN 3 THEN 1700 - 1 - x ELSE y END::double AS v, cast(CASE WHEN x + 1 <= 256 THEN 1 ELSE 1 + ceil((x + 1 - 256) / 192.0) END AS int) AS n_tiles, CASE WHEN x + 1 <= 256 THEN 0 ELSE x + 1 - 256 END AS last FROM d_points"""


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of cubic curves, and which paths are closed or stroked."""
    from isoline.operators import vector

    p = derived(spark, sf_dir, "d_points")
    at = lambda dx, dy: F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y"))
    c = geometry.bezier(at(0, 0), at(30, 5), at(60, 55), at(40, 80))
    items = F.expr("array(named_struct('kind', if(point_id % 5 = 0, 're', 'l'), 'points', array(array(double(x), double(y)), array(double(x + point_id % 3), double(y)))))")
    path = F.struct(F.expr("if(point_id % 7 = 0, true, null)").alias("closed"), items.alias("items"))
    stroked = vector.is_stroked(F.expr("if(point_id % 4 = 0, null, 'k')"), F.expr("if(point_id % 2 = 0, 'w', null)"), F.expr("if(point_id % 3 = 0, 'f', 's')"))
    return p.select("sheet_id", "point_id", F.bround(c[3].x, 6).alias("x3"), F.bround(c[3].y, 6).alias("y3"), F.size(c).alias("n"), vector.is_closed(path).alias("closed"), stroked.alias("stroked"))


CURVES = f"""{with_('d_points')}, t AS (SELECT *, 0.375::double AS t FROM d_points) SELECT sheet_id, point_id, round_even(pow(1 - t, 3) * x + 3 * pow(1 - t, 2) * t * (x + 30) + 3 * (1 - t) * t * t * (x + 60) + t * t * t * (x + 40), 6) AS x3, round_even(pow(1 - t, 3) * y + 3 * pow(1 - t, 2) * t * (y + 5) + 3 * (1 - t) * t * t * (y + 55) + t * t * t * (y + 80), 6) AS y3, 9 AS n,
  point_id % 7 = 0 OR point_id % 5 = 0 OR point_id % 3 <= 1 AS closed, point_id % 4 <> 0 AND NOT (point_id % 2 = 0 AND point_id % 3 = 0) AS stroked FROM t"""


def unmarked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each path when a marked drawing is unmarked."""
    color = lambda by: F.expr(f"case cast(l_orderkey % {by} as int) when 0 then array(0.0D, 0.0D, 0.0D) when 1 then array(1.0D, 0.2D, 0.1D) when 2 then array(0.5D, 0.55D, 0.6D) else null end")
    p = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("page_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("path_id"), color(3).alias("color"), color(5).alias("fill"), F.expr("l_linenumber / 4D").alias("width"), F.expr("double(l_quantity)").alias("length"))
    width = registers.pipe_width(p)
    return registers.painted_paths(p, 0.72).join(width, "page_id")


UNMARKED_PATHS = """WITH p AS (SELECT l_orderkey % 97 AS page_id, l_orderkey * 10 + l_linenumber AS path_id, l_orderkey % 3 = 1 AS m, l_orderkey % 5 = 1 AS f, l_linenumber / 4.0::double AS width, l_quantity::double AS n FROM lineitem), w AS (SELECT page_id, coalesce(quantile_cont(width, 0.5) FILTER (NOT m AND NOT f), 0.72) AS width FROM p GROUP BY 1)
SELECT page_id, path_id, CASE WHEN f THEN 'drop' WHEN NOT m THEN 'keep' WHEN p.width >= 1 OR n > 40 THEN 'redraw' ELSE 'drop' END AS what, w.width FROM p JOIN w USING (page_id)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of reviewed sheets."""
    b = derived(spark, sf_dir, "d_boxes")
    s = b.select("sheet_id").distinct().select("sheet_id", F.expr("sheet_id % 2 = 0").alias("reviewed"), F.lit(512).alias("w"), F.expr("if(sheet_id % 10 = 4, 0, 1024)").alias("h"))
    return registers.training_samples(s, b)


SAMPLES = f"""{with_('d_boxes')} SELECT sheet_id, box_id, printf('%d %.6f %.6f %.6f %.6f', CASE coarse WHEN 'equipment' THEN 0 WHEN 'instrument' THEN 1 ELSE 2 END, (x1 + x2) / 2 / 512, (y1 + y2) / 2 / 1024, (x2 - x1) / 512, (y2 - y1) / 1024) AS label FROM d_boxes WHERE sheet_id % 2 = 0 AND sheet_id % 10 <> 4"""


def marked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of marked pipes, manual ones first, and the legend of each sheet."""
    r = derived(spark, sf_dir, "d_runs").select("sheet_id", "run_id")
    manual = r.where("run_id % 9 = 0").withColumn("group_name", F.lit("by hand"))
    t = derived(spark, sf_dir, "d_tags").where("run_id is not null").select("sheet_id", "run_id", F.col("fluid").alias("group_name"))
    marked = registers.annotations(r, manual, t).withColumn("color", F.expr("if(manual, 'black', concat('c', length(group_name)))"))
    return registers.legend(marked)


MARKED_GROUPS = f"""{with_('d_runs', 'd_tags')}, g AS (SELECT r.sheet_id, CASE WHEN r.run_id % 9 = 0 THEN 'by hand' ELSE t.fluid END AS name, CASE WHEN r.run_id % 9 = 0 THEN 'black' ELSE 'c' || len(t.fluid) END AS color FROM d_runs r LEFT JOIN d_tags t ON t.run_id = r.run_id WHERE r.run_id % 9 = 0 OR t.run_id IS NOT NULL)
SELECT sheet_id, color, count(*) AS n_pipes, min(name) AS group_name FROM g GROUP BY ALL"""


def edited_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes after batches of edits: colours, labels and deletions, with their new places."""
    r = derived(spark, sf_dir, "d_runs").select("sheet_id", "run_id", F.lit("blue").alias("color"), F.lit(None).cast("string").alias("label"))
    c = r.where("run_id % 4 = 0").select("sheet_id", "run_id", F.expr("run_id % 8 = 0").alias("deleted"), F.lit("red").alias("color"), F.expr("if(run_id % 12 = 0, null, 'L')").alias("label"))
    return tracing.renumber(tracing.edit(r, c, ["color", "label"]))


EDITED_PIPES = f"""{with_('d_runs')} SELECT sheet_id, run_id, CASE WHEN run_id % 4 = 0 THEN 'red' ELSE 'blue' END AS color, CASE WHEN run_id % 4 = 0 AND run_id % 12 <> 0 THEN 'L' END AS label, row_number() OVER (PARTITION BY sheet_id ORDER BY run_id) - 1 AS run_idx FROM d_runs WHERE run_id % 8 <> 0"""


def junction_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of junctions from the directions of the pipes that leave them."""
    o = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("sheet_id"), F.col("l_orderkey").alias("node_id"), F.col("l_linenumber").alias("arm"), F.expr("double(case l_suppkey % 4 when 0 then 1 when 1 then -1 else 0 end)").alias("dx"), F.expr("double(case l_suppkey % 4 when 2 then 1 when 3 then -1 else 0 end)").alias("dy"))
    return tracing.junctions(o)


_JD = "(a.dx * b.dx + a.dy * b.dy)"
JUNCTION_KINDS = f"""WITH a AS (SELECT l_orderkey % 50 AS sheet_id, l_orderkey AS node_id, l_linenumber AS arm, CASE l_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS dx, CASE l_suppkey % 4 WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS dy FROM lineitem), n AS (SELECT sheet_id, node_id, count(*) AS degree, list({{'dx': dx, 'dy': dy}} ORDER BY arm, dx, dy) AS v FROM a GROUP BY ALL),
d AS (SELECT *, list_transform([[1, 2], [1, 3], [1, 4], [2, 3], [2, 4], [3, 4]], lambda p: v[p[1]].dx * v[p[2]].dx + v[p[1]].dy * v[p[2]].dy) AS d FROM n)
SELECT sheet_id, node_id, degree, CASE degree WHEN 1 THEN 'endpoint' WHEN 2 THEN CASE WHEN d[1] <= -0.7 THEN 'straight' ELSE 'corner' END WHEN 3 THEN CASE WHEN least(d[1], d[2], d[4]) <= -0.35 THEN 'tee' ELSE 'complex' END
  WHEN 4 THEN (SELECT CASE WHEN greatest(x, y) <= -0.3 THEN 'crossover' WHEN least(x, y) <= -0.35 THEN 'partial' ELSE 'complex' END FROM (SELECT unnest([{{'x': d[1], 'y': d[6], 'k': 0}}, {{'x': d[2], 'y': d[5], 'k': 1}}, {{'x': d[3], 'y': d[4], 'k': 2}}], recursive := true)) ORDER BY x + y, k LIMIT 1) ELSE 'complex' END AS kind FROM d"""


def terminal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with which jobs end."""
    return progress.until_terminal(derived(spark, sf_dir, "d_progress")).select("job_id", "event_id", "step")


TERMINAL_EVENTS = f"{with_('d_progress')} SELECT job_id, event_id, message AS step FROM d_progress WHERE message IN ('completed', 'failed')"


def matched_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written on two lines that read as a tag once they are joined."""
    from isoline.operators import association

    t = derived(spark, sf_dir, "d_tags").select("sheet_id", "pid_idx", "pid", "x", "y")
    top = t.select("sheet_id", (F.col("pid_idx") * 2).alias("frag_id"), F.substring_index("pid", "-", 3).alias("text"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.expr("x + 60").alias("x2"), F.expr("y + 10").alias("y2"))
    low = t.select("sheet_id", (F.col("pid_idx") * 2 + 1).alias("frag_id"), F.expr("substring_index(pid, '-', -2)").alias("text"), F.expr("x + pid_idx % 90").alias("x1"), F.expr("y + 12").alias("y1"), F.expr("x + pid_idx % 90 + 40").alias("x2"), F.expr("y + 22").alias("y2"))
    pairs = association.two_line_pairs(top.unionByName(low))
    return association.tags_of_pairs(pairs).select("sheet_id", "upper", "lower", "pid", "weight")


MATCHED_LABELS = f"""{with_('d_tags')}, f AS (SELECT sheet_id, pid_idx * 2 AS id, array_to_string(string_split(pid, '-')[1:3], '-') AS text, x AS x1, y AS y1, x + 60 AS x2, y + 10 AS y2 FROM d_tags UNION ALL SELECT sheet_id, pid_idx * 2 + 1, array_to_string(string_split(pid, '-')[-2:], '-'), x + pid_idx % 90, y + 12, x + pid_idx % 90 + 40, y + 22 FROM d_tags),
p AS (SELECT a.sheet_id, a.id AS upper, b.id AS lower, a.text || '-' || b.text AS norm FROM f a JOIN f b ON a.sheet_id = b.sheet_id AND a.id <> b.id AND b.y1 - a.y2 >= -0.6 * 10 AND b.y1 - a.y2 <= 1.8 * 10 AND least(a.x2, b.x2) - greatest(a.x1, b.x1) >= 0.4 * least(a.x2 - a.x1, b.x2 - b.x1))
SELECT sheet_id, upper, lower, CASE WHEN regexp_matches(norm, {_q(_PA)}) THEN regexp_extract(norm, {_q(_PA)}, 0) ELSE regexp_extract(norm, {_q(_PB)}, 0) END AS pid, 3 AS weight FROM p WHERE regexp_matches(norm, {_q(_PA)}) OR regexp_matches(norm, {_q(_PB)})"""

_ALL = (
    instrument_register, equipment_register, valve_register, break_register, barriers, register_summary, system_register, circuit_register, bubbles, typed_tags, learned_tags, coarse_classes, fluid_colors, linelist_files, grouping_report, marking_report, validation_score,
    report_flags, merged_fluids, spread_systems, project_members, topology_nodes, topology_summary, break_sides, marked_sheets, new_tags, manual_first, project_jobs, listings, preview, tenant_project, id_recall, known_codes, matched_boxes, thinned_points, turned_points, curves,
    unmarked_paths, samples, marked_groups, edited_pipes, junction_kinds, terminal_events, matched_labels,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
