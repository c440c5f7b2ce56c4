"""Corrosion systems and circuits with codes, operating summary and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Material of each known piping class.
MATERIAL_SPEC = {"CDA": "SS", "CDE": "SS", "CCC": "CS", "CCB": "CS", "ASA": "CS", "ASB": "CS", "DSA": "SS", "DSE": "SS", "DDE": "SS", "A1A2": "CS", "B1A2": "CS", "C1A2": "CS", "A3A2": "SS", "A4A2": "SS"}


def material_spec(spark: SparkSession) -> DataFrame:
    """(spec_class, spec_material): the class specification, a fixed dimension."""
    return spark.createDataFrame(list(MATERIAL_SPEC.items()), "spec_class string, spec_material string")


def with_material(rows: DataFrame, spec: DataFrame, class_map: DataFrame | None = None, pclass: str = "pclass", explicit: str = "material", out: str = "effective_material") -> DataFrame:
    """Add the material: explicit, else of the specification, else of the class map, else the class's second letter.

    spec and class_map are dimensions of piping classes; Spark broadcasts them while they are under its threshold.
    """
    code = F.upper(F.trim(F.coalesce(F.col(pclass), F.lit(""))))
    rows = rows.join(spec.withColumnRenamed("spec_class", "_c1"), code == F.col("_c1"), "left")
    mapped = F.lit(None).cast("string")
    if class_map is not None:
        rows = rows.join(class_map.select(F.upper("piping_class").alias("_c2"), F.upper("material").alias("_m2")), code == F.col("_c2"), "left")
        mapped = F.col("_m2")
    own = F.nullif(F.upper(F.trim(F.coalesce(F.col(explicit), F.lit("")))), F.lit(""))
    rows = rows.withColumn(out, F.coalesce(own, F.col("spec_material"), mapped, F.substring(code, 2, 1)))
    return rows.drop("_c1", "_c2", "_m2", "spec_material")


def direct_labels(tags: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """One label per pipe: the first tag (smallest pid_idx) that names the pipe, with all its columns."""
    named = tags.where("run_id is not null")
    first = Window.partitionBy(*keys, "run_id").orderBy("pid_idx")
    return named.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def propagated_labels(tags: DataFrame, spread: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """One label per pipe that a tag reaches along the pipes: the tag's columns with the pipe's run_id and whether it is
    inferred. spread: keys, run_id, source (a pid_idx), inferred, as propagation gives."""
    named = tags.drop("run_id").withColumnRenamed("pid_idx", "source")
    return spread.select(*keys, "run_id", "source", "inferred").join(named, [*keys, "source"]).withColumnRenamed("source", "pid_idx")


def _fluid() -> Column:
    return F.upper(F.trim(F.coalesce(F.col("fluid"), F.lit(""))))


def systems(labels: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, fluid, system_no, n_pipes): pipes by fluid, the largest system first, then by name."""
    found = labels.withColumn("fluid", _fluid()).where("fluid <> ''").groupBy(*keys, "fluid").agg(F.count("*").alias("n_pipes"))
    rank = Window.partitionBy(*keys).orderBy(F.desc("n_pipes"), "fluid")
    return found.withColumn("system_no", F.row_number().over(rank))


def circuits(labels: DataFrame, tags: DataFrame, spec: DataFrame, class_map: DataFrame | None = None, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Circuits of every system: pipes of one material, phase and corrosion loop.

    Members are the tags with exactly that key. Averages are rounded half to even. Provenance is the strongest rule
    that applies: loop of a line list, phase boundary, class of the specification, else the class's own letter.
    """
    by = [*keys, "fluid", "circuit_material", "phase", "loop"]

    def keyed(rows: DataFrame) -> DataFrame:
        rows = with_material(rows, spec, class_map, out="circuit_material")
        phase, loop = F.upper(F.trim(F.coalesce("fluid_phase", F.lit("")))), F.trim(F.coalesce("corrosion_loop", F.lit("")))
        rows = rows.withColumn("fluid", _fluid()).withColumn("phase", phase).withColumn("loop", loop)
        return rows.withColumn("pclass", F.upper(F.trim(F.coalesce("pclass", F.lit(""))))).where("fluid <> ''")

    known = F.array(*(F.lit(c) for c in MATERIAL_SPEC))
    pipes = keyed(labels).groupBy(*by).agg(F.count("*").alias("n_pipes"), F.array_sort(F.collect_set(F.nullif("pclass", F.lit("")))).alias("classes"))
    members = keyed(tags).groupBy(*by).agg(
        F.count("*").alias("n_tags"), F.bround(F.avg("operating_temperature"), 1).alias("avg_temperature_c"), F.bround(F.avg("operating_pressure"), 1).alias("avg_pressure_barg"), F.min("corrosion_allowance").alias("corrosion_allowance_mm")
    )
    out = pipes.join(members, by, "left").join(systems(labels, keys).withColumnRenamed("n_pipes", "system_pipes"), [*keys, "fluid"])
    rank = Window.partitionBy(*keys, "fluid").orderBy(F.desc("n_pipes"), "circuit_material", "phase", "loop")
    out = out.withColumn("circuit_no", F.row_number().over(rank)).withColumn("code", F.format_string("%02d.%02d", "system_no", "circuit_no"))
    rules = [(F.col("loop") != "", "LINE_LIST_CORROSION_LOOP", 1.0), (F.col("phase") != "", "API_RP_970_PHASE_BOUNDARY", 0.95), (F.arrays_overlap("classes", known), "API_RP_970_MATERIAL_SPEC", 0.95)]
    rule, confidence = F.lit("API_RP_970_MATERIAL_SPLIT"), F.lit(0.85)
    for when, name, value in reversed(rules):
        rule, confidence = F.when(when, name).otherwise(rule), F.when(when, value).otherwise(confidence)
    return out.select(*keys, "code", "fluid", F.col("circuit_material").alias("material"), F.col("phase").alias("fluid_phase"), F.col("loop").alias("corrosion_loop"), "n_pipes", F.coalesce("n_tags", F.lit(0)).alias("n_tags"), F.concat_ws(",", "classes").alias("classes"), "avg_temperature_c", "avg_pressure_barg", "corrosion_allowance_mm", rule.alias("rule"), confidence.alias("confidence"))


def dedup_tags(tags: DataFrame, key: Column, merge_runs: bool = False, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """One entry per line.

    Simple (live) rule: of equal tags the one with the highest conf, then the first. merge_runs: of one key the entry
    with an inch mark, then the longest, then the highest conf, then the first; votes are summed and pipes united.
    """
    if not merge_runs:
        best = Window.partitionBy(*keys, "pid").orderBy(F.desc("conf"), "pid_idx")
        return tags.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    full = F.struct(F.col("pid").contains('"'), F.length("pid"), "conf", -F.col("pid_idx"))
    rows = tags.groupBy(*keys, key.alias("line_key")).agg(F.max_by("pid", full).alias("pid"), F.sum("conf").alias("conf"), F.array_sort(F.collect_set("run_id")).alias("runs"), F.max_by("run_id", full).alias("own_run"))
    primary = F.coalesce("own_run", F.get("runs", F.lit(0)))
    return rows.select(*keys, "line_key", "pid", "conf", primary.alias("run_id"), F.array_except("runs", F.array(primary)).alias("extra_runs"))


def snap_units(tags: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Replace a unit that misses or adds one leading or trailing digit of the drawing's most frequent unit.

    tags: pid, weight, pid_idx. Only weights of 3 and more vote; of equally frequent units the first seen wins.
    """
    unit = F.split("pid", "-")[0]
    votes = tags.where("weight >= 3").groupBy(*keys, unit.alias("unit")).agg(F.count("*").alias("n"), F.min("pid_idx").alias("first"))
    top = votes.groupBy(*keys).agg(F.max_by("unit", F.struct("n", -F.col("first"))).alias("dominant"))
    rows = tags.join(top, list(keys), "left").withColumn("unit", unit)
    typo = (F.col("unit") != F.col("dominant")) & (F.abs(F.length("dominant") - F.length("unit")) <= 1) & (F.col("dominant").endswith(F.col("unit")) | F.col("unit").endswith(F.col("dominant")))
    fixed = F.concat("dominant", F.expr("substring(pid, length(unit) + 1)"))
    return rows.withColumn("pid", F.when(typo, fixed).otherwise(F.col("pid"))).drop("unit", "dominant")
