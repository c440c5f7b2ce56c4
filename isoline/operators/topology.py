"""Multi-sheet topology: off-page connectors to sheets, edges, and circuits over all sheets of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoline.functions.tags import drawing_key


def sheet_references(sheets: DataFrame) -> DataFrame:
    """(ref, ref_sheet): keys that name a sheet - its number and its file; of equal keys the last sheet in order wins.

    Sheets are ordered by number, then file name, then id.
    """
    refs = sheets.select("sheet_id", "sheet_number", "filename", F.explode(F.array(drawing_key(F.col("sheet_number")), drawing_key(F.col("filename")))).alias("ref")).where("ref <> ''")
    return refs.groupBy("ref").agg(F.max_by("sheet_id", F.struct("sheet_number", "filename", "sheet_id")).alias("ref_sheet"))


def edges(opcs: DataFrame, sheets: DataFrame, tags: DataFrame) -> DataFrame:
    """(source, target, opc_id, target_opc, piping_id, confidence): one edge per sheet pair and line.

    A connector leads to the sheet that its sheet number names, else its drawing, else the first other sheet that has
    the same tag (opcs of other sheets count through tags). A connector of the same line on the target sheet raises
    the confidence. tags: sheet_id, pid.
    """
    refs = sheet_references(sheets)
    o = opcs
    for c, name in (("target_sheet_number", "t1"), ("target_drawing", "t2")):
        o = o.join(refs.withColumnRenamed("ref", f"_{name}").withColumnRenamed("ref_sheet", name), (drawing_key(F.col(c)) == F.col(f"_{name}")) & (F.col(name) != F.col("sheet_id")), "left").drop(f"_{name}")
    place = sheets.select(F.col("sheet_id").alias("other"), F.struct("sheet_number", "filename", "sheet_id").alias("rank"))
    homes = tags.select(F.col("pid").alias("piping_id"), F.col("sheet_id").alias("other")).distinct().join(place, "other")
    # the two first sheets of a tag are enough: one of them is not the connector's own
    order = Window.partitionBy("piping_id").orderBy("rank")
    firsts = homes.withColumn("_n", F.row_number().over(order)).where("_n <= 2").groupBy("piping_id").agg(F.sort_array(F.collect_list(F.struct("_n", "other"))).alias("homes"))
    o = o.join(firsts, "piping_id", "left").withColumn("t3", F.get(F.filter("homes", lambda h: h.other != F.col("sheet_id")), F.lit(0)).other)
    o = o.withColumn("target", F.coalesce("t1", "t2", "t3")).where("target is not null").select("sheet_id", "opc_id", "piping_id", "target")
    back = opcs.groupBy(F.col("sheet_id").alias("target"), "piping_id").agg(F.min("opc_id").alias("target_opc"))
    o = o.join(back, ["target", "piping_id"], "left")
    first = Window.partitionBy(F.least("sheet_id", "target"), F.greatest("sheet_id", "target"), "piping_id").orderBy("sheet_id", "opc_id")
    o = o.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return o.select(F.col("sheet_id").alias("source"), "target", "opc_id", "target_opc", "piping_id", F.when(F.col("target_opc").isNotNull(), 0.95).otherwise(0.85).alias("confidence"))


def project_circuits(circuits: DataFrame) -> DataFrame:
    """Circuits of equal fluid, material, phase and loop over all sheets, ranked anew over the project.

    circuits: sheet_id, fluid, material, fluid_phase, corrosion_loop, n_pipes, n_tags, avg_temperature_c and so on.
    """
    by = ["fluid", "material", "fluid_phase", "corrosion_loop"]
    out = circuits.groupBy(*by).agg(F.countDistinct("sheet_id").alias("n_sheets"), F.sum("n_pipes").alias("n_pipes"), F.sum("n_tags").alias("n_tags"), F.min("corrosion_allowance_mm").alias("corrosion_allowance_mm"))
    systems = out.groupBy("fluid").agg(F.sum("n_pipes").alias("_pipes"))
    # one row per fluid: a plant has few
    systems = systems.withColumn("system_no", F.row_number().over(Window.orderBy(F.desc("_pipes"), "fluid"))).drop("_pipes")
    rank = Window.partitionBy("fluid").orderBy(F.desc("n_pipes"), "material", "fluid_phase", "corrosion_loop")
    out = out.join(systems, "fluid").withColumn("code", F.format_string("%02d.%02d", "system_no", F.row_number().over(rank)))
    return out.select("code", *by, "n_sheets", "n_pipes", "n_tags", "corrosion_allowance_mm")


def circuit_members(tags: DataFrame, by: tuple[str, ...] = ("fluid", "material", "fluid_phase", "corrosion_loop")) -> DataFrame:
    """Members of project circuits: (by, member_pids sorted, n_members, and the operating summary over all of them).

    tags: sheet_id, pid, the columns of `by`, operating_temperature, operating_pressure, corrosion_allowance. Averages
    are over the tags of all sheets, rounded half to even.
    """
    return tags.groupBy(*by).agg(
        F.array_sort(F.collect_set("pid")).alias("member_pids"), F.countDistinct("pid").alias("n_members"), F.array_sort(F.collect_set("sheet_id")).alias("sheet_ids"),
        F.bround(F.avg("operating_temperature"), 1).alias("avg_temperature_c"), F.bround(F.avg("operating_pressure"), 1).alias("avg_pressure_barg"), F.min("corrosion_allowance").alias("corrosion_allowance_mm"),
    )


def nodes(sheets: DataFrame, circuits: DataFrame) -> DataFrame:
    """(id, type, label): a node per sheet, named by its number or else its file, and one per project circuit.

    The id of a circuit node holds all that tells circuits apart, so no two circuits share one.
    """
    label = F.coalesce(F.nullif(F.trim("sheet_number"), F.lit("")), F.col("filename"))
    a = sheets.select(F.col("sheet_id").cast("string").alias("id"), F.lit("sheet").alias("type"), label.alias("label"))
    name = F.concat(F.lit("circ-"), F.concat_ws("-", "code", "fluid", "material", "fluid_phase", "corrosion_loop"))
    b = circuits.select(name.alias("id"), F.lit("circuit").alias("type"), F.concat(F.lit("Circuit "), "code", F.lit(" ("), "fluid", F.lit(" - "), "material", F.lit(")")).alias("label"))
    return a.unionByName(b)


def summary(sheets: DataFrame, links: DataFrame, circuits: DataFrame) -> DataFrame:
    """One row: total_sheets, total_opc_edges, total_unified_circuits, multi_sheet_circuits."""
    a = sheets.agg(F.count("*").alias("total_sheets"))
    b = links.agg(F.count("*").alias("total_opc_edges"))
    c = circuits.agg(F.count("*").alias("total_unified_circuits"), F.count_if(F.col("n_sheets") > 1).alias("multi_sheet_circuits"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))
