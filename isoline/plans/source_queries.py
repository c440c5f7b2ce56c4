"""Queries that write files of each kind to the shared folder and read them back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.operators import grouping
from isoline.plans.derive import derived, with_
from isoline.plans.line_queries import yolo_labels
from isoline.session import shared_path, table
from isoline.sources import linelists


def _put(spark: SparkSession, tag: str, files: dict[str, bytes]) -> str:
    """Write a few small files to a new folder and return its path."""
    path = shared_path(spark, tag)
    where, folder = fs.FileSystem.from_uri(path)
    where.create_dir(folder, recursive=True)
    for name, data in files.items():
        with where.open_output_stream(f"{folder}/{name}", compression=None) as out:
            out.write(data)
    return path


def _book(*sheets: list[list[str | None]]) -> bytes:
    """A workbook of inline texts."""
    out, ns = io.BytesIO(), "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, rows in enumerate(sheets, 1):
            cell = lambda i, j, v: f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
            body = "".join("<row>" + "".join(cell(i, j, v) for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """The rows of a dimension of 25: a workbook is a document of this size."""
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()


def workbook_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a workbook with notes on one sheet and lines on another."""
    rows = [["Tag", "Oper. Temp", "Fluid Phase", "Remarks", "Paint"]] + [[r.n_name, f"{r.n_nationkey}.5 C" if r.n_nationkey % 3 else "-", "liq" if r.n_regionkey < 2 else None, f"note {r.n_regionkey}", "red"] for r in _nations(spark, sf_dir)]
    path = _put(spark, "workbooks", {"a.xlsx": _book([["only notes"], ["here"]], rows)})
    e = linelists.read_line_list(spark, f"{path}/a.xlsx")
    return e.select("row_no", "line_number", "operating_temperature_c", "fluid_phase", "notes", F.try_element_at("raw_attributes", F.lit("Paint")).alias("paint"))


WORKBOOK_ENTRIES = "SELECT cast(row_number() OVER (ORDER BY n_nationkey) AS int) AS row_no, n_name AS line_number, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey + 0.5::double END AS operating_temperature_c, CASE WHEN n_regionkey < 2 THEN 'L' ELSE '' END AS fluid_phase, 'note ' || n_regionkey AS notes, 'red' AS paint FROM nation"


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of lines in reference workbooks, beside a lock file and a broken one."""
    rows = [["Source File", "Piping ID", "Color Group"]] + [[f"D-{r.n_regionkey}", f'{r.n_name.lower()} - 6"', "nan" if r.n_nationkey % 5 == 0 else f"g{r.n_nationkey % 3}"] for r in _nations(spark, sf_dir)]
    path = _put(spark, "truth", {"a_loop_dataset.xlsx": _book(rows), "~$a_loop_dataset.xlsx": b"lock", "b_loop_dataset.xlsx": b"broken"})
    return linelists.read_ground_truth(spark, path)


GROUND_TRUTH = "SELECT 'D-' || n_regionkey AS source_file, replace(upper(n_name), ' ', '') || '-6' AS pid_key, 'g' || n_nationkey % 3 AS group_key FROM nation WHERE n_nationkey % 5 <> 0"


def class_specification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a specification, and those of a class map with a header and blanks."""
    import json

    spec = json.dumps({"classes": {k: {"material": v.lower(), "design_pressure_barg": 19.6} for k, v in grouping.MATERIAL_SPEC.items()}})
    lines = "﻿piping_class,material\n" + "".join(f" q{r.n_nationkey} , m{r.n_regionkey}\n" for r in _nations(spark, sf_dir)) + ",x\ny,\n"
    path = _put(spark, "specification", {"spec.json": spec.encode(), "map.csv": lines.encode()})
    a = linelists.read_material_spec(spark, f"{path}/spec.json").select(F.col("spec_class").alias("piping_class"), F.col("spec_material").alias("material"), F.col("design_pressure_barg").alias("pressure"))
    return a.unionByName(linelists.read_class_map(spark, f"{path}/map.csv").withColumn("pressure", F.lit(None).cast("double")))


CLASS_SPECIFICATION = "WITH s(c, m) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in grouping.MATERIAL_SPEC.items()) + ") SELECT c AS piping_class, m AS material, 19.6::double AS pressure FROM s UNION ALL SELECT 'Q' || n_nationkey, 'M' || n_regionkey, NULL FROM nation"


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes per class in label files, with lines that are none."""
    path = shared_path(spark, "labels")
    lines = yolo_labels(spark, sf_dir).select(F.col("label").alias("value"))
    lines.unionByName(lines.select(F.substring("value", 1, 9).alias("value"))).write.text(path)
    got = linelists.read_yolo_labels(spark, path)
    return got.groupBy("cls").agg(F.count("*").alias("n"), F.bround(F.sum("cx"), 3).alias("cx"), F.bround(F.sum("h"), 3).alias("h"))


LABEL_FILES = f"""{with_('d_boxes')} SELECT CASE coarse WHEN 'equipment' THEN 0 ELSE 1 END AS cls, count(*) AS n, round_even(sum(round_even((x1 + x2) / 2 / 512, 6)), 3) AS cx, round_even(sum(round_even((y2 - y1) / 512, 6)), 3) AS h FROM d_boxes WHERE coarse IN ('equipment', 'valve') GROUP BY 1"""


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of a training log with padded headers."""
    path = shared_path(spark, "training")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("epoch"), (F.col("event_id") * 7 % 1000).alias("  map50"))
    rows.coalesce(1).write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return linelists.read_training_log(spark, path).select(F.col("epoch").cast("bigint").alias("epoch"), F.col("map50").cast("bigint").alias("map50"))


TRAINING_LOG = "SELECT max(event_id) AS epoch, arg_max(event_id * 7 % 1000, event_id) AS map50 FROM events"


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of result documents that were saved and read again."""
    t = derived(spark, sf_dir, "d_tags")
    docs = t.groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("pid_idx", "pid", "fluid", F.col("conf").alias("conf"), F.col("run_id").cast("int").alias("run_idx")))).alias("piping_ids"))
    path = shared_path(spark, "results")
    linelists.save_results(docs, path)
    linelists.save_results(docs, path)  # a second save replaces the first
    got = linelists.read_results(spark, f"{path}/*")["piping_ids"]
    return got.select(F.regexp_extract("sheet_id", "sheet_id=([0-9]+)", 1).cast("bigint").alias("sheet_id"), "idx", "pid", "fluid", "conf", F.col("run_idx").cast("bigint").alias("run_id"))


RESULT_DOCUMENTS = f"{with_('d_tags')} SELECT sheet_id, cast(row_number() OVER (PARTITION BY sheet_id ORDER BY pid_idx) - 1 AS int) AS idx, pid, fluid, conf, run_id FROM d_tags"


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of uploaded documents, one per page, and which of their caches may be used again."""
    s = derived(spark, sf_dir, "d_sheets")
    files = s.select("sheet_id", F.expr("if(sheet_id % 5 = 0, replace(filename, '.pdf', '.png'), filename)").alias("path"), F.expr("cast(1 + sheet_id % 4 as int)").alias("n_pages"))
    caches = s.select("sheet_id", F.expr("if(sheet_id % 3 = 0, 2, 3)").alias("v"), F.expr("if(sheet_id % 4 = 0, 450, 90)").alias("rot"), F.expr("if(sheet_id % 7 = 0, null, 100 + sheet_id % 2)").alias("w"), F.lit(50).alias("h"))
    good = linelists.valid_cache(caches, 3, 90, 100, 50).select("sheet_id", F.lit(True).alias("cached"))
    # by sheet: from 100000 pages on names are cut to five digits and several sheets share one
    return linelists.page_sheets(files, ("sheet_id",)).join(good, "sheet_id", "left").select("page_path", "sheet_number", F.coalesce("cached", F.lit(False)).alias("cached"))


PAGE_ROWS = f"""{with_('d_sheets')}, s AS (SELECT *, CASE WHEN sheet_id % 5 <> 0 THEN 1 + sheet_id % 4 ELSE 1 END AS n FROM d_sheets), p AS (SELECT *, unnest(range(1, n + 1)) AS k FROM s)
SELECT CASE WHEN sheet_id % 5 = 0 THEN replace(filename, '.pdf', '.png') WHEN n = 1 THEN filename ELSE replace(filename, '.pdf', '') || '-p' || lpad(cast(k AS varchar), 3, '0') || '.pdf' END AS page_path, CASE WHEN n > 1 THEN k || '/' || n ELSE '' END AS sheet_number, sheet_id % 3 <> 0 AND (sheet_id % 7 = 0 OR sheet_id % 2 = 0) AS cached FROM p"""

_ALL = (workbook_entries, ground_truth, class_specification, label_files, training_log, result_documents, page_rows)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
