"""Readers: line lists in CSV or workbooks, result documents, class tables, label files, training logs."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.functions.tags import key_c
from isoline.operators.linelist import match_columns, parse_cells
from isoline.session import prepare


CELLS = "source string, row_no int, fields map<string,string>, cells map<string,string>"
#: Bytes up to which a file is read as a whole, and rows that are handed on at a time of a larger one.
WHOLE, ROWS = 8 << 20, 5000


def _cells(source: str, rows: list[list[str | None]], mapping: dict[str, str] | None) -> pd.DataFrame | None:
    """Rows below a header as cells by header and by field; None without a column of line numbers."""
    heads = [h or "" for h in rows[0]] if rows else []
    at = match_columns(heads, mapping)
    if "line_number" not in at:
        return None
    out = []
    for k, r in enumerate(rows[1:], 1):
        cells = {h: v for h, v in zip(heads, r, strict=False) if h and v is not None}
        out.append((source, k, {f: cells[h] for f, h in at.items() if h in cells}, cells))
    return pd.DataFrame(out, columns=["source", "row_no", "fields", "cells"])


def read_csv(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, encoding: str | None = None) -> DataFrame:
    """Entries of CSV line lists with source and row_no; every file has its own header and its own encoding.

    Without a set encoding a file that is not valid UTF-8 is read as Latin-1. Files are read in parallel; those of up to
    WHOLE bytes each as a whole, larger ones in blocks. Fails if a file has no column of line numbers.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").load(path)
    # blocks are told apart by their bytes, which takes an encoding that leaves ASCII as it is
    ascii_ = encoding is None or '\r\n,"'.encode(encoding) == b'\r\n,"'
    large = [r.path for r in files.where(F.col("length") > WHOLE).select("path").collect()] if ascii_ else []

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path_, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    text = content.decode(encoding or "utf-8-sig")
                except UnicodeDecodeError:
                    text = content.decode("latin-1")
                rows = [[c or None for c in r] for r in csv.reader(io.StringIO(text, newline=""))]
                found = _cells(path_, rows, mapping)
                if found is None:
                    raise ValueError(f"{path_} has no column of line numbers")
                yield found

    if not large:
        return parse_cells(files.select("path", "content").mapInPandas(explode, CELLS))
    small = files.where(F.col("length") <= WHOLE).select("path", "content").mapInPandas(explode, CELLS)
    return parse_cells(small.unionByName(_blocks(spark, large, mapping, encoding)))


def _plain(path: str) -> str:
    return re.sub(r"^(\w+):/+", r"\1:/", path)


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _texts(lines: Iterable[bytes], encoding: str) -> Iterator[str]:
    """Lines for csv.reader, which ends them at lone carriage returns as well."""
    for line in lines:
        text = line.decode(encoding) + "\n"
        if "\r" in text:
            yield from io.StringIO(text, newline="")
        else:
            yield text


def _batches(source: str, rows: Iterator[list[str]], first: int, heads: list[str], at: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Rows as cells by header and by field, as in _cells, a few at a time; first is the number of the first one."""

    def maps(dicts: list[dict[str, str]]) -> pa.Array:
        ends = [0]
        for d in dicts:
            ends.append(ends[-1] + len(d))
        keys, items = (pa.array(list(chain.from_iterable(x)), pa.string()) for x in (dicts, (d.values() for d in dicts)))
        return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), keys, items)

    while some := list(islice(rows, ROWS)):
        cells = [{h: v for h, v in zip(heads, r, strict=False) if h and v} for r in some]
        fields = [{f: c[h] for f, h in at.items() if h in c} for c in cells]
        numbers = pa.array(range(first, first + len(some)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([source] * len(some)), numbers, maps(fields), maps(cells)], ["source", "row_no", "fields", "cells"])
        first += len(some)


def _blocks(spark: SparkSession, paths: list[str], mapping: dict[str, str] | None, encoding: str | None) -> DataFrame:
    """The cells of large CSV files, read in blocks of whole lines.

    A first pass counts the rows of every block, which gives row numbers, and sees whether a block ends within quotes. A
    file in which one does, other than the last, has rows that span blocks: its lines are put in order and read by one
    task, line by line. Blocks of all others are read in parallel.
    """
    read = spark.read.option("lineSep", "\n").text([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths])
    lines = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start), group in groupby(_lines(batches), itemgetter(0, 1)):
            bad = False

            def seen(group: Iterator[tuple] = group) -> Iterator[bytes]:
                nonlocal bad
                for _, _, line in group:
                    try:
                        line.decode()
                    except UnicodeDecodeError:
                        bad = True
                    yield line
                yield b"\x01"  # a row of its own, unless the block ends within quotes

            n, head, row, rest = -1, None, None, seen()
            try:
                for row in csv.reader(_texts(rest, "latin-1")):
                    head = row if head is None else head
                    n += 1
            except csv.Error:  # a field beyond csv's limit: quotes that another block has opened, or left open
                row = None
                for _ in rest:
                    pass
            yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "n": n, "open": row != ["\x01"], "bad": bad, "head": head if start == 0 else None}], kinds)

    kinds = pa.schema([("path", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("open", pa.bool_()), ("bad", pa.bool_()), ("head", pa.list_(pa.string()))])
    blocks = sorted(lines.mapInArrow(count, "path string, start long, n long, open boolean, bad boolean, head array<string>").collect(), key=itemgetter(0, 1))
    sources = {_plain(p): p for p in paths}
    plan, first, spanning = {}, {}, []
    for path, group in groupby(blocks, itemgetter(0)):
        own, source = list(group), sources[_plain(unquote(path))]
        code = encoding or ("latin-1" if any(b.bad for b in own) else "utf-8")
        code = "utf-8" if code.lower().replace("_", "-") == "utf-8-sig" else code  # the mark is left out as lines are read
        if any(b.open for b in own[:-1]):
            spanning.append(path)
        heads = [h.encode("latin-1").decode(code) for h in own[0].head or []]
        plan[path] = source, code, heads, match_columns(heads, mapping)
        if path not in spanning and "line_number" not in plan[path][3]:
            raise ValueError(f"{source} has no column of line numbers")
        before = 0
        for b in own:
            first[path, b.start] = before
            before += b.n

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start), group in groupby(_lines(batches), itemgetter(0, 1)):
            source, code, heads, at = plan[path]
            rows = csv.reader(_texts((line for _, _, line in group), code))
            if start == 0:
                next(rows)
            yield from _batches(source, rows, max(1, first[path, start]), heads, at)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, group in groupby(_lines(batches), itemgetter(0)):
            source, code, _, _ = plan[path]
            rows = csv.reader(_texts((line for _, _, _, line in group), code))
            heads = next(rows, [])
            at = match_columns(heads, mapping)
            if "line_number" not in at:
                raise ValueError(f"{source} has no column of line numbers")
            yield from _batches(source, rows, 1, heads, at)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(range(k, k + len(batch)), pa.int64()), batch.columns[2]], ["path", "start", "k", "value"])
            k += len(batch)

    out = lines.where(~F.col("path").isin(spanning)).mapInArrow(explode, CELLS)
    if spanning:
        placed = lines.where(F.col("path").isin(spanning)).mapInArrow(numbered, "path string, start long, k long, value binary")
        out = out.unionByName(placed.repartition(len(spanning), "path").sortWithinPartitions("path", "start", "k").mapInArrow(in_order, CELLS))
    return out


def _sheet_rows(book: zipfile.ZipFile, name: str, shared: list[str]) -> list[list[str | None]]:
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out = []
    for row in ElementTree.fromstring(book.read(name)).iter(f"{ns}row"):
        cells: dict[int, str | None] = {}
        for c in row.iter(f"{ns}c"):
            letters = re.match("[A-Z]+", c.get("r", "A")).group()
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            value, inline = c.find(f"{ns}v"), c.find(f"{ns}is")
            if c.get("t") == "s" and value is not None:
                cells[at - 1] = shared[int(value.text)]
            elif inline is not None:
                cells[at - 1] = "".join(t.text or "" for t in inline.iter(f"{ns}t"))
            elif value is not None:
                cells[at - 1] = value.text
        out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return out


def read_workbooks(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Entries of all worksheets of xlsx files with source (file and worksheet) and row_no, read in parallel by file.

    Worksheets without a tag column are skipped; fails if no worksheet has one. Every cell stays in raw_attributes.
    """
    prepare(spark)

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for frame in frames:
            for path_, content in zip(frame["path"], frame["content"], strict=True):
                book = zipfile.ZipFile(io.BytesIO(content))
                shared = []
                if "xl/sharedStrings.xml" in book.namelist():
                    shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
                for name in sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                    rows = _cells(f"{path_}#{name}", _sheet_rows(book, name, shared), mapping)
                    if rows is not None:
                        yield rows

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(explode, CELLS)
    if found.isEmpty():
        raise ValueError("no worksheet has a column of line numbers")
    return parse_cells(found)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, pid_key, group_key) of reference workbooks (columns Source File, Piping ID, Color Group).

    Lock files (~$ names) and files that cannot be read are skipped; rows without source, id or colour are dropped. Of
    several rows with one source and id the last counts.
    """
    prepare(spark)
    schema = "source string, row_no int, source_file string, pid string, group_key string"

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for frame in frames:
            for path_, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    book = zipfile.ZipFile(io.BytesIO(content))
                    names = book.namelist()
                    shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")] if "xl/sharedStrings.xml" in names else []
                    rows = _sheet_rows(book, min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), shared)
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
                    continue
                heads = [(h or "").strip().lower() for h in rows[0]] if rows else []
                if {"source file", "piping id", "color group"} <= set(heads):
                    at = [heads.index(h) for h in ("source file", "piping id", "color group")]
                    data = [(path_, k, *((r[i] if i < len(r) else None) for i in at)) for k, r in enumerate(rows[1:])]
                    yield pd.DataFrame(data, columns=["source", "row_no", "source_file", "pid", "group_key"])

    files = spark.read.format("binaryFile").load(path).where(~F.regexp_extract("path", "([^/]*)$", 1).startswith("~$"))
    rows = files.select("path", "content").mapInPandas(explode, schema)
    rows = rows.select("source", "row_no", F.trim("source_file").alias("source_file"), key_c(F.col("pid")).alias("pid_key"), F.trim("group_key").alias("group_key"))
    filled = rows.where("source_file <> '' and lower(source_file) <> 'nan' and pid_key <> '' and group_key <> '' and lower(group_key) <> 'nan'")
    return filled.groupBy("source_file", "pid_key").agg(F.max_by("group_key", F.struct("source", "row_no")).alias("group_key"))


def read_material_spec(spark: SparkSession, path: str) -> DataFrame:
    """(spec_class, spec_material, name, design_pressure_barg, design_temperature_c, corrosion_allowance_mm) of a class
    specification: a JSON document whose `classes` map each class to its properties."""
    kind = "material: string, name: string, design_pressure_barg: double, design_temperature_c: double, corrosion_allowance_mm: double"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", f"classes map<string, struct<{kind}>>").alias("d"))
    rows = docs.select(F.explode("d.classes").alias("c", "p"))
    return rows.select(F.upper("c").alias("spec_class"), F.upper("p.material").alias("spec_material"), "p.name", "p.design_pressure_barg", "p.design_temperature_c", "p.corrosion_allowance_mm")


def save_results(docs: DataFrame, path: str) -> None:
    """Write result documents (sheet_id, runs, piping_ids, symbols) as JSON, one folder per sheet, replaced as a whole.

    The output committer moves finished files only, so a reader never sees half a document.
    """
    body = F.to_json(F.struct(*(c for c in docs.columns if c != "sheet_id")))
    out = docs.select("sheet_id", body.alias("value"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sheet_id").text(path)


def valid_cache(caches: DataFrame, version: int, rotation: int, w: int, h: int) -> DataFrame:
    """Caches of read texts that may be used again: made by this version at this rotation and size; a cache that does not
    say its rotation was not turned, one without a size has the drawing's."""
    turned = F.pmod(F.coalesce("rot", F.lit(0)), F.lit(360)) == rotation % 360
    return caches.where((F.col("v") == version) & turned & (F.coalesce("w", F.lit(w)) == w) & (F.coalesce("h", F.lit(h)) == h))


def page_sheets(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of uploaded documents (path, n_pages): path of the page's file, and n/total as sheet number.

    Anything but a document of several pages stays one sheet under its own path, without a number. keys go along: uploads
    may share a path.
    """
    many = F.lower("path").endswith(".pdf") & (F.coalesce("n_pages", F.lit(1)) > 1)
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    pages = files.withColumn("page", F.explode(F.when(many, F.sequence(F.lit(1), F.col("n_pages"))).otherwise(F.array(F.lit(1)))))
    page_path = F.when(many, F.concat(stem, F.lit("-p"), F.lpad(F.col("page").cast("string"), 3, "0"), F.lit(".pdf"))).otherwise(F.col("path"))
    return pages.select(*keys, "path", "page", page_path.alias("page_path"), F.when(many, F.concat_ws("/", "page", "n_pages")).otherwise("").alias("sheet_number"))


def read_line_list(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """By file ending: workbook or CSV; files of any other ending are workbooks if they are zip archives, else CSV."""
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("csv", "txt"):
        return read_csv(spark, path, mapping)
    if end in ("xlsx", "xls"):
        return read_workbooks(spark, path, mapping)
    magic = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4).alias("m")).where(F.col("m") == F.lit(b"PK\x03\x04"))
    return read_csv(spark, path, mapping) if magic.isEmpty() else read_workbooks(spark, path, mapping)


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """(piping_class, material) of a two-column CSV with or without header, byte-order mark or blanks."""
    rows = spark.read.csv(path, header=False, schema="a string, b string")
    a = F.upper(F.trim(F.regexp_replace("a", "^﻿", "")))
    return rows.select(a.alias("piping_class"), F.upper(F.trim("b")).alias("material")).where("piping_class <> '' and material <> '' and piping_class <> 'PIPING_CLASS'")


def read_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Result documents (one JSON document per file) as child tables keyed by sheet and position."""
    box = ", ".join(f"{c}: double" for c in ("x1", "y1", "x2", "y2"))
    schema = f"runs array<struct<id: string, points: array<array<int>>, axis: string, marked: boolean, underline: boolean>>, piping_ids array<struct<pid: string, unit: string, size: string, fluid: string, pclass: string, seq: string, conf: int, run_idx: int, extra_runs: array<int>, {box}>>, symbols array<struct<coarse: string, cls: string, conf: double, manual: boolean, {box}>>"
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("sheet_id"), F.from_json("value", schema).alias("d"))
    return {name: docs.select("sheet_id", F.posexplode(f"d.{name}").alias("idx", "row")).select("sheet_id", "idx", "row.*") for name in ("runs", "piping_ids", "symbols")}


def read_yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """(stem, cls, cx, cy, w, h) of label text files; malformed lines are dropped."""
    parts = F.split(F.trim("value"), r"\s+")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1)
    nums = [F.try_element_at(parts, F.lit(k)).try_cast("double").alias(n) for k, n in ((2, "cx"), (3, "cy"), (4, "w"), (5, "h"))]
    return spark.read.text(path).select(stem.alias("stem"), parts[0].try_cast("int").alias("cls"), *nums).where("cls is not null and h is not null")


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each training log (CSV with an epoch column and padded headers)."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = rows.toDF(*(c.strip() for c in rows.columns))
    last = rows.groupBy(F.input_file_name().alias("source")).agg(F.max_by(F.struct("*"), F.col("epoch").try_cast("double")).alias("r"))
    return last.select("source", "r.*")
