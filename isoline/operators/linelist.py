"""Line lists: header matching, typed rows, merging of repeated rows and enrichment of tags."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.functions import measures
from isoline.functions.tags import key_b

NUMBERS = ("design_pressure_barg", "design_temperature_c", "operating_pressure_barg", "operating_temperature_c", "corrosion_allowance_mm", "corrosion_rate_mmpy")
TEXTS = ("fluid_phase", "insulation", "notes", "source_file", "material", "corrosion_loop", "service_condition")


@dataclass(frozen=True)
class Rule:
    """A header belongs to a field if it has all patterns and none of the others."""

    field: str
    has: tuple[str, ...]
    lacks: tuple[str, ...] = ()


_OPERATING, _DESIGN = r"oper|oprt|\bop\b|\bop\.", "design|dsgn"
#: Header patterns of each field, in the order in which a header is tried.
RULES = (
    Rule("line_number", (r"line.*(?:no|num|tag|id)|(?:no|num|tag|id).*line|piping.*id|id.*piping|pipe.*id|^tag$",)),
    Rule("operating_pressure_barg", (_OPERATING, "pres"), (_DESIGN,)),
    Rule("operating_temperature_c", (_OPERATING, "temp"), (_DESIGN,)),
    Rule("design_pressure_barg", (_DESIGN, "pres")),
    Rule("design_temperature_c", (_DESIGN, "temp")),
    Rule("fluid_phase", (r"fluid phase|\bphase\b|\bstate\b",)),
    Rule("insulation", ("insul",)),
    Rule("notes", (r"\bnotes?\b|\bremarks?\b|\bketerangan\b|\bcomments?\b",)),
    Rule("material", (r"\bmatl\b|\bmaterial\b|pipe\s*mat",), ("spec", "color")),
    Rule("corrosion_allowance_mm", (r"corrosion\s*allow|\bca\b|\(ca\)",)),
    Rule("corrosion_rate_mmpy", (r"corrosion\s*rate|\bcr\b|\(cr\)",)),
    Rule("corrosion_loop", (r"corr(?:osion)?\.?\s*loop|corrosion\s*circuit|\bcircuit\b|loop\s*tag",)),
    Rule("service_condition", ("service",), ("phase",)),
    Rule("source_file", (r"source\s*file|dwg\s*no|drawing|p&id",)),
)
FIELDS = tuple(r.field for r in RULES)
#: Other names of fields that a user's mapping may give.
ALIASES = {
    "piping_id": "line_number", "pid": "line_number", "tag": "line_number", "line_no": "line_number",
    "operating_pressure": "operating_pressure_barg", "op_pressure": "operating_pressure_barg", "op_press": "operating_pressure_barg",
    "operating_temperature": "operating_temperature_c", "op_temperature": "operating_temperature_c", "op_temp": "operating_temperature_c",
    "design_pressure": "design_pressure_barg", "dsgn_pressure": "design_pressure_barg", "dsgn_press": "design_pressure_barg",
    "design_temperature": "design_temperature_c", "dsgn_temperature": "design_temperature_c", "dsgn_temp": "design_temperature_c",
    "phase": "fluid_phase", "insul": "insulation", "note": "notes", "remarks": "notes", "remark": "notes", "keterangan": "notes", "matl": "material",
    "corrosion_allowance": "corrosion_allowance_mm", "ca": "corrosion_allowance_mm", "corrosion_rate": "corrosion_rate_mmpy", "cr": "corrosion_rate_mmpy",
    "corr_loop": "corrosion_loop", "circuit": "corrosion_loop", "service": "service_condition", "dwg_no": "source_file",
}


def clean_header(header: str | None) -> str:
    """Lower case with single blanks."""
    return re.sub(r"\s+", " ", (header or "").strip().lower())


def field_of(name: str) -> str | None:
    """The field that a name or another name of it stands for."""
    name = clean_header(name).replace(" ", "_")
    return name if name in FIELDS else ALIASES.get(name)


def match_columns(headers: list[str], mapping: dict[str, str] | None = None) -> dict[str, str]:
    """Field to header. A mapping given by the user comes first, in either direction; then each header, from the left,
    takes the first field that it fits and that no header has taken."""
    found: dict[str, str] = {}
    clean = [clean_header(h) for h in headers]
    for a, b in (mapping or {}).items():
        one, two = (field_of(x) for x in (a, b))
        field, source = (one, b) if one else (two, a) if two else (None, "")
        want = clean_header(source)
        hit = next((h for h, c in zip(headers, clean, strict=True) if field and want and want in c), None)
        if hit is not None:
            found[field] = hit
    for h, c in zip(headers, clean, strict=True):
        rule = next((r for r in RULES if c and r.field not in found and all(re.search(p, c) for p in r.has) and not any(re.search(p, c) for p in r.lacks)), None)
        if rule:
            found[rule.field] = h
    return found


def parse_rows(rows: DataFrame, mapping: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed entries of raw rows whose columns are all strings; every original cell stays in raw_attributes.

    Rows without a tag are dropped. Fails if no column is a tag column. The headers are metadata, so matching them
    needs no pass over the rows. keep: columns that are no cells, such as source and row_no, and stay as they are.
    """
    heads = [c for c in rows.columns if c not in keep]
    at = match_columns(heads, mapping)
    if "line_number" not in at:
        raise ValueError("a line list needs a column of line numbers")
    cell = {f: F.col(f"`{at[f]}`").cast("string") if f in at else F.lit(None).cast("string") for f in FIELDS}
    raw = F.map_from_arrays(F.array(*(F.lit(h) for h in heads)), F.array(*(F.col(f"`{h}`").cast("string") for h in heads)))
    return _entries(rows, cell, raw, keep)


def parse_cells(rows: DataFrame, keep: tuple[str, ...] = ("source", "row_no")) -> DataFrame:
    """Typed entries of rows with `fields` (map from field to cell) and `cells` (map from header to cell): the form in
    which files whose headers differ are read together."""
    cell = {f: F.try_element_at("fields", F.lit(f)) for f in FIELDS}
    return _entries(rows, cell, F.col("cells"), keep)


def _entries(rows: DataFrame, cell: dict[str, Column], raw: Column, keep: tuple[str, ...]) -> DataFrame:
    tag = F.trim(cell["line_number"])
    typed: list[Column] = [tag.alias("line_number")]
    typed += [measures.number(cell[f]).alias(f) for f in NUMBERS]
    as_text = {"fluid_phase": measures.phase, "insulation": lambda c: F.upper(measures.text(c)), "material": lambda c: F.upper(measures.text(c))}
    typed += [as_text.get(f, measures.text)(cell[f]).alias(f) for f in TEXTS]
    return rows.select(*keep, *typed, raw.alias("raw_attributes")).where((F.col("line_number") != "") & ~F.lower("line_number").isin("none", "nan", "null"))


def merge_entries(entries: DataFrame, order: str = "row_no", numbers: tuple[str, ...] = NUMBERS, texts: tuple[str, ...] = TEXTS) -> DataFrame:
    """One entry per line: of every field the first value that is there, in row order; empty text is no value."""
    key = key_b(F.col("line_number"))
    first = [F.expr(f"min_by(`{c}`, `{order}`) filter (where `{c}` is not null)").alias(c) for c in numbers]
    first += [F.coalesce(F.expr(f"min_by(`{c}`, `{order}`) filter (where `{c}` <> '')"), F.lit("")).alias(c) for c in texts]
    return entries.groupBy(key.alias("line_key")).agg(F.min_by("line_number", order).alias("line_number"), *first, F.count("*").alias("n_rows")).where("line_key <> ''")


def enrich(tags: DataFrame, lines: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Overwrite fields of tags with what the line list says of their line; blanks overwrite nothing. Adds matched.

    fields: tag column to line-list column. lines has one row per line_key (merge_entries).
    """
    right = lines.select(F.col("line_key").alias("_key"), *(F.col(v).alias(f"_{k}") for k, v in fields.items()))
    out = tags.join(right, key_b(F.col("pid")) == F.col("_key"), "left").withColumn("matched", F.col("_key").isNotNull())
    kinds = dict(right.dtypes)
    for k in fields:
        new = F.nullif(f"_{k}", F.lit("")) if kinds[f"_{k}"] == "string" else F.col(f"_{k}")
        out = out.withColumn(k, F.coalesce(new, F.col(k)))
    return out.drop("_key", *(f"_{k}" for k in fields))
