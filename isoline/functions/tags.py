"""Line tags: normalising, matching against schemas, parsing, and the three keys that identify a line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("unit", "size", "fluid", "pclass", "seq")


@dataclass(frozen=True)
class Schema:
    """A tag format: a pattern with numbered groups, and the group that holds each field."""

    name: str
    pattern: str
    groups: dict[str, int]
    weight: int = 3


#: The two built-in tag formats, and the tolerant form of the first.
SCHEMAS = (
    Schema(
        "unit-size-fluid-class-seq",
        r"(\d{2,3})-(\d{1,2}(?:-\d/\d|/\d)?)[\"']?-([A-Z]{1,4})-([A-Z]{3})-(\d{1,3}[A-Z]{0,3})((?:-[A-Z0-9]{1,5}){0,3})",
        {"unit": 1, "size": 2, "fluid": 3, "pclass": 4, "seq": 5},
    ),
    Schema(
        "unit-fluid-seq-class-size",
        r"(\d{1,3})-([A-Z]{1,2}\d?)-(\d{3,4})-([A-Z][A-Z0-9]{2,4})-(\d{1,2}(?:[-/]\d/\d)?)[\"']?(?:-[A-Z]-?\d{1,3})?",
        {"unit": 1, "fluid": 2, "seq": 3, "pclass": 4, "size": 5},
    ),
)
LOOSE = r"(\d{2,3})-(\d{1,2}(?:-\d/\d|/\d)?)[\"']?-([A-Z][A-Z0-9]{0,3})-([A-Z]{3})-([A-Z0-9]{1,4})((?:-[A-Z0-9]{1,5}){0,3})"
#: Letters read for digits in a sequence number, digits read for letters in a fluid code.
SEQ_REPAIR = ("ODQILZSBGT", "0001125867")
FLUID_REPAIR = ("012568", "OIZSGB")
#: Signs that stand for an inch mark or a one.
MARKS = ("”″’‘'`!|", '""""""11')


#: What a regular expression takes for white space, as characters to delete.
_BLANKS = " \t\n\u000b\f\r"


def normalise(text: Column) -> Column:
    """Upper case; quote variants become \", ! and | become 1; white space goes; any other sign is a single dash."""
    s = F.translate(F.upper(text), MARKS[0] + _BLANKS, MARKS[1])
    return F.btrim(F.regexp_replace(s, r"[^A-Z0-9\"/]+", "-"), F.lit("-"))


def tokens(tag: Column) -> Column:
    """The parts of a normalised tag between dashes."""
    return F.filter(F.split(normalise(tag), "-"), lambda t: t != "")


def repair_seq(seq: Column) -> Column:
    """Letters that are read for digits."""
    return F.translate(seq, *SEQ_REPAIR)


def repair_fluid(fluid: Column) -> Column:
    """Digits that are read for letters."""
    return F.translate(fluid, *FLUID_REPAIR)


def looks_like_tag(s: Column) -> Column:
    """Starts with 2 to 4 digits, has four parts, two letters in a row, and an inch mark or a digit in the last part."""
    parts = F.split(s, "-")
    return s.rlike(r"^\d{2,4}-") & (F.size(parts) >= 4) & s.rlike("[A-Z]{2,}") & (s.contains('"') | F.element_at(parts, -1).rlike(r"\d"))


_MARK = "\u0001"  # no text of a drawing holds it


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _found(s: Column, pattern: str, groups: int) -> Column:
    """The first match of a pattern and its groups as an array, from one pass; an empty array if there is none."""
    marked = F.regexp_replace(s, f"(?s)^.*?({pattern}).*$", "".join(f"{_MARK}${k}" for k in range(1, groups + 2)))
    return F.slice(F.split(marked, _MARK), 2, groups + 1)


def _cascade(s: Column, tries: list[tuple[Column, object]], last: Column) -> Column:
    """What the first of (parts, then) gives that is not null, each computed only if those before it failed."""
    if not tries:
        return last
    parts, then = tries[0]
    return let(parts, lambda p: let(F.when(F.size(p) > 0, then(p)), lambda hit: F.when(hit.isNotNull(), hit).otherwise(_cascade(s, tries[1:], last))))


def _mended(p: Column) -> Column:
    """The repaired tag of a tolerant match, or null."""
    fluid, seq = repair_fluid(p[3]), repair_seq(p[5])
    pid = F.concat(p[1], F.lit("-"), p[2], F.lit('"-'), fluid, F.lit("-"), p[4], F.lit("-"), seq, p[6])
    return F.when(fluid.rlike("^[A-Z]{1,4}$") & seq.rlike(r"^\d{1,3}[A-Z]?$"), pid)


def read(s: Column, schemas: tuple[Schema, ...] = SCHEMAS) -> Column:
    """struct(pid, weight, fields) of a normalised text, null if it is no tag: schemas first, then the tolerant form
    repaired, then tag shape; fields are those of `parse`. Each format is tried once."""
    empty = F.struct(*(F.lit("").alias(f) for f in FIELDS))
    hit = lambda pid, weight, fields: F.struct(pid.alias("pid"), F.lit(weight).alias("weight"), fields.alias("fields"))
    tries = [(_found(s, x.pattern, max(x.groups.values())), lambda p, x=x: hit(p[0], x.weight, F.struct(*(p[x.groups[f]].alias(f) for f in FIELDS)))) for x in schemas]
    mended = lambda p: let(_mended(p), lambda m: F.when(m.isNotNull(), hit(m, 1, parse(m, schemas))))
    return _cascade(s, [*tries, (_found(s, LOOSE, 6), mended)], F.when(looks_like_tag(s), hit(s, 1, empty)))


def match(s: Column, schemas: tuple[Schema, ...] = SCHEMAS) -> Column:
    """struct(pid, weight) of a normalised text, null if it is no tag."""
    tries = [(_found(s, x.pattern, 0), lambda p, w=x.weight: F.struct(p[0].alias("pid"), F.lit(w).alias("weight"))) for x in schemas]
    one = lambda pid: F.struct(pid.alias("pid"), F.lit(1).alias("weight"))
    mended = lambda p: let(_mended(p), lambda m: F.when(m.isNotNull(), one(m)))
    return _cascade(s, [*tries, (_found(s, LOOSE, 6), mended)], F.when(looks_like_tag(s), one(s)))


def parse(pid: Column, schemas: tuple[Schema, ...] = SCHEMAS) -> Column:
    """struct of unit, size, fluid, pclass, seq by the first schema found in the tag; empty fields if there is none."""
    tries = [(_found(pid, x.pattern, max(x.groups.values())), lambda p, g=x.groups: F.struct(*(p[g[f]].alias(f) for f in FIELDS))) for x in schemas]
    return _cascade(pid, tries, F.struct(*(F.lit("").alias(f) for f in FIELDS)))


#: The two formats of tags as they are typed on screen, which must fit the whole text.
TYPED = (
    (r"^(\d{2,4})-?(\d{1,2}(?:[-/]\d/\d|/\d)?[\"']?)-([A-Za-z]{1,4})-([A-Za-z0-9]{2,4})-(\d{1,4}[A-Za-z]{0,3})(?:-(.+))?$", {"unit": 1, "size": 2, "fluid": 3, "pclass": 4, "seq": 5}),
    (r"^(\d{1,4})-([A-Za-z]{1,3}\d?)-(\d{3,5})-([A-Za-z][A-Za-z0-9]{2,4})-(\d{1,2}(?:[-/]\d/\d)?[\"']?)(?:-(.+))?$", {"unit": 1, "fluid": 2, "seq": 3, "pclass": 4, "size": 5}),
)
#: What a part between dashes is, for texts of neither format; the first free field that fits takes it.
SIZE_PART, FLUID_PART, CLASS_PART, SEQ_PART, UNIT_PART = r"^\d+(/\d+)?$", r"^[A-Za-z]{1,4}$", r"^[A-Za-z][A-Za-z0-9]{2,4}$", r"^\d{3,5}[A-Za-z]?$", r"^\d{2,4}$"


def parse_typed(raw: Column) -> Column:
    """struct of unit, size, fluid, pclass, seq of a tag as it is typed: the lenient reading of forms and tables.

    Texts of neither format are taken apart at dashes, from the left: a part with an inch mark, or a number beyond the
    first part while the size is free, is the size; then fluid, class, sequence and (first part only) unit, while free.
    """
    norm = F.regexp_replace(F.translate(F.trim(F.coalesce(raw, F.lit(""))), "”″’‘'`", '""""""'), r"\s+", "")
    upper = lambda f, c: F.upper(c) if f in ("fluid", "pclass") else c

    def guess(s: Column) -> Column:
        empty = F.struct(*(F.lit("").alias(f) for f in FIELDS))
        parts = F.filter(F.split(s, "-"), lambda p: p != "")
        numbered = F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i")))

        def step(a: Column, x: Column) -> Column:
            p, later = x.p, x.i > 0
            size = p.contains('"') | (p.rlike(SIZE_PART) & (a.size == "") & later)
            fluid = ~size & p.rlike(FLUID_PART) & (a.fluid == "")
            pclass = ~size & ~fluid & p.rlike(CLASS_PART) & (a.pclass == "")
            seq = ~size & ~fluid & ~pclass & p.rlike(SEQ_PART) & (a.seq == "")
            unit = ~size & ~fluid & ~pclass & ~seq & p.rlike(UNIT_PART) & (a.unit == "") & ~later
            hits = {"unit": unit, "size": size & (a.size == ""), "fluid": fluid, "pclass": pclass, "seq": seq}
            return F.struct(*(F.when(hits[f], upper(f, p)).otherwise(a[f]).alias(f) for f in FIELDS))

        return F.aggregate(numbered, empty, step)

    def read(s: Column) -> Column:
        tries = [(_found(s, pattern, 6), lambda p, g=groups: F.struct(*(upper(f, p[g[f]]).alias(f) for f in FIELDS))) for pattern, groups in TYPED]
        return _cascade(s, tries, guess(s))

    return let(norm, read)


def parse_learned(tags: DataFrame, learned: DataFrame, pid: str = "pid") -> DataFrame:
    """Add the five fields: built-in schemas, else the learned positions of tags with as many parts.

    learned: n_tokens, field, idx (from 0), one row per field; it is small by nature (fields times lengths) and joins
    as a map per length.
    """
    places = learned.groupBy("n_tokens").agg(F.map_from_entries(F.collect_list(F.struct("field", "idx"))).alias("_places"))
    out = tags.withColumn("_tokens", tokens(F.col(pid))).withColumn("_own", parse(F.col(pid)))
    out = out.join(places, F.size("_tokens") == F.col("n_tokens"), "left")
    own = (F.col("_own.fluid") != "") | (F.col("_own.pclass") != "")
    for f in FIELDS:
        at = F.coalesce(F.get("_tokens", F.try_element_at("_places", F.lit(f)).cast("int")), F.lit(""))
        out = out.withColumn(f, F.when(own, F.col(f"_own.{f}")).otherwise(at))
    return out.drop("_tokens", "_own", "_places", "n_tokens")


def teach(learned: DataFrame, example: str, positions: dict[str, int]) -> DataFrame:
    """The learned positions with those of one example, which replace what was known for its number of parts."""
    spark = learned.sparkSession
    n = spark.range(1).select(F.size(tokens(F.lit(example)))).first()[0]
    rows = [(n, f, int(k)) for f, k in positions.items() if f in FIELDS]
    new = spark.createDataFrame(rows, "n_tokens int, field string, idx int")
    return learned.where(F.col("n_tokens") != n).unionByName(new)


def key_a(pid: Column) -> Column:
    """Identity of a line on one drawing: no inch marks, no blanks."""
    return F.upper(F.translate(pid, '" ', ""))


def key_b(pid: Column) -> Column:
    """Identity of a line in line lists: no white space, quotes, dashes or underscores."""
    return F.upper(F.translate(F.coalesce(pid, F.lit("")), _BLANKS + "\"'-_", ""))


def key_c(pid: Column) -> Column:
    """Identity of a line in reference workbooks: upper case, no inch marks, no white space, single dashes."""
    s = F.translate(F.replace(F.upper(F.trim(pid)), F.lit("''"), F.lit("")), _BLANKS + '"”’', "")
    return F.replace(s, F.lit("--"), F.lit("-"))


def drawing_key(ref: Column) -> Column:
    """A sheet or drawing reference: upper case, no file ending, no blanks, dashes or underscores."""
    s = F.regexp_replace(F.upper(F.trim(F.coalesce(ref, F.lit("")))), r"\.(PNG|JPG|JPEG|PDF)$", "")
    return F.regexp_replace(s, r"[\s_\-]", "")
