"""Line, asset and legend registers, annotation and tile tables, training labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoline.functions import naming

def line_register(circuit_tags: DataFrame, tags: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Lines in the order of system, circuit and tag with a running number; lines of no circuit follow, by tag.

    circuit_tags: keys, code, pid_idx; tags: keys, pid_idx, pid, fluid, pclass.
    """
    rows = tags.join(circuit_tags.select(*keys, "pid_idx", "code"), [*keys, "pid_idx"], "left")
    order = Window.partitionBy(*keys).orderBy(F.col("code").asc_nulls_last(), "pid", "pid_idx")
    return rows.withColumn("line_no", F.row_number().over(order)).select(*keys, "line_no", F.coalesce("code", F.lit("-")).alias("code"), "pid", "fluid", "pclass", "pid_idx")


def symbol_register(symbols: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Symbols numbered per class from top to bottom, then left to right."""
    order = Window.partitionBy(*keys, "coarse").orderBy("y1", "x1", "box_id")
    return symbols.withColumn("item_no", F.row_number().over(order)).select(*keys, "coarse", "item_no", "box_id")


def counts(symbols: DataFrame, by: str, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Number of symbols per value, the most frequent first: rank, value, n."""
    n = symbols.groupBy(*keys, by).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), by)))


def legend(painted: DataFrame, keys: tuple[str, ...] = ("sheet_id",), color: str = "color") -> DataFrame:
    """Colours of a marked sheet with the number of pipes and the first group that uses each."""
    return painted.groupBy(*keys, color).agg(F.count("*").alias("n_pipes"), F.min("group_name").alias("group_name"))


def annotations(runs: DataFrame, manual: DataFrame, automatic: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Group of each pipe on the marked sheet: a manual group wins over an automatic one; pipes of neither are left out."""
    m, a = manual.select(*keys, "run_id", F.col("group_name").alias("_m")), automatic.select(*keys, "run_id", F.col("group_name").alias("_a"))
    rows = runs.join(m, [*keys, "run_id"], "left").join(a, [*keys, "run_id"], "left")
    return rows.withColumn("group_name", F.coalesce("_m", "_a")).withColumn("manual", F.col("_m").isNotNull()).where("group_name is not null").drop("_m", "_a")


def yolo_labels(boxes: DataFrame, w: float, h: float, classes: list[str]) -> DataFrame:
    """Label lines (class, centre and size as shares of the sheet); unknown classes are left out."""
    number = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col("coarse")) - 1
    shares = [(F.col("x1") + F.col("x2")) / 2 / w, (F.col("y1") + F.col("y2")) / 2 / h, (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h]
    rows = boxes.withColumn("cls", number).where("cls >= 0")
    return rows.select(*(c for c in boxes.columns), "cls", F.format_string("%d %.6f %.6f %.6f %.6f", "cls", *(F.bround(x, 6) for x in shares)).alias("label"))


def tiles(sheets: DataFrame, tile: int = 256) -> DataFrame:
    """Index of an image pyramid: (sheet_id, level, col, row) of every tile; level 0 is one pixel."""
    top = F.ceil(F.log2(F.greatest("width", "height").cast("double"))).cast("int")
    rows = sheets.select("sheet_id", "width", "height", F.explode(F.sequence(F.lit(0), top)).alias("level"), top.alias("top"))
    scale = F.pow(F.lit(2.0), F.col("top") - F.col("level"))
    last = lambda side: F.greatest(F.ceil(F.ceil(F.col(side) / scale) / tile) - 1, F.lit(0)).cast("int")
    rows = rows.withColumn("col", F.explode(F.sequence(F.lit(0), last("width"))))
    return rows.withColumn("row", F.explode(F.sequence(F.lit(0), last("height")))).select("sheet_id", "level", "col", "row")


def read_bubbles(texts: DataFrame, keys: tuple[str, ...] = ("sheet_id", "box_id")) -> DataFrame:
    """(keys, func, loop): function and loop number of instrument bubbles from their texts, from top to bottom.

    texts: keys, x, y, text. The first text that reads as a function gives it; the first loop number is taken, from the
    same text or from one of its own.
    """
    t = naming.clean_tag(F.col("text"))
    own = texts.select(*keys, "y", "x", t.alias("t")).withColumn("f", F.regexp_extract("t", naming.FUNCTION, 1)).withColumn("n", F.regexp_extract("t", naming.FUNCTION, 2))
    loop = F.when(F.col("f") != "", F.col("n")).otherwise(F.col("t"))
    own = own.withColumn("loop", F.when(loop.rlike(naming.LOOP), loop))
    place = F.struct("y", "x", "t")
    out = own.groupBy(*keys).agg(F.expr("min_by(f, struct(y, x, t)) filter (where f <> '')").alias("func"), F.min_by(F.col("loop"), F.when(F.col("loop").isNotNull(), place)).alias("loop"))
    return out.select(*keys, F.coalesce("func", F.lit("")).alias("func"), F.coalesce("loop", F.lit("")).alias("loop"))


def mend_loops(first: DataFrame, closer: DataFrame, keys: tuple[str, ...] = ("sheet_id", "box_id")) -> DataFrame:
    """Readings of bubbles with loop numbers of four digits and more replaced by those of a closer look, if these are the
    end of the first reading: a second look never makes up a number. A missing function may come from it as well."""
    again = closer.select(*keys, F.col("func").alias("_func"), F.col("loop").alias("_loop"))
    rows = first.join(again, list(keys), "left")
    long = F.length(F.regexp_replace("loop", r"\D", "")) >= 4
    take = long & (F.coalesce("_loop", F.lit("")) != "") & (F.col("_loop") != F.col("loop")) & F.col("loop").endswith(F.col("_loop"))
    return rows.select(*keys, F.when(take & (F.col("func") == ""), F.col("_func")).otherwise(F.col("func")).alias("func"), F.when(take, F.col("_loop")).otherwise(F.col("loop")).alias("loop"))


def equipment_register(symbols: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, no, tag, desc, source, x, y): equipment from top to bottom, then left to right.

    symbols: keys, box_id, x1 .. y2, tag, desc, subtype. What a person typed (subtype) is a tag if it reads as one, else
    a description; it fills what was not read.
    """
    typed = F.trim(F.coalesce("subtype", F.lit("")))
    is_tag = typed.rlike(naming.EQUIPMENT_TAG)
    tag, desc = (F.coalesce(c, F.lit("")) for c in ("tag", "desc"))
    tag_ = F.when((tag == "") & is_tag, naming.clean_tag(typed)).otherwise(tag)
    desc_ = F.when((desc == "") & (typed != "") & ~is_tag, typed).otherwise(desc)
    order = Window.partitionBy(*keys).orderBy("y1", "x1", "box_id")
    fill = lambda c, other: F.when(c == "", other).otherwise(c)
    return symbols.select(*keys, F.row_number().over(order).alias("no"), fill(tag_, naming.NOT_READ).alias("tag"), fill(desc_, "Equipment").alias("desc"), F.when(typed == "", "detected").otherwise("manual").alias("source"), *_middle())


def _middle() -> list[Column]:
    return [((F.col(f"{c}1") + F.col(f"{c}2")) / 2).cast("int").alias(c) for c in "xy"]


def instrument_register(symbols: DataFrame, units: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, no, tag, func, desc, x, y): instruments from top to bottom; symbols: keys, box_id, x1 .. y2, func, loop.

    The tag starts with the unit that most lines of the sheet have, the first of equals (units: keys, unit, pid_idx).
    """
    votes = units.where("unit <> ''").groupBy(*keys, "unit").agg(F.count("*").alias("n"), F.min("pid_idx").alias("first"))
    top = votes.groupBy(*keys).agg(F.max_by("unit", F.struct("n", -F.col("first"))).alias("unit"))
    rows = symbols.join(top, list(keys), "left")
    order = Window.partitionBy(*keys).orderBy("y1", "x1", "box_id")
    func = F.coalesce("func", F.lit(""))
    part = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    tag = F.when(func == "", naming.NOT_READ).otherwise(F.concat_ws("-", part("unit"), part("func"), part("loop")))
    desc = F.when(func == "", "Instrument").otherwise(naming.describe_instrument(func))
    return rows.select(*keys, F.row_number().over(order).alias("no"), tag.alias("tag"), F.when(func == "", naming.NOT_READ).otherwise(func).alias("func"), desc.alias("desc"), *_middle())


def valve_items(symbols: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, no, type, x, y): valves from top to bottom, named by their finer class."""
    order = Window.partitionBy(*keys).orderBy("y1", "x1", "box_id")
    return symbols.select(*keys, F.row_number().over(order).alias("no"), naming.display_class(F.col("subtype"), F.lit("valve")).alias("type"), *_middle())


def break_register(breaks: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, no, codes, attached, x, y): spec breaks in order of cp_id."""
    order = Window.partitionBy(*keys).orderBy("cp_id")
    attached = F.when(F.col("run_id").isNotNull(), "yes").otherwise("no")
    return breaks.select(*keys, F.row_number().over(order).alias("no"), F.concat_ws(" | ", "code_a", "code_b").alias("codes"), attached.alias("attached"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def system_register(circuits: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, code, fluid, n_lines, n_pipes, n_circuits, classes): corrosion systems, summed from their circuits (keys,
    code, fluid, n_pipes, n_tags, classes as a list with commas)."""
    number = F.concat(F.lit("#"), F.substring_index("code", ".", 1))
    classes = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split("classes", ","), lambda c: c != ""))))), ", ")
    return circuits.groupBy(*keys, number.alias("code"), "fluid").agg(F.sum("n_tags").alias("n_lines"), F.sum("n_pipes").alias("n_pipes"), F.count("*").alias("n_circuits"), classes.alias("classes"))


def circuit_register(circuits: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, code, fluid, material, classes, n_lines): corrosion circuits; a missing material is a dash."""
    return circuits.select(*keys, "code", "fluid", F.coalesce(F.nullif("material", F.lit("")), F.lit("-")).alias("material"), F.replace("classes", F.lit(","), F.lit(", ")).alias("classes"), F.col("n_tags").alias("n_lines"))


def register_summary(tables: dict[str, DataFrame], keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, item, n): rows of each register table per sheet; a sheet that is in any table has every item."""
    rows = None
    for name, t in tables.items():
        part = t.select(*keys, F.lit(name).alias("item"))
        rows = part if rows is None else rows.unionByName(part)
    n = rows.groupBy(*keys).pivot("item", list(tables)).count().fillna(0)
    return n.select(*keys, F.explode(F.array(*(F.struct(F.lit(t).alias("item"), F.col(f"`{t}`").alias("n")) for t in tables))).alias("c")).select(*keys, "c.*")


def painted_paths(paths: DataFrame, pipe_width: float, saturation: float = 0.15, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """What becomes of each path when a marked drawing is unmarked: keep, redraw (black, at pipe width) or drop.

    paths: keys, path_id, color and fill (arrays of red, green, blue from 0 to 1, or null), width, length of its straight
    lines. Colours are marks if their channels differ by more than `saturation`. A marked fill is a note; a marked
    stroke is a pipe if it is wide, or longer than 40.
    """
    mark = lambda c: F.coalesce(F.array_max(c) - F.array_min(c) > saturation, F.lit(False))
    pipe = (F.coalesce("width", F.lit(0.0)) >= max(1.0, 1.3 * pipe_width)) | (F.col("length") > 40)
    return paths.select(*keys, "path_id", F.when(mark("fill"), "drop").when(~mark("color"), "keep").when(pipe, "redraw").otherwise("drop").alias("what"))


def pipe_width(paths: DataFrame, default: float = 0.72, saturation: float = 0.15, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys, width): median width of strokes that are no marks; a page without any has the default."""
    mark = lambda c: F.coalesce(F.array_max(c) - F.array_min(c) > saturation, F.lit(False))
    own = F.when((F.coalesce("width", F.lit(0.0)) > 0) & ~mark("color") & ~mark("fill"), F.col("width"))
    return paths.groupBy(*keys).agg(F.coalesce(F.percentile(own, 0.5), F.lit(default)).alias("width"))


def training_samples(samples: DataFrame, boxes: DataFrame, classes: tuple[str, ...] = ("equipment", "instrument", "valve")) -> DataFrame:
    """(sheet_id, box_id, label): label lines of the boxes of reviewed sheets.

    samples: sheet_id, reviewed, w, h. Corners may be given in any order; boxes without extent and of other classes are
    left out. A sheet whose review was withdrawn has no rows, so writing the table anew withdraws its sample.
    """
    rows = boxes.join(samples.where("reviewed and w > 0 and h > 0").select("sheet_id", "w", "h"), "sheet_id")
    number = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col("coarse")) - 1
    side = lambda c, size: (F.expr(f"(x1 + x2) / 2 / {size}") if c == "x" else F.expr(f"(y1 + y2) / 2 / {size}"))
    rows = rows.withColumns({"cls": number, "cx": side("x", "w"), "cy": side("y", "h"), "bw": F.expr("abs(x2 - x1) / w"), "bh": F.expr("abs(y2 - y1) / h")}).where("cls >= 0 and bw > 0 and bh > 0")
    return rows.select("sheet_id", "box_id", F.format_string("%d %.6f %.6f %.6f %.6f", "cls", *(F.bround(c, 6) for c in ("cx", "cy", "bw", "bh"))).alias("label"))
