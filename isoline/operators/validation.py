"""Checks of digitised sheets, of grouping and of marking, and review findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoline.operators.spatial import in_cells

#: Order in which findings are listed.
KINDS = ("fluid_suspect", "pid_none", "pid_in_equipment", "fluid_empty", "cp_unattached", "orphan_run")


def percent(part: Column, whole: Column) -> Column:
    """Percentage, rounded half to even; 100 of nothing."""
    return F.bround(F.when(whole > 0, 100.0 * part / F.nullif(whole, F.lit(0))).otherwise(100.0), 1)


def _filled(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def fluid_suspects(tags: DataFrame, keys: tuple[str, ...] = ("sheet_id",), common: int = 3) -> DataFrame:
    """(keys, fluid, suggest): a code used once, one edit away from a code used three times or more.

    Of several the most frequent is suggested, then the first by name. Codes of a sheet are few, so the join runs on
    counts, not on tags.
    """
    code = F.upper(F.trim(F.coalesce("fluid", F.lit(""))))
    n = tags.groupBy(*keys, code.alias("fluid")).agg(F.count("*").alias("n")).where("fluid <> ''")
    big = n.where(F.col("n") >= common).select(*keys, F.col("fluid").alias("suggest"), F.col("n").alias("m"))
    near = n.where("n = 1").join(big, list(keys)).where(F.levenshtein("fluid", "suggest") == 1)
    return near.groupBy(*keys, "fluid").agg(F.min_by("suggest", F.struct(-F.col("m"), F.col("suggest"))).alias("suggest"))


def merge_fluids(tags: DataFrame, suspects: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Tags with suspect codes replaced by what is suggested."""
    own = F.upper(F.trim(F.coalesce("fluid", F.lit(""))))
    out = tags.withColumn("_code", own).join(suspects.withColumnRenamed("fluid", "_code"), [*keys, "_code"], "left")
    return out.withColumn("fluid", F.coalesce("suggest", "fluid")).drop("_code", "suggest")


def digitization(tags: DataFrame, symbols: DataFrame, orphans: DataFrame, keys: tuple[str, ...] = ("sheet_id",), sym_conf: float = 0.35, votes: int = 2) -> DataFrame:
    """Six checks per sheet as rows: check, value, n_ok, n_all, passed. orphans: keys of long pipes without label."""
    n = F.count("*")
    t = tags.groupBy(*keys).agg(n.alias("n_tags"), F.count_if(F.col("run_id").isNotNull()).alias("linked"), F.count_if(_filled("fluid")).alias("fluided"), F.count_if(F.col("conf") >= votes).alias("voted"))
    t = t.join(fluid_suspects(tags, keys).groupBy(*keys).agg(n.alias("suspect")), list(keys), "left")
    t = t.join(symbols.groupBy(*keys).agg(n.alias("n_symbols"), F.count_if(F.col("score") >= sym_conf).alias("sure")), list(keys), "left")
    t = t.join(orphans.groupBy(*keys).agg(n.alias("orphans")), list(keys), "left").fillna(0)
    rows = [
        ("pipe_link", "linked", "n_tags"),
        ("fluid_parsed", "fluided", "n_tags"),
        ("fluid_consistency", "n_tags - suspect", "n_tags"),
        ("symbol_conf", "sure", "n_symbols"),
        ("pid_conf", "voted", "n_tags"),
        ("pipe_labeled", "if(orphans = 0, 1, 0)", "1"),
    ]
    out = t.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.expr(ok).cast("bigint").alias("n_ok"), F.expr(all_).cast("bigint").alias("n_all")) for c, ok, all_ in rows))).alias("c"))
    return out.select(*keys, "c.check", percent(F.col("c.n_ok"), F.col("c.n_all")).alias("value"), "c.n_ok", "c.n_all", (F.col("c.n_ok") == F.col("c.n_all")).alias("passed"))


def _report(rows: DataFrame, keys: tuple[str, ...], checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row per check: (keys, check, value, passed), with a null value where a check does not apply."""
    each = F.array(*(F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), passed.alias("passed")) for name, value, passed in checks))
    return rows.select(*keys, F.explode(each).alias("c")).select(*keys, "c.*").where("value is not null")


def _none(c: str) -> Column:
    """100 if a count of faults is 0, else 0."""
    return F.when(F.col(c) == 0, 100.0).otherwise(0.0)


def grouping(tags: DataFrame, members: DataFrame, systems: DataFrame, breaks: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Six checks per sheet: (keys, check, value, passed).

    one_fluid: members of a system have its fluid. partition: every tag with a fluid is in exactly one system.
    one_material: a circuit's material is its tags' effective one. coverage: tags have a fluid. colors: systems have
    different colours. specbreak, only where breaks lie on labelled pipes: the pipe's class is one of the two codes.

    members: keys, pid_idx, system_fluid, circuit_material, effective_material, one row per tag and circuit; systems:
    keys, fluid, color; breaks: keys, cp_id, run_id, code_a, code_b; labels: keys, run_id, pclass.
    """
    by = list(keys)
    t = tags.groupBy(*keys).agg(F.count("*").alias("n_tags"), F.count_if(_filled("fluid")).alias("fluided"))
    own = tags.select(*keys, "pid_idx", F.upper(F.trim(F.coalesce("fluid", F.lit("")))).alias("own"))
    held = members.join(own, [*keys, "pid_idx"])
    bad = held.groupBy(*keys).agg(F.count_if(F.col("own") != F.col("system_fluid")).alias("bad_fluid"), F.count_if(~F.col("circuit_material").eqNullSafe(F.col("effective_material"))).alias("bad_material"))
    per_tag = held.groupBy(*keys, "pid_idx").agg(F.countDistinct("system_fluid").alias("systems"), F.max("own").alias("own"))
    seen = per_tag.groupBy(*keys).agg(F.count_if(F.col("systems") > 1).alias("dup"), F.count_if(F.col("own") != "").alias("seen"))
    clash = systems.groupBy(*keys).agg((F.count("color") - F.countDistinct("color")).alias("clash"))
    code = F.upper("pclass")
    met = breaks.join(labels.where("pclass <> ''"), [*keys, "run_id"]).groupBy(*keys).agg(F.count("*").alias("met"), F.count_if((code == F.upper("code_a")) | (code == F.upper("code_b"))).alias("agreed"))
    for part in (bad, seen, clash, met):
        t = t.join(part, by, "left")
    t = t.fillna(0).withColumn("missing", F.col("fluided") - F.col("seen"))
    checks = [
        ("one_fluid", _none("bad_fluid"), F.col("bad_fluid") == 0),
        ("partition", percent(F.expr("fluided - dup - missing"), F.col("fluided")), F.expr("dup = 0 and missing = 0")),
        ("one_material", _none("bad_material"), F.col("bad_material") == 0),
        ("coverage", percent(F.col("fluided"), F.col("n_tags")), F.col("fluided") == F.col("n_tags")),
        ("colors", _none("clash"), F.col("clash") == 0),
        ("specbreak", F.when(F.col("met") > 0, percent(F.col("agreed"), F.col("met"))), F.col("agreed") == F.col("met")),
    ]
    return _report(t, keys, checks)


def marking(runs: DataFrame, painted: DataFrame, systems: DataFrame, circuits: DataFrame, keys: tuple[str, ...] = ("sheet_id",), enough: float = 0.75) -> DataFrame:
    """Five checks per sheet: (keys, check, value, passed).

    color_match: painted pipes have their system's colour. refs: painted pipes exist. circuit_colors: circuits of a
    system have different colours. legend: circuit codes are unique. coverage: the share of pipe length (underlines do
    not count) that is painted, passed from `enough` on; absent where there is no pipe.

    runs: keys, run_id, length, underline; painted: keys, run_id, fluid, color; systems: keys, fluid, color; circuits:
    keys, code, fluid, color.
    """
    by = list(keys)
    own = systems.select(*keys, "fluid", F.col("color").alias("_own"))
    p = painted.join(own, [*keys, "fluid"], "left").join(runs.select(*keys, "run_id", F.lit(True).alias("_real")), [*keys, "run_id"], "left")
    t = p.groupBy(*keys).agg(F.countDistinct("run_id").alias("n"), F.count_if(~F.col("color").eqNullSafe(F.col("_own"))).alias("odd"), F.count_if(F.col("_real").isNull()).alias("ghosts"))
    both = runs.where("not coalesce(underline, false)").join(painted.select(*keys, "run_id", F.lit(True).alias("marked")).distinct(), [*keys, "run_id"], "left")
    way = both.groupBy(*keys).agg(F.sum("length").alias("total"), F.coalesce(F.sum(F.when(F.col("marked"), F.col("length"))), F.lit(0)).alias("painted"))
    shades = circuits.groupBy(*keys, "fluid").agg((F.count("color") - F.countDistinct("color")).alias("n")).groupBy(*keys).agg(F.sum("n").alias("clash"))
    codes = circuits.groupBy(*keys).agg((F.count("code") - F.countDistinct("code")).alias("dup"))
    t = runs.select(*keys).distinct().join(t, by, "left").join(way, by, "left").join(shades, by, "left").join(codes, by, "left").fillna(0)
    checks = [
        ("color_match", percent(F.expr("n - odd"), F.col("n")), F.col("odd") == 0),
        ("refs", _none("ghosts"), F.col("ghosts") == 0),
        ("circuit_colors", _none("clash"), F.col("clash") == 0),
        ("legend", _none("dup"), F.col("dup") == 0),
        ("coverage", F.when(F.col("total") > 0, percent(F.col("painted"), F.col("total"))), F.col("painted") >= enough * F.col("total")),
    ]
    return _report(t, keys, checks)


def combined(*reports: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, n_checks, n_failed, score, passed) over all checks of several reports; the score is their mean."""
    rows = None
    for r in reports:
        part = r.select(*keys, "value", "passed")
        rows = part if rows is None else rows.unionByName(part)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"), F.bround(F.avg("value"), 1).alias("score"))
    return out.withColumn("passed", F.col("n_failed") == 0)


def first_flags(findings: DataFrame, limit: int = 12, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """The findings that a report lists: the first `limit` of each sheet in order of kind and subject; the limit is the
    report's own."""
    order = Window.partitionBy(*keys).orderBy("kind_no", "subject")
    return findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def review(tags: DataFrame, equipment: DataFrame, orphans: DataFrame, breaks: DataFrame | None = None, keys: tuple[str, ...] = ("sheet_id",), cell: float = 128.0) -> DataFrame:
    """(keys, kind_no, kind, subject): findings in the order of KINDS; orphans: keys, run_id, length (longest first).

    A tag without pipe whose place lies in equipment is told apart from one that does not. A spec break (breaks: keys,
    cp_id, run_id) on no pipe is a finding.
    """
    rank = F.element_at(F.create_map(*(x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k)))), F.col("kind"))
    suspects = fluid_suspects(tags, keys).select(*keys, F.lit("fluid_suspect").alias("kind"), F.concat_ws(">", "fluid", "suggest").alias("subject"))
    found = lambda rows, kind, subject: rows.select(*keys, F.lit(kind).alias("kind"), F.col(subject).cast("string").alias("subject"))
    free = tags.where("run_id is null")
    at = free.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).join(in_cells(equipment.select(*keys, "x1", "y1", "x2", "y2"), cell), [*keys, "cx", "cy"])
    inside = at.where("x between x1 and x2 and y between y1 and y2").select(*keys, "pid_idx").distinct()
    parts = [
        found(inside, "pid_in_equipment", "pid_idx"),
        found(free.join(inside, [*keys, "pid_idx"], "left_anti"), "pid_none", "pid_idx"),
        found(tags.where("run_id is not null").where(~_filled("fluid")), "fluid_empty", "pid_idx"),
        found(orphans, "orphan_run", "run_id"),
    ]
    if breaks is not None:
        parts.append(found(breaks.where("run_id is null"), "cp_unattached", "cp_id"))
    out = suspects
    for part in parts:
        out = out.unionByName(part)
    return out.select(*keys, rank.alias("kind_no"), "kind", "subject")
