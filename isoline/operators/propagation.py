"""Label propagation along pipes: shortest distance from labelled pipes, as a DataFrame loop or per sheet."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoline.session import cut, prepare

SLACK = 1e-6


def propagate(runs: DataFrame, edges: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = ("sheet_id",), max_dist: float | None = None, max_rounds: int = 200) -> DataFrame:
    """(keys, run_id, source, dist, hops, inferred): the label whose way along the pipes is shortest.

    Entering a pipe costs its length. Seeds (keys, run_id, source) are never overwritten and have distance 0. Of equal
    distances fewer hops win, then the smaller source. runs: keys, run_id, length; edges: keys, a, b (undirected).
    Each round relaxes only the pipes that changed; fails loudly at max_rounds. For graphs that span sheets.
    """
    both = edges.select(*keys, F.col("a").alias("run_id"), F.col("b").alias("next")).unionByName(edges.select(*keys, F.col("b").alias("run_id"), F.col("a").alias("next")))
    step = cut(both.join(runs.select(*keys, F.col("run_id").alias("next"), "length"), [*keys, "next"]).join(seeds.select(*keys, F.col("run_id").alias("next")), [*keys, "next"], "left_anti"), "steps")
    best = cut(seeds.groupBy(*keys, "run_id").agg(F.min("source").alias("source")).select(*keys, "run_id", "source", F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(True).alias("fresh")), "labels")
    for _ in range(max_rounds):
        reached = best.where("fresh").join(step, [*keys, "run_id"]).select(*keys, F.col("next").alias("run_id"), "source", (F.col("dist") + F.col("length")).alias("dist"), (F.col("hops") + 1).alias("hops"))
        if max_dist is not None:
            reached = reached.where(F.col("dist") <= max_dist)
        way = F.struct("dist", "hops", "source")
        reached = reached.groupBy(*keys, "run_id").agg(F.min(way).alias("w"))
        old = best.select(*keys, "run_id", F.struct("dist", "hops", "source").alias("o"))
        merged = old.join(reached, [*keys, "run_id"], "full")
        better = F.col("o").isNull() | F.coalesce(F.col("w") < F.col("o"), F.lit(False))
        now = F.when(better, F.col("w")).otherwise(F.col("o"))
        best = cut(merged.select(*keys, "run_id", now.alias("n"), better.alias("fresh")).select(*keys, "run_id", "n.source", "n.dist", "n.hops", "fresh"), "labels")
        if best.where("fresh").isEmpty():
            return best.select(*keys, "run_id", "source", "dist", "hops", (F.col("hops") > 0).alias("inferred"))
    raise RuntimeError(f"labels did not settle within {max_rounds} rounds")


def propagate_by_sheet(runs: DataFrame, edges: DataFrame, seeds: DataFrame, key: str = "sheet_id") -> DataFrame:
    """The same for graphs within a sheet: one small group per sheet, searched from all seeds at once."""
    prepare(runs.sparkSession)
    rows = runs.select(key, F.col("run_id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("length").cast("double").alias("length"), F.lit("run").alias("kind"))
    rows = rows.unionByName(edges.select(key, "a", "b", F.lit(None).cast("double").alias("length"), F.lit("edge").alias("kind")))
    rows = rows.unionByName(seeds.select(key, F.col("run_id").alias("a"), F.col("source").cast("bigint").alias("b"), F.lit(None).cast("double").alias("length"), F.lit("seed").alias("kind")))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        part = dict(list(frame.groupby("kind")))
        lengths = dict(zip(part["run"]["a"], part["run"]["length"], strict=True)) if "run" in part else {}
        near: dict[int, set[int]] = {}
        for a, b in zip(part["edge"]["a"], part["edge"]["b"].astype("int64"), strict=True) if "edge" in part else ():
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        start: dict[int, int] = {}
        for a, s in zip(part["seed"]["a"], part["seed"]["b"].astype("int64"), strict=True) if "seed" in part else ():
            start[a] = min(s, start.get(a, s))
        done: dict[int, tuple[float, int, int]] = {}
        queue = [(0.0, 0, s, a) for a, s in start.items()]
        heapq.heapify(queue)
        while queue:
            d, h, s, a = heapq.heappop(queue)
            if a in done:
                continue
            done[a] = (d, h, s)
            for b in near.get(a, ()):
                if b not in done and b not in start and b in lengths:
                    heapq.heappush(queue, (d + lengths[b], h + 1, s, b))
        sheet = frame[key].iloc[0]
        return pd.DataFrame([(sheet, a, s, d, h, h > 0) for a, (d, h, s) in done.items()], columns=[key, "run_id", "source", "dist", "hops", "inferred"])

    kind = dict(runs.dtypes)[key]
    return rows.groupBy(key).applyInPandas(search, f"{key} {kind}, run_id bigint, source bigint, dist double, hops int, inferred boolean")


def break_classes(labels: DataFrame, runs: DataFrame, breaks: DataFrame, tol: float, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """Labels with the class that a spec break states for its two halves, where the label is inferred.

    breaks: keys, cp_id, x, y, orient (H: left and right, V: above and below), code_a, code_b. A break counts if
    exactly two pipes end within tol of it; the one further left (above) takes code_a.
    """
    ends = runs.select(*keys, "run_id", ((F.col("x1") + F.col("x2")) / 2).alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my"), F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e"))
    size = max(tol, 1.0)
    ends = ends.select(*keys, "run_id", "mx", "my", "e.x", "e.y").withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    b = breaks.select(*keys, "cp_id", "orient", "code_a", "code_b", F.col("x").alias("bx"), F.col("y").alias("by"))
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size) + 1))
    b = b.withColumn("cx", around("bx")).withColumn("cy", around("by"))
    halves = b.join(ends, [*keys, "cx", "cy"]).where(f"abs(x - bx) <= {tol} and abs(y - by) <= {tol}").select(*keys, "cp_id", "orient", "code_a", "code_b", "run_id", "mx", "my").distinct()
    by = Window.partitionBy(*keys, "cp_id")
    order = by.orderBy(F.when(F.col("orient") == "H", F.col("mx")).otherwise(F.col("my")), "run_id")
    halves = halves.withColumn("n", F.count("*").over(by)).withColumn("side", F.row_number().over(order)).where("n = 2")
    code = halves.groupBy(*keys, "run_id").agg(F.max_by(F.when(F.col("side") == 1, F.col("code_a")).otherwise(F.col("code_b")), "cp_id").alias("code"))
    out = labels.join(code, [*keys, "run_id"], "left")
    return out.withColumn("pclass", F.when(F.col("inferred") & F.col("code").isNotNull(), F.col("code")).otherwise(F.col("pclass"))).drop("code")


def coverage(runs: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """(keys, n_direct, n_inferred, n_runs)."""
    both = runs.select(*keys, "run_id").join(labels.select(*keys, "run_id", "inferred"), [*keys, "run_id"], "left")
    return both.groupBy(*keys).agg(F.count_if(~F.col("inferred")).alias("n_direct"), F.count_if("inferred").alias("n_inferred"), F.count("*").alias("n_runs"))


def fallback_seeds(free_tags: DataFrame, near: DataFrame, components: DataFrame, labelled: DataFrame, key: str = "sheet_id") -> DataFrame:
    """(sheet, run_id, pid_idx): tags without pipe claim the nearest component that has no label, one each.

    near: sheet, pid_idx, run_id, distance candidates; components: sheet, run_id, component; labelled: sheet, run_id.
    Nearest first, then component, pipe and tag; greedy within a sheet.
    """
    prepare(near.sparkSession)
    taken = labelled.join(components, [key, "run_id"]).select(key, "component").distinct()
    cand = near.join(free_tags.select(key, "pid_idx"), [key, "pid_idx"], "left_semi").join(components, [key, "run_id"]).join(taken, [key, "component"], "left_anti")

    def claim(frame: pd.DataFrame) -> pd.DataFrame:
        used, named, out = set(), set(), []
        for r in frame.sort_values(["distance", "component", "run_id", "pid_idx"]).itertuples(index=False):
            if r.component not in used and r.pid_idx not in named:
                used.add(r.component)
                named.add(r.pid_idx)
                out.append((getattr(r, key), r.run_id, r.pid_idx))
        return pd.DataFrame(out, columns=[key, "run_id", "pid_idx"])

    return cand.select(key, "distance", "component", "run_id", "pid_idx").groupBy(key).applyInPandas(claim, f"{key} {dict(near.dtypes)[key]}, run_id bigint, pid_idx bigint")
