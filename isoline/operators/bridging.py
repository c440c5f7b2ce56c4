"""Joining traced pipes over the gaps that tracing leaves at bends and at valves.

Joins go in rounds. In a round the pairs of pipe ends that a rule allows are ranked by their gap, then by their ids; a pair
is joined if it comes first for both its pipes, so that a pipe takes part in one join at most and the result does not
depend on the order of rows. A joined pipe keeps the smaller id. Rounds end when no pair is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.functions import geometry as g
from isoline.operators.spatial import cell_join, end_pairs, in_cells
from isoline.session import cut

KEYS = ("sheet_id",)
_BOX = ("x1", "y1", "x2", "y2")
#: A pipe heads along an axis if it moves this much more on it; how far beside a valve a gap's middle lies.
HEADS, BESIDE = 1.5, 15


def _ends(runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Both ends of every polyline with the direction in which it leaves the pipe."""
    p = lambda k: F.element_at("points", k)
    end = lambda which, k, back: F.struct(F.lit(which).alias("which"), p(k)[0].alias("x"), p(k)[1].alias("y"), (p(k)[0] - p(back)[0]).alias("dx"), (p(k)[1] - p(back)[1]).alias("dy"))
    rows = runs.select(*keys, "run_id", "grew", g.length(F.col("points")).alias("way"), F.explode(F.array(end(1, 1, 2), end(2, -1, -2))).alias("e"))
    return rows.select(*keys, "run_id", "grew", "way", "e.*")


def _unblocked(pairs: DataFrame, blocks: DataFrame | None, keys: tuple[str, ...], cell: float = 128.0) -> DataFrame:
    """Pairs of ends whose gap no box of blocks meets."""
    if blocks is None:
        return pairs
    own = [*keys, "a", "b", "a_which", "b_which"]
    span = pairs.select(*own, *(F.expr(f"{f}(a_{c}, b_{c})").alias(n) for n, f, c in (("l", "least", "x"), ("t", "least", "y"), ("r", "greatest", "x"), ("u", "greatest", "y"))))
    near = cell_join(in_cells(span, cell, 0.0, ("l", "t", "r", "u")), in_cells(blocks.select(*keys, *_BOX), cell), [*keys, "cx", "cy"])
    return pairs.join(near.where("l <= x2 and r >= x1 and t <= y2 and u >= y1").select(*own).distinct(), own, "left_anti")


def _rounds(runs: DataFrame, reach: float, rule: Callable[[DataFrame], DataFrame], keys: tuple[str, ...], max_rounds: int) -> DataFrame:
    old: list[str] = []
    cur = cut(runs.where("size(points) >= 2").select(*keys, "run_id", F.transform("points", lambda p: F.transform(p, lambda c: c.cast("double"))).alias("points"), F.lit(False).alias("grew"), F.lit(1).alias("n_runs")), "bridge", old)
    for _ in range(max_rounds):
        pairs = end_pairs(_ends(cur, keys), reach, keys).withColumn("gap", F.expr("sqrt(pow(a_x - b_x, 2) + pow(a_y - b_y, 2))")).where(f"gap <= {reach}")
        found = cut(rule(pairs).select(*keys, "a", "b", "a_which", "b_which", F.struct("gap", "a", "b", "a_which", "b_which").alias("rank")), "bridge-pairs")
        if found.isEmpty():
            return cur.drop("grew")
        both = found.select(*keys, F.col("a").alias("run_id"), "rank").unionByName(found.select(*keys, F.col("b").alias("run_id"), "rank"))
        first = both.groupBy(*keys, "run_id").agg(F.min("rank").alias("first"))
        taken = found
        for side in "ab":
            taken = taken.join(first.select(*keys, F.col("run_id").alias(side), F.col("first").alias(f"_{side}")), [*keys, side])
        taken = cut(taken.where("rank = _a and rank = _b").select(*keys, "a", "b", "a_which", "b_which"), "bridge-taken")
        part = lambda s: cur.select(*keys, F.col("run_id").alias(s), F.col("points").alias(f"{s}_points"), F.col("n_runs").alias(f"{s}_n"))
        turned = lambda s, keep: F.when(F.col(f"{s}_which") == keep, F.col(f"{s}_points")).otherwise(F.reverse(f"{s}_points"))
        joined = taken.join(part("a"), [*keys, "a"]).join(part("b"), [*keys, "b"])
        points = F.concat(turned("a", 2), turned("b", 1))
        joined = joined.select(*keys, F.col("a").alias("run_id"), _once(points).alias("points"), F.lit(True).alias("grew"), (F.col("a_n") + F.col("b_n")).alias("n_runs"))
        used = taken.select(*keys, F.col("a").alias("run_id")).unionByName(taken.select(*keys, F.col("b").alias("run_id")))
        cur = cut(cur.join(used, [*keys, "run_id"], "left_anti").unionByName(joined), "bridge", old)
    raise RuntimeError(f"pipes did not settle within {max_rounds} rounds")


def _once(points: Column) -> Column:
    """Points without those that repeat the one before."""
    none = F.array().cast("array<array<double>>")
    return F.aggregate(points, none, lambda s, p: F.when((F.size(s) > 0) & (F.try_element_at(s, F.lit(-1)) == p), s).otherwise(F.concat(s, F.array(p))))


def bridge_bends(runs: DataFrame, max_gap: float = 60.0, max_length: float = 140.0, max_turn: float = 75.0, blocks: DataFrame | None = None, keys: tuple[str, ...] = KEYS, max_rounds: int = 60) -> DataFrame:
    """(keys, run_id, points, n_runs): pipes with the short pieces that tracing leaves at bends.

    Two ends join if they are at most max_gap apart, one of the pipes is at most max_length long or is itself joined,
    the way does not turn by more than max_turn degrees, and no box of blocks lies in the gap.
    """

    def rule(pairs: DataFrame) -> DataFrame:
        norm = "(sqrt(a_dx * a_dx + a_dy * a_dy) * sqrt(b_dx * b_dx + b_dy * b_dy))"
        cosine = f"greatest(-1.0D, least(1.0D, -(a_dx * b_dx + a_dy * b_dy) / nullif({norm}, 0)))"
        free = pairs.where(f"(a_grew or a_way <= {max_length} or b_grew or b_way <= {max_length}) and coalesce(degrees(acos({cosine})), 0) <= {max_turn}")
        return _unblocked(free, blocks, keys)

    return _rounds(runs, max_gap, rule, keys, max_rounds)


def bridge_valves(runs: DataFrame, valves: DataFrame, max_gap: float = 75.0, tol: float = 6.0, blocks: DataFrame | None = None, keys: tuple[str, ...] = KEYS, max_rounds: int = 60, cell: float = 128.0) -> DataFrame:
    """(keys, run_id, points, n_runs): pipes joined over valves and instruments that stand in line.

    Two ends join if they are at most max_gap apart, one of them near a valve, and either both pipes go on along one
    axis within tol of each other, or they head alike and a valve (give or take BESIDE) holds the middle of the gap.
    Sheets without valves stay as they are.
    """

    def rule(pairs: DataFrame) -> DataFrame:
        flat = lambda s: f"abs({s}_dx) >= {HEADS} * abs({s}_dy)"
        tall = lambda s: f"abs({s}_dy) >= {HEADS} * abs({s}_dx)"
        dx, dy = "abs(a_x - b_x)", "abs(a_y - b_y)"
        line = f"({flat('a')} and {flat('b')} and {dy} <= {tol} and {dx} > 0) or ({tall('a')} and {tall('b')} and {dx} <= {tol} and {dy} > 0)"
        alike = f"({flat('a')}) = ({flat('b')}) and ({tall('a')}) = ({tall('b')})"
        rows = pairs.where("gap > 0").where(f"({line}) or ({alike})").withColumns({"line": F.expr(line), "alike": F.expr(alike), "mx": F.expr("(a_x + b_x) / 2"), "my": F.expr("(a_y + b_y) / 2")})
        box = in_cells(valves.select(*keys, *_BOX), cell, 2 * max_gap)
        at = cell_join(rows.withColumn("cx", F.floor(F.col("mx") / cell)).withColumn("cy", F.floor(F.col("my") / cell)), box, [*keys, "cx", "cy"])
        near = lambda s: f"({s}_x between x1 - {max_gap} and x2 + {max_gap} and {s}_y between y1 - {max_gap} and y2 + {max_gap})"
        between = f"mx between x1 - {BESIDE} and x2 + {BESIDE} and my between y1 - {BESIDE} and y2 + {BESIDE}"
        own = [*keys, "a", "b", "a_which", "b_which", "gap", "a_x", "a_y", "b_x", "b_y"]
        seen = at.groupBy(*own, "line", "alike").agg(F.bool_or(F.expr(f"{near('a')} or {near('b')}")).alias("near"), F.bool_or(F.expr(between)).alias("between"))
        return _unblocked(seen.where("near and (line or (alike and between))"), blocks, keys)

    return _rounds(runs, max_gap, rule, keys, max_rounds)
