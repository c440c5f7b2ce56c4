"""Connected components and label propagation on edge tables, as DataFrame loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoline.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node that is reachable.

    Alternates large-star and small-star contraction until the edges form stars. Every round is two grouped
    minima (combined before the shuffle) and two equi-joins whose skewed keys AQE can split; rows never exceed
    twice the edges. Each round is written to the shared folder, so a lost executor costs one round at most.
    Null ends and self loops add no edge, but a self loop's node is returned. Fails loudly at max_rounds.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    # the edges are evaluated here and never again
    first = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    loops = first.where("u = v").select(F.col("u").alias("node"))
    cur, written = first.where("u <> v"), []
    for _ in range(max_rounds):
        if _stars(cur):
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = cut(hooked.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc", written)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    tips = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node")).distinct()
    rest = roots.unionByName(loops).distinct().join(tips.select("node"), "node", "left_anti")
    return tips.unionByName(rest.select("node", F.col("node").alias("component")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none that an edge leads down to has one itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 and down > 0").isEmpty()
