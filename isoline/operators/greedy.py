"""Operators whose result depends on the order of steps: one small group per sheet, sorted by explicit keys first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoline.functions import geometry as g
from isoline.operators.graph import connected_components
from isoline.operators.spatial import in_cells
from isoline.session import cut, prepare

_BOX = ["x1", "y1", "x2", "y2"]


def _areas(b: np.ndarray) -> np.ndarray:
    return np.maximum(0, b[..., 2] - b[..., 0]) * np.maximum(0, b[..., 3] - b[..., 1])


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0])) * np.maximum(0, np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]))


def _keep(rows: DataFrame, key: str, choose: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Rows that a sheet's greedy choice keeps."""
    prepare(rows.sparkSession)
    return rows.groupBy(key).applyInPandas(choose, rows.schema)


def nms(boxes: DataFrame, iou: float = 0.5, key: str = "sheet_id") -> DataFrame:
    """Boxes that no box of a higher score overlaps by more than iou; equal scores by box_id."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "box_id"], ascending=[False, True])
        b = frame[_BOX].to_numpy(float)
        size, alive, kept = _areas(b), np.ones(len(b), bool), []
        for k in range(len(b)):
            if alive[k]:
                kept.append(k)
                inter = _shared(b[k], b)
                alive &= inter / (size[k] + size - inter + 1e-9) <= iou
        return frame.iloc[kept]

    return _keep(boxes, key, choose)


def suppress_nested(boxes: DataFrame, share: float = 0.55, key: str = "sheet_id") -> DataFrame:
    """Boxes of which no kept larger box holds more than `share`; equal sizes by box_id."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        b = frame[_BOX].to_numpy(float)
        frame = frame.assign(_a=-_areas(b)).sort_values(["_a", "box_id"]).drop(columns="_a")
        b = frame[_BOX].to_numpy(float)
        size, kept = _areas(b), []
        for k in range(len(b)):
            if not (size[k] > 0 and kept and (_shared(b[k], b[kept]) / size[k] > share).any()):
                kept.append(k)
        return frame.iloc[kept]

    return _keep(boxes, key, choose)


def merge_boxes(boxes: DataFrame, gap: float | None = None, overlap: float = 0.25, key: str = "sheet_id", max_rounds: int = 30, cell: float = 128.0) -> DataFrame:
    """Unions of boxes, to a fixpoint: boxes at most `gap` apart, or (no gap) sharing over `overlap` of the smaller.

    Returns (key, x1, y1, x2, y2, n_boxes). In every round boxes that meet, directly or through others, become the box
    around them all, whatever their order; rounds go on until none meet. Fails loudly at max_rounds.
    """
    kinds = dict(boxes.dtypes)
    old: list[str] = []
    cur = cut(boxes.select(F.struct(key, "box_id").alias("box"), key, *_BOX, F.lit(1).alias("n_boxes")), "boxes", old)
    pad = gap or 0.0
    for _ in range(max_rounds):
        a, b = (in_cells(cur, cell, d).select(key, "cx", "cy", *(F.col(c).alias(f"{p}_{c}") for c in ("box", *_BOX))) for p, d in (("a", pad), ("b", 0.0)))
        near = a.join(b, [key, "cx", "cy"]).where(f"a_box < b_box and a_x1 - {pad} <= b_x2 and b_x1 - {pad} <= a_x2 and a_y1 - {pad} <= b_y2 and b_y1 - {pad} <= a_y2")
        if gap is None:
            small = F.least(g.area("a_"), g.area("b_"))
            near = near.where((small > 0) & (g.intersection("a_", "b_") / F.nullif(small, F.lit(0)) > overlap))
        edges = cut(near.select("a_box", "b_box").distinct(), "box-pairs")
        if edges.isEmpty():
            return cur.select(key, *_BOX, "n_boxes")
        home = connected_components(edges, "a_box", "b_box")
        rows = cur.join(home, cur.box == home.node, "left").withColumn("box", F.coalesce("component", "box"))
        around = [F.min(c).alias(c) if c in ("x1", "y1") else F.max(c).alias(c) for c in _BOX]
        cur = cut(rows.groupBy("box", key).agg(*around, F.sum("n_boxes").cast("int").alias("n_boxes")).select("box", key, *(F.col(c).cast(kinds[c]).alias(c) for c in _BOX), "n_boxes"), "boxes", old)
    raise RuntimeError(f"boxes did not settle within {max_rounds} rounds")


def cluster_tags(tags: DataFrame, merge_dist: float, min_votes: int = 2, key: str = "sheet_id") -> DataFrame:
    """Readings of one label: clusters around a running mean, seeded by the strongest; a weighted vote names each.

    tags: key, pid_idx, pid, x, y, weight. Returns key, pid, x, y (medians), conf (votes). Ties go to the longer text,
    then to the one met first; readings go by weight, then pid_idx. A sheet's readings are one sorted array, folded
    into an array of sums: each reading joins the first cluster whose mean is within merge_dist on both axes.
    """
    kind = dict(tags.dtypes)[key]
    sheet = tags.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "pid_idx", "pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("rs"))
    home = f"array_position(transform(s.c, o -> abs(r.x - o.x / o.n) <= {merge_dist} and abs(r.y - o.y / o.n) <= {merge_dist}), true)"
    joined = "if(h = 0, concat(s.c, array(named_struct('x', r.x, 'y', r.y, 'n', 1L))), transform(s.c, (o, i) -> if(i = h - 1, named_struct('x', o.x + r.x, 'y', o.y + r.y, 'n', o.n + 1L), o)))"
    step = f"get(transform(array({home}), h -> named_struct('c', {joined}, 'at', concat(s.at, array(if(h = 0, bigint(size(s.c)), h - 1))))), 0)"
    start = "named_struct('c', cast(array() as array<struct<x:double,y:double,n:bigint>>), 'at', cast(array() as array<bigint>))"
    at = sheet.select(key, F.expr(f"inline(arrays_zip(rs, aggregate(rs, {start}, (s, r) -> {step}).at))").alias("r", "at"))
    rows = at.select(key, "at", "r.pid", "r.x", "r.y", (-F.col("r.w")).alias("weight"), F.struct("r.w", "r.pid_idx").alias("met"))
    place = rows.groupBy(key, "at").agg(F.percentile("x", 0.5).alias("x"), F.percentile("y", 0.5).alias("y"), F.sum("weight").cast("int").alias("conf")).where(F.col("conf") >= min_votes)
    votes = rows.groupBy(key, "at", "pid").agg(F.sum("weight").alias("votes"), F.min("met").alias("met"))
    best = Window.partitionBy(key, "at").orderBy(F.desc("votes"), F.desc(F.length("pid")), "met")
    name = votes.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(key, "at", "pid")
    return place.join(name, [key, "at"]).select(F.col(key).cast(kind).alias(key), "pid", "x", "y", "conf")


def match_boxes(truth: DataFrame, found: DataFrame, iou: float = 0.5, key: str = "sheet_id") -> DataFrame:
    """(key, box_id, score, coarse, tp): predictions, each truth used once, in order of score, then box_id."""
    prepare(truth.sparkSession)
    cols = [key, "box_id", "coarse", "score", *_BOX]
    rows = truth.withColumn("score", F.lit(None).cast("double")).select(*cols, F.lit(True).alias("is_truth")).unionByName(found.select(*cols, F.lit(False).alias("is_truth")))

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for cls, part in frame.groupby("coarse"):
            t, p = part[part.is_truth].sort_values("box_id"), part[~part.is_truth].sort_values(["score", "box_id"], ascending=[False, True])
            tb, free = t[_BOX].to_numpy(float), np.ones(len(t), bool)
            for r in p.itertuples(index=False):
                hit = False
                if free.any():
                    b = np.array([r.x1, r.y1, r.x2, r.y2], float)
                    inter = _shared(b, tb)
                    union = _areas(b) + _areas(tb) - inter
                    score = np.where(free & (union > 0), inter / np.where(union > 0, union, 1), -1)
                    k = int(score.argmax())
                    hit = bool(score[k] >= iou)
                    free[k] &= not hit
                out.append((getattr(r, key), r.box_id, r.score, cls, hit))
        return pd.DataFrame(out, columns=[key, "box_id", "score", "coarse", "tp"])

    return rows.groupBy(key, "coarse").applyInPandas(match, f"{key} {dict(truth.dtypes)[key]}, box_id bigint, score double, coarse string, tp boolean")
