"""Joins by cell never broadcast rows that were exploded into cells, however few Spark takes them for."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoline.operators import spatial, tracing, vector
from isoline.plans.derive import derived


def exploded_broadcasts(df: DataFrame) -> int:
    """How many broadcasts of the plan hold rows that were exploded."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    found = 0
    for k, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            found += any("Generate explode" in y for y in lines[k:end])
    return found


def _runs(spark, small):
    return derived(spark, small, "d_runs")


def _ends(spark, small):
    return spatial.ends_of(_runs(spark, small))


CASES = {
    "tokens_near": lambda s, d: spatial.tokens_near(_runs(s, d).select("sheet_id", "run_id", F.col("x2").alias("x"), F.col("y2").alias("y")), derived(s, d, "d_points").withColumn("text", F.lit("T")), 180.0),
    "drop_glyph_noise": lambda s, d: tracing.drop_glyph_noise(_runs(s, d), 120.0, 25.0),
    "stitch": lambda s, d: tracing.stitch(_runs(s, d).withColumnRenamed("run_id", "new_id"), _runs(s, d), 40.0),
    "bar_regions": lambda s, d: vector.bar_regions(derived(s, d, "d_segs")),
    "v_regions": lambda s, d: vector.v_regions(derived(s, d, "d_segs")),
    "split_at_regions": lambda s, d: vector.split_at_regions(_runs(s, d), derived(s, d, "d_boxes")),
    "drop_inside": lambda s, d: tracing.drop_inside(_runs(s, d), derived(s, d, "d_boxes"), 1.0),
    "split_at_tees": lambda s, d: spatial.split_at_tees(_runs(s, d), 3.0, 6.0),
    "end_pairs": lambda s, d: spatial.end_pairs(_ends(s, d), 60.0),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_no_exploded_rows_are_broadcast(spark, small, name):
    assert exploded_broadcasts(CASES[name](spark, small)) == 0


def test_the_check_sees_such_broadcasts(spark, small):
    runs = _runs(spark, small)
    cells = runs.select("sheet_id", F.explode(F.sequence(F.col("x1") - 1, F.col("x1") + 1)).alias("x1"))
    assert exploded_broadcasts(runs.join(F.broadcast(cells), ["sheet_id", "x1"])) == 1
