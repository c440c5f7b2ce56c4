"""Queries take all rows of their tables."""

import pytest

from isoline.plans import registry
from isoline.plans.derive import derived


@pytest.mark.parametrize("name", ["propagation_by_sheet", "propagation_loop"])
def test_every_tag_is_a_seed(spark, small, name):
    got = registry.QUERIES[name](spark, small).where("not inferred")
    want = derived(spark, small, "d_tags").where("run_id is not null and fluid <> ''").groupBy("sheet_id", "run_id").agg({"pid_idx": "min"})
    assert sorted(tuple(r) for r in got.select("sheet_id", "run_id", "source").collect()) == sorted(tuple(r) for r in want.collect())
