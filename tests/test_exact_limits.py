"""Results at the very limits of rules: shares, halves of pixels, repeated paths, ties."""

import duckdb
import pytest

from isoline.operators import association, listings
from isoline.plans import registry


def test_underlines_of_just_the_share(spark):
    """A line is an underline if 55 percent of it, or just that, lies under its label; lengths and shares are exact."""
    labels, runs, want = [], [], set()
    for k, n in enumerate(range(1, 201)):
        share = -(-55 * n // 100)
        for off, cover in enumerate((share, share - 1)):
            i = 2 * k + off
            labels.append((i, i, 1000, 100, 1000 + 120, 112))
            runs.append((i, i, "H", 1120 - cover, 112, 1120 - cover + n, 112))
            if cover > 0 and 100 * cover >= 55 * n and 10 * n <= 19 * 120:
                want.add(i)
    lab = spark.createDataFrame(labels, "sheet_id long, pid_idx long, x1 long, y1 long, x2 long, y2 long")
    got = association.underlines(lab, spark.createDataFrame(runs, "sheet_id long, run_id long, axis string, x1 long, y1 long, x2 long, y2 long"), 8.0, 9.0)
    assert {r.pid_idx for r in got.collect()} == want


@pytest.fixture
def orders(spark, tmp_path):
    """Puts orders into a folder of tables: (o_orderkey, o_custkey) each."""

    def put(rows):
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"file://{tmp_path}/orders.parquet")
        return str(tmp_path)

    return put


def test_stub_whose_middle_is_half_a_pixel_away(spark, orders):
    """The stub's middle lies half a pixel beside a valve's reach and is put on the whole pixel within it."""
    folder = orders([(112604, 3542), (112608, 10756), (460266, 54916), (460272, 54982), (460245, 53229)])
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    want = {r[1] for r in c.sql(registry.SQL["no_stubs"]).fetchall()}
    got = {r.run_id for r in registry.QUERIES["no_stubs"](spark, folder).collect()}
    assert 112604 in want and got == want


def test_pages_of_sheets_that_share_a_path(spark, tmp_path):
    """Six-digit sheets whose names are cut to one path keep their own pages and caches."""
    ids = [*range(155270, 155290), *range(15520, 15530)]
    spark.createDataFrame([(i,) for i in ids], "page_id long").coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = c.sql(f"SELECT page_path, sheet_number, cached FROM ({registry.SQL['page_rows']})").fetchall()
    got = registry.QUERIES["page_rows"](spark, str(tmp_path)).select("page_path", "sheet_number", "cached")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_sheets_that_share_number_and_file_go_by_id(spark):
    """Places do not depend on the order in which sheets come."""
    ids = [i * 7919 % 1000 for i in range(1000)]
    sheets = spark.createDataFrame([(1, i, f"{i % 3:03d}", "a.pdf") for i in ids], "project_id int, sheet_id long, sheet_number string, filename string")
    got = listings.sheets_by_number(sheets).orderBy("place").collect()
    assert [r.sheet_id for r in got] == sorted(ids, key=lambda i: (i % 3, i))
