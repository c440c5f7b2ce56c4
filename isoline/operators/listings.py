"""Listings of projects, sheets and line lists: filters by key and tenant, and the order in which rows are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def of_tenant(rows: DataFrame, tenant_id: object) -> DataFrame:
    """Rows of one tenant; every read goes through it, also of a single row."""
    return rows.where(F.col("tenant_id") == F.lit(tenant_id))


def by_key(rows: DataFrame, key: str, value: object, tenant_id: object | None = None) -> DataFrame:
    """The row with a key, if the tenant may see it; no row otherwise."""
    found = rows.where(F.col(key) == F.lit(value))
    return found if tenant_id is None else of_tenant(found, tenant_id)


def ordered_projects(projects: DataFrame) -> DataFrame:
    """Projects with their place in their tenant's list: newest first, then by id."""
    return projects.withColumn("place", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), "project_id")))


def ordered_sheets(sheets: DataFrame) -> DataFrame:
    """Sheets with their place in their project's list: by time, then by page number (the part of sheet_number before a
    slash, 0 if it is no number), then by id."""
    page = F.split(F.coalesce("sheet_number", F.lit("")), "/")[0]
    number = F.when(page.rlike("^[0-9]+$"), page.try_cast("bigint")).otherwise(0)
    return sheets.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", number, "sheet_id")))


def sheets_by_number(sheets: DataFrame) -> DataFrame:
    """Sheets with their place in their project's topology: by number, then by file; sheets that share both, by id."""
    return sheets.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy("sheet_number", "filename", "sheet_id")))


def preview(entries: DataFrame, order: str = "row_no", limit: int = 100) -> DataFrame:
    """The first entries of a line list; the limit is the preview's own."""
    return entries.orderBy(order).limit(limit)
