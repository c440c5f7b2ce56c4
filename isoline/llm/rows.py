"""Names for rows: where a row lies in its Parquet file, so that decisions fall on rows and never on repeated ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from isoline.session import cut

#: What may stand above a scan without repeating its rows.
_PLAIN = {"Project", "Filter", "SubqueryAlias"}


def _is_scan(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in _PLAIN:
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.relation().toString() == "parquet"


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: the file of each row and its number there.

    Rows of anything but a plain read of Parquet files are first written to the shared folder.
    """
    file, row = "_file", "_row"
    while {file, row} & set(docs.columns):
        file, row = "_" + file, "_" + row
    if not _is_scan(docs):
        docs = cut(docs, "located")
    place = docs.metadataColumn("_metadata")
    return docs.select("*", place["file_path"].alias(file), place["row_index"].alias(row)), file, row


def without(here: DataFrame, file: str, row: str, gone: DataFrame) -> DataFrame:
    """The rows of here, which `located` gave, whose place is not in gone (_f, _r)."""
    same: Column = (here[file] == gone["_f"]) & (here[row] == gone["_r"])
    return here.join(gone, same, "left_anti").drop(file, row)
