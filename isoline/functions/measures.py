"""Cells of line lists: numbers with units, phases and blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of nothing, and of the three phases.
NO_NUMBER = ("", "-", "--", "n/a", "na", "none", "null", "nil", "nan")
NO_TEXT = ("none", "nan", "null", "nil")
PHASES = {"L": ("L", "LIQ", "LIQUID"), "G": ("G", "GAS", "V", "VAP", "VAPOR", "STEAM"), "2P": ("2P", "2-PHASE", "2 PHASE", "TWO PHASE", "MIX", "MIXED")}


def number(cell: Column) -> Column:
    """The number a cell starts with; a comma is a decimal point, so 1,234.5 gives 1.234. Null if there is none."""
    s = F.replace(F.trim(cell), F.lit(","), F.lit("."))
    found = F.nullif(F.regexp_extract(s, r"^[-+]?[0-9]*\.?[0-9]+", 0), F.lit(""))
    return F.when(~F.lower(s).isin(*NO_NUMBER), found.try_cast("double"))


def phase(cell: Column) -> Column:
    """L, G, 2P, or the cell in upper case; empty for null."""
    s = F.upper(F.trim(F.coalesce(cell, F.lit(""))))
    out = s
    for code, names in PHASES.items():
        out = F.when(s.isin(*names), code).otherwise(out)
    return out


def text(cell: Column) -> Column:
    """The trimmed cell; empty for null and for words that say nothing."""
    s = F.trim(F.coalesce(cell, F.lit("")))
    return F.when(F.lower(s).isin(*NO_TEXT), "").otherwise(s)
