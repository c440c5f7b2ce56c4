"""Names, keys and colours: file stems, cache keys, instrument codes, colour arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coarse class of each fine symbol class.
COARSE = {
    "3 Way Gate Valve": "valve", "4 Way Gate Valve": "valve", "Ball Valve": "valve", "Butterfly Valve": "valve", "Check Valve": "valve",
    "Diaphragm Valve": "valve", "Diaphragm pneumatic control valve": "valve", "Electromagnetic globe valve": "valve", "Gate Valve": "valve",
    "Globe Valve": "valve", "Plug Valve": "valve", "Rotary Piston-Pneumatic Gate Valve": "valve",
    "Centrifugal Pump": "equipment", "Filter": "equipment", "Gear Pump": "equipment", "Heat Exchanger": "equipment",
    "Measurement Instrument": "instrument", "localMeasurement Instrument": "instrument", "device KKS": "instrument", "local device KKS": "instrument",
}
COARSE_NAMES = ("equipment", "instrument", "valve")


#: What instrument codes stand for, and what their first letter does.
INSTRUMENTS = {
    "PSV": "Pressure Safety Valve", "PRV": "Pressure Relief Valve", "PT": "Pressure Transmitter", "PI": "Pressure Indicator", "PG": "Pressure Gauge",
    "PIC": "Pressure Indicating Controller", "PIT": "Pressure Indicating Transmitter", "PDT": "Pressure Differential Transmitter", "PDI": "Pressure Differential Indicator",
    "PV": "Pressure (Control) Valve", "PSHH": "Pressure Switch High-High",
    "TT": "Temperature Transmitter", "TI": "Temperature Indicator", "TG": "Temperature Gauge", "TIC": "Temperature Indicating Controller",
    "TV": "Temperature (Control) Valve", "TE": "Temperature Element", "TA": "Temperature Alarm", "TZT": "Temperature Safety Transmitter",
    "FT": "Flow Transmitter", "FI": "Flow Indicator", "FE": "Flow Element", "FIC": "Flow Indicating Controller", "FV": "Flow (Control) Valve",
    "FC": "Flow Controller", "FO": "Flow Orifice (restriksi)",
    "LT": "Level Transmitter", "LI": "Level Indicator", "LG": "Level Gauge/Glass", "LIC": "Level Indicating Controller", "LV": "Level (Control) Valve",
    "LA": "Level Alarm", "LZT": "Level Safety Transmitter", "LSH": "Level Switch High", "LSL": "Level Switch Low", "LYC": "Level Computing Controller",
    "SDV": "Shutdown Valve", "BDV": "Blowdown Valve", "ESD": "Emergency Shutdown", "XV": "On-Off Valve", "ZI": "Position Indicator", "ZS": "Position Switch",
    "ZT": "Position Transmitter", "HS": "Hand Switch", "HIC": "Hand Indicating Controller", "HV": "Hand Valve", "XI": "Multivariable Indicator", "XA": "Multivariable Alarm",
    "UA": "Multivariable Alarm", "AI": "Analysis Indicator", "AT": "Analysis Transmitter", "SC": "Sample Connection", "RO": "Restriction Orifice", "SP": "Sample Point",
    "PY": "Pressure Relay/Compute", "TY": "Temperature Relay/Compute",
}
MEASURED = {"P": "Pressure", "T": "Temperature", "F": "Flow", "L": "Level", "A": "Analysis", "Z": "Position", "H": "Hand", "S": "Speed/Safety", "V": "Vibration", "X": "Multivariable"}
#: What the letters of an equipment tag stand for; the form of such a tag, of an instrument's function and
#: of a loop number; the text for what could not be read; names of symbols without a finer class.
EQUIPMENT = {
    "V": "Vessel", "D": "Drum", "T": "Tank", "C": "Column", "E": "Heat exchanger", "K": "Compressor", "P": "Pump", "F": "Filter / coalescer", "R": "Reactor", "H": "Heater", "S": "Separator", "B": "Blower", "X": "Package / skid",
}
EQUIPMENT_TAG = r"\d{2,3}\s*-\s*[A-Z]{1,3}\s*-\s*\d{2,4}\s*[A-Z]?"
FUNCTION = r"^([A-Z]{2,4})[\s\-]*([0-9][0-9A-Z\-]*)?$"
LOOP = r"^\d{2,4}[A-Z]{0,2}$"
NOT_READ = "(not read)"
OTHER = {"equipment": "Other equipment", "instrument": "Other instrument", "valve": "Other valve"}


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def safe_stem(name: Column) -> Column:
    """The name of a drawing's files: no folder, no ending, dots as underscores; page if nothing is left."""
    base = F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("page")), r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    stem = F.regexp_replace(base, r"\.", "_")
    return F.when(stem == "", "page").otherwise(stem)


def etag(path: Column, mtime_ns: Column, size: Column) -> Column:
    """Identity of a file's content for caches: the first 32 digits of the digest of path, time and size."""
    return F.substring(F.sha2(F.concat_ws("|", path, mtime_ns.cast("string"), size.cast("string")), 256), 1, 32)


def describe_instrument(code: Column) -> Column:
    """What an instrument code stands for: the table's text, else what its first letter measures."""
    c = F.upper(F.coalesce(code, F.lit("")))
    general = F.concat(F.try_element_at(_table(MEASURED), F.substring(c, 1, 1)), F.lit(" instrument"))
    return F.coalesce(F.try_element_at(_table(INSTRUMENTS), c), general, F.lit("Instrument"))


def clean_tag(text: Column) -> Column:
    """An equipment or instrument tag: upper case, no blanks."""
    return F.replace(F.regexp_replace(F.upper(F.trim(text)), r"\s*-\s*", "-"), F.lit(" "), F.lit(""))


def describe_equipment(tag: Column) -> Column:
    """The kind of equipment by the first letter of its tag; empty if the text is no tag."""
    letters = F.regexp_extract(F.coalesce(tag, F.lit("")), r"^\d{2,3}-([A-Z]{1,3})-", 1)
    return F.when(letters == "", "").otherwise(F.coalesce(F.try_element_at(_table(EQUIPMENT), F.substring(letters, 1, 1)), F.lit("Equipment")))


def display_class(subtype: Column, coarse: Column) -> Column:
    """The name of a symbol's class on screen: its finer class, else the rest of its coarse one."""
    return F.coalesce(F.nullif(F.trim(F.coalesce(subtype, F.lit(""))), F.lit("")), F.try_element_at(_table(OTHER), coarse), F.lit("Other"))


def cache_key(*parts: Column) -> Column:
    """A digest of several values, in order; null counts as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def coarse_of(name: Column) -> Column:
    """The coarse class of a fine class; a coarse class is its own, anything else is other."""
    table = F.create_map(*(F.lit(x) for kv in (COARSE | {c: c for c in COARSE_NAMES}).items() for x in kv))
    return F.coalesce(F.try_element_at(table, name), F.lit("other"))
