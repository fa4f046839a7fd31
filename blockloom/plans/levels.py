"""Levels, modes, methods and pipelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels with their modes and the peers they are measured against.
LEVELS = {
    1: ("wire", "lz4 -9, zstd -1"),
    3: ("general", "gzip -9"),
    9: ("hybrid", "zstd -19 (stretch: xz -9, brotli -11)"),
    19: ("slow", "xz -9, brotli -11 (ratio stretch)"),
}
MODES = ("wire", "general", "fast", "hybrid", "slow")
DEFAULT_LEVEL = 9

# Labels of method ids 0 to 20.
METHODS = {
    0: "COPY",
    1: "CM",
    2: "CM(text)",
    3: "CM(binary)",
    4: "CM(exec)",
    5: "BWT→MTF→RLE0→CM",
    6: "LZP→BWT→MTF→CM",
    7: "JSON-split→BWT→CM",
    8: "byte-CM",
    9: "byte-BWT→MTF→RLE0",
    10: "byte-LZP→BWT→MTF",
    11: "byte-JSON-split→BWT",
    12: "byte-XWRT→BWT→MTF→RLE0",
    13: "XWRT→BWT→MTF→RLE0→CM",
    14: "byte-E8E9→CM",
    15: "CSV-split→BWT→CM",
    16: "XML-split→BWT→CM",
    17: "byte-CSV-split→BWT",
    18: "byte-XML-split→BWT",
    19: "wire-LZ",
    20: "byte-CM(text)",
}
# Method ids of pipelines under the slow coder and under the byte coder.
PIPELINES = {
    "raw": (2, 8),
    "bwt_mtf_rle": (5, 9),
    "lzp_bwt_mtf": (6, 10),
    "json_split": (7, 11),
    "xwrt_bwt_mtf_rle": (13, 12),
    "csv_split": (15, 17),
    "xml_split": (16, 18),
}
KIND_METHODS = {"Random": 0, "Text": 2, "Binary": 3, "Exec": 4}


def parse_level(level: int) -> int:
    """The positive level of a level or its negative alias."""
    if abs(level) not in LEVELS:
        raise ValueError(f"no such level: {level}; there are {', '.join(map(str, LEVELS))}")
    return abs(level)


def resolve_mode(level: int | None = None, mode: str | None = None) -> str:
    """The mode of a level, a mode or both; they must agree.  Without either, of level 9."""
    if mode is not None and mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if level is None:
        return mode or LEVELS[DEFAULT_LEVEL][0]
    named = LEVELS[parse_level(level)][0]
    if mode not in (None, named):
        raise ValueError(f"level {level} is mode {named}, not {mode}")
    return named


def pipeline_method(pipeline: str, mode: str) -> int:
    return PIPELINES[pipeline][0 if mode == "slow" else 1]


def method_pipeline(method: int) -> str:
    """The pipeline whose inverse a method needs."""
    for name, methods in PIPELINES.items():
        if method in methods:
            return name
    if method in (4, 14):
        return "e8e9"
    if method in METHODS:
        return "raw"
    raise ValueError(f"unknown method {method}")


def method_label(method: Column) -> Column:
    pairs = [x for k, v in METHODS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), method.cast("int")), F.lit("?"))


def method_kind(method: Column) -> Column:
    """The kind a method decodes as; an unknown method is an error."""
    m = method.cast("int")
    return (
        F.when(m == 0, "Random").when(m.isin(3, 19), "Binary").when(m.isin(4, 14), "Exec").when(m.between(0, 20), "Text")
        .otherwise(F.raise_error(F.concat(F.lit("unknown method "), m.cast("string"))))
    )
