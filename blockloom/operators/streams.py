"""Structured blocks as streams: totals by expressions, and the streams themselves without loss."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import as_column
from ..kernels import shred

STRING = '"(?:[^"\\\\]|\\\\.)*"'
NUMBER = "-?[0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def json_totals(text: Column | str) -> Column:
    """Struct of counts: keys, strings, numbers, and the length of the rest, strings taken out first."""
    t = as_column(text)
    keys = F.size(_found(t, f"({STRING})[ \\t\\r\\n]*:", 1))
    strings = F.size(_found(t, STRING)) - keys
    bare = F.regexp_replace(t, STRING, "")
    return F.struct(
        keys.cast("long").alias("n_keys"), strings.cast("long").alias("n_strings"), F.size(_found(bare, NUMBER)).cast("long").alias("n_numbers"),
        F.length(F.regexp_replace(bare, NUMBER, "")).cast("long").alias("structural"),
    )


def xml_totals(text: Column | str) -> Column:
    """Struct of counts: tags, tags with attributes, and the length of the text outside tags."""
    t = as_column(text)
    return F.struct(
        F.size(_found(t, "<[^>]*>")).cast("long").alias("n_tags"), F.size(_found(t, "<[^\\s>/]+\\s[^>]*>")).cast("long").alias("n_attrs"),
        F.length(F.regexp_replace(t, "<[^>]*>", "")).cast("long").alias("text_chars"),
    )


def csv_columns(lines: DataFrame, line: str, delimiter: str) -> DataFrame:
    """``(column, cells, bytes)`` of lines without quotes."""
    cells = lines.select(F.posexplode(F.split(F.col(line), delimiter)).alias("column", "cell"))
    return cells.groupBy("column").agg(F.count("*").alias("cells"), F.sum(F.octet_length("cell")).cast("long").alias("bytes"))


SPLITS = {"json": (shred.json_split, shred.json_join, shred.unpack_json), "csv": (shred.csv_split, shred.csv_join, shred.unpack_csv), "xml": (shred.xml_split, shred.xml_join, shred.unpack_xml)}


def split_streams(data: Column | str, structure: str) -> Column:
    """The streams of a block as an array of binary."""
    split = SPLITS[structure][0]

    @F.pandas_udf("array<binary>")
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: None if x is None else split(bytes(x)).streams())

    return run(as_column(data))


def join_streams(streams: Column | str, structure: str) -> Column:
    """The block of an array of streams; missing or spare pieces are errors."""
    _, join, read = SPLITS[structure]

    @F.pandas_udf("binary")
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: None if x is None else join(read([bytes(s) for s in x])))

    return run(as_column(streams))


def stream_totals(df: DataFrame, data: str, structure: str) -> DataFrame:
    """``(stream, blocks, bytes)`` over all blocks, by place of the stream."""
    parts = df.select(F.posexplode(split_streams(data, structure)).alias("stream", "data"))
    return parts.groupBy("stream").agg(F.count("*").alias("blocks"), F.sum(F.octet_length("data")).cast("long").alias("bytes"))
