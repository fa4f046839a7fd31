"""Byte transforms of blocks: as kernels on whole cells, and as relations over positions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import as_column, byte_list, let
from ..kernels import codecs, coding, matching, transforms

KERNELS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "rle0": (transforms.rle0, transforms.rle0_inverse),
    "mtf": (transforms.mtf, transforms.mtf_inverse),
    "bwt": (transforms.bwt, transforms.bwt_inverse),
    "lzp": (transforms.lzp, transforms.lzp_inverse),
    "e8e9": (transforms.e8e9, transforms.e8e9_inverse),
    "bwt_mtf": (transforms.bwt_mtf, transforms.bwt_mtf_inverse),
    "bwt_mtf_rle": (transforms.bwt_mtf_rle, transforms.bwt_mtf_rle_inverse),
    "lzp_bwt_mtf": (transforms.lzp_bwt_mtf, transforms.lzp_bwt_mtf_inverse),
    "order0": (coding.order0_encode, coding.order0_decode),
    "side": (coding.side_encode, coding.side_decode),
    "stream": (codecs.pick_stream, codecs.unpick_stream),
}


def _cellwise(f: Callable[[bytes], bytes]):
    @F.pandas_udf("binary")
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: None if x is None else f(bytes(x)))

    return run.asNondeterministic()


def transform(data: Column | str, name: str) -> Column:
    """A named transform of a binary column; null stays null.  Evaluated once a row."""
    return _cellwise(KERNELS[name][0])(as_column(data))


def inverse(data: Column | str, name: str) -> Column:
    return _cellwise(KERNELS[name][1])(as_column(data))


def wire_encode(data: Column | str) -> Column:
    return _cellwise(matching.wire_encode)(as_column(data))


def wire_decode(data: Column | str, size: Column | str) -> Column:
    @F.pandas_udf("binary")
    def run(cells: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else matching.wire_decode(bytes(x), int(n)) for x, n in zip(cells, sizes)])

    return run(as_column(data), as_column(size))


def parse_runs(data: Column | str, kind: Column | str) -> Column:
    """The cheapest parse as an array of (at, length, distance)."""
    @F.pandas_udf("array<struct<at:int,length:int,distance:int>>")
    def run(cells: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [{"at": r.at, "length": r.length, "distance": r.distance} for r in matching.parse(bytes(x), k)] for x, k in zip(cells, kinds)])

    return run(as_column(data), as_column(kind))


def positions(df: DataFrame, key: str, data: str) -> DataFrame:
    """``(key, pos, byte)`` with bytes as hex pairs."""
    return df.select(key, F.posexplode(byte_list(data)).alias("pos", "byte"))


def runs(df: DataFrame, key: str, data: str) -> DataFrame:
    """``(key, start, byte, length)``: maximal runs of equal bytes, from where bytes change."""
    at = Window.partitionBy(key).orderBy("pos")
    change = positions(df, key, data).withColumn("new", F.coalesce((F.lag("byte").over(at) != F.col("byte")), F.lit(True)))
    starts = change.where("new").withColumn("next", F.lead("pos").over(at))
    size = df.select(key, F.octet_length(data).alias("__n"))
    return starts.join(size, key).select(key, F.col("pos").alias("start"), "byte", (F.coalesce("next", "__n") - F.col("pos")).alias("length"))


def mtf_ranks(df: DataFrame, key: str, data: str) -> DataFrame:
    """``(key, pos, rank)`` of bytes seen before: how many others came since; null at first sight."""
    pos = positions(df, key, data)
    last = pos.withColumn("before", F.lag("pos").over(Window.partitionBy(key, "byte").orderBy("pos")))
    other = pos.select(F.col(key).alias("__k"), F.col("pos").alias("__p"), F.col("byte").alias("__b"))
    between = last.join(other, (F.col(key) == F.col("__k")) & (F.col("__p") > F.col("before")) & (F.col("__p") < F.col("pos")), "left")
    return between.groupBy(key, "pos", "before").agg(F.count_distinct("__b").alias("n")).select(
        key, "pos", F.when(F.col("before").isNotNull(), F.col("n")).alias("rank")
    )


def bwt_rows(df: DataFrame, key: str, data: str) -> DataFrame:
    """``(key, last)``: last column of the sorted rotations of short blocks, as hex."""
    n = F.octet_length(data)
    h = F.hex(as_column(data))
    rot = df.where(n > 0).select(key, F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), h.alias("h"))
    rot = rot.select(key, "i", F.concat(F.substr("h", F.col("i") * 2 + 1), F.substring(F.col("h"), F.lit(1), F.col("i") * 2)).alias("r"))
    ordered = F.array_sort(F.collect_list(F.struct("r", (-F.col("i")).alias("i"))))
    return rot.groupBy(key).agg(F.concat_ws("", F.transform(ordered, lambda x: F.right(x["r"], F.lit(2)))).alias("last"))


def previous_grams(df: DataFrame, key: str, data: str, width: int = 4) -> DataFrame:
    """``(key, pos, distance)``: how far back each run of ``width`` bytes was last seen."""
    n = F.octet_length(data)
    each = lambda b: F.transform(F.sequence(F.lit(0), n - width), lambda i: F.concat(*(F.get(b, i + k) for k in range(width))))
    grams = F.when(n >= width, let(byte_list(data), each)).otherwise(F.array().cast("array<string>"))
    at = df.select(key, F.posexplode(grams).alias("pos", "gram"))
    return at.select(key, "pos", (F.col("pos") - F.lag("pos").over(Window.partitionBy(key, "gram").orderBy("pos"))).alias("distance"))
