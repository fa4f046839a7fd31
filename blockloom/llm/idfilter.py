"""A bitmap of fixed size that tells which ids may be in a set.

It never grows with the data: beyond what it can hold apart, more rows pass it, and the join
that follows every use of it stays exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import free_name

BITS = 23


def bit_of(column: Column | str, bits: int = BITS) -> Column:
    """The bit that stands for an id."""
    return F.pmod(F.xxhash64(column), F.lit(1 << bits)).cast("int")


def id_bitmap(spark: SparkSession, ids: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """2**bits bits as 64-bit words, or-ed together in Spark; at most 2**(bits-6) rows come back."""
    words = (
        ids.select(bit_of(column, bits).alias("bit"))
        .groupBy(F.expr("bit div 64").cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    rows = words.toArrow()
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return spark.sparkContext.broadcast(out.astype("<i8").view(np.uint8))


def passing(batch: pa.RecordBatch, bitmap: np.ndarray, column: str = "bit") -> pa.RecordBatch:
    """The rows whose id may be in the set."""
    bit = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
    return batch.filter(pa.array((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))


def hash_bitmap(spark: SparkSession, hashes: DataFrame, column: str, bits: int) -> Broadcast:
    """Like :func:`id_bitmap` for values that are hashes already: their low bits serve."""
    words = (
        hashes.select(F.expr(f"`{column}` & {(1 << bits) - 1}L").alias("bit"))
        .groupBy(F.expr("bit div 64").cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    rows = words.toArrow()
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return spark.sparkContext.broadcast(out.astype("<i8").view(np.uint8))


def holds(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which signed 64-bit hashes may be in a set made by :func:`hash_bitmap`."""
    bit = hashes & ((1 << bits) - 1)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def drop_ids(spark: SparkSession, docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of docs whose id is not among ids; rows of null id stay, and all columns, whatever their names.

    Rows whose id the bitmap rules out go straight through; only the rest, about as many as
    there are ids, meet the ids in an exact anti-join.
    """
    bitmap = id_bitmap(spark, ids, column)
    name = free_name("bit", docs.columns)
    ready = docs.withColumn(name, F.coalesce(bit_of(column), F.lit(-1)))
    inside = _bit_set(bitmap)(name)
    may = ready.where(inside).drop(name).join(ids.select(column).distinct(), column, "left_anti").select(*docs.columns)
    return ready.where(~inside).select(*docs.columns).unionByName(may)


def _bit_set(bitmap: Broadcast):
    @F.pandas_udf("boolean")
    def inside(bit: pd.Series) -> pd.Series:
        at = bit.to_numpy()
        safe = np.maximum(at, 0)
        return pd.Series(((bitmap.value[safe >> 3] >> (safe & 7).astype(np.uint8)) & 1 > 0) & (at >= 0))

    return inside
