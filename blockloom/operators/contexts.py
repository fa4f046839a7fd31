"""Counts of bytes by the bytes before them, and what models would choose from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import byte_class, pick_order, pick_order_deep


def context_counts(df: DataFrame, order: int, data: str = "raw") -> DataFrame:
    """``(context, byte, n)`` of order 0 to 3; the context is a number, its last byte the nearest.

    Counted in each batch before the shuffle; texts do not run into each other.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for x in batch.column(0).to_pylist():
                if x is not None and len(x) > order:
                    b = np.frombuffer(x, np.uint8).astype(np.int64)
                    code = b[order:].copy()
                    for k in range(1, order + 1):
                        code |= b[order - k : len(b) - k] << (8 * k)
                    codes.append(code)
            code, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(code >> 8), pa.array((code & 255).astype(np.int32)), pa.array(n.astype(np.int64))], ["context", "byte", "n"])

    return df.select(data).mapInArrow(count, "context long, byte int, n long").groupBy("context", "byte").agg(F.sum("n").alias("n"))


def context_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))


def conditional_entropy(counts: DataFrame) -> DataFrame:
    """One row: bits a byte given its context, and how many bytes and contexts there are."""
    total = counts.groupBy("context").agg(F.sum("n").alias("total"))
    bits = counts.join(total, "context").agg(
        F.sum(-F.col("n") * F.log2(F.col("n") / F.col("total"))).alias("bits"), F.sum("n").alias("n"), F.count_distinct("context").alias("contexts")
    )
    return bits.select("contexts", "n", F.round(F.coalesce(F.col("bits") / F.col("n"), F.lit(0.0)), 4).alias("bits"))


def chosen_orders(counts1: DataFrame, counts2: DataFrame, counts3: DataFrame | None = None) -> DataFrame:
    """``(order, contexts, n)``: which order the selector takes after each pair (or triple) of bytes."""
    t1 = context_totals(counts1).select(F.col("context").alias("c1"), F.col("total").alias("t1"), F.col("distinct").alias("d1"))
    t2 = context_totals(counts2).select(F.col("context").alias("c2"), F.col("total").alias("t2"), F.col("distinct").alias("d2"))
    deepest, weight = t2, "t2"
    if counts3 is not None:
        t3 = context_totals(counts3).select(F.col("context").alias("c3"), F.col("total").alias("t3"), F.col("distinct").alias("d3"))
        deepest, weight = t3.withColumn("c2", F.col("c3").bitwiseAND(0xFFFF)).join(t2, "c2"), "t3"
    both = deepest.withColumn("c1", F.col("c2").bitwiseAND(0xFF)).join(t1, "c1")
    cols = [F.col(c) for c in ("t1", "d1", "t2", "d2")]
    pick = pick_order(*cols) if counts3 is None else pick_order_deep(*cols, F.col("t3"), F.col("d3"))
    return both.groupBy(pick.alias("order")).agg(F.count("*").alias("contexts"), F.sum(weight).alias("n"))


def class_profile(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy(byte_class(F.col("byte")).alias("class")).agg(F.sum("n").alias("n"))


def frequent_pairs(counts1: DataFrame, least: int = 4) -> DataFrame:
    """``(first, second, n)`` of neighbouring bytes that occur ``least`` times at least."""
    return counts1.where(F.col("n") >= least).select(F.col("context").cast("int").alias("first"), F.col("byte").alias("second"), "n")


def deltas(counts1: DataFrame) -> DataFrame:
    """``(delta, n)``: differences of neighbouring bytes modulo 256."""
    return counts1.groupBy(F.pmod(F.col("byte") - F.col("context"), F.lit(256)).cast("int").alias("delta")).agg(F.sum("n").alias("n"))


def frequencies(histogram: DataFrame, scale: int = 4096) -> DataFrame:
    """``(byte, freq, start)`` that fill the scale: what occurs gets 1 at least, the most frequent the rest."""
    from pyspark.sql import Window

    everything = Window.partitionBy(F.lit(0))
    share = F.greatest(F.lit(1), F.floor(F.col("n") * scale / F.sum("n").over(everything))).cast("long")
    top = F.row_number().over(everything.orderBy(F.desc("n"), "byte")) == 1
    out = histogram.withColumn("freq", share).withColumn("freq", F.when(top, scale - F.sum("freq").over(everything) + F.col("freq")).otherwise(F.col("freq")))
    before = F.sum("freq").over(Window.partitionBy(F.lit(0)).orderBy("byte").rowsBetween(Window.unboundedPreceding, -1))
    return out.select("byte", "freq", F.coalesce(before, F.lit(0)).alias("start"))
