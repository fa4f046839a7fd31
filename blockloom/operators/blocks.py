"""Members to blocks: cutting, measuring, classifying and detecting structure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blocks as B
from ..kernels import classify

#: Blocks of small members go on together, of about so many bytes.
CUT_BYTES = 4 << 20
MEASURE = "n long, entropy double, printable double, marks boolean"


def measure(data: Column | str) -> Column:
    """Struct of length, entropy, printable share and executable marks of binary cells; null as empty."""
    @F.pandas_udf(MEASURE)
    def run(cells: pd.Series) -> pd.DataFrame:
        rows = [classify.measure(bytes(x) if x is not None else b"") for x in cells]
        return pd.DataFrame(rows, columns=["n", "entropy", "printable", "marks"])

    return run(B.as_column(data))


def profile(df: DataFrame, data: str = "raw") -> DataFrame:
    """df with n, entropy, printable, marks and kind of a binary column."""
    out = df.withColumn("__m", measure(data))
    for name in ("n", "entropy", "printable", "marks"):
        out = out.withColumn(name, F.col(f"__m.{name}"))
    return out.drop("__m").withColumn("kind", B.kind_of(F.col("n"), F.col("entropy"), F.col("printable"), F.col("marks")))


def histogram(df: DataFrame, data: str = "raw", keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, byte, n)``: byte counts, summed inside each batch before they are shuffled."""
    shape = df.select(*keys).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple, np.ndarray] = {}
            names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            for key, x in zip(names, batch.column(data).to_pylist()):
                if x:
                    c = np.bincount(np.frombuffer(x, np.uint8), minlength=256)
                    total[key] = total[key] + c if key in total else c
            rows = [(*key, b, int(c[b])) for key, c in total.items() for b in np.flatnonzero(c).tolist()]
            cols = list(zip(*rows)) if rows else [()] * (len(keys) + 2)
            fields = [pa.array(c, t) for c, t in zip(cols, [*(batch.schema.field(k).type for k in keys), pa.int32(), pa.int64()])]
            yield pa.RecordBatch.from_arrays(fields, [*keys, "byte", "n"])

    out = T.StructType([*shape.fields, T.StructField("byte", T.IntegerType()), T.StructField("n", T.LongType())])
    return df.select(*keys, data).mapInArrow(count, out).groupBy(*keys, "byte").agg(F.sum("n").alias("n"))


def histogram_native(df: DataFrame, data: str = "raw", keys: tuple[str, ...] = ()) -> DataFrame:
    """The same by exploding the bytes."""
    pairs = df.select(*keys, F.explode(B.byte_list(data)).alias("byte"))
    return pairs.withColumn("byte", F.conv("byte", 16, 10).cast("int")).groupBy(*keys, "byte").agg(F.count("*").alias("n"))


def cut_fixed(members: DataFrame, size: Column | int, data: str = "content") -> DataFrame:
    """Blocks of a size that may depend on the member, by expressions alone; none for an empty member."""
    size = F.lit(size) if isinstance(size, int) else size
    n = F.coalesce(F.octet_length(data), F.lit(0)).cast("long")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, size.cast("long"))).otherwise(F.array().cast("array<long>"))
    keep = [c for c in members.columns if c != data]
    return (
        members.withColumn("__size", size.cast("long")).select(*keep, F.col(data).alias("__data"), "__size", F.posexplode(starts).alias("block_id", "start"))
        .withColumn("stop", F.least(F.col("start") + F.col("__size"), F.octet_length("__data").cast("long")))
        .withColumn("raw", F.substring(F.col("__data"), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")))
        .drop("__data", "__size")
    )


def cut(members: DataFrame, wire: bool = False, window: int | None = None) -> DataFrame:
    """``(member_id, block_id, start, stop, kind, raw)`` of ``(member_id, content)``.

    Each block's kind decides its size.  Without ``window`` a kind is that of the whole rest of
    the member.
    """
    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["member_id", "block_id", "start", "stop", "kind", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for member, content in zip(batch.column("member_id").to_pylist(), batch.column("content").to_pylist()):
                rows += [(member, k, a, b, kind, content[a:b]) for k, (a, b, kind) in enumerate(classify.cut(content or b"", wire, window))]
                held += len(content or b"")
                if held > CUT_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    return members.select("member_id", "content").mapInArrow(run, "member_id long, block_id int, start long, stop long, kind string, raw binary")


def structure_of(text: Column) -> Column:
    """json, csv, xml or null, the first that fits."""
    return F.when(B.looks_like_json(text), "json").when(B.looks_like_csv(text), "csv").when(B.looks_like_xml(text), "xml")


def kind_summary(profiled: DataFrame) -> DataFrame:
    return profiled.groupBy("kind").agg(F.count("*").alias("blocks"), F.sum("n").alias("bytes"), F.round(F.avg("entropy"), 3).alias("mean_entropy"))


def block_member(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """blocks ``(block_no)`` with the member that holds them, from ``(member_id, first_block, num_blocks)``."""
    held = members.where("num_blocks > 0").select(
        "member_id", F.explode(F.expr("sequence(first_block, first_block + num_blocks - 1)")).alias("block_no")
    )
    return blocks.join(held, "block_no")
