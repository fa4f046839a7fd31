"""Archives that grow: a stream of members, coded batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import blocks as block_ops
from ..plans.archive import encode
from ..plans.levels import resolve_mode


def encode_stream(members: DataFrame, level: int | None = None, mode: str | None = None, window: int = 1 << 20, words: list[bytes] | None = None, **floors: int) -> DataFrame:
    """Coded blocks of a stream of ``(member_id, name, content)``.

    Blocks are independent, so no state is kept.  A stream has no counts to make a dictionary of:
    it is given, from a sample or an earlier archive, or there is none; decoding needs the same.
    """
    mode = resolve_mode(level, mode)
    return encode(block_ops.cut(members, mode == "wire", window), mode, words or [], **floors)


def append(members: DataFrame, path: str, checkpoint: str, level: int | None = None, mode: str | None = None, words: list[bytes] | None = None, **floors: int) -> DataStreamWriter:
    """A writer that appends coded blocks to a folder, each batch once."""
    return encode_stream(members, level, mode, words=words, **floors).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def kind_counts(members: DataFrame, time: str, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """``(window, kind, blocks, bytes)`` of a stream of members by event time, late ones up to a delay."""
    measured = block_ops.profile(members.withWatermark(time, delay), "content")
    return measured.groupBy(F.window(time, width), "kind").agg(F.count("*").alias("blocks"), F.sum("n").alias("bytes"))
