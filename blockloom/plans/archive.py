"""Archives: members to coded blocks in Parquet tables, and back.

An archive is a folder with the tables ``members``, ``blocks``, ``dictionary`` and ``manifest``.
Each block says how long its bytes were before and after its transform and which model wrote
it, so nothing is inferred from one for another; every block is independent of the others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import codecs, models
from ..operators import blocks as block_ops
from ..operators import words as word_ops
from .levels import method_label, resolve_mode

CODED = "member_id long, block_id int, start long, kind string, raw_len long, coded_len long, comp_len long, method int, crc32 long, payload binary"
VERSION = 2
CODE_BYTES = 32 << 20  # of the bytes that are coded or decoded together


def words_for(members: DataFrame, mode: str) -> list[bytes]:
    """The dictionary of all members, which wire and general do without."""
    if mode in ("wire", "general"):
        return []
    texts = members.select(F.col("member_id").alias("doc_id"), F.decode("content", "ISO-8859-1").alias("text"))
    counts = word_ops.word_counts(texts).where(F.octet_length("word") == F.length("word"))
    return word_ops.collect_words(word_ops.dictionary(counts))


def encode(blocks: DataFrame, mode: str, words: list[bytes], floor: int = codecs.STRUCTURED_FLOOR, plain_floor: int = codecs.PLAIN_FLOOR, stack: models.Stack | None = None) -> DataFrame:
    """Blocks ``(member_id, block_id, start, kind, raw)`` to coded blocks, with a stack of models of one's own if given.

    The structure of text blocks is found by expressions first; trials and coding are one pass.
    """
    text = F.when(F.col("kind") == "Text", F.decode("raw", "ISO-8859-1"))
    structure = F.lit(None).cast("string") if mode in ("wire", "general") else structure_for(text, min(floor, plain_floor))
    dealt = spread(blocks.select("member_id", "block_id", "start", "kind", "raw"))
    ready = dealt.select("member_id", "block_id", "start", "kind", structure.alias("structure"), F.crc32("raw").alias("crc32"), "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in together(batches, "raw"):
            data, kinds, shapes = (part.column(c).to_pylist() for c in ("raw", "kind", "structure"))
            coded = codecs.encode_blocks(list(zip(kinds, shapes, data)), mode, words, floor, plain_floor, stack)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("member_id", "block_id", "start", "kind")), pa.array([len(x) for x in data], pa.int64()),
                    pa.array([c.coded_len for c in coded], pa.int64()), pa.array([len(c.payload) for c in coded], pa.int64()),
                    pa.array([c.method for c in coded], pa.int32()), part.column("crc32"), pa.array([c.payload for c in coded], pa.binary()),
                ],
                ["member_id", "block_id", "start", "kind", "raw_len", "coded_len", "comp_len", "method", "crc32", "payload"],
            )

    return ready.mapInArrow(run, CODED)


def together(batches: Iterator[pa.RecordBatch], column: str, most: int = CODE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about ``most`` bytes, by a column of bytes or of their number; models code many blocks in little more time than few."""
    held, size = [], 0
    for batch in batches:
        data, at = batch.column(column), 0
        sizes = (data if pa.types.is_integer(data.type) else pc.binary_length(data)).to_pylist()
        for stop, n in enumerate(sizes, 1):
            size += n or 0
            if size >= most:
                held.append(batch.slice(at, stop - at))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, at = [], 0, stop
        if at < len(sizes):
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def structure_for(text: Column, least: int) -> Column:
    """The structure of texts of ``least`` bytes or more; shorter blocks have no trials that it could matter to."""
    return F.when(F.octet_length("raw") >= least, block_ops.structure_of(text))


def spread(blocks: DataFrame) -> DataFrame:
    """Blocks dealt to all cores: coding takes far longer than moving the bytes."""
    spark = blocks.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(parts, F.xxhash64("member_id", "block_id"))


def decode(coded: DataFrame, words: list[bytes], permissive: bool = False, stack: models.Stack | None = None) -> DataFrame:
    """``(member_id, block_id, start, raw, error)``: bytes of coded blocks, checked by length and CRC.

    A broken block fails the query, or has an error and no bytes if ``permissive``.
    """
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches, "raw_len"):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("method", "coded_len", "payload", "raw_len", "crc32"))))
            blocks = [codecs.Coded(m, n, p) for m, n, p, _, _ in rows]
            raw, error = _decoded(blocks, words, permissive, stack)
            for i, (_, _, _, size, crc) in enumerate(rows):
                if error[i] is None and (len(raw[i]) != size or zlib.crc32(raw[i]) != crc):
                    error[i] = f"CrcMismatch: {zlib.crc32(raw[i])} for {crc}"
                    raw[i] = None
            if not permissive and any(error):
                raise codecs.CorruptBlock(next(e for e in error if e))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("member_id", "block_id", "start")), pa.array(raw, pa.binary()), pa.array(error, pa.string())],
                ["member_id", "block_id", "start", "raw", "error"],
            )

    keep = coded.select("member_id", "block_id", "start", "method", "coded_len", "payload", "raw_len", "crc32")
    return keep.mapInArrow(run, "member_id long, block_id int, start long, raw binary, error string")


def _decoded(blocks: list[codecs.Coded], words: list[bytes], permissive: bool, stack: models.Stack | None) -> tuple[list, list]:
    try:
        return codecs.decode_blocks(blocks, words, stack), [None] * len(blocks)
    except Exception:
        if not permissive:
            raise
    raw, error = [], []
    for b in blocks:
        try:
            raw.append(codecs.decode_blocks([b], words, stack)[0])
            error.append(None)
        except Exception as e:  # noqa: BLE001  any way in which a payload can be broken
            raw.append(None)
            error.append(f"CorruptBlock: {e}")
    return raw, error


def join_blocks(decoded: DataFrame) -> DataFrame:
    """``(member_id, content)``: the blocks of each member in order."""
    return decoded.groupBy("member_id").agg(F.expr("listagg(raw) within group (order by block_id)").alias("content"))


def compress(members: DataFrame, level: int | None = None, mode: str | None = None, window: int | None = 1 << 20, stack: models.Stack | None = None, **floors: int) -> tuple[DataFrame, list[bytes]]:
    """Coded blocks of ``(member_id, name, content)``, and the dictionary they were written with."""
    mode = resolve_mode(level, mode)
    stack = models.check_stack(stack) if stack else None
    words = [] if stack else words_for(members, mode)
    return encode(block_ops.cut(members, mode == "wire" and not stack, window), mode, words, stack=stack, **floors), words


def decompress(coded: DataFrame, members: DataFrame, words: list[bytes], stack: models.Stack | None = None) -> DataFrame:
    """``(member_id, name, content)`` of every member, those without blocks too."""
    whole = join_blocks(decode(coded, words, stack=stack))
    return members.select("member_id", "name").join(whole, "member_id", "left").withColumn("content", F.coalesce("content", F.lit(b"")))


def write(members: DataFrame, path: str, level: int | None = None, mode: str | None = None, force: bool = False, **options: int) -> None:
    """Writes an archive folder; an existing one is an error unless forced.  So is an empty table."""
    spark = members.sparkSession
    if members.isEmpty():
        raise ValueError("nothing to archive")
    mode = resolve_mode(level, mode)
    coded, words = compress(members, mode=mode, **options)
    how = "overwrite" if force else "errorifexists"
    coded.write.mode(how).partitionBy("kind").parquet(f"{path}/blocks")
    blocks = spark.read.schema(CODED).parquet(f"{path}/blocks").groupBy("member_id").agg(F.count("*").alias("num_blocks"))
    table = members.select("member_id", "name", F.octet_length("content").cast("long").alias("raw_len")).join(blocks, "member_id", "left")
    table.withColumn("num_blocks", F.coalesce("num_blocks", F.lit(0))).write.mode(how).parquet(f"{path}/members")
    spark.createDataFrame([(i, w) for i, w in enumerate(words)], "word_id int, word binary").coalesce(1).write.mode(how).parquet(f"{path}/dictionary")
    spark.createDataFrame([(VERSION, mode, json.dumps(options))], "version int, mode string, options string").coalesce(1).write.mode(how).parquet(f"{path}/manifest")


def open_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[bytes]]:
    """Coded blocks, members and dictionary of an archive; an unknown version is an error."""
    (manifest,) = spark.read.parquet(f"{path}/manifest").collect()
    if manifest["version"] != VERSION:
        raise ValueError(f"unknown archive version {manifest['version']}")
    words = [bytes(r["word"]) for r in spark.read.parquet(f"{path}/dictionary").orderBy("word_id").limit(1024).collect()]
    return spark.read.schema(CODED).parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/members"), words


def read(spark: SparkSession, path: str) -> DataFrame:
    return decompress(*open_archive(spark, path))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """``(member_id, block_id, error)`` of blocks that cannot be restored, and of members whose
    blocks are missing or do not fill them; no rows mean that all is well."""
    coded, members, words = open_archive(spark, path)
    broken = decode(coded, words, permissive=True).where("error is not null").select("member_id", "block_id", "error")
    held = coded.groupBy("member_id").agg(F.count("*").alias("n"), F.sum("raw_len").alias("bytes"))
    short = (
        members.join(held, "member_id", "full").where(~F.col("num_blocks").eqNullSafe(F.coalesce("n", F.lit(0))) | (F.coalesce("bytes", F.lit(0)) != F.col("raw_len")))
        .select("member_id", F.lit(None).cast("int").alias("block_id"), F.lit("InvalidContainer: blocks do not fill the member").alias("error"))
    )
    return broken.unionByName(short)


def offsets(coded: DataFrame) -> DataFrame:
    """coded with where each payload would start if its member's payloads stood in a row."""
    from pyspark.sql import Window

    before = Window.partitionBy("member_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    return coded.withColumn("offset", F.coalesce(F.sum("comp_len").over(before), F.lit(0)))


def diagnostics(coded: DataFrame) -> DataFrame:
    """``(kind, method, label, blocks, size_in, size_out)``."""
    return coded.groupBy("kind", "method").agg(F.count("*").alias("blocks"), F.sum("raw_len").alias("size_in"), F.sum("comp_len").alias("size_out")).withColumn(
        "label", method_label(F.col("method"))
    )


def trials(
    blocks: DataFrame, words: list[bytes], floor: int = codecs.STRUCTURED_FLOOR, plain_floor: int = codecs.PLAIN_FLOOR, most_bits: float = codecs.TRIAL_BITS,
) -> DataFrame:
    """``(member_id, block_id, pipeline, size, place)``: the coded size of every candidate pipeline of
    text blocks, a row each; pruned pipelines have none.  Floors of 0 and 8 bits prune nothing."""
    text = F.decode("raw", "ISO-8859-1")
    dealt = spread(blocks.where("kind = 'Text'").select("member_id", "block_id", "raw"))
    ready = dealt.select("member_id", "block_id", structure_for(text, min(floor, plain_floor)).alias("structure"), "raw")

    def sized(tried: list[tuple[int, int, str, int]], made: list[bytes]) -> pa.RecordBatch:
        member, block, name, place = zip(*tried) if tried else [()] * 4
        cols = (member, block, name, codecs.side_sizes(made), place)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32()))], ["member_id", "block_id", "pipeline", "size", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tried, made, held = [], [], 0
            for member, block, shape, raw in zip(*(batch.column(c).to_pylist() for c in ("member_id", "block_id", "structure", "raw"))):
                entropy = codecs.shannon(raw) if len(raw) >= min(floor, plain_floor) else 0.0
                for place, name in enumerate(codecs.candidates(raw, shape, words, entropy, floor, plain_floor, most_bits)):
                    tried.append((member, block, name, place))
                    made.append(codecs.PIPELINES[name][0](raw, words))
                    held += len(made[-1])
                if held > 4 << 20:
                    yield sized(tried, made)
                    tried, made, held = [], [], 0
            yield sized(tried, made)

    return ready.mapInArrow(run, "member_id long, block_id int, pipeline string, size long, place int")


def winners(trial_rows: DataFrame) -> DataFrame:
    return trial_rows.groupBy("member_id", "block_id").agg(F.min_by("pipeline", F.struct("size", "place")).alias("pipeline"), F.min("size").alias("size"))
