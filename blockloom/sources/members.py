"""Members ``(member_id, name, content, raw_len)`` from files, folders and tables, and back to files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import as_column, safe_member_name

SUFFIX = ".blk"
LONGEST_NAME = 4096


class UnsafeName(ValueError):
    """A member name that does not stay below the folder it is restored to."""


def check_name(name: str) -> str:
    """The name, if it is a relative path of plain parts."""
    parts = name.split("/")
    if not name or len(name.encode()) > LONGEST_NAME or name.startswith("/") or "\0" in name or "\\" in name or {"", ".", ".."} & set(parts):
        raise UnsafeName(f"unsafe member name: {name!r}")
    return name


def _numbered(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Ids by name order; names are dealt by range, so that no task sorts them all, and without contents."""
    rows = df.select("name").sort("name").rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
    return spark.createDataFrame(rows, "member_id long, name string").join(df, "name").select("member_id", "name", "content", "raw_len")


def same_path(a: str, b: str) -> bool:
    return a == b or os.path.realpath(a) == os.path.realpath(b)


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """One regular file, not a link, under its own name."""
    p = Path(path)
    if p.is_symlink() or not p.is_file():
        raise ValueError(f"not a regular file: {path}")
    name = check_name(p.name)
    df = spark.read.format("binaryFile").load(str(p.absolute()))
    return df.select(F.lit(0).cast("long").alias("member_id"), F.lit(name).alias("name"), "content", F.col("length").alias("raw_len"))


def scan_tree(spark: SparkSession, root: str, output: str | None = None) -> DataFrame:
    """Every regular file below a folder, by name, without links and without the output itself.

    Names start with the folder's own.
    """
    top = Path(root)
    if not top.is_dir():
        raise ValueError(f"not a folder: {root}")
    label = check_name(top.resolve().name)
    kept = []
    for folder, inner, files in os.walk(top):
        inner[:] = sorted(d for d in inner if not os.path.islink(os.path.join(folder, d)) and not (output and same_path(os.path.join(folder, d), output)))
        kept += [os.path.join(folder, f) for f in files if os.path.isfile(os.path.join(folder, f)) and not os.path.islink(os.path.join(folder, f)) and not (output and same_path(os.path.join(folder, f), output))]
    if not kept:
        return spark.createDataFrame([], "member_id long, name string, content binary, raw_len long")
    names = spark.createDataFrame([(str(Path(k).relative_to(top)),) for k in kept], "rel string")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(top.absolute()))
    body = df.select(F.substring("path", len(f"file:{top.absolute()}/") + 1, 1 << 30).alias("rel"), "content")
    found = names.join(body, "rel", "left").withColumn("content", F.coalesce("content", F.lit(b"")))  # the reader leaves out empty files
    return _numbered(found.select(F.concat(F.lit(label + "/"), "rel").alias("name"), "content", F.octet_length("content").cast("long").alias("raw_len")), spark)


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Non-empty files right in a folder that can be read, without archives of this package: what a bench measures."""
    top = str(Path(root).absolute())
    df = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(top + "/*").withColumn("name", F.substring("path", len(f"file:{top}/") + 1, 1 << 30))
    right = (F.col("length") > 0) & ~F.contains("name", F.lit("/")) & ~F.col("name").endswith(SUFFIX)
    return _numbered(df.where(right).select("name", "content", F.col("length").alias("raw_len")), spark)


def from_table(df: DataFrame, key: str, data: Column | str, name: Column | None = None) -> DataFrame:
    """Members from rows: text as UTF-8, binary as it is; null as empty.  At least one row is needed
    to archive them."""
    body = as_column(data)
    return df.select(
        F.col(key).cast("long").alias("member_id"), (name if name is not None else F.concat(F.lit(f"{key}/"), F.col(key).cast("string"))).alias("name"),
        F.coalesce(body.cast("binary"), F.lit(b"")).alias("content"),
    ).withColumn("raw_len", F.octet_length("content").cast("long"))


def unsafe_members(members: DataFrame) -> DataFrame:
    return members.where(~safe_member_name(F.col("name"))).select("member_id", "name")


def restore(members: DataFrame, root: str, force: bool = False) -> None:
    """Writes members ``(name, content)`` below a folder; fails before an existing file unless forced.

    The folder must be one that all executors share.
    """
    base = os.path.abspath(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                path = os.path.join(base, check_name(name))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb" if force else "xb") as f:
                    f.write(content or b"")
            yield batch.select(["name"])

    members.select("name", "content").mapInArrow(write, "name string").count()


def restored_name(archive: str, stored: str | None, output: str | None) -> str:
    """Where one member goes: the output given, else its stored name, else the archive's less its suffix."""
    if output:
        return output
    if stored:
        return check_name(stored)
    if archive.endswith(SUFFIX) and len(archive) > len(SUFFIX):
        return archive[: -len(SUFFIX)]
    raise ValueError("no name to restore to")
