"""Command line: compress, decompress, verify and bench."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .kernels import container
from .plans import archive
from .plans.levels import MODES, resolve_mode
from .sources import members as M


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="blockloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, paths in (("compress", ("input", "output")), ("decompress", ("input", "output")), ("verify", ("input",)), ("bench", ("input",))):
        c = sub.add_parser(name)
        for x in paths:
            c.add_argument(x, **({"nargs": "?"} if (name, x) == ("decompress", "output") else {}))
        c.add_argument("--level", type=int)
        c.add_argument("--mode", choices=MODES)
        c.add_argument("--force", action="store_true")
        c.add_argument("--verbose", action="store_true")
    return p


def timed(data: bytes, mode: str) -> dict:
    """Ratio in per cent, MB/s both ways, and whether the bytes came back."""
    t0 = time.perf_counter()
    packed = container.compress(data, mode)
    t1 = time.perf_counter()
    intact = container.decompress(packed) == data
    t2 = time.perf_counter()
    size = len(data) / 1e6
    return {"ratio": 100 * len(packed) / len(data), "compress": size / (t1 - t0), "decompress": size / (t2 - t1), "intact": intact}


def bench(spark: SparkSession, folder: str, modes: list[str]) -> list[dict]:
    """A row for each file and mode; files are read and coded in tasks, and only their rows come here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, mode, data in zip(*(batch.column(c).to_pylist() for c in ("name", "engine", "content"))):
                yield pa.RecordBatch.from_pylist([{"file": name, "engine": mode, **timed(data, mode)}])

    files = M.scan_corpus(spark, folder).select("name", "content", F.explode(F.array(*map(F.lit, modes))).alias("engine"))
    files = files.repartition(spark.sparkContext.defaultParallelism, "name", "engine")
    rows = files.mapInArrow(run, "file string, engine string, ratio double, compress double, decompress double, intact boolean").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: (r["file"], r["engine"]))


def restore(spark: SparkSession, source: str, output: str | None, force: bool) -> None:
    """An archive of one member without a folder in its name goes to a file, others below a folder."""
    members = archive.read(spark, source)
    first = members.select("name").limit(2).collect()
    if len(first) > 1 or "/" in first[0]["name"] or output and os.path.isdir(output):
        M.restore(members, output or ".", force)
        return
    path = os.path.abspath(M.restored_name(source, first[0]["name"], output))
    M.restore(members.withColumn("name", F.lit(os.path.basename(path))), os.path.dirname(path), force)


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("blockloom").getOrCreate()
    if a.command == "compress":
        found = M.scan_tree(spark, a.input, a.output) if os.path.isdir(a.input) else M.scan_file(spark, a.input)
        archive.write(found, a.output, a.level, a.mode, a.force)
        if a.verbose:
            archive.diagnostics(archive.open_archive(spark, a.output)[0]).orderBy("kind", "method").show(truncate=False)
        total = archive.open_archive(spark, a.output)[0].agg(F.sum("raw_len"), F.sum("comp_len")).first()
        print(f"{total[0] or 0} -> {total[1] or 0} bytes")
    elif a.command == "decompress":
        restore(spark, a.input, a.output, a.force)
    elif a.command == "verify":
        broken = archive.verify(spark, a.input)
        broken.show(truncate=False)
        return 0 if broken.isEmpty() else 1
    else:
        for row in bench(spark, a.input, [resolve_mode(a.level, a.mode)]):
            print(json.dumps(row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
