"""Times headline queries, and ratio (per cent) and MB/s of each level on 200 documents; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from blockloom.plans.archive import compress, decode
from blockloom.plans.levels import LEVELS, resolve_mode
from blockloom.plans.queries import QUERIES
from blockloom.sources.members import from_table

HEADLINE = (
    "kind_summary", "byte_histogram", "block_cut_fixed", "structure_summary", "dictionary_ids", "word_bigrams", "json_stream_totals", "csv_column_totals",
    "xml_stream_totals", "order_k_entropy", "order_selector_deep", "shred_xml", "transform_bwt_mtf_rle", "roundtrip_wire", "win_loss_tally",
)


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.files.maxPartitionBytes", "4m").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    levels = {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(200)
    members = from_table(docs, "doc_id", "text").persist()
    size = members.agg(F.sum("raw_len")).first()[0] / 1e6
    for level in LEVELS:
        began = time.perf_counter()
        coded, words = compress(members, level, window=4096 if level > 3 else 1 << 20)
        held = coded.persist().agg(F.sum("comp_len")).first()[0] / 1e6
        between = time.perf_counter()
        intact = decode(coded, words).count() > 0  # a block that does not come back raises
        ended = time.perf_counter()
        levels[str(level)] = {
            "mode": resolve_mode(level), "mb": round(size, 3), "ratio": round(100 * held / size, 2), "compress": round(size / (between - began), 3),
            "decompress": round(size / (ended - between), 3), "intact": intact,
        }
        coded.unpersist()
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "levels": levels, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
