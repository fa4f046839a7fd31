"""Exact Jaccard join of documents on word shingles by T-occurrence search.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of distinct
``width``-word shingles.  The search keeps the inverted lists short before any document meets
another:

1. Equal sets collapse to the smallest doc_id that has them.
2. Of each set's shingles in hash order the first ``p`` are indexed.  Linked sets share at
   least ``l`` of their indexed shingles, so DivideSkip may leave the ``l - 1`` longest lists
   of each document unmerged; the lists of a common passage are such.  Most documents then
   have no list left that names another document.  Documents that still meet in large numbers
   get all their shingles indexed, so that all but the shortest lists can be left unmerged.
3. What remains forms candidate clusters.  Inside a cluster, in blocks of bounded size, the
   short lists are heap-merged, the long ones probed by binary search and documents that reach
   the required overlap are kept (:func:`divide_skip`).  A cluster above ``block`` documents
   is dealt into blocks twice; documents that are not of its largest class by then search the
   lists of all of it, in larger blocks.
4. Links join by contraction to components.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .idfilter import BITS, bit_of, id_bitmap, passing
from .scratch import Scratch
from .text import chunks, list_array, mix, signed, split_words, trim, window_hashes

CROWD = 8
SCAN = "doc_id long, n_shingles long, h1 long, h2 long, tokens array<long>"


def needed(n: int, percent: int) -> int:
    """Least overlap that a set of n shingles has with any set it links with."""
    return -(-percent * n // 100)


def slack(n: int) -> int:
    """How many shared indexed shingles a set of n shingles is indexed for, less one."""
    return n // 10


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z count as a-z."""
    words = split_words(column, lower=True)
    windows = window_hashes(words.hashes, width)
    sets = []
    for row in range(len(column)):
        at = words.span(row)
        n = at.stop - at.start
        if n >= width:
            sets.append(np.unique(windows[at.start : at.stop - width + 1]))
        else:
            sets.append(window_hashes(words.hashes[at], n) if n else np.zeros(0, np.uint64))
    return sets


def _scan(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            sets = shingle_sets(part.column("text"), width)
            sizes = [len(s) for s in sets]
            with np.errstate(over="ignore"):
                h1 = np.array([np.sum(mix(s), dtype=np.uint64) for s in sets], np.uint64)
                h2 = np.array([np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else 0 for s in sets], np.uint64)
            tokens = [signed(s[: n - needed(n, percent) + 1 + slack(n)]) for s, n in zip(sets, sizes)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(signed(h1)), pa.array(signed(h2)), list_array(tokens, pa.int64())],
                ["doc_id", "n_shingles", "h1", "h2", "tokens"],
            )
    trim()


def _sets(batches: Iterator[pa.RecordBatch], width: int, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(passing(batch, bitmap), "text"):
            sets = [signed(s).tobytes() for s in shingle_sets(part.column("text"), width)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])
    trim()


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Ids that occur in at least ``least`` of the sorted lists, with their counts.

    The longest lists are set aside, as many as the cost rule of the method allows; the rest
    are heap-merged, skipping ids that cannot reach the rest of the threshold, and each
    survivor is counted in the long lists by binary search.
    """
    if least < 1 or len(lists) < least:
        return {}
    lists = sorted(lists, key=len, reverse=True)
    aside = min(least - 1, int(least / (0.01 * math.log2(len(lists[0]) + 1) + 1)))
    long, short, least_short = lists[:aside], lists[aside:], least - aside
    heap = [(ids[0], k) for k, ids in enumerate(short)]
    heapq.heapify(heap)
    at = [0] * len(short)
    found = {}
    while len(heap) >= least_short:
        now, popped = heap[0][0], []
        while heap and heap[0][0] == now:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least_short:
            count = len(popped)
            for ids in long:
                i = bisect_left(ids, now)
                count += i < len(ids) and ids[i] == now
            if count >= least:
                found[now] = count
            target = now + 1
        else:
            while heap and len(popped) < least_short - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            target = max(now + 1, heap[0][0])
        for k in popped:
            i = at[k] = bisect_left(short[k], target, at[k])
            if i < len(short[k]):
                heapq.heappush(heap, (short[k][i], k))
    return found


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Linked positions ``(i, j)`` of two lists of sets, or ``j < i`` of one if right is None."""
    index: dict[int, list[int]] = {}
    queries = left if right is None else right
    if right is not None:
        for i, tokens in enumerate(left):
            for t in tokens.tolist():
                index.setdefault(t, []).append(i)
    for j, tokens in enumerate(queries):
        n, items = len(tokens), tokens.tolist()
        lists = [ids for ids in map(index.get, items) if ids]
        for i, overlap in divide_skip(lists, needed(n, percent)).items():
            if 100 * overlap >= percent * (n + len(left[i]) - overlap):
                yield (i, j)
        if right is None:
            for t in items:
                index.setdefault(t, []).append(j)


def _block(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    rows = rows.sort_values(["side", "node"], kind="stable")
    sets = [np.frombuffer(s, np.int64) for s in rows["shingles"]]
    nodes, cut = rows["node"].tolist(), int((rows["side"] == 0).sum())
    two = cut < len(nodes)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in block_links(sets[:cut], sets[cut:] if two else None, percent):
        j += cut if two else 0
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            if nodes[i] != nodes[j]:
                out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def _search(spark: SparkSession, docs: DataFrame, plan: DataFrame, width: int, percent: int, filter_bits: int) -> DataFrame:
    """Links inside the blocks of a plan ``(node, component, a, b, side)``."""
    bitmap = id_bitmap(spark, plan, "node", filter_bits)
    sets = docs.where("doc_id is not null").withColumn("bit", bit_of("doc_id", filter_bits)).mapInArrow(
        lambda it: _sets(it, width, bitmap.value), "node long, shingles binary"
    )
    return sets.join(plan, "node").groupBy("component", "a", "b").applyInPandas(lambda p: _block(p, percent), "u long, v long").distinct()


def _mingled(sized: DataFrame, block: int) -> DataFrame:
    """Small clusters as they are; large ones dealt into blocks by chance, twice."""
    plan = sized.where(f"size <= {block}").select("node", "component", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"))
    for deal in (1, 2):
        chunk = F.pmod(F.xxhash64(F.lit(deal), "node"), F.ceil(F.col("size") / block)).cast("int")
        plan = plan.unionByName(sized.where(f"size > {block}").select("node", "component", F.lit(deal).alias("a"), chunk.alias("b"), F.lit(0).alias("side")))
    return plan


def _strangers(scratch: Scratch, labelled: DataFrame, block: int) -> DataFrame:
    """Blocks in which every document outside its cluster's largest class searches the whole cluster.

    Two documents of that class need not meet: they are in one component already.  Each block
    has the inverted lists of up to CROWD times ``block`` documents and as many that search
    them, so a document is sent once for that many others, not for each.
    """
    block *= CROWD
    own = scratch.save(labelled.withColumn("label", F.coalesce("label", "node")))
    count = own.groupBy("component", "label").agg(F.count("*").alias("n"))
    main = count.groupBy("component").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all"))
    known = own.join(main.select("component", F.col("main.label").alias("main"), (F.col("all") - F.col("main.n")).alias("others")), "component").where("others > 0")
    ways, parts = F.ceil(F.col("others") / block).cast("int"), F.ceil(F.col("size") / block).cast("int")
    crowd = known.select(
        "node", "component", F.explode(F.sequence(F.lit(0), ways - 1)).alias("a"),
        F.pmod(F.xxhash64(F.lit(3), "node"), parts).cast("int").alias("b"), F.lit(0).alias("side"),
    )
    asking = known.where("label <> main").select(
        "node", "component", F.pmod(F.xxhash64(F.lit(4), "node"), ways).cast("int").alias("a"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("b"), F.lit(1).alias("side"),
    )
    return crowd.unionByName(asking)


def _full_sets(spark: SparkSession, docs: DataFrame, nodes: DataFrame, width: int, filter_bits: int) -> DataFrame:
    """``(node, tokens)``: whole shingle sets of the documents that may be among nodes."""
    bitmap = id_bitmap(spark, nodes, "node", filter_bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(passing(batch, bitmap.value), "text"):
                sets = [signed(s) for s in shingle_sets(part.column("text"), width)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), list_array(sets, pa.int64())], ["node", "tokens"])

    return docs.where("doc_id is not null").withColumn("bit", bit_of("doc_id", filter_bits)).mapInArrow(read, "node long, tokens array<long>")


def _clusters(postings: DataFrame, aside: Column, scratch: Scratch) -> DataFrame:
    """``(node, component, size)`` of the documents that ``(node, n, token)`` joins by short lists.

    Lists of one document count as the shortest.  Of each document's lists the ``aside``
    longest are left out.
    """
    # Written, as lead below, so that the rows of a list that names many documents can be split in the join.
    shared = scratch.save(postings.groupBy("token").agg(F.count("*").alias("length")).where("length > 1"))
    kept = F.size("lists") - aside.cast("int")
    short = (
        postings.join(shared, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("length", "token"))).alias("lists"))
        .where(kept > 0).select("node", F.explode(F.slice("lists", F.lit(1), kept)["token"]).alias("token"))
    )
    short = scratch.save(short)
    scratch.drop(shared)
    lead = scratch.save(short.groupBy("token").agg(F.min("node").alias("lead")))
    cluster = scratch.save(components(short.join(lead, "token").select(F.col("node").alias("u"), F.col("lead").alias("v")), scratch))
    scratch.drop(short, lead)
    size = scratch.save(cluster.groupBy("component").agg(F.count("*").alias("size")))
    return scratch.save(cluster.join(size, "component"))


def jaccard_components(
    spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, block: int = 64, filter_bits: int = BITS
) -> tuple[DataFrame, DataFrame]:
    """Membership ``(doc_id, n_shingles, representative, component_id)`` and links ``(u, v)``.

    docs needs doc_id and text; other columns are ignored.  A null or wordless text has the
    empty set and links with nothing.  Rows that repeat a doc_id count as one document that
    has all of their sets; rows with a null doc_id come back with a null component.  Links
    are between representatives of equal sets and span every component; links that would close
    a circle inside a block are left out.  An empty table gives an empty result.
    """
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = scratch.save(docs.mapInArrow(lambda it: _scan(it, width, percent), SCAN))
    sets = scan.where("n_shingles > 0 and doc_id is not null")
    reps = scratch.save(sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("representative")))
    member = scan.drop("tokens").join(reps, ["h1", "h2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("representative")).alias("representative")
    )

    one = (
        sets.join(reps.withColumnRenamed("representative", "doc_id"), ["doc_id", "h1", "h2"])
        .groupBy("doc_id", "h1", "h2").agg(F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
    )
    postings = one.select(F.col("doc_id").alias("node"), "n", F.explode("tokens").alias("token"))
    least = F.ceil(F.col("n") * percent / F.lit(100))
    sized = _clusters(postings, F.floor(least / 10), scratch)
    crowded = sized.where(f"size > {block}").select("node")
    every = _full_sets(spark, docs, crowded, width, filter_bits).join(crowded, "node").distinct()
    every = every.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    sized = scratch.save(sized.where(f"size <= {block}").unionByName(_clusters(every, least - 1, scratch)))
    links = scratch.save(_search(spark, docs, _mingled(sized, block), width, percent, filter_bits))
    label = components(links, scratch).select("node", F.col("component").alias("label"))
    late = scratch.save(_strangers(scratch, sized.where(f"size > {block}").join(label, "node", "left"), block))
    if not late.isEmpty():
        links = scratch.save(links.unionByName(_search(spark, docs, late, width, percent, filter_bits)).distinct())
    joined = components(links, scratch).select(F.col("node").alias("representative"), F.col("component").alias("component_id"))
    member = member.join(joined, "representative", "left").select(
        "doc_id", "n_shingles", "representative", F.coalesce("component_id", "representative", "doc_id").alias("component_id")
    )
    return member, links


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by :func:`jaccard_components`, whose docstring defines nulls, empties, ties and repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    member, _ = jaccard_components(spark, docs, width=4, percent=85)
    return member.select("doc_id", "n_shingles", "component_id")
