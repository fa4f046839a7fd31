"""Removal of passages that occurred before, by Rabin-Karp window hashes.

A window is ``width`` consecutive words of one document.  Every word is removed that lies in a
window whose word sequence also starts earlier: in a document of smaller doc_id, or earlier in
the same one.

Each window hashes in constant time from a running sum.  So that windows seen once never
reach a shuffle, each window names an anchor, the least hash among the ``width / 2``-word
grams inside it: equal windows have equal anchors, and neighbours mostly share theirs.  Spark
first counts anchors; only windows whose anchor repeats are then hashed and compared with
their first place, in one shuffle.  What a task can tell alone, that a window came before in
the rows it holds, goes along as runs of windows, so that of the places of a window that many
documents share each task sends one.  Overlapping removed windows merge into maximal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .idfilter import bit_of, hash_bitmap, holds, id_bitmap
from .scratch import Scratch
from .text import chunks, mix, signed, split_words, window_hashes

#: The bitmap of anchors has four bits for each that repeats, within these bounds: 8 to 64 MB.
ANCHOR_BITS = 26, 29
#: A task compares so many windows among themselves.
HELD = 1 << 19
CHECK = np.uint64(0xA0761D6478BD642F)


def _windows(column: pa.Array, width: int):
    """Row, start in the row, anchor position and word table of every window of a column."""
    words = split_words(column)
    gram = max(1, width // 2)
    n = len(words.hashes)
    if n < width:
        return None
    grams = window_hashes(words.hashes, gram)
    spread = width - gram + 1
    least, at = grams[: n - width + 1].copy(), np.arange(n - width + 1)
    for k in range(1, spread):
        there = grams[k : k + n - width + 1]
        less = there < least
        least[less] = there[less]
        at[less] = np.flatnonzero(less) + k
    row = np.searchsorted(words.first, np.arange(n - width + 1), side="right") - 1
    inside = np.flatnonzero(np.arange(n - width + 1) + width <= words.first[row + 1])
    return words, inside, row[inside], least[inside], at[inside]


def anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One row for each anchor place of each document."""
    for batch in batches:
        for part in chunks(batch, "text"):
            found = _windows(part.column("text"), width)
            if found is None or not len(found[1]):
                continue
            _, _, row, least, at = found
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(signed(least[new]))], ["anchor"])


def repeated_windows(batches: Iterator[pa.RecordBatch], width: int, bitmap: Broadcast, bits: int, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Hash, check, document and start of each window whose anchor may repeat, ``held`` and more at a time through :func:`_settle`.

    The check is 32 bits of a second sum over other values of the same words, so that windows
    compare by 96 bits.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    before = n = 0
    for batch in batches:
        for part in chunks(batch, "text"):
            found = _windows(part.column("text"), width)
            if found is None or not len(found[1]):
                continue
            words, start, row, least, _ = found
            may = holds(bitmap.value, signed(least), bits)
            start, row = start[may], row[may]
            ids = part.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            hashes = window_hashes(words.hashes, width)[start]
            check = window_hashes(mix(words.hashes ^ CHECK), width)[start].astype(np.uint32).view(np.int32)
            parts.append((hashes, check, ids[row].astype(np.int64), (start - words.first[row]).astype(np.int32), (row + before).astype(np.int32)))
            before, n = before + part.num_rows, n + len(start)
            if n >= held:
                yield _settle(parts)
                parts, n = [], 0
    if n:
        yield _settle(parts)


def _settle(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Places ``(window, check, doc_id, start)`` that are the first of their window among these, or as early; the others
    are known to be later and come as runs: ``-1 - start`` of the first, how many for a check, and for a window a hash of the
    place, which deals them evenly.
    """
    hashes, check, ids, place, row = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(hashes, kind="stable")  # equal windows stay in the order of rows and starts
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    group = np.flatnonzero(np.r_[True, ~same])
    doc = ids[order]
    known = np.empty(len(order), bool)
    known[order] = doc > np.repeat(np.minimum.reduceat(doc, group), np.diff(np.r_[group, len(order)]))
    known[order[1:]] |= same & (row[order[1:]] == row[order[:-1]])
    first, later = np.flatnonzero(~known), np.flatnonzero(known)
    new = np.ones(len(later), bool)
    new[1:] = (row[later[1:]] != row[later[:-1]]) | (place[later[1:]] != place[later[:-1]] + 1)
    run, size = later[new], np.diff(np.r_[np.flatnonzero(new), len(later)]).astype(np.int32)
    even = mix(mix(ids[run]) + place[run].astype(np.uint64))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(signed(np.r_[hashes[first], even])), pa.array(np.r_[check[first], size]),
            pa.array(np.r_[ids[first], ids[run]]), pa.array(np.r_[place[first], -1 - place[run]]),
        ],
        ["window", "check", "doc_id", "start"],
    )


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal runs of words, end exclusive, that the windows at sorted starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + width).tolist()))


def _starts(runs: list[int]) -> np.ndarray:
    """The sorted starts of all windows of runs."""
    return np.sort(np.concatenate([np.arange(x >> 32, (x >> 32) + (x & 0xFFFFFFFF)) for x in runs])) if runs else np.zeros(0, np.int64)


def _cut(batches: Iterator[pa.RecordBatch], width: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows ``(doc_id, text, runs)`` without the windows of the runs, each ``start << 32 | number``; without that column, whole."""
    for batch in batches:
        for part in chunks(batch, "text"):
            out: list[list] = [[] for _ in range(4)]
            texts = part.column("text").to_pylist()
            lists = part.column("runs").to_pylist() if "runs" in part.schema.names else [None] * len(texts)
            for text, runs in zip(texts, lists):
                words = (text or "").encode().split()
                n, spans = len(words), intervals(_starts(runs or []), width)
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                joined = b" ".join(kept)
                for column, value in zip(out, (n, n - len(kept), joined.decode() if keep_text else hashlib.sha256(joined).hexdigest(), spans)):
                    column.append(value)
            pairs = pa.array([[{"start": a, "end": b} for a, b in s] for s in out[3]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pairs],
                ["doc_id", "n_words", "n_removed", "kept", "removed"],
            )


def _split(batches: Iterator[pa.RecordBatch], bitmap: Broadcast, inside: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("bit")
        bit = batch.column(at).to_numpy(zero_copy_only=False)
        may = (bitmap.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
        yield batch.filter(pa.array(may == inside)).select(["doc_id", "text"])


def bitmap_bits(n: int) -> int:
    """The logarithm of the size of a bitmap for n anchors."""
    return min(max((4 * n).bit_length(), ANCHOR_BITS[0]), ANCHOR_BITS[1])


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = 50, keep_text: bool = True, anchor_bits: int | None = None) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, removed)`` of every row of docs.

    docs needs doc_id and text; other columns are ignored.  ``kept`` is the remaining words
    joined by one space, or its SHA-256 if ``keep_text`` is false; ``removed`` lists maximal
    word intervals, end exclusive.  A null text counts as empty.  Rows of null doc_id stay
    whole.  Rows that repeat a doc_id are equally early: none takes a window from the other.  An
    empty table gives an empty result.  ``anchor_bits`` sets the bitmap's size in place of
    :func:`bitmap_bits`; it changes what is shuffled and no result.
    """
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = docs.where("doc_id is not null")
    twice = scratch.save(
        named.select("text").mapInArrow(lambda it: anchors(it, width), "anchor long")
        .groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    )
    bits = anchor_bits or bitmap_bits(twice.count())
    marked = hash_bitmap(spark, twice, "anchor", bits)
    scratch.drop(twice)
    windows = named.mapInArrow(lambda it: repeated_windows(it, width, marked, bits), "window long, check int, doc_id long, start int")
    # Each task sends a window's first place only, so one sort can take all of a window's rows.
    first = F.min(F.expr("if(start < 0, null, doc_id)")).over(Window.partitionBy("window", "check"))
    later = windows.withColumn("first", first).where("start < 0 or doc_id > first")
    run = F.expr("if(start < 0, shiftleft(-1L - start, 32) + check, shiftleft(cast(start as long), 32) + 1L)")
    runs = scratch.save(later.select("doc_id", run.alias("run")).groupBy("doc_id").agg(F.collect_list("run").alias("runs")))

    touched = id_bitmap(spark, runs, "doc_id")
    ready = docs.withColumn("bit", bit_of("doc_id"))
    result = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>"
    whole = ready.mapInArrow(lambda it: _cut(_split(it, touched, False), width, keep_text), result)  # one worker a task for both steps
    cut = ready.mapInArrow(lambda it: _split(it, touched, True), "doc_id long, text string").join(runs, "doc_id", "left")
    return whole.unionByName(cut.mapInArrow(lambda it: _cut(it, width, keep_text), result))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents by :func:`remove_repeats`, whose docstring defines nulls, empties, ties and repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(spark, docs, width=20, keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
