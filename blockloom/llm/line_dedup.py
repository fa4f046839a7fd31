"""Removal of lines that came before, up to an edit of one word, by a deletion-neighbourhood join.

Lines compare by their words, A-Z as a-z.  A line goes if an equal line came earlier, or, for
lines of ``least_words`` words and more, if an earlier line turns into it by replacing, adding
or leaving out one word.  Earlier means smaller doc_id, then smaller line number.

Every line would have a variant for each word, most of them met by no other line.  A single
edit leaves three of a line's four quarters as they are, so Spark first counts the lines
without one quarter; only a quarter whose rest is shared by different lines is searched.
There each variant without one word becomes a hashed key: with its position for replaced
words, and without for words left out, where it meets the whole lines one word shorter.  Equal
keys give the earliest line of each, and the edit distance is verified on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .idfilter import bit_of, hash_bitmap, holds, id_bitmap, passing
from .scratch import Scratch, free_name
from .text import Words, chunks, mix, powers, signed, split_words, trim

KEY_BITS = 26
QUARTERS = 4


def _lines(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a column, and for each line with a word its row, number, first and last word."""
    words = split_words(column, lower=True)
    breaks = np.flatnonzero(words.data == 0x0A)
    line = np.searchsorted(breaks, words.starts)
    row = np.searchsorted(words.first, np.arange(len(line)), side="right") - 1
    new = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])])) if len(line) else np.zeros(0, np.int64)
    number = line[new] - np.searchsorted(breaks, words.rows)[row[new]]
    return words, row[new], number, new, np.append(new[1:], len(line)) if len(new) else new


class _Sums:
    """Hashes of joined ranges of words: words[a:b] followed by words[c:d]."""

    def __init__(self, hashes: np.ndarray):
        self.power, self.inverse = powers(len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * self.power[: len(hashes)], out=self.total[1:])

    def joined(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            left = (self.total[b] - self.total[a]) * self.inverse[a]
            right = (self.total[d] - self.total[c]) * self.inverse[c] * self.power[b - a]
            return mix(left + right + mix(np.asarray(b - a + d - c + np.asarray(salt) * (1 << 32), np.uint64)))


def _quarter_keys(sums: _Sums, start: np.ndarray, end: np.ndarray):
    """For each quarter, and for a line's own length and one less: key, quarter start, quarter end.

    The left end is counted from the line's start and the right end from its end, so that a
    line with one word more in the quarter has the same key.
    """
    n = end - start
    for m in (n, n - 1):
        for j in range(QUARTERS):
            a, b = j * m // QUARTERS, (j + 1) * m // QUARTERS
            yield sums.joined(start, start + a, end - (m - b), end, 8 + j), start + a, end - (m - b)


def _earliest(whole: np.ndarray, ids: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which lines are the earliest of their text in this chunk; the others have the same variants."""
    order = np.lexsort((number, ids, whole))
    first = np.zeros(len(whole), bool)
    first[order[np.concatenate([[True], whole[order[1:]] != whole[order[:-1]]])] if len(order) else order] = True
    return first


def line_table(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            words, row, number, start, end = _lines(part.column("text"))
            sums = _Sums(words.hashes)
            whole = sums.joined(start, end, end, end, 0)
            keys = np.stack([k for k, _, _ in _quarter_keys(sums, start, end)], axis=1) if len(start) else np.zeros((0, 2 * QUARTERS), np.uint64)
            ids = part.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            long = ((end - start) >= least_words) & _earliest(whole, ids[row], number)
            offsets = np.zeros(len(start) + 1, np.int32)
            np.cumsum(long * 2 * QUARTERS, out=offsets[1:])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[row].astype(np.int64)), pa.array(number.astype(np.int32)), pa.array(signed(whole)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(keys[long].reshape(-1)))),
                ],
                ["doc_id", "line", "whole", "keys"],
            )
    trim()


def variants(batches: Iterator[pa.RecordBatch], least_words: int, shared: Broadcast, bits: int) -> Iterator[pa.RecordBatch]:
    """``(key, exact, whole, doc_id, line)``: variants of lines in their searched quarters.

    ``exact`` marks a whole line among the variants that leave one word out.
    """
    for batch in batches:
        for part in chunks(batch, "text"):
            words, row, number, start, end = _lines(part.column("text"))
            sums = _Sums(words.hashes)
            whole = sums.joined(start, end, end, end, 0)
            ids = part.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            long = ((end - start) >= least_words) & _earliest(whole, ids[row], number)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            searched = np.zeros(len(start), bool)
            for k, (key, a, b) in enumerate(_quarter_keys(sums, start, end)):
                may = np.flatnonzero(long & holds(shared.value, signed(key), bits))
                searched[may] = True
                size = (b - a)[may]
                at = np.repeat(may, size)
                word = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a[may], size)
                if k < QUARTERS:
                    out.append((sums.joined(start[at], word, word + 1, end[at], 16 + word - start[at]), at, np.zeros(len(at), bool)))
                else:
                    out.append((sums.joined(start[at], word, word + 1, end[at], 1), at, np.zeros(len(at), bool)))
            at = np.flatnonzero(searched)
            out.append((sums.joined(start[at], end[at], end[at], end[at], 1), at, np.ones(len(at), bool)))
            key, at, exact = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(key)), pa.array(exact), pa.array(signed(whole[at])), pa.array(ids[row[at]].astype(np.int64)), pa.array(number[at].astype(np.int32))],
                ["key", "exact", "whole", "doc_id", "line"],
            )
    trim()


def _texts(batches: Iterator[pa.RecordBatch], wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    """The lines of documents that may be wanted."""
    for batch in batches:
        for part in chunks(passing(batch, wanted.value), "text"):
            lines = [x.split("\n") for x in part.column("text").to_pylist()]
            sizes = [len(x) for x in lines]
            ids = part.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(ids, sizes).astype(np.int64)), pa.array([i for n in sizes for i in range(n)], pa.int32()),
                    pa.array([x for part_lines in lines for x in part_lines], pa.string()),
                ],
                ["doc_id", "line", "text"],
            )
    trim()


def within_one(a: list, b: list) -> bool:
    """Whether one word replaced, added or left out, or nothing, turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i, short = 0, min(len(a), len(b))
    while i < short and a[i] == b[i]:
        i += 1
    rest = lambda x, longer: x[i + (len(x) >= longer) :]
    return rest(a, max(len(a), len(b))) == rest(b, max(len(a), len(b)))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = (batch.column("text").to_pylist(), batch.column("earlier").to_pylist())
        near = [within_one(a.encode().lower().split(), b.encode().lower().split()) for a, b in zip(*both)]
        yield batch.select(["whole"]).filter(pa.array(near, pa.bool_()))


def repeated_lines(spark: SparkSession, docs: DataFrame, least_words: int = 8, key_bits: int = KEY_BITS) -> DataFrame:
    """``(doc_id, n_lines, removed)``: how many lines with words each document has, and the
    numbers, from 0, of those that came before.

    docs needs doc_id and text; other columns are ignored.  Lines without words are never
    removed nor counted, so a null, empty or blank text has none.  Rows of null doc_id are
    left out of the result and of the search.  Rows that repeat a doc_id count as one document:
    their lines of one number are equally early and neither removes the other.  An empty table
    gives an empty result.
    """
    scratch = Scratch(spark)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = docs.mapInArrow(lambda it: line_table(it, least_words), "doc_id long, line int, whole long, keys array<long>")
    lines = scratch.save(table.select("doc_id", "line", "whole"))
    keys = table.select("whole", F.explode("keys").alias("key"))
    met = keys.groupBy("key").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).where("low <> high")
    shared = hash_bitmap(spark, met, "key", key_bits)

    rows = scratch.save(docs.mapInArrow(lambda it: variants(it, least_words, shared, key_bits), "key long, exact boolean, whole long, doc_id long, line int"))
    place = F.struct("doc_id", "line", "whole")
    lead = scratch.save(rows.groupBy("key").agg(
        F.min(F.when(F.col("exact"), place)).alias("exact_first"), F.min(F.when(~F.col("exact"), place)).alias("variant_first"),
        F.max("exact").alias("has_exact"), F.min("whole").alias("low"), F.max("whole").alias("high"),
    ).where("low <> high").drop("low", "high"))  # written, so that a hot key's rows can be split in the join
    # A replaced word meets variants; a word left out meets whole lines, which it may precede or follow.
    first = F.when(F.col("exact"), F.col("variant_first")).when(F.col("has_exact"), F.col("exact_first")).otherwise(F.col("variant_first"))
    pairs = (
        rows.join(lead, "key").select("whole", "doc_id", "line", first.alias("first"))
        .where((F.col("first.whole") != F.col("whole")) & (F.struct("first.doc_id", "first.line") < F.struct("doc_id", "line")))
        .groupBy("whole", F.col("first.whole").alias("other")).agg(F.min(F.struct("doc_id", "line")).alias("here"), F.min("first").alias("there"))
    )
    own = lines.groupBy("whole").agg(F.min(F.struct("doc_id", "line")).alias("place"))
    pairs = scratch.save(
        pairs.join(own, "whole").where(F.struct("there.doc_id", "there.line") < F.col("place"))
        .select("whole", "place.doc_id", "place.line", F.col("there.doc_id").alias("other_doc"), F.col("there.line").alias("other_line"))
    )
    scratch.drop(rows, lead)
    asked = pairs.select("doc_id").unionByName(pairs.select(F.col("other_doc").alias("doc_id")))
    wanted = id_bitmap(spark, asked, "doc_id")
    texts = docs.withColumn("bit", bit_of("doc_id")).mapInArrow(lambda it: _texts(it, wanted), "doc_id long, line int, text string")
    spots = pairs.select("doc_id", "line").unionByName(pairs.select(F.col("other_doc").alias("doc_id"), F.col("other_line").alias("line"))).distinct()
    texts = scratch.save(texts.join(spots, ["doc_id", "line"]))
    checked = (
        pairs.join(texts, ["doc_id", "line"])
        .join(texts.select(F.col("doc_id").alias("other_doc"), F.col("line").alias("other_line"), F.col("text").alias("earlier")), ["other_doc", "other_line"])
        .select("whole", "text", "earlier").mapInArrow(_verified, "whole long").distinct().withColumn("near", F.lit(True))
    )
    fate = scratch.save(own.join(checked, "whole", "left"))  # so that a hot line's rows can be split in the join
    return (
        lines.join(fate, "whole").withColumn("gone", F.col("near").isNotNull() | (F.struct("doc_id", "line") > F.col("place")))
        .groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("line")))).alias("removed"))
        .join(docs.select("doc_id").distinct(), "doc_id", "right")
        .select("doc_id", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    )


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs with the ``removed`` lines of ``(doc_id, n_lines, removed)`` cut from text.

    A document is dropped if all its lines with words are removed; one without any line to
    remove stays as it is.  The other lines, blank ones too, keep their order; other columns
    pass through, whatever their names.
    """
    lines, gone = free_name("lines", docs.columns), free_name("gone", docs.columns)
    cut = removed.select("doc_id", F.col("n_lines").alias(lines), F.col("removed").alias(gone))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return (
        docs.join(cut, "doc_id", "left")
        .where(F.coalesce((F.size(gone) == 0) | (F.size(gone) < F.col(lines)), F.lit(True)))
        .withColumn("text", F.when(F.size(gone) > 0, kept).otherwise(F.col("text"))).select(*docs.columns)
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the repeated lines of all documents by :func:`repeated_lines`, whose docstring defines nulls, empties, ties and repeats."""
    out = repeated_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))
