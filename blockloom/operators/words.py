"""Words, the dictionary of the most frequent, and texts written with it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import as_column, let
from ..kernels import lexicon

#: A run of bytes other than blanks, NUL and ASCII punctuation; on characters, the same runs.
WORD = "[^ \\t\\n\\r\\x00!-/:-@\\[-`{-~]+"


def words_of(text: Column | str) -> Column:
    return F.regexp_extract_all(as_column(text), F.lit(WORD), F.lit(0))


def word_counts(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """``(word, freq, first_seen)`` of words of 2 to 255 bytes over all texts."""
    at = docs.select(F.col(order).alias("__o"), F.posexplode(words_of(text)).alias("__p", "word"))
    size = F.octet_length("word")
    return at.where((size >= lexicon.SHORTEST) & (size <= lexicon.LONGEST)).groupBy("word").agg(
        F.count("*").alias("freq"), F.min(F.struct(F.col("__o").alias("doc"), F.col("__p").alias("place"))).alias("first_seen")
    )


def dictionary(counts: DataFrame) -> DataFrame:
    """``(word_id, word, freq)``: the most frequent words, first seen first among equals.

    Ids of one byte go to any word, the others to words of four bytes and up.  The counts are
    planned once: each task keeps its most frequent long and short words, 1024 of a kind at
    most, and only these are numbered.
    """
    from pyspark.sql import Window

    order = (F.desc("freq"), F.col("first_seen"))
    long = F.octet_length("word") >= lexicon.LONG_FROM
    place = F.row_number().over(Window.partitionBy("long").orderBy(*order))
    most = counts.withColumn("long", long).withColumn("place", place).where(F.col("place") <= lexicon.MOST)
    tiers = most.withColumn("tier", (F.row_number().over(Window.orderBy(*order)) > lexicon.ONE_BYTE).cast("int")).where("tier = 0 or long")
    number = F.row_number().over(Window.orderBy("tier", *order)) - 1
    return tiers.select(number.alias("word_id"), "word", "freq").where(F.col("word_id") < lexicon.MOST)


def collect_words(table: DataFrame) -> list[bytes]:
    """The words of a dictionary in order of id; 1024 rows at most."""
    return [r["word"].encode() for r in table.orderBy("word_id").limit(lexicon.MOST).collect()]


def replace_words(data: Column | str, words: list[bytes]) -> Column:
    """ASCII blocks with tokens for words; null for others."""
    @F.pandas_udf("binary")
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: lexicon.replace(bytes(x), words) if x is not None and bytes(x).isascii() else None)

    return run(as_column(data))


def restore_words(data: Column | str, words: list[bytes]) -> Column:
    @F.pandas_udf("binary")
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: None if x is None else lexicon.restore(bytes(x), words))

    return run(as_column(data))


def savings(table: DataFrame) -> DataFrame:
    """``(word_id, word, saved)`` of a dictionary: bytes that whole-word tokens save, less the entry itself."""
    size, token = F.octet_length("word"), F.when(F.col("word_id") < lexicon.ONE_BYTE, 1).otherwise(3)
    return table.select("word_id", "word", (F.col("freq") * (size - token) - (size + 1)).alias("saved"))


def word_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(previous, word, n)`` over neighbouring words of a text."""
    both = lambda w: F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("previous"), F.slice(w, F.lit(2), F.size(w) - 1).alias("word"))
    pairs = let(words_of(text), lambda w: F.when(F.size(w) >= 2, both(w)))
    return docs.select(F.explode(pairs).alias("p")).groupBy(F.col("p.previous").alias("previous"), F.col("p.word").alias("word")).agg(F.count("*").alias("n"))
