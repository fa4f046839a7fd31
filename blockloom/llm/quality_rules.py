"""Quality rules with DataFrame functions only: text statistics and cross-document lines.

Base rules look at one text: too few words, or too many words inside repeated three-word
windows.  The line rule looks across documents: a normalised line that many different texts of
one host share is furniture of that host.  Such lines are cut from the text, and a document
that is mostly such lines is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, free_name

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
PACKED = 1 << 12
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more.

    In texts of up to PACKED words, window hash and place share one long: as many low bits hold
    the place as the text needs, the rest, 52 at least, hold the hash, and one primitive sort
    brings equal windows together.  Longer texts keep the whole hash beside the place.
    """
    n = F.size(words)

    def covered(sorted_rows: Column, group, place) -> Column:
        twin = lambda s, x, i: (
            (group(F.get(s, i - 1)) == group(x)) | (group(F.get(s, i + 1)) == group(x))
        )
        return _let(sorted_rows, lambda s: _let(
            F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(s, x, i), F.lit(False))), place)),
            lambda at: F.aggregate(
                F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(3)), F.lit(3)).cast("long")),
                F.lit(0).cast("long"), lambda a, x: a + x,
            ),
        ))

    def count(h: Column) -> Column:
        bits = F.length(F.bin(F.size(h).cast("long")))
        packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        whole = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        return F.when(n <= PACKED, covered(packed, lambda x: F.call_function("shiftright", x, bits), lambda x: x.bitwiseAND(mask))).otherwise(
            covered(whole, lambda x: x["h"], lambda x: x["i"])
        )

    hashes = lambda w: F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    return F.when(n >= 4, _let(words, lambda w: _let(hashes(w), count))).otherwise(F.lit(0).cast("long"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_statistics(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs with the counts of the base rules and ``base_failed``, each name after ``prefix``.

    docs needs text; other columns pass, and must not be called like a result.
    """
    body, words, lines = (free_name(c, [*docs.columns, *(prefix + x for x in STATISTICS)]) for c in ("body", "words", "lines"))
    solid = F.filter(F.split(F.col(body), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counts = {
        "n_words": F.size(words), "word_chars": F.length(F.translate(body, SPACES, "")), "n_symbols": F.length(body) - F.length(F.translate(body, SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": repeated_words(F.col(words)),
    }
    n, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (
        docs.withColumn(body, F.coalesce(F.col("text"), F.lit(""))).withColumn(words, words_of(F.col(body))).withColumn(lines, solid)
        .select("*", *(counts[c].cast("long").alias(prefix + c) for c in STATISTICS))
        .withColumn(prefix + "base_failed", (n < 50) | (100 * repeats > 50 * n))
        .drop(body, words, lines)
    )


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space as one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), WORD_BREAK, " "))


def host_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, host, body, line, n`` for every different normalised line of each row, n its words."""
    line = normal_line(F.col("raw"))
    return (
        docs.select(
            "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
            F.xxhash64("text").alias("body"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("raw"),
        )
        .select("doc_id", "host", "body", line.alias("norm"))
        .where("norm <> ''")
        .select("doc_id", "host", "body", F.xxhash64("norm").alias("line"), (F.length("norm") - F.length(F.translate("norm", " ", "")) + 1).alias("n"))
    )


def furniture(lines: DataFrame, share: float, least_docs: int) -> DataFrame:
    """``(host, line)`` that over ``share`` of a host's different texts have, and ``least_docs`` at least.

    Exact copies count as one text, so a much copied document does not reject itself.
    """
    pairs = lines.select("host", "body", "line").distinct()
    often = pairs.groupBy("host", "line").agg(F.count("*").alias("texts")).where(F.col("texts") >= least_docs)
    total = lines.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("all"))
    return often.join(total, "host").where(F.col("texts") > share * F.col("all")).select("host", "line")


def furnished_documents(docs: DataFrame, scratch: Scratch, share: float = 0.1, least_docs: int = 20, loss: float = 0.5) -> DataFrame:
    """``(doc_id, furniture, depleted)`` of documents with lines above the limits: hashes of these
    lines, each with its host, and whether over ``loss`` of the document's words are in them.
    """
    lines = scratch.save(host_lines(docs.where("doc_id is not null")))
    common = scratch.save(furniture(lines, share, least_docs))
    hit = F.when(F.col("common") == 1, F.xxhash64("host", "line"))
    return scratch.save(
        lines.join(common.withColumn("common", F.lit(1)), ["host", "line"], "left")
        .groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("common") == 1, F.col("n"))).alias("lost"), F.collect_set(hit).alias("furniture"))
        .where("lost is not null").select("doc_id", "furniture", (F.col("lost") > loss * F.col("n")).alias("depleted"))
    )


def depleted_documents(docs: DataFrame, scratch: Scratch, share: float = 0.1, least_docs: int = 20, loss: float = 0.5) -> DataFrame:
    """doc_ids that lose over ``loss`` of their words with the lines above the limits."""
    return furnished_documents(docs, scratch, share, least_docs, loss).where("depleted").select("doc_id")


def without_furniture(text: Column, source: Column, furniture: Column) -> Column:
    """The text without its lines in ``furniture``; the other lines, blank ones too, keep their order."""
    host = F.coalesce(source.cast("string"), F.lit(""))
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(furniture, F.xxhash64(host, F.xxhash64(normal_line(x)))))
    return F.when(F.size(furniture) > 0, F.array_join(kept, "\n")).otherwise(text)


def clean_documents(spark: SparkSession, docs: DataFrame, share: float = 0.1, least_docs: int = 20, loss: float = 0.5) -> DataFrame:
    """The documents that are not depleted and whose text, without the lines above the limits,
    passes the base rules, with that text and its ``n_chars``.

    docs needs doc_id, text, source and n_chars; all its columns pass, whatever their names.  A
    null or empty text fails the base rules.  A row of null doc_id keeps its lines and is judged
    by the base rules alone.  Rows that repeat a doc_id are depleted together.  A text of which
    no line is cut stays as it is, and so does its ``n_chars``.  A line in just ``share`` of the
    texts, or a document that loses just ``loss`` of its words, stays.  An empty table gives an
    empty result.
    """
    found = furnished_documents(docs.select("doc_id", "text", "source"), Scratch(spark), share, least_docs, loss)
    lines, depleted = free_name("furniture", docs.columns), free_name("depleted", docs.columns)
    cut = (
        docs.join(found.select("doc_id", F.col("furniture").alias(lines), F.col("depleted").alias(depleted)), "doc_id", "left")
        .where(~F.coalesce(depleted, F.lit(False))).withColumn("text", without_furniture(F.col("text"), F.col("source"), F.col(lines)))
        .withColumn("n_chars", F.when(F.col(lines).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    )
    prefix = "rules_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return text_statistics(cut.select(*docs.columns), prefix).where(~F.col(prefix + "base_failed")).select(*docs.columns)


def apply_rules(spark: SparkSession, docs: DataFrame, share: float = 0.1, least_docs: int = 20, loss: float = 0.5) -> DataFrame:
    """docs with the counts, ``base_failed`` and ``kept``, and text without the lines above the limits.

    docs needs doc_id, text and source (the host); further columns pass through, except that
    a column named like a result is replaced.  A null text has no words and fails; a null
    source is one host of its own; a row of null doc_id is judged by the base rules alone.
    The counts are of the text as it was given.  Rows that repeat a doc_id are depleted together.
    A line in just ``share`` of the texts, or a document that loses just ``loss`` of its words,
    stays.  An empty table gives an empty result.
    """
    made = [*STATISTICS, "base_failed", "kept"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    found = furnished_documents(docs.select("doc_id", "text", "source"), Scratch(spark), share, least_docs, loss)
    lines, depleted = free_name("furniture", docs.columns), free_name("depleted", docs.columns)
    return (
        text_statistics(docs).join(found.select("doc_id", F.col("furniture").alias(lines), F.col("depleted").alias(depleted)), "doc_id", "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(depleted, F.lit(False)))
        .withColumn("text", without_furniture(F.col("text"), F.col("source"), F.col(lines))).drop(lines, depleted)
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents by :func:`apply_rules`, whose docstring defines nulls, empties, ties and repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return apply_rules(spark, docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
