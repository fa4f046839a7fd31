"""A corpus pipeline of five stages over the operators of ``blockloom.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return
the columns of documents.  Each is written as Parquet and read again as the docs of the next.
A row of null doc_id is judged by its own text where that is enough and stays otherwise; each
stage says what it does with nulls, empties, repeats and ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.byte_bpe import encode
from blockloom.llm.decontaminate import find_leaks
from blockloom.llm.idfilter import drop_ids
from blockloom.llm.jaccard_join import jaccard_components
from blockloom.llm.line_dedup import repeated_lines, without_lines
from blockloom.llm.quality_rules import clean_documents
from blockloom.llm.scratch import Scratch, free_name


#: A line in more of a source's different texts is furniture: the boilerplate line of the given
#: documents is in 8.5 to 13 % of each source's, every other line in under 5 %.
FURNITURE_SHARE = 0.065


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the furniture lines of their source that pass the base rules and were not mostly furniture.

    Null, empty and wordless texts go, since they have under 50 words.  A null source is one of
    its own; a row of null doc_id keeps its lines and is judged by the base rules.  Rows that
    repeat a doc_id are rejected together if depleted, else each by its own text.  A line in
    just the limit's share of texts stays.  Further columns pass, whatever their names; an
    empty table gives an empty one.
    """
    return clean_documents(spark, docs, share=FURNITURE_SHARE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came before; those with no line of words left go.

    Null, empty and wordless texts have no such line to lose and stay, as rows of null doc_id
    do.  Rows that repeat a doc_id are equally early: neither takes the other's lines, and both
    lose what an earlier document has.  Further columns pass, whatever their names; an empty
    table gives an empty one.
    """
    removed = Scratch(spark).save(repeated_lines(spark, docs).where(F.size("removed") > 0))
    return without_lines(docs, removed).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group that shares 0.8 of its five-word shingles.

    Null, empty and wordless texts are in no group and stay, as rows of null doc_id do.  Rows
    that repeat a doc_id are one document and share its fate.  A similarity of just 0.8 links.
    Further columns pass, whatever their names; an empty table gives an empty one.
    """
    member, _ = jaccard_components(spark, docs, width=5, percent=80)
    others = Scratch(spark).save(member.where("component_id <> doc_id").select("doc_id").distinct())
    return drop_ids(spark, docs, others)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null, empty and wordless texts contain none and stay.  A row of null doc_id is searched
    under a hash of its text.  Rows that repeat a doc_id go together if one of them contains an
    item; a share of just the limit counts.  Further columns pass, whatever their names; an
    empty table, or an empty benchmark, takes nothing away.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = find_leaks(spark, docs, benchmark)
    kept = drop_ids(spark, docs, Scratch(spark).save(leaks.select("doc_id").distinct()))
    unnamed = docs.where("doc_id is null")
    if unnamed.isEmpty():
        return kept
    name = free_name("key", docs.columns)
    keyed = unnamed.withColumn(name, F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")))
    found = find_leaks(spark, keyed.select(F.col(name).alias("doc_id"), "text").distinct(), benchmark)
    clean = keyed.join(Scratch(spark).save(found.select(F.col("doc_id").alias(name)).distinct()), name, "left_anti")
    return kept.where("doc_id is not null").unionByName(clean.select(*docs.columns))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, intact)`` of each document; intact if the ids decode to its text.

    A null text counts as empty and has no ids; doc_ids pass as they are, repeated or null.
    Further columns are left out; an empty table gives an empty one.
    """
    import public_tokenizers

    out = encode(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", "intact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("tokenise", tokenise),
]

#: Several stages have no SQL form; tests hold each against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
