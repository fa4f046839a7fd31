"""Secrets in texts with DataFrame functions only: fixed patterns, and Markov models for the rest.

Two first-order character models, one of random strings and one of ordinary identifiers, are
counted from labelled samples.  A run of token characters that no pattern took is a secret if
its log-likelihood ratio is high, in total and per character.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the base kinds, in the order in which kinds sort.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
RUN = "[A-Za-z0-9+/_-]{20,}={0,2}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
SIZE = len(ALPHABET) + 1
SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches in code points, without those whose group is too short.

    The pieces between matches and the matches themselves, laid end to end, give the places.
    """
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(pieces.alias("piece"), whole.alias("match"), held.alias("held"))
    start = lambda acc, x: acc["at"] + F.length(x["piece"])

    def step(acc: Column, x: Column) -> Column:
        end = start(acc, x) + F.coalesce(F.length(x["match"]), F.lit(0))
        found = F.array(F.struct(start(acc, x).alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        good = x["match"].isNotNull() & (F.length(x["held"]) >= least)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["found"], found)).otherwise(acc["found"]).alias("found"))

    empty = F.array().cast(SPAN)
    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(spans(text, ASSIGN, 0, 2, 6), spans(text, ACCESS, 1), spans(text, HEX, 2)))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of character pairs from ``(token, random)`` samples.

    A pair is smoothed by how often its second character occurs at all in samples of its kind.
    At most ``2 * SIZE ** 2`` counts come to the driver.  Characters outside the alphabet
    share one place.  Without samples every ratio is 0.
    """
    pair = F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substring(token, i, 2))"))
    rows = (
        samples.where("length(token) >= 2 and random is not null").select("random", pair.alias("pair"))
        .groupBy("random", *(F.expr(f"instr('{ALPHABET}', substring(pair, {i}, 1))").alias(c) for i, c in ((1, "a"), (2, "b"))))
        .agg(F.count("*").alias("n")).collect()
    )
    count = {(bool(r["random"]), r["a"], r["b"]): r["n"] for r in rows}
    ratio, weight = [], smoothing * SIZE
    single = {kind: [sum(count.get((kind, a, b), 0) for a in range(SIZE)) + smoothing for b in range(SIZE)] for kind in (True, False)}
    for a in range(SIZE):
        total = {kind: sum(count.get((kind, a, b), 0) for b in range(SIZE)) + weight for kind in (True, False)}
        for b in range(SIZE):
            random, plain = (
                (count.get((kind, a, b), 0) + weight * single[kind][b] / sum(single[kind])) / total[kind] for kind in (True, False)
            )
            ratio.append(math.log(random / plain))
    return ratio


def likelihood_ratio(token: Column, ratio: list[float]) -> Column:
    """Sum of the pair ratios over a token."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in ratio)), ",").cast("array<double>")
    place = lambda i: F.call_function("instr", F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.get(table, place(i) * SIZE + place(i + 1)))
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def markov_spans(text: Column, base: Column, ratio: list[float], total: float, mean: float) -> Column:
    """Runs of token characters that meet no base span and look random."""
    def random(x: Column) -> Column:
        token = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        score = likelihood_ratio(token, ratio)
        return (score >= total) & (score >= mean * F.length(token))

    free = lambda x: ~F.exists(base, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"]))
    return F.filter(F.filter(spans(text, RUN, 3), free), random)


def corpus_samples(docs: DataFrame, sample_docs: int = 2000) -> DataFrame:
    """Labelled ``(token, random)`` samples from a corpus.

    Ordinary: runs of at least six token characters, outside base spans, of the ``sample_docs``
    documents whose doc_id has the least MD5.  Random: the values in the base spans of the same
    documents, and for each of them strings of digests in base 64, hex and upper case, so that
    no alphabet is missing.
    """
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string"))).limit(sample_docs)
    picked = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    without = picked.select("doc_id", "text", F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), HEX, " "), ACCESS, " ").alias("rest"))
    plain = without.select(F.explode(F.array_distinct(F.regexp_extract_all("rest", F.lit("[A-Za-z0-9+/_-]{6,}"), F.lit(0)))).alias("token"), F.lit(False).alias("random"))
    held = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (HEX, ACCESS)))
    found = picked.select(F.explode(held).alias("token"), F.lit(True).alias("random")).distinct()
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    made = picked.select(
        F.explode(F.array(F.base64(F.unhex(digest)), F.base64(F.unhex(F.sha2(digest, 256))), digest, F.translate(F.upper(F.base64(F.unhex(digest))), "+/=", "234"))).alias("token"),
        F.lit(True).alias("random"),
    )
    return plain.unionByName(found).unionByName(made)


def scan(docs: DataFrame, ratio: list[float], total: float = 15.0, mean: float = 2.0) -> DataFrame:
    """docs with ``base`` and ``found``: arrays of (start, kind, end), kinds 0-2 by pattern, 3 by model.

    docs needs text; other columns pass, ones named like a result are replaced.  A null
    or empty text has empty lists.  Places are code points, ends exclusive; each list is in order
    of start, then kind.  A run whose ratio is just ``total`` and ``mean`` is a secret.  Repeated
    rows give repeated results, and an empty table an empty one.
    """
    docs = docs.drop("base", "found").withColumn("base", base_spans(F.coalesce("text", F.lit(""))))
    more = markov_spans(F.coalesce("text", F.lit("")), F.col("base"), ratio, total, mean)
    return docs.withColumn("found", F.array_sort(F.concat("base", more)))


def _written(found: str) -> Column:
    kinds = F.array(*(F.lit(k) for k in ("assign", "access", "hex", "markov")))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents by :func:`scan`, whose docstring defines nulls, empties, ties and repeats; the model learns from :func:`corpus_samples`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs, train(corpus_samples(docs)))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written("base"), 256).alias("base_sha256"), _written("found").alias("spans"),
    )
