"""Allow and block decisions for urls: fixed rules, then trust that spreads over host links.

Rules name a host and a path prefix and hold for subdomains.  A page that no rule fits is
judged by its host: trust flows forward along host links from hosts whose pages are allowed,
distrust flows backward from hosts whose pages are blocked (who links to bad hosts is bad),
both as personalised PageRank.  A host is blocked where distrust exceeds a threshold and
trust.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

# The rules of the query, (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = "(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"']?\\s*((?:https?:)?//[^\"'\\s>]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: the share of a host's outward links that go to another host.

    pages needs host and html.  Links inside a host are left out.  Counts are summed per host
    pair before any rank is passed along, so a hot host costs one row for each neighbour.
    """
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("url"))
    target = host_of(F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url")))
    pairs = links.select(F.col("host").alias("src"), target.alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def weighted(edges: DataFrame, source: str) -> DataFrame:
    """Edges with weights that sum to 1 over each source."""
    total = edges.groupBy(source).agg(F.sum("n").alias("total"))
    other = "dst" if source == "src" else "src"
    return edges.join(total, source).select(F.col(source).alias("from"), F.col(other).alias("to"), (F.col("n") / F.col("total")).alias("weight"))


def rounds_for(damping: float, tolerance: float) -> int:
    """How many rounds leave under ``tolerance`` of any seed undelivered, however long its paths."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def pagerank(seeds: DataFrame, edges: DataFrame, scratch: Scratch, damping: float, tolerance: float) -> DataFrame:
    """``(host, score)`` of hosts that seeds ``(host, seed)`` reach over ``(from, to, weight)``.

    Scores are in units of one full seed: a host without inward links scores its own seed.
    Rounds end when no score rises by ``tolerance * (1 - damping)`` any more, or as
    :func:`rounds_for` says.
    """
    score = seeds.select("host", F.col("seed").alias("score"))
    if edges.isEmpty():
        return score
    for _ in range(rounds_for(damping, tolerance)):
        before = score
        passed = (
            score.join(edges, F.col("host") == F.col("from")).groupBy("to")
            .agg(F.sum(F.col("score") * F.col("weight") * damping).alias("score")).withColumnRenamed("to", "host")
        )
        score = scratch.save(
            passed.join(seeds, "host", "full").select("host", (F.coalesce("score", F.lit(0.0)) + F.coalesce("seed", F.lit(0.0))).alias("score"))
        )
        rise = F.max(F.col("score") - F.coalesce("old", F.lit(0.0)))
        if (score.join(before.withColumnRenamed("score", "old"), "host", "left").agg(rise).first()[0] or 0.0) < tolerance * (1 - damping):
            break
    return score


def judge(
    spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = 0.85, tolerance: float = 1e-3, threshold: float = 0.5
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` of every row of pages.

    pages needs page_id, url and html; other columns are ignored.  A null url, or one without
    ``://``, has an empty host and path and is allowed; null html has no links.  Seeds are the
    share of a host's pages, and one more, that rules allow or block: a host blocked in part is
    distrusted in part, and a single page decides nothing.  Distrust of just ``threshold``, or
    just the host's trust, does not block.  Repeated rows count as pages of their own.  An empty
    table gives an empty result.
    """
    scratch = Scratch(spark)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    ruled = parts.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r")).select(
        "page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruling")
    )
    share = lambda v: F.count(F.when(F.col("ruling") == v, 1)) / (F.count("*") + 1)
    hosts = scratch.save(ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")))
    edges = scratch.save(host_edges(parts))
    forward = scratch.save(weighted(edges, "src"))
    # A host takes distrust by the share of its own links, so that it does not matter how many others link there too.
    backward = forward.select(F.col("to").alias("from"), F.col("from").alias("to"), "weight")
    trust = pagerank(hosts.where("good > 0").select("host", F.col("good").alias("seed")), forward, scratch, damping, tolerance)
    distrust = pagerank(hosts.where("bad > 0").select("host", F.col("bad").alias("seed")), backward, scratch, damping, tolerance)
    scores = scratch.save(
        trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
        .select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    )
    bad = (F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruling", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages by :func:`judge`, whose docstring defines nulls, empties, ties and repeats."""
    return judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
