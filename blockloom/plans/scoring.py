"""Scores of engines against peers, from a table of sizes and seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(original: Column, compressed: Column) -> Column:
    """Compressed size in percent of the original; null for nothing."""
    return F.when(original > 0, 100.0 * compressed / original)


def throughput(original: Column, seconds: Column) -> Column:
    """Megabytes of original bytes a second."""
    return F.when(seconds > 0, original / F.lit(1e6) / seconds)


def ratio_verdict(own: Column, peer: Column) -> Column:
    """Lower wins; equal, or both next to nothing, is a tie."""
    return F.when((own == peer) | ((own < 0.5) & (peer < 0.5)), "tie").when(own < peer, "win").otherwise("lose")


def speed_verdict(own: Column, peer: Column) -> Column:
    return F.when(own == peer, "tie").when(own > peer, "win").otherwise("lose")


def both_verdict(by_ratio: Column, by_speed: Column) -> Column:
    return F.when((by_ratio != "lose") & (by_speed == "win"), "win").when((by_ratio == "lose") & (by_speed == "lose"), "lose").otherwise("split")


def verdicts(engines: DataFrame, peers: DataFrame) -> DataFrame:
    """``(file, engine, peer, ratio, speed, both)``: every engine with every peer of the same file.

    Both tables are ``(file, engine, ratio, speed)``.
    """
    own = engines.select("file", "engine", F.col("ratio").alias("own_ratio"), F.col("speed").alias("own_speed"))
    other = peers.select("file", F.col("engine").alias("peer"), F.col("ratio").alias("peer_ratio"), F.col("speed").alias("peer_speed"))
    both = own.join(other, "file").withColumn("ratio", ratio_verdict(F.col("own_ratio"), F.col("peer_ratio"))).withColumn(
        "speed", speed_verdict(F.col("own_speed"), F.col("peer_speed"))
    )
    return both.select("file", "engine", "peer", "ratio", "speed", both_verdict(F.col("ratio"), F.col("speed")).alias("both"))


def tally(verdict_rows: DataFrame) -> DataFrame:
    """``(axis, engine, peer, wins, losses, ties)``; a split counts as neither."""
    axis = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("verdict")) for a in ("ratio", "speed", "both"))))
    rows = verdict_rows.select("engine", "peer", axis.alias("v")).select("v.axis", "engine", "peer", "v.verdict")
    return rows.groupBy("axis", "engine", "peer").agg(
        F.count_if(F.col("verdict") == "win").alias("wins"), F.count_if(F.col("verdict") == "lose").alias("losses"), F.count_if(F.col("verdict") == "tie").alias("ties")
    )


def against_baseline(results: DataFrame, baseline: str, margin: float = 0.05) -> DataFrame:
    """``(file, engine, ratio, delta, mark)``: difference to the baseline of the same file."""
    base = results.where(F.col("engine") == baseline).select("file", F.col("ratio").alias("base"))
    delta = F.col("ratio") - F.col("base")
    mark = F.when(delta < -margin, "better").when(delta > margin, "worse").otherwise("same")
    return results.where(F.col("engine") != baseline).join(base, "file").select("file", "engine", "ratio", delta.alias("delta"), mark.alias("mark"))


def totals(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("engine").agg(F.count("*").alias("files"), F.sum("original").alias("original"), F.sum("compressed").alias("compressed")).withColumn(
        "ratio", ratio(F.col("original"), F.col("compressed"))
    )


def round_trips(restored: DataFrame, members: DataFrame) -> DataFrame:
    """``(member_id, intact)``: whether each member came back byte for byte; missing ones did not."""
    back = restored.select("member_id", F.sha2("content", 256).alias("__b"))
    return members.select("member_id", F.sha2("content", 256).alias("__a")).join(back, "member_id", "left").select(
        "member_id", F.coalesce(F.col("__a") == F.col("__b"), F.lit(False)).alias("intact")
    )
