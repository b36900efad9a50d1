"""Ranking of candidates: gates, composite, priorities and the older score chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import composite, evidence, feedback_delta


def same_code(query_code: Column, code: Column) -> Column:
    """The code gate: false only if both have a code and they differ."""
    return ~((query_code != "") & (code != "") & (query_code != code))


def rerank(candidates: DataFrame, weights=(0.25, 0.5, 0.25)) -> DataFrame:
    """Adds evidence and composite from retrieval_score, relevance (one half if absent), up, votes, ok and runs."""
    proof = evidence(*(F.coalesce(c, F.lit(0)) for c in ("up", "votes", "ok", "runs")))
    df = candidates.withColumn("evidence", proof).withColumn("relevance_verified", F.col("relevance").isNotNull())
    return df.withColumn("composite", composite(F.col("retrieval_score"), F.coalesce("relevance", F.lit(0.5)), F.col("evidence"), weights))


def prioritized(candidates: DataFrame, by: str = "query_id", key: str = "key") -> DataFrame:
    """Position of each candidate: eligible ones first (high tier, same failure, not low), then composite, date and key."""
    w = Window.partitionBy(by).orderBy(
        F.desc(F.col("tier") == "high"), F.desc("same_failure"), F.desc(F.col("tier") != "low"), F.desc("composite"), F.desc("resolution_at"), F.asc(key)
    )
    return candidates.withColumn("position", F.row_number().over(w))


def nudged(score: Column, net: Column, rrf: Column, best: Column, order: Column, reason: Column, threshold: float = 0.7) -> Column:
    """The older chain: votes, pin of curated fixes, hybrid share, then order match and reason, in that order."""
    voted = score + feedback_delta(net)
    pinned = F.when(net >= 3, F.greatest(voted, F.lit(threshold + 0.001))).otherwise(voted)
    hybrid = F.when(best > 0, F.round(rrf / best * 0.1, 4)).otherwise(0.0)
    match = lambda c, w: F.when(c.isNull(), 0.0).when(c, 0.05 * w).otherwise(-0.12 * w)
    return pinned + hybrid + match(order, 1.0) + match(reason, 0.6)


def resolution_quality(kind: Column, fields: Column, has_fix: Column, steps: Column, length: Column, closer: Column) -> Column:
    """The older richness score of a resolution's text."""
    table = F.when(fields > 0, 5 + 0.4 * F.least(fields, F.lit(5))).otherwise(0.0)
    value = table + F.when(has_fix, 5.0).otherwise(0.0) + 0.6 * F.least(steps, F.lit(5)) + F.least(length / 200, F.lit(3.0)) - F.when(closer, 5.0).otherwise(0.0) - F.when(length < 60, 1.0).otherwise(0.0)
    return F.when(kind == "doc", 3.0).otherwise(value)


def merged(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local and remote candidates by (query_id, key): local score, remote evidence, origins united."""
    r = remote.select("query_id", "key", F.col("score").alias("remote_score"), F.col("evidence").alias("remote_evidence"))
    both = local.withColumn("here", F.lit(True)).join(r.withColumn("there", F.lit(True)), ["query_id", "key"], "full_outer")
    origins = F.filter(F.array(F.when(F.col("here"), "local"), F.when(F.col("there"), "remote")), lambda x: x.isNotNull())
    return both.select("query_id", "key", F.coalesce("score", "remote_score").alias("score"), F.coalesce("remote_evidence", "evidence").alias("evidence"), origins.alias("origins"), F.lit(False).alias("relevance_verified"))


def confidence(has_rule: Column, best: Column, candidates: Column, threshold: float = 0.7) -> Column:
    return F.when(has_rule, "approved_rule").when(best >= threshold, "strong_match").when(candidates > 0, "low_confidence").otherwise("no_data")
