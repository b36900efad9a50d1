"""The older search chain: lexical scores, floors, order match, splits and cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import error_similarity, feedback_delta, text_similarity
from ..functions.text import let, token_set
from .windows import numbered


def lexical_rescore(query_step: Column, query_error: Column, step: Column, error: Column, weight: float = 0.65) -> Column:
    """Score of a candidate by its words; null where its code contradicts the query's.

    With both fields ``(1 - weight) step + weight error``, with one that one alone; 'none'
    of them leaves the caller's score, so the result is a struct (score, kept, scored).
    """
    has_step, has_error = query_step != "", query_error != ""

    def build(e):
        s = text_similarity(query_step, step)
        both = F.round(s * (1 - weight) + e["score"] * weight, 3)
        score = F.when(has_step & has_error, both).when(has_error, e["score"]).when(has_step, s)
        return F.struct(score.alias("score"), (~has_error | ~e["gated"]).alias("kept"), (has_step | has_error).alias("scored"))

    return let(error_similarity(query_error, error), build)


def same_category(a: Column, b: Column) -> Column:
    """Whether the words of one category are among those of the other; both must have some."""
    x, y = token_set(a), token_set(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def order_adjustment(query_type: Column, query_reason: Column, kind: Column, reason: Column, lift: float = 0.05, sink: float = 0.12, share: float = 0.6) -> Column:
    """What order type and reason add to a ticket's rank: lifted where both sides agree, sunk where they differ."""
    def one(a, b, weight):
        there = (F.trim(a) != "") & (F.trim(b) != "")
        return F.when(there & same_category(a, b), lift * weight).when(there, -sink * weight).otherwise(0.0)

    return one(query_type, kind, 1.0) + one(query_reason, reason, share)


def error_floor(candidates: DataFrame, floor: float, step: str = "step_score", error: str = "error_score") -> DataFrame:
    """Drops candidates of which both sides were compared and the error side is below the floor."""
    return candidates.where(F.col(step).isNull() | F.col(error).isNull() | (F.col(error) >= floor))


def ranked_chain(candidates: DataFrame, threshold: float = 0.7, weight: float = 0.15, curated: int = 3, hybrid: float = 0.1, by: str = "query_id") -> DataFrame:
    """rank_score, strong and feedback label of (query_id, key, type, score, rrf, net, order_adj, quality, updated).

    Votes first, then the pin of confirmed fixes, the hybrid share and the order match;
    documents below the threshold go.
    """
    pinned = F.col("net") >= curated
    voted = F.col("score") + F.when(F.col("net") != 0, feedback_delta(F.col("net"), weight)).otherwise(0.0)
    voted = F.when(pinned, F.greatest(voted, F.lit(threshold + 0.001))).otherwise(voted)
    best = F.max("rrf").over(Window.partitionBy(by))
    share = F.when((F.col("rrf") > 0) & (best > 0), F.round(F.col("rrf") / best * hybrid, 4)).otherwise(0.0)
    label = F.when(pinned, "curated").when(F.col("net") > 0, "boosted").when(F.col("net") < 0, "demoted").otherwise("")
    out = candidates.withColumn("rank_score", voted + share + F.col("order_adj")).withColumn("feedback", label).withColumn("strong", F.col("rank_score") >= threshold)
    return out.where((F.col("type") != "doc") | F.col("strong"))


def final_order(ranked: DataFrame, by: str = "query_id", key: str = "key") -> DataFrame:
    """Position by rank to two places, quality to whole numbers (half to even), time and key; strong ones first."""
    w = Window.partitionBy(by).orderBy(F.desc("strong"), F.desc(F.round("rank_score", 2)), F.desc(F.bround("quality")), F.desc("updated"), F.asc(key))
    return ranked.withColumn("position", F.row_number().over(w))


def overfetch(k: int, factor: int, least: int, most: int) -> int:
    """How many to fetch so that ``k`` remain: ``factor`` times as many, within bounds."""
    return min(most, max(least, factor * k))


def best_of_kind(ranked: DataFrame, limits: dict[str, int], score: str, by: str = "query_id", key: str = "key", kind: str = "type") -> DataFrame:
    """The first so many of each kind of source in a query; kinds without a limit stay whole."""
    place = F.row_number().over(Window.partitionBy(by, kind).orderBy(F.desc(score), F.asc(key)))
    limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col(kind)), F.lit(2**31 - 1))
    return ranked.withColumn("place", place).where(F.col("place") <= limit)


def merged_sides(step: DataFrame, error: DataFrame, weight: float = 0.65, floor: float = 0.0, use_step: bool = True, use_error: bool = True, by: str = "query_id") -> DataFrame:
    """(query, key, score, step_score, error_score) of hits of either side; a side that lacks a hit counts as 0.

    With both sides in use, hits whose error side is below the floor go.
    """
    s, e = step.select(by, "key", F.col("score").alias("step_score")), error.select(by, "key", F.col("score").alias("error_score"))
    both = s.join(e, [by, "key"], "full_outer").select(by, "key", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("step_score", "error_score")))
    if use_step and use_error:
        return both.where(F.col("error_score") >= floor).withColumn("score", F.col("step_score") * (1 - weight) + F.col("error_score") * weight)
    return both.withColumn("score", F.col("step_score") if use_step else F.col("error_score"))


def ticket_corpus(chunks: DataFrame, signature: Column) -> DataFrame:
    """One row a ticket, its first chunk, with the signature of its failure and the number of tickets that share it.

    ``chunks(key, pos, ...)``; rows without a key go.
    """
    one = numbered(chunks.where(F.trim(F.coalesce("key", F.lit(""))) != ""), Window.partitionBy("key").orderBy("pos"), lambda n: n == 1).withColumn("signature", signature)
    return one.join(one.groupBy("signature").agg(F.count("*").alias("siblings")), "signature")
