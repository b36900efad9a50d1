"""Scores on columns: vectors, token sets, shrinkage and the composite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, error_signature, strip_volatile, token_set


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, in order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def cosine(a: Column, b: Column) -> Column:
    """-1 where lengths differ, are 0, or a vector is zero or not finite."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.try_divide(dot(a, b), size)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (size == 0) | F.isnan(value) | value.isNull(), F.lit(-1.0)).otherwise(value)


def dual_score(step: Column, error: Column, weight: float = 0.65, floor: float | None = None) -> Column:
    """Weighted sum of both sides, or the one that is there; null where both are and the error side is below ``floor``."""
    both = (1 - weight) * step + weight * error
    both = both if floor is None else F.when(error >= floor, both)
    return F.when(step.isNull(), error).when(error.isNull(), step).otherwise(both)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))))


def text_similarity(a: Column, b: Column) -> Column:
    """Token Jaccard with 1 for subsets and for two empty texts."""
    x, y = (token_set(strip_volatile(clean_text(c))) for c in (a, b))
    inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(inside, 1.0).otherwise(F.round(jaccard(x, y), 3))


def error_similarity(query: Column, candidate: Column, floor: float = 0.6) -> Column:
    """Struct of score and gated: different codes drop, equal codes lift the score to the floor."""
    q, c = error_signature(query), error_signature(candidate)
    both = (q["code"] != "") & (c["code"] != "")
    gated, same = both & (q["code"] != c["code"]), both & (q["code"] == c["code"])
    plain = jaccard(q["tokens"], c["tokens"])
    none = (F.size(q["tokens"]) == 0) & (F.size(c["tokens"]) == 0)
    score = (
        F.when((q["code"] == "") & (F.size(q["tokens"]) == 0), 1.0).when(gated, 0.0)
        .when(none, F.when(same, 1.0).otherwise(0.0)).when(same, F.round(F.greatest(plain, F.lit(floor)), 3)).otherwise(F.round(plain, 3))
    )
    return F.struct(score.alias("score"), gated.alias("gated"))


def shrunk(good: Column, n: Column) -> Column:
    """Beta(2, 2) mean."""
    return (good + 2) / (n + 4)


def evidence(up: Column, n: Column, ok: Column, m: Column) -> Column:
    """Human and automated evidence, weighted by volume; one half where there is none."""
    return F.when(n + m == 0, 0.5).otherwise((shrunk(up, n) * n + shrunk(ok, m) * m) / (n + m))


def composite(retrieval: Column, relevance: Column, proof: Column, weights=(0.25, 0.5, 0.25)) -> Column:
    if abs(sum(weights) - 1) > 0.001:
        raise ValueError("weights must add up to 1")
    return weights[0] * retrieval + weights[1] * relevance + weights[2] * proof


def feedback_delta(net: Column, weight: float = 0.15) -> Column:
    return F.tanh(net / 2) * weight
