"""Caches of earlier answers: validity, exact and similar lookups, generations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cosine
from ..sources.shared import shared_path
from .windows import numbered

SCORES = "map<string, struct<llm_score:double, llm_reason:string>>"


def usable_vector(v: Column) -> Column:
    """Not empty, all finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def valid_scores(raw: Column, expected: Column) -> Column:
    """Scores read from JSON, null unless their keys are exactly those expected, each score lies in 0 to 1 and each reason is text."""
    plain = F.from_json(raw, "map<string, struct<llm_score:string, llm_reason:string>>", {"mode": "PERMISSIVE"})
    number = lambda x: F.regexp_like(x, F.lit(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$")) & x.try_cast("double").between(0, 1)
    fine = F.forall(F.map_entries(plain), lambda e: F.coalesce(number(e["value"]["llm_score"]), F.lit(False)) & e["value"]["llm_reason"].isNotNull())
    same = (F.size(F.array_except(F.map_keys(plain), expected)) == 0) & (F.size(F.array_except(expected, F.map_keys(plain))) == 0)
    return F.when(F.coalesce(fine & same, F.lit(False)), F.from_json(raw, SCORES))


def scope_hash(*parts: Column) -> Column:
    """Scope of a cache: all that makes an answer reusable, the generation among it."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def bands_needed(threshold: float, bits: int, miss: float) -> int:
    """Bands of ``bits`` random hyperplanes that let a pair of ``threshold`` apart slip through with a chance of at most ``miss``."""
    hit = (1 - math.acos(min(threshold, 1.0)) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-hit))) if hit < 1 else 1


def band_keys(vector: Column, bits: int, count: int, seed: int = 7) -> Column:
    """For each band the sides of ``bits`` random hyperplanes on which a usable vector lies, as one number that names the band too."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes, weight = {}, 1 << np.arange(bits, dtype=np.int64)
        for vectors in batches:
            out = np.empty(len(vectors), object)
            width = np.array([len(v) for v in vectors], np.int64)
            for w in np.unique(width):
                if w not in planes:
                    planes[w] = np.random.default_rng([seed, int(w)]).standard_normal((int(w), bits * count))
                rows = np.flatnonzero(width == w)
                side = (np.stack([np.asarray(vectors.iloc[i], np.float64) for i in rows]) @ planes[w] > 0).reshape(len(rows), count, bits)
                codes = side @ weight + (np.arange(count, dtype=np.int64) << bits)
                for i, c in zip(rows, codes):
                    out[i] = c
            yield pd.Series(out, vectors.index)

    return run(vector)


def sketch(vector: Column, seed: int = 11) -> Column:
    """A usable vector's direction along eight (at most its length) orthonormal axes, a byte each."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        axes = {}
        for vectors in batches:
            out, width = np.zeros(len(vectors), np.int64), np.array([len(v) for v in vectors], np.int64)
            for w in np.unique(width):
                if w not in axes:
                    axes[w] = np.linalg.qr(np.random.default_rng([seed, int(w)]).standard_normal((int(w), min(8, int(w)))))[0]
                rows = np.flatnonzero(width == w)
                v = np.stack([np.asarray(vectors.iloc[i], np.float64) for i in rows])
                v /= np.abs(v).max(axis=1, keepdims=True)
                at = np.clip((v / np.linalg.norm(v, axis=1, keepdims=True)) @ axes[w], -1, 1)
                out[rows] = np.pad(np.floor((at + 1) * 127.5).astype(np.uint8), ((0, 0), (0, 8 - at.shape[1]))).view(np.int64)[:, 0]
            yield pd.Series(out, vectors.index)

    return run(vector)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """False only where two sketches prove that the cosine is below ``threshold``: directions are no nearer than their parts along the axes."""
    byte = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
    gap = lambda i: F.greatest(F.abs(byte(a, i) - byte(b, i)) - 1, F.lit(0))
    return sum((gap(i) * gap(i) for i in range(1, 8)), gap(0) * gap(0)) <= math.ceil((2 - 2 * threshold + 1e-6) * 127.5**2)


def _meet(asked: DataFrame, stored: DataFrame, keys: list[str], most: int, threshold: float) -> DataFrame:
    """(query_id, id) of rows with equal keys whose sketches allow ``threshold``.  The stored rows of a key go in pieces of about ``most``, which the asked ones visit."""
    hot = stored.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("pieces")).where("pieces > 1")
    pieces = F.coalesce("pieces", F.lit(1).cast("long"))
    s = stored.join(hot, keys, "left").withColumn("piece", F.pmod(F.xxhash64("id"), pieces)).drop("pieces")
    a = asked.join(hot, keys, "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("pieces")
    both = a.join(s.withColumnRenamed("sketch", "other"), [*keys, "piece"])
    return both.where(may_reach(F.col("sketch"), F.col("other"), threshold)).select("query_id", "id")


def similar(requests: DataFrame, entries: DataFrame, threshold: float, nearest: int = 3, bits: int | None = None, miss: float = 1e-6, most_bands: int = 64, direct: int = 2_000) -> DataFrame:
    """(query_id, id, similarity, position): the ``nearest`` entries of the same scope from ``threshold`` on, ties to the smaller id.

    ``requests(query_id, scope, vector)``, ``entries(id, scope, vector)``.  Scopes of at most
    ``direct`` different vectors are compared whole.  In larger ones vectors meet that lie on the same side
    of all hyperplanes of a band, and every pair is then compared in full; a pair at the threshold is
    missed with a chance of ``miss``, a closer one with less.  ``bits`` (hyperplanes of a band) grow with the
    largest scope unless given, so a band's lists stay short.  Pairs whose sketches rule the threshold out
    don't get that far.  Where the threshold is so low that this takes
    more than ``most_bands`` bands, large scopes are compared whole too, in pieces.  Equal vectors of a
    scope are compared once.  Vectors that are null, empty, zero, not finite or of another length than
    the request's have no similarity.  The different vectors of both sides are written to the
    shared folder first, since every leg reads them, and stay there as long as the result may be read.
    """
    folder = shared_path(requests.sparkSession, "similar")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    v = F.col("vector").cast("array<double>")
    ids = entries.select("id", "scope", v.alias("vector")).where(usable_vector(F.col("vector")))
    ids = numbered(ids, Window.partitionBy("scope", "vector").orderBy("id"), lambda n: n <= nearest)
    stored = written(ids.groupBy("scope", "vector").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")).withColumn("sketch", sketch(F.col("vector"))), "stored")  # at most ``nearest`` ids
    q = requests.select("query_id", "scope", v.alias("vector")).where(usable_vector(F.col("vector")))
    asked = written(q.groupBy("scope", "vector").agg(F.min("query_id").alias("query_id")).withColumn("sketch", sketch(F.col("vector"))), "asked")
    size = F.size("vector").alias("width")
    sides = [asked.select("query_id", "scope", size, "vector", "sketch"), stored.select("id", "scope", size, "vector", "sketch")]
    large = stored.groupBy("scope").count().where(F.col("count") > direct)
    most = large.agg(F.max("count").alias("most")).first().most or 0
    large = large.select("scope")
    if bits is None:
        bits = 12
        while most >> (bits + 2) and bands_needed(threshold, bits + 1, miss) <= most_bands:  # lists of about four
            bits += 1
    count = bands_needed(threshold, bits, miss)
    if count > most_bands or not most:
        pairs = _meet(*(d.drop("vector") for d in sides), ["scope", "width"], direct, threshold)
    else:
        whole = [d.join(large, "scope", "left_anti").drop("vector") for d in sides]
        banded = [d.join(large, "scope", "left_semi").withColumn("band", F.explode(band_keys(F.col("vector"), bits, count))).drop("vector") for d in sides]
        pairs = _meet(*whole, ["scope", "width"], direct, threshold).unionByName(_meet(*banded, ["scope", "width", "band"], 10 * direct, threshold).distinct())
    found = pairs.join(asked.select("query_id", "scope", "vector"), "query_id").join(stored.select("id", "ids", F.col("vector").alias("other")), "id")
    found = found.withColumn("similarity", F.round(cosine(F.col("vector"), F.col("other")), 9)).where(F.col("similarity") >= threshold)
    found = found.select("query_id", "similarity", F.explode("ids").alias("id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    best = found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= nearest).withColumnRenamed("query_id", "first")
    same = q.join(asked.drop("sketch").withColumnRenamed("query_id", "first"), ["scope", "vector"]).select("query_id", "first")
    return same.join(best, "first").select("query_id", "id", "similarity", "position")


def lookup(requests: DataFrame, entries: DataFrame, threshold: float = 0.97, now: Column | None = None, valid: str | None = None, **search) -> DataFrame:
    """(query_id, status, id, similarity): an exact hit, else the most similar entry of the scope, else a miss.

    ``requests(query_id, scope, query_hash, eligible, vector)``, ``entries(id, scope,
    query_hash, vector, expires_at)``.  Only requests without an exact hit are compared by ``similar``
    (``search`` goes there), and of these the eligible ones.  ``valid`` names a column of entries
    that is checked afterwards: an exact hit must pass it, and of the three nearest the first
    that passes it counts.
    """
    e = entries if now is None else entries.where(F.col("expires_at") > now)
    passes = F.lit(True) if valid is None else F.coalesce(F.col(valid), F.lit(False))
    e = e.select("id", "scope", "query_hash", "vector", passes.alias("passes"))
    same = e.where("passes").groupBy("scope", "query_hash").agg(F.min("id").alias("id"))
    exact = requests.select("query_id", "scope", "query_hash").join(same, ["scope", "query_hash"]).select("query_id", "id", F.lit(1.0).alias("similarity"), F.lit("exact_hit").alias("status"))
    rest = requests.where("eligible").join(exact.select("query_id"), "query_id", "left_anti")
    near = similar(rest, e, threshold, nearest=1 if valid is None else 3, **search)
    if valid is not None:
        near = near.join(e.where("passes").select("id"), "id")
    near = near.groupBy("query_id").agg(F.min_by(F.struct("id", "similarity"), "position").alias("hit"))
    hits = exact.unionByName(near.select("query_id", "hit.id", "hit.similarity", F.lit("semantic_hit").alias("status")))
    out = requests.select("query_id").join(hits, "query_id", "left")
    return out.select("query_id", F.coalesce("status", F.lit("miss")).alias("status"), "id", "similarity")


def cleared(state: DataFrame, generation: Column) -> DataFrame:
    """State in which the cache has a new generation, so that no entry of the old one, nor a write under way, is in scope."""
    return state.withColumn("value", F.when(F.col("key") == "cache_generation", generation).otherwise(F.col("value")))


def fresh_sources(cache: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Cached evidence that isn't from the future, at most so many seconds old, and not empty, with its age."""
    age = now.cast("timestamp").cast("double") - F.col("cached_at").cast("timestamp").cast("double")
    return cache.withColumn("age_seconds", F.round(age).cast("long")).where((age >= 0) & (age <= seconds) & (F.size("sources") > 0))
