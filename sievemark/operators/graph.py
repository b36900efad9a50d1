"""The ticket graph: signature buckets and pointer edges, one hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand(seeds: DataFrame, members: DataFrame, pointers: DataFrame, most: int = 8, bucket: int = 200) -> DataFrame:
    """Neighbours of seeds (query_id, key): same bucket, or joined by a pointer in either direction.

    ``members(key, bucket)``, ``pointers(src, dst)``.  Buckets of more than ``bucket``
    members give no neighbours, so the join can't grow with the square of a bucket; a
    pointer overrides a bucket; seeds are left out; at most ``most`` a query, pointers first.
    """
    fit = members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") <= bucket).select("bucket")
    m = members.join(fit, "bucket")
    own = seeds.join(m, "key").select("query_id", "bucket").distinct()
    near = own.join(m, "bucket").select("query_id", "key", F.lit(1).alias("kind"))
    both = pointers.select("src", "dst").unionByName(pointers.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    linked = seeds.join(both, seeds["key"] == both["src"]).select("query_id", F.col("dst").alias("key"), F.lit(0).alias("kind"))
    every = near.unionByName(linked).groupBy("query_id", "key").agg(F.min("kind").alias("kind")).join(seeds.select("query_id", "key"), ["query_id", "key"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("kind", "key")
    ranked = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.select("query_id", "key", "rank", F.when(F.col("kind") == 0, "pointer").otherwise("signature").alias("relation"))


def follow_pointers(candidates: DataFrame, comments: DataFrame) -> DataFrame:
    """Candidates that only point at another ticket, replaced by that ticket's resolution.

    ``candidates(query_id, key, body, refers_to)`` with refers_to '' where the body is no
    pointer; ``comments(key, body, refers_to)``.  Dropped: targets that don't exist, point
    on themselves, or are candidates of the query already.  Of a target's several comments
    the smallest text counts, whatever the order of rows.
    """
    plain = candidates.where("refers_to = ''").select("query_id", "key", "body", F.lit("").alias("via"))
    target = comments.where("refers_to = ''").select(F.col("key").alias("target"), F.col("body").alias("found"))
    moved = candidates.where("refers_to <> ''").join(target, F.col("refers_to") == F.col("target"))
    moved = moved.groupBy("query_id", F.col("target").alias("key")).agg(F.min("found").alias("body"), F.min("key").alias("via"))
    moved = moved.join(candidates.select("query_id", "key"), ["query_id", "key"], "left_anti")
    return plain.unionByName(moved.select("query_id", "key", "body", "via"))
