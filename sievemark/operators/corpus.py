"""Corpus tables: joins with quality, counts, change sets and guarded pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import numbered

TIERS = ("high", "medium", "low")


def with_tier(docs: DataFrame, quality: DataFrame, key: str) -> DataFrame:
    """Left join; a document without a row counts as low."""
    return docs.join(quality.select(key, "tier"), key, "left").withColumn("tier", F.coalesce("tier", F.lit("low")))


def tier_counts(rated: DataFrame) -> DataFrame:
    """Rows of each tier, zero where there is none."""
    spark = rated.sparkSession
    dim = spark.createDataFrame([(t,) for t in TIERS], "tier string")
    counted = rated.groupBy("tier").agg(F.count("*").alias("n"))
    return dim.join(counted, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ingestion_counts(rated: DataFrame) -> DataFrame:
    """One row: stored, searchable (high and medium) and excluded (low)."""
    is_low = F.col("tier") == "low"
    return rated.agg(F.count("*").alias("stored"), F.count_if(~is_low).alias("searchable"), F.count_if(is_low).alias("excluded"))


def usable(rated: DataFrame) -> DataFrame:
    return rated.where(F.col("tier") != "low")


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def change_set(new: DataFrame, old: DataFrame, key: str, *content: str) -> DataFrame:
    """(key, change) of a full refresh: insert, update, same or missing.

    ``content`` (``content_hash`` by default) are the columns that make a row the same:
    hash, tier and reasons, version of the policy or of the vectors.
    """
    content = content or ("content_hash",)
    n = new.select(key, F.struct(*content).alias("new_hash"), F.lit(True).alias("in_new"))
    o = old.select(key, F.struct(*content).alias("old_hash"), F.lit(True).alias("in_old"))
    change = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "missing").when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "same").otherwise("update")
    return n.join(o, key, "full_outer").select(key, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` rows, and the ``old`` ones they don't replace."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def prune(old: DataFrame, seen: DataFrame, key: str, allow_mass: bool = False) -> DataFrame:
    """Rows of ``old`` that were seen again.

    Fails before anything is dropped if nothing was seen, or if more than a tenth (and
    more than ten) would go, unless ``allow_mass``.
    """
    kept = old.join(seen.select(key).distinct(), key, "left_semi")
    if not allow_mass:
        n, left, found = old.count(), kept.count(), not seen.isEmpty()
        if n > left and (not found or n - left > max(10, n // 10)):
            raise ValueError(f"{n - left} of {n} documents would be pruned")
    return kept


def exact_duplicates(docs: DataFrame, key: str, body: Column) -> DataFrame:
    """(content_hash, n, first_key) of contents that occur more than once."""
    return docs.groupBy(F.sha2(F.coalesce(body, F.lit("")), 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")


def first_of(frames: list[DataFrame], key: str) -> DataFrame:
    """Union in which the earliest frame wins a key."""
    columns = list(dict.fromkeys(c for f in frames for c in f.columns))
    origin, every = "origin", None
    while origin.lower() in {c.lower() for c in columns}:
        origin += "_"
    for i, f in enumerate(frames):
        f = f.withColumn(origin, F.lit(i))
        every = f if every is None else every.unionByName(f, allowMissingColumns=True)
    return numbered(every, Window.partitionBy(key).orderBy(origin), lambda n: n == 1).select(*columns)


def listing(rated: DataFrame, key: str, limit: int, offset: int) -> DataFrame:
    """A page in tier order, then by key."""
    order = F.when(F.col("tier") == "high", 0).when(F.col("tier") == "medium", 1).otherwise(2)
    return rated.orderBy(order, key).offset(offset).limit(limit)


def hydrate(candidates: DataFrame, *tables: tuple[DataFrame, str]) -> DataFrame:
    """Left joins of candidates with lookup tables on their keys, for a whole batch at once."""
    for t, key in tables:
        candidates = candidates.join(t, key, "left")
    return candidates
