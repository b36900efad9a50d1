"""The library of resolution versions: recording, detaching evidence, current versions, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized, text


def pattern_key(reason: Column, step: Column, error: Column) -> Column:
    """Key of a failure pattern: normalised reason, step and error."""
    return F.sha2(F.concat_ws("|", normalized(reason), normalized(step), normalized(error)), 256)


def recordable(items: DataFrame, least: int = 20) -> DataFrame:
    """Items that make a version: a body of ``least`` characters, a step and an error."""
    body = F.trim(F.regexp_replace(text(F.col("body")), r"\s+", " "))
    tidy = items.withColumn("body", body).withColumn("step", F.trim(text(F.col("step")))).withColumn("error", F.trim(text(F.col("error")))).withColumn("order_reason", F.trim(text(F.col("order_reason"))))
    return tidy.where((F.length("body") >= least) & (F.col("step") != "") & (F.col("error") != ""))


def record_versions(items: DataFrame) -> DataFrame:
    """Versions of (source_key, order_reason, step, error, body, release, resolution_at).

    Bodies of a pattern that are equal as words are one version.  Versions are numbered by
    first sight; the one resolved last is current, and of equal times the one seen later.
    """
    i = recordable(items).withColumn("pattern_key", pattern_key(F.col("order_reason"), F.col("step"), F.col("error"))).withColumn("body_hash", F.sha2(normalized(F.col("body")), 256))
    v = i.groupBy("pattern_key", "body_hash").agg(
        F.min(F.struct("resolution_at", "source_key", "body")).alias("first"), F.max("resolution_at").alias("latest_resolution_at"),
        F.array_sort(F.collect_set("source_key")).alias("source_keys"), F.array_sort(F.collect_set(F.nullif(F.trim(text(F.col("release"))), F.lit("")))).alias("releases"))
    number = F.row_number().over(Window.partitionBy("pattern_key").orderBy("first"))
    v = v.withColumn("version_number", number).withColumn("body", F.col("first.body")).drop("first")
    return with_current(v)


def with_current(versions: DataFrame) -> DataFrame:
    """Status of each version: of those with evidence the latest is current (ties to the later number), others superseded."""
    backed = F.size("source_keys") > 0
    last = F.row_number().over(Window.partitionBy("pattern_key").orderBy(F.desc(backed), F.desc("latest_resolution_at"), F.desc("version_number")))
    return versions.withColumn("status", F.when(backed & (last == 1), "current").otherwise("superseded"))


def detach(versions: DataFrame, removed: DataFrame, used: DataFrame) -> DataFrame:
    """Versions after evidence went: ``removed(source_key)`` leaves all versions, statuses are made anew.

    A version without evidence goes, unless votes or outcomes (``used(pattern_key,
    version_number)``) speak of it; then it stays without sources, superseded.
    """
    one = versions.select("pattern_key", "version_number", F.explode("source_keys").alias("source_key"))
    left = one.join(removed.select("source_key").distinct(), "source_key", "left_anti").groupBy("pattern_key", "version_number").agg(F.array_sort(F.collect_set("source_key")).alias("source_keys"))
    v = versions.drop("source_keys", "status").join(left, ["pattern_key", "version_number"], "left").withColumn("source_keys", F.coalesce("source_keys", F.array().cast("array<string>")))
    keep = used.select("pattern_key", "version_number", F.lit(True).alias("used")).distinct()
    v = v.join(keep, ["pattern_key", "version_number"], "left").where((F.size("source_keys") > 0) | F.col("used"))
    return with_current(v.drop("used"))


def next_numbers(versions: DataFrame) -> DataFrame:
    """(pattern_key, next_number, newest) of each pattern."""
    return versions.groupBy("pattern_key").agg((F.max("version_number") + 1).alias("next_number"), F.max("latest_resolution_at").alias("newest"))


def with_patterns(versions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Versions with the failure that their pattern stands for."""
    return versions.join(patterns, "pattern_key")


def search_library(joined: DataFrame, words: str = "", source_key: str = "") -> DataFrame:
    """Versions whose reason, step or error holds ``words`` in any case, and of a pattern that has the exact source key."""
    out = joined
    if words:
        low = words.lower()
        out = out.where(F.contains(F.lower("order_reason"), F.lit(low)) | F.contains(F.lower("failed_step"), F.lit(low)) | F.contains(F.lower("error_description"), F.lit(low)))
    if source_key:
        out = out.join(joined.where(F.array_contains("source_keys", source_key)).select("pattern_key").distinct(), "pattern_key", "left_semi")
    return out
