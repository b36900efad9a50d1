"""Versions, votes, outcomes, audit chain, caches and evaluation."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import new_column, numbered


def versions(seen: DataFrame, pattern: str, body: str, at: str, key: str) -> DataFrame:
    """One row for each distinct body of a pattern: number by first sight, latest time, status, sources.

    The version with the latest resolution is current (ties to the later number), the
    others are superseded.
    """
    v = seen.groupBy(pattern, body).agg(F.min(F.struct(at, key)).alias("first"), F.max(at).alias("latest_at"), F.array_sort(F.collect_set(key)).alias("source_keys"))
    number = F.row_number().over(Window.partitionBy(pattern).orderBy("first"))
    v = v.withColumn("version_number", number)
    last = F.row_number().over(Window.partitionBy(pattern).orderBy(F.desc("latest_at"), F.desc("version_number")))
    return v.withColumn("status", F.when(last == 1, "current").otherwise("superseded")).drop("first")


def by_source(v: DataFrame, key: str) -> DataFrame:
    """Versions by each of their source keys."""
    return v.select("*", F.explode("source_keys").alias(key))


def tally(votes: DataFrame, *by: str) -> DataFrame:
    up, down = F.count_if(F.col("vote") > 0), F.count_if(F.col("vote") < 0)
    return votes.groupBy(*by).agg(up.alias("up"), down.alias("down"), (up - down).alias("net"), F.countDistinct("voter").alias("voters"))


def first_votes(votes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Insert-or-ignore: the earliest vote of each key counts."""
    return numbered(votes, Window.partitionBy(*key).orderBy(order), lambda n: n == 1)


def outcome_counts(outcomes: DataFrame, *by: str) -> DataFrame:
    return outcomes.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("verified") & (F.col("outcome") == "succeeded")).alias("ok"), F.count_if(F.col("verified") & (F.col("outcome") == "failed")).alias("failed"))


START = "0" * 64


def link_hash(payload: Column, previous: Column) -> Column:
    """An event's hash covers its content and its predecessor's hash."""
    return F.sha2(F.concat(payload, F.lit("|"), previous), 256)


def chained(events: DataFrame, partition: str, order: str, payload: Column) -> DataFrame:
    """Adds previous_hash and event_hash of an audit log; each partition is a chain of its own.

    A link needs its predecessor's hash, so a chain is walked in order: events are sorted
    within their partition and streamed, with one hash kept.  Payloads are text.
    """
    columns = events.columns
    rows = events.withColumn("payload", payload).withColumn("chain", F.col(partition).cast("string"))
    kinds = {f.name: f.dataType for f in events.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c].simpleString()}" for c in columns), "previous_hash string", "event_hash string"])

    def walk(batches):
        chain, last, started = None, START, False
        for b in batches:
            previous, own = [], []
            for body, name in zip(b.column("payload").to_pylist(), b.column("chain").to_pylist()):
                if not started or name != chain:
                    chain, last, started = name, START, True
                previous.append(last)
                last = hashlib.sha256(f"{body or ''}|{last}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(previous, pa.string()), pa.array(own, pa.string())], [*columns, "previous_hash", "event_hash"])

    return rows.repartition("chain").sortWithinPartitions("chain", order).mapInArrow(walk, schema)


def broken_links(log: DataFrame, partition: str, order: str, payload: Column) -> DataFrame:
    """Events whose content doesn't have the stored hash, or whose predecessor isn't the one they name.

    Links are checked side by side: each needs the stored hash before it only.
    """
    before = F.coalesce(F.lag("event_hash").over(Window.partitionBy(partition).orderBy(order)), F.lit(START))
    wrong = ~F.col("previous_hash").eqNullSafe(before) | ~F.col("event_hash").eqNullSafe(link_hash(F.coalesce(payload, F.lit("")), F.col("previous_hash")))
    flag = new_column(log, "bad")
    return log.withColumn(flag, wrong).where(flag).drop(flag)


def audit_report(log: DataFrame, partition: str, order: str, payload: Column) -> DataFrame:
    """Of each chain: events, whether all hold, the first that doesn't, and the newest hash."""
    bad = broken_links(log, partition, order, payload).groupBy(partition).agg(F.min(order).alias("first_bad"))
    heads = log.groupBy(partition).agg(F.count("*").alias("events"), F.max_by("event_hash", order).alias("head_hash"))
    return heads.join(bad, partition, "left").withColumn("ok", F.col("first_bad").isNull())


def fresh(cache: DataFrame, now: Column, cutoff: Column) -> DataFrame:
    return cache.where((F.col("expires_at") > now) & (F.col("created_at") > cutoff))


def evicted(cache: DataFrame, scope: str, keep: int) -> DataFrame:
    """Entries beyond the newest ``keep`` of each scope.

    Only entries up to the ``keep``-th stay, so these are found by a limited window, which
    drops the rest of each task's rows before they move; the others are what isn't among them.
    """
    w = Window.partitionBy(scope).orderBy(F.desc("created_at"), F.desc("id"))
    n = new_column(cache, "row")
    kept = cache.select("id", scope, "created_at").withColumn(n, F.row_number().over(w)).where(F.col(n) <= keep)
    return cache.join(kept.select("id"), "id", "left_anti")


def metrics(returned: DataFrame, expected: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """One row: hit rate, recall and mean reciprocal rank at ``k`` over all cases."""
    hit = returned.where(F.col("rank") <= k).join(expected, ["query_id", "key"])
    g = hit.groupBy("query_id").agg(F.countDistinct("key").alias("found"), F.min("rank").alias("first"))
    n = expected.groupBy("query_id").agg(F.countDistinct("key").alias("wanted"))
    each = cases.select("query_id").join(n, "query_id").join(g, "query_id", "left")
    return each.agg(
        F.count("*").alias("cases"), F.avg(F.when(F.col("found") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.avg(F.coalesce(F.col("found") / F.col("wanted"), F.lit(0.0))).alias("recall"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def nearest_rank(df: DataFrame, value: str, by: str, shares=(0.5, 0.95), buckets: int = 4096) -> DataFrame:
    """Nearest-rank percentiles of each group: the value at place max(1, ceil(n p)); nulls don't count.

    Equal values are counted first.  Counts by equal stretches of a group's range say in which
    stretch a place lies; only its values are put in order, so that no group is sorted
    or held as a whole.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    about = c.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets))).otherwise(0)
    c = c.join(about.withColumnRenamed("g", "group"), F.col("g").eqNullSafe(F.col("group"))).select("group", "v", "n", "total", place.alias("bucket"))
    sizes = c.groupBy("group", "bucket", "total").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.partitionBy("group").orderBy("bucket")) - F.col("size")  # at most ``buckets`` rows a group
    sizes = sizes.withColumn("before", before)
    out = df.select(F.col(by)).distinct()
    for p in shares:
        rank = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(p)))
        own = sizes.where((F.col("before") < rank) & (rank <= F.col("before") + F.col("size"))).select(F.col("group").alias("og"), F.col("bucket").alias("ob"), "before")
        inside = c.join(own, F.col("group").eqNullSafe(F.col("og")) & (F.col("bucket") == F.col("ob")))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("group").orderBy("v"))
        name = f"p{round(100 * p)}"
        one = inside.withColumn("upto", upto).where(F.col("upto") >= rank).groupBy("group").agg(F.min("v").alias(name))
        out = out.join(one, F.col(by).eqNullSafe(F.col("group")), "left").drop("group")
    return out


def leave_one_out(scored: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Self-test: is the best other item of the same label, and is one among the best ``k``.

    ``scored(query_id, key, rank)`` of other items, ``labels(key, label)``.
    """
    q = labels.select(F.col("key").alias("query_id"), F.col("label").alias("want"))
    each = scored.join(labels, "key").join(q, "query_id").groupBy("query_id").agg(
        F.max((F.col("rank") == 1) & (F.col("label") == F.col("want"))).alias("hit1"), F.max((F.col("rank") <= k) & (F.col("label") == F.col("want"))).alias("hitk"))
    return each.agg(F.count("*").alias("cases"), F.avg(F.col("hit1").cast("double")).alias("hit1"), F.avg(F.col("hitk").cast("double")).alias("hitk"), F.avg((~F.col("hit1")).cast("double")).alias("wrong1"))
