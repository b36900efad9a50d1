"""A ledger of what was published, for batches that may be repeated.

A batch is folded to one row a target.  Rows whose body the target has already are left
out; the others are written to an outbox under a new version, with the new state of the
buckets that they touch, and a commit that names both and the batch comes last.  A batch that
was committed does nothing when it is repeated; one that died before its commit left files
that no commit names, and is done again as a whole.  So no body is in the outbox twice in a row for a target,
whatever is repeated or interrupted.

Defined cases: rows without a target or a body are left out; of several rows of a batch for one target that with the
largest order counts; ``hold`` rows (tier low) are never published; an empty batch is committed and
publishes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.decisions import publish as decision
from ..sources import commits

BUCKETS = 32


def _read(spark: SparkSession, path: str, table: str, state: dict, only: list[int] | None = None) -> DataFrame | None:
    folders = [f"{path}/{table}/version={v}/bucket={b}" for b, v in state[table].items() if only is None or int(b) in only]
    return spark.read.option("basePath", f"{path}/{table}").parquet(*folders).drop("version") if folders else None


def publish_batch(batch: DataFrame, number: int, path: str, key: str, body: str, order: str, tier: str | None = None, buckets: int = BUCKETS) -> None:
    """One batch of a stream, or of a table with a number of its own."""
    spark = batch.sparkSession
    state = commits.committed(spark, path) or {"version": 0, "batch": -1, "bodies": {}, "outbox": {}}
    if number <= state["batch"]:
        return
    used = [int(n.split("=")[1]) for t in ("bodies", "outbox") for n in commits.names(spark, f"{path}/{t}") if n.startswith("version=")]
    version = max([state["version"], *used]) + 1
    level = F.lit("high") if tier is None else F.coalesce(F.col(tier), F.lit("low"))
    rows = batch.select(F.col(key).alias("key"), F.col(body).cast("string").alias("body"), F.col(order).alias("at"), level.alias("tier")).where("key is not null and body is not null")
    now = rows.groupBy("key").agg(F.max(F.struct("at", "body", "tier")).alias("r")).select("key", "r.body", "r.at", "r.tier")
    now = now.withColumn("hash", F.sha2("body", 256)).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    touched = sorted(r.bucket for r in now.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    had = _read(spark, path, "bodies", state, touched)
    had = spark.createDataFrame([], now.select("key", F.col("hash").alias("had"), "bucket").schema) if had is None else had
    judged = now.join(had.select("key", "had"), "key", "left").withColumn("action", decision(F.col("hash"), F.col("had"), F.col("tier")))
    sent = judged.where(F.col("action").isin("create", "update"))
    sent.select("key", "body", "hash", "action", F.lit(number).cast("long").alias("batch"), F.lit(version).alias("version"), "bucket").write.mode("append").partitionBy("version", "bucket").parquet(f"{path}/outbox")
    bodies = had.join(sent.select("key"), "key", "left_anti").select("key", "had", "bucket").unionByName(sent.select("key", F.col("hash").alias("had"), "bucket"))
    bodies.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", "bucket").parquet(f"{path}/bodies")
    found = {t: [n.split("=")[1] for n in commits.names(spark, f"{path}/{t}/version={version}") if n.startswith("bucket=")] for t in ("bodies", "outbox")}
    state["bodies"] |= dict.fromkeys(found["bodies"], version)
    if found["outbox"]:
        state["outbox"][str(version)] = version
    state.pop("version")
    commits.commit(spark, path, version, state | {"batch": number})
    commits.tidy(spark, path)


def publish(decisions: DataFrame, path: str, checkpoint: str, key: str, body: str, order: str, tier: str | None = None) -> StreamingQuery:
    """A stream of decisions into the ledger."""
    return decisions.writeStream.foreachBatch(lambda b, n: publish_batch(b, n, path, key, body, order, tier)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outbox(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, body, hash, action, batch) of everything that was published."""
    state = commits.committed(spark, path)
    folders = [f"{path}/outbox/version={v}" for v in (state or {"outbox": {}})["outbox"].values()]
    return spark.read.option("basePath", f"{path}/outbox").parquet(*folders).drop("version", "bucket") if folders else None
