"""Incremental work as Structured Streaming: scans, votes and change capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_seen(changes: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """Insert-or-ignore over a stream: one row of each key within the watermark."""
    return changes.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def counts(events: DataFrame, at: str, by: str, size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts by window of event time; a window is final once the watermark has passed it."""
    return events.withWatermark(at, delay).groupBy(F.window(at, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


BUCKETS = 64


def scan(changes: DataFrame, path: str, checkpoint: str, key: str, content: list[str], order: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps a table of the newest state of each key under ``path``.

    Each batch is folded to one row a key, the one with the largest ``order``.  A row that
    is older than the stored one, or says the same, changes nothing.  The state is kept by
    buckets of the key: a batch reads and rewrites those that it touches, under its own
    number, and what the batch before last left is removed.  A repeated batch reads the
    state before its number and writes the same again.
    """
    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        last = batch.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(order, *content)).alias("r")).select("r.*")
        last = last.withColumn("content_hash", F.sha2(F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content)), 256)).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        now = last
        if files.exists(folder):
            old = current(spark, path, number)
            touched = old.join(F.broadcast(last.select("bucket").distinct()), "bucket", "left_semi")  # at most ``buckets`` rows
            both = touched.unionByName(last)
            newest = F.max_by(F.struct("*"), F.struct(order, *content))
            now = both.groupBy(key).agg(newest.alias("r")).select("r.*")
        now.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path)
        stale(spark, path, number - 1)

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Batches that wrote each bucket, from the folders' names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/bucket=*")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    out: dict[int, list[int]] = {}
    for f in found or []:
        batch, bucket = (int(x.split("=")[1]) for x in str(f.getPath().toString()).rsplit("/", 2)[1:])
        out.setdefault(bucket, []).append(batch)
    return out


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The state: of each bucket the newest version, of batches before ``before`` only if given."""
    newest = [(max(x), bucket) for bucket, batches in versions(spark, path).items() if (x := [n for n in batches if before is None or n < before])]
    table = spark.read.parquet(path)
    pick = F.lit(False)
    for batch, own in _by_batch(newest).items():
        pick = pick | ((F.col("batch") == batch) & F.col("bucket").isin(own))
    return table.where(pick).drop("batch")


def _by_batch(pairs: list[tuple[int, int]]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for batch, bucket in pairs:
        out.setdefault(batch, []).append(bucket)
    return out


def stale(spark: SparkSession, path: str, before: int) -> None:
    """Removes versions of buckets that a batch up to ``before`` has replaced."""
    for bucket, batches in versions(spark, path).items():
        done = [n for n in batches if n <= before]
        for n in sorted(done)[:-1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}/bucket={bucket}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each key of the table that ``scan`` keeps."""
    return current(spark, path).drop("bucket")
