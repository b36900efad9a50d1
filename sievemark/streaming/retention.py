"""Retention: entries of a stream that nobody touches for their class' time to live are evicted.

The state of a key is its last touch and class.  An event that comes later than that
touch allows first evicts the entry, at the time it ran out, and starts a new one; a key
without another event is evicted by an event-time timer once the watermark has passed.  So
the evictions of a log don't depend on how it was cut into batches, as long as its events come no
later than the watermark's delay; the last entries are still held until the watermark passes them.

Defined cases: events without a key or time are left out; a class without a time to live
is kept for ever; equal times count as one touch, of the class that is first by name; an event exactly at the end of the
time to live is in time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT, STATE = "key string, class string, touched timestamp, evicted timestamp", "class string, touched bigint"


def evictions(events: DataFrame, key: str, kind: str, at: str, ttl: dict[str, int], delay: str = "1 hour") -> DataFrame:
    """(key, class, touched, evicted) of a stream; ``ttl`` gives seconds by class."""

    def row(group: tuple, held: str, touched: int) -> tuple:
        return (group[0], held, pd.Timestamp(touched, unit="us"), pd.Timestamp(touched + ttl[held] * 1_000_000, unit="us"))

    def advance(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append(row(group, *state.get))
            state.remove()
        else:
            held, touched = state.get if state.exists else (None, None)
            rows = pd.concat(list(batches), ignore_index=True).sort_values(["us", "class"]).drop_duplicates("us")
            for now, us in zip(rows["class"], rows["us"].tolist(), strict=True):
                if touched is not None and us <= touched:
                    continue
                if touched is not None and held in ttl and us > touched + ttl[held] * 1_000_000:
                    out.append(row(group, held, touched))
                held, touched = now, us
            state.update((held, touched))
            if held in ttl:
                ends = (touched + ttl[held] * 1_000_000) // 1000 + 1
                state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "class", "touched", "evicted"])

    e = events.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("class"), F.col(at).cast("timestamp").alias("at")).where("key is not null and at is not null")
    e = e.withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    return e.groupBy("key").applyInPandasWithState(advance, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def evictions_of_log(log: DataFrame, key: str, kind: str, at: str, ttl: dict[str, int], until) -> DataFrame:
    """The same of a whole table at the time ``until``, as one window."""
    from pyspark.sql import Window

    e = log.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("class"), F.col(at).cast("timestamp").alias("touched")).where("key is not null and touched is not null")
    e = e.groupBy("key", "touched").agg(F.min("class").alias("class"))
    live = F.coalesce(*(F.when(F.col("class") == c, F.lit(s)) for c, s in ttl.items()), F.lit(None).cast("int"))
    e = e.withColumn("evicted", F.timestamp_micros(F.unix_micros("touched") + live.cast("long") * 1_000_000)).withColumn("next", F.lead("touched").over(Window.partitionBy("key").orderBy("touched")))
    return e.where("evicted is not null").where(F.coalesce(F.col("next"), F.lit(until)) > F.col("evicted")).select("key", "class", "touched", "evicted")
