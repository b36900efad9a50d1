"""Small keyed tables: state, settings, records, queues, runs and audit payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text
from .windows import numbered


def upserted(table: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key; a row of ``new`` that isn't newer than the stored one changes nothing."""
    both = table.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)), allowMissingColumns=True)
    return numbered(both, Window.partitionBy(*key).orderBy(F.desc(order), "is_new"), lambda n: n == 1).drop("is_new")


def changed_notes(notes: DataFrame, stored: DataFrame, most: int = 4000) -> DataFrame:
    """Notes that differ from the stored ones, cut to ``most`` characters."""
    cut = notes.select("id", F.substring("note", 1, most).alias("note"))
    return cut.join(stored.select("id", F.col("note").alias("was")), "id").where(~F.col("note").eqNullSafe(F.col("was"))).drop("was")


def settings(rows: DataFrame, defaults: dict[str, tuple[float, float, float]]) -> DataFrame:
    """(key, value, valid) of every setting, stored or default; a stored value must lie within its bounds."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(k, float(d), float(lo), float(hi)) for k, (d, lo, hi) in defaults.items()], "key string, fallback double, low double, high double")
    both = F.broadcast(known).join(rows.select("key", F.get_json_object("value", "$").try_cast("double").alias("stored"), F.lit(True).alias("set")), "key", "left")
    fits = F.coalesce(F.col("stored").between(F.col("low"), F.col("high")), F.lit(False))
    return both.select("key", F.when(fits, F.col("stored")).otherwise(F.col("fallback")).alias("value"), (F.col("set").isNull() | fits).alias("valid"))


def latest_event(log: DataFrame, action: str, payload: str, by: list[str] | None = None) -> DataFrame:
    """Of the newest event with an action its time and payload (a struct read from JSON), for each of ``by``."""
    rows = log.where(F.col("action") == action)
    last = F.max_by(F.struct("id", "created_at", "data"), "id").alias("e")
    one = rows.groupBy(*by).agg(last) if by else rows.agg(last).where("e is not null")
    return one.select(*(by or []), F.col("e.id").alias("id"), F.col("e.created_at").alias("created_at"), F.from_json("e.data", payload).alias("data"))


# States of suggestions and rules, and the states that each may go to.
SUGGESTION_STEPS = {"pending": ["approved", "rejected"]}
RULE_STEPS = {"draft": ["approved", "deprecated"], "approved": ["deprecated"], "deprecated": ["approved"]}


def moved(table: DataFrame, changes: DataFrame, steps: dict[str, list[str]], key: str = "id") -> DataFrame:
    """A table with a status after changes (key, status); a step that the table of steps doesn't have is left out."""
    allowed = F.create_map(*(x for k, v in steps.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    both = table.join(changes.select(key, F.col("status").alias("wanted")), key, "left")
    ok = F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("status")), F.col("wanted")), F.lit(False))
    return both.withColumn("status", F.when(ok, F.col("wanted")).otherwise(F.col("status"))).drop("wanted")


def with_status(table: DataFrame, status: str, order: str = "created_at") -> DataFrame:
    """Rows of a status, newest first."""
    return table.where(F.col("status") == status).orderBy(F.desc(order), F.desc("id"))


def run_counts(runs: DataFrame, *by: str) -> DataFrame:
    """Counters of scan or ingest runs: checked, new, changed, same, failed."""
    kinds = {"new": "insert", "changed": "update", "same": "same", "removed": "missing", "failed": "error"}
    return runs.groupBy(*by).agg(F.count("*").alias("checked"), *(F.count_if(F.col("change") == v).alias(k) for k, v in kinds.items()))


def due(issues: DataFrame, state: DataFrame, key: str, updated: str, context: Column) -> DataFrame:
    """Issues to look at: not seen, or seen with another time or in another context (settings, versions, policy, newest rejection)."""
    now = issues.withColumn("context_hash", F.sha2(text(context), 256))
    was = state.select(key, F.col(updated).alias("was"), F.col("context_hash").alias("was_context"))
    both = now.join(was, key, "left")
    return both.where(~(F.col(updated).eqNullSafe(F.col("was")) & F.col("context_hash").eqNullSafe(F.col("was_context")))).drop("was", "was_context")


def in_window(issues: DataFrame, updated: str, now: Column, minutes: int) -> DataFrame:
    """Issues updated within the last minutes; a plain comparison, so that a source can take it over."""
    return issues.where(F.col(updated) >= now - F.make_interval(mins=F.lit(minutes)))


def previews(records: DataFrame, day: Column, statuses: list[str]) -> DataFrame:
    """Records of a day with one of the statuses, newest first."""
    return records.where((F.to_date("updated") == day) & F.col("status").isin(statuses)).orderBy(F.desc("updated"), F.desc("id"))
