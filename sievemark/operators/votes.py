"""Votes and outcomes: idempotent recording, scopes, rejected sources, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text, vote_key
from .windows import numbered

# What an outcome may say and where it may come from.
SOURCES = ["human", "automated", "human_assisted"]
OUTCOMES = ["succeeded", "failed", "partial", "not_applicable", "unknown"]


def vote_scope(step: Column, error: Column) -> Column:
    """The failure that a vote is about: the error, else the step."""
    e = F.trim(text(error))
    return F.when(e != "", e).otherwise(F.trim(text(step)))


def recorded(votes: DataFrame) -> DataFrame:
    """Votes that may be stored: up or down on a named candidate, for a failure that is named."""
    return votes.where(F.col("vote").isin(1, -1) & (F.trim(text(F.col("key"))) != "") & (vote_scope(F.col("step"), F.col("error")) != ""))


def votes_for(candidates: DataFrame, votes: DataFrame) -> DataFrame:
    """Candidates with up, down and net of the votes on the same source, version and normalised failure.

    ``candidates(query_id, key, version_id, step, error)``, ``votes(key, version_id, step,
    error, vote)``; versions are '' where there is none.  Votes are counted before they meet
    the candidates.
    """
    target = lambda: vote_key(F.when(text(F.col("error")) != "", F.col("error")).otherwise(F.col("step")))
    v = votes.select("key", text(F.col("version_id")).alias("version_id"), target().alias("target"), "vote").groupBy("key", "version_id", "target").agg(F.count_if(F.col("vote") > 0).alias("up"), F.count_if(F.col("vote") < 0).alias("down"))
    c = candidates.withColumn("version_id", text(F.col("version_id"))).withColumn("target", target())
    out = c.join(v.where("target <> ''"), ["key", "version_id", "target"], "left").drop("target")
    return out.withColumn("up", F.coalesce("up", F.lit(0))).withColumn("down", F.coalesce("down", F.lit(0))).withColumn("net", F.col("up") - F.col("down"))


def rejected(votes: DataFrame, current: DataFrame) -> DataFrame:
    """(issue_key, key) voted down in the version that is current now; ``current(key, version_id)``."""
    down = votes.where("vote < 0").select("issue_key", "key", text(F.col("version_id")).alias("version_id")).distinct()
    now = current.select("key", F.col("version_id").alias("now"))
    return down.join(now, "key", "left").where(F.col("version_id") == text(F.col("now"))).select("issue_key", "key").distinct()


def without_rejected(candidates: DataFrame, rejections: DataFrame) -> DataFrame:
    return candidates.join(rejections, ["issue_key", "key"], "left_anti")


def vote_history(votes: DataFrame, key: str, scope: str) -> DataFrame:
    """Single votes of a source about a failure, newest first."""
    return votes.where((F.col("key") == key) & (vote_scope(F.col("step"), F.col("error")) == scope)).orderBy(F.desc("created_at"), F.desc("id"))


def valid_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcomes that may be recorded; those not by a person need a reference."""
    known = F.col("source_kind").isin(SOURCES) & F.col("outcome").isin(OUTCOMES) & F.col("verified").isNotNull()
    return outcomes.where(known & ((F.col("source_kind") == "human") | (F.trim(text(F.col("external_reference"))) != "")))


def new_outcomes(outcomes: DataFrame, known: DataFrame, versions: DataFrame) -> DataFrame:
    """Outcomes to add: valid, of a version that exists, each reference of a version and kind once.

    Those without a reference are always new; of equal references the earliest counts, and
    none that is stored already.
    """
    ref = F.substring(F.trim(text(F.col("external_reference"))), 1, 250)
    own = valid_outcomes(outcomes).withColumn("external_reference", ref).join(versions.select("version_id").distinct(), "version_id", "left_semi")
    named = numbered(own.where("external_reference <> ''"), Window.partitionBy("version_id", "source_kind", "external_reference").orderBy("created_at", "id"), lambda n: n == 1)
    stored = known.select("version_id", "source_kind", ref.alias("external_reference")).distinct()
    named = named.join(stored, ["version_id", "source_kind", "external_reference"], "left_anti")
    return own.where("external_reference = ''").unionByName(named.select(*own.columns))


def harvested(publications: DataFrame, reactions: DataFrame, known: DataFrame) -> DataFrame:
    """New votes from reactions on published answers: (issue_key, key, vote, digest), each digest once.

    ``publications(issue_key, comment_id, key)``, ``reactions(comment_id, actor, vote, created_at)``.
    """
    votes = publications.join(reactions, "comment_id").withColumn("digest", F.sha2(F.concat_ws("|", "issue_key", "key", "actor", F.col("vote").cast("string")), 256))
    first = numbered(votes, Window.partitionBy("digest").orderBy("created_at", "comment_id"), lambda n: n == 1)
    return first.join(known.select("digest").distinct(), "digest", "left_anti").select("issue_key", "key", "actor", "vote", "digest")


def feedback_labels(votes: DataFrame) -> DataFrame:
    """(scope, kind, key, good) of each source whose votes about a failure don't cancel out, where one is good."""
    net = votes.select(vote_scope(F.col("step"), F.col("error")).alias("scope"), "kind", F.trim("key").alias("key"), "vote").where("scope <> ''").groupBy("scope", "kind", "key").agg(F.sum("vote").alias("net")).where("net <> 0")
    some = net.where("net > 0").select("scope").distinct()
    return net.join(some, "scope", "left_semi").select("scope", "kind", "key", (F.col("net") > 0).alias("good"))


def scorecard(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """One row over all labelled failures: hits at 1 and 3, mean reciprocal rank, found, and leaks.

    ``ranked(scope, kind, key, position)``.  A leak is a failure of which a source that was
    voted down stands before all that were voted up.
    """
    hit = labels.join(ranked, ["scope", "kind", "key"], "left").groupBy("scope").agg(F.min(F.when(F.col("good"), F.col("position"))).alias("up"), F.min(F.when(~F.col("good"), F.col("position"))).alias("down"))
    mean = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return hit.agg(
        F.count("*").alias("failures"), mean(F.col("up") == 1).alias("hit1"), mean(F.col("up") <= 3).alias("hit3"), F.avg(F.coalesce(1.0 / F.col("up"), F.lit(0.0))).alias("mrr"),
        mean(F.col("up").isNotNull()).alias("found"), mean(F.col("down").isNotNull() & (F.col("up").isNull() | (F.col("down") < F.col("up")))).alias("leak"),
    )


def kept_runs(runs: DataFrame, order: str, keep: int = 200) -> DataFrame:
    """The last ``keep`` runs of a history, oldest first."""
    return runs.orderBy(F.desc(order)).limit(keep).orderBy(order)


def scorecard_status(runs: DataFrame, order: str, recent: int = 30) -> DataFrame:
    """The last runs, newest first, with the latest marked."""
    last = runs.orderBy(F.desc(order)).limit(recent)
    return last.withColumn("latest", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(order))) == 1)  # at most ``recent`` rows
