"""Decisions on drafts and packages: support, agreement, demotion, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.procedures import clauses, is_supported, is_told, lexemes, squeezed, told
from ..functions.text import let, text


def draft_reasons(steps: DataFrame, sources: DataFrame, ready: bool = False) -> DataFrame:
    """(draft_id, reason, source_key, skipped): each draft's first fault, '' and nulls where there is none.

    ``steps(draft_id, pos, source_key, action, quote)`` has a row for each source that a step
    cites, in the order of ``cite`` where there is such a column; ``sources(draft_id,
    source_key, evidence)`` are those selected.  Going through the steps, the first of these
    counts: ``outside``, a source that wasn't selected (or no source); ``changed``, a quote of
    more than 500 characters or that isn't in the evidence, or an action that quote or
    evidence don't support; ``reordered``, an action that the source has before one already
    drafted.  A draft without them that leaves out an action which its source has before a
    drafted one is ``skipped``, and ``skipped`` lists the clauses left out.  Clauses are equal
    if their normalised words are, so a repeated clause counts at all its places.  Null
    evidence supports nothing; of repeated sources the smallest text counts.  Drafts without
    steps give no row.

    Texts that many drafts share may come ``ready``, with what ``told`` gives of them, so
    that it is worked out once: ``doing`` of the action and ``quoted`` of the quote in
    ``steps``, ``told`` of the evidence in ``sources``.
    """
    key = ["draft_id", "source_key"]
    seen = lambda name, c: (F.col(name) if ready else told(F.col(c))).alias(name)
    one = F.struct(F.col("evidence").isNull().alias("none"), F.coalesce("evidence", F.lit("")).alias("evidence"), *(["told"] if ready else []))
    known = sources.groupBy(*key).agg(F.min(one).alias("one")).select(*key, "one.*")
    known = known.select(*key, seen("told", "evidence"), squeezed(F.col("evidence")).alias("shown"))
    s = steps.select(*key, "pos", (F.col("cite") if "cite" in steps.columns else F.lit(0)).alias("cite"), "quote", seen("doing", "action"), seen("quoted", "quote"))
    # what needs no source is known before they meet
    s = s.withColumn("quote", F.when(F.length("quote") <= 500, squeezed(text(F.col("quote")))))
    s = s.select(*key, "pos", "cite", "quote", "doing", ((F.length("quote") >= 12) & is_told(F.col("doing"), F.col("quoted"))).alias("sure")).join(known, key, "left")
    sound = F.col("sure") & F.contains("shown", F.col("quote")) & is_told(F.col("doing"), F.col("told"))
    s = s.withColumn("fault", F.when(F.col("told").isNull(), "outside").when(F.coalesce(sound, F.lit(False)), "").otherwise("changed"))
    places = F.filter(F.transform("told.said", lambda x, i: F.when(F.array_contains("doing.said", x), i)), lambda x: x.isNotNull())
    s = s.select(*key, "pos", "cite", "fault", F.explode_outer(F.when(F.col("fault") == "", places)).alias("place"))
    before = F.max("place").over(Window.partitionBy(*key).orderBy("pos").rangeBetween(Window.unboundedPreceding, -1))
    at = lambda order, name: F.struct("pos", F.lit(order).alias("order"), "cite", "source_key", name.alias("reason"))
    s = s.withColumn("fault", F.when(F.col("fault") != "", at(0, F.col("fault"))).when(F.col("place") < before, at(1, F.lit("reordered"))))
    used = s.groupBy(*key).agg(F.min("fault").alias("fault"), F.collect_set("place").alias("used"), F.min(F.struct("pos", "cite")).alias("since"))
    evidence = sources.groupBy(*key).agg(F.min("evidence").alias("evidence"))
    left_out = F.filter(F.transform(clauses(F.col("evidence")), lambda x, i: F.when((i < F.array_max("used")) & ~F.array_contains("used", i), x)), lambda x: x.isNotNull())
    used = used.join(evidence, key, "left").withColumn("skipped", left_out)
    gap = F.min(F.when(F.size("skipped") > 0, F.struct("since", "source_key", "skipped")))
    out = used.groupBy("draft_id").agg(F.min("fault").alias("fault"), gap.alias("gap"))
    sole = F.when(F.col("fault").isNull(), F.col("gap"))
    return out.select("draft_id", F.coalesce(F.col("fault.reason"), F.when(F.col("gap").isNotNull(), "skipped"), F.lit("")).alias("reason"),
                      F.coalesce(F.col("fault.source_key"), sole["source_key"]).alias("source_key"), sole["skipped"].alias("skipped"))


def agreement(a: Column, b: Column, same_source: Column) -> Column:
    """How two drafts, as arrays of normalised steps, relate."""
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), "single_branch").when((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0) & same_source, "same_ticket_both_paths")
        .when((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0), "independent_sources_agree").otherwise("different_procedures")
    )


def gated(tier: Column, declined: Column, reasons: Column, branches: Column, review_ok: Column) -> Column:
    """Tier after the gate: what is wrong with a draft demotes it."""
    return F.when(declined | (F.size(reasons) > 0), "low").when((branches == "different_procedures") | ~review_ok, F.when(tier == "high", "medium").otherwise(tier)).otherwise(tier)


def package_status(local: Column, remote: Column) -> Column:
    return F.when((local == "ready") & (remote == "ready"), "ready").when((local == "ready") | (remote == "ready"), "partial").otherwise("failed")


def next_stage(candidates: Column, status: Column, rule: Column) -> Column:
    return F.when(rule, "publish").when(candidates == 0, "remote").when(status == "sufficient", "draft").otherwise("review")


def publish(body_hash: Column, published_hash: Column, tier: Column) -> Column:
    """Create, update, or nothing for a comment whose text was posted before."""
    return F.when(tier == "low", "hold").when(published_hash.isNull(), "create").when(published_hash == body_hash, "unchanged").otherwise("update")


def with_kept_sources(original: DataFrame, revised: DataFrame) -> DataFrame:
    """Revised steps (draft_id, pos, source_key, text, sources) with the sources that the same step had before."""
    same = lambda c: F.transform(clauses(F.col(c)), lambda x: F.array_join(lexemes(x), " "))
    before = original.select("draft_id", "source_key", same("text").alias("said"), F.col("sources").alias("had")).groupBy("draft_id", "source_key", "said").agg(F.flatten(F.collect_list("had")).alias("had"))
    out = revised.withColumn("said", same("text")).join(before, ["draft_id", "source_key", "said"], "left")
    every = F.array_distinct(F.concat("sources", F.coalesce("had", F.array().cast("array<string>"))))
    return out.select("draft_id", "pos", "source_key", "text", every.alias("sources"))


def proposal_quality(rule_kept: Column, candidates: Column, declined: Column, steps: Column, fault: Column, cited: Column, first: Column, most: int = 5) -> Column:
    """Struct (tier, reason) of a proposal.

    ``rule_kept``: null without a rule, else whether its action is kept word for word;
    ``fault``: what is wrong with the draft, '' for nothing; ``cited``: tiers of all cited
    sources; ``first``: tier of the best candidate.
    """
    say = lambda tier, why: F.struct((F.lit(tier) if isinstance(tier, str) else tier).alias("tier"), F.lit(why).alias("reason"))
    worst = F.get(F.filter(cited, lambda t: t != "high"), F.lit(0))
    return (
        F.when(rule_kept, say("high", "rule kept")).when(rule_kept.isNotNull(), say("medium", "rule changed")).when(candidates == 0, say("low", "no candidates"))
        .when(declined | (steps == 0), say(F.when(first == "high", "medium").otherwise(first), "no steps")).when(steps > most, say("medium", "too many steps"))
        .when(fault != "", say("medium", "unfaithful")).when(worst.isNotNull(), say(worst, "cited source")).otherwise(say("high", "supported"))
    )


def review_lead(candidates: DataFrame, least: int = 12, most: int = 500) -> DataFrame:
    """Per query the first candidate whose whole evidence can be shown and supports itself; null where sources conflict or none can.

    ``candidates(query_id, position, key, applicable, tier, evidence, conflicting)``.
    """
    fits = F.col("applicable") & F.col("tier").isin("high", "medium") & F.length("evidence").between(least, most) & is_supported(F.col("evidence"), F.col("evidence")) & ~F.col("conflicting")
    lead = F.min(F.when(fits, F.struct("position", "key", "evidence"))).alias("lead")
    out = candidates.groupBy("query_id").agg(lead)
    return out.select("query_id", F.col("lead.key").alias("key"), F.col("lead.evidence").alias("text"), F.col("lead").isNull().alias("decline"))


def allowed_citations(cited: DataFrame, known: DataFrame, resolvable: DataFrame, excluded: DataFrame, pattern: str, most: int = 5) -> DataFrame:
    """(query_id, added, allowed): whether all sources that a draft cites are known or can be looked up, none is excluded, and few are new."""
    c = cited.select("query_id", "key").distinct()
    c = c.join(known.select("query_id", "key", F.lit(True).alias("known")).distinct(), ["query_id", "key"], "left").join(resolvable.select("key", F.lit(True).alias("found")).distinct(), "key", "left")
    c = c.join(excluded.select("query_id", "key", F.lit(True).alias("out")).distinct(), ["query_id", "key"], "left")
    new = F.col("known").isNull()
    bad = F.col("out").isNotNull() | (new & (~F.regexp_like("key", F.lit(pattern)) | F.col("found").isNull()))
    return c.groupBy("query_id").agg(F.count_if(new).alias("added"), (~F.coalesce(F.bool_or(bad), F.lit(False)) & (F.count_if(new) <= most)).alias("allowed"))


def verbatim_fix(body: Column, solution: Column, least: int = 20, most: int = 500) -> Column:
    """The solution of a marked fix block if it can be used word for word, else null: then a model drafts."""
    marked = F.contains(F.lower(body), F.lit("=== fix ==="))
    return F.when(marked & F.length(solution).between(least, most), solution)


def synthesis_status(body: Column, fingerprint: Column, cached: Column, idle: Column, most: int = 12_000) -> Column:
    """What to do about a rewrite: take the cached one, say that nothing acts, that it is too long, or prepare it."""
    return F.when(cached == fingerprint, "cached").when((F.trim(body) == "") | idle, "no_action").when(F.length(F.trim(body)) > most, "unavailable").otherwise("prepare")


def matched(mode: Column, best: Column, declined: Column, no_fix: Column, threshold: float = 0.7) -> Column:
    """Whether an answer may be suggested: an approved rule always, a strong match unless it is no fix."""
    return (mode == "approved_rule") | ((mode == "strong_match") & (F.coalesce(best, F.lit(0.0)) >= threshold) & ~F.coalesce(declined, F.lit(False)) & ~no_fix)


def failure_status(error: Column) -> Column:
    """timeout, unavailable or error, by the name of what went wrong."""
    low = F.lower(error)
    return F.when(F.contains(low, F.lit("timeout")), "timeout").when(F.regexp_like(low, F.lit("unavailable|busy|connect")), "unavailable").otherwise("error")


def reduced_stream(events: DataFrame, by: str = "request_id") -> DataFrame:
    """Final text of each token stream, from events (by, seq, kind, artifact_id, text, append, last_chunk, state).

    Chunks of an artifact are joined, a text without a chunk flag replaces what was there;
    artifacts follow each other in the order of their first event.  Only completed streams
    with a letter or digit give a text.
    """
    e = events.where("kind = 'artifact-update'").withColumn("chunk", F.coalesce("append", F.lit(False)) | F.coalesce(~F.col("last_chunk"), F.lit(False)))
    whole = Window.partitionBy(by, "artifact_id").orderBy("seq")
    e = e.withColumn("part", F.sum((~F.col("chunk")).cast("int")).over(whole)).withColumn("last", F.max("part").over(Window.partitionBy(by, "artifact_id"))).withColumn("begin", F.min("seq").over(Window.partitionBy(by, "artifact_id")))
    parts = e.where("part = last").groupBy(by, "artifact_id", "begin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))  # one answer's artifact
    joined = parts.where("text <> ''").groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "text"))), lambda x: x["text"]), "\n\n").alias("artifacts"))
    said = events.groupBy(by).agg(F.max_by(F.when(F.col("kind") == "message", F.col("text")), F.when(F.col("kind") == "message", F.col("seq"))).alias("message"), F.max_by("state", F.when(F.col("state").isNotNull(), F.col("seq"))).alias("state"), F.bool_or(F.col("kind") == "message").alias("answered"))
    text = F.coalesce("artifacts", "message")
    done = (F.col("answered") | (F.col("state") == "completed")) & F.regexp_like(text, F.lit(r"[\p{L}\p{N}]"))
    return said.join(joined, by, "left").select(by, F.when(F.coalesce(done, F.lit(False)), F.substring(text, 1, 40_000)).alias("text"), F.coalesce("state", F.when(F.col("answered"), "completed")).alias("state"))
