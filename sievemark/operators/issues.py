"""Issues and their comments: pages, selection of the resolution, own comments, keys in answers, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.issues import issue_query, resolution_context
from ..functions.text import is_generated, let, resolution_text, text
from .quality import source_quality

# What an issue key looks like, and kinds of records that hold none.
ISSUE_KEY = r"^[A-Z][A-Z0-9_]{1,29}-[1-9][0-9]{0,9}$"
LINKED_KEY = r"/browse/([A-Z][A-Z0-9_]{1,29}-[1-9][0-9]{0,9})\b"
TIERS = {"high": 2, "medium": 1, "low": 0}


def all_comments(inline: DataFrame, pages: DataFrame, key: str = "key") -> DataFrame:
    """(key, comments) of every issue: those that came with it, or all pages of them if it has more.

    ``inline(key, total, comments)``, ``pages(key, start, comments)``.
    """
    more = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "comments"))).alias("pages"))  # the comments of one issue
    both = inline.join(more, key, "left")
    paged = F.flatten(F.transform("pages", lambda p: p["comments"]))
    whole = F.coalesce(F.col("total") <= F.size("comments"), F.lit(False)) | F.col("pages").isNull()
    return both.select(key, F.when(whole, F.col("comments")).otherwise(paged).alias("comments"))


def resolution_choice(comments: Column, status: Column, resolved: Column, assignee: Column, step: Column, error: Column, markers: tuple[str, ...] = (), longest: int = 12_000, days: int = 14) -> Column:
    """Struct of the comment that holds an issue's resolution, its tier, reasons and why it was chosen.

    ``comments``: structs (id, body, created, updated, author).  Generated and very long
    comments and those changed long after the issue was resolved don't count.  Quality
    comes first, then time, the assignee, a labelled field, and the id.
    """
    def rated(c):
        body = F.trim(text(c["body"]))
        at = F.coalesce(c["updated"], c["created"])
        late = F.coalesce(at > resolved + F.make_interval(days=F.lit(days)), F.lit(False))
        usable = ~is_generated(body, *markers) & ~late & (F.length(body) <= longest)
        return F.when(usable, let(F.struct(source_quality(body, step, error, markers=markers).alias("q"), resolution_text(body).alias("solution")), lambda x: F.struct(
            F.element_at(F.create_map(*(F.lit(v) for pair in TIERS.items() for v in pair)), x["q"]["tier"]).alias("rank"), F.coalesce(at, F.timestamp_seconds(F.lit(-62135596800))).alias("at"),
            F.coalesce((assignee != "") & (c["author"] == assignee), F.lit(False)).cast("int").alias("own"), (x["solution"] != body).cast("int").alias("structured"), text(c["id"].cast("string")).alias("id"),
            body.alias("body"), x["solution"].alias("solution"), x["q"]["tier"].alias("tier"), x["q"]["reasons"].alias("reasons"))))

    def best(choices):
        x = F.array_max(choices)
        why = F.when((x["own"] == 1) & (x["structured"] == 0), "assignee_authored_fallback").when(x["structured"] == 1, "structured_resolution").when(x["tier"] != "low", "comment_body_fallback").otherwise("low_quality_comment")
        found = F.struct(x["id"].alias("comment_id"), x["body"].alias("body"), x["solution"].alias("solution"), x["tier"].alias("tier"), x["reasons"].alias("reasons"), x["at"].alias("resolution_at"), why.alias("selection"))
        return F.when(F.size(choices) > 0, found).otherwise(nothing("none"))

    def nothing(why: str):
        return F.struct(F.lit("").alias("comment_id"), F.lit("").alias("body"), F.lit("").alias("solution"), F.lit("low").alias("tier"), F.array(F.lit("no usable comment")).alias("reasons"), F.lit(None).cast("timestamp").alias("resolution_at"), F.lit(why).alias("selection"))

    chosen = let(F.array_compact(F.transform(comments, rated)), best)
    return F.when(F.contains(F.lower(F.trim(text(status))), F.lit("cancel")), nothing("excluded_cancelled_ticket")).otherwise(chosen)


def resolution_candidates(issues: DataFrame, bot: str, markers: tuple[str, ...] = ()) -> DataFrame:
    """Issues as candidates: failure, order context and chosen resolution; those of low tier are left out.

    ``issues(key, summary, description, status, resolved, assignee, comments)``, comments as
    structs (id, body, created, updated, author, author_name).
    """
    named = F.transform("comments", lambda c: F.struct(c["author_name"].alias("author"), c["body"].alias("body")))
    q = issues.where(F.regexp_like("key", F.lit(ISSUE_KEY))).withColumn("query", issue_query(F.col("summary"), F.col("description"), named, bot))
    c = q.withColumn("choice", resolution_choice(F.col("comments"), F.col("status"), F.col("resolved"), text(F.col("assignee")), F.col("query.step"), F.col("query.error"), markers))
    out = c.where("choice.tier <> 'low'").withColumn("context", resolution_context(F.col("query.text"), F.col("choice.body")))
    return out.select("key", "summary", F.col("query.step").alias("step"), F.col("query.error").alias("error"), "context.*", "choice.comment_id", "choice.body", "choice.solution", "choice.tier", "choice.selection", "choice.resolution_at")


def candidates_by_key(keys: DataFrame, candidates: DataFrame, query: str = "query_id", most: int = 5) -> DataFrame:
    """The first ``most`` named issues of each query that have usable evidence, in the order they were named.

    ``keys(query, pos, key)``.
    """
    hit = keys.join(candidates, "key")
    place = F.row_number().over(Window.partitionBy(query).orderBy("pos"))
    return hit.withColumn("place", place).where(F.col("place") <= most)


def inflow(issues: DataFrame, **fields: str) -> DataFrame:
    """(key, updated, ...) of open issues with custom fields (JSON), each its option's value or name, or its text."""
    def value(c):
        return F.coalesce(F.nullif(F.get_json_object(c, "$.value"), F.lit("")), F.nullif(F.get_json_object(c, "$.name"), F.lit("")), F.when(F.startswith(F.ltrim(c), F.lit("{")), "").otherwise(c), F.lit(""))

    return issues.select("key", F.coalesce("updated", F.lit("")).alias("updated"), *(value(F.col(c)).alias(name) for name, c in fields.items()))


def preview(issues: DataFrame, key: str, sample: int = 5) -> DataFrame:
    """One row: how many there are, and the first few keys."""
    some = issues.select(key).orderBy(key).limit(sample).agg(F.array_sort(F.collect_list(key)).alias("sample_keys"))
    return issues.agg(F.count("*").alias("total")).join(F.broadcast(some)).withColumn("has_more", F.col("total") > sample)  # one row each


def own_comment(comments: Column, marker: str) -> Column:
    """The first comment that carries an own marker, null if none does."""
    return F.get(F.filter(comments, lambda c: F.contains(text(c["body"]), F.lit(marker))), F.lit(0))


def recovered_state(comments: Column, marker: str, waiting: str, template: str) -> Column:
    """Struct (comment_id, status, template_comment_id) from an issue's own comments; the last of each kind counts."""
    posted = F.filter(comments, lambda c: F.contains(text(c["body"]), F.lit(marker)))
    body = F.try_element_at(posted, F.lit(-1))["body"]
    other = F.filter(comments, lambda c: F.contains(text(c["body"]), F.lit(template)) & ~F.contains(text(c["body"]), F.lit(marker)))
    return F.struct(
        F.try_element_at(posted, F.lit(-1))["id"].cast("string").alias("comment_id"), F.when(F.contains(body, F.lit(waiting)), "awaiting_match").when(body.isNotNull(), "posted").alias("status"),
        F.try_element_at(other, F.lit(-1))["id"].cast("string").alias("template_comment_id"),
    )


def named_keys(answer: Column, fields: str = "array<struct<type:string,key:string,issueKey:string,url:string>>") -> Column:
    """Issue keys that a remote search named, in order, each once: of its records, or of the links in its text.

    Records are a JSON array; keys in dashboards, filters and pages don't count.
    """
    records = F.from_json(answer, fields)
    real = F.filter(records, lambda r: ~F.lower(text(r["type"])).isin("dashboard", "filter", "page", "space", "board", "project"))
    own = F.flatten(F.transform(real, lambda r: F.concat(
        F.filter(F.array(F.coalesce(F.nullif(r["issueKey"], F.lit("")), r["key"])), lambda k: k.isNotNull() & F.regexp_like(k, F.lit(ISSUE_KEY))), F.regexp_extract_all(text(r["url"]), F.lit(LINKED_KEY), F.lit(1)))))
    return F.array_distinct(F.coalesce(own, F.regexp_extract_all(text(answer), F.lit(LINKED_KEY), F.lit(1))))


def imported_rules(rules: DataFrame, known: DataFrame) -> DataFrame:
    """Rules of the older form (id, pattern, failed_step, order_type, workaround_text, created_by) as drafts; known ids stay as they are."""
    ok = rules.where((text(F.col("pattern")) != "") & (text(F.col("workaround_text")) != "")).join(known.select("id"), "id", "left_anti")
    return ok.withColumn("status", F.lit("draft")).withColumn("created_by", F.coalesce(F.nullif("created_by", F.lit("")), F.lit("legacy_import")))


def imported_votes(votes: DataFrame) -> DataFrame:
    """Votes of the older form (pos, key, vote, step, error, voter) on made-up issues, one for each candidate and failure."""
    key, failure = F.trim(text(F.col("key"))), F.coalesce(F.nullif(F.col("error"), F.lit("")), F.col("step"), F.lit(""))
    ok = votes.where((key != "") & F.col("vote").isin(1, -1))
    actor = F.when(F.trim(text(F.col("voter"))) != "", F.concat(F.trim("voter"), F.lit(" (legacy #"), F.col("pos").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("legacy_import_"), F.col("pos").cast("string")))
    return ok.select(F.concat(F.lit("legacy:"), key, F.lit(":"), F.substring(F.sha2(failure, 256), 1, 12)).alias("issue_key"), key.alias("candidate_key"), F.when(F.col("vote") == 1, "up").otherwise("down").alias("vote"), text(F.col("step")).alias("query_step"), text(F.col("error")).alias("query_error"), actor.alias("actor"))


def copied(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows for an empty target, in its columns and types; fails if it isn't empty."""
    if not target.isEmpty():
        raise ValueError("the target table is not empty")
    return source.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema))


def point_lookup(tables: dict[str, DataFrame], name: str, field: str, value: str, fields: list[str], most: int = 20) -> DataFrame:
    """Rows of an allowed table whose field is a value, the first ``most`` by all fields."""
    if name not in tables or not {field, *fields} <= set(tables[name].columns):
        raise ValueError("this lookup is not allowed")
    return tables[name].where(F.col(field) == F.lit(value)).select(*fields).orderBy(*fields).limit(most)
