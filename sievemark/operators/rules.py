"""Approved rules: matching by conditions and by pattern, precedence, overlaps."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieve import BROADCAST_BYTES, fits
from .windows import numbered

#: Tasks that the rules of one pattern and one set of values are dealt to, where they are too many to be sent.
SALTS = 16
FIELDS = ("failed_step", "order_type", "order_reason")


def usable_rules(spark: SparkSession, rules: list[dict]) -> list[dict]:
    """Rules whose pattern compiles where it will run; a malformed one never matches."""
    out = []
    for r in rules:
        try:
            spark._jvm.java.util.regex.Pattern.compile("(?is)" + (r.get("pattern") or ""))
        except (Py4JJavaError, IllegalArgumentException):
            continue
        out.append(r)
    return out


def condition(rule: dict, field: str, value: Column, unknown_matches: bool) -> Column:
    """One narrowed field of a rule: equals, in, or any.  Unknown operations match in the older mode only."""
    op, want = rule.get(f"{field}_op", "any"), rule.get(field)
    norm = lambda c: F.lower(F.trim(c))
    if op == "any":
        return F.lit(True)
    if op == "equals":
        return norm(value) == (want or "").strip().lower()
    if op == "in":
        return norm(value).isin(*[w.strip().lower() for w in want or ["\0"]])
    return F.lit(unknown_matches)


def specificity(rule: dict) -> int:
    return sum(rule.get(f"{f}_op", "any") != "any" for f in FIELDS)


def match_rules(queries: DataFrame, rules: list[dict], query_id: str, error: str, unknown_matches: bool = False) -> DataFrame:
    """(query_id, rule_id) of the winning rule of each query: most specific, then newest, then largest id.

    Rules are a small literal list, so each becomes one expression in a single scan;
    no pairs of queries and rules are made.
    """
    hits = [
        F.when(
            _all([F.regexp_like(F.col(error), F.lit("(?is)" + r.get("pattern", ""))), *(condition(r, f, F.col(f), unknown_matches) for f in FIELDS if f in queries.columns)]),
            F.struct(F.lit(specificity(r)).alias("s"), F.lit(r.get("created_at", "")).alias("c"), F.lit(r["id"]).alias("rule_id")),
        )
        for r in usable_rules(queries.sparkSession, rules)
    ]
    if not hits:
        return queries.select(query_id, F.lit(None).cast("string").alias("rule_id")).where("false")
    best = F.array_max(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return queries.select(query_id, best["rule_id"].alias("rule_id")).where("rule_id is not null")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def relation(a: Column, b: Column) -> Column:
    """Equal, subset, disjoint or overlap of two value sets; null stands for any value."""
    left, right = F.size(F.array_except(a, b)) == 0, F.size(F.array_except(b, a)) == 0
    return (
        F.when(a.isNull() & b.isNull(), "equal").when(a.isNull() | b.isNull(), "subset").when(left & right, "equal")
        .when(left | right, "subset").when(F.arrays_overlap(a, b), "overlap").otherwise("disjoint")
    )


def overlapping(rules: DataFrame, fields: list[str]) -> DataFrame:
    """Pairs of rules with the same trimmed pattern, and how they relate.

    Values are compared once for rules that have the same; what is left for each pair is to be written. So that
    few patterns keep all cores busy, one side is dealt evenly and the other sent, or spread over ``SALTS`` tasks a pattern.
    """
    r = rules.select("id", F.trim("pattern").alias("pattern"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("shape"), *fields)
    one = r.groupBy("pattern", "shape").agg(*(F.first(f).alias(f) for f in fields))
    a, b = one.alias("a"), one.alias("b")
    rel = [relation(F.col(f"a.{f}"), F.col(f"b.{f}")) for f in fields]
    every = F.array(*rel)
    kind = F.when(F.array_contains(every, "disjoint"), "disjoint").when(F.forall(every, lambda x: x == "equal"), "equal").when(F.array_contains(every, "overlap"), "overlap").otherwise("subset")
    kinds = a.join(b, F.col("a.pattern") == F.col("b.pattern")).select(F.col("a.pattern").alias("pattern"), F.col("a.shape").alias("shape"), F.col("b.shape").alias("other"), kind.alias("relation"))
    left = r.select(F.col("id").alias("a"), "pattern", "shape").join(kinds, ["pattern", "shape"]).select("a", "pattern", "other", "relation")
    right = r.select(F.col("id").alias("b"), "pattern", F.col("shape").alias("other"))
    keys = ["pattern", "other"]
    if fits(right, BROADCAST_BYTES):
        right, left = F.broadcast(right), left.repartition(4 * rules.sparkSession.sparkContext.defaultParallelism, "a")
    else:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        left, right, keys = left.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS))), right.withColumn("salt", every), [*keys, "salt"]
    return left.join(right, keys).where("a < b").select("a", "b", "relation")


def newest(df: DataFrame, key: str, order: str) -> DataFrame:
    return numbered(df, Window.partitionBy(key).orderBy(F.desc(order)), lambda n: n == 1)
