"""Rules as a table: thousands of patterns against a table of texts.

A pattern's literal factor is the longest run of plain characters that every match must
contain.  The factors of a block of rules make one Aho-Corasick automaton, which reads each text
once; only rules whose factor stands in the text have their expression tried, and those without
a factor always.  Conditions and precedence are joins and windows on what matched.

Defined cases: a pattern that doesn't compile, or is null, never matches; an empty pattern matches
every text; null texts count as empty; a rule without a condition for a field takes any value; a
null value matches no condition; repeated ids of texts are matched each for itself and give one row an id.
"""

from __future__ import annotations

import math
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAGS = re.IGNORECASE | re.DOTALL
SHORTEST = 2
#: What the ignoring of case takes for an ASCII letter.
FOLDED = str.maketrans({"ı": "i", "İ": "i", "ſ": "s", "\u212a": "k"})


def factor(parsed) -> str:
    """The longest run of ASCII literals, in small letters, that a match of a parsed expression must contain."""
    best, run = "", ""
    for op, value in parsed:
        name, inner = str(op), None
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            best = max(best, run, key=len)
            continue
        run = ""
        if name == "SUBPATTERN":
            inner = value[3]
        elif name == "ATOMIC_GROUP":
            inner = value
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = value[2]
        if inner is not None:
            best = max(best, factor(inner), key=len)
    return best


def compiled(pattern: str | None) -> tuple[re.Pattern, str] | None:
    """An expression and its factor; None where it doesn't compile."""
    if pattern is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return re.compile(pattern, FLAGS), factor(re._parser.parse(pattern, FLAGS))
    except (re.error, RecursionError, OverflowError, ValueError):
        return None


def automaton(patterns: list[tuple[str, str]]):
    """(automaton of factors, expressions by place, places without a factor) of (rule, pattern)."""
    import ahocorasick

    tree, expressions, always = ahocorasick.Automaton(), [], []
    by: dict[str, list[int]] = {}
    for rule, pattern in patterns:
        made = compiled(pattern)
        if made is None:
            continue
        if len(made[1]) >= SHORTEST:
            by.setdefault(made[1], []).append(len(expressions))
        else:
            always.append(len(expressions))
        expressions.append((rule, made[0]))
    for literal, places in by.items():
        tree.add_word(literal, places)
    if by:
        tree.make_automaton()
    return tree if by else None, expressions, always


def matched(text: str, tree, expressions: list, always: list[int]) -> list:
    """The rules whose expression is found in a text."""
    maybe = set(always)
    if tree is not None:
        for _, places in tree.iter(text.translate(FOLDED).lower()):
            maybe.update(places)
    return [expressions[i][0] for i in sorted(maybe) if expressions[i][1].search(text)]


def pattern_hits(texts: DataFrame, rules: DataFrame, text_id: str, body: str, rule_id: str = "id", pattern: str = "pattern", block_bytes: int = 8 << 20) -> DataFrame:
    """(query_id, rule_id) of all texts and rules that match.

    Texts of at most ``block_bytes`` that are the smaller side go to all tasks, each of which
    reads its own rules; else rules go to the tasks in blocks of about that size.
    """
    own = rules.select(F.col(rule_id).alias("rule"), F.col(pattern).cast("string").alias("pattern")).where("pattern is not null")
    size = own.agg(F.coalesce(F.sum(F.octet_length("pattern") + 64), F.lit(0)).alias("n")).first().n
    blocks = max(1, math.ceil(1.5 * size / block_bytes))
    left = texts.select(F.col(text_id).alias("query_id"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"))
    kinds = [left.schema["query_id"].dataType.simpleString(), own.schema["rule"].dataType.simpleString()]
    asked = left.agg(F.coalesce(F.sum(F.octet_length("body") + 64), F.lit(0)).alias("n")).first().n
    if asked <= min(size, block_bytes):
        every = texts.sparkSession.sparkContext.broadcast(left.toArrow())  # at most block_bytes

        def over(batches):
            bodies = every.value.column(1).to_pylist()
            for b in batches:
                made = automaton(list(zip(range(b.num_rows), b.column(1).to_pylist())))
                rows, found = [], []
                for i, text in enumerate(bodies):
                    for place in matched(text, *made):
                        rows.append(i)
                        found.append(place)
                ids = every.value.column(0).combine_chunks().take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, b.column(0).take(pa.array(found, pa.int64()))], ["query_id", "rule_id"])

        return own.repartition("rule", "pattern").mapInArrow(over, f"query_id {kinds[0]}, rule_id {kinds[1]}").distinct()
    out = None
    for k in range(blocks):
        block = own if blocks == 1 else own.where(F.pmod(F.xxhash64("rule", "pattern"), F.lit(blocks)) == k)
        sent = texts.sparkSession.sparkContext.broadcast([(r.rule, r.pattern) for r in block.orderBy("rule", "pattern").collect()])  # about block_bytes

        def run(batches, sent=sent):
            made = automaton(sent.value)
            for b in batches:
                rows, found = [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    for rule in matched(text, *made):
                        rows.append(i)
                        found.append(rule)
                ids = b.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, ARROW.get(kinds[1], pa.string()))], ["query_id", "rule_id"])

        part = left.mapInArrow(run, f"query_id {kinds[0]}, rule_id {kinds[1]}")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def match_table(texts: DataFrame, rules: DataFrame, text_id: str, body: str, fields: dict[str, str], block_bytes: int = 8 << 20) -> DataFrame:
    """(query_id, rule_id) of the winning rule of each text: most conditions, then newest, then largest id.

    ``rules(id, pattern, created_at, <field>)``, where a field holds the values that a rule takes, null for any;
    ``fields`` names the texts' column for each.
    """
    hits = pattern_hits(texts, rules, text_id, body, block_bytes=block_bytes)
    norm = lambda c: F.lower(F.trim(c))
    narrowed = rules.select(F.col("id").alias("rule_id"), "created_at", *(F.transform(f, norm).alias(f"want_{f}") for f in fields))
    values = texts.select(F.col(text_id).alias("query_id"), *(norm(F.col(c).cast("string")).alias(f"has_{f}") for f, c in fields.items())).distinct()
    both = hits.join(narrowed, "rule_id").join(values, "query_id")
    fits, count = F.lit(True), F.lit(0)
    for f in fields:
        fits = fits & (F.col(f"want_{f}").isNull() | F.coalesce(F.array_contains(F.col(f"want_{f}"), F.col(f"has_{f}")), F.lit(False)))
        count = count + F.col(f"want_{f}").isNotNull().cast("int")
    best = F.max(F.struct(count.alias("s"), "created_at", "rule_id")).alias("r")
    return both.where(fits).groupBy("query_id").agg(best).select("query_id", "r.rule_id")
