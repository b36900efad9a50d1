"""Uploaded documents: passages as sources, listings, the older single-chunk form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.issues import document_fields
from ..functions.text import field, parse_failure, text
from .quality import source_quality
from .windows import numbered, pieces

CONTEXT = {"order_type": ("Order Type", "Order Type Failed"), "order_reason": ("Order Reason",), "release": ("Release",)}


def merged_context(docs: DataFrame, body: str = "text") -> DataFrame:
    """Adds step, error and order context: what was given, else what the text says."""
    found = parse_failure(F.col(body))
    read = {"step": found["step"], "error": found["error"], **{k: field(F.col(body), *names) for k, names in CONTEXT.items()}}
    given = [c for c in read if c in docs.columns]
    return docs.select(*(c for c in docs.columns if c not in given), *(F.coalesce(F.nullif(text(F.col(k)), F.lit("")), v).alias(k) if k in given else v.alias(k) for k, v in read.items()))


def source_items(docs: DataFrame, key: str = "doc_id", body: str = "text", size: int = 6000, prefix: str = "DOC") -> DataFrame:
    """One row a passage: source_key ``DOC:id:n``, its body and hash, number and count, and its tier.

    Needs step and error (``merged_context``).  A passage of several is of medium tier at best.
    """
    cut = docs.withColumn("parts", pieces(F.col(body), size))
    each = cut.select(*docs.columns, F.size("parts").alias("chunk_count"), F.posexplode("parts").alias("pos", "chunk")).withColumn("chunk_number", F.col("pos") + 1)
    q = source_quality(F.col("chunk"), F.col("step"), F.col("error"), F.col("chunk_count"))
    named = F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"), F.lit(":"), F.col("chunk_number").cast("string"))
    return each.select(named.alias("source_key"), key, "chunk_number", "chunk_count", "step", "error", F.col("chunk").alias("body"), F.sha2("chunk", 256).alias("content_hash"), q.alias("q")).select("*", F.col("q.tier").alias("tier"), F.col("q.reasons").alias("reasons")).drop("q")


def indexed(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with chunk_count, searchable_chunks and status: failed where no passage came out."""
    n = items.groupBy(key).agg(F.count("*").alias("chunk_count"), F.count_if(F.col("tier") != "low").alias("searchable_chunks"))
    return docs.select(key).join(n, key, "left").select(key, F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("searchable_chunks", F.lit(0)).alias("searchable_chunks"), F.when(F.col("chunk_count") > 0, "ready").otherwise("failed").alias("status"))


def searchable(items: DataFrame) -> DataFrame:
    """Passages that go (again) into an index: usable tier, and a text."""
    return items.where((F.col("tier") != "low") & (text(F.col("body")) != ""))


def two_sided(items: DataFrame, step_vector: Column, error_vector: Column) -> DataFrame:
    """Rows of an index with two vectors, each null where its side says nothing; rows without either go."""
    side = lambda c, v: F.when(F.trim(text(F.col(c))) != "", v)
    return items.withColumn("step_vec", side("step", step_vector)).withColumn("error_vec", side("error", error_vector)).where("step_vec is not null or error_vec is not null")


def single_chunks(docs: DataFrame, name: str = "filename", body: str = "text", least: int = 50, most: int = 4000) -> DataFrame:
    """The older form: one chunk a file, keyed by a hash of its name; a file without step and error, or too short, is rejected."""
    f = document_fields(F.col(body))
    rows = docs.where(F.length(F.trim(text(F.col(body)))) >= least).select(F.substring(F.md5(F.col(name).cast("binary")), 1, 12).alias("doc_key"), name, f.alias("f"), F.substring(body, 1, most).alias("body"))
    return rows.select("doc_key", name, F.col("f.step").alias("step"), F.col("f.error").alias("error"), "body").where("step <> '' and error <> ''")


def approved_fixes(suggestions: DataFrame) -> DataFrame:
    """Approved fixes as sources ``usr_<id>``: a body, and a step or an error."""
    there = lambda c: F.trim(text(F.col(c))) != ""
    ok = suggestions.where((F.col("status") == "approved") & there("body") & (there("step") | there("error")))
    return ok.select(F.concat(F.lit("usr_"), F.col("id").cast("string")).alias("source_key"), F.lit("doc").alias("source_type"), "step", "error", "body")


def replaced(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with the rows of ``new`` in place of those with the same key; of equal keys in ``new`` one stays."""
    one = numbered(new, Window.partitionBy(key).orderBy(*new.columns), lambda n: n == 1)
    return table.join(one.select(key), key, "left_anti").unionByName(one, allowMissingColumns=True)


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def listed(docs: DataFrame, created: str, *columns: str) -> DataFrame:
    """Newest first, without the texts."""
    return docs.select(*columns, created).orderBy(F.desc(created), *columns)
