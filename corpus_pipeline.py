"""The corpus pipeline: documents in, packed training sequences out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of ``documents``.

Defined cases, of all stages: a null text counts as empty and its row stays; rows
with a null id stay, each for itself; further columns are carried along whatever
their names; an empty table gives an empty table.  Of rows with equal ids
``ngram_join`` keeps one, the other stages keep all; without labels or benchmark
items nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm._common import dropped, staged, table
from sievemark.llm.decontaminate import without_benchmark
from sievemark.llm.ngram_join import one_of_each
from sievemark.llm.packing import pack_documents
from sievemark.llm.secret_scan import redact_secrets
from sievemark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("ngram_join", ngram_join), ("decontamination", decontamination), ("secret_scan", secrets), ("packing", packing)]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage returns is written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        after = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(spark, before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
