"""Physical plans of the registered queries of part 1."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PLAIN = sorted(k for k in entry.queries() if not k.startswith("op") and k not in ("pipeline", "stream_scan"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


#: Cuts and chains depend on what came before, tokens on a vocabulary's file, bands on products of matrices, so these run on Arrow batches.
ARROW = {"document_pieces", "document_items", "audit_chain", "audit_verify", "audit_report", "rule_table_match", "token_windows", "token_budgets", "semantic_lookup", "indexed_vectors"}
#: Joins with one-row tables, and blocks of queries against all vectors.
LOOPS = {"dense_topk", "dual_score", "selftest", "chain_rank", "cache_fresh", "cache_sources"}


@pytest.mark.parametrize("name", PLAIN)
def test_no_python_and_no_products(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert name in ARROW or not re.search("Python|ArrowEval|MapInPandas|MapInArrow", p)
    assert "CartesianProduct" not in p
    for loop in re.findall(r"BroadcastNestedLoopJoin[^\n]*", p):
        assert name in LOOPS or re.search(r"(Inner|Cross)$", loop.strip()), loop  # without a condition: a one-row table


def test_search_reads_the_corpus_few_times(spark):
    """Once for the words' frequencies, once for the queries' words; windows, quotations and lengths of the found are read besides."""
    for name, most in (("bm25_topk", 2), ("history_search", 5)):
        df = entry.queries()[name](spark, SF)
        df.collect()
        p = plan(df).split("== Initial Plan ==")[0]  # the plan that ran, with reused exchanges
        assert len(re.findall(r"FileScan parquet[^\n]*documents", p)) <= most
        assert not re.search(r"NestedLoopJoin[^\n]*[Cc]ontains", p)


def test_fields_are_read_once(spark):
    """Each label's pattern stands once in the plan and only behind the test that the label occurs; a table in one file goes to all cores."""
    from pyspark.sql import functions as F

    from sievemark.functions import tables

    p = plan(entry.queries()["structured_fields"](spark, SF))
    for label in tables.LABELS:
        assert len(re.findall(rf"\\\*\?{label}\\\*\?", p)) == 1, label
    assert "RoundRobinPartitioning" in p
    bodies = ["ORDER type: a\nsub TYPE | b |", "Order Type\nx", None, "", "Step: 12\nError code: 12", "ſtep: x\nStep: é y"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i long, body string").select("i", tables.structured_fields(F.col("body")).alias("m"), tables.field_lines(F.col("body")).alias("l"))
    assert {r.i: (r.m, r.l) for r in df.collect()} == {
        0: ({"Order Type": "a", "Sub Type": "b"}, "Order Type: a\nSub Type: b"), 1: ({}, ""), 2: ({}, ""), 3: ({}, ""), 4: ({"Error Code": "12"}, "Error Code: 12"), 5: ({"Step": "y"}, "Step: y"),
    }
