"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._common import table
from .ann_tree import nearest
from .collocations import SQL as COLLOCATIONS
from .collocations import collocations
from .decontaminate import decontaminate
from .lm_score import score_cross_entropy
from .ngram_join import similar_groups
from .packing import pack_documents
from .periodic_runs import find_runs, run_digests, with_planted_periods
from .secret_scan import digests, find_secrets
from .suffix_dedup import remove_repeats
from .token_files import token_file_round_trip
from .toxicity import score_toxicity
from .warc_files import warc_round_trip
from .wrapper_induction import extract_text


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_linked_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_secrets(table(spark, sf_dir, "documents")))


def op5_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


def op7_run_length_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_cross_entropy(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(find_runs(with_planted_periods(table(spark, sf_dir, "documents"))))


def op12_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_template_decontamination, op2_warc_writer, op3_sum_of_squares_packing, op4_linked_secret_scan, op5_pfor_token_files, op6_ngram_jaccard_join, op7_run_length_suffix_dedup, op8_cross_entropy_difference, op9_toxic_segments, op10_kmeans_tree_search, op11_periodic_runs, op12_wrapper_induction, op13_phrase_collocations)}
#: SQL of the queries that it can express; tests/llm holds the others against brute force.
ORACLE_SQL = {
    "op2_warc_writer": """WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
        d AS (SELECT *, list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, (5 * g + 1)::BIGINT, 5))::BIGINT) >> s) & 31), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
        min(page_id) OVER (PARTITION BY h) AS first, row_number() OVER (PARTITION BY h, page_id) AS r FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first AND r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first AND r = 1 THEN NULL ELSE first END AS refers_to, url FROM d""",
    "op13_phrase_collocations": COLLOCATIONS,
}
