"""Registered queries of the persisted index, rules as a table, the ledger and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import postings, retrieve, rulebook
from ..sources.shared import shared_path
from ..streaming import ledger, retention
from .queries import BM25, TOKENS, load, query


@query(f"WITH {BM25} SELECT query_id, key, round(score, 6) AS score, rank FROM top")
def indexed_topk(spark, sf_dir):
    """Keyword search from an index that is written first."""
    path = shared_path(spark, "index")
    postings.rebuild(load(spark, sf_dir, "documents"), path)
    return postings.ask(spark, path, load(spark, sf_dir, "benchmark"), 20)


@query(f"WITH {BM25} SELECT query_id, key, round(score, 6) AS score, rank FROM top")
def pruned_topk(spark, sf_dir):
    """The same by bounds: rows that can't reach the best twenty aren't added up."""
    path = shared_path(spark, "index")
    postings.rebuild(load(spark, sf_dir, "documents"), path, slice_docs=64)
    return postings.ask(spark, path, load(spark, sf_dir, "benchmark"), 20, direct_rows=0)


@query(f"WITH {BM25} SELECT query_id, key, round(score, 6) AS score, rank FROM top")
def upserted_topk(spark, sf_dir):
    """An index of other texts and documents, brought up to date by changes: every third text is new, and what isn't a document goes."""
    path, docs = shared_path(spark, "index"), load(spark, sf_dir, "documents").select("doc_id", "text")
    third = F.col("doc_id") % 3 == 0
    before = docs.where(~third | (F.col("doc_id") % 2 == 0)).select("doc_id", F.when(third, F.concat(F.lit("old "), F.reverse("text"))).otherwise(F.col("text")).alias("text"))
    gone = load(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    postings.rebuild(before.unionByName(gone), path)
    changes = docs.where(third).select("doc_id", "text", F.lit(False).alias("deleted")).unionByName(gone.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted")))
    postings.upsert(changes, path, deleted="deleted")
    return postings.ask(spark, path, load(spark, sf_dir, "benchmark"), 20)


@query(f"""WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 97 = 0 THEN concat('(', t[1]) ELSE concat('\\b', t[1], '[^a-z0-9]+', t[2], '\\b') END AS pattern, doc_id % 11 AS created_at, CASE WHEN doc_id % 5 = 0 THEN (doc_id // 5) % 3 END AS want, doc_id % 97 <> 0 AS ok
  FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents) WHERE len(t) >= 2),
m AS (SELECT item_id AS query_id, id AS rule_id, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN want IS NULL THEN 0 ELSE 1 END DESC, created_at DESC, id DESC) AS n
  FROM benchmark, r WHERE ok AND (want IS NULL OR want = item_id % 3) AND regexp_matches(lower(coalesce(text, '')), CASE WHEN ok THEN pattern ELSE 'x' END))
SELECT query_id, rule_id FROM m WHERE n = 1""")
def rule_table_match(spark, sf_dir):
    """A rule from each document's first two words, some malformed, some narrowed, against all benchmark items."""
    t = F.array(*(F.regexp_extract(F.lower("text"), "([a-z0-9]+)[^a-z0-9]+([a-z0-9]+)", i) for i in (1, 2)))  # read no further than there
    r = load(spark, sf_dir, "documents").select("doc_id", t.alias("t")).where("t[0] <> ''")
    pattern = F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("("), F.col("t")[0])).otherwise(F.concat(F.lit("(?a:\\b"), F.col("t")[0], F.lit("[^a-z0-9]+"), F.col("t")[1], F.lit("\\b)")))
    r = r.select(F.col("doc_id").alias("id"), pattern.alias("pattern"), (F.col("doc_id") % 11).alias("created_at"), F.when(F.col("doc_id") % 5 == 0, F.array((F.floor(F.col("doc_id") / 5) % 3).cast("string"))).alias("kind"))
    q = load(spark, sf_dir, "benchmark").select("item_id", "text", (F.col("item_id") % 3).alias("kind"))
    return rulebook.match_table(q, r, "item_id", "text", {"kind": "kind"})


@query("""WITH e AS (SELECT user_id, event_id, concat(event_type, ' ', coalesce(CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR), '-')) AS body, event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS batch FROM events WHERE user_id IS NOT NULL),
f AS (SELECT user_id, batch, arg_max(body, event_id) AS body, CASE WHEN user_id % 7 = 0 THEN 'low' ELSE 'high' END AS tier FROM e GROUP BY 1, 2),
c AS (SELECT *, lag(body) OVER (PARTITION BY user_id ORDER BY batch) AS had FROM f WHERE tier <> 'low')
SELECT user_id AS key, body, batch::BIGINT AS batch, CASE WHEN had IS NULL THEN 'create' ELSE 'update' END AS action FROM c WHERE had IS NULL OR had <> body""")
def published_once(spark, sf_dir):
    """Events as decisions in four batches, each given twice; the outbox has every change of a text once."""
    path, parts = shared_path(spark, "ledger"), 4
    body = F.concat("event_type", F.lit(" "), F.coalesce(F.floor(F.col("value") / 50).cast("string"), F.lit("-")))
    events = load(spark, sf_dir, "events")
    last = F.broadcast(events.agg((F.max("event_id") + 1).alias("n")))  # one row
    tier = F.when(F.col("user_id") % 7 == 0, "low").otherwise("high")
    e = events.join(last).select("user_id", "event_id", body.alias("body"), tier.alias("tier"), F.floor(F.col("event_id") * parts / F.col("n")).alias("batch"))
    for number in [n for n in range(parts) for _ in range(2)]:
        ledger.publish_batch(e.where(F.col("batch") == number), number, path, "user_id", "body", "event_id", "tier")
    return ledger.outbox(spark, path).select("key", "body", "batch", "action")


#: Seconds that an event of a type keeps its user's entry.
TTL = {"view": 6 * 3600, "click": 12 * 3600, "purchase": 24 * 3600, "signup": 48 * 3600}


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, ts AS touched, min(event_type) AS class FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, CASE class {" ".join(f"WHEN '{c}' THEN {s}" for c, s in TTL.items())} END AS live, lead(touched) OVER (PARTITION BY key ORDER BY touched) AS next FROM e)
SELECT key, class, epoch_us(touched) AS touched, epoch_us(touched) + live * 1000000::BIGINT AS evicted FROM t
WHERE live IS NOT NULL AND coalesce(epoch_us(next), (SELECT epoch_us(max(ts)) FROM events) - 3600000000) > epoch_us(touched) + live * 1000000::BIGINT""")
def evicted_entries(spark, sf_dir):
    """Entries of users that nobody touched in time, from a stream of events with timers."""
    path, checkpoint = shared_path(spark, "evictions"), shared_path(spark, "evictions-checkpoint")
    raw = spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    out = retention.evictions(raw, "user_id", "event_type", "ts", TTL)
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(retention.RESULT).parquet(path).select("key", "class", F.unix_micros("touched").alias("touched"), F.unix_micros("evicted").alias("evicted"))
