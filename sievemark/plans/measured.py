"""Registered queries of texts measured in tokens, similar cache entries, best passages, and drafts' agreement and routing."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.procedures import told
from ..functions.text import epoch, quote_is_present
from ..operators import caches, comments, decisions, retrieve, vectors
from ..sources.shared import shared_path
from .queries import load, query

#: Folder of vocabulary files.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = f"{VOCABULARIES}/byte_bpe_50k.json"


@query()
def token_windows(spark, sf_dir):
    """Windows of 128 tokens of every document, with its language as prefix."""
    d = retrieve.spread(load(spark, sf_dir, "documents")).withColumn("prefix", F.concat(F.coalesce("lang", F.lit("")), F.lit("\nReference: ")))
    d = d.select("doc_id", "text", F.posexplode(tokens.token_passages(F.col("text"), VOCABULARY, F.col("prefix"), 128)).alias("number", "at"))
    piece = F.substring("text", F.col("at.start").cast("int") + 1, (F.col("at.end") - F.col("at.start")).cast("int"))
    return d.select("doc_id", F.col("number").cast("long").alias("number"), F.col("at.start").alias("start"), F.col("at.end").alias("end"), F.sha2(piece, 256).alias("piece"))


@query()
def token_budgets(spark, sf_dir):
    """Each conversation's turns as the fields of a failure, within 64 tokens."""
    turn = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(*(turn(n).alias(f"t{n}") for n in range(4)))
    code = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("E-"), F.col("conv_id").cast("string")))
    body = tokens.token_failure_text(code, F.col("t0"), F.col("t1"), F.col("t2"), F.col("t3"), VOCABULARY, 64)
    return c.select("conv_id", body.alias("body")).select("conv_id", "body", tokens.token_count(F.col("body"), VOCABULARY).alias("tokens"))


@query("""WITH e AS (SELECT vec_id * 3 + k AS id, vec_id % 2 AS scope, CASE WHEN k = 0 THEN concat('h', vec_id) ELSE concat('x', vec_id * 3 + k) END AS h, (vec_id * 3 + k) % 4 <> 0 AS valid,
    list_transform(range(len(embedding)), lambda i: CAST(embedding[i + 1] AS DOUBLE) + CASE WHEN vec_id % 10 = 0 THEN 0 ELSE ((vec_id * 31 + i * 17 + k * 7) % 11 - 5) * (0.002 + 0.005 * k) END) AS v FROM embeddings, range(3) r(k)),
q AS (SELECT vec_id AS query_id, vec_id % 2 AS scope, CASE WHEN vec_id % 7 = 0 THEN concat('h', vec_id) ELSE 'none' END AS h, vec_id % 9 <> 0 AS eligible, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT query_id, min(id) AS id FROM q JOIN e USING (scope, h) WHERE valid GROUP BY 1),
s AS (SELECT query_id, id, valid, round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)), 9) AS similarity FROM q JOIN e USING (scope) WHERE eligible AND query_id NOT IN (SELECT query_id FROM x)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS position FROM s WHERE similarity >= 0.97),
f AS (SELECT query_id, arg_min(id, position) AS id, arg_min(similarity, position) AS similarity FROM t WHERE position <= 3 AND valid GROUP BY 1)
SELECT q.query_id, CASE WHEN x.id IS NOT NULL THEN 'exact_hit' WHEN f.id IS NOT NULL THEN 'semantic_hit' ELSE 'miss' END AS status, coalesce(x.id, f.id) AS id,
  CASE WHEN x.id IS NOT NULL THEN 1.0::DOUBLE ELSE round(f.similarity, 6) END AS similarity FROM q LEFT JOIN x USING (query_id) LEFT JOIN f USING (query_id)""")
def semantic_lookup(spark, sf_dir):
    """All vectors as requests against a cache of three blurred copies of each, by bands of hyperplanes; hits are checked afterwards."""
    v, x = load(spark, sf_dir, "embeddings"), F.col("embedding").cast("array<double>")
    blur = lambda k: F.transform(x, lambda c, i: c + F.when(F.col("vec_id") % 10 == 0, 0).otherwise(((F.col("vec_id") * 31 + i * 17 + k * 7) % 11 - 5) * (0.002 + 0.005 * k)))
    own = F.col("vec_id") * 3 + F.col("k")
    e = v.select("vec_id", F.posexplode(F.array(*(blur(k) for k in range(3)))).alias("k", "vector"))
    e = e.select(own.alias("id"), (F.col("vec_id") % 2).alias("scope"), F.when(F.col("k") == 0, F.concat(F.lit("h"), "vec_id")).otherwise(F.concat(F.lit("x"), own)).alias("query_hash"), "vector", (own % 4 != 0).alias("valid"))
    q = v.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 2).alias("scope"), F.when(F.col("vec_id") % 7 == 0, F.concat(F.lit("h"), "vec_id")).otherwise(F.lit("none")).alias("query_hash"), (F.col("vec_id") % 9 != 0).alias("eligible"), x.alias("vector"))
    return caches.lookup(q, e, 0.97, valid="valid", direct=200).withColumn("similarity", F.round("similarity", 6))


@query("""WITH w AS (SELECT doc_id, number, list_distinct(string_split(p, ' ')) AS words FROM (SELECT doc_id, generate_subscripts(t, 1) - 1 AS number, unnest(t) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL))),
h AS (SELECT i.item_id AS query_id, w.doc_id AS key, number, count(*) AS score FROM (SELECT item_id, unnest(list_distinct(string_split(text, ' '))) AS word FROM benchmark WHERE text IS NOT NULL) i
  JOIN (SELECT doc_id, number, unnest(words) AS word FROM w) w ON w.word = i.word AND length(i.word) >= 7 GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key, number) AS pos FROM h),
b AS (SELECT query_id, key, max(score) AS score, min(pos) AS first FROM p WHERE pos <= 50 GROUP BY 1, 2)
SELECT query_id, key, score::BIGINT AS score, row_number() OVER (PARTITION BY query_id ORDER BY first)::INT AS rank FROM b""")
def best_lines(spark, sf_dir):
    """Documents of a question by their best line, from the 50 lines with the most of its words of seven letters or more."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    lines = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    lines = lines.select(F.col("doc_id").alias("key"), "number", F.explode(words("line")).alias("word")).where("length(word) >= 7")
    asked = load(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), F.explode(words("text")).alias("word")).where("length(word) >= 7")
    hits = asked.join(lines, "word").groupBy("query_id", "key", "number").agg(F.count("*").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key", "number"))
    return retrieve.best_passage(hits.withColumn("pos", place).where(F.col("pos") <= 50))


@query("""WITH s AS (SELECT o_orderkey, list(DISTINCT concat(l_partkey % 5, ' ', l_linestatus)) FILTER (l_linenumber % 2 = 1) AS a, list(DISTINCT concat(l_partkey % 5, ' ', l_linestatus)) FILTER (l_linenumber % 2 = 0) AS b,
  count(DISTINCT l_suppkey) = 1 AS same, count(*) FILTER (l_returnflag = 'A') AS n, any_value(o_orderstatus) AS status, any_value(o_orderpriority) AS priority FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN a IS NULL OR b IS NULL THEN 'single_branch' WHEN list_sort(a) <> list_sort(b) THEN 'different_procedures' WHEN same THEN 'same_ticket_both_paths' ELSE 'independent_sources_agree' END AS agreement,
  CASE WHEN priority = '1-URGENT' THEN 'publish' WHEN n = 0 THEN 'remote' WHEN status = 'F' THEN 'draft' ELSE 'review' END AS stage FROM s""")
def draft_agreement(spark, sf_dir):
    """Odd and even lines of an order as two drafts: how they relate, and the stage that comes next."""
    step = F.concat((F.col("l_partkey") % 5).cast("string"), F.lit(" "), "l_linestatus")
    side = lambda k: F.collect_set(F.when(F.col("l_linenumber") % 2 == k, step))
    o = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = o.groupBy("o_orderkey", "o_orderstatus", "o_orderpriority").agg(side(1).alias("a"), side(0).alias("b"), (F.count_distinct("l_suppkey") == 1).alias("same"), F.count_if(F.col("l_returnflag") == "A").alias("n"))
    status = F.when(F.col("o_orderstatus") == "F", "sufficient").otherwise("open")
    return g.select("o_orderkey", decisions.agreement(F.col("a"), F.col("b"), F.col("same")).alias("agreement"), decisions.next_stage(F.col("n"), status, F.col("o_orderpriority") == "1-URGENT").alias("stage"))


#: Sentences of three words or more of a conversation's turns, in small ASCII letters and digits.
SENTENCES = """x AS (SELECT conv_id, turn, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[.!?\\n]+') AS l FROM conversations WHERE text IS NOT NULL)),
y AS (SELECT conv_id, turn, i, lower(trim(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g'))) AS s FROM x),
z AS (SELECT conv_id, s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM y WHERE len(string_split(s, ' ')) >= 3)"""
NOT_HELD = "['a', 'an', 'the', 'please', 'we', 'have', 'has', 'had', 'was', 'were', 'been']"
HELD_BACK = "['not', 'no', 'never', 'without', 'before', 'after', 'if', 'unless', 'until', 'only', 'except']"


@query(rf"""WITH {SENTENCES},
c AS (SELECT *, list_transform(raw, lambda p: array_to_string(list_filter(string_split(p, ' '), lambda w: NOT list_contains({NOT_HELD}, w)), ' ')) AS said,
  list_sort(list_distinct(list_filter(string_split(s, ' '), lambda w: list_contains({HELD_BACK}, w)))) AS held FROM (SELECT *, list_filter(string_split(regexp_replace(concat('check ', s), ' (and )?then ', chr(10), 'g'), chr(10)), lambda p: p <> '') AS raw FROM z)),
e AS (SELECT conv_id, flatten(list(said ORDER BY pos)) AS every, flatten(list(raw ORDER BY pos)) AS text, list_sort(list_distinct(flatten(list(held)))) AS holds, sum(length(s) + 6) + 2 * (count(*) - 1) AS size FROM c GROUP BY 1),
d AS (SELECT conv_id * 4 + k AS draft_id, k, c.*, CASE WHEN k = 2 THEN -pos ELSE pos END AS place FROM c, range(4) r(k) WHERE k <> 1 OR pos <> 2),
p AS (SELECT *, list_transform(said, lambda q: list_position(every, q)) AS there, list_transform(said, lambda q: list_position(said, q)) AS here, k = 3 AND pos = n AS away FROM d JOIN e USING (conv_id)),
f AS (SELECT *, CASE WHEN away THEN 'outside' WHEN length(s) + 6 BETWEEN 12 AND 500 AND size <= 12000 AND held = holds AND there = list_sort(there) AND here = list_sort(here) THEN '' ELSE 'changed' END AS fault FROM p),
a AS (SELECT *, CASE WHEN fault = '' THEN list_filter(range(len(every)), lambda j: list_contains(said, every[j + 1])) END AS spots FROM f),
g AS (SELECT *, CASE WHEN fault <> '' THEN fault WHEN list_min(spots) < max(list_max(spots)) OVER (PARTITION BY draft_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'reordered' END AS why FROM a),
h AS (SELECT draft_id, any_value(conv_id) AS conv_id, arg_min(why, place) FILTER (why IS NOT NULL) AS why, arg_min(away, place) FILTER (why IS NOT NULL) AS away, list_distinct(flatten(list(spots) FILTER (spots IS NOT NULL))) AS used, any_value(text) AS text FROM g GROUP BY 1),
m AS (SELECT *, list_transform(list_filter(range(coalesce(list_max(used), 0)), lambda j: NOT list_contains(used, j)), lambda j: text[j + 1]) AS missing FROM h)
SELECT draft_id, coalesce(why, CASE WHEN len(missing) > 0 THEN 'skipped' ELSE '' END) AS reason, CASE WHEN why IS NOT NULL THEN conv_id + CASE WHEN away THEN 1 ELSE 0 END WHEN len(missing) > 0 THEN conv_id END AS source_key,
  CASE WHEN why IS NULL AND len(missing) > 0 THEN array_to_string(missing, '; ') END AS skipped FROM m""")
def draft_support(spark, sf_dir):
    """Each conversation as a procedure of its sentences, and four drafts of it: as it is, without the second step, backwards, and with the last step from elsewhere."""
    # both uses of the sentences need the same rows, so they are made once
    c = load(spark, sf_dir, "conversations").where("text is not null and conv_id is not null")
    said = F.transform(F.split("text", r"[.!?\n]+"), lambda x: F.lower(F.trim(F.regexp_replace(x, "[^A-Za-z0-9]+", " "))))
    c = c.select("conv_id", "turn", F.posexplode(said).alias("i", "s")).where(F.size(F.split("s", " ")) >= 3)
    w = Window.partitionBy("conv_id")
    c = c.select("conv_id", "s", F.row_number().over(w.orderBy("turn", "i")).alias("at"), F.count("*").over(w).alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: F.concat(F.lit("check "), x["s"])), "; ")
    drafts = F.explode(F.sequence(F.lit(0), F.lit(3)))
    # four drafts share each text, so it is worked out before there are four of it
    sources = c.groupBy("conv_id").agg(whole.alias("evidence")).withColumn("told", told(F.col("evidence")))
    sources = sources.select(F.col("conv_id").alias("source_key"), "evidence", "told", drafts.alias("k")).withColumn("draft_id", F.col("source_key") * 4 + F.col("k"))
    c = c.withColumn("action", F.concat(F.lit("checked "), "s")).withColumn("quote", F.concat(F.lit("check "), "s")).withColumn("doing", told(F.col("action"))).withColumn("quoted", told(F.col("quote")))
    d = c.withColumn("k", drafts).where((F.col("k") != 1) | (F.col("at") != 2))
    away = (F.col("k") == 3) & (F.col("at") == F.col("n"))
    steps = d.select((F.col("conv_id") * 4 + F.col("k")).alias("draft_id"), F.when(F.col("k") == 2, -F.col("at")).otherwise(F.col("at")).alias("pos"), (F.col("conv_id") + away.cast("int")).alias("source_key"),
                     "action", "quote", "doing", "quoted")
    return decisions.draft_reasons(steps, sources, ready=True).withColumn("skipped", F.array_join("skipped", "; "))


@query(r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), q AS (SELECT doc_id, text, replace(CASE WHEN doc_id % 2 = 1 THEN upper(l[-1]) ELSE l[-1] END, ' ', '  ') AS quote FROM d),
s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x0B]+', ' ', 'g')) AS body, trim(regexp_replace(coalesce(quote, ''), '[\s\x0B]+', ' ', 'g')) AS quote FROM q)
SELECT doc_id, length(quote) >= 12 AND contains(body, quote) AS present FROM s""")
def quoted_lines(spark, sf_dir):
    """Whether the last line of each document, spaced otherwise and every other time in capitals, is a quotation of it."""
    d, line = load(spark, sf_dir, "documents"), F.element_at(F.split("text", "\n"), -1)
    quote = F.replace(F.when(F.col("doc_id") % 2 == 1, F.upper(line)).otherwise(line), F.lit(" "), F.lit("  "))
    return d.select("doc_id", quote_is_present(quote, F.col("text")).alias("present"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN epoch(date_trunc('second', ts)) - 5400 WHEN 2 THEN epoch(date_trunc('day', ts)) ELSE epoch(date_trunc('second', ts)) END AS at FROM events")
def event_epochs(spark, sf_dir):
    """Seconds of times written with a zone's letter, with an offset, as a day, and of what can't be read or isn't there."""
    e, n = load(spark, sf_dir, "events"), F.col("event_id") % 5
    iso, day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd")
    bad = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("no "), iso))
    written = F.when(n == 0, bad).when(n == 1, F.concat(iso, F.lit("+01:30"))).when(n == 2, day).otherwise(F.concat(iso, F.lit("Z")))
    return e.select("event_id", epoch(written).alias("at"))


@query("""SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND (length(text) > 40 OR (role = 'assistant' AND length(trim(text)) >= 3))""")
def older_pool(spark, sf_dir):
    """Turns that the older pool of comments would keep; those of the assistant are the assignee's."""
    c = load(spark, sf_dir, "conversations")
    c = c.select("conv_id", "turn", F.col("text").alias("body"), (F.col("role") == "system").alias("bot"), (F.col("role") == "assistant").alias("by_assignee"))
    return comments.human_pool(c).select("conv_id", "turn")


@query("""SELECT query_id, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INT AS rank FROM
  (SELECT a.vec_id AS query_id, b.vec_id AS key, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b)) WHERE rank <= 10""")
def indexed_vectors(spark, sf_dir):
    """All vectors as questions to an index of all vectors."""
    path, e = shared_path(spark, "vectors"), load(spark, sf_dir, "embeddings")
    vectors.build(e, path)
    return vectors.ask(spark, path, e, 10, "vec_id", "embedding")
