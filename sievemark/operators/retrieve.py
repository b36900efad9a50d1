"""Keyword, vector and fused retrieval for tables of queries.

Every operator takes a whole table of queries.  Query terms, which are few, meet
the corpus' terms in a join whose query side is broadcast only after its size was
checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp, dot
from ..functions.text import let, text, tokens

# Weights of a source's fields in keyword search.
FIELD_WEIGHTS = {"summary": 1.0, "step": 2.0, "error": 5.0, "body": 0.5}
#: Bytes up to which a table is sent to all executors, and rows of it that are counted at most.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 1_000_000


def fits(df: DataFrame, most: int) -> bool:
    """Whether all rows (as JSON) take at most ``most`` bytes."""
    size = df.limit(BROADCAST_ROWS + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= BROADCAST_ROWS and size["bytes"] <= most


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows (as JSON) are small enough together, else as it is.

    For tables that are cheap to compute, since this runs a job; what is dear is left to
    adaptive execution, which knows its size when it gets there.
    """
    return F.broadcast(df) if fits(df, BROADCAST_BYTES) else df


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer files than there are cores, dealt to all of them; larger ones as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df  # counted there, not brought here


def top(df: DataFrame, k: int, score: str, key: str, by: str = "query_id", rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(key))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def vocabulary(corpus: DataFrame, body: Column) -> DataFrame:
    """(token, df, lengths, total) of all terms in one pass; the row of the empty token, marked total, has the documents and their length.

    Rows are told apart by ``total``, which is aggregated: a filter on the token would be
    pushed below the aggregation, and each use would read the corpus again.
    """
    t = corpus.select(tokens(body).alias("t")).select(F.size("t").alias("len"), F.explode(F.array_append(F.array_distinct("t"), F.lit(""))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("df"), F.sum("len").alias("lengths"), F.max(F.col("token") == "").alias("total"))


def asked_terms(q: DataFrame, weighed: DataFrame) -> DataFrame:
    """The queries' terms with their weights, sent to all tasks if they are few, so that the counts stay where their documents are."""
    both = q.join(weighed, "token")
    return F.broadcast(both) if fits(q, 2 * BROADCAST_BYTES // 3) else both


def bm25(corpus: DataFrame, queries: DataFrame, key="doc_id", body="text", query_key="item_id", query_body="text", k1=1.5, b=0.75, share=0.25) -> DataFrame:
    """(query_id, key, score) of every document whose score for a query is positive.

    A term twice in a query counts twice.  idf is ln((N - df + 0.5) / (df + 0.5)); where that
    is negative, it is ``share`` of the mean idf of all terms of the corpus.  The corpus is
    read twice: for the terms' document frequencies, and for the counts of the queries'
    terms.  There texts move once, by key, so that neither counts nor products of terms and queries do.
    """
    q = queries.select(F.col(query_key).alias("query_id"), F.explode(tokens(F.col(query_body))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    wanted = small(q.select("token").distinct())
    words = vocabulary(corpus, F.col(body))
    about = words.where("total").select(F.col("df").alias("n"), (F.col("lengths") / F.col("df")).alias("mean"))
    terms = words.where("not total").join(F.broadcast(about))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    floor = terms.agg((share * F.avg(idf)).alias("floor"))
    weighed = terms.join(wanted, "token").join(F.broadcast(floor)).select("token", "mean", F.when(idf < 0, F.col("floor")).otherwise(idf).alias("idf"))
    placed = corpus.select(F.col(key).alias("key"), F.col(body).alias("body")).repartition("key")
    body_terms = placed.select("key", tokens(F.col("body")).alias("t")).select("key", F.size("t").alias("len"), F.explode("t").alias("token"))
    tf = body_terms.join(wanted, "token").groupBy("key", "token", "len").agg(F.count("*").alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return tf.join(asked_terms(q, weighed), "token").groupBy("query_id", "key").agg(F.sum(part).alias("score")).where("score > 0")


def quoted(corpus: DataFrame, queries: DataFrame, key="doc_id", body="text", query_key="item_id", query_body="text", window=4, block=500) -> DataFrame:
    """(query_id, key) of the documents that hold a query's whole text.

    A text that holds another holds the other's inner tokens in sequence.  So the hash of
    one window of them (the smallest) is looked up among the document's, and only hits are
    compared in full.  Queries of too few tokens have no window; they go as literals, a
    ``block`` of them a pass.
    """
    q = queries.select(F.col(query_key).alias("query_id"), text(F.col(query_body)).alias("needle"))

    def grams(words: Column) -> Column:
        def each(t):
            last = F.size(t) - window + 1
            return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(t, i, F.lit(window))))).otherwise(F.array().cast("array<bigint>"))

        return let(words, each)

    inner = tokens(F.col("needle"))
    inner = F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))
    keyed = q.withColumn("gram", F.array_min(grams(inner)))
    docs = corpus.select(F.col(key).alias("key"), F.col(body).alias("body"))
    maybe = docs.select("key", F.explode(F.array_distinct(grams(tokens(F.col("body"))))).alias("gram")).join(small(keyed.where("gram is not null")), "gram")
    out = docs.join(maybe.drop("gram"), "key").where(F.contains("body", F.col("needle"))).select("query_id", "key")
    short = keyed.where("gram is null").select("query_id", "needle")
    n = short.count()
    for i in range(-(-n // block)):
        own = [(r.query_id, r.needle) for r in (short if n <= block else short.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // block))) == i)).collect()]  # about ``block`` rows
        literals = F.array(*(F.struct(F.lit(a).alias("query_id"), F.lit(b).alias("needle")) for a, b in own))
        found = docs.select("key", F.explode(F.filter(literals, lambda x: F.contains(F.col("body"), x["needle"]))).alias("x"))
        out = out.unionByName(found.select(F.col("x.query_id").alias("query_id"), "key"))
    return out.distinct()


def similar_sets(left: DataFrame, right: DataFrame, least: float, left_key="doc_id", right_key="item_id") -> DataFrame:
    """(left key, right key, score) of token sets ``t`` with a Jaccard similarity of ``least`` or more.

    Prefix filter: sets of that similarity share a token among their rarest ones, so only
    those of the left side, which is read in one pass, meet those of the right side; each
    pair that passes the length filter is compared once.
    """
    one, two = (df.select(F.col(k).alias(n), "t", F.size("t").alias("size")).where("size > 0") for df, k, n in ((left, left_key, "l"), (right, right_key, "r")))
    often = two.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranks = small(often)
    # tokens in order of frequency on the right side; those that it lacks come first and match nothing
    def prefix(df: DataFrame, name: str) -> DataFrame:
        each = df.select(name, "size", F.explode("t").alias("token")).join(ranks, "token")
        known = F.count("*").over(Window.partitionBy(name))
        place = F.row_number().over(Window.partitionBy(name).orderBy("n", "token")) + F.col("size") - known
        return each.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(least * F.col("size")) + 1).select(name, "size", "token")

    x, y = prefix(one, "l"), prefix(two, "r")
    pairs = x.join(y.withColumnRenamed("size", "other"), "token").where((F.least("size", "other") >= least * F.greatest("size", "other"))).select("l", "r").distinct()
    both = pairs.join(one.select("l", F.col("t").alias("a")), "l").join(two.select("r", F.col("t").alias("b")), "r")
    score = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return both.select(F.col("l").alias(left_key), F.col("r").alias(right_key), score.alias("score")).where(F.col("score") >= least)


def fielded_bm25(corpus: DataFrame, queries: DataFrame, fields: dict[str, float], key: str, query_key: str, query_body: str, k1=1.2, b=0.75, of: dict[str, str] | None = None) -> DataFrame:
    """BM25 over weighted fields; a query's distinct terms, all of its text, count once each.

    ``of`` names the column of a field that isn't called like one; a column of several
    fields is moved and cut into terms once.
    """
    q = queries.select(F.col(query_key).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_body)))).alias("token"))
    wanted = small(q.select("token").distinct())
    # every column gives counts by the weights of its fields; lengths are over all fields; texts move once, by key
    shared: dict[str, list[float]] = {}
    for f, w in fields.items():
        shared.setdefault((of or {}).get(f, f), []).append(float(w))
    placed = corpus.select(F.col(key).alias("key"), *shared).repartition("key")
    sized = placed.select("key", *(tokens(F.col(c)).alias(c) for c in shared))
    sized = sized.withColumn("len", sum((F.size(c) * len(w) for c, w in shared.items()), F.lit(0)))
    about = sized.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    weighty = {c: sum(x for x in w if x > 0) for c, w in shared.items()}
    terms = sized.select("key", "len", F.explode(F.array(*(F.struct(F.lit(w).alias("w"), F.col(c).alias("t")) for c, w in weighty.items() if w > 0))).alias("x"))
    terms = terms.select("key", "len", F.col("x.w").alias("w"), F.explode("x.t").alias("token")).join(wanted, "token")
    tf = terms.groupBy("key", "len", "token").agg(F.sum("w").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(about))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighed = df.select("token", "mean", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return tf.join(asked_terms(q, weighed), "token").groupBy("query_id", "key").agg(F.sum(part).alias("score"))


def dense(vectors: DataFrame, queries: DataFrame, key="vec_id", vector="embedding", query_key="query_id", query_vector="q", score=lambda v, q: clamp(dot(v, q))) -> DataFrame:
    """(query_id, key, score) of one block of queries and all vectors: clamped inner product of unit vectors, to 9 places.

    ``queries`` is broadcast; ``dense_top`` gives it blocks of bounded size.  Pairs whose
    ``score`` is null are left out.
    """
    v = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    q = queries.select(F.col(query_key).alias("query_id"), F.col(query_vector).alias("q"))
    return v.join(F.broadcast(q), F.lit(True)).select("query_id", "key", F.round(score(F.col("v"), F.col("q")), 9).alias("score")).where("score is not null")


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2_000, **names) -> DataFrame:
    """The best ``k`` of every query.  Queries go in blocks of ``block`` rows, so what is broadcast is bounded."""
    n = queries.count()
    parts = max(1, -(-n // block))
    out = None
    for i in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(names.get("query_key", "query_id")), F.lit(parts)) == i)
        one = top(dense(vectors, own, **names), k, "score", "key")
        out = one if out is None else out.unionByName(one)
    return out


def fuse(lists: list[DataFrame], constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, key, rank) lists, scaled by the query's best."""
    every = lists[0].select("query_id", "key", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "key", "rank"))
    one = every.groupBy("query_id", "key").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("rrf"), F.count("*").alias("lists"))
    best = F.max("rrf").over(Window.partitionBy("query_id"))
    return one.withColumn("retrieval_score", F.least(F.lit(1.0), F.col("rrf") / best))


def best_passage(hits: DataFrame) -> DataFrame:
    """One row a key from hits of passages (query_id, key, pos, score): best score, rank by first appearance."""
    one = hits.groupBy("query_id", "key").agg(F.max("score").alias("score"), F.min("pos").alias("first"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "key"))).drop("first")
