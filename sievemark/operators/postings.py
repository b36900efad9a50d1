"""A persisted inverted index: built once, kept up to date by buckets, asked often.

A posting is a row (token, key, tf, len).  Postings lie by token bucket, in files of whole slices of the
documents (by hash, about ``slice_docs`` documents each) that are sorted by token; so the list of a word that stands everywhere
is spread, no group is longer than a document, and a token takes no room in its rows.  For each document the index
keeps its length and the buckets that its tokens are in, not its terms.

The best ``k`` of a query are found by bounds.  The rarest terms propose some documents, which get
their whole scores; the k-th best is a floor.  Frequent terms whose largest contributions
together stay below the floor can't bring a document in alone, so only postings of the other terms,
and of these only those that can reach the floor, are added up.  Documents whose sum
could still reach the floor get the rest of their scores.  Where the terms that propose are much of all, all is added up at once,
each document in one place, and only sums below the floor are dropped.  Nothing that could be among the best is left out.

Files are written under a new version and named by a commit last.  An upsert rewrites
the buckets of the tokens that old or new texts of the changed documents hold, and no
other.  ``rebuild`` writes everything anew beside the old version, ``refresh`` takes the rows of a
window that overlaps the last one, ``upsert`` a set of changes.

Defined cases: null and empty texts have no postings and count as documents; of rows with one key the largest text
counts; rows with a null key are left out; an upsert with a null text and ``deleted`` true removes; an empty
index answers nothing; further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources import commits
from ..sources.shared import shared_path
from .retrieve import small, top

BUCKETS, SLICE_DOCS = 16, 256
#: Documents, and products of postings and query terms, of a task at most by plan.
TASK_DOCS, TASK_ROWS = 8_192, 8_000_000
#: Keys (whole numbers) of changed documents that are sent to all tasks at most, so that postings that stay aren't moved.
SENT_KEYS = 4_000_000
#: Room for rounding of scores where bounds are compared.
ROOM = 1e-5
#: Postings of all queries' terms that are added up without looking for bounds, which takes more jobs.
DIRECT_ROWS = 5_000_000
#: How many times the postings of terms that propose must go into those of all terms, for the rest to be added up apart.
WORTH = 8


def bucket(c: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def slice_of(slices: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")


def _tasks(spark: SparkSession, docs: int, rows: int = 0) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, -(-docs // TASK_DOCS), -(-rows // TASK_ROWS))


def _postings(rows: DataFrame, buckets: int, slices: int, n: int) -> DataFrame:
    """Postings of the newest texts of (key, body, gone): texts are moved once, by slice, and what is made of them stays there."""
    dealt = rows.withColumn("slice", slice_of(slices)).repartition(_tasks(rows.sparkSession, n), "slice")
    newest = dealt.groupBy("slice", "key").agg(F.max(F.struct("gone", "body")).alias("r")).where("not r.gone")  # a removal wins
    listed = newest.select("slice", "key", tokens(F.col("r.body")).alias("t")).select("slice", "key", F.size("t").alias("len"), F.explode("t").alias("token"))
    counted = listed.groupBy("slice", "key", "len", "token").agg(F.count("*").cast("int").alias("tf"))
    return counted.select("token", "key", "tf", "len", bucket("token", buckets).alias("bucket"))


def _documents(keys: DataFrame, postings: DataFrame | None, buckets: int) -> DataFrame:
    """(key, len, held, bucket) of all documents; bit b % 64 of ``held`` says that bucket b has tokens of it."""
    every = keys.select("key", F.lit(0).alias("len"), F.lit(0).cast("long").alias("held"))
    if postings is not None:
        every = every.unionByName(postings.select("key", "len", F.expr("shiftleft(1L, bucket % 64)").alias("held")))
    return every.groupBy("key", bucket("key", buckets).alias("bucket")).agg(F.max("len").alias("len"), F.bit_or("held").alias("held")).select("key", "len", "held", "bucket")


def _write(df: DataFrame, path: str, table: str, version: int) -> None:
    """A file of each bucket from every task that holds rows of it, sorted by token; rows aren't moved again for fewer files."""
    df.sortWithinPartitions("bucket", *(c for c in ("token", "key") if c in df.columns)).write.mode("append").partitionBy("bucket").parquet(f"{path}/{table}/version={version}")


def _read(spark: SparkSession, path: str, table: str, state: dict, only: list[int] | None = None) -> DataFrame | None:
    """The committed version of each bucket, or of those of ``only``."""
    base = f"{path}/{table}"
    folders = [f"{base}/version={v}/bucket={b}" for b, v in state[table].items() if only is None or int(b) in only]
    return spark.read.option("basePath", base).parquet(*folders).drop("version") if folders else None


def _found(spark: SparkSession, path: str, table: str, version: int) -> dict[str, int]:
    return {n.split("=")[1]: version for n in commits.names(spark, f"{path}/{table}/version={version}") if n.startswith("bucket=")}


def _next(spark: SparkSession, path: str, state: dict | None) -> int:
    """A version number that no run, committed or not, has used."""
    used = [int(n.split("=")[1]) for t in ("postings", "docs", "words", "changes") for n in commits.names(spark, f"{path}/{t}") if n.startswith("version=")]
    return max([state["version"] if state else 0, *used]) + 1


def idf(n: int) -> Column:
    return F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _finish(spark: SparkSession, path: str, version: int, state: dict) -> None:
    """The words of the new buckets, sums over all, then the commit."""
    for table in ("postings", "docs"):
        state[table] = {b: v for b, v in state[table].items() if v != version} | _found(spark, path, table, version)
    new = [int(b) for b, v in state["postings"].items() if v == version]
    if new:
        words = _read(spark, path, "postings", state, new).groupBy("bucket", "token").agg(F.count("*").alias("df"), F.max("tf").alias("most"), F.min("len").alias("shortest"))
        _write(words, path, "words", version)
    state["words"] = {b: v for b, v in state["words"].items() if b in state["postings"] and v != version} | _found(spark, path, "words", version)
    docs, words = _read(spark, path, "docs", state), _read(spark, path, "words", state)
    about = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first() if docs is not None else None
    state |= {"n": about.n if about else 0, "total": about.total if about else 0}
    state["mean_idf"] = words.agg(F.avg(idf(state["n"])).alias("x")).first().x if words is not None else 0.0
    state.pop("version", None)
    commits.commit(spark, path, version, state)
    commits.tidy(spark, path)


def rebuild(corpus: DataFrame, path: str, key: str = "doc_id", body: str = "text", buckets: int = BUCKETS, slice_docs: int = SLICE_DOCS) -> int:
    """Writes the whole index as a new version beside the old one, and swaps by the commit."""
    spark = corpus.sparkSession
    version = _next(spark, path, commits.committed(spark, path))
    n = corpus.where(F.col(key).isNotNull()).count()
    slices = max(1, -(-n // slice_docs))
    own = corpus.select(F.col(key).alias("key"), F.col(body).cast("string").alias("body"), F.lit(False).alias("gone")).where("key is not null")
    _write(_postings(own, buckets, slices, n), path, "postings", version)
    state = {"buckets": buckets, "slices": slices, "postings": _found(spark, path, "postings", version), "docs": {}, "words": {}}
    _write(_documents(own.select("key"), _read(spark, path, "postings", state), buckets), path, "docs", version)
    _finish(spark, path, version, state)
    return version


def upsert(changes: DataFrame, path: str, key: str = "doc_id", body: str = "text", deleted: str | None = None) -> int:
    """Replaces, adds and removes documents; rewrites the buckets that these touch."""
    spark = changes.sparkSession
    state = commits.committed(spark, path)
    if state is None:
        gone = changes if deleted is None else changes.where(~F.coalesce(F.col(deleted), F.lit(False)))
        return rebuild(gone, path, key, body)
    version, buckets = _next(spark, path, state), state["buckets"]
    flag = F.lit(False) if deleted is None else F.coalesce(F.col(deleted), F.lit(False))
    rows = changes.select(F.col(key).alias("key"), F.col(body).cast("string").alias("body"), flag.alias("gone")).where("key is not null")
    keys = staged(rows.groupBy("key").agg(F.max("gone").alias("gone")))
    n = keys.count()
    if not n:
        return state["version"]
    _write(_postings(rows, buckets, state["slices"], n), path, "changes", version)
    new = _read(spark, path, "changes", {"changes": (found := _found(spark, path, "changes", version))})
    changed = keys.select("key")
    changed = F.broadcast(changed) if n <= SENT_KEYS and changed.schema["key"].dataType.simpleString() in ("int", "bigint") else small(changed)

    touched = sorted(r.b for r in keys.select(bucket("key", buckets).alias("b")).distinct().collect())  # at most ``buckets`` numbers
    now, held = _documents(keys.where("not gone"), new, buckets), 0
    before = _read(spark, path, "docs", state, touched)
    if before is not None:
        held = before.join(changed, "key", "left_semi").agg(F.bit_or("held").alias("held")).first().held or 0
        now = before.join(changed, "key", "left_anti").select("key", "len", "held", "bucket").unionByName(now)
    _write(now, path, "docs", version)
    state["docs"] = {b: v for b, v in state["docs"].items() if int(b) not in touched} | _found(spark, path, "docs", version)

    hit = [b for b in range(buckets) if str(b) in found or held >> (b % 64) & 1]
    old = _read(spark, path, "postings", state, hit)
    left = [] if old is None else [old.join(changed, "key", "left_anti")]
    both = [x.select("token", "key", "tf", "len", "bucket") for x in (*left, *([] if new is None else [new]))]
    if both:
        _write(both[0] if len(both) == 1 else both[0].unionByName(both[1]), path, "postings", version)
    state["postings"] = {b: v for b, v in state["postings"].items() if int(b) not in hit}
    _finish(spark, path, version, state)
    commits.remove(spark, f"{path}/changes")
    return version


def refresh(corpus: DataFrame, path: str, at: str, since, overlap: str = "1 hour", key: str = "doc_id", body: str = "text") -> int:
    """Upserts the rows changed from ``since`` on, less an overlap for what arrived late; the repeated ones change nothing."""
    return upsert(corpus.where(F.col(at) >= F.lit(since).cast("timestamp") - F.expr(f"interval {overlap}")), path, key, body)


def share(tf: Column, length: Column, mean: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean)))


def ask(spark: SparkSession, path: str, queries: DataFrame, k: int, query_key: str = "item_id", query_body: str = "text", k1: float = 1.5, b: float = 0.75, floor_share: float = 0.25, seeds: int = 10, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best documents of each query by BM25, scores to six places, ties by key.

    The scores are those of ``retrieve.bm25``.  Only the postings of the queries' tokens are read.
    """
    return top(scores(spark, path, queries, k, query_key, query_body, k1, b, floor_share, seeds, direct_rows), k, "score", "key")


def scores(spark: SparkSession, path: str, queries: DataFrame, k: int, query_key="item_id", query_body="text", k1=1.5, b=0.75, floor_share=0.25, seeds=10, direct_rows=DIRECT_ROWS) -> DataFrame:
    """Whole scores of the documents that may be among a query's ``k`` best."""
    empty = spark.createDataFrame([], f"query_id {queries.schema[query_key].dataType.simpleString()}, key bigint, score double")
    state = commits.committed(spark, path)
    if state is None or not state["postings"]:
        return empty
    mean = state["total"] / max(1, state["n"])
    asked = queries.select(F.col(query_key).alias("query_id"), F.explode(tokens(F.col(query_body))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    some = [r.b for r in asked.select(bucket("token", state["buckets"]).alias("b")).distinct().collect()]  # at most ``buckets`` numbers
    own = _read(spark, path, "postings", state, some)
    if own is None:
        return empty
    wanted = small(asked.select("token").distinct())
    words = _read(spark, path, "words", state, some).join(wanted, "token").select("token", "df", share(F.col("most"), F.col("shortest"), mean, k1, b).alias("bound"))
    words = staged(words.withColumn("number", F.monotonically_increasing_id()))
    weight = F.when(idf(state["n"]) < 0, F.lit(floor_share * state["mean_idf"])).otherwise(idf(state["n"])) * F.col("times")
    by = Window.partitionBy("query_id")
    rare = by.orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    terms = asked.join(words, "token").withColumn("weight", weight).withColumn("reach", F.greatest(F.col("weight"), F.lit(0.0)) * F.col("bound"))
    terms = terms.withColumn("seen", F.coalesce(F.sum("df").over(rare), F.lit(0))).withColumn("lowest", F.min("weight").over(by)).withColumn("all", F.sum("reach").over(by))
    terms = staged(terms.select("query_id", "number", "df", "weight", "reach", "seen", "lowest", "all"))
    volume = terms.agg(F.sum("df").alias("rows")).first().rows or 0
    terms = small(terms)
    own = own.join(small(words.select("token", "number")), "token").select("number", "key", "tf", "len")
    gain, part = share(F.col("tf"), F.col("len"), mean, k1, b), F.col("weight") * F.col("gain")

    def summed(own_terms: DataFrame, rows: int, only: Column = F.lit(True)) -> DataFrame:
        """What some terms give to all documents.  A document's postings go to one place, and products and sums stay there."""
        placed = own.repartition(_tasks(spark, state["n"], rows), "key").select("number", "key", gain.alias("gain"))
        return placed.join(own_terms, "number").where(only).groupBy("query_id", "key").agg(F.sum(part).alias("part"))

    if volume <= direct_rows:
        return summed(terms.select("query_id", "number", "weight"), volume).select("query_id", "key", F.round("part", 6).alias("score")).where("score > 0")

    def added(pairs: DataFrame, own_terms: DataFrame) -> DataFrame:
        """What some terms give to some documents: postings of these are put together by document, and meet its queries there."""
        near = small(own_terms.select("query_id", "number", "weight"))
        listed = own.join(small(own_terms.select("number").distinct()), "number").join(small(pairs.select("key").distinct()), "key")  # the others aren't moved
        held = listed.groupBy("key").agg(F.collect_list(F.struct("number", gain.alias("gain"))).alias("held"))
        met = pairs.select("query_id", "key").join(held, "key").select("query_id", "key", F.explode("held").alias("d")).select("query_id", "key", "d.number", "d.gain")
        return met.join(near, ["query_id", "number"]).groupBy("key", "query_id").agg(F.sum(part).alias("part")).select("query_id", "key", "part")

    # The floor: the k-th best whole score among documents that the rarest terms propose; weights below zero allow none.
    seed_terms = terms.where((F.col("seen") < seeds * k) & (F.col("lowest") >= 0)).select("query_id", "number", "weight")
    seed = own.select("number", "key", gain.alias("gain")).join(small(seed_terms), "number").groupBy("query_id", "key").agg(F.sum(part).alias("part"))
    seed = staged(top(seed, 2 * k, "part", "key").select("query_id", "key"))
    whole = added(seed, terms).withColumnRenamed("part", "score")
    floors = top(whole, k, "score", "key").where(F.col("rank") == k).select("query_id", (F.col("score") - ROOM).alias("floor"))

    # Terms in order of reach: those that stay below the floor together propose nothing.
    ordered = by.orderBy("reach", "number").rowsBetween(Window.unboundedPreceding, 0)
    judged = terms.select("query_id", "number", "df", "weight", "reach", "all").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-1e300))).withColumn("below", F.sum("reach").over(ordered))
    judged = staged(judged.withColumn("proposes", F.col("below") >= F.col("floor")))
    proposed = judged.where("proposes").agg(F.sum("df").alias("rows")).first().rows or 0
    if WORTH * proposed > volume:
        least = small(judged.select("query_id", "floor").distinct())
        return summed(terms.select("query_id", "number", "weight"), volume).join(least, "query_id").where(F.col("part") >= F.col("floor")).select("query_id", "key", F.round("part", 6).alias("score")).where("score > 0")
    possible = F.greatest(part, F.lit(0.0)) + F.col("all") - F.col("reach") >= F.col("floor")
    first = summed(small(judged.where("proposes")), proposed, possible)
    rest = judged.groupBy("query_id").agg(F.max("floor").alias("floor"), F.coalesce(F.sum(F.when(~F.col("proposes"), F.col("reach"))), F.lit(0.0)).alias("rest"))
    left = staged(first.join(small(rest), "query_id").where(F.col("part") + F.col("rest") >= F.col("floor")).select("query_id", "key", "part"))
    every = left.unionByName(added(left, judged.where("not proposes")))
    return every.groupBy("query_id", "key").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")


def staged(df: DataFrame) -> DataFrame:
    """Cuts the plan: writes a table to the shared folder and reads it again."""
    path = shared_path(df.sparkSession, "postings")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
