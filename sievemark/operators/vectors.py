"""A vector index that is written once and asked often: lists around centres, with bounds that make the answer exact.

A list keeps the vectors that are nearest to its centre c and the largest distance r of any of them from it, so no
inner product of a question q with one of its vectors is above q.c + |q| r.  A question first reads the lists whose centres
are nearest, until they hold enough vectors; the k-th best of these is its floor, and then only lists whose
bound reaches the floor are read.  On vectors in clusters that is a small part of the table; on vectors
without structure it is most of it, and the answer is the same.

Centres come from a sample of at most ``sample`` vectors, chosen by a hash of the id, and are at most ``most_lists``;
every vector is indexed.  Large lists lie in parts of about ``rows`` vectors.  What no commit names isn't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.commits import commit, committed, tidy
from ..sources.shared import shared_path
from .caches import usable_vector
from .windows import numbered

SLACK = 1e-6
#: Questions and pairs that are computed at once, and bytes of the vectors of a block.
CHUNK, PIECE, BLOCK_BYTES = 256, 50_000, 16 << 20


def _centres(points: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from the first different points."""
    _, first = np.unique(points, axis=0, return_index=True)
    c = points[np.sort(first)[:lists]].copy()
    for _ in range(rounds):
        own = (points @ c.T - (c * c).sum(1) / 2).argmax(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, points)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(vector: Column, c: np.ndarray) -> Column:
    @F.pandas_udf("list int, distance double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        half = (c * c).sum(1) / 2
        for v in batches:
            if not len(v):
                yield pd.DataFrame({"list": np.zeros(0, np.int32), "distance": np.zeros(0)})
                continue
            x = np.stack([np.asarray(one, np.float64) for one in v])
            own = (x @ c.T - half).argmax(1)
            yield pd.DataFrame({"list": own.astype(np.int32), "distance": np.linalg.norm(x - c[own], axis=1)})

    return run(vector)


def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", sample: int = 20_000, most_lists: int = 1_024, rows: int = 50_000) -> None:
    """Writes the next version of the index under ``path`` and commits it.

    Rows with a null id and vectors that are null, empty, zero, not finite or of another length than
    most take no part; other columns aren't read.  Repeated ids are rows of their own.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("key").isNotNull() & usable_vector(F.col("v")))
    width = v.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    old = committed(spark, path)
    version = old["version"] + 1 if old else 0
    if width is None:
        commit(spark, path, version, {"vectors": {}, "centres": {}, "width": 0})
        return
    v = v.where(F.size("v") == width["w"])
    n = width["count"]
    mark = F.xxhash64("key", "v")
    some = v if n <= 2 * sample else v.where(F.pmod(mark, F.lit(1 << 30)) < math.ceil(1.5 * sample / n * (1 << 30)))
    some = some.orderBy(mark, "key", "v").limit(sample).select("v").toArrow()  # bounded by ``sample``
    c = _centres(_matrix(some.column("v")), max(1, min(most_lists, math.isqrt(n))))
    parts = max(1, -(-n // rows))
    dealt = v.withColumn("at", _nearest(F.col("v"), c)).select("key", "v", "at.*").withColumn("part", F.pmod(F.xxhash64("key", "v"), F.lit(parts)).cast("int"))
    table, centres = (f"{path}/{name}/version={version}" for name in ("vectors", "centres"))
    dealt.repartition("list", "part").write.mode("overwrite").partitionBy("list").parquet(table)
    sizes = spark.read.parquet(table).groupBy("list").agg(F.max("distance").alias("radius"), F.count("*").alias("n"))
    known = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "list int, centre array<double>")
    known.join(sizes, "list").coalesce(1).write.mode("overwrite").parquet(centres)  # at most ``most_lists`` rows
    commit(spark, path, version, {"vectors": {"0": version}, "centres": {"0": version}, "width": width["w"]})
    tidy(spark, path)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _dealt(c: np.ndarray, n: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Lists dealt to bins of about ``block`` vectors, neighbours together: first bin and pieces of each list, number of bins.  Lists above that have bins of their own."""
    first, pieces = np.zeros(len(c), int), np.maximum(1, -(-n // block))
    left, at, bins, held = np.ones(len(c), bool), 0, 0, 0
    for _ in range(len(c)):
        left[at] = False
        if held and (held + n[at] > block or pieces[at] > 1):
            bins, held = bins + 1, 0
        first[at] = bins
        held += n[at]
        if pieces[at] > 1:
            bins, held = bins + pieces[at], 0
        if left.any():
            far = ((c - c[at]) ** 2).sum(1)
            at = int(np.where(left, far, np.inf).argmin())
    return first, pieces, int(bins + (held > 0))


def _places(vector: Column, floor: Column, own: Column, c: np.ndarray, radius: np.ndarray, bin_of: tuple) -> Column:
    """The bins that a question still has to meet: those of lists whose bound reaches its floor, without its own."""
    first, pieces, _ = bin_of

    @F.pandas_udf("array<int>")
    def run(v: pd.Series, floor: pd.Series, own: pd.Series) -> pd.Series:
        out = np.empty(len(v), object)
        for start in range(0, len(v), CHUNK):
            q = np.stack([np.asarray(one, np.float64) for one in v.iloc[start : start + CHUNK]])
            bound, slack = _reach(q, c, radius)
            least = floor.iloc[start : start + CHUNK].fillna(-np.inf).to_numpy(np.float64)
            for i, near in enumerate(bound >= (least - slack)[:, None]):
                bins = {int(b) for j in np.flatnonzero(near) for b in range(first[j], first[j] + pieces[j])} - {int(own.iloc[start + i])}
                out[start + i] = sorted(bins)
        return pd.Series(out, v.index)

    return run(vector, floor, own)


def _reach(q: np.ndarray, c: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a list can give each question at most, and by how much a computed product may be off."""
    size = np.linalg.norm(q, axis=1)
    most = (np.linalg.norm(c, axis=1) + radius).max(initial=0)
    return q @ c.T + size[:, None] * radius, SLACK + 1e-12 * size * most


def _best(q: np.ndarray, floor: np.ndarray, rank: np.ndarray, own: np.ndarray, v: np.ndarray, c: np.ndarray, radius: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, vector, product) of all that can be among the ``k`` best of a question by rounded product and ``rank``, from its floor on.

    ``own`` is ascending and numbers the rows of ``c``.  Of equal products of a question the ``k`` of least rank stay.
    """
    ends = np.searchsorted(own, np.arange(len(c) + 1))
    found = []
    for start in range(0, len(q), CHUNK):
        some = q[start : start + CHUNK]
        bound, slack = _reach(some, c, radius)
        least, top, rows, cols, scores = floor[start : start + CHUNK].copy(), np.full((len(some), k), -np.inf), [], [], []
        for j in np.argsort(-bound.max(0, initial=-np.inf), kind="stable"):
            a, b = ends[j], ends[j + 1]
            near = np.flatnonzero(bound[:, j] >= least - slack) if b > a else ()
            if not len(near):
                continue
            s = some[near] @ v[a:b].T
            both = np.concatenate([top[near], s], axis=1)
            top[near] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            least[near] = np.maximum(least[near], top[near].min(1))
            x, y = np.nonzero(s >= (least - slack)[near][:, None])
            rows.append(near[x])
            cols.append(a + y)
            scores.append(s[x, y])
        if not rows:
            continue
        x, y, s = (np.concatenate(z) for z in (rows, cols, scores))
        fine = s >= (least - slack)[x]
        x, y = x[fine], y[fine]
        # in order of the components, as a column adds them up
        s = np.concatenate([np.cumsum(some[x[i : i + PIECE]] * v[y[i : i + PIECE]], axis=1)[:, -1] + 0.0 for i in range(0, len(x), PIECE)] or [np.zeros(0)])
        order = np.lexsort((rank[y], -s, x))
        x, y, s = x[order], y[order], s[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (s[1:] != s[:-1])
        at = np.arange(len(x))
        keep = at - np.maximum.accumulate(np.where(new, at, 0)) < k
        found.append((x[keep] + start, y[keep], s[keep]))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _fewer(v: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of at most ``k`` vectors of least rank of each that are equal."""
    _, same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((rank, same))
    at, sorted_ = np.arange(len(order)), same[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < k]


def _met(asked: DataFrame, stored: DataFrame, lists: np.ndarray, c: np.ndarray, radius: np.ndarray, k: int) -> DataFrame:
    """(query_id, key, score) of what can be among the ``k`` best, from questions and vectors of equal block and bin."""
    kinds = [asked.schema["query_id"].dataType.simpleString(), stored.schema["key"].dataType.simpleString()]

    def run(q: pa.Table, s: pa.Table) -> pa.Table:
        keys = s.column("key").combine_chunks()
        rank = np.empty(len(keys), np.int64)
        rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
        v, number = _matrix(s.column("v")), np.searchsorted(lists, s.column("list").to_numpy())
        if len(q) and len(v):
            kept = _fewer(v, rank, k)
            kept = kept[np.argsort(number[kept], kind="stable")]
            present, own = np.unique(number[kept], return_inverse=True)
            floor = pc.fill_null(q.column("floor"), -np.inf).to_numpy()
            x, y, score = _best(_matrix(q.column("q")), floor, rank[kept], own, v[kept], c[present], radius[present], k)
            y = kept[y]
        else:
            x, y, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return pa.table({"query_id": q.column("query_id").take(pa.array(x)), "key": keys.take(pa.array(y)), "score": pa.array(score)})

    both = asked.groupBy("block", "bin").cogroup(stored.groupBy("block", "bin"))
    return both.applyInArrow(run, f"query_id {kinds[0]}, key {kinds[1]}, score double").withColumn("score", F.round("score", 9))


def ask(spark: SparkSession, path: str, queries: DataFrame, k: int, query_key: str = "query_id", query_vector: str = "q", block: int = 20_000) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` largest inner products, to 9 places, ties to the smaller key.  Questions that can't be used have none.

    Lists are dealt to bins and questions to blocks, both of at most about ``block`` rows; a block meets its own bin first, which
    gives floors, and then the bins that reach one of them.  What a task holds is one block and one bin.  The
    questions with their floors and the first answers are written to the shared folder and stay there as long as the result may be read.
    """
    found = committed(spark, path)
    if found is None:
        raise ValueError(f"there is no index under {path}")
    q = queries.select(F.col(query_key).alias("query_id"), F.col(query_vector).cast("array<double>").alias("q"))
    q = q.where(usable_vector(F.col("q")) & (F.size("q") == found["width"]))
    if not found["vectors"]:
        return q.select("query_id", F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).where("false")
    number = found["vectors"]["0"]
    known = sorted(spark.read.parquet(f"{path}/centres/version={number}").collect(), key=lambda r: r["list"])  # at most ``most_lists``
    c, lists, radius, n = (np.array([r[x] for r in known]) for x in ("centre", "list", "radius", "n"))
    rows = min(block, max(2_000, int(n.sum()) // 16), max(256, BLOCK_BYTES // (8 * found["width"])))
    bin_of = _dealt(c, n, rows)
    places = F.broadcast(spark.createDataFrame([(int(a), int(b), int(m)) for a, b, m in zip(lists, *bin_of[:2])], "list int, first int, pieces int"))  # at most ``most_lists`` rows
    spot = lambda key: (F.col("first") + F.pmod(F.xxhash64(key), F.col("pieces"))).cast("int")
    table = spark.read.parquet(f"{path}/vectors/version={number}").select("list", "key", "v")

    nearest = F.element_at(F.array(*(F.lit(int(x)) for x in lists)), _nearest(F.col("q"), c)["list"] + 1)
    q = q.withColumn("list", nearest).join(places, "list").select("query_id", "q", spot("query_id").alias("own"))
    asked, first = shared_path(spark, "asked"), shared_path(spark, "first")
    q.write.parquet(asked)
    q = spark.read.parquet(asked)
    deal = q.groupBy("own").agg(F.ceil(F.count("*") / rows).cast("int").alias("deal"))  # as many rows as bins
    q = q.join(F.broadcast(deal), "own").withColumn("salt", F.pmod(F.xxhash64("query_id", "q"), F.col("deal")).cast("int"))
    q = q.select("query_id", "q", "own", (F.col("own").cast("long") * (1 << 32) + F.col("salt")).alias("block"))
    pairs = q.select("block", F.col("own").alias("bin")).distinct()

    def stored(pairs: DataFrame) -> DataFrame:
        bins = {r.bin for r in pairs.select("bin").distinct().collect()}  # as many as bins
        used = [int(x) for x, a, m in zip(lists, *bin_of[:2]) if any(b in bins for b in range(a, a + m))]
        return table.where(F.col("list").isin(used)).join(places, "list").select("list", "key", "v", spot("key").alias("bin")).join(pairs.toDF("block", "bin"), "bin")

    _met(q.select("query_id", "q", F.lit(None).cast("double").alias("floor"), "block", F.col("own").alias("bin")), stored(pairs), lists, c, radius, k).write.parquet(first)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    early = numbered(spark.read.parquet(first), best, lambda r: r <= k)
    floor = early.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    late = q.join(floor, "query_id", "left").withColumn("bins", _places(F.col("q"), F.col("floor"), F.col("own"), c, radius, bin_of))
    again = shared_path(spark, "asked")
    late.select("query_id", "q", "floor", "block", "bins").write.parquet(again)
    late = spark.read.parquet(again).select("query_id", "q", "floor", "block", F.explode("bins").alias("bin"))
    met = _met(late, stored(late.select("block", "bin").distinct()), lists, c, radius, k)
    every = early.unionByName(met).withColumn("rank", F.row_number().over(best))
    return every.where(F.col("rank") <= k)
