"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on a sample (``fit_rows``, by default one in 17 rows, at least
20,000 and at most 1,000,000), so that leaves hold about ``leaf_rows`` vectors up to
17 million and the tree, which all tasks get, stays below about 60 MB; every vector
is put into it.  Inner products become distances by one more component, sqrt(M^2 - |x|^2)
with M the largest norm, which is 0 for queries.  A query walks the tree
best-bin-first: a priority queue of nodes by distance to their centroids yields
leaves in turn.  How many leaves are visited is calibrated: for a bounded sample
of queries the true neighbours are found among all rows, and visits are widened
until they hold ``recall`` of them.  A query whose leaves hold fewer than ``k`` other
vectors goes on down its queue.

Neighbouring leaves make buckets of about ``GROUP`` vectors; a larger leaf makes
several groups, its vectors dealt by a hash of the id.  A query goes once to each
group that holds leaves it visits, with a bitmap of those.  A task reads a group's
vectors first and then streams the queries past them, so its memory is bounded by
``GROUP``; the groups' top lists are merged by query.

Scores are sums of double products in a fixed order, so equal vectors tie.

Defined cases: vectors that are null, empty, zero, of another length than most,
or that hold null or non-finite components take no part, nor do rows with a null
id; rows with equal ids are one row's copies and never each other's neighbours;
fewer candidates than ``k`` are all returned; empty tables give an empty result;
columns besides id and vector are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import hash_sample, mix, staged, tidied, tidy

#: Vectors of a group, about.
GROUP = 8192
#: Distances of a block of queries to nodes, at most (8 bytes each).
CELLS = 4 << 20


@dataclass
class Tree:
    centroids: np.ndarray  # of all nodes; 0 is the root
    children: list[list[int]]
    norm: float

    def wide(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that turns inner products into distances."""
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))
        return np.column_stack([x, rest])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest child at every level."""
        at, x = np.zeros(len(x), np.int64), self.wide(x)
        todo = {0: np.arange(len(x))} if self.children[0] else {}
        while todo:
            node, rows = todo.popitem()
            c = np.array(self.children[node])
            d = (self.centroids[c] ** 2).sum(axis=1) - 2 * x[rows] @ self.centroids[c].T
            to = c[d.argmin(axis=1)]
            at[rows] = to
            for child in np.unique(to):
                if self.children[child]:
                    todo[int(child)] = rows[to == child]
        return at

    def visits(self, q: np.ndarray, most: int, count: np.ndarray | None = None, least: int = 0) -> list[list[int]]:
        """For each query its first ``most`` leaves, best bin first, and more until these hold ``least`` vectors of ``count``."""
        q, square = np.column_stack([q, np.zeros(len(q))]), (self.centroids**2).sum(axis=1)
        # where few leaves are visited, only the nodes that the queue reaches are measured
        known = square - 2 * q @ self.centroids.T if 16 * most > len(self.children) else None
        out = []
        for i in range(len(q)):
            heap, leaves, held = [(0.0, 0)], [], 0
            while heap and (len(leaves) < most or held < least):
                node = heapq.heappop(heap)[1]
                below = self.children[node]
                if not below:
                    leaves.append(node)
                    held += 0 if count is None else int(count[node])
                    continue
                d = known[i, below] if known is not None else square[below] - 2 * self.centroids[below] @ q[i]
                for c, x in zip(below, d.tolist()):
                    heapq.heappush(heap, (x, c))
            out.append(leaves)
        return out

    def leaves(self) -> int:
        return sum(not c for c in self.children)

    def in_order(self) -> list[int]:
        """All leaves, those of one branch side by side."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            if self.children[node]:
                todo += reversed(self.children[node])
            else:
                out.append(node)
        return out


@dataclass
class Groups:
    """Where leaves' vectors and visiting queries go."""

    bucket: np.ndarray  # of each node
    place: np.ndarray  # of each leaf in its bucket
    size: list[int]  # leaves of each bucket
    parts: np.ndarray  # groups of each bucket
    first: np.ndarray  # number of its first group
    count: np.ndarray  # vectors of each leaf


def grouped(tree: Tree, count: dict[int, int]) -> Groups:
    """Buckets of neighbouring leaves with about GROUP vectors each."""
    bucket, place = np.zeros(len(tree.children), np.int64), np.zeros(len(tree.children), np.int64)
    size, rows = [], []
    for leaf in tree.in_order():
        n = count.get(leaf, 0)
        if not size or rows[-1] and rows[-1] + n > GROUP:
            size.append(0)
            rows.append(0)
        bucket[leaf], place[leaf] = len(size) - 1, size[-1]
        size[-1] += 1
        rows[-1] += n
    parts = np.maximum(1, -(-np.array(rows) // GROUP))
    rows_of = np.zeros(len(tree.children), np.int64)
    rows_of[list(count)] = list(count.values())
    return Groups(bucket, place, size, parts, np.cumsum(parts) - parts, rows_of)


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 10) -> np.ndarray:
    """Labels of at most ``k`` clusters by Lloyd's rounds."""
    centers = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = ((centers**2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)
        used = np.unique(label)
        centers = np.stack([x[label == c].mean(axis=0) for c in used])
    return ((centers**2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)


def fit_tree(sample: np.ndarray, norm: float, leaf_rows: int, branch: int, seed: int = 7) -> Tree:
    """Splits nodes of more than ``leaf_rows`` sample rows into ``branch`` clusters."""
    tree = Tree(np.zeros((0, 0)), [], norm)
    rng, x = np.random.default_rng(seed), tree.wide(sample)
    centroids, todo = [x.mean(axis=0) if len(x) else np.zeros(sample.shape[1] + 1)], [(0, np.arange(len(x)))]
    tree.children.append([])
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf_rows:
            continue
        label = kmeans(x[rows], min(branch, -(-len(rows) // leaf_rows) + 1), rng)
        parts = [rows[label == c] for c in np.unique(label)]
        if len(parts) < 2:
            continue
        for p in parts:
            tree.children[node].append(len(centroids))
            tree.children.append([])
            todo.append((len(centroids), p))
            centroids.append(x[p].mean(axis=0))
    tree.centroids = np.stack(centroids)
    return tree


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best(q_id: np.ndarray, q: np.ndarray, x_id: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query row, id, score) of each query's best ``k`` of ``x`` that reach its floor, with equal ids left out."""
    rough = q @ x.T
    rough[q_id[:, None] == x_id[None, :]] = -np.inf
    floor = np.full(len(q_id), -np.inf) if floor is None else floor.copy()
    open_ = np.flatnonzero(floor == -np.inf)
    if len(x_id) > k and len(open_):
        floor[open_] = np.partition(rough[open_], len(x_id) - k, axis=1)[:, len(x_id) - k]
    slack = 1e-9 * (1 + np.abs(q).sum(axis=1) * np.abs(x).max(initial=0.0))
    i, j = np.nonzero((rough >= (floor - slack)[:, None]) & (rough > -np.inf))
    score = np.empty(len(i))
    for lo in range(0, len(i), 1 << 16):
        a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        score[lo : lo + (1 << 16)] = (q[a] * x[b]).sum(axis=1)
    if len(x_id) <= k or len(i) <= k * len(q_id):
        return i, x_id[j], score
    order = np.lexsort((x_id[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, np.arange(len(q_id)))
    top = np.arange(len(i)) - first[i] < k
    return i[top], x_id[j[top]], score[top]


class Tops:
    """Running best lists by query, and from them the score that a new one has to reach."""

    def __init__(self, k: int, most: int = 200_000):
        self.k, self.most = k, most
        self.clear()

    def clear(self) -> None:
        self.parts, self.held, self.reduced = [], 0, 0
        self.known, self.least = np.zeros(0, np.int64), np.zeros(0)

    def floor(self, q_id: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(q_id), -np.inf)
        at = np.minimum(np.searchsorted(self.known, q_id), len(self.known) - 1)
        return np.where(self.known[at] == q_id, self.least[at], -np.inf)

    def add(self, q_id, v_id, score) -> None:
        self.parts.append((q_id, v_id, score))
        self.held += len(q_id)
        if self.held > max(self.most, 2 * self.reduced):
            self.reduce()

    def reduce(self) -> None:
        q, v, s = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        again = np.zeros(len(q), bool)
        again[1:] = (q[1:] == q[:-1]) & (v[1:] == v[:-1])
        q, v, s = q[~again], v[~again], s[~again]
        new = np.ones(len(q), bool)
        new[1:] = q[1:] != q[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        top = np.arange(len(q)) - first < self.k
        last = np.arange(len(q)) - first == self.k - 1
        self.known, self.least = q[last], s[last]
        self.parts, self.reduced = [(q[top], v[top], s[top])], int(top.sum())
        self.held = self.reduced

    def flush(self):
        """The lists so far."""
        if self.parts:
            self.reduce()
            q, v, s = self.parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])
        self.clear()


NAMES, GROUP_ROWS = ["key", "kind", "ids", "v", "more"], "key long, kind int, ids binary, v binary, more binary"
RESULT = "query_id long, vec_id long, score double"


def asks(tree: Tree, g: Groups, batches, visits: int, least: int):
    """Queries (id, v) with the leaves that they visit, a row for each group and block of queries.

    A block has so few queries that their distances to all nodes, and the leaves they visit, stay below ``CELLS`` numbers.
    """
    block = max(1, min(4096, CELLS // len(tree.children)))
    for b in tidy(batches):
        if not b.num_rows:
            continue
        every_id, every_q = b.column(0).to_numpy(), matrix(b.column(1))
        for lo in range(0, len(every_id), block):
            ids, q = every_id[lo : lo + block], every_q[lo : lo + block]
            leaves = [np.array(x, np.int32) for x in tree.visits(q, visits, g.count, least)]
            row, leaf = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in leaves]), np.concatenate(leaves)
            order = np.argsort(g.bucket[leaf], kind="stable")
            row, leaf = row[order], leaf[order]
            bucket = g.bucket[leaf]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            out, held = [[] for _ in NAMES], 0
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                one = int(bucket[a])
                rows, back = np.unique(row[a:z], return_inverse=True)
                seen = np.zeros((len(rows), g.size[one]), bool)
                seen[back, g.place[leaf[a:z]]] = True
                blobs = (ids[rows].tobytes(), q[rows].tobytes(), np.packbits(seen, axis=1).tobytes())
                for part in range(int(g.parts[one])):
                    for o, v in zip(out, (int(g.first[one]) + part, 1, *blobs)):
                        o.append(v)
                held += sum(map(len, blobs))
                if held > 16 << 20:
                    yield group_rows(out)
                    out, held = [[] for _ in NAMES], 0
            yield group_rows(out)


def group_rows(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], NAMES)


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, as doubles."""
    v = vectors[vector_col].cast("array<double>")
    ok = v.isNotNull() & vectors[id_col].isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v")).where(ok)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common.n if common else 0))


def top_k(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


@tidied
def nearest(vectors: DataFrame, query_filter, k: int = 20, id_col="vec_id", vector_col="embedding", recall: float = 0.96, fit_rows: int | None = None, leaf_rows: int = 200, branch: int = 16, calibration: int = 200) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row that ``query_filter(id)`` picks."""
    spark = vectors.sparkSession
    rows = staged(taking_part(vectors, id_col, vector_col), "vectors")
    about = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).first()
    if not about.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fit_rows = fit_rows or min(1_000_000, max(20_000, about.n // 17))
    sample = hash_sample(rows, "id", fit_rows, about.n).select("v").toArrow()  # at most fit_rows vectors
    sample = matrix(sample.column("v").combine_chunks())
    share = len(sample) / about.n
    tree = fit_tree(sample, float(np.sqrt(about.norm)) * (1 + 1e-12), max(12, int(leaf_rows * share)), branch)
    sent = spark.sparkContext.broadcast(tree)
    queries = rows.where(query_filter(F.col("id")))

    # true neighbours of the calibration queries among all rows, and the leaves that hold them
    asked = hash_sample(queries, "id", calibration, queries.count(), 1).toArrow()  # at most ``calibration`` vectors
    a_id, a = asked.column("id").to_numpy(), matrix(asked.column("v").combine_chunks())
    asked = spark.sparkContext.broadcast((a_id, a))

    def brute(batches):
        ids, q = asked.value
        tops = Tops(k)
        for b in tidy(batches):
            if b.num_rows and len(ids):
                x_id = b.column(0).to_numpy()
                i, v, s = best(ids, q, x_id, matrix(b.column(1)), k)
                tops.add(ids[i], v, s)
        yield from tops.flush()

    visits = 1
    if len(a_id):
        true = top_k(rows.mapInArrow(brute, RESULT), k).select("query_id", "vec_id")

        def placed(batches):
            for b in tidy(batches):
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent.value.leaf(matrix(b.column(2))))], ["query_id", "vec_id", "leaf"])

        where = true.join(rows.withColumnRenamed("id", "vec_id"), "vec_id").select("query_id", "vec_id", "v").mapInArrow(placed, "query_id long, vec_id long, leaf long").toPandas()  # calibration * k rows
        order = {int(i): {leaf: r for r, leaf in enumerate(ls)} for i, ls in zip(a_id, tree.visits(a, tree.leaves()))}
        ranks = np.sort([order[q][leaf] for q, leaf in zip(where.query_id, where.leaf)])
        if len(ranks):
            visits = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1

    def assign(batches):
        for b in tidy(batches):
            if b.num_rows:
                yield b.append_column("leaf", pa.array(sent.value.leaf(matrix(b.column(1)))))

    assigned = staged(rows.mapInArrow(assign, "id long, v array<double>, leaf long"), "assigned")
    groups = grouped(tree, {r.leaf: r["count"] for r in assigned.groupBy("leaf").count().collect()})  # one row a leaf
    where = spark.sparkContext.broadcast(groups)

    def put(batches):
        for b in tidy(batches):
            if not b.num_rows:
                continue
            ids, x, leaf, g = b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy(), where.value
            at = g.bucket[leaf]
            key = g.first[at] + (mix(ids.view(np.uint64)) % g.parts[at].astype(np.uint64)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(key)]])
            parts = [order[a:b] for a, b in zip(cut[:-1], cut[1:])]
            blobs = [pa.array([y[p].tobytes() for p in parts], pa.binary()) for y in (ids, x, g.place[leaf])]
            yield pa.RecordBatch.from_arrays([pa.array([int(key[p[0]]) for p in parts], pa.int64()), pa.array([0] * len(parts), pa.int32()), *blobs], NAMES)

    def ask(batches):
        yield from asks(sent.value, where.value, batches, visits, k + 1)

    def meet(batches):
        tops, now, held, x_id = Tops(k), None, [], None
        for b in tidy(batches):
            for key, kind, ids, v, more in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    yield from tops.flush()
                    now, held, x_id = key, [], None
                ids = np.frombuffer(ids, np.int64)
                v = np.frombuffer(v, np.float64).reshape(len(ids), -1)
                if kind == 0:
                    held.append((ids, v, np.frombuffer(more, np.int64)))
                    continue
                if not held:
                    continue
                if x_id is None:
                    x_id, x, leaf = (np.concatenate(c) for c in zip(*held))
                    order = np.argsort(leaf, kind="stable")
                    x_id, x, leaf = x_id[order], x[order], leaf[order]
                    edge = np.searchsorted(leaf, np.arange(leaf[-1] + 2))
                seen = np.unpackbits(np.frombuffer(more, np.uint8).reshape(len(ids), -1), axis=1).view(bool)
                for lo in range(0, len(ids), 1024):
                    for n in range(min(seen.shape[1], len(edge) - 1)):
                        rows = lo + np.flatnonzero(seen[lo : lo + 1024, n])
                        if len(rows) and edge[n + 1] > edge[n]:
                            at = slice(edge[n], edge[n + 1])
                            i, w, s = best(ids[rows], v[rows], x_id[at], x[at], k, tops.floor(ids[rows]))
                            tops.add(ids[rows][i], w, s)
                    tops.reduce() if tops.parts else None
                yield from tops.flush()
        yield from tops.flush()

    both = assigned.mapInArrow(put, GROUP_ROWS).unionByName(queries.mapInArrow(ask, GROUP_ROWS))
    total = int(groups.parts.sum())
    found = both.repartition(total, "key").sortWithinPartitions("key", "kind").mapInArrow(meet, RESULT)
    return top_k(found, k).select("query_id", "rank", "vec_id", "score")
