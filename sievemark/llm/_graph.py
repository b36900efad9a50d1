"""Connected components, and fixed-size tables gathered from all partitions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, staged, tidied, tidy

SLABS = 16


@tidied
def components(edges: DataFrame, jumps: int = 3) -> DataFrame:
    """(node, component) of every node in ``edges(a, b)``: the smallest node that can be reached.

    Each round points every node at its smallest neighbour, follows the pointers
    ``jumps`` times and contracts the edges, so a chain shrinks by a power of two a
    round and no group is gathered in one place.
    """
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        if parent.isEmpty():
            break
        for _ in range(jumps):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p").select("a", F.col("q").alias("p"))
        done = staged(parent, "parents")
        if labels is None:
            labels = done.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            up = done.select(F.col("a").alias("component"), "p")
            labels = staged(labels.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        left = edges.join(done, "a").select(F.col("p").alias("x"), F.col("b").alias("a")).join(done, "a").select("x", F.col("p").alias("y"))
        edges = staged(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def slab_rows(array: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A partition's part of a fixed-size table, cut into slabs; empty slabs are left out."""
    codec = pa.Codec("zstd", 1)
    cut = array.reshape(SLABS, -1)
    keep = [i for i in range(SLABS) if cut[i].any()]
    return keep, [codec.compress(np.ascontiguousarray(cut[i]).tobytes(), asbytes=True) for i in keep]


def gathered(slabs: DataFrame, dtype, size: int, how: str = "sum") -> np.ndarray:
    """Adds up (or ORs) the partitions' slabs (slab, blob); the result has ``size`` entries however large the input is."""
    each = size // SLABS * np.dtype(dtype).itemsize

    def add(batches):
        codec, total = pa.Codec("zstd", 1), {}
        for b in tidy(batches):
            for slab, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one = np.frombuffer(codec.decompress(blob, each, asbytes=True), dtype)
                total[slab] = one.copy() if slab not in total else total[slab] + one if how == "sum" else total[slab] | one
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([codec.compress(v.tobytes(), asbytes=True) for v in total.values()], pa.binary())], ["slab", "blob"])

    codec, out = pa.Codec("zstd", 1), np.zeros(size, dtype)
    cut = out.reshape(SLABS, -1)
    for r in slabs.select(F.col("slab").cast("int"), "blob").repartition(SLABS, "slab").mapInArrow(add, "slab int, blob binary").collect():  # at most SLABS rows
        cut[r.slab] = np.frombuffer(codec.decompress(bytes(r.blob), each, asbytes=True), dtype)
    return out


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


__all__ = ["components", "dropped", "gathered", "slab_rows", "staged", "union"]
