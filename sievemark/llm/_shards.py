"""Deterministic range shards: which rows share a file follows from the rows alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import filesystem

#: Fewest and most bytes of a shard, the number of shards between these bounds, and fewest and most rows of the sample.
LEAST, MOST, SHARDS, FEW, MANY = 4 << 20, 256 << 20, 2048, 1 << 16, 1 << 23


def range_shards(rows: DataFrame, id_col: str, size: Column, tie: str, more: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``rows`` with a column ``shard``, each shard in a partition of its own, and the number of shards.

    Shards are ranges of (id, tie), nulls first, of about equal bytes.  Their bounds come
    from a sample chosen by a hash of (id, tie), one row in so many that it has about MANY
    rows at most: they don't depend on partitions, order or settings.  Rows of ``more``
    are dealt with the others and count for nothing.
    """
    spark = rows.sparkSession
    total = rows.count()
    every = max(1, total // min(MANY, max(FEW, total // 8000)))
    key = [F.coalesce(F.col(id_col), F.lit(-(1 << 63))).alias("id"), F.col(tie).alias("tie")]
    sample = rows.select(*key, size.cast("long").alias("size")).where(F.pmod(F.xxhash64("id", "tie"), F.lit(every)) == 0)
    sample = sample.groupBy("id", "tie").agg(F.sum("size").alias("size")).toArrow()  # about MANY rows at most
    ids, ties, sizes = (c.to_numpy() for c in sample.columns)
    order = np.lexsort((ties, ids))
    ids, ties, filled = ids[order], ties[order], np.cumsum(sizes[order].astype(float)) * every
    bytes_ = float(filled[-1]) if len(filled) else 0.0
    wide = min(MOST, max(LEAST, bytes_ / SHARDS))
    last = np.searchsorted(filled, wide * np.arange(1, max(1, int(bytes_ / wide))))
    last = np.unique(last[last < len(ids) - 1])  # the last row of each shard but one
    bounds = spark.sparkContext.broadcast((ids[last], ties[last]))

    @F.pandas_udf("int")
    def shard(i: pd.Series, t: pd.Series) -> pd.Series:
        a, b = bounds.value
        i, t = i.to_numpy(np.int64), t.to_numpy(np.int64)
        lo, hi = np.searchsorted(a, i), np.searchsorted(a, i, "right")
        out = lo.copy()
        for k in np.flatnonzero(hi > lo):  # an id that is cut: count the bounds below the tie
            out[k] += np.searchsorted(b[lo[k] : hi[k]], t[k])
        return pd.Series(out.astype(np.int32))

    n = len(last) + 1
    rows = rows if more is None else rows.unionByName(more)
    return rows.withColumn("shard", shard(*key)).repartitionById(n, "shard"), n


def shard_slices(b: pa.RecordBatch):
    """(shard, its rows) of a batch that is sorted by shard."""
    shard = b.column("shard").to_numpy()
    edge = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else [0]
    for lo, hi in zip(edge[:-1], edge[1:]):
        yield int(shard[lo]), b.slice(lo, hi - lo)


def cleaned(folder: str) -> None:
    """Deletes temporary files that failed or repeated tasks left in an output folder."""
    store, root = filesystem(folder)
    for f in store.get_file_info(fs.FileSelector(root)):
        if f.base_name.startswith("_"):
            store.delete_file(f.path)
