"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import posixpath
import re
import tempfile
import uuid
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_column(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and everything runs on one machine a local one is chosen.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + posixpath.join(tempfile.gettempdir(), f"sievemark-{spark.sparkContext.applicationId}")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables staged by the operators that run now, innermost last.
_staged: ContextVar[tuple[list[str], ...]] = ContextVar("staged", default=())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it again."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if _staged.get():
        _staged.get()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidied(operator):
    """An operator whose result is staged and whose other staged tables are deleted."""

    @functools.wraps(operator)
    def run(*args, **settings):
        own: list[str] = []
        token = _staged.set((*_staged.get(), own))
        try:
            out = operator(*args, **settings)
        finally:
            _staged.reset(token)
        out = staged(out, operator.__name__)
        deleted(out.sparkSession, own)
        return out

    return run


def deleted(spark: SparkSession, folders) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(df: DataFrame, key: str, rows: int, total: int, seed: int = 0) -> DataFrame:
    """The ``rows`` rows of smallest key hash, of ``total``; rows that can't be among them are dropped before the sort."""
    h = F.xxhash64(F.lit(seed), key)
    if total > 2 * rows + 1000:
        share = (1.5 * rows + 200) / total
        df = df.where(F.pmod(h, F.lit(1 << 32)) < int(share * (1 << 32)))
    return df.orderBy(F.pmod(h, F.lit(1 << 32)), h, key).limit(rows)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.startswith(shared_dir(spark).replace("file:///", "file:/").rstrip("/")) or folder.startswith(shared_dir(spark)):
                deleted(spark, [folder])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow file system and path for a shared folder (file, hdfs, s3, gs)."""
    if uri.startswith("file:") or uri.startswith("/"):
        path = "/" + uri.removeprefix("file:").lstrip("/")
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(uri)


def released() -> None:
    """Gives freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def tidy(batches):
    """The batches, with freed memory given back after each."""
    for b in batches:
        yield b
        del b
        released()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and each row's bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, most: int):
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


#: An odd base for polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept between calls up to a few million."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 20)
        a = np.full(size, base & (2**64 - 1), np.uint64)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if size <= 1 << 22:
            _powers[base] = have
    return have


class Rolling:
    """Hashes of any slices of one byte array from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE_INVERSE, n)[:n], out=self.sums[1:])
        self.powers = powers(BASE, n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.powers[end])


def rows_kept(docs: DataFrame, keep) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``keep(batch)`` marks."""

    def run(batches):
        for b in tidy(batches):
            if b.num_rows:
                yield b.filter(pa.array(keep(b), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
