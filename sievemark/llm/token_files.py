"""Token ids in files of patched frame-of-reference blocks.

A file holds blocks of ``BLOCK`` ids.  Each block stores its minimum, the ids
less that minimum packed at a width that fits a given percentile of them, and
lists of the exceptions' places and values.  An index of block starts lets a
reader decode any range of ids; a second index has each document's id and count.

Layout, little-endian: ``SMPF``, u32 version; blocks (u32 minimum, u16 ids, u8
width, u8 zero, u16 exceptions, u16 zero, packed bits, u16 places, u32 values);
u64 block starts; i64 document ids, u8 flags of null ids, u32 counts; footer of
u64 index start, blocks, documents, ids, u32 crc32 of the indexes, ``SMPF``.

Documents are range-sorted by id into shards whose bounds follow from the rows
alone; each shard makes one file, written under a temporary name and renamed to
one fixed by its place, so that equal tables give equal files whatever the
partitions and settings, and a repeated task leaves the same file.  The driver
removes what failed tasks left and writes a manifest of one line a file.

Defined cases: null and empty texts are one end id; rows with equal ids stand
side by side, ordered by a hash of the text and the text; null ids come first; very long texts
are encoded whole; an empty table gives an empty manifest and an empty result; other columns aren't read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import filesystem, new_path, tidy
from ._shards import cleaned, range_shards, shard_slices
from ._tokenize import pieces, vocabulary_path

MAGIC, BLOCK = b"SMPF", 1024
HEAD, FOOT = struct.Struct("<IHBBHH"), struct.Struct("<QQQQI4s")


def encode_block(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """One block; the width fits the ``percentile`` of the ids less their minimum."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype("<u4")
    at = min(len(rest) - 1, int(percentile * len(rest)))
    width = int(np.partition(rest, at)[at]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    values = rest[over]
    kept = rest.copy()
    kept[over] = 0
    bits = np.unpackbits(kept.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return HEAD.pack(low, len(ids), width, 0, len(over), 0) + np.packbits(bits, bitorder="little").tobytes() + over.astype("<u2").tobytes() + values.tobytes()


def decode_block(raw: memoryview) -> np.ndarray:
    low, n, width, _, over, _ = HEAD.unpack_from(raw)
    at = HEAD.size
    size = (n * width + 7) // 8
    out = np.zeros((n, 32), np.uint8)
    out[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    ids = np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()
    at += size
    if over:
        places = np.frombuffer(raw, "<u2", over, at)
        ids[places] = np.frombuffer(raw, "<u4", over, at + 2 * over)
    return ids + np.uint32(low)


class Writer:
    """Streams documents into one file object."""

    def __init__(self, out, percentile: float = 0.9):
        self.out, self.percentile = out, percentile
        self.at, self.total = out.write(MAGIC + struct.pack("<I", 1)) or 8, 0
        self.at = 8
        self.blocks, self.docs, self.counts = [], [], []
        self.left: list[np.ndarray] = []
        self.waiting = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.total += len(ids)
        self.left.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.left) if self.left else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for lo in range(0, end, BLOCK):
            block = encode_block(ids[lo : min(lo + BLOCK, end)], self.percentile)
            self.blocks.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.left, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> dict:
        self.flush(True)
        index = np.array(self.blocks, "<u8").tobytes()
        index += np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array([d is None for d in self.docs], np.uint8).tobytes() + np.array(self.counts, "<u4").tobytes()
        self.out.write(index)
        self.out.write(FOOT.pack(self.at, len(self.blocks), len(self.docs), self.total, zlib.crc32(index), MAGIC))
        return {"blocks": len(self.blocks), "docs": len(self.docs), "ids": self.total, "bytes": self.at + len(index) + FOOT.size}


class Reader:
    """Reads one file: the document index, and ids of any range through the block starts."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        start, blocks, docs, self.total, crc, magic = FOOT.unpack(file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        index = file.read_at(size - FOOT.size - start, start)
        if zlib.crc32(index) != crc:
            raise ValueError("the index of a token file is damaged")
        self.blocks = np.append(np.frombuffer(index, "<u8", blocks), np.uint64(start)).astype(np.int64)
        null = np.frombuffer(index, np.uint8, docs, 8 * blocks + 8 * docs)
        self.docs = [None if z else int(d) for d, z in zip(np.frombuffer(index, "<i8", docs, 8 * blocks), null)]
        self.counts = np.frombuffer(index, "<u4", docs, 8 * blocks + 9 * docs).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (end - 1) // BLOCK + 1
        raw = memoryview(self.file.read_at(int(self.blocks[b] - self.blocks[a]), int(self.blocks[a])))
        got = np.concatenate([decode_block(raw[self.blocks[i] - self.blocks[a] : self.blocks[i + 1] - self.blocks[a]]) for i in range(a, b)])
        return got[start - a * BLOCK : end - a * BLOCK]

    def documents(self, at_once: int = 1 << 18):
        """(document id, its ids), in file order, decoding about ``at_once`` ids at a time."""
        ends = np.cumsum(self.counts)
        lo = 0
        while lo < len(self.docs):
            base = int(ends[lo] - self.counts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, base + at_once, "right")))
            ids = self.ids(base, int(ends[hi - 1]))
            for i in range(lo, hi):
                yield self.docs[i], ids[ends[i] - self.counts[i] - base : ends[i] - base]
            lo = hi


def renamed(store, held: str, name: str) -> None:
    """Commits a finished file; where a repeated task left it already, the new one replaces it."""
    try:
        store.move(held, name)
    except OSError:
        store.delete_file(name)
        store.move(held, name)


def write_token_files(docs: DataFrame, folder: str, id_col="doc_id", text_col="text", vocabulary: str | None = None, end_id=2, percentile=0.9) -> list[dict]:
    """Writes the files and ``manifest.json``; returns the manifest, one entry a file in id order."""
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)

    def run(batches):
        part, writer = None, None
        store, root = filesystem(folder)

        def closed():
            said = writer.close()
            out.close()
            name = f"part-{part:06d}.ids"
            renamed(store, held, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"part": pa.array([part]), "file": [name], **{k: pa.array([said[k]]) for k in ("docs", "ids", "blocks", "bytes")}})

        for b in tidy(batches):
            for shard, piece in shard_slices(b):
                if shard != part:
                    if writer is not None:
                        yield closed()
                    part, held = shard, f"{root}/_part-{shard:06d}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(held)
                    writer = Writer(out, percentile)
                for d, ids in zip(piece.column("id").to_pylist(), pieces(path, False).rows(piece.column("text"))):
                    writer.add(d, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            yield closed()

    read = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    dealt, _ = range_shards(read.withColumn("tie", F.xxhash64("text")), "id", 8 + F.coalesce(F.octet_length("text"), F.lit(0)), "tie")
    shards = dealt.sortWithinPartitions("shard", "id", "tie", "text").mapInArrow(run, "part long, file string, docs long, ids long, blocks long, bytes long")
    entries = sorted((r.asDict() for r in shards.collect()), key=lambda r: r["part"])  # one small row a file
    cleaned(folder)
    start = 0
    for e in entries:
        e["start"] = start
        start += e["ids"]
    held = f"{root}/_manifest.{uuid.uuid4().hex}"
    with store.open_output_stream(held) as out:
        out.write(json.dumps({"version": 1, "block": BLOCK, "files": entries}).encode())
    renamed(store, held, f"{root}/manifest.json")
    return entries


def read_manifest(folder: str) -> list[dict]:
    store, root = filesystem(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())["files"]


def read_token_files(spark: SparkSession, folder: str, id_col="doc_id") -> DataFrame:
    """Per document in the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = [(e["file"], int(e["start"])) for e in read_manifest(folder)]

    def run(batches):
        store, root = filesystem(folder)
        for b in tidy(batches):
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cols = [[], [], [], []]
                with store.open_input_file(f"{root}/{name}") as f:
                    for doc, ids in Reader(f).documents():
                        for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()))):
                            c.append(v)
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(files, "file string, start long").repartition(max(1, len(files)))
    return listed.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_file_round_trip(docs: DataFrame, **settings) -> DataFrame:
    """Writes the table to a new shared folder and reads it back."""
    folder = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, folder, **settings)
    return read_token_files(docs.sparkSession, folder)
