"""Removal of repeated byte strings with a sharded run-length suffix index.

A byte goes if it lies in a string of ``long`` bytes that also starts earlier
(smaller id, or earlier in the same document).

1. Every string of ``long`` bytes has an anchor: the k-gram in it with the
   smallest hash.  Strings in a row with equal anchors form a segment; equal
   strings always have equal anchors, so repeats meet in the anchor's shard.
   Of segments with the same content hash only the first of a batch travels on;
   the others are candidates, with the first as their source.
2. In a shard segments of all batches meet.  Those with the content hash of an
   earlier one are candidates too.  Anchors left with several different segments
   ("variants") are looked through by the index.
3. Candidates of a document that continue each other in the same source become
   runs.  Sources are cut into units of ``PIECE`` bytes; a run goes to the units
   that it lies in.
4. The bytes of variants, runs and sources are fetched from their documents and
   dealt by anchor or unit.  Each group builds a run-compressed Burrows-Wheeler
   transform with sampled run ends and streams the strings in question through
   it.  A place is a repeat if its match has ``long`` bytes and the first place of
   that match in the index comes earlier.  So hashes only bring strings together;
   what goes is decided by matching statistics over bytes.  Of variants, strings
   whose two halves (as hashes) don't both occur twice in the group are cut off
   first, which makes the index smaller.
5. Repeats are merged for each document and cut out of its text.

Anchors in very many segments, such as those at the border of a passage that stands
in a third of all documents, are found first by counting a sixteenth of the
documents; an anchor that still has more than ``CROWD`` different segments is found
in its shard.  Strings of both are dealt one by one by two hashes of the whole
string, so that no shard gets them together, and become candidates like others.  A
unit with very many runs is dealt to several groups, each with the unit's source.
Documents are moved only if a bitmap says they may be needed; it has 16 bits a
wanted document, up to 128 MB.

Defined cases: null and empty texts have no bytes; texts longer than ``CHUNK`` are
read whole, a chunk each; matches never cross documents; rows with equal id and text are one document, which repeats nothing
of itself by that; rows with one id and different texts are ordered by a hash of
the text; null ids come first; an empty table gives an empty result; columns
besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import MIX_A, Rolling, chunks, dropped, flat, mix, staged, tidy
from ._graph import gathered, slab_rows
from ._rindex import RunIndex

CHUNK = 2 << 20
#: Most bits of the bitmaps of documents.
BITMAP = 1 << 30
#: Segments of an anchor from which its strings are dealt one by one at once, the share of documents in which they are
#: counted (one in so many), and different segments of an anchor in a shard from which they are dealt so later.
HOT, COUNTED, CROWD = 1_000_000, 16, 8_192
#: Segments of one anchor shard, symbols of one index, and documents of one merge group, on average.
SHARE, SYMBOLS, GROUP = 400_000, 1_200_000, 20_000
#: Bytes of a source's unit, bytes of runs from which a unit is dealt to several groups, and strings of a streamed query.
PIECE, FULL, QUERY = 1 << 16, 32 << 20, 1024
CODEC = "zstd"
INNER = 1 << 14


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every ``width`` neighbours, by doubling."""
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = f(x[: len(x) - size], x[size:])
        size *= 2
    return f(x[:n], x[width - size : width - size + n])


def anchored(data: np.ndarray, bounds: np.ndarray, long: int, k: int):
    """(anchor, row, first place, end of places, k-gram hashes, rolling hash) of the segments of a chunk."""
    n = len(data)
    rolling = Rolling(data)
    at = np.arange(max(0, n - k + 1))
    h = rolling.of(at, at + k)
    if n < long:
        return *(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64)), h, rolling
    low = sliding(h, long - k + 1, np.minimum)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ok = row[: n - long + 1] == row[long - 1 :]
    edge = np.ones(len(low), bool)
    edge[1:] = (low[1:] != low[:-1]) | (ok[1:] != ok[:-1]) | (row[1 : len(low)] != row[: len(low) - 1])
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(low))
    start, end = start[ok[start]], end[ok[start]]
    return low[start], row[start], start, end, h, rolling


def occurrences(h, anchor, start, end, wide: int) -> np.ndarray:
    """How often each segment's anchor stands in its k-grams from ``start`` to ``end``."""
    out = np.zeros(len(start), np.int64)
    if not len(start):
        return out
    low = np.zeros(len(h) + wide, np.uint64)
    low[wide : len(h)] = sliding(h, wide + 1, np.minimum)
    at = np.flatnonzero(h == sliding(low, wide + 1, np.maximum))  # k-grams that are the smallest of a window
    a, z, d = np.searchsorted(at, start), np.searchsorted(at, end), 0
    todo = np.arange(len(start))
    while len(todo):
        out[todo] += h[at[a[todo] + d]] == anchor[todo]
        d += 1
        todo = todo[a[todo] + d < z[todo]]
    return out


def among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def lone(rolling: Rolling, at: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """An anchor of its own for each string of ``long`` bytes, and its content hash."""
    half = at + long // 2
    return mix(rolling.of(at, half) * MIX_A + rolling.of(half, at + long)), rolling.of(at, at + long)


def segments(data: np.ndarray, bounds: np.ndarray, long: int, k: int, hot: np.ndarray | None = None):
    """(anchor, row, first string's start in the row, strings, content hash) of all segments.

    The number of strings has INNER added where the anchor occurs more than once, so
    that the segment may repeat itself.  Segments of anchors in ``hot`` are cut into
    single strings with anchors of their own.
    """
    anchor, row, start, end, h, rolling = anchored(data, bounds, long, k)
    most = long - k + 1  # longer runs come from repeated k-grams
    if len(start) and (end - start).max() > most:
        parts = -(-(end - start) // most)
        first = np.repeat(start, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        end = np.minimum(first + most, np.repeat(end, parts))
        anchor, row, start = np.repeat(anchor, parts), np.repeat(row, parts), first
    count = end - start
    anchors = occurrences(h, anchor, start, start + count + long - k, long - k)
    content, many = rolling.of(start, end - 1 + long), count | np.where(anchors > 1, INNER, 0)
    if hot is not None and (of := among(hot, anchor)).any():
        n = count[of]
        one = np.repeat(start[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own, whole = lone(rolling, one, long)
        row, many = np.concatenate([row[~of], np.repeat(row[of], n)]), np.concatenate([many[~of], np.ones(len(one), many.dtype)])
        anchor, content = np.concatenate([anchor[~of], own]), np.concatenate([content[~of], whole])
        start = np.concatenate([start[~of], one])
    return anchor, row, start - bounds[row], many, content


def packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec(CODEC, 1).compress(raw, asbytes=True)


def unpacked(blob: bytes) -> bytes:
    return pa.Codec(CODEC).decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of ranges within each of ``doc`` (any integers that sort documents)."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    _, dense = np.unique(doc, return_inverse=True)
    base = dense.astype(np.int64) << 33
    reach = np.maximum.accumulate(base + end)
    new = np.ones(len(doc), bool)
    new[1:] = (base[1:] + start[1:]) > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - base[last]


def numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each combination of keys, in their order, and the first row of each number."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    row = np.empty(len(order), np.int64)
    row[order] = np.cumsum(new) - 1
    return row, order[new]


def runs(doc, tag, start, end, of_doc, of_tag, shift):
    """Candidates (bytes ``start`` to ``end``, found in ``of`` from ``start + shift``) that continue each other as one."""
    number, first = numbered(doc, tag, of_doc, of_tag, shift)
    which, start, end = merged(number, start, end)
    at = first[which]
    return doc[at], tag[at], start, end, of_doc[at], of_tag[at], shift[at]


def by_document(doc, tag, *more, groups: int):
    """Rows packed by a group of documents: lists of groups and blobs."""
    if not len(doc):
        return [], []
    group = (mix(doc.view(np.uint64) ^ tag.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    group, cols = group[order], [c[order].astype(np.int64) for c in (doc, tag, *more)]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    return [int(g) for g in group[cut[:-1]]], [packed(*(c[a:b] for c in cols)) for a, b in zip(cut[:-1], cut[1:])]


def hot_anchors(docs: DataFrame, long: int, k: int) -> np.ndarray:
    """Anchors of about HOT segments and more, sorted; at most all segments / HOT of them, twice that by chance."""

    def run(batches):
        for b in tidy(batches):
            data, bounds = flat(b.column(0))
            for lo, hi in chunks(bounds, CHUNK):
                a = anchored(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], long, k)[0]
                a, n = np.unique(a, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    part = docs.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(COUNTED)) == 0).select("text").mapInArrow(run, "anchor long, n long")
    many = part.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1, HOT // COUNTED)).select("anchor")
    return np.sort(many.toArrow().column(0).to_numpy().view(np.uint64))


NAMES = ["kind", "key", "blob", "doc", "tag", "anchor", "start", "count"]
SCHEMA = "kind int, key long, blob binary, doc long, tag long, anchor long, start long, count long"
SEGMENT, CANDIDATES, RANGES, VARIANT, CROWDED = range(5)


def blob_batch(kind: int, keys: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary()), *(pa.nulls(n, pa.int64()) for _ in range(5))], NAMES)


def segment_batch(a, row, start, count, content, doc, tag, shards: int) -> pa.RecordBatch:
    """SEGMENT rows (shard, packed segments)."""
    shard = (mix(a) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((a, shard))
    a, row, start, count, content, shard = (x[order] for x in (a, row, start, count, content, shard))
    cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    blobs = []
    for x, y in zip(cut[:-1], cut[1:]):
        rows, back = np.unique(row[x:y], return_inverse=True)
        step = a[x:y].copy()
        step[1:] -= a[x : y - 1]
        blobs.append(packed(np.array([y - x, len(rows)], np.int64), step, content[x:y], doc[rows], tag[rows], back.astype(np.uint32), start[x:y].astype(np.uint32), count[x:y].astype(np.uint16)))
    return blob_batch(SEGMENT, shard[cut[:-1]].tolist(), blobs)


def deal_segments(docs: DataFrame, long: int, k: int, shards: int, groups: int, hot) -> DataFrame:
    """Step 1: SEGMENT rows, and CANDIDATES rows (group, packed runs)."""

    def run(batches):
        for b in tidy(batches):
            if not b.num_rows:
                continue
            doc, tag = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            data, bounds = flat(b.column(2))
            parts = []
            for lo, hi in chunks(bounds, CHUNK):
                a, row, start, count, content = segments(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], long, k, hot.value)
                parts.append((a, row + lo, start, count, content))
            a, row, start, count, content = (np.concatenate(x) for x in zip(*parts))
            if not len(a):
                continue
            place = np.empty(len(doc), np.int64)  # of rows by id and text
            place[np.lexsort((tag, doc))] = np.arange(len(doc))
            order = np.lexsort((start, place[row], content, a))
            a, row, start, count, content = a[order], row[order], start[order], count[order], content[order]
            again, found = sources(a, content, doc[row], tag[row], start, count % INNER - 1 + long)
            yield blob_batch(CANDIDATES, *by_document(*found, groups=groups))
            yield segment_batch(*(x[~again] for x in (a, row, start, count, content)), doc, tag, shards)

    return docs.mapInArrow(run, SCHEMA)


def sources(a, content, doc, tag, start, size):
    """Of segments in order (anchor, content, document, start): which repeat an earlier one's content hash, and the runs of these."""
    again = np.zeros(len(a), bool)
    again[1:] = (a[1:] == a[:-1]) & (content[1:] == content[:-1])
    lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(a))))
    r = again & ~((doc == doc[lead]) & (tag == tag[lead]) & (start == start[lead]))  # else the same document once more
    of = lead[r]
    return again, runs(doc[r], tag[r], start[r], start[r] + size[r], doc[of], tag[of], start[of] - start[r])


def opened(blob: bytes):
    raw = unpacked(blob)
    n, rows = (int(v) for v in np.frombuffer(raw, np.int64, 2))
    at = 16
    out = []
    for kind, m in ((np.uint64, n), (np.uint64, n), (np.int64, rows), (np.int64, rows), (np.uint32, n), (np.uint32, n), (np.uint16, n)):
        out.append(np.frombuffer(raw, kind, m, at))
        at += m * np.dtype(kind).itemsize
    step, content, doc, tag, back, start, count = out
    return np.cumsum(step, dtype=np.uint64), content, doc[back], tag[back], start.astype(np.int64), count.astype(np.int64)


def match_segments(dealt: DataFrame, long: int, groups: int) -> DataFrame:
    """Step 2: CANDIDATES rows, and VARIANT or CROWDED rows of anchors with several contents."""

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [opened(x) for b in batches for x in b.column("blob").to_pylist()]
        a, content, doc, tag, start, count = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, tag, doc, content, a))
        a, content, doc, tag, start, count = (x[order] for x in (a, content, doc, tag, start, count))
        again, found = sources(a, content, doc, tag, start, count % INNER - 1 + long)
        yield blob_batch(CANDIDATES, *by_document(*found, groups=groups))
        a, doc, tag, start, count = (x[~again] for x in (a, doc, tag, start, count))
        several = count >= INNER
        same = a[1:] == a[:-1]
        several[1:] |= same
        several[:-1] |= same
        v = np.flatnonzero(several)
        n = len(v)
        crowd = np.repeat(*(lambda u: (u > CROWD, u))(np.unique(a[v], return_counts=True)[1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(crowd, CROWDED, VARIANT).astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(doc[v]), pa.array(tag[v]), pa.array(a[v].view(np.int64)), pa.array(start[v]), pa.array(count[v] % INNER)], NAMES)

    return dealt.where(F.col("kind") == SEGMENT).groupBy("key").applyInArrow(run, SCHEMA)


def bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of (doc, tag) with ``bits`` bits, a power of two."""

    def mark(batches):
        mine = np.zeros(bits, bool)
        for b in tidy(batches):
            if b.num_rows:
                mine[place_in(b, bits)] = True
        slab, blob = slab_rows(np.packbits(mine))
        yield pa.RecordBatch.from_arrays([pa.array(slab, pa.int32()), pa.array(blob, pa.binary())], ["slab", "blob"])

    return gathered(rows.select("doc", "tag").mapInArrow(mark, "slab int, blob binary"), np.uint8, bits // 8, "or")


def bits_for(rows: int) -> int:
    return min(BITMAP, 1 << max(20, (16 * rows).bit_length()))


def place_in(b: pa.RecordBatch, bits: int) -> np.ndarray:
    doc, tag = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (0, 1))
    return (mix(doc ^ mix(tag)) & np.uint64(bits - 1)).astype(np.int64)


def marked(b: pa.RecordBatch, table: np.ndarray) -> np.ndarray:
    at = place_in(b, 8 * len(table))
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def with_texts(docs: DataFrame, wants: DataFrame, temporary: list[DataFrame]) -> DataFrame:
    """(doc, tag, text, parts): of each wanted document its text and what is wanted of it."""
    wants = staged(wants.groupBy("doc", "tag").agg(F.collect_list("part").alias("parts")), "wants")  # bounded by the document's length
    temporary.append(wants)
    table = docs.sparkSession.sparkContext.broadcast(bitmap(wants, bits_for(wants.count())))

    def pick(batches):
        for b in tidy(batches):
            if b.num_rows:
                yield b.filter(pa.array(marked(b, table.value)))

    text = docs.mapInArrow(pick, "doc long, tag long, text binary").dropDuplicates(["doc", "tag"])
    return text.join(wants, ["doc", "tag"])


def parts_in(b: pa.RecordBatch):
    """(texts end to end, their bounds, row of each wanted part, fields of the parts)."""
    data, bounds = flat(b.column("text"))
    parts = b.column("parts")
    offsets, held = parts.offsets.to_numpy(), parts.values
    held = held.slice(offsets[0], offsets[-1] - offsets[0])
    row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
    return data, bounds, row, [held.field(i).to_numpy(zero_copy_only=False) for i in range(held.type.num_fields)]


def deal_crowded(docs: DataFrame, crowded: DataFrame, long: int, shards: int, temporary: list[DataFrame]) -> DataFrame:
    """SEGMENT rows of the single strings of crowded anchors."""
    wants = crowded.select("doc", "tag", F.struct("start", "count").alias("part"))

    def run(batches):
        for b in tidy(batches):
            if not b.num_rows:
                continue
            data, bounds, row, (start, n) = parts_in(b)
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row = np.repeat(row, n)
            own, whole = lone(Rolling(data), bounds[row] + at, long)
            doc, tag = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            yield segment_batch(own, row, at, np.ones(len(at), np.int64), whole, doc, tag, shards)

    return with_texts(docs, wants, temporary).mapInArrow(run, SCHEMA)


def in_units(packed_runs: DataFrame, long: int) -> DataFrame:
    """Step 3: runs of each document, cut at the sources' units: (unit, doc, tag, start, end, of_doc, of_tag, low, high)."""
    names = ["unit", "doc", "tag", "start", "end", "of_doc", "of_tag", "low", "high"]

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [np.frombuffer(unpacked(x), np.int64).reshape(7, -1) for b in tidy(batches) for x in b.column("blob").to_pylist()]
        doc, tag, start, end, of_doc, of_tag, shift = runs(*np.concatenate(blobs, axis=1))
        first, last = start + shift, end + shift - long  # places of strings in the source
        n = last // PIECE - first // PIECE + 1
        k = np.repeat(np.arange(len(doc)), n)
        piece = first[k] // PIECE + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        low, high = np.maximum(first[k], piece * PIECE), np.minimum(last[k], (piece + 1) * PIECE - 1) + long
        unit = mix(mix(of_doc[k].view(np.uint64) ^ mix(of_tag[k].view(np.uint64))) + piece.view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (unit, doc[k], tag[k], low - shift[k], high - shift[k], of_doc[k], of_tag[k], low, high)], names)

    return packed_runs.select("key", "blob").groupBy("key").applyInArrow(run, ", ".join(f"{x} long" for x in names))


INDEXED, ASKED = 1, 2


def fetch(docs: DataFrame, variants: DataFrame, candidates: DataFrame, long: int, temporary: list[DataFrame]) -> DataFrame:
    """Step 4, first half: (key, packed strings with their bytes, to be indexed, asked for, or both)."""
    units = staged(candidates.groupBy("unit", "of_doc", "of_tag").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.col("end") - F.col("start")).alias("bytes")), "units")
    full = units.where(F.col("bytes") > FULL).select("unit", "bytes").orderBy("unit").toPandas()  # at most all bytes / FULL rows
    sent = docs.sparkSession.sparkContext.broadcast((full.unit.to_numpy(np.int64), -(-full.bytes.to_numpy(np.int64) // FULL)))

    def part(unit, start, end, role):
        return F.struct(F.col(unit).alias("unit"), start.alias("start"), end.alias("end"), F.lit(role).alias("role")).alias("part")

    wants = variants.select("doc", "tag", part("anchor", F.col("start"), F.col("start") + F.col("count") - 1 + long, INDEXED | ASKED))
    wants = wants.unionByName(candidates.select("doc", "tag", part("unit", F.col("start"), F.col("end"), ASKED)))
    wants = wants.unionByName(units.select(F.col("of_doc").alias("doc"), F.col("of_tag").alias("tag"), part("unit", F.col("low"), F.col("high"), INDEXED)))
    wants = staged(wants, "wanted")
    temporary += [units, wants]
    symbols = wants.agg(F.coalesce(F.sum(F.col("part.end") - F.col("part.start")), F.lit(0)).alias("n")).first().n
    shards = np.uint64(1 + symbols // (2 * SYMBOLS))

    def cut(batches):
        hot, times = sent.value
        for b in tidy(batches):
            if not b.num_rows:
                continue
            data, bounds, row, (unit, start, end, role) = parts_in(b)
            doc, tag = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            copies = np.zeros(len(unit), np.int64)
            if len(hot):  # a full unit's source goes to all of its parts, a run to one of them
                at = np.minimum(np.searchsorted(hot, unit), len(hot) - 1)
                of = (hot[at] == unit) & (role != INDEXED | ASKED)
                n = np.where(of & (role == INDEXED), times[at], 1)
                k = np.repeat(np.arange(len(unit)), n)
                copies = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                unit, start, end, role, row, of, at = (x[k] for x in (unit, start, end, role, row, of, at))
                copies = np.where(of & (role == ASKED), (mix(doc.view(np.uint64) ^ mix(tag.view(np.uint64)))[row] % times[at].astype(np.uint64)).astype(np.int64), copies)
            key = (mix(unit.view(np.uint64) + copies.view(np.uint64)) % shards).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, unit, start, size, role, row, copies = (x[order] for x in (key, unit, start, end - start, role, row, copies))
            edge, blobs = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]), []
            for lo, hi in zip(edge[:-1], edge[1:]):
                m, r = size[lo:hi], row[lo:hi]
                cols = (unit[lo:hi] + copies[lo:hi], doc[r], tag[r], start[lo:hi], m, role[lo:hi].astype(np.int64))
                blobs.append(packed(np.array([hi - lo], np.int64), *cols, gathered_bytes(data, bounds[r] + start[lo:hi], m)))
            yield pa.RecordBatch.from_arrays([pa.array(key[edge[:-1]]), pa.array(blobs, pa.binary())], ["key", "blob"])

    return with_texts(docs, wants, temporary).mapInArrow(cut, "key long, blob binary")


def gathered_bytes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def worth_indexing(data: np.ndarray, begin: np.ndarray, size: np.ndarray, long: int):
    """(string, offset, size) of the pieces of strings in which both halves of each ``long`` bytes occur twice, as hashes."""
    half = long // 2
    count = size - long + 1
    string = np.repeat(np.arange(len(size)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    own = gathered_bytes(data, begin, size)
    rolling, first = Rolling(own), np.cumsum(size) - size
    at = np.arange(max(0, len(own) - half + 1))
    _, back, times = np.unique(rolling.of(at, at + half), return_inverse=True, return_counts=True)
    often = times[back] > 1
    at = first[string] + offset
    keep = often[at] & often[at + long - half]
    string, offset = string[keep], offset[keep]
    edge = np.ones(len(string), bool)
    edge[1:] = (string[1:] != string[:-1]) | (offset[1:] > offset[:-1] + long)  # nearer ones stay in one piece
    one = np.flatnonzero(edge)
    last = np.append(one[1:], len(string)) - 1
    return (string[one], offset[one], offset[last] - offset[one] + long) if len(string) else (string, offset, offset)


def index_shards(fetched: DataFrame, long: int, groups: int) -> DataFrame:
    """Step 4, second half: RANGES rows of the repeats, by matching statistics."""

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, bodies = [[] for _ in range(6)], []
        for b in tidy(batches):
            for blob in b.column("blob").to_pylist():
                raw = unpacked(blob)
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                for i, c in enumerate(cols):
                    c.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n * i))
                bodies.append(np.frombuffer(raw, np.uint8, -1, 8 + 48 * n))
        unit, doc, tag, start, length, role = (np.concatenate(c) for c in cols)
        data = np.concatenate(bodies)
        begin = np.cumsum(length) - length
        for both in (False, True):
            order = np.flatnonzero((role == INDEXED | ASKED) == both)
            order = order[np.lexsort((start[order], tag[order], doc[order], unit[order]))]
            # units in turn, as many at a time as fill an index
            filled = np.cumsum(np.where(role & INDEXED, length, 0)[order])
            ends = np.flatnonzero(np.append(np.diff(unit[order]) != 0, True)) + 1
            lo = 0
            while lo < len(order):
                fit = ends[filled[ends - 1] <= (filled[lo - 1] if lo else 0) + SYMBOLS]
                hi = int(fit[-1]) if len(fit) and fit[-1] > lo else int(ends[np.searchsorted(ends, lo, "right")])
                part = order[lo:hi]
                part = part[np.lexsort((start[part], tag[part], doc[part]))]
                held, ask = ((doc[p], tag[p], start[p], begin[p], length[p]) for p in (part[(role[part] & r) > 0] for r in (INDEXED, ASKED)))
                if both:
                    string, offset, size = worth_indexing(data, held[3], held[4], long)
                    held = ask = (held[0][string], held[1][string], held[2][string] + offset, held[3][string] + offset, size)
                if len(held[0]) and len(ask[0]):
                    yield from found_in(RunIndex(gathered_bytes(data, *held[3:]), held[4], long), held, ask, data)
                lo = hi

    def found_in(index: RunIndex, held, ask, data):
        at, size = ask[3:]
        # long queries in pieces that overlap; equal pieces are streamed once
        n = -(-(size - long + 1) // QUERY)
        k = np.repeat(np.arange(len(size)), n)
        skip = QUERY * (np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n))
        width = np.minimum(QUERY - 1 + long, size[k] - skip)
        view, number = memoryview(data), {}
        place = (at[k] + skip).tolist()
        same = np.array([number.setdefault(bytes(view[x : x + w]), len(number)) for x, w in zip(place, width.tolist())])
        _, one, times = np.unique(same, return_index=True, return_counts=True)
        members, begin, wide = np.argsort(same, kind="stable"), np.cumsum(times) - times, width[one]
        del number
        edge = [0, *np.searchsorted(np.cumsum(wide), np.arange(2 * SYMBOLS, wide.sum(), 2 * SYMBOLS), "right"), len(one)]
        for a, z in zip(edge[:-1], edge[1:]):
            got = list(index.matches(gathered_bytes(data, at[k[one[a:z]]] + skip[one[a:z]], wide[a:z]), wide[a:z]))
            if not got:
                continue
            piece, offset, first = (np.concatenate(x) for x in zip(*got))
            order = np.argsort((piece << 32) + offset)
            piece, offset, first = piece[order] + a, offset[order], first[order]
            new = np.ones(len(piece), bool)  # else the place before goes on here, and so does its match
            new[1:] = (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1) | (first[1:] != first[:-1] + 1)
            lo = np.flatnonzero(new)
            n = np.append(lo[1:], len(piece)) - lo
            piece, offset, first = piece[lo], offset[lo], first[lo]
            source = np.searchsorted(index.starts, first, "right") - 1
            r = np.repeat(np.arange(len(piece)), times[piece])
            own = members[begin[piece[r]] + np.arange(len(r)) - np.repeat(np.cumsum(times[piece]) - times[piece], times[piece])]
            string = k[own]
            d, t, p = ask[0][string], ask[1][string], ask[2][string] + skip[own] + offset[r]
            e, u, o = held[0][source[r]], held[1][source[r]], held[2][source[r]] + first[r] - index.starts[source[r]]
            hit = (e < d) | (e == d) & ((u < t) | (u == t) & (o < p))
            d, t, p, n = d[hit], t[hit], p[hit], n[r][hit]
            row, one_of = numbered(d, t)
            which, x, y = merged(row, p, p + n - 1 + long)
            yield blob_batch(RANGES, *by_document(d[one_of[which]], t[one_of[which]], x, y, groups=groups))

    return fetched.groupBy("key").applyInArrow(run, SCHEMA)


def merge_ranges(packed_ranges: DataFrame) -> DataFrame:
    """(doc, tag, starts and ends as packed 64-bit integers) of each document with repeats."""

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[] for _ in range(4)]
        for b in tidy(batches):
            for blob in b.column("blob").to_pylist():
                for c, part in zip(cols, np.frombuffer(unpacked(blob), np.int64).reshape(4, -1)):
                    c.append(part)
        doc, tag, start, end = (np.concatenate(c) for c in cols)
        if not len(doc):
            return
        row, first = numbered(doc, tag)
        which, start, end = merged(row, start, end)
        cut = np.searchsorted(which, np.arange(len(first) + 1))
        blobs = [np.concatenate([start[a:b], end[a:b]]).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(tag[first]), pa.array(blobs, pa.binary())], ["doc", "tag", "ranges"])

    return packed_ranges.select("key", "blob").groupBy("key").applyInArrow(run, "doc long, tag long, ranges binary")


def kept(text: bytes, ranges: bytes) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, the rest) of a text."""
    start, end = np.frombuffer(ranges, np.int64).reshape(2, -1)
    at, out = 0, []
    for s, e in zip(start.tolist(), end.tolist()):
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return int((end - start).sum()), len(start), b"".join(out)


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", long: int = 100, k: int = 20, keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row, with ``keep_text`` the kept bytes as well."""
    spark = docs.sparkSession
    body = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    docs = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(body).alias("tag"), body.cast("binary").alias("text"))
    read = docs.select("doc", "tag", "text")
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    shards, groups = 1 + size.bytes // (SHARE * (long - k) // 2), 1 + size.rows // GROUP
    hot, temporary = spark.sparkContext.broadcast(hot_anchors(read, long, k)), []
    first = staged(deal_segments(read, long, k, shards, groups, hot), "segments")
    second = staged(match_segments(first, long, groups), "matches")
    found = first.where(F.col("kind") == CANDIDATES).unionByName(second.where(F.col("kind") == CANDIDATES))
    crowded = second.where(F.col("kind") == CROWDED)
    if not crowded.isEmpty():
        strings = crowded.agg(F.sum("count").alias("n")).first().n
        more = staged(match_segments(deal_crowded(read, crowded, long, 1 + strings // SHARE, temporary), long, groups), "matches")
        found, second = found.unionByName(more.where(F.col("kind") == CANDIDATES)), second.unionByName(more)
    candidates = staged(in_units(found, long), "runs")
    variants = second.where(F.col("kind") == VARIANT).select("doc", "tag", "anchor", "start", "count")
    ranges = staged(merge_ranges(index_shards(fetch(read, variants, candidates, long, temporary), long, groups)), "ranges")
    dropped(spark, first, second, candidates, *temporary)
    table = spark.sparkContext.broadcast(bitmap(ranges, bits_for(ranges.count())))
    cols = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]

    def split(batches):
        """Rows that can't have repeats are done; only the others carry their text on."""
        for b in tidy(batches):
            if b.num_rows:
                may, text = marked(b, table.value) | keep_text, b.column("text").to_pylist()
                sha = pa.array([None if m else hashlib.sha256(t).hexdigest() for m, t in zip(may, text)], pa.string())
                body = pa.array([t if m else None for m, t in zip(may, text)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tag"), b.column("id"), pa.array([len(t) for t in text], pa.int64()), sha, body], ["doc", "tag", "id", "n_bytes", "sha", "text"])

    def finish(batches):
        for b in tidy(batches):
            rows = []
            for n, sha, text, r in zip(*(b.column(c).to_pylist() for c in ("n_bytes", "sha", "text", "ranges"))):
                removed, spans, rest = kept(text, r) if r is not None and text is not None else (0, 0, text)
                rows.append((n, removed, spans, hashlib.sha256(rest).hexdigest() if text is not None else sha, rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(len(cols)))], ["id", *cols])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    dealt = docs.select("doc", "tag", "id", "text").mapInArrow(split, "doc long, tag long, id long, n_bytes long, sha string, text binary")
    out = dealt.join(ranges, ["doc", "tag"], "left").select("id", "n_bytes", "sha", "text", "ranges").mapInArrow(finish, schema)
    return out.withColumnRenamed("id", id_col)
