"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id into shards whose bounds follow from the rows
alone.  A shard's records are streamed into gzip members, one a record, and roll to
a new file when the compressed size passes ``roll_bytes``; headers, digests and
record ids are regenerated from the rows.  So equal tables give equal files
whatever the partitions and settings.  Files are written under temporary names and
renamed; the driver removes what failed tasks left, and writes the manifest, one
line a file, last.

Records with equal payloads: the one with the smallest page id is ``response``,
the rest are ``revisit`` and carry no payload.  Who refers to whom comes from a
pass over digests only; the marks then travel in the same range sort as the
rows, so the payloads move once.

Defined cases: null html is an empty payload; a null url is left out of the
header, control characters in a url are percent-encoded; of repeated rows with
the smallest id one is response, the others revisit it; rows with a null id come
first and revisit like any other, the smallest non-null id being the response;
an empty table gives an empty manifest and result; very long pages are one record
each, larger than ``roll_bytes`` if need be; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import filesystem, new_path, tidy
from ._shards import cleaned, range_shards, shard_slices
from .token_files import read_manifest, renamed

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE_OF_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space
CHUNK = 1 << 20


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page, digest: str, ordinal: int) -> str:
    """Of the ``ordinal``-th row of this page with this payload."""
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, f'page:{page}:{digest}:{ordinal}')}>"


def header(fields: list[tuple[str, object]]) -> bytes:
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def record(page, ordinal: int, url: str | None, payload: bytes, digest: str, revisit: bool, refers, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    url = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest, ordinal)), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers, digest, 0) if revisit else None), ("Page-ID", page), ("Refers-To-Page-ID", refers if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    return header(fields) + block + b"\r\n\r\n"


def member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def marks(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(id, tie, digest, refers) of rows whose payload a smaller id has too."""
    d = pages.select("id", "tie", F.unhex(F.sha1("payload")).alias("digest"), F.length("payload").alias("n")).where(F.col("n") >= least_bytes)
    first = d.groupBy("digest").agg(F.min("id").alias("refers"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return d.join(first, "digest").where(~F.col("id").eqNullSafe(F.col("refers"))).select("id", "tie", "digest", "refers").distinct()


def write_warc(pages: DataFrame, folder: str, id_col="page_id", url_col="url", payload_col="html", least_bytes=0, roll_bytes=256 << 20, date="2000-01-01T00:00:00Z", level=6) -> list[dict]:
    """Writes the archives and ``manifest.json``; returns the manifest, one entry a file in id order."""
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    rows = pages.select(
        pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("string").cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("tie", F.xxhash64("payload"))
    nothing = lambda kind: F.lit(None).cast(kind)
    marked = marks(rows, least_bytes).select("id", "tie", nothing("string").alias("url"), nothing("binary").alias("payload"), F.lit(0).alias("kind"), "digest", "refers")
    every = rows.select("id", "tie", "url", "payload", F.lit(1).alias("kind"), nothing("binary").alias("digest"), nothing("long").alias("refers"))

    def run(batches):
        store, out, done = filesystem(folder)[0], None, []
        shard = at = count = files = 0
        key, refers, seen = None, {}, Counter()

        def closed():
            out.close()
            renamed(store, held, f"{root}/{name}")
            done.append((shard, name, count, at))

        for b in tidy(batches):
            for part, piece in shard_slices(b):
                if part != shard:
                    if out is not None:
                        closed()
                    shard, files, out = part, 0, None
                for i, tie, url, payload, kind, digest, ref in zip(*(piece.column(c).to_pylist() for c in ("id", "tie", "url", "payload", "kind", "digest", "refers"))):
                    if (i, tie) != key:
                        key, refers, seen = (i, tie), {}, Counter()
                    if kind == 0:
                        refers[digest] = ref
                        continue
                    raw = hashlib.sha1(payload).digest()
                    ordinal = seen[raw]
                    again = len(payload) >= least_bytes and (raw in refers or ordinal > 0)
                    seen[raw] += 1
                    if out is None:
                        name = f"pages-{shard:06d}-{files:05d}.warc.gz"
                        held = f"{root}/_{name}.{uuid.uuid4().hex}"
                        out = store.open_output_stream(held, compression=None)
                        about = f"software: sievemark\r\nformat: WARC File Format 1.1\r\nisPartOf: pages\r\nname: {name}\r\n".encode()
                        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("WARC-Block-Digest", f"sha1:{sha1(about)}"), ("Content-Type", "application/warc-fields"), ("Content-Length", len(about))]
                        z = member(header(fields) + about + b"\r\n\r\n", level)
                        out.write(z)
                        at, count, files = len(z), 0, files + 1
                    z = member(record(i, ordinal, url, payload, base64.b32encode(raw).decode(), again, refers.get(raw, i), date), level)
                    out.write(z)
                    at, count = at + len(z), count + 1
                    if at >= roll_bytes:
                        closed()
                        out = None
        if out is not None:
            closed()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), *(pa.array([d[k] for d in done], pa.int64()) for k in (2, 3))], ["part", "file", "records", "bytes"])

    dealt, _ = range_shards(every, "id", 64 + F.length("payload"), "tie", marked)
    sorted_rows = dealt.sortWithinPartitions("shard", "id", "tie", "kind", "url", "payload")
    entries = sorted((r.asDict() for r in sorted_rows.mapInArrow(run, "part long, file string, records long, bytes long").collect()), key=lambda r: r["file"])  # one small row a file
    cleaned(folder)
    held = f"{root}/_manifest.{uuid.uuid4().hex}"
    with store.open_output_stream(held) as out:
        out.write(json.dumps({"version": 1, "files": entries}).encode())
    renamed(store, held, f"{root}/manifest.json")
    return entries


def members(stream):
    """The decompressed gzip members of a stream, one at a time."""
    z, parts = zlib.decompressobj(31), []
    data = stream.read(CHUNK)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data or stream.read(CHUNK), zlib.decompressobj(31), []
        else:
            data = stream.read(CHUNK)
    if parts:
        raise ValueError("an archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record; checks its length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if rest[n:] != b"\r\n\r\n" or fields["warc-block-digest"] != f"sha1:{sha1(block)}":
        raise ValueError("a WARC record is damaged")
    return fields, block


def read_warc(spark: SparkSession, folder: str, id_col="page_id") -> DataFrame:
    """Per record of the archives: id, payload_bytes, payload_digest, record_type, refers_to, url, and the payload of responses."""
    files = [(e["file"],) for e in read_manifest(folder)]
    names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        store, root = filesystem(folder)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for b in tidy(batches):
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for raw in members(f):
                        fields, block = parse(raw)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = fields["warc-type"] == "revisit"
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and sha1(payload) != digest:
                            raise ValueError("a payload does not have its digest")
                        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                        number = lambda k: None if (v := fields.get(k, "None")) == "None" else int(v)
                        rows.append((number("page-id"), size, digest, fields["warc-type"], number("refers-to-page-id"), fields.get("warc-target-uri"), None if revisit else payload))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    listed = spark.createDataFrame(files, "file string").repartition(max(1, len(files)))
    schema = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return listed.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def warc_round_trip(pages: DataFrame, **settings) -> DataFrame:
    """Writes the table to a new shared folder and reads the archives back, without the payloads."""
    folder = new_path(pages.sparkSession, "warc")
    write_warc(pages, folder, **settings)
    return read_warc(pages.sparkSession, folder).drop("payload")
