"""Secret scan with multipart credential linking.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are
reported on their own.  Weak candidates -- a random-looking bare string, an
endpoint -- say nothing alone; they are reported only when complementary parts
stand in the same scope.  A scope is a paragraph (text between blank lines)
further bounded by a distance in code points.  Linking is an interval join: the
parts of each kind and scope are sorted, and each weak part looks up those within
reach as one range, so no pairs are listed and a document with many parts costs n log n.
An endpoint's identifier and secret are two strings that don't overlap: some such pair is within
reach if and only if the first identifier ends before the last secret starts, or the other way round.

The scan is one pass over the rows without a shuffle; RE2 screens pick the few
rows that the exact expressions then read in full.

Defined cases: null text counts as empty and gives a row without spans; every
input row gives one row, repeated rows and ids included; a null id stays null;
an empty table gives an empty result; very long texts are read whole; other columns of the input are not read,
so their names can't clash.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import tidy

# The base kinds of the contract, in its order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
# Kinds that only the linking adds.
BARE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s\"'<>|]{4,}")
ORDER = ("assign", "access", "hex", "secret", "endpoint")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "secret": "secret", "endpoint": "endpoint"}

SCREEN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"""
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three base kinds in code points: leftmost, non-overlapping per kind, short ones dropped."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], ORDER.index(x[2])))


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def weak_spans(text: str, base: list[tuple[int, int, str]], bits: float) -> list[tuple[int, int, str]]:
    """Candidates that need a complement: mixed, random-looking strings and endpoints outside the base spans."""
    ends = sorted((s, e) for s, e, _ in base)
    starts = [s for s, _ in ends]
    furthest = list(accumulate((e for _, e in ends), max))

    def free(s: int, e: int) -> bool:
        i = bisect.bisect_left(starts, e)
        return i == 0 or furthest[i - 1] <= s

    found = []
    for m in ENDPOINT.finditer(text):
        if free(*m.span()):
            found.append((m.start(), m.end(), "endpoint"))
    urls = [(s, e) for s, e, _ in found]  # in order, without overlaps

    def outside(s: int, e: int) -> bool:
        i = bisect.bisect_left(urls, (e,))
        return i == 0 or urls[i - 1][1] <= s

    for m in BARE.finditer(text):
        v = m[0]
        mixed = any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v)
        if mixed and entropy(v) >= bits and free(*m.span()) and outside(*m.span()):
            found.append((m.start(), m.end(), "secret"))
    return found


def link(text: str, base: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], reach: int) -> list[tuple[int, int, str]]:
    """Weak spans with a complement in their scope.

    A bare secret needs an identifier within ``reach`` in its paragraph; an
    endpoint needs both an identifier and a secret (base or linked) there, which
    don't overlap: one string can't play both parts.
    """
    if not weak or not base:
        return []
    breaks = [m.start() for m in PARAGRAPH.finditer(text)]
    scope = lambda at: bisect.bisect_right(breaks, at)

    def scoped(parts: list[tuple[int, int, str]]) -> dict[int, list[tuple[list[int], list[int]]]]:
        """By scope and kind: starts and ends in order; spans of one kind don't overlap."""
        out: dict[tuple[int, str], tuple[list[int], list[int]]] = {}
        for s, e, kind in sorted(parts):
            starts, ends = out.setdefault((scope(s), kind), ([], []))
            starts.append(s)
            ends.append(e)
        by: dict[int, list[tuple[list[int], list[int]]]] = {}
        for (k, _), v in out.items():
            by.setdefault(k, []).append(v)
        return by

    def near(parts: dict[int, list[tuple[list[int], list[int]]]], s: int, e: int) -> tuple[int, int] | None:
        """Of the parts within reach the first end and the last start."""
        found = []
        for starts, ends in parts.get(scope(s), ()):
            lo, hi = bisect.bisect_left(ends, s - reach), bisect.bisect_right(starts, e + reach)
            if lo < hi:
                found.append((ends[lo], starts[hi - 1]))
        return (min(a for a, _ in found), max(b for _, b in found)) if found else None

    def complementary(s: int, e: int) -> bool:
        one, other = near(identifiers, s, e), near(secrets, s, e)
        return one is not None and other is not None and (one[0] <= other[1] or other[0] <= one[1])

    identifiers = scoped([x for x in base if ROLE[x[2]] == "identifier"])
    linked = [x for x in weak if x[2] == "secret" and near(identifiers, x[0], x[1])]
    secrets = scoped([x for x in base if ROLE[x[2]] == "secret"] + linked)
    return linked + [x for x in weak if x[2] == "endpoint" and complementary(x[0], x[1])]


def scan_text(text: str | None, reach: int = 400, bits: float = 3.5) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of one whole text."""
    if not text:
        return [], []
    base = base_spans(text)
    weak = weak_spans(text, base, bits) if any(k == "access" for _, _, k in base) else []
    return base, sorted(base + link(text, base, weak, reach), key=lambda x: (x[0], ORDER.index(x[2]), x[1]))


SPANS = "spans array<struct<start:int,end:int,kind:string>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 400, bits: float = 3.5) -> DataFrame:
    """(id, spans) for every row; ``spans`` holds base and linked spans, ``base`` only the former."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def scan(batches):
        for b in tidy(batches):
            text = b.column(1).cast(pa.string()).fill_null("")
            hit = pc.match_substring_regex(text, SCREEN).to_numpy(zero_copy_only=False)
            base, every = [[] for _ in range(len(text))], [[] for _ in range(len(text))]
            for i in hit.nonzero()[0]:
                one, two = scan_text(text[i].as_py(), reach, bits)
                base[i] = [{"start": s, "end": e, "kind": k} for s, e, k in one]
                every[i] = [{"start": s, "end": e, "kind": k} for s, e, k in two]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(every, kind)], ["id", "base", "spans"])

    ids = docs.schema[id_col].dataType.simpleString()
    read = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return read.mapInArrow(scan, f"id {ids}, base array<struct<start:int,end:int,kind:string>>, {SPANS}").withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by one mark that names its first kind."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", reach: int = 400, bits: float = 3.5) -> DataFrame:
    """All rows and columns of ``docs`` with secrets replaced; ``length_col``, if there, follows the text."""

    def run(batches):
        for b in tidy(batches):
            text = b.column(text_col).cast(pa.string())
            hit = pc.match_substring_regex(text.fill_null(""), SCREEN).to_numpy(zero_copy_only=False).nonzero()[0]
            new = {}
            for i in hit.tolist():
                body = text[i].as_py()
                if spans := scan_text(body, reach, bits)[1]:
                    new[i] = redacted(body, spans)
            if new:
                values = text.to_pylist()
                for i, v in new.items():
                    values[i] = v
                at = b.schema.get_field_index(text_col)
                b = b.set_column(at, b.schema.field(at), pa.array(values, pa.string()).cast(b.schema.field(at).type))
                if length_col in b.schema.names:
                    at = b.schema.get_field_index(length_col)
                    sizes = b.column(at).to_pylist()
                    for i, v in new.items():
                        sizes[i] = len(v)
                    b = b.set_column(at, b.schema.field(at), pa.array(sizes, b.schema.field(at).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of the contract, from the operator's spans."""
    from pyspark.sql import functions as F

    def text(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        id_col, *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans")
    )


def brute(text: str | None) -> tuple[int, int, int, str]:
    """For tests: the base kinds by the plain expressions of the contract."""
    text, out = text or "", []
    for k, expression, width in (("assign", ASSIGN, lambda m: len(m[2])), ("access", ACCESS, lambda m: len(m[0])), ("hex", HEX, lambda m: len(m[0]))):
        out += [(m.start(), ORDER.index(k), m.end(), k) for m in expression.finditer(text) if width(m) >= LEAST[k]]
    out.sort()
    n = Counter(x[3] for x in out)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in out).encode()).hexdigest()
