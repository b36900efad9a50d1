"""Texts measured in the tokens of a model: windows, budgets, and places in the text itself.

The vocabulary is a file of the ``tokenizers`` library, given by its path.  Line ends count as
spaces, as models read them; what is returned is always a piece of the text as it was.  A text
is one row's work, whatever its length.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("Error", "Failed Step", "Order Reason", "Summary")


@lru_cache(maxsize=4)
def vocabulary(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # in a text they are ordinary text
    t.no_truncation()
    t.no_padding()
    return t


#: Where a byte-level vocabulary cuts anyway, with ASCII white space; and what other white space there is.
PIECE = re.compile(r"[\t-\r ]+(?![^\t-\r ])| ?[^\t-\r ]+|[\t-\r ]+")
FAR_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
#: Most pieces that a worker remembers, and characters of one.
REMEMBERED, LONGEST = 200_000, 100


@lru_cache(maxsize=4)
def remembered(path: str) -> dict | None:
    """Pieces seen, each with its count of ids and its tokens' places; null if the vocabulary may look beyond a piece."""
    t = json.loads(vocabulary(path).to_str())
    cut = t["pre_tokenizer"] or {}
    alone = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and t["normalizer"] is None
    return {} if alone and all(x["special"] for x in t["added_tokens"]) else None


def whole(path: str, body: str) -> tuple[int, list[tuple[int, int]]]:
    """Ids of a text without line ends, and start and end of each token that holds characters."""
    e = vocabulary(path).encode(body, add_special_tokens=False)
    return len(e.ids), [o for o in e.offsets if o[1] > o[0]]


def parts(path: str, body: str):
    """``whole`` of a text's pieces, in order; each distinct piece is encoded once."""
    known, body = remembered(path), body.replace("\n", " ")
    if known is None or FAR_SPACE.search(body):
        yield 0, whole(path, body)
        return
    at = 0
    for piece in PIECE.findall(body):
        one = known.get(piece)
        if one is None:
            one = whole(path, piece)
            if len(piece) <= LONGEST:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[piece] = one
        yield at, one
        at += len(piece)


def spans(path: str, body: str) -> list[tuple[int, int]]:
    """Start and end of each token that holds characters, in code points."""
    return [(at + a, at + b) for at, (_, places) in parts(path, body) for a, b in places]


def size(path: str, body: str, special: int = 0) -> int:
    return sum(n for _, (n, _) in parts(path, body)) + special


def head(path: str, body: str, budget: int) -> str:
    """The text up to the end of its ``budget``-th token."""
    at = spans(path, body) if budget > 0 else []
    return body if len(at) <= budget and budget > 0 else body[: at[budget - 1][1]] if at else ""


def cuts(path: str, body: str, prefix: str, limit: int, overlap: int, special: int) -> list[tuple[int, int]]:
    """Windows that fit ``limit`` tokens with the prefix before them; each begins ``overlap`` tokens before the last one's end."""
    at = spans(path, body)
    room = limit - size(path, prefix, special) - 4
    if at and room < 8:
        raise ValueError("the prefix leaves no room for the text")
    out, first, shared = [], 0, min(overlap, room // 4)
    while first < len(at):
        after = min(first + room, len(at))
        while size(path, prefix + body[at[first][0] : at[after - 1][1]], special) > limit:  # a cut can split a merge
            after -= 1
            if after == first:
                raise ValueError("a token is larger than the window")
        out.append((at[first][0], at[after - 1][1]))
        first = len(at) if after == len(at) else max(first + 1, after - shared)
    return out


def token_count(body: Column, path: str) -> Column:
    """Tokens of each text; 0 of a null."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: size(path, t or ""))

    return run(body)


def token_trimmed(body: Column, path: str, budget: int) -> Column:
    """Each text up to its ``budget``-th token; '' of a null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: head(path, t or "", budget))

    return run(body)


def token_passages(body: Column, path: str, prefix: Column | None = None, limit: int = 128, overlap: int = 24, special: int = 0) -> Column:
    """Overlapping windows of each text as structs (start, end) in code points; none of a null, empty or blank text.

    A window and its prefix are at most ``limit`` tokens together, ``special`` of them for the
    model.  The overlap is at most a quarter of the window, and the last token is always covered.
    """

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def run(texts: pd.Series, prefixes: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in cuts(path, t or "", p or "", limit, overlap, special)] for t, p in zip(texts, prefixes)], texts.index, dtype=object)

    return run(body, F.lit("") if prefix is None else prefix)


def failure(path: str, code: str, fields: list[str], budget: int, special: int = 0) -> str:
    """The code whole, then every field with an equal share of what its label and the code leave; then tokens go from the end until all fits."""
    first = f"Error code: {code}\n" if code else ""
    bare = size(path, first + "\n".join(f"{k}: " for k in LABELS), special)
    share = max(1, (budget - bare) // len(LABELS))
    out = first + "\n".join(f"{k}: {head(path, f, share)}" for k, f in zip(LABELS, fields))
    while size(path, out, special) > budget:
        n = len(spans(path, out))
        if n <= 1:
            raise ValueError("the budget is smaller than a token")
        out = head(path, out, n - 1)
    return out


def token_failure_text(code: Column, error: Column, step: Column, reason: Column, summary: Column, path: str, budget: int, special: int = 0) -> Column:
    """A failure for a model that reads ``budget`` tokens; null parts are empty."""

    @F.pandas_udf("string")
    def run(codes: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([failure(path, x or "", [f or "" for f in fields], budget, special) for x, *fields in zip(codes, a, b, c, d)], codes.index, dtype=object)

    return run(code, error, step, reason, summary)
