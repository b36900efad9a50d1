"""Passages of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.text import let


#: Bytes of texts that are cut at once.
AT_ONCE = 4 << 20


def passages(words: Column, budget: int = 96, overlap: int = 24) -> Column:
    """Overlapping windows of an array of words; the last word is always covered.

    The overlap is at most a quarter of the budget.
    """
    step = budget - min(overlap, budget // 4)

    def cut(w):
        n = F.size(w)
        starts = F.when(n <= budget, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.ceil((n - budget) / step) * step).cast("int"), F.lit(step)))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(w, s + 1, F.lit(budget)).alias("words")))

    return let(words, cut)


def soft_pieces(body: str | None, size: int = 6000) -> list[str]:
    """Pieces of at most ``size`` characters, ended at the last line end, else the last space, in a window's second half."""
    out, rest = [], body or ""
    at, n = 0, len(rest)
    while at < n:
        end = min(n, at + size)
        if end < n:
            for mark in ("\n", " "):
                cut = rest.rfind(mark, at + size // 2, end)
                if cut >= 0:
                    end = cut
                    break
        out.append(rest[at:end].strip())
        at = end
        while at < n and rest[at].isspace():
            at += 1
    return out


def shares(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """A batch in runs of rows of about ``most`` bytes; a row is never cut."""
    lo, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if i > lo and held + (n or 0) > most:
            yield texts[lo:i]
            lo, held = i, 0
        held += n or 0
    yield texts[lo:]


def pieces(body: Column, size: int = 6000) -> Column:
    """``soft_pieces`` of each text; each cut depends on the one before, so it runs on Arrow batches, a few megabytes at once."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for some in shares(texts, AT_ONCE):
                yield pa.array((soft_pieces(t.as_py(), size) for t in some), pa.list_(pa.string()), size=len(some))

    return run(body)


def new_column(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def numbered(df: DataFrame, window: WindowSpec, keep) -> DataFrame:
    """Rows whose number in the window passes ``keep``, with the columns that ``df`` has."""
    n = new_column(df, "row")
    return df.withColumn(n, F.row_number().over(window)).where(keep(F.col(n))).select(*df.columns)
