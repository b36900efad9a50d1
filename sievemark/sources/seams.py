"""Where models plug in: deterministic stand-ins with the shape of the real calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_vectors(texts: pd.Series, size: int = 64) -> pd.Series:
    """Unit vectors of hashed tokens; blank texts give null."""
    out = []
    for t in texts:
        v = np.zeros(size, np.float32)
        for w in (t or "").lower().split():
            h = int.from_bytes(w.encode()[:8].ljust(8, b"\0"), "little") * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            v[h % size] += 1 if h >> 63 else -1
        n = float(np.linalg.norm(v))
        out.append((v / n).tolist() if n else None)
    return pd.Series(out)


def embed(column: Column, model: Callable[[pd.Series], pd.Series] = hashed_vectors, batch: int = 100) -> Column:
    """Vectors of texts, ``batch`` of them a call."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.concat([model(s.iloc[i : i + batch]) for i in range(0, max(1, len(s)), batch)], ignore_index=True) if len(s) else s

    return run(column)


def relevance(score: Column | None = None) -> tuple[Column, Column]:
    """(score, verified): one half and false where no model answered; a score never implies the flag."""
    if score is None:
        return F.lit(0.5), F.lit(False)
    ok = score.isNotNull() & ~F.isnan(score) & score.between(0, 1)
    return F.when(ok, score).otherwise(0.5), ok


def keep_only(candidates: Column, kept: Column) -> Column:
    """A model may remove candidates, not add or reorder them; an empty or foreign answer changes nothing."""
    left = F.filter(candidates, lambda x: F.array_contains(kept, x))
    return F.when(kept.isNull() | (F.size(left) == 0), candidates).otherwise(left)
