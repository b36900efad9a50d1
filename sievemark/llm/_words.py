"""Word hashes of whole batches of texts by numpy, without a Python loop over words."""

from __future__ import annotations

import numpy as np

from ._common import Rolling

#: White space of the word rule: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that make up a plain token: letters, digits and everything beyond ASCII.
PLAIN = np.zeros(256, bool)
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = PLAIN[128:] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def lowered(data: np.ndarray, latin: bool = False) -> np.ndarray:
    """Lower-cases A-Z, and with ``latin`` the letters U+00C0 to U+00DE as well."""
    out = LOWER[data]
    if latin and len(out) > 1:
        hit = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[hit] += 0x20
    return out


def word_bounds(space: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words before each row's start."""
    n = len(space)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    solid = ~space
    first, last = solid.copy(), solid.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    edges = bounds[:-1][(np.diff(bounds) > 0)]
    first[edges] = solid[edges]
    inner = edges[edges > 0] - 1
    last[inner] = solid[inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased, cut at white space), and the words before each row."""
    starts, ends, per = word_bounds(SPACE[data], bounds)
    return Rolling(LOWER[data]).of(starts, ends), per


def tokens(data: np.ndarray, bounds: np.ndarray):
    """Plain tokens: punctuation dropped, lower-cased.  Returns hashes, tokens before each row, and each token's first byte and end in ``data``."""
    space = SPACE[data]
    at = np.flatnonzero(PLAIN[data] | space)
    kept = np.searchsorted(at, bounds)
    low = lowered(data, latin=True)[at]
    starts, ends, per = word_bounds(space[at], kept)
    hashes = Rolling(low).of(starts, ends)
    return hashes, per, at[starts] if len(starts) else starts, (at[ends - 1] + 1) if len(ends) else ends
