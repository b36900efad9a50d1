"""Periodic runs of words, found by a suffix automaton.

A run is a stretch of consecutive words with smallest period ``q`` that no
neighbouring word extends.  Every text gets a suffix automaton whose states stand
for sets of end positions.  The sets are merged up the suffix links, longest state
first, the smaller into the larger; whenever two end positions become neighbours
in a state, their distance is compared with the state's length: what isn't longer
is the seed of a square, and its two copies overlap.  A state's length is the longest
common suffix of the two prefixes, so a seed can't be extended to the left; the
seed whose next words differ is the right end of its run.  Two neighbours of one
state can't have a third one between them, so their distance is the smallest period
and each run is found exactly once.

A run of at least ``least`` words and ``times`` periods repeats n-grams of
``least * (times - 1) / times`` words within itself.  Stretches without such repeats are left
out before the automaton is built, by hashes: equal words have equal hashes, so no
run is lost, and what the automaton sees are words, so a hash decides nothing.

Each text is read by one task, in time n log n; nothing is shuffled.  A text of any length
is one string, because a run may span all of it.

Defined cases: null and empty texts have no words and no runs; every row gives one
row, repeated ids included; an empty table gives an empty result; very long texts
are processed whole, a few dozen bytes a word where they repeat; other columns are
not read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Rolling, chunks, flat, mix, tidy
from ._words import SPACE, word_bounds

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
CHUNK = 4 << 20


def automaton(ids) -> tuple[array, array, bytearray]:
    """Length and suffix link of every state, and which states are clones.  State 0 is the empty string."""
    length, link, first, to = array("i", [0]), array("i", [-1]), array("i", [-1]), array("i", [0])
    clone, more = bytearray(1), {}  # most states have one transition; the others' further ones stand in `more`
    last = 0
    for c in ids:
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        first.append(-1)
        to.append(0)
        clone.append(0)
        p, last, q = last, now, -1
        while p >= 0:
            have = first[p]
            if have < 0:
                first[p], to[p] = c, now
            elif have == c:
                q = to[p]
                break
            else:
                others = more.setdefault(p, {})
                q = others.setdefault(c, now)
                if q != now:
                    break
                q = -1
            p = link[p]
        if q < 0:
            continue
        if length[p] + 1 == length[q]:
            link[now] = q
            continue
        twin = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        first.append(first[q])
        to.append(to[q])
        clone.append(1)
        if q in more:
            more[twin] = dict(more[q])
        link[q] = link[now] = twin
        while p >= 0:
            if first[p] == c:
                if to[p] != q:
                    break
                to[p] = twin
            else:
                if more[p].get(c) != q:
                    break
                more[p][c] = twin
            p = link[p]
    return length, link, clone


def runs_of(ids, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of small integers, sorted."""
    n = len(ids)
    if n < least:
        return []
    length, link, clone = automaton(ids)
    lengths = np.frombuffer(length, np.int32)
    floor = -(-least * (times - 1) // times)  # shorter states can't hold a seed that counts
    order = np.flatnonzero(lengths >= floor)
    order = order[np.argsort(-lengths[order], kind="stable")]
    found: list[tuple[int, int, int]] = []

    def seed(early: int, late: int, size: int) -> None:
        d = late - early
        if d * (times - 1) <= size and size + d >= least and (late + 1 == n or ids[early + 1] != ids[late + 1]):
            found.append((early - size + 1, size + d, d))

    # Ends are kept as negative numbers in ascending order: a state's own end is its smallest, so it is appended.
    sets: dict[int, list[int]] = {}
    for v in order.tolist():
        size, ends = length[v], sets.pop(v, None)
        if not clone[v]:
            own = 1 - size
            if ends is None:
                ends = [own]
            else:
                seed(-own, -ends[-1], size)
                ends.append(own)
        u = link[v]
        if length[u] < floor or ends is None:
            continue
        size, small, large = length[u], ends, sets.get(u)
        if large is None:
            sets[u] = small
            continue
        if len(small) > len(large):
            small, large = large, small
        before, places = None, []
        for j, x in enumerate(small):
            i = bisect_left(large, x)
            places.append(i)
            if i and (before is None or large[i - 1] > before):
                seed(-x, -large[i - 1], size)
            if i < len(large) and (j + 1 == len(small) or small[j + 1] > large[i]):
                seed(-large[i], -x, size)
            before = x
        if len(small) <= 8:
            for i, x in zip(reversed(places), reversed(small), strict=True):
                large.insert(i, x)
        else:
            large.extend(small)
            large.sort()  # two ascending runs: a merge
        sets[u] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_stretches(hashes: np.ndarray, per: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches, within one row each, whose n-grams of ``size`` words repeat within the stretch."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none
    row = np.repeat(np.arange(len(per) - 1), np.diff(per))
    gram, width, odd = mix(hashes + np.uint64(1)), 1, np.uint64(0x9E3779B97F4A7C15)
    while width < size:
        step = min(width, size - width)
        gram = mix(gram[: n - width - step + 1] * odd + gram[step : n - width + 1])
        width += step
    inside = row[: n - size + 1] == row[size - 1 :]
    at = np.flatnonzero(inside)
    part = row
    for _ in range(2):  # once by row, once by the stretches of the first time
        key = mix(gram[at] ^ (part[at].astype(np.uint64) * odd))
        ordered = np.sort(key)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return none, none
        i = np.searchsorted(twice, key)
        at = at[twice[np.minimum(i, len(twice) - 1)] == key]
        edge = np.zeros(n + 1, np.int64)
        edge[at] += 1
        edge[at + size] -= 1
        covered = np.cumsum(edge[:-1]) > 0
        first = covered.copy()
        first[1:] &= ~covered[:-1] | (row[1:] != row[:-1])
        starts = np.flatnonzero(first)
        part = np.searchsorted(starts, np.arange(n), "right")
    last = covered.copy()
    last[:-1] &= ~covered[1:] | (row[1:] != row[:-1])
    ends = np.flatnonzero(last) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def numbered(words: list[bytes]) -> list[int]:
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """The id, all runs by start and period, the number of words, and the text in which every run is cut to its first period."""
    size = -(-least * (times - 1) // times)
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in tidy(batches):
            data, bounds = flat(b.column(1))
            runs, counts, kept = [], [], []
            for lo, hi in chunks(bounds, CHUNK):
                part, cuts = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
                first, last, per = word_bounds(SPACE[part], cuts)
                at, to = repeated_stretches(Rolling(part).of(first, last), per, size, least)
                which = np.searchsorted(per, at, "right") - 1
                raw = part.tobytes()
                for i in range(hi - lo):
                    words = raw[cuts[i] : cuts[i + 1]].split()
                    found: list[tuple[int, int, int]] = []
                    a, z = np.searchsorted(which, (i, i + 1)) if len(which) else (0, 0)
                    for s, e in zip((at[a:z] - per[i]).tolist(), (to[a:z] - per[i]).tolist(), strict=True):
                        found += [(s + x, m, q) for x, m, q in runs_of(numbered(words[s:e]), least, times)]
                    counts.append(len(words))
                    if found:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for s, m, q in found:
                            edge[s + q] += 1
                            edge[s + m] -= 1
                        words = [words[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                    kept.append(b" ".join(words).decode())
            fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, pa.list_(fields)), pa.array(counts, pa.int64()), pa.array(kept, pa.string())], ["id", "runs", "n_words", "collapsed"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, runs {RUN}, n_words bigint, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_planted_periods(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and texts; from every tenth id on (by crc32), the words after some point repeat with a period that the id tells.

    Texts that are not rewritten pass unchanged.  A row without an id isn't rewritten.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in tidy(batches):
            texts = b.column(1)
            ids = b.column(0).to_pylist()
            chosen = {}
            for i, x in enumerate(ids):
                if x is None:
                    continue
                h = zlib.crc32(str(x).encode())
                if h % 10 == 0 and texts[i].is_valid:
                    words, g = texts[i].as_py().encode().split(), h // 10
                    if words:
                        a = g % len(words)
                        p = 1 + (len(words) - a) // (3 + g % 8)
                        chosen[i] = b" ".join(words[a + (j - a) % p] if j >= a else words[j] for j in range(len(words))).decode()
            if chosen:
                mask = np.zeros(len(ids), bool)
                mask[list(chosen)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(list(chosen.values()), texts.type))
            yield pa.RecordBatch.from_arrays([b.column(0), texts.cast(pa.string())], ["id", "text"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, text string")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def strongest(runs: str) -> Column:
    """The run with the greatest length / period, compared as fractions; ties go to the first by start, then period."""
    better = "acc is null or cast(r.length as decimal(19)) * acc.period > cast(acc.length as decimal(19)) * r.period"
    return F.expr(f"aggregate({runs}, cast(null as struct<start: bigint, length: bigint, period: bigint>), (acc, r) -> case when {better} then r else acc end)")


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: the number of runs, the strongest one, and hashes of all runs and of the collapsed text."""
    spelled = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(id_col, "runs", "collapsed", strongest("runs").alias("best")).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(spelled, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
