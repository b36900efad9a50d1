"""A run-length index: run-compressed Burrows-Wheeler transform with sampled run ends.

The text is a collection of short strings, each closed by a separator smaller
than all symbols; equal suffixes are ordered by place.  Stored are the runs of
the transform (head, first row, where LF takes that row; a bit a row finds the run of a
row), text places at the
first and last row of each run, and, for a length ``long``, the blocks of rows
that share their first ``long`` symbols, with the first place of each block.
``stream`` gives matching statistics of any queries right to left: as long as the
next symbol is the run's head it follows LF; else it jumps to the nearer end of
a run of that symbol, whose sampled place tells how long the match still is.
All queries advance together, one symbol a step.
"""

from __future__ import annotations

import numpy as np

BITS = 21


def _ranked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1 of pairs, and how many there are."""
    n = len(first)
    if n < 1 << BITS:
        key = np.sort((first.astype(np.uint64) << np.uint64(2 * BITS)) | (second.astype(np.uint64) << np.uint64(BITS)) | np.arange(n, dtype=np.uint64))
        at, key = (key & np.uint64((1 << BITS) - 1)).astype(np.int64), key >> np.uint64(BITS)
        new = np.ones(n, np.int64)
        new[1:] = key[1:] != key[:-1]
    else:
        at = np.lexsort((second, first))
        a, b = first[at], second[at]
        new = np.ones(n, np.int64)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    rank = np.empty(n, np.int64)
    rank[at] = np.cumsum(new)
    return rank, int(rank.max(initial=0))


class Ranks:
    """Which of the marks (sorted rows) is the last at or before a row, -1 if none: a bit a row and a count a word."""

    def __init__(self, marks: np.ndarray, n: int):
        bits = np.zeros(-(-n // 64) * 64 or 64, np.uint8)
        bits[marks] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        count = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(count) - count - 1

    def __call__(self, row: np.ndarray) -> np.ndarray:
        word = row >> 6
        return self.before[word] + np.bitwise_count(self.words[word] << (63 - (row & 63)).astype(np.uint64))


class RunIndex:
    def __init__(self, data: np.ndarray, lengths: np.ndarray, long: int = 100):
        """``data``: the strings' bytes end to end; ``lengths``: of each string."""
        m, n = len(lengths), len(data) + len(lengths)
        self.ends = np.cumsum(lengths + 1) - 1  # places of the separators
        self.starts = self.ends - lengths
        text = np.zeros(n, np.uint16)
        solid = np.ones(n, bool)
        solid[self.ends] = False
        text[solid] = data.astype(np.uint16) + 1
        self.text, self.long = text, long
        left = np.repeat(self.ends, lengths + 1) - np.arange(n)  # symbols before the separator
        key = np.zeros(n, np.uint64)
        for j in range(7):
            part = np.zeros(n, np.uint64)
            part[: n - j] = text[j:]
            part[left < j] = 0
            key = (key << np.uint64(9)) | part
        at = np.argsort(key)
        new = np.ones(n, np.int64)
        new[1:] = key[at][1:] != key[at][:-1]
        rank = np.empty(n, np.int64)
        rank[at] = np.cumsum(new)
        depth, count = 7, int(rank.max(initial=0))
        held = (7, rank)  # the deepest ranks of at most ``long`` symbols
        most = int(lengths.max(initial=0)) + 1
        while depth < most:
            second = np.zeros(n, np.int64)
            second[: n - depth] = rank[depth:]
            second[left < depth] = 0
            rank, now = _ranked(rank, second)
            depth *= 2
            if depth <= long:
                held = (depth, rank)
            if now == count:
                break
            count = now
        order = np.argsort((rank.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64))
        before = np.where(order > 0, text[order - 1], 0)
        before[np.isin(order, self.starts)] = 0
        edge = np.ones(n, bool)
        edge[1:] = before[1:] != before[:-1]
        self.run = np.flatnonzero(edge)
        self.head = before[self.run]
        self.run_of = Ranks(self.run, n)
        size = np.diff(np.append(self.run, n))
        by = np.argsort(self.head, kind="stable")
        first = np.zeros(258, np.int64)  # rows before the first row of each symbol
        first[1:] = np.cumsum(np.bincount(text, minlength=257)[:257])
        done = np.cumsum(size[by]) - size[by]
        base = np.zeros(len(by), np.int64)
        heads = self.head[by]
        group = np.ones(len(by), bool)
        group[1:] = heads[1:] != heads[:-1]
        base[group] = done[group]
        base = np.maximum.accumulate(base)
        self.lf = np.empty(len(by), np.int64)
        self.lf[by] = first[heads] + done - base
        self.last = self.run + size - 1
        self.at_first, self.at_last = order[self.run], order[self.last]  # sampled places
        self.by = by  # runs by symbol
        self.by_key = self.head[by].astype(np.int64) * len(by) + by
        self.edge = np.searchsorted(self.head[by], np.arange(258))
        # blocks of rows with equal first ``long`` symbols
        same = np.zeros(n, bool)
        if n:
            d, r = held
            a, b = order[1:], order[:-1]
            ok = (left[a] >= long) & (left[b] >= long)
            a, b = a[ok], b[ok]
            if d <= long <= 2 * d:
                same[1:][ok] = (r[a] == r[b]) & (r[a + long - d] == r[b + long - d])
            else:  # the ranks were final before they were that deep
                same[1:][ok] = self._equal(a, b)
        lead = np.flatnonzero(~same)
        size = np.diff(np.append(lead, n))
        smallest = np.minimum.reduceat(order, lead) if n else order
        keep = size > 1
        self.block, self.block_end, self.block_first = lead[keep], lead[keep] + size[keep], smallest[keep]
        self.block_of = Ranks(self.block, n)

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = np.ones(len(a), bool)
        for j in range(self.long):
            same &= self.text[a + j] == self.text[b + j]
        return same

    def first_places(self, row: np.ndarray) -> np.ndarray:
        """The first place of a row's block, -1 for rows whose long prefix stands alone."""
        if not len(self.block):
            return np.full(len(row), -1)
        k = self.block_of(row)
        inside = (k >= 0) & (row < self.block_end[np.maximum(k, 0)])
        return np.where(inside, self.block_first[np.maximum(k, 0)], -1)

    def common(self, place: np.ndarray, query: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols that the text from each ``place`` and the query from ``at`` share, ``most`` at most."""
        same, todo, done = np.zeros(len(place), np.int64), np.flatnonzero(most > 0), 0
        while len(todo):
            step = np.arange(done, done + 16)
            a, q = place[todo][:, None] + step, at[todo][:, None] + step
            differ = (self.text[np.minimum(a, len(self.text) - 1)] != query[np.minimum(q, len(query) - 1)]) | (step >= most[todo][:, None])
            some = differ.any(axis=1)
            same[todo] = done + np.where(some, differ.argmax(axis=1), 16)
            todo, done = todo[~some], done + 16
        return same

    def stream(self, data: np.ndarray, lengths: np.ndarray):
        """Matching statistics of query strings (bytes end to end): yields (string, offset, length, place, row) a step.

        For each place of a query, the length of its longest match and a place of that in
        the text.  Lengths of ``long`` and more are only known to be that.
        """
        if not len(self.ends) or not len(lengths):
            return
        order = np.argsort(-lengths, kind="stable")
        size, end = lengths[order], np.cumsum(lengths)[order]
        query = data.astype(np.uint16) + 1
        m = len(order)
        row, at, n = np.zeros(m, np.int64), np.full(m, self.ends[0]), np.zeros(m, np.int64)  # row 0 is the first separator
        for step in range(int(size[0])):
            m = int(np.searchsorted(-size, -step))  # strings longer than that
            row, at, n = row[:m], at[:m], n[:m]
            pos = end[:m] - 1 - step
            c = query[pos]
            r = self.run_of(row)
            other = np.flatnonzero(self.head[r] != c)
            if len(other):
                want = c[other].astype(np.int64)
                k = np.searchsorted(self.by_key, want * len(self.by) + r[other])
                before, after = k - 1 >= self.edge[want], k < self.edge[want + 1]
                most = np.minimum(n[other], self.long)
                up, down = self.by[np.maximum(k - 1, 0)], self.by[np.minimum(k, len(self.by) - 1)]
                one = np.where(before, self.common(self.at_last[up], query, pos[other] + 1, np.where(before, most, 0)), -1)
                two = np.where(after, self.common(self.at_first[down], query, pos[other] + 1, np.where(after, most, 0)), -1)
                best, lower = np.where(two > one, down, up), two > one
                there = before | after
                o, best, lower = other[there], best[there], lower[there]
                r[o], n[o] = best, np.maximum(one, two)[there]
                row[o], at[o] = np.where(lower, self.run[best], self.last[best]), np.where(lower, self.at_first[best], self.at_last[best])
                lost = other[~there]  # symbols that the text doesn't have
                held = row[lost], at[lost]
            row, at, n = self.lf[r] + row - self.run[r], at - 1, n + 1
            if len(other) and len(lost):
                row[lost], at[lost], n[lost] = *held, 0
            yield order[:m], size[:m] - 1 - step, n, at, row

    def matches(self, data: np.ndarray, lengths: np.ndarray):
        """(string, offset, first place) of all places of the queries whose match has ``long`` symbols."""
        for string, offset, n, at, row in self.stream(data, lengths):
            hit = np.flatnonzero(n >= self.long)
            if len(hit):
                first = self.first_places(row[hit])
                yield string[hit], offset[hit], np.where(first >= 0, first, at[hit])

    def statistics(self, query: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of one query: for each place the length of its longest match and a place of it in the text."""
        length, place = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        for _, offset, n, at, _ in self.stream(np.frombuffer(query, np.uint8), np.array([len(query)])):
            length[offset], place[offset] = n, at
        return length, place
