"""Sum-of-squares online packing of token sequences.

Windows hold ``window`` ids.  A document's full windows are cut off; what is
left is placed online, at the fill level h that makes the sum over levels of
N(h)^2 smallest, N(h) being the number of partly filled windows with h ids
(Csirik et al., 2006); ties go to the fullest window.  The level array is all the state, so a step
costs one pass over ``window`` numbers however many documents there were.

Each input partition packs its own rows in one pass without a shuffle; a
partition read again after a loss packs in the same way.  At a partition's end
the windows that are still open are closed by moving ids from the emptiest to
the fullest, so at most one window a partition is short.

Where input partitions end decides which documents share a window, as the method is
online: other partitions give another, equally valid packing.

Defined cases: null and empty texts are one end id; a document longer than a
window is cut, however long it is; repeated rows and ids are packed one by one; a null id stays
null; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import tidy

from ._tokenize import pieces, vocabulary_path


class Packer:
    """Online packer.  ``add`` returns the windows that became full; a window is a list of (tag, start, ids)."""

    def __init__(self, window: int = 1024):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)  # partly filled windows by fill; 0 and ``window`` stay 0
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def place(self, n: int) -> int:
        """The fill level that an item of ``n`` ids goes to, 0 for a new window."""
        level, w = self.level, self.window
        least, best = (2 * int(level[n]) + 1 if n < w else 0), 0
        if n < w:
            into = level[n : w + 1].copy()  # fills after the item, for h = 0 ..
            cost = 2 * into - 2 * level[: w + 1 - n] + 2
            cost[w - n] -= 1  # a window that fills up leaves the sum
            cost[0] = least
            cost[1:][level[1 : w + 1 - n] == 0] = 1 << 60
            h = int(w - n - np.argmin(cost[::-1]))
            if cost[h] < least or h and cost[h] == least:
                best = h
        return best

    def add(self, tag, ids: np.ndarray) -> list[list]:
        w, full, at = self.window, [], 0
        while len(ids) - at >= w:
            full.append([(tag, at, ids[at : at + w])])
            at += w
        rest = ids[at:]
        if len(rest):
            h, n = self.place(len(rest)), len(rest)
            if h:
                held = self.open[h].pop()
                self.level[h] -= 1
            else:
                held = []
            held.append((tag, at, rest))
            if h + n == w:
                full.append(held)
            else:
                self.open[h + n].append(held)
                self.level[h + n] += 1
        return full

    def close(self) -> list[list]:
        """Closes the open windows, filling the fullest with ids cut from the emptiest."""
        left = [(h, x) for h in range(self.window, 0, -1) for x in self.open[h]]
        i, j = 0, len(left) - 1
        while i < j:
            (h, x), (g, y) = left[i], left[j]
            tag, start, ids = y.pop()
            k = min(self.window - h, len(ids))
            if k < len(ids):
                y.append((tag, start, ids[: len(ids) - k]))
            x.append((tag, start + len(ids) - k, ids[len(ids) - k :]))
            left[i], left[j] = (h + k, x), (g - k, y)
            i += h + k == self.window
            j -= g - k == 0
        self.__init__(self.window)
        return [x for _, x in left if x]


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, id_col="doc_id", text_col="text", window=1024, vocabulary: str | None = None, end_id=0) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    ids_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        packer, first, done = Packer(window), TaskContext.get().partitionId() << 40, 0
        names = ["id", *(x.split()[0] for x in SCHEMA.split(", "))]
        kind = None

        def rows(windows):
            nonlocal done
            cols = [[] for _ in names]
            for w in windows:
                at = 0
                for (doc, total), start, ids in w:
                    for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, first + done, at)):
                        c.append(v)
                    at += len(ids)
                done += 1
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for b in tidy(batches):
            kind, doc, full = b.column(0).type, b.column(0).to_pylist(), []
            for d, ids in zip(doc, pieces(path, True).rows(b.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                full += packer.add((d, len(ids)), ids)
            yield rows(full)
        if kind is not None:
            yield rows(packer.close())

    read = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return read.mapInArrow(run, f"id {ids_type}, {SCHEMA}").withColumnRenamed("id", id_col)
