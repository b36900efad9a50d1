"""Token ids of whole texts with the tokenizers library.

Both vocabularies split at white space before they merge, so a text's ids are
those of its pieces end to end.  A worker finds the pieces of a batch of texts
with numpy, encodes each distinct piece once and looks the rest up by a 64-bit
hash; the table of pieces lives as long as the worker and is emptied when it
passes a bound.  Texts with white space beyond ASCII are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import Rolling, chunks, flat
from ._words import SPACE, word_bounds

# White space beyond ASCII.
FAR_SPACE = "[\u0085   -     　]"
CHUNK = 2 << 20
#: Pieces of one joined text.
JOIN = 200
#: Pieces of Latin letters, digits and punctuation without an apostrophe, and the words that the vocabulary cuts them into.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+")
WHITE = ("", *"\t\n\v\f\r ")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def carried_bounds(data: np.ndarray, bounds: np.ndarray):
    """Pieces that keep their white space: a run of it less its last character, then that character, joined to the word if it is a space."""
    n = len(data)
    space = SPACE[data]
    head = np.zeros(n + 1, bool)
    head[bounds] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)  # the neighbour is solid / the last place before a solid one
    before[1:] = ~space[:-1]
    after[:-1] = ~space[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False  # nothing follows at a row's end
    plain = np.zeros(n, bool)
    plain[1:] = data[:-1] == 0x20
    first = np.where(space, before | after, ~(before | plain)) | head[:n]
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, bounds)


class Pieces:
    """Encoder over one vocabulary file.  ``carried``: white space belongs to the pieces."""

    def __init__(self, path: str, carried: bool, most: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.carried, self.most = carried, most
        self.edge = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)  # ids that begin a piece, or end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.startswith("Ġ") if carried else token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def singles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and their counts, each piece encoded alone."""
        counts, ids = [], []
        for lo in range(0, len(texts), 5_000):
            for e in self.tokenizer.encode_batch(texts[lo : lo + 5_000], add_special_tokens=False):
                one = e.ids
                counts.append(len(one))
                ids += one
        return np.array(ids, np.uint32), np.array(counts, np.int64)

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that can be told apart in a text made of many, which is quicker."""
        out, counts = [], []
        for lo in range(0, len(texts), JOIN * 25):
            groups = [texts[i : min(i + JOIN, lo + JOIN * 25)] for i in range(lo, min(len(texts), lo + JOIN * 25), JOIN)]
            encoded = self.tokenizer.encode_batch_fast([("" if self.carried else " ").join(g) for g in groups], add_special_tokens=False)
            for g, e in zip(groups, encoded):
                ids = np.array(e.ids, np.uint32)
                marks = np.flatnonzero(self.edge[ids])
                if self.carried:  # marks are first ids
                    good, cut = len(marks) == len(g) and marks[0] == 0, np.append(marks, len(ids))
                else:  # marks are last ids of words
                    ends = np.cumsum([len(WORD.findall(t)) for t in g])
                    good = len(marks) == ends[-1] and marks[-1] == len(ids) - 1
                    cut = np.append(0, marks[ends - 1] + 1) if good else None
                one = (ids, np.diff(cut)) if good else self.singles(g)
                out.append(one[0])
                counts.append(one[1])
        return np.concatenate(out), np.concatenate(counts)

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if self.carried:
            plain = np.array([t[0] == " " and t[1:2] not in WHITE for t in texts])
        else:
            plain = np.array([PLAIN.fullmatch(t) is not None for t in texts])
        parts = []
        for kind, way in ((True, self.joined), (False, self.singles)):
            at = np.flatnonzero(plain == kind)
            if len(at):
                parts.append((hashes[at], *way([texts[i] for i in at.tolist()])))
        hashes, new, counts = (np.concatenate(x) for x in zip(*parts))
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(new), self.used // 2), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known)
        self.known = known[order]
        self.start = np.concatenate([self.start, self.used + np.cumsum(counts) - counts])[order]
        self.count = np.concatenate([self.count, counts])[order]
        self.used += len(new)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and each row's bounds in them."""
        starts, ends, per = carried_bounds(data, bounds) if self.carried else word_bounds(SPACE[data], bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        every, first, back = np.unique(Rolling(data).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.clear()
        at = np.searchsorted(self.known, every)
        fresh = np.ones(len(every), bool)
        if len(self.known):
            fresh = self.known[np.minimum(at, len(self.known) - 1)] != every
        if fresh.any():
            raw, f = data.tobytes(), first[fresh]
            self.learn(every[fresh], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[f].tolist(), ends[f].tolist())])
            at = np.searchsorted(self.known, every)
        a, n = self.start[at][back], self.count[at][back]
        stop = np.cumsum(n)
        ids = self.ids[np.repeat(a - stop + n, n) + np.arange(stop[-1])]
        return ids, np.concatenate([[0], stop])[per]

    def rows(self, column: pa.Array):
        """Ids of each row of a string column, one array a row; null counts as empty."""
        column = column.fill_null("")
        odd = pc.match_substring_regex(column, FAR_SPACE).to_numpy(zero_copy_only=False)
        data, bounds = flat(column)
        for lo, hi in chunks(bounds, CHUNK):
            ids, cut = self.encode(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            for i in range(lo, hi):
                if odd[i]:
                    yield np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[cut[i - lo] : cut[i - lo + 1]]


_pieces: dict[tuple[str, bool], Pieces] = {}


def pieces(path: str, carried: bool) -> Pieces:
    """The worker's encoder for a vocabulary."""
    if (path, carried) not in _pieces:
        _pieces[path, carried] = Pieces(path, carried)
    return _pieces[path, carried]
