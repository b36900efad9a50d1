"""Collocations: phrases whose words stand together more often than their parts let expect.

Counting every n-gram exactly would move nearly all of them, though nearly none is
frequent.  So the texts are read twice.

1. Each task counts its n-grams in a count-min sketch (two rows of one-byte
   counters that stop at 255).  Sketches of all tasks are added block by block.  A
   counter is never less than the count of any n-gram that falls on it.
2. N-grams whose counters, and those of all their parts, reach the threshold
   survive; they are counted exactly, by their words.  An n-gram that reaches the
   threshold always survives, and its parts, being as frequent, do as well, so every
   number that the score needs is exact.

Then candidates are scored by their weakest cut, and those that only live inside a longer
candidate are dropped.

The sketch has one counter for 16 to 32 bytes of text, up to ``2 ** most_bits`` a row; beyond that
(2 GB of text with the default) more rare n-grams survive the first pass, which costs time and shuffle, and
never results.  A task holds two bytes, a broadcast two bits for each counter of a row.

Defined cases: null and empty texts give nothing; a null language counts as ``und``; repeated
rows count as often as they stand there; an empty table gives an empty result; texts are read whole;
other columns are not read, so their names can't clash; ties in the ranking go by count, then by the phrase's bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Rolling, chunks, flat, mix, staged, tidied, tidy
from ._words import lowered, word_bounds

#: What ends a piece, and what ends a word within a piece.
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:!?"]] = True
STOP[0x0A:0x0E] = True
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Multipliers that give a sketch's rows their own places.
ROWS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
CHUNK, BLOCK = 1 << 20, 1 << 18


class Grams:
    """The words of a chunk of texts, exactly numbered, and the hashes of the n-grams within pieces."""

    def __init__(self, langs: pa.Array, data: np.ndarray, bounds: np.ndarray, longest: int):
        data = lowered(data)
        stop = STOP[data]
        space = stop | BLANK[data]
        first, last, per = word_bounds(space, bounds)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(per))
        piece = np.cumsum(stop)[first] + row if len(first) else first
        cuts = np.concatenate(([0], np.cumsum(last - first))).astype(np.int32)
        solid = np.ascontiguousarray(data[~space])
        words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(solid)]).dictionary_encode()
        self.words, self.word = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        coded = langs.dictionary_encode()
        self.langs, self.lang = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        self.rows_lang = coded.indices.to_numpy(zero_copy_only=False)
        self.inside = [np.ones(len(first), bool)]
        for k in range(1, longest):
            same = np.zeros(len(first), bool)
            if len(first) > k:
                same[:-k] = piece[:-k] == piece[k:]
            self.inside.append(same)
        raw, b = flat(self.words)
        each = Rolling(raw).of(b[:-1], b[1:]) if len(b) > 1 else np.zeros(0, np.uint64)
        tongue, b = flat(pa.array(self.langs, pa.string()))
        tongue = mix(Rolling(tongue).of(b[:-1], b[1:]) + ODD) if len(b) > 1 else np.zeros(0, np.uint64)
        token = each[self.word]
        self.hash = [mix(token * ODD + tongue[self.lang])]
        for k in range(1, longest):
            g = np.zeros(len(first), np.uint64)
            if len(first) > k:
                g[:-k] = mix(self.hash[-1][:-k] * ODD + token[k:])
            self.hash.append(g)


def places(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes * ROWS[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def added(counters: np.ndarray, at: np.ndarray) -> None:
    """Adds one at each place, up to 255."""
    at = np.sort(at)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    much = np.diff(np.append(first, len(at)))
    place = at[first]
    counters[place] = np.minimum(counters[place] + np.minimum(much, 255), 255).astype(np.uint8)


def sketch(texts: DataFrame, least: int, longest: int, bits: int) -> list[np.ndarray]:
    """One bit a counter, a bitmap a row of the sketch: whether the counters of all tasks add up to ``least``."""
    width, block = 1 << bits, min(BLOCK, 1 << bits)

    def count(batches):
        rows = [np.zeros(width, np.uint8) for _ in ROWS]
        for b in tidy(batches):
            data, bounds = flat(b.column(1))
            for lo, hi in chunks(bounds, CHUNK):
                g = Grams(b.column(0)[lo:hi], data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], longest)
                every = np.concatenate([h[i] for h, i in zip(g.hash, g.inside, strict=True)])
                for r, counters in enumerate(rows):
                    added(counters, places(every, r, bits))
        for r, counters in enumerate(rows):
            for k in range(0, width, block):
                some = counters[k : k + block]
                if some.any():
                    yield pa.RecordBatch.from_pydict({"place": pa.array([r * width + k], pa.int64()), "counts": pa.array([pa.compress(some.tobytes(), "zstd", asbytes=True)], pa.binary())})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for place, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = np.frombuffer(pa.decompress(counts, block, "zstd", asbytes=True), np.uint8)
                have = sums.get(place)
                sums[place] = new if have is None else (have + np.minimum(new, 255 - have)).astype(np.uint8)
        for place in sorted(sums):
            yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64()), "reached": pa.array([np.packbits(sums[place] >= least).tobytes()], pa.binary())})

    parts = max(1, min(2 * width // block, 64))
    summed = texts.mapInArrow(count, "place bigint, counts binary").repartition(parts, "place").mapInArrow(merge, "place bigint, reached binary")
    maps = [np.zeros(width // 8, np.uint8) for _ in ROWS]
    for place, reached in summed.collect():  # at most 2 ** bits bits a row
        r, k = divmod(place, width)
        maps[r][k // 8 : k // 8 + block // 8] = np.frombuffer(bytes(reached), np.uint8)
    return maps


def survivors(g: Grams, maps: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """For each size, where n-grams start whose counters, and those of their parts, reach the threshold."""
    out: list[np.ndarray] = []
    for k, (h, inside) in enumerate(zip(g.hash, g.inside, strict=True)):
        ok = inside
        if k:
            ok = inside & out[-1]
            ok[:-1] &= out[-1][1:]
        at = np.flatnonzero(ok)
        for r, bitmap in enumerate(maps):
            p = places(h[at], r, bits)
            at = at[(bitmap[p >> np.uint32(3)] >> (np.uint8(7) - (p & np.uint32(7)).astype(np.uint8))) & 1 == 1]
        ok = np.zeros(len(h), bool)
        ok[at] = True
        out.append(ok)
    return out


def exact_counts(texts: DataFrame, maps: list[np.ndarray], least: int, longest: int, bits: int) -> DataFrame:
    """Counts of all n-grams that reach ``least``, and the words of each language as size 0."""
    held = texts.sparkSession.sparkContext.broadcast([m.tobytes() for m in maps])

    def count(batches):
        bitmaps = [np.frombuffer(m, np.uint8) for m in held.value]
        for b in tidy(batches):
            data, bounds = flat(b.column(1))
            for lo, hi in chunks(bounds, CHUNK):
                g = Grams(b.column(0)[lo:hi], data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], longest)
                langs, sizes, phrases, numbers = [], [], [], []

                def add(size: int, lang: np.ndarray, text: pa.Array, much: np.ndarray) -> None:
                    langs.append(lang)  # noqa: B023
                    sizes.append(np.full(len(lang), size, np.int8))  # noqa: B023
                    phrases.append(text)  # noqa: B023
                    numbers.append(much)  # noqa: B023

                total = np.bincount(g.lang, minlength=len(g.langs))
                spoken = np.flatnonzero(total)
                add(0, spoken, pa.array([""] * len(spoken), pa.string()), total[spoken])
                alive, v = survivors(g, bitmaps, bits), max(len(g.words), 1)
                code, words, texts_of = g.lang, g.words.cast(pa.string()), None
                for k in range(longest):
                    at = np.flatnonzero(alive[k])
                    if not len(at):
                        break
                    key = code[at] * v + g.word[at + k]  # language and words so far, then one more word
                    distinct, which, much = np.unique(key, return_inverse=True, return_counts=True)
                    ends = words.take(pa.array(distinct % v))
                    texts_of = ends if texts_of is None else pc.binary_join_element_wise(texts_of.take(pa.array(distinct // v)), ends, " ")
                    somewhere = np.zeros(len(distinct), np.int64)
                    somewhere[which] = at
                    add(k + 1, g.lang[somewhere], texts_of, much)
                    code = np.zeros(len(g.word), np.int64)
                    code[at] = which
                names = pa.array(g.langs, pa.string())
                if langs:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(langs))), pa.array(np.concatenate(sizes)), pa.concat_arrays(phrases), pa.array(np.concatenate(numbers).astype(np.int64))], ["lang", "size", "phrase", "f"])

    found = texts.mapInArrow(count, "lang string, size tinyint, phrase string, f bigint")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("size") == 0) | (F.col("f") >= least))


def text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def phrase_counts(docs: DataFrame, *, least: int = 30, longest: int = 4, lang_col: str = "lang", text_col: str = "text", most_bits: int = 26) -> DataFrame:
    """(lang, size, phrase, f) of all n-grams up to ``longest`` words that occur ``least`` times; size 0 has the words of a language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    volume = text_bytes(texts)
    bits = min(max((volume // 32).bit_length(), 12), most_bits)
    # A sketch leaves the task whole, so few tasks count much text each.
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, volume >> 28)
    maps = sketch(texts.coalesce(tasks), least, longest, bits)
    return exact_counts(texts, maps, least, longest, bits)


@tidied
def collocations(docs: DataFrame, *, least: int = 30, longest: int = 4, share: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text", most_bits: int = 26) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate is dropped when a longer one that contains it has ``share`` per cent of its occurrences or more.
    """
    counts = staged(phrase_counts(docs, least=least, longest=longest, lang_col=lang_col, text_col=text_col, most_bits=most_bits), "phrase_counts")
    spoken = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("size > 0").select("lang", "phrase", "f")
    candidates = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))

    cuts = candidates.select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - size)").alias("right")
    )
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(a as decimal(19)) * 2000000) div (cast(l as decimal(19)) + r)")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    # Every shorter phrase of two words or more inside a candidate, with the most frequent candidate around it.
    within = candidates.where("size > 2").select("lang", "a", F.split("phrase", " ").alias("w"), "size")
    within = within.select("lang", "a", F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    )).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = weakest.join(within, ["lang", "phrase"], "left").where("around is null or cast(around as decimal(19)) * 100 < cast(a as decimal(19)) * " + str(int(share)))

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(spoken) if spoken.limit(10_001).count() <= 10_000 else spoken, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB's SQL.
SQL = r"""WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
    counted AS (SELECT lang, k AS size, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces, range(1, 5) AS t(k)) GROUP BY ALL),
    spoken AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
    known AS (SELECT * FROM counted WHERE f >= 30),
    candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM known WHERE size > 1),
    cuts AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
        JOIN known l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN known r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
    weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    around AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
        FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates WHERE size > 2)) GROUP BY ALL),
    kept AS (SELECT w.* FROM weakest w LEFT JOIN around s ON s.lang = w.lang AND s.phrase = w.phrase WHERE s.a IS NULL OR 100::HUGEINT * s.a < 80::HUGEINT * w.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
    FROM kept JOIN spoken USING (lang) QUALIFY rank <= 2000"""
