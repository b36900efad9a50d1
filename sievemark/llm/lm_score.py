"""Cross-entropy difference scores (Moore and Lewis 2010).

One vocabulary: the plain tokens that all documents hold at least twice (with
``words``, only so many of the most frequent), plus one id for the rest and one
for a text's start.  Over it two bigram models are counted: the target from the
documents labelled ``quality`` 1, the background from all documents.  They are
matched: same vocabulary, order and smoothing,

    P(b | a) = (c(a, b) + m P(b)) / (c(a) + m),  P(b) = (c(b) + 1) / (N + V).

All counts are exact, and their tables are distributed and grow with the corpus.
Texts are cut into chunks of about ``TOKENS`` tokens.  A chunk sends each of its
distinct tokens, later each of its distinct pairs, once to the shard of the key's
hash; the shard adds up and answers with the totals in the order of the question.
Frequent keys are asked for by every chunk, so with very many chunks shards are split
and add up level by level; no group grows with the corpus.
A document's score is the mean over its tokens of target loss less background
loss, in nats; lower is nearer to the target.

Defined cases: null, empty and wordless texts have no tokens, losses of 0 and
score 0; very long texts are counted whole, a chunk each; tokens that are equally frequent at the
vocabulary's edge (with ``words``) are in or out together; every input row gives one row; labels of unknown or null ids are
ignored, a repeated label counts if any of its rows has quality 1; without
labelled documents the target is flat; an empty table gives an empty result;
columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, dropped, flat, mix, staged, tidy
from ._words import tokens

CHUNK = 2 << 20
#: Tokens and rows that end a chunk.
TOKENS, ROWS = 1 << 20, 50_000
#: Tokens a shard of counts, and the fewest shards.
SHARD, SHARDS = 4 << 20, 64
#: Chunks whose questions one group takes.
FAN = 2048
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Stand for the tokens beyond the vocabulary, a text's start and the sum of all tokens.
REST, START, ALL = (np.uint64(x) for x in (0x1D8E4E27C47D124F, 0x5851F42D4C957F2D, 0x14057B7EF767814F))


def batch_tokens(column: pa.Array):
    """(first row, token hashes, tokens before each row) of each chunk of rows."""
    data, bounds = flat(column)
    for lo, hi in chunks(bounds, CHUNK):
        h, per, *_ = tokens(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        yield lo, h, per


def packed(a: np.ndarray) -> bytes:
    """An array by byte planes, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpacked(blob: bytes, kind) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob[8:], size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(a: np.ndarray) -> bytes:
    """Sorted hashes as packed differences."""
    return packed(np.diff(a, prepend=np.zeros(1, np.uint64)))


def summed(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, np.uint64), dtype=np.uint64)


PARTS = "chunk long, kind int, at int, ids binary, sizes binary, words binary, seq binary, good binary"


def rows_of(**columns) -> pa.RecordBatch:
    """Rows of PARTS; what isn't given is null."""
    kinds = {"chunk": pa.int64(), "kind": pa.int32(), "at": pa.int32()} | dict.fromkeys(("ids", "sizes", "words", "seq", "good"), pa.binary())
    n = len(columns["chunk"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))


def cut(docs: DataFrame) -> DataFrame:
    """Chunks of rows (kind 0): ids, tokens of each row, distinct tokens by hash, and each token's place among them."""

    def run(batches):
        part, k, held, n, rows = TaskContext.get().partitionId() << 32, 0, [], 0, 0

        def chunk():
            sink = pa.BufferOutputStream()
            ids = pa.record_batch([pa.concat_arrays([x[0] for x in held])], ["id"])
            with pa.ipc.new_stream(sink, ids.schema) as w:
                w.write_batch(ids)
            words, seq = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True)
            sizes = np.concatenate([x[2] for x in held])
            return rows_of(chunk=[part + k], kind=[0], ids=[sink.getvalue().to_pybytes()], sizes=[packed(sizes.astype(np.int32))], words=[steps(words)], seq=[packed(seq.astype(np.int32))])

        for b in tidy(batches):
            for lo, h, per in batch_tokens(b.column(1)):
                held.append((b.column(0).slice(lo, len(per) - 1), h, np.diff(per)))
                n, rows = n + len(h), rows + len(per) - 1
                if n >= TOKENS or rows >= ROWS:
                    yield chunk()
                    k, held, n, rows = k + 1, [], 0, 0
        if held:
            yield chunk()

    return docs.select("id", "text").mapInArrow(run, PARTS)


def ids_in(blob: bytes) -> pa.Array:
    return pa.ipc.open_stream(blob).read_all().column(0).combine_chunks()


def flags(parts: DataFrame, labels: DataFrame, ids: str) -> DataFrame:
    """Rows of kind 2: the places in each chunk of the rows that are labelled ``quality`` 1."""

    def places(batches):
        for b in tidy(batches):
            for c, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = ids_in(blob)
                yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(own), c)), pa.array(np.arange(len(own), dtype=np.int32))], ["id", "chunk", "place"])

    def blobs(batches):
        for b in tidy(batches):
            if b.num_rows:
                yield rows_of(chunk=b.column(0), kind=[2] * b.num_rows, good=[np.array(x, np.int32).tobytes() for x in b.column(1).to_pylist()])

    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    own = parts.select("chunk", "ids").mapInArrow(places, f"id {ids}, chunk long, place int")
    own = own.join(good.hint("merge"), "id", "left_semi")  # one plan at every size
    return own.groupBy("chunk").agg(F.collect_list("place").alias("places")).mapInArrow(blobs, PARTS)


def keyed(words: np.ndarray, seq: np.ndarray, sizes: np.ndarray, good: np.ndarray):
    """Distinct keys of a chunk's pairs, tokens, starts and sum in order of hash, their counts in all and in labelled rows, each token's key of pair, context and token, and the key of the sum."""
    own = words[seq]
    before = np.empty(len(own), np.uint64)
    before[1:] = own[:-1]
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[first] = START
    pairs, pair = np.unique(mix(mix(before ^ SEEDS[0]) ^ own), return_inverse=True)
    single, place = np.unique(np.concatenate([words, [REST, START, ALL]]), return_inverse=True)
    token, start, every = place[seq], place[-2], place[-1]
    context = np.empty(len(own), np.int64)
    context[1:] = token[:-1]
    context[first] = start
    labelled = np.repeat(good, sizes)

    def counts(ok: np.ndarray, rows: np.ndarray) -> np.ndarray:
        n = np.bincount(token[ok], minlength=len(single))
        n[start], n[every] = (sizes[rows] > 0).sum(), ok.sum()
        return np.concatenate([np.bincount(pair[ok], minlength=len(pairs)), n]).astype(np.uint64)

    keys = np.concatenate([pairs, mix(single ^ SEEDS[1])])
    order = np.argsort(keys)
    at = np.empty(len(keys), np.int64)
    at[order] = np.arange(len(keys))
    more = len(pairs)
    every_row = counts(np.ones(len(own), bool), np.ones(len(sizes), bool))
    return keys[order], every_row[order], counts(labelled, good)[order], (at[pair], at[more + context], at[more + token], at[more + every])


def asked(parts: DataFrame, shards: int, pairs: bool) -> DataFrame:
    """Each chunk's distinct keys with their counts, by shard: the tokens, or all that ``keyed`` gives."""

    def run(batches):
        for b in tidy(batches):
            for r in b.to_pylist():
                words, seq = summed(r["words"]), unpacked(r["seq"], np.int32)
                if pairs:
                    keys, n, t, _ = keyed(words, seq, unpacked(r["sizes"], np.int32), unpacked(r["good"], bool))
                else:
                    keys, n = words, np.bincount(seq, minlength=len(words)).astype(np.uint64)
                    t = n[:0]
                shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
                edge = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(edge))
                span = [slice(edge[i], edge[i + 1]) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([r["chunk"]] * len(some), pa.int64()), *(pa.array([f(x[s]) for s in span], pa.binary()) for f, x in ((steps, keys), (packed, n), (packed, t)))],
                    ["shard", "chunk", "key", "n", "t"],
                )

    return parts.select("chunk", "sizes", "words", "seq", "good").mapInArrow(run, "shard int, chunk long, key binary, n binary, t binary")


def answered(questions: DataFrame, least: int, chunks: int, fan: int = FAN) -> DataFrame:
    """Rows of kind 1: totals for each question, in ``words`` of all rows, in ``good`` of labelled ones.

    Rows of kind 3 say in ``chunk`` how many keys of at least ``least`` have the level ``at``.  A key that stands in
    every chunk is asked for by all of them; so beyond ``fan`` chunks a shard is split, its parts ask for the sums of their
    own questions, by the same rule, and answer these with what they are told.  No group gets more than about ``fan`` rows.
    """
    parts = -(-chunks // fan)
    if parts > 1:
        return answered_by_parts(questions, least, parts, fan)

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, asks = group[0].as_py(), [r for b in batches for r in b.to_pylist()]
        every, own, total = added(asks)
        for i, r in enumerate(asks):
            n, t = (b"" if x is None else packed(x[own[i]]) for x in total)
            yield rows_of(chunk=[r["chunk"]], kind=[1], at=[shard], words=[n], good=[t])
        levels, n = np.unique(level(total[0][total[0] >= least]), return_counts=True)
        yield rows_of(chunk=n, kind=[3] * len(n), at=levels)

    return questions.groupBy("shard").applyInArrow(run, PARTS)


def added(asks: list[dict]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray | None]]:
    """All keys of some questions, the places of each question's keys among them, and their sums."""
    key = [summed(r["key"]) for r in asks]
    edge = np.cumsum([0, *map(len, key)])
    every, at = np.unique(np.concatenate(key), return_inverse=True)
    total = []
    for c in ("n", "t"):
        x = np.concatenate([unpacked(r[c], np.uint64) for r in asks])
        total.append(np.bincount(at, x, len(every)).astype(np.uint64) if len(x) else None)
    return every, [at[a:z] for a, z in zip(edge[:-1], edge[1:])], total


def answered_by_parts(questions: DataFrame, least: int, parts: int, fan: int) -> DataFrame:
    questions = staged(questions.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts))), "lm-questions")

    def sums(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, _, total = added([r for b in batches for r in b.to_pylist()])
        n, t = (b"" if x is None else packed(x) for x in total)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([group[0].as_py()], pa.int32()), "chunk": pa.array([group[1].as_py()], pa.int64()), "key": pa.array([steps(every)], pa.binary()), "n": pa.array([n], pa.binary()), "t": pa.array([t], pa.binary())})

    asks = questions.groupBy("shard", "part").applyInArrow(sums, "shard int, chunk long, key binary, n binary, t binary")
    told = staged(answered(asks, least, parts, fan), "lm-told")

    def reply(own: pa.Table, answer: pa.Table) -> pa.Table:
        asks, said = own.to_pylist(), answer.to_pylist()[0]
        at = added([r | {"n": b"\0" * 8, "t": b"\0" * 8} for r in asks])[1]
        total = [unpacked(said[c], np.uint64) for c in ("words", "good")]
        n, t = ([packed(x[i]) if len(x) else b"" for i in at] for x in total)
        return pa.Table.from_batches([rows_of(chunk=[r["chunk"] for r in asks], kind=[1] * len(asks), at=[r["shard"] for r in asks], words=n, good=t)])

    answers = told.where("kind = 1").select(F.col("at").alias("shard"), F.col("chunk").alias("part"), "words", "good")
    return questions.groupBy("shard", "part").cogroup(answers.groupBy("shard", "part")).applyInArrow(reply, PARTS).unionByName(told.where("kind = 3"))


def level(n: np.ndarray) -> np.ndarray:
    """Eight levels an octave."""
    return np.floor(8 * np.log2(n.astype(np.float64))).astype(np.int64)


def lowest(answers: DataFrame, words: int | None) -> tuple[int, int]:
    """The lowest level of the vocabulary, and its tokens.  A level that would not fit into ``words`` as a whole is left out."""
    floor, size = 1 << 30, 0
    for r in answers.where("kind = 3").groupBy("at").agg(F.sum("chunk").alias("tokens")).orderBy(F.desc("at")).collect():  # a few hundred levels at most
        if words is not None and size + r.tokens > words:
            break
        floor, size = r["at"], size + r.tokens
    return floor, size


def together(group_batches) -> tuple[dict, list[dict], list[np.ndarray]]:
    """A chunk's own row, its answers in order of shard, and its labelled rows."""
    rows = [r for b in group_batches for r in b.to_pylist()]
    answers = sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["at"])
    return next(r for r in rows if r["kind"] == 0), answers, [np.frombuffer(r["good"], np.int32) for r in rows if r["kind"] == 2]


def mapped(parts: DataFrame, answers: DataFrame, flagged: DataFrame, least: int, floor: int) -> DataFrame:
    """The chunks with tokens beyond the vocabulary as one, and with marks at labelled rows."""

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, said, places = together(batches)
        words, seq = summed(own["words"]), unpacked(own["seq"], np.int32)
        if len(words):
            n = np.concatenate([unpacked(r["words"], np.uint64) for r in said])
            words, place = np.unique(np.where((n < least) | (level(n) < floor), REST, words), return_inverse=True)
            seq = place.astype(np.int32)[seq]
        good = np.zeros(len(unpacked(own["sizes"], np.int32)), bool)
        for x in places:
            good[x] = True
        yield rows_of(chunk=[own["chunk"]], kind=[0], ids=[own["ids"]], sizes=[own["sizes"]], words=[steps(words)], seq=[packed(seq)], good=[packed(good)])

    return parts.unionByName(answers.where("kind = 1")).unionByName(flagged).groupBy("chunk").applyInArrow(run, PARTS)


def scored(parts: DataFrame, answers: DataFrame, v: int, smooth: float, ids: str) -> DataFrame:
    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, said, _ = together(batches)
        sizes = unpacked(own["sizes"], np.int32)
        *_, (pair, context, token, every) = keyed(summed(own["words"]), unpacked(own["seq"], np.int32), sizes, unpacked(own["good"], bool))
        mean, end = [], np.cumsum(sizes)
        for c in ("good", "words"):
            n = np.concatenate([unpacked(r[c], np.uint64) for r in said]).astype(np.float64)
            p = (n[token] + 1) / (n[every] + v)
            sums = np.concatenate([[0.0], np.cumsum(-np.log((n[pair] + smooth * p) / (n[context] + smooth)))])
            mean.append((sums[end] - sums[end - sizes]) / np.maximum(sizes, 1))
        t, g = mean
        yield pa.RecordBatch.from_arrays([ids_in(own["ids"]), pa.array(sizes.astype(np.int64)), pa.array(t), pa.array(g), pa.array(t - g)], ["id", "n_tokens", "target_loss", "background_loss", "score"])

    return parts.unionByName(answers.where("kind = 1")).groupBy("chunk").applyInArrow(run, f"id {ids}, n_tokens long, target_loss double, background_loss double, score double")


def score_cross_entropy(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", words: int | None = None, smooth: float = 20.0, least: int = 2, fan: int = FAN) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) for every row."""
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    ids = docs.schema["id"].dataType.simpleString()
    parts = staged(cut(docs), "lm-chunks")
    about = parts.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n"), F.count("*").alias("chunks")).first()
    size = about.n // 6  # about six bytes a token
    counts = staged(answered(asked(parts, max(SHARDS, size // SHARD), False), least, about.chunks, fan), "lm-tokens")
    floor, v = lowest(counts, words)
    known = staged(mapped(parts, counts, flags(parts, labels, ids), least, floor), "lm-mapped")
    dropped(spark, parts, counts)
    size = known.agg(F.coalesce(F.sum(F.octet_length("seq")), F.lit(0)).alias("n")).first().n // 2  # about two bytes a token
    answers = answered(asked(known, max(SHARDS, size // SHARD), True), least, about.chunks, fan)
    return scored(known, answers, v + 2, smooth, ids).withColumnRenamed("id", id_col)
