"""Toxic passages by maximum-scoring segments.

Training: a bounded sample of labelled rows (``train_rows``, smallest hashes of
the id first) gives, for each token, the numbers of distinct toxic and clean
texts that hold it.  Tokens get log-odds with an informative Dirichlet prior;
those whose likelihood ratio against equal shares is beyond ``chance``, divided
by the number of tokens tested, make the model, at most ``most_tokens`` of them.
All other tokens carry one small negative score, so that the expected score is
negative and segment statistics hold.

Scoring: every text is scanned once in linear time (Ruzzo and Tompa 1999) for
all maximal scoring segments.  A segment of score S in a text of m tokens has
the expected number of chance equals E = K m exp(-lambda S) (Karlin and Altschul
1990); lambda solves sum p exp(lambda s) = 1 over clean text, where a token has the
share that was counted and that of the prior, and K is fitted to clean training texts.  A document's evidence is the sum of -ln E over its
significant passages, and a logistic curve fitted on the training sample maps it
to a probability.

Scoring is one pass without a shuffle; only the training sample moves.

Defined cases: null and empty texts have no passage and get the score of that;
each input row gives one row, repeated ids included; without labelled rows of
both classes every score is 0; very long texts are scanned whole; which rows are
near each other in partitions changes no score; a null id is never trained on and not held out; an
empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, flat, hash_sample, mix, rows_kept, tidy
from ._words import tokens

CHUNK = 1 << 20
SHINGLE = 5


@dataclass
class Model:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = -0.05
    decay: float = 1.0  # lambda
    k: float = 1e-3
    slope: float = 0.0
    intercept: float = -50.0


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in linear time."""
    total, stack = 0.0, []  # of [start, end, sum before, sum with]
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            # the nearest earlier candidate whose left sum is smaller; those between can never be joined
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                stack.append([*new, j])
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(a, b, r - x) for a, b, x, r, _ in stack]


def passages(at: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """Maximal segments over a text in which only the tokens at ``at`` have positive scores."""
    steps, places = [], []
    last = -1
    for p, s in zip(at.tolist(), scores.tolist()):
        if p - last > 1:
            steps.append(drift * (p - last - 1))
            places.append(last + 1)
        steps.append(s)
        places.append(p)
        last = p
    return [(places[a], places[b - 1] + 1, s) for a, b, s in maximal_segments(steps)]


def hits(model_hashes: np.ndarray, model_scores: np.ndarray, hashes: np.ndarray):
    """Positions of the model's tokens among ``hashes`` and their scores."""
    if not len(model_hashes) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0)
    i = np.minimum(np.searchsorted(model_hashes, hashes), len(model_hashes) - 1)
    at = np.flatnonzero(model_hashes[i] == hashes)
    return at, model_scores[i[at]]


def evidence(found: list[tuple[int, int, float]], n: int, m: Model) -> float:
    """Sum of -ln E over passages with E below 1."""
    return sum(x for *_, s in found if (x := m.decay * s - math.log(m.k * max(n, 1))) > 0)


def row_tokens(text: pa.Array):
    """(first row, token hashes, tokens before each row) of each chunk of rows."""
    data, bounds = flat(text)
    for lo, hi in chunks(bounds, CHUNK):
        h, per, *_ = tokens(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        yield lo, h, per


def walk(text: pa.Array, hashes: np.ndarray, scores: np.ndarray, drift: float):
    """For each row (row, number of tokens, its passages); rows without a hit have none."""
    for lo, h, per in row_tokens(text):
        at, s = hits(hashes, scores, h)
        row = np.searchsorted(per, at, "right") - 1
        cut = np.searchsorted(row, np.arange(len(per)))
        for i in range(len(per) - 1):
            a, b = cut[i], cut[i + 1]
            yield lo + i, int(per[i + 1] - per[i]), passages(at[a:b] - per[i], s[a:b], drift) if b > a else []


def held_out(id_col):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(toxic, text) of at most ``rows`` labelled rows that aren't held out.

    Texts with the same smallest shingle hash, so most near copies, count once; which one follows from the rows alone.
    """
    chosen = (
        labels.select(labels["doc_id"].alias("k"), labels["toxic"].cast("int").alias("toxic"))
        .where(F.col("k").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("k")))
        .groupBy("k").agg(F.max("toxic").alias("toxic"))
    )
    chosen = hash_sample(chosen, "k", rows, chosen.count())
    found = docs.select(docs[id_col].alias("k"), docs[text_col].cast("string").alias("text")).join(F.broadcast(chosen), "k")  # at most ``rows`` ids

    def sketch(batches):
        for b in tidy(batches):
            keys = []
            for _, h, per in row_tokens(b.column("text")):
                m = max(0, len(h) - SHINGLE + 1)
                x = np.zeros(m, np.uint64)
                for j in range(SHINGLE if m else 0):
                    x = mix(x + h[j : j + m])
                for a, z in zip(per[:-1].tolist(), per[1:].tolist()):
                    keys.append(int((x[a : z - SHINGLE + 1].min() if z - a >= SHINGLE else mix(h[a:z]).sum(dtype=np.uint64)).view(np.int64)))
            yield b.append_column("key", pa.array(keys, pa.int64()))

    rows = found.select("toxic", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sketch, "toxic int, text string, key long")
    # of several texts with one key the toxic one stays, then that of the smallest hash, then of the smallest text
    first = F.min(F.struct((-F.col("toxic")).alias("toxic"), F.xxhash64("text").alias("h"), "text")).alias("s")
    return rows.groupBy("key").agg(first).select((-F.col("s.toxic")).alias("toxic"), "s.text")


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", train_rows=40_000, least_toxic=3, chance=0.01, most_tokens=100_000, prior=10.0) -> Model:
    from ._common import dropped, staged

    sample = staged(training_sample(docs, labels, id_col, text_col, train_rows), "toxic-sample")
    held = (F.col("t") >= least_toxic)

    def present(batches, only=None):
        """Of each batch: token, toxic texts and clean texts with it; token 0 counts the texts."""
        for b in tidy(batches):
            every_toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for lo, h, per in row_tokens(b.column("text")):
                toxic = every_toxic[lo : lo + len(per) - 1]
                row = np.repeat(np.arange(len(toxic)), np.diff(per))
                if only is not None and len(h):
                    keep = hits(only, np.zeros(len(only)), h)[0]
                    h, row = h[keep], row[keep]
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, t = h[new], toxic[row[new]]
                u, inverse = np.unique(h, return_inverse=True)
                one = np.bincount(inverse, t, len(u)).astype(np.int64)
                every = np.bincount(inverse, minlength=len(u))
                u, one, every = np.append(u, np.uint64(0)), np.append(one, toxic.sum()), np.append(every, len(toxic))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(one), pa.array((every - one).astype(np.int64))], ["token", "t", "c"])

    schema = "token long, t long, c long"
    first = sample.where("toxic > 0").mapInArrow(present, schema).groupBy("token").agg(F.sum("t").alias("t"))
    first = first.where(held & (F.col("token") != 0)).orderBy(F.desc("t"), "token").limit(most_tokens)
    candidates = np.sort(np.array([r.token for r in first.select("token").collect()], np.int64).view(np.uint64))  # at most most_tokens
    counted = sample.mapInArrow(lambda it: present(it, candidates), schema).groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).toPandas()  # likewise
    total = counted[counted.token == 0]
    counted = counted[counted.token != 0]
    if not len(total) or not total.t.iloc[0] or not total.c.iloc[0]:
        dropped(sample.sparkSession, sample)
        return Model()
    nt, nc = float(total.t.iloc[0]), float(total.c.iloc[0])
    t, c = counted.t.to_numpy(float), counted.c.to_numpy(float)
    a = prior * (t + c) / (nt + nc) + 0.01
    odds = np.log((t + a) / (nt + prior - t - a + 1)) - np.log((c + a) / (nc + prior - c - a + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        share = nt / (nt + nc)
        ratio = 2 * (np.where(t > 0, t * np.log(t / ((t + c) * share)), 0) + np.where(c > 0, c * np.log(c / ((t + c) * (1 - share))), 0))
    keep = (ratio >= 2 * math.log(max(2, len(t)) / chance)) & (odds > 0.7)
    hashes, scores = counted.token.to_numpy()[keep].view(np.uint64), odds[keep]
    order = np.argsort(hashes)
    hashes, scores = hashes[order], scores[order]
    m = Model(hashes, scores)
    if not len(hashes):
        dropped(sample.sparkSession, sample)
        return m

    def measured(batches):
        """Of each clean text its tokens and best score (token null); of each batch of them the model's tokens and how often they stand there."""
        for b in tidy(batches):
            if not b.num_rows:
                continue
            rows = [(n, max((s for *_, s in found), default=0.0)) for _, n, found in walk(b.column("text"), hashes, scores, m.drift)]
            every = np.concatenate([h[hits(hashes, scores, h)[0]] for _, h, _ in row_tokens(b.column("text"))])
            token, n = np.unique(every, return_counts=True)
            value = pa.array([*(x[1] for x in rows), *map(float, n)], pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(rows) + token.view(np.int64).tolist(), pa.int64()), pa.array([x[0] for x in rows] + [0] * len(token), pa.int64()), value], ["token", "n", "value"])

    clean = sample.where("toxic = 0")
    seen = staged(clean.mapInArrow(measured, "token long, n long, value double"), "toxic-clean")
    size = float(seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n) + 1
    often = seen.where("token is not null").groupBy("token").agg(F.sum("value").alias("value")).toPandas()  # at most most_tokens rows
    held_by = np.zeros(len(hashes))
    held_by[np.searchsorted(hashes, often.token.to_numpy(np.int64).view(np.uint64))] = often.value
    share = clean_share(held_by, a[keep][order], size)
    m.drift = min(m.drift, -2 * float(share @ scores) / (1 - float(share.sum())))
    if m.drift < Model.drift:  # clean text is so full of the model's tokens that the usual drift wouldn't outweigh them
        dropped(sample.sparkSession, seen)
        seen = staged(clean.mapInArrow(measured, "token long, n long, value double"), "toxic-clean")
    m.decay = decay(share, scores, m.drift)
    floor = float(np.quantile(scores, 0.1))
    m.k = (seen.where(F.col("token").isNull() & (F.col("value") >= floor)).count() + 0.5) / size * math.exp(m.decay * floor)

    def weighed(batches):
        for b in tidy(batches):
            x = [evidence(found, n, m) for _, n, found in walk(b.column("text"), hashes, scores, m.drift)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column("toxic")], ["x", "toxic"])

    x = sample.mapInArrow(weighed, "x double, toxic int").toPandas()  # at most train_rows rows of numbers
    x = x.sort_values(["x", "toxic"])  # so that sums don't depend on the order of rows
    m.slope, m.intercept = logistic(np.log1p(x.x.to_numpy()), (x.toxic > 0).to_numpy(float))
    dropped(sample.sparkSession, seen)
    dropped(sample.sparkSession, sample)
    return m


def clean_share(n: np.ndarray, prior: np.ndarray, size: float) -> np.ndarray:
    """Shares of the model's tokens in clean text: what was counted, and the Dirichlet prior's, so that none is zero; half of the text at most."""
    share = (n + prior) / (size + prior.sum())
    return share * min(1.0, 0.5 / share.sum())


def decay(share: np.ndarray, scores: np.ndarray, drift: float) -> float:
    """lambda: the sum of p exp(lambda s) over clean text, ``share`` of tokens with ``scores`` and all others with ``drift``, is 1.

    There is exactly one such positive number if the expected score is negative and some score with a share is positive; else this raises.
    """

    def beyond(x: float) -> float:
        return float((share * np.expm1(np.minimum(700, x * scores))).sum()) + (1 - float(share.sum())) * math.expm1(x * drift)

    if not float(share @ scores) + (1 - float(share.sum())) * drift < 0 or not ((share > 0) & (scores > 0)).any():
        raise ValueError("no extreme-value calibration: scores over clean text must have a negative mean and a positive part")
    high = 1.0
    while beyond(high) <= 0:
        high *= 2
    low = high / 2
    while beyond(low) > 0:
        low /= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beyond(mid) <= 0 else (low, mid)
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a light ridge."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.array([0.0, math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w * np.array([1, 0]))
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def probability(found: list[tuple[int, int, float]], n: int, m: Model) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * math.log1p(evidence(found, n, m)) + m.intercept))))


def score(docs: DataFrame, m: Model, id_col="doc_id", text_col="text", threshold=0.3) -> DataFrame:
    """(id, score, predicted, n_passages, passages) for every row."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("neg_ln_e", pa.float64())]))

    def run(batches):
        for b in tidy(batches):
            p, spans = [], []
            for _, n, found in walk(b.column(1), m.hashes, m.scores, m.drift):
                p.append(probability(found, n, m))
                base = math.log(m.k * max(n, 1))
                spans.append([{"start": s, "end": e, "neg_ln_e": m.decay * v - base} for s, e, v in found])
            p = pa.array(p, pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), p, pa.array([int(v.as_py() >= threshold) for v in p], pa.int32()), pa.array(spans, span)], ["id", "score", "predicted", "passages"])

    ids = docs.schema[id_col].dataType.simpleString()
    read = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = read.mapInArrow(run, f"id {ids}, score double, predicted int, passages array<struct<start:int,end:int,neg_ln_e:double>>")
    return out.select(F.col("id").alias(id_col), "score", "predicted", F.size("passages").alias("n_passages"), "passages")


def score_toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Trains on the labelled rows that aren't held out and scores every row."""
    scored = score(docs, train(docs, labels, **settings))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages", "passages")


def without_toxic(docs: DataFrame, labels: DataFrame, text_col="text", threshold=0.3, **settings) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns."""
    m = train(docs, labels, text_col=text_col, **settings)
    return rows_kept(docs, lambda b: [probability(found, n, m) < threshold for _, n, found in walk(b.column(text_col).cast(pa.string()), m.hashes, m.scores, m.drift)])
