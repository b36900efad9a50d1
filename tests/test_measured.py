"""Token windows and budgets, similar cache entries."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievemark.functions import tokens
from sievemark.operators import caches
from sievemark.plans.measured import VOCABULARY

LONG = "long text, " * 30_000


def plain_similar(requests, entries, threshold, nearest):
    out = set()
    for q, scope, v in requests:
        hits = []
        for i, s, w in entries:
            if s == scope and v and w and len(v) == len(w) and all(x is not None and math.isfinite(x) for x in v + w) and any(v) and any(w):
                c = round(sum(a * b for a, b in zip(v, w)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w)), 9)
                if c >= threshold:
                    hits.append((-c, i))
        out |= {(q, i, -c, n) for n, (c, i) in enumerate(sorted(hits)[:nearest], 1)}
    return out


def blurred(rng, v, by):
    return [x + rng.gauss(0, by) for x in v]


def vectors(seed=3, groups=12, width=24):
    """A scope that holds most entries, small ones, copies, vectors that can't be used, and two lengths."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(groups)]
    entries = [(i, "hot" if i % 5 else f"s{i % 3}", blurred(rng, centres[i % groups], rng.choice([0.0, 0.1, 0.3]))) for i in range(600)]
    entries += [(1000 + i, "hot", centres[0]) for i in range(200)]  # more copies than are asked for
    entries += [(2000, "hot", None), (2001, "hot", []), (2002, "hot", [0.0] * width), (2003, "hot", [math.nan] * width), (2004, "hot", [1.0, 2.0]), (2005, "s0", [math.inf] * width)]
    requests = [(i, "hot" if i % 4 else "s0", blurred(rng, centres[i % groups], 0.05)) for i in range(60)]
    requests += [(100, "hot", centres[0]), (101, "hot", centres[0]), (102, "s9", centres[1]), (103, "hot", None), (104, "hot", [2.0, 4.0]), (105, "hot", [0.0] * width)]
    return requests, entries


def frames(spark, requests, entries):
    return (
        spark.createDataFrame(requests, "query_id bigint, scope string, vector array<double>").repartition(5),
        spark.createDataFrame(entries, "id bigint, scope string, vector array<double>").repartition(3),
    )


@pytest.mark.parametrize("settings", [{}, {"direct": 20}, {"direct": 20, "most_bands": 0}, {"direct": 1, "bits": 4}])
def test_similar_entries_are_those_of_brute_force(spark, settings):
    requests, entries = vectors()
    got = {tuple(r) for r in caches.similar(*frames(spark, requests, entries), 0.95, **settings).select("query_id", "id", "similarity", "position").collect()}
    want = plain_similar(requests, entries, 0.95, 3)
    close = lambda rows: sorted((q, i, n) for q, i, _, n in rows)
    assert close(got) == close(want) and len(want) > 150
    assert all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(sorted(got), sorted(want)))


def test_chance_of_a_miss():
    n = caches.bands_needed(0.97, 12, 1e-6)
    hit = (1 - math.acos(0.97) / math.pi) ** 12
    assert (1 - hit) ** n <= 1e-6 < (1 - hit) ** (n - 1)
    assert caches.bands_needed(1.0, 12, 1e-6) == 1 and caches.bands_needed(0.4, 12, 1e-6) > 64


def test_bands_propose_few_pairs(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(800)]
    d = spark.createDataFrame(rows, "id bigint, v array<double>")
    n = caches.bands_needed(0.97, 12, 1e-6)
    k = d.select("id", F.explode(caches.band_keys(F.col("v"), 12, n)).alias("band"))
    pairs = k.join(k.select(F.col("id").alias("other"), "band"), "band").where("id < other").select("id", "other").distinct().count()
    assert pairs < 0.03 * 800 * 799 / 2


def test_lookup_checks_hits_afterwards(spark):
    q = spark.createDataFrame([(1, "a", "h1", True, [1.0, 0.0]), (2, "a", "h2", True, [1.0, 0.0]), (3, "a", "h3", False, [1.0, 0.0]), (4, "a", "h4", True, [0.0, 1.0]), (5, "b", "h1", True, [1.0, 0.0]), (6, None, "h1", True, None)], "query_id bigint, scope string, query_hash string, eligible boolean, vector array<double>")
    e = spark.createDataFrame([(10, "a", "h1", [0.0, 1.0], False), (11, "a", "h2", [1.0, 0.0], True), (12, "a", "x", [1.0, 0.0], False), (13, "a", "y", [1.0, 0.01], True), (14, "a", "z", [0.02, 1.0], None), (15, "a", "z", [0.03, 1.0], False), (16, "a", "z", [0.04, 1.0], True)], "id bigint, scope string, query_hash string, vector array<double>, fine boolean")
    rows = {r.query_id: (r.status, r.id) for r in caches.lookup(q, e, 0.97, valid="fine").collect()}
    assert rows == {1: ("semantic_hit", 11), 2: ("exact_hit", 11), 3: ("miss", None), 4: ("miss", None), 5: ("miss", None), 6: ("miss", None)}
    rows = {r.query_id: (r.status, r.id) for r in caches.lookup(q, e.where("id < 0"), 0.97).collect()}
    assert set(rows.values()) == {("miss", None)} and len(rows) == 6


TEXTS = [None, "", "   \n ", "one", "a line\nand another, with 12 numbers: 3.14\n" * 40, "été à Zürich 東京 🙂 " * 60, "x" * 3000, "<|endoftext|> is text " * 30, LONG]


def test_windows_cover_every_token_and_fit(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "i bigint, t string")
    found = {r.i: r.w for r in d.select("i", tokens.token_passages(F.col("t"), VOCABULARY, F.lit("prefix: "), 64, 24).alias("w")).collect()}
    for i, t in enumerate(TEXTS):
        t = t or ""
        at = tokens.spans(VOCABULARY, t)
        assert [len(t[a:b]) for a, b in at] == [b - a for a, b in at]
        if not at:
            assert found[i] == []
            continue
        w = [(x.start, x.end) for x in found[i]]
        assert w[0][0] == at[0][0] and w[-1][1] == at[-1][1]
        assert all(a[0] < b[0] <= a[1] and a[1] < b[1] for a, b in zip(w, w[1:]))  # no character is left out
        assert all(tokens.size(VOCABULARY, "prefix: " + t[a:b]) <= 64 for a, b in w[:200])
    ends = {b: n for n, (a, b) in enumerate(tokens.spans(VOCABULARY, TEXTS[4]))}
    starts = {a: n for n, (a, b) in enumerate(tokens.spans(VOCABULARY, TEXTS[4]))}
    w = found[4]
    room = 64 - tokens.size(VOCABULARY, "prefix: ") - 4
    assert all(ends[a.end] + 1 - starts[b.start] == room // 4 for a, b in zip(w, w[1:]))


def test_a_prefix_without_room_is_an_error():
    with pytest.raises(ValueError):
        tokens.cuts(VOCABULARY, "text", "a long prefix " * 20, 32, 24, 0)


def test_budgets(spark):
    d = spark.createDataFrame([(1, "E-7", "disk is full " * 50, None, "why " * 90, "🙂 " * 40), (2, None, None, None, None, None), (3, "", "short", "step", "reason", "summary"), (4, "E" * 200, LONG, "", "", "")], "i bigint, c string, a string, b string, r string, s string")
    out = {r.i: (r.t, r.n) for r in d.select("i", tokens.token_failure_text(F.col("c"), F.col("a"), F.col("b"), F.col("r"), F.col("s"), VOCABULARY, 48).alias("t")).withColumn("n", tokens.token_count(F.col("t"), VOCABULARY)).collect()}
    assert all(n <= 48 for _, n in out.values())
    assert out[1][0].startswith("Error code: E-7\nError: disk is full") and "Order Reason: why" in out[1][0]
    assert out[2][0] == "Error: \nFailed Step: \nOrder Reason: \nSummary: "
    assert out[3][0] == "Error: short\nFailed Step: step\nOrder Reason: reason\nSummary: summary"
    assert out[4][0].startswith("Error code: EEE")
    cut = d.select(tokens.token_trimmed(F.col("a"), VOCABULARY, 5).alias("t"), tokens.token_trimmed(F.col("a"), VOCABULARY, 0).alias("z")).collect()
    assert cut[0].t == "disk is full disk is" and all(r.z == "" for r in cut) and cut[1].t == ""


def test_query_windows_are_those_of_whole_texts(spark):
    import hashlib

    from sievemark.plans.measured import token_windows

    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.number): (r.start, r.end, r.piece) for r in token_windows(spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect():
        for n, (a, b) in enumerate(tokens.cuts(VOCABULARY, r.text or "", f"{r.lang or ''}\nReference: ", 128, 24, 0)):
            want[r.doc_id, n] = (a, b, hashlib.sha256((r.text or "")[a:b].encode()).hexdigest())
    assert got == want and len(want) > 300


def clustered(n=900, width=16, seed=9):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(25)]
    rows = [(i, blurred(rng, centres[i % 25 if i % 3 else 0], 0.02)) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(40)]  # a third near one centre, and copies


def plain_nearest(asked, rows, k):
    out = set()
    for q, v in asked:
        best = sorted((-round(math.fsum(a * b for a, b in zip(v, w)), 9), i) for i, w in rows)[:k]
        out |= {(q, i, n) for n, (_, i) in enumerate(best, 1)}
    return out


def test_vector_index_is_exact_and_reads_few_lists(spark, tmp_path):
    from sievemark.operators import vectors as V

    rows, path = clustered(), f"file://{tmp_path}/v"
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [math.nan] * 16), (5004, [1.0]), (None, [1.0] * 16)]
    d = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    V.build(d, path, rows=100)
    asked = rows[::30] + odd[:5]
    q = spark.createDataFrame(asked, "query_id bigint, q array<double>")
    got = V.ask(spark, path, q, 7).collect()
    assert {(r.query_id, r.key, r["rank"]) for r in got} == plain_nearest(rows[::30], rows, 7)
    centres = spark.read.parquet(f"{path}/centres").collect()
    c, radius, n = ([r[x] for r in centres] for x in ("centre", "radius", "n"))
    assert sum(n) == len(rows) and len(n) == math.isqrt(len(rows))
    few = 0
    for _, v in rows[::30]:
        floor = sorted((sum(a * b for a, b in zip(v, w)) for _, w in rows), reverse=True)[6]
        few += sum(m for x, r, m in zip(c, radius, n) if sum(a * b for a, b in zip(v, x)) + math.dist(v, [0] * 16) * r >= floor)
    assert few < 0.6 * len(rows) * len(rows[::30])  # vectors in lists that reach the floor


@pytest.mark.parametrize("block", [40, 150])
def test_vector_index_in_small_blocks_with_copies(spark, tmp_path, block):
    """Lists and questions of several blocks, copies beyond a block, ties at the last place; no table of questions by lists is made."""
    from sievemark.operators import vectors as V

    rows, path = clustered(), f"file://{tmp_path}/v"
    rows = rows + [(10_000 + i, rows[0][1]) for i in range(300)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    V.build(d, path, rows=100)
    asked = rows[::20]
    got = V.ask(spark, path, d.where(F.col("vec_id").isin([i for i, _ in asked])), 7, "vec_id", "embedding", block=block)
    assert {(r.query_id, r.key, r["rank"]) for r in got.collect()} == plain_nearest(asked, rows, 7)
    first, pieces, bins = V._dealt(V.np.zeros((3, 2)), V.np.array([10, 95, 20]), 40)
    assert list(pieces) == [1, 3, 1] and bins == max(first + pieces)


def test_vector_index_of_few_and_no_vectors(spark, tmp_path):
    from sievemark.operators import vectors as V

    path = f"file://{tmp_path}/v"
    with pytest.raises(ValueError):
        V.ask(spark, path, spark.createDataFrame([(1, [1.0])], "query_id bigint, q array<double>"), 3)
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    V.build(empty, path)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id bigint, q array<double>")
    assert V.ask(spark, path, q, 3).collect() == []
    V.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id bigint, embedding array<double>"), path)  # the next version
    assert [(r.query_id, r.key, r.score, r["rank"]) for r in V.ask(spark, path, q, 3).orderBy("query_id", "rank").collect()] == [(1, 1, 1.0, 1), (1, 2, 1.0, 2), (2, 1, 0.0, 1), (2, 2, 0.0, 2)]


def test_sketches_rule_out_only_far_vectors(spark):
    """Most far pairs don't get as far as their vectors; every near one does, whatever its length and scale."""
    import numpy as np
    from pyspark.sql import functions as F

    from sievemark.operators import caches

    r = np.random.default_rng(5)
    rows = []
    for i in range(300):
        w = int(r.choice([1, 3, 64]))
        v = r.standard_normal(w) * 10.0 ** int(r.integers(-200, 200))
        near = v + r.standard_normal(w) * np.abs(v).max() * r.choice([0.0, 0.02, 0.1, 0.4])
        rows.append((i, v.tolist(), near.tolist(), float(v / np.abs(v).max() @ (near / np.abs(near).max()) / np.linalg.norm(v / np.abs(v).max()) / np.linalg.norm(near / np.abs(near).max()))))
    far = [(1000 + i, a.tolist(), b.tolist(), 0.0) for i, (a, b) in enumerate(r.standard_normal((200, 2, 64)))]
    df = spark.createDataFrame(rows + far, "i long, a array<double>, b array<double>, cosine double")
    got = {x.i: (x.ok, x.cosine) for x in df.select("i", "cosine", caches.may_reach(caches.sketch(F.col("a")), caches.sketch(F.col("b")), 0.97).alias("ok")).collect()}
    assert all(ok for ok, c in got.values() if c >= 0.97) and sum(c >= 0.97 for _, c in got.values()) > 50
    assert sum(got[1000 + i][0] for i in range(200)) < 40


def test_words_of_texts_are_encoded_once(monkeypatch):
    """Places and counts are those of whole texts, white space of all kinds included, and a word that was seen isn't encoded again."""
    import random

    from sievemark.functions import tokens
    from sievemark.plans.measured import VOCABULARIES

    r = random.Random(3)
    bits = ["the", "Straße", "it's", "we'll", "1234", "...", "日本語", "é", "😀", "<|endoftext|>", "x_y", "don't", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", " \t ", "'s", "\x0b", "q\x1cq", "a\xa0b", "\u2003", "\u3000", "\x85", "\x00"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(3_000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = f"{VOCABULARIES}/{name}"
        for t in texts if name.startswith("byte") else texts[:200]:
            e = tokens.vocabulary(path).encode(t.replace("\n", " "), add_special_tokens=False)
            assert tokens.spans(path, t) == [o for o in e.offsets if o[1] > o[0]] and tokens.size(path, t) == len(e.ids), repr(t)
    path, seen = f"{VOCABULARIES}/byte_bpe_50k.json", []
    once = tokens.whole
    monkeypatch.setattr(tokens, "whole", lambda p, t: seen.append(t) or once(p, t))
    tokens.remembered(path).clear()
    assert tokens.size(path, "again and again " * 500) > 1_000 and len(seen) <= 4
