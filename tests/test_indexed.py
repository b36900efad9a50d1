"""The persisted index, rules as a table, the ledger and retention."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sievemark.operators import postings, retrieve, rulebook
from sievemark.sources import commits
from sievemark.streaming import ledger, retention

SF = "/root/testdata/sf0.001"


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id bigint, text string" + extra)


def asked(spark, path, texts, k=5, **settings):
    q = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    return sorted(map(tuple, postings.ask(spark, path, q, k, **settings).collect()))


def plain(spark, rows, texts, k=5):
    q = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    hits = retrieve.bm25(frame(spark, rows), q).withColumn("score", F.round("score", 6))
    return sorted(map(tuple, retrieve.top(hits, k, "score", "key").select("query_id", "key", "score", "rank").collect()))


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(words, [1 / (1 + j) for j in range(60)], k=rng.randint(1, 40)))) for i in range(n)]


ASKED = ["w3 w50 w0", "w41 w41 w12", "nothing here", "", "w0", "w55 w56 w57 w58 w59 w0 w1 w2"]


def test_index_gives_the_same_as_the_scan(spark, tmp_path):
    rows, path = corpus(), f"file://{tmp_path}/ix"
    postings.rebuild(frame(spark, rows), path, slice_docs=16)
    want = plain(spark, rows, ASKED)
    assert asked(spark, path, ASKED) == want and len(want) >= 20
    assert asked(spark, path, ASKED, direct_rows=0) == want  # by bounds
    assert asked(spark, path, ASKED, direct_rows=0, seeds=1) == want
    q = spark.createDataFrame([(1, "w59 w58 w0 w1 w2 w3")], "item_id bigint, text string")
    every, pruned = (postings.scores(spark, path, q, 3, direct_rows=n).count() for n in (10**9, 0))
    assert pruned < every / 2  # few documents get whole scores


def test_a_question_reads_postings_only(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    postings.rebuild(spark.read.parquet(f"{SF}/documents.parquet"), path)
    found = postings.ask(spark, path, spark.createDataFrame([(1, "the of")], "item_id bigint, text string"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet[^\n]*Location: [^\n]*?paths?\)?\[([^\]]*)", plan)
    assert scans and all("documents.parquet" not in s and "/docs" not in s for s in scans)
    buckets = set(re.findall(r"postings/version=\d+/bucket=\d+", plan))
    assert len(buckets) <= 2


def test_texts_and_postings_are_moved_once(spark, tmp_path, monkeypatch):
    moved, write = {}, postings._write

    def watched(df, path, table, version):
        moved[table] = len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))
        write(df, path, table, version)

    monkeypatch.setattr(postings, "_write", watched)
    postings.rebuild(frame(spark, corpus()), f"file://{tmp_path}/ix", slice_docs=16)
    assert moved["docs"] == moved["postings"] == 1


def test_upserts_rewrite_what_they_touch(spark, tmp_path):
    path, rows = f"file://{tmp_path}/ix", dict(corpus(120))
    postings.rebuild(frame(spark, list(rows.items())), path, buckets=64)
    before = commits.committed(spark, path)
    changes = [(3, "w7 fresh", False), (500, "fresh fruit", False), (9, None, True), (10, "gone", True), (10, "gone as well", False), (None, "no key", False), (11, None, False)]
    postings.upsert(frame(spark, changes, ", deleted boolean"), path, deleted="deleted")
    after = commits.committed(spark, path)
    now = rows | {3: "w7 fresh", 500: "fresh fruit", 11: None}
    del now[9], now[10]
    assert after["n"] == len(now) == before["n"] - 1
    assert asked(spark, path, [*ASKED, "fresh fruit"]) == plain(spark, list(now.items()), [*ASKED, "fresh fruit"])
    hit = {t for i in (3, 9, 10, 11) for t in (rows[i] or "").split()} | {"w7", "fresh", "fruit"}
    wanted = {str(r.b) for r in spark.createDataFrame([(t,) for t in hit], "t string").select(postings.bucket("t", 64).alias("b")).collect()}
    assert {b for b, v in after["postings"].items() if v == after["version"]} <= wanted < set(after["postings"]) | wanted
    assert all(after["postings"][b] == v for b, v in before["postings"].items() if b not in wanted)


def test_upserts_and_sums_move_little(spark, tmp_path, monkeypatch):
    """Postings that stay are written where they are read, documents keep no terms, and sums of a document are made where its postings are."""
    path, plans, write = f"file://{tmp_path}/ix", {}, postings._write
    postings.rebuild(frame(spark, corpus(60)), path)
    monkeypatch.setattr(postings, "_write", lambda df, at, table, version: (plans.setdefault(table, df._jdf.queryExecution().executedPlan().toString()), write(df, at, table, version)))
    postings.upsert(frame(spark, [(3, "w1 w1"), (4, None), (90, "w2 new")]), path)
    assert not re.search(r"\bExchange ", plans["postings"]) and "LeftAnti" in plans["postings"]
    assert "terms" not in spark.read.parquet(f"{path}/docs").columns
    q = spark.createDataFrame(list(enumerate(ASKED)), "item_id bigint, text string")
    for rows in (10**9, 0):
        found = postings.scores(spark, path, q, 3, direct_rows=rows)
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, key#", found._jdf.queryExecution().executedPlan().toString())


def test_a_run_that_dies_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path, rows = f"file://{tmp_path}/ix", corpus(60)
    postings.rebuild(frame(spark, rows), path)
    want = asked(spark, path, ASKED)

    def dies(*_):
        raise OSError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(commits, "commit", dies)
        for run in (lambda: postings.upsert(frame(spark, [(1, "w1 w1 w1")]), path), lambda: postings.rebuild(frame(spark, rows[:5]), path)):
            with pytest.raises(OSError):
                run()
    assert asked(spark, path, ASKED) == want
    postings.upsert(frame(spark, [(1, "w1 w1 w1")]), path)
    assert asked(spark, path, ASKED) == plain(spark, [(1, "w1 w1 w1") if i == 1 else (i, t) for i, t in rows], ASKED)
    with pytest.raises(RuntimeError):
        commits.commit(spark, path, commits.committed(spark, path)["version"], {})
    assert len(commits.names(spark, f"{path}/commits")) <= 4


def test_refresh_takes_a_window_with_overlap(spark, tmp_path):
    path, rows = f"file://{tmp_path}/ix", corpus(40)
    postings.rebuild(frame(spark, rows[:30]), path)
    timed = frame(spark, [(i, t, f"2026-01-01 0{i // 10}:{i % 10}0:00"[:19] if i % 10 < 6 else f"2026-01-01 0{i // 10}:59:00") for i, t in rows], ", at string").withColumn("at", F.col("at").cast("timestamp"))
    postings.refresh(timed, path, "at", "2026-01-01 03:30:00")
    assert commits.committed(spark, path)["n"] == 40
    assert asked(spark, path, ASKED) == plain(spark, rows, ASKED)


def test_index_of_odd_tables(spark, tmp_path):
    q = ["w1"]
    assert asked(spark, f"file://{tmp_path}/none", q) == []
    for n, rows in enumerate(([], [(1, None), (2, ""), (None, "w1")])):
        path = f"file://{tmp_path}/odd{n}"
        postings.rebuild(frame(spark, rows), path)
        assert asked(spark, path, q) == []
        postings.upsert(frame(spark, [(5, "w1 w2"), (5, "w1"), (6, "w3"), (7, "w4")]), path)
        assert [r[1] for r in asked(spark, path, ["w2"])] == [5]


# Rules


def test_factors_stand_in_every_match():
    of = lambda p: rulebook.compiled(p)[1]
    assert of("abc") == "abc" and of("a|bc") == "" and of("(?:ab)+cxde?") == "cxd" and of(r"x\d+yzw*") == "yz"
    assert of("(?P<n>Hello) W.") == "hello" and of("(foo)?bar") == "bar" and of("é+abc") == "abc" and of("[ab]c") == "c" and of("") == ""
    assert rulebook.compiled("(") is None and rulebook.compiled(None) is None and rulebook.compiled("a**b") is None


def test_ten_thousand_rules_against_trying_each(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    shapes = [lambda: word(), lambda: f"{word()}|{word()}", lambda: f"{word()}.*{word()}", lambda: rf"\b{word()}\s+{word()}\b", lambda: f"({word()}", lambda: f"[ab]{word()}$", lambda: f"(?:{word()}){{2,}}", lambda: f"{word().upper()}\\d"]
    rules = [(i, rng.choice(shapes)()) for i in range(10_000)] + [(10_000, None), (10_001, "İstanbul|ſ"), (10_002, "kiss")]
    texts = [(i, " ".join(word() + rng.choice(("", "", "1", "\n")) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(60, None), (61, ""), (62, "KIſS me in İstanbul"), (62, "abcd")]
    r = spark.createDataFrame(rules, "id bigint, pattern string")
    t = spark.createDataFrame(texts, "q bigint, body string")
    want = set()
    for rule, pattern in rules:
        try:
            tried = re.compile(pattern, re.I | re.S) if pattern is not None else None
        except re.error:
            tried = None
        want |= {(q, rule) for q, body in texts if tried and tried.search(body or "")}
    for size in (8 << 20, 100_000):
        assert {tuple(x) for x in rulebook.pattern_hits(t, r, "q", "body", block_bytes=size).collect()} == want
    assert len(want) > 1000


def test_conditions_and_precedence(spark):
    rules = [(1, "fail", 5, None, None), (2, "fail", 1, ["A ", "b"], None), (3, "fail", 9, None, ["x"]), (4, "fail", 1, ["a"], None), (5, "fail(", 9, ["a"], ["x"]), (6, "other", 9, ["a"], ["x"]), (7, "fail", 5, None, [])]
    r = spark.createDataFrame(rules, "id bigint, pattern string, created_at bigint, step array<string>, reason array<string>")
    texts = [(1, "it FAILED", " a", "y"), (2, "it failed", "c", "x"), (3, "it failed", None, None), (4, "fine", "a", "x"), (5, "it failed", "B", "x")]
    t = spark.createDataFrame(texts, "q bigint, body string, step string, reason string")
    got = dict(map(tuple, rulebook.match_table(t, r, "q", "body", {"step": "step", "reason": "reason"}).collect()))
    assert got == {1: 4, 2: 3, 3: 1, 5: 3}
    assert rulebook.match_table(t, r.where("false"), "q", "body", {"step": "step"}).count() == 0


# Ledger


def decisions(spark, rows):
    return spark.createDataFrame(rows, "key bigint, body string, at bigint, tier string")


def sent(spark, path):
    out = ledger.outbox(spark, path)
    return [] if out is None else sorted((r.batch, r.key, r.body, r.action) for r in out.collect())


def test_repeated_and_interrupted_batches_publish_once(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ledger"
    batches = [[(1, "a", 1, "high"), (1, "b", 2, "high"), (2, "x", 1, "low"), (None, "n", 1, "high"), (3, None, 1, "high")], [(1, "b", 3, "high"), (2, "x", 2, "medium"), (4, "d", 1, None)], [], [(1, "a", 9, "high"), (2, "x", 9, "high")]]
    put = lambda n: ledger.publish_batch(decisions(spark, batches[n]), n, path, "key", "body", "at", "tier")
    for n in range(4):
        with monkeypatch.context() as m:
            m.setattr(commits, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                put(n)
        before = sent(spark, path)
        assert all(b < n for b, *_ in before)
        put(n)
        put(n)
        put(0)
    assert sent(spark, path) == [(0, 1, "b", "create"), (1, 2, "x", "create"), (3, 1, "a", "update")]
    assert commits.committed(spark, path)["batch"] == 3


def test_published_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    rows = [(i % 7, f"body {i % 3}", i, "high") for i in range(40)]
    path = f"file://{tmp_path}/ledger"
    for n, part in enumerate((rows[:25], rows[25:])):
        decisions(spark, part).coalesce(1).write.parquet(f"{source}/{n}")
        stream = spark.readStream.schema(decisions(spark, []).schema).option("recursiveFileLookup", "true").parquet(source)
        ledger.publish(stream, path, f"{tmp_path}/checkpoint", "key", "body", "at").awaitTermination()
    got = sent(spark, path)
    last = {}
    for i, (key, body, _, _) in enumerate(rows):
        last[key, i >= 25] = body
    want = [(int(late), key, body, "update" if late else "create") for (key, late), body in last.items() if not late or last.get((key, False)) != body]
    assert got == sorted(want)


# Retention


def test_evictions_don_t_depend_on_batches(spark, tmp_path):
    rng = random.Random(3)
    rows, t = [], 1_700_000_000
    for _ in range(400):
        t += rng.randint(0, 900)
        rows.append((rng.choice("abcdef"), rng.choice(("short", "long", "kept")), t))
    rows += [(None, "short", t), ("a", "short", None)]
    log = spark.createDataFrame(rows, "key string, class string, s bigint").withColumn("at", F.timestamp_seconds("s"))
    ttl = {"short": 1800, "long": 7200}
    want = sorted(map(tuple, retention.evictions_of_log(log, "key", "class", "at", ttl, F.timestamp_seconds(F.lit(t - 3600))).collect()))
    assert len(want) > 30
    for n, cuts in enumerate(([0, 402], [0, 10, 60, 61, 200, 390, 402])):
        source, out, checkpoint = (f"{tmp_path}/{x}{n}" for x in ("in", "out", "checkpoint"))
        for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = spark.createDataFrame(rows[a:z], "key string, class string, s bigint").withColumn("at", F.timestamp_seconds("s"))
            part.coalesce(1).write.parquet(f"{source}/{k}")
            stream = spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(source)
            retention.evictions(stream, "key", "class", "at", ttl).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(tuple, spark.read.schema(retention.RESULT).parquet(out).collect())) == want


def test_many_rules_are_read_by_all_tasks(spark):
    """Few texts go to the rules: one pass, however many blocks the rules would make."""
    t = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None), (3, "alpha 7")], "q bigint, body string")
    r = spark.createDataFrame([(i, ["alpha", "^beta", "(", "a.*7", "", None][i % 6]) for i in range(600)], "id bigint, pattern string")
    got = rulebook.pattern_hits(t, r, "q", "body", block_bytes=400)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = {0: {1, 3}, 1: {2}, 3: {3}, 4: {1, 2, 3}}
    assert {tuple(x) for x in got.collect()} == {(q, i) for i in range(600) for q in want.get(i % 6, ())}
