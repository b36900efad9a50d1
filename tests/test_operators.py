import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sievemark.functions import procedures as P
from sievemark.functions import scores as S
from sievemark.functions import text as T
from sievemark.operators import comments, corpus, decisions, graph, history, quality, rank, retrieve, rules, windows
from sievemark.sources import files, issues, seams
from sievemark.streaming import scan


def one(spark, c, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(c(F.col("v"))).collect()]


def test_clean_text(spark):
    got = one(spark, T.clean_text, "❌ Plan * 19392021851 failed 6/3/2026 8:59 AM", "MobileVoice19392021851 [ ] ()", "a - b", "123*456", "14081 kept", None, "- x |")
    assert got == ["Plan failed", "MobileVoice", "a b", "123456", "14081 kept", "", "x"]


def test_clean_error_keeps_codes(spark):
    assert one(spark, T.clean_error, "* 140811 | Order: 1234567 failed", "140811 |", "no code 12345678", None) == ["140811 | failed", "140811", "no code", ""]


def test_pointers(spark):
    bodies = ("duplicate, refer to ABC-231619", "reset it, see ABC-231619", "merged with browse/ab-12", "duplicate of nothing", None)
    assert one(spark, T.is_pointer, *bodies) == [True, False, True, False, False]
    assert one(spark, T.referenced_ticket, *bodies) == ["ABC-231619", "ABC-231619", "AB-12", "", ""]


def test_fix_block(spark):
    assert one(spark, T.fix_block, "hi === fix === do it === end === bye", "=== FIX === open", "plain") == ["=== FIX ===\ndo it\n=== END ===", "=== FIX ===\nopen\n=== END ===", "plain"]


def test_redaction_order(spark):
    got = one(spark, T.redact, "id 123e4567-e89b-12d3-a456-426614174000 a.b@c.org +1 (939) 202-1851, 1234567; 123456")
    assert got == ["id [ID] [EMAIL] [NUMBER], [NUMBER]; 123456"]


def test_numbers_that_share_a_neighbour(spark):
    body = "a 4387393285946913 +1 (438) 555-5817 b 4387393285946913 1385550123456 é1234567é"
    assert one(spark, T.redact, body) == ["a [NUMBER] [NUMBER] b [NUMBER] é[NUMBER]é"]
    assert one(spark, lambda c: T.redact(c, taken=True), body) == ["a [NUMBER] +[NUMBER] b [NUMBER] é[NUMBER]é"]  # as the query's SQL


def test_guards_end_at_other_letters(spark):
    """Words are made of ASCII letters, whatever stands beside them."""
    d = spark.createDataFrame([("noé x é12é isn't ñno",)], "v string").select(P.guards(F.col("v"), F.lit("s"), F.lit("e")).alias("g")).first().g
    assert (d.words, d.numbers) == (["isn't", "no"], ["12"])


def test_signatures_and_similarity(spark):
    df = spark.createDataFrame([("14047 | a b", "14048 | a b"), ("14047 | a b", "14047 | c"), ("a b c d", "a b"), ("", "x")], "q string, c string")
    got = [(r.s.score, r.s.gated) for r in df.select(S.error_similarity(F.col("q"), F.col("c")).alias("s")).collect()]
    assert got == [(0.0, True), (0.6, False), (0.5, False), (1.0, False)]
    assert [r[0] for r in df.select(S.text_similarity(F.col("q"), F.col("c"))).collect()][2:] == [1.0, 0.0]


def test_scores(spark):
    row = spark.range(1).select(S.evidence(F.lit(3), F.lit(3), F.lit(0), F.lit(0)).alias("e"), S.evidence(*[F.lit(0)] * 4).alias("n"), S.composite(F.lit(1.0), F.lit(0.5), F.lit(0.5)).alias("c")).first()
    assert row.e == pytest.approx(5 / 7) and row.n == 0.5 and row.c == 0.625
    with pytest.raises(ValueError):
        S.composite(F.lit(1.0), F.lit(1.0), F.lit(1.0), (0.5, 0.5, 0.5))
    v = spark.createDataFrame([([1.0, 0.0], [1.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [-1.0, -1.0, 1.0]


def test_fusion_counts_a_document_once_a_list(spark):
    a = retrieve.best_passage(spark.createDataFrame([(1, "A", 1, 0.9), (1, "A", 2, 0.8), (1, "B", 3, 0.85)], "query_id int, key string, pos int, score double"))
    b = spark.createDataFrame([(1, "B", 1), (1, "A", 2)], "query_id int, key string, rank int")
    got = {r.key: r.retrieval_score for r in retrieve.fuse([a, b]).collect()}
    assert got == {"A": 1.0, "B": 1.0}


def test_bm25_ranks_rare_terms_first(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["reset port now", "port port port", "other words here", "more other text", "", None])], "doc_id long, text string")
    q = spark.createDataFrame([(7, "reset port")], "item_id long, text string")
    assert [r.key for r in retrieve.bm25(d, q).orderBy(F.desc("score")).collect()][0] == 0


def test_dense_top_blocks(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [0.1, 0.0]), (2, [0.0, 0.1])], "query_id long, q array<double>")
    want = sorted(tuple(r) for r in retrieve.dense_top(v, q, 2).collect())
    assert want == sorted(tuple(r) for r in retrieve.dense_top(v, q, 2, block=1).collect())
    assert [r[1] for r in want if r[0] == 1] == [4, 5] or [r[1] for r in want if r[0] == 1] == [5, 4]


def test_prune_guard(spark):
    old = spark.range(100).withColumnRenamed("id", "k")
    assert corpus.prune(old, old.where("k >= 5"), "k").count() == 95
    for seen in (old.where("k >= 50"), old.where("false")):
        with pytest.raises(ValueError):
            corpus.prune(old, seen, "k")
    assert corpus.prune(old, old.where("k >= 50"), "k", allow_mass=True).count() == 50


def test_change_set_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, content_hash string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "k int, content_hash string")
    assert {r.k: r.change for r in corpus.change_set(new, old, "k").collect()} == {1: "same", 2: "update", 3: "same", 4: "insert"}
    assert corpus.upsert(old, new.where("k = 2"), "k").where("k = 2").first().content_hash == "c"


def test_graph_bucket_bound_and_precedence(spark):
    members = spark.createDataFrame([(k, "x") for k in "abcd"] + [(f"z{i}", "big") for i in range(300)] + [("s", "x"), ("s", "big")], "key string, bucket string")
    got = {r.key: r.relation for r in graph.expand(spark.createDataFrame([(1, "s")], "query_id int, key string"), members, spark.createDataFrame([("a", "s")], "src string, dst string")).collect()}
    assert got == {"a": "pointer", "b": "signature", "c": "signature", "d": "signature"}


def test_pointers_are_followed_once(spark):
    c = spark.createDataFrame([(1, "A", "see B", "B"), (1, "C", "fix", ""), (1, "D", "see C", "C"), (1, "E", "see X", "X")], "query_id int, key string, body string, refers_to string")
    k = spark.createDataFrame([("B", "do this", ""), ("C", "fix", ""), ("X", "see Y", "Y")], "key string, body string, refers_to string")
    assert sorted((r.key, r.via) for r in graph.follow_pointers(c, k).collect()) == [("B", "A"), ("C", "")]


def test_quality_tiers(spark):
    """A high tier needs a corrective clause of four lexemes, and that every clause acts."""
    good = "Resolution: Reset the port in the access portal and retry the order line"
    rows = [
        (good, "s", "e", "high"), ("Resolution: Reset the port and retry the order line", "s", "e", "medium"), ("done", "s", "e", "low"), ("will now be automatically closed", "s", "e", "low"),
        (good, "", "e", "medium"), ("nothing to see in this long text", "s", "e", "low"), ("Verify that the port is in the right state", "s", "e", "medium"), (good + "?", "s", "e", "medium"),
        ("Reset the port in the access portal; nothing else", "s", "e", "medium"), ("Resetting the broken port in the portal", "s", "e", "high"), ("Open a new ticket and reset the port in the portal", "s", "e", "low"),
        ("Update from Salesforce: reset the port in the portal, OrderStepId 4", "s", "e", "low"), ("OWN-MARK reset the port in the access portal", "s", "e", "low"),
        ("Resolution: reset the port in the portal\nand mark the order as done\nRelease: 7 nothing", "s", "e", "high"),
    ]
    df = spark.createDataFrame(rows, "body string, step string, error string, want string")
    found = quality.source_quality(F.col("body"), F.col("step"), F.col("error"), markers=("OWN-MARK",))
    assert [(r[0].tier, r.body) for r in df.select(found, "body").collect()] == [(w, b) for b, *_, w in rows]
    part = quality.source_quality(F.col("body"), F.col("step"), F.col("error"), F.lit(3))
    assert df.limit(1).select(part).first()[0].tier == "medium"


def test_pick_sources(spark):
    """Restatements are capped, not banned; unusable bodies are passed over; one stays where all are."""
    fix = "reset the port, cleared cache seven, restarted line four and retried order"
    bodies = ["done", fix, fix.upper(), fix + " quickly", fix + " carefully", fix + " slowly", "SLA breached by L3", "changed the plan code to gold and resubmitted it"]
    df = spark.createDataFrame([([(i, b) for i, b in enumerate(bodies)],), ([(0, "done"), (1, "fixed")],), ([],)], "x array<struct<key:int,body:string>>")
    got = [[x["key"] for x in r[0]] for r in df.select(quality.pick_sources(F.col("x"))).collect()]
    assert got == [[1, 3, 4, 7], [0], []]
    assert [x["key"] for x in df.select(quality.pick_sources(F.col("x"), most=2)).first()[0]] == [1, 3]


def test_rules_malformed_and_unknown(spark):
    q = spark.createDataFrame([(1, "x FAILED y", "Add")], "id int, error string, order_type string")
    rs = [{"id": "a", "pattern": "failed", "order_type_op": "like", "order_type": "add"}, {"id": "b", "pattern": "("}]
    assert rules.match_rules(q, rs, "id", "error").count() == 0
    assert rules.match_rules(q, rs, "id", "error", unknown_matches=True).first().rule_id == "a"
    assert rules.match_rules(q, [], "id", "error").count() == 0


def test_versions_and_audit(spark):
    s = spark.createDataFrame([(1, "x", 1, "a"), (1, "y", 2, "b"), (1, "x", 3, "c")], "p int, body string, at int, key string")
    got = {r.body: (r.version_number, r.status, r.source_keys) for r in history.versions(s, "p", "body", "at", "key").collect()}
    assert got == {"x": (1, "current", ["a", "c"]), "y": (2, "superseded", ["b"])}
    log = history.chained(s, "p", "at", F.col("body")).cache()
    assert history.broken_links(log, "p", "at", F.col("body")).count() == 0
    at = lambda df: [r["at"] for r in history.broken_links(df, "p", "at", F.col("body")).orderBy("at").collect()]
    assert at(log.withColumn("body", F.when(F.col("at") == 2, "tampered").otherwise(F.col("body")))) == [2]
    assert at(log.withColumn("event_hash", F.when(F.col("at") == 2, "0").otherwise(F.col("event_hash")))) == [2, 3]
    assert at(log.where("at <> 2")) == [3]
    mended = log.withColumn("body", F.when(F.col("at") == 2, "tampered").otherwise(F.col("body"))).withColumn("event_hash", F.when(F.col("at") == 2, history.link_hash(F.col("body"), F.col("previous_hash"))).otherwise(F.col("event_hash")))
    assert at(mended) == [3]  # the change reaches the next link even if the event's own hash was made anew
    report = history.audit_report(mended, "p", "at", F.col("body")).first()
    assert (report.ok, report.first_bad, report.events) == (False, 3, 3)


def test_soft_pieces():
    from sievemark.operators.windows import soft_pieces

    r = random.Random(0)
    for _ in range(200):
        t = "".join(r.choice("abc  \n") for _ in range(r.randint(0, 300)))
        got = soft_pieces(t, 40)
        assert "".join(got).replace(" ", "").replace("\n", "") == t.replace(" ", "").replace("\n", "") and all(len(p) <= 40 for p in got)
    assert soft_pieces("aaaa bbbb cccc", 10) == ["aaaa bbbb", "cccc"] and soft_pieces("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5] and soft_pieces(None) == []


def test_metrics(spark):
    got = history.metrics(
        spark.createDataFrame([(1, "x", 1), (1, "a", 2), (2, "q", 1)], "query_id int, key string, rank int"),
        spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id int, key string"), spark.createDataFrame([(1,), (2,)], "query_id int"), 10).first()
    assert tuple(got) == (2, 0.5, 0.25, 0.25)


def test_passages_cover_the_last_word(spark):
    for n in (0, 1, 96, 97, 168, 169, 500):
        w = [str(i) for i in range(n)]
        got = spark.createDataFrame([(w,)], "w array<string>").select(windows.passages(F.col("w"))).first()[0]
        assert (got[-1].words or [""])[-1] == (w[-1] if w else "") and all(len(p.words) <= 96 for p in got)
        assert set(x for p in got for x in p.words) == set(w)


def test_merge_and_nudges(spark):
    a = spark.createDataFrame([(1, "x", 0.5, "l")], "query_id int, key string, score double, evidence string")
    b = spark.createDataFrame([(1, "x", 0.9, "r"), (1, "y", 0.8, "r")], "query_id int, key string, score double, evidence string")
    assert sorted((r.key, r.score, r.evidence, r.origins) for r in rank.merged(a, b).collect()) == [("x", 0.5, "r", ["local", "remote"]), ("y", 0.8, "r", ["remote"])]
    n = spark.range(1).select(rank.nudged(F.lit(0.1), F.lit(4), F.lit(1.0), F.lit(2.0), F.lit(False), F.lit(True)).alias("s")).first().s
    assert n == pytest.approx(0.701 + 0.05 - 0.12 + 0.03)


def test_cases_are_checked(spark, tmp_path):
    good = {"id": "1", "query_text": "q", "expected_source_keys": ["A-1"], "verified": True}
    for i, (change, ok) in enumerate([({}, True), ({"verified": False}, False), ({"expected_source_keys": []}, False), ({"issue_key": "A-1"}, False), ({"id": " "}, False)]):
        (tmp_path / f"{i}.json").write_text(json.dumps(good | change))
        if ok:
            assert files.load_cases(spark, str(tmp_path / f"{i}.json")).count() == 1
        else:
            with pytest.raises(ValueError):
                files.load_cases(spark, str(tmp_path / f"{i}.json"))


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a text that is long enough to be kept")
    (tmp_path / "b.txt").write_text("short")
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    got = {r.name: (bool(r.text), r.error) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == (True, "") and got["b.txt"] == (False, "length") and got["c.docx"][1]


def test_issue_pages(spark, tmp_path):
    page = {"issues": [{"key": "A-1", "fields": {"summary": "s", "description": {"content": [{"text": "x"}, {"content": [{"text": "y"}]}]}, "status": {"name": "Open"}}}]}
    (tmp_path / "page-1.json").write_text(json.dumps(page))
    issues.register(spark)
    r = spark.read.format("issue_pages").option("path", str(tmp_path)).load().first()
    assert (r.key, r.description, r.status, r.comments) == ("A-1", "x y", "Open", "[]")


def test_scan_skips_unchanged_and_replays(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    schema = "k int, v string, at int"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2)], schema).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    scan.scan(stream(), out, cp, "k", ["v"], "at").awaitTermination()
    spark.createDataFrame([(1, "c", 3), (2, "d", 3)], schema).write.mode("append").parquet(src)
    scan.scan(stream(), out, cp, "k", ["v"], "at").awaitTermination()
    assert {r.k: r.v for r in scan.latest(spark, out).collect()} == {1: "c", 2: "d"}
    spark.createDataFrame([(2, "late", 1), (3, "e", 1)], schema).write.mode("append").parquet(src)
    scan.scan(stream(), out, cp, "k", ["v"], "at").awaitTermination()  # an event that is older than the state
    assert {r.k: r.v for r in scan.latest(spark, out).collect()} == {1: "c", 2: "d", 3: "e"}
    assert all(len(v) <= 2 for v in scan.versions(spark, out).values())


def test_comment_noise(spark):
    got = one(spark, comments.is_unusable, "done", "no issue found", "SLA breach, closing all", "dup, please refer to ABC-231619", "!shot.png!", "Reset the port and retried the order", "", "already activated\n" + "x" * 90)
    assert got == [True, True, True, True, True, False, True, False]


def test_comment_pools(spark):
    rows = [(1, "Fixed the mapping of the device and retried it!", False, False, "2026-01-01", None), (2, "done.", False, True, "2026-01-01", None), (3, "reset ok", False, True, "2026-01-01", "2026-03-01"), (4, "bot says hello to everyone in this long text here", True, False, "2026-01-01", None)]
    df = spark.createDataFrame(rows, "comment_id int, body string, bot boolean, by_assignee boolean, created string, updated string").withColumn("created", F.to_timestamp("created")).withColumn("updated", F.to_timestamp("updated")).withColumn("resolved_at", F.to_timestamp(F.lit("2026-01-02")))
    assert sorted(r.comment_id for r in comments.human_pool(df).collect()) == [1, 3]
    assert sorted(r.comment_id for r in comments.eligible(df).collect()) == [1, 2]


def test_resolution_event_takes_the_later_entry(spark):
    df = spark.createDataFrame([("A", 1, 1, "x", "status", "Done"), ("A", 5, 2, "y", "status", "Open"), ("A", 4, 3, "z", "resolution", "Fixed"), ("A", 4, 4, "w", "status", "Closed"), ("B", 1, 1, "q", "status", "Open")], "key string, at int, pos int, author string, field string, to string")
    assert [tuple(r) for r in comments.resolution_event(df, "key").collect()] == [("A", 4, "w")]
    assert comments.field_setter(df, "key", "status").where("key = 'A'").first().author == "y"


def test_source_evidence(spark):
    v = spark.createDataFrame([("v1", "Reset  the port"), ("v2", "other")], "version_id string, body string")
    c = spark.createDataFrame([(i, "Resolution: reset the PORT") for i in range(5)], "comment_id int, body string")
    got = comments.source_evidence(v, c).collect()
    assert sorted((r.version_id, r.comment_id) for r in got if r.comment_id is not None) == [("v1", 0), ("v1", 1), ("v1", 2)] and [r.evidence for r in got if r.comment_id is None] == ["other"]


def test_draft_reasons(spark):
    text = "Check the line; reset the port; retry the order"
    src = spark.createDataFrame([(d, "S", text) for d in range(6)], "draft_id int, source_key string, evidence string")
    steps = [
        (0, 1, "S", "check the line", text), (0, 2, "S", "reset the port", text), (1, 1, "X", "check the line", text), (2, 1, "S", "check the line", "Check the Line"),
        (3, 1, "S", "reset the port", text), (3, 2, "S", "check the line", text), (4, 1, "S", "reset the port", text), (5, 1, "S", "do not check the line", text),
    ]
    df = spark.createDataFrame(steps, "draft_id int, pos int, source_key string, action string, quote string")
    src = src.unionByName(src.where("draft_id = 0").withColumn("source_key", F.lit("T")))
    assert {r.draft_id: r.reason for r in decisions.draft_reasons(df, src).collect()} == {0: "", 1: "outside", 2: "changed", 3: "reordered", 4: "skipped", 5: "changed"}


def test_draft_reasons_name_what_was_left_out(spark):
    text = "Check the line; reset the port; retry the order; reset the port"
    other = "Verify the plan then update the plan"
    src = [(d, "S", text, "x") for d in range(9)] + [(d, "T", other, "x") for d in range(9)] + [(9, "S", None, "x"), (10, "S", text, "x"), (10, "S", "zzz", "x")]
    steps = [
        (0, 1, 0, "S", "reset the port", text), (0, 2, 0, "S", "frob the port", text),  # a repeated clause stands at both its places
        (1, 1, 0, "S", "check the line", text), (1, 1, 1, "S", "Checked the line", text), (1, 1, 2, "T", "verify the plan", other),  # several citations of a step
        (2, 1, 0, "S", "retry the order", text), (2, 2, 0, "S", "check the line", text), (2, 3, 0, "S", "never retry", text),  # out of order before it is changed
        (3, 1, 0, "T", "update the plan", other), (3, 2, 0, "S", "retry the order", text),  # both lack something, the one cited first counts
        (4, 1, 0, "S", "check the line", None), (5, 1, 0, "S", None, text), (6, 1, 0, None, "check the line", text), (7, 1, 0, "S", "check the line", "check the line; " + "x" * 500),
        (8, 1, 1, "S", "frob", text), (8, 1, 0, "U", "frob", text), (9, 1, 0, "S", "check the line", text), (10, 1, 0, "S", "check the line", text),
    ]
    df = spark.createDataFrame(steps, "draft_id int, pos int, cite int, source_key string, action string, quote string").withColumn("evidence", F.lit("clashing")).withColumn("fault", F.lit(1))
    df = df.unionByName(df.where("draft_id = 1")).repartition(3)
    s = spark.createDataFrame(src, "draft_id int, source_key string, evidence string, told string")
    got = {r.draft_id: (r.reason, r.source_key, r.skipped) for r in decisions.draft_reasons(df, s).collect()}
    assert got == {
        0: ("changed", "S", None), 1: ("", None, None), 2: ("reordered", "S", None), 3: ("skipped", "T", ["Verify the plan"]), 4: ("changed", "S", None), 5: ("changed", "S", None),
        6: ("outside", None, None), 7: ("changed", "S", None), 8: ("outside", "U", None), 9: ("changed", "S", None), 10: ("", None, None),
    }
    assert decisions.draft_reasons(df.limit(0), s).count() == 0 and {r.reason for r in decisions.draft_reasons(df, s.limit(0)).collect()} == {"outside"}


def test_forms_of_verbs(spark):
    words = [(f, v) for v, forms in P.VERBS.items() for f in forms.split()] + [("Retried", "retry"), ("resett", "resett"), ("", ""), ("re", "re"), ("Re-Triggered", "retrigger"), (None, None)]
    d = spark.createDataFrame(words, "w string, verb string").select("verb", P.operation(F.col("w")).alias("got"))
    assert d.where(~F.col("verb").eqNullSafe(F.col("got"))).count() == 0


def test_decision_labels(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("x"))
    none = F.array().cast("array<string>")
    row = spark.range(1).select(
        decisions.agreement(a, b, F.lit(False)).alias("a"), decisions.agreement(a, none, F.lit(False)).alias("b"), decisions.agreement(a, F.array(F.lit("z")), F.lit(True)).alias("c"),
        decisions.gated(F.lit("high"), F.lit(False), none, F.lit("different_procedures"), F.lit(True)).alias("d"), decisions.publish(F.lit("h"), F.lit("h"), F.lit("high")).alias("e"),
        decisions.package_status(F.lit("ready"), F.lit("failed")).alias("f"), decisions.next_stage(F.lit(2), F.lit("sufficient"), F.lit(False)).alias("g")).first()
    assert tuple(row) == ("independent_sources_agree", "single_branch", "different_procedures", "medium", "unchanged", "partial", "draft")


def test_seams(spark):
    df = spark.createDataFrame([("reset the port",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(seams.embed(F.col("t"))).collect()]
    assert len(got[0]) == 64 and sum(x * x for x in got[0]) == pytest.approx(1, abs=1e-5) and got[1:] == [None, None]
    row = spark.range(1).select(*seams.relevance(F.lit(float("nan"))), *seams.relevance(), seams.keep_only(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("q")))).first()
    assert tuple(row) == (0.5, False, 0.5, False, ["b"])


def test_streams_of_votes(spark, tmp_path):
    src = str(tmp_path / "v")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "voter string, at int").withColumn("at", F.timestamp_seconds("at")).write.parquet(src)
    q = scan.first_seen(spark.readStream.schema("voter string, at timestamp").parquet(src), ["voter"], "at").writeStream.format("memory").queryName("votes").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) c from votes").first().c == 2


def test_procedures(spark):
    assert one(spark, P.procedure_identity, "1. Resetting the port and retried it", "Can't retry") == [[["reset", "port"], ["retry", "it"]], [["can", "not", "retry"]]]
    got = one(spark, P.lexemes, "Can't retried a = -5.2 A/B")
    assert got == [["can", "not", "retry", "=", "-5.2", "A/B"]]
    assert one(spark, lambda c: P.is_supported(c, F.lit("reset the port; retry the order")), "retried order; reset port", "reset port", "not reset port") == [False, True, False]


@pytest.mark.parametrize("most", [None, 0])
def test_overlaps_of_few_patterns_use_all_cores(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(rules, "BROADCAST_BYTES", most)
    values = [None, ["a"], ["a", "b"], ["b", "a"], ["b", "c"], ["d"]]
    rows = [(i, [" x", "x ", "y", None][i % 4], values[i % 6]) for i in range(120)]
    d = rules.overlapping(spark.createDataFrame(rows, "id bigint, pattern string, f array<string>"), ["f"])
    assert "REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString() or most == 0

    def kind(a, b):
        if a is None or b is None:
            return "equal" if a is b else "subset"
        a, b = set(a), set(b)
        return "equal" if a == b else "subset" if a <= b or b <= a else "overlap" if a & b else "disjoint"

    want = {(i, j, kind(v, w)) for i, p, v in rows for j, q, w in rows if i < j and p and q and p.strip() == q.strip()}
    got = [tuple(r) for r in d.collect()]
    assert set(got) == want and len(got) == len(want)


def test_keyword_search_moves_texts_once(spark):
    """Counts and products stay where their document is; no row by query and document is dealt by both."""
    d = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} common words", "s", "l") for i in range(60)], "doc_id bigint, text string, source string, lang string")
    q = spark.createDataFrame([(1, "w1 w2 common"), (2, "w5 other")], "item_id bigint, text string")
    for hits in (retrieve.bm25(d, q), retrieve.fielded_bm25(d, q, {"text": 1.0, "source": 2.0}, "doc_id", "item_id", "text")):
        assert hits.count() > 0
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\((query_id#\d+L?, key#|key#\d+L?, token#|key#\d+L?, len#)", plan)


def test_texts_are_cut_a_few_megabytes_at_once(spark, monkeypatch):
    """A batch of texts goes through in shares, whole and in order, however long a text is."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from sievemark.operators import windows

    texts = ["ab " * 5_000, None, "", "x" * 30_000, "é " * 7_000] * 6
    assert [len(x) for x in windows.shares(pa.array(texts[:5]), 20_000)] == [3, 1, 1]
    assert sum((x.to_pylist() for x in windows.shares(pa.array(texts), 16)), []) == texts and [len(x) for x in windows.shares(pa.array([], pa.string()), 16)] == [0]
    monkeypatch.setattr(windows, "AT_ONCE", 20_000)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1).select("i", windows.pieces(F.col("t")).alias("p"))
    assert {r.i: r.p for r in df.collect()} == {i: windows.soft_pieces(t) for i, t in enumerate(texts)}


def test_texts_of_many_drafts_are_worked_out_once(spark):
    """What ``told`` gives may come with steps and sources; then no text is read again, and reasons are the same."""
    evidence = [("reset the port; then verify the line", 1), ("check the line", 2), (None, 3), ("create the order", 4)]
    sources = spark.createDataFrame([(d, k, t) for d in range(6) for t, k in [*evidence, (None, 1), ("zz", 4)]], "draft_id long, source_key long, evidence string")
    rows = [(0, 1, 1, "reset the port", "reset the port; then"), (0, 2, 2, "check the line", "check the line"), (1, 1, 1, "verify the line", "verify the line"), (1, 2, 1, "reset the port", "reset  the port"),
            (2, 1, 3, "check the line", "check the line"), (3, 1, 9, "check the line", "check the line"), (4, 1, 1, "verify the line", "verify the line"), (5, 1, 4, "create the order", None), (5, 2, 4, "create the order", "x" * 600)]
    steps = spark.createDataFrame(rows, "draft_id long, pos int, source_key long, action string, quote string")
    whole = lambda df: spark.createDataFrame(df.collect(), df.schema)
    given = decisions.draft_reasons(whole(steps.withColumn("doing", P.told(F.col("action"))).withColumn("quoted", P.told(F.col("quote")))), whole(sources.withColumn("told", P.told(F.col("evidence")))), ready=True)
    want = sorted(map(tuple, decisions.draft_reasons(steps, sources).collect()))
    assert sorted(map(tuple, given.collect())) == want and {r[1] for r in want} == {"", "reordered", "changed", "outside", "skipped"}
    assert "regexp_like" not in given._jdf.queryExecution().executedPlan().toString().lower().replace("rlike", "regexp_like")


def test_qualifiers_stand_in_clauses(spark):
    """What ends a clause holds no qualifier, so those of the clauses are those of the text."""
    r = random.Random(9)
    parts = ["not", "can't", "cannot", "Don't", "until", "1.", "2)", "1.if", "-5", "x-only", "then", "and then", "and reset", "if;no", "never.", "after!", "\n3. unless", "\n", ";", "the", "Checked", "a.b/no", "isn't.", "was", "before,"]
    rows = [(i, "".join(r.choice(parts) + r.choice([" ", "  ", "", "\n"]) for _ in range(r.randint(0, 9)))) for i in range(600)] + [(600, None), (601, "")]
    df = spark.createDataFrame(rows, "i int, t string").select("t", P.told(F.col("t")).alias("told"), P.qualifiers(F.col("t")).alias("want"))
    assert [(x.t, x.want) for x in df.collect() if x.told.held != x.want] == [] and df.where("size(want) > 1").count() > 100


def test_fielded_search_reads_whole_texts(spark):
    """A term counts wherever it stands in a query or a text; a column of two fields counts for both."""
    d = spark.createDataFrame([(i, "filler " * 300 + ("deep" if i == 3 else "other"), "s") for i in range(9)], "doc_id bigint, text string, source string")
    q = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)) + " deep"), (2, "s")], "item_id bigint, text string")
    weights = {"summary": 1.0, "error": 5.0, "body": 0.5}
    hits = retrieve.fielded_bm25(d, q, weights, "doc_id", "item_id", "text", of={"summary": "source", "error": "text", "body": "text"})
    apart = retrieve.fielded_bm25(d.selectExpr("doc_id", "source AS summary", "text AS error", "text AS body"), q, weights, "doc_id", "item_id", "text")
    got, want = ({(r.query_id, r.key): round(r.score, 9) for r in x.collect()} for x in (hits, apart))
    assert got == want and [k for k in got if k[0] == 1] == [(1, 3)] and len(got) == 10
    from sievemark.plans import queries

    assert "left(" not in queries.ORACLE["fielded_topk"] and "list_slice" not in queries.ORACLE["fielded_topk"]
