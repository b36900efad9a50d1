"""Defined cases of the issue, vote, library, cache, document and state operators: nulls, empty tables, ties, clashing names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievemark.functions import issues as I
from sievemark.functions import procedures as P
from sievemark.functions import tables as B
from sievemark.operators import caches, chain, decisions, documents, issues, library, quality, retrieve, state, votes


def values(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").orderBy("i").select(f(F.col("c"))).collect()]


def test_texts_of_issues_take_nulls(spark):
    assert values(spark, I.stable_error, None, "", "Error 14081: x 005A0000001AbCdEFG , y") == ["", "", "Error 14081: x, y"]
    assert values(spark, I.seconds, None, "", "2.5", "1m30s", "500ms", "soon", "1h 2m") == [60.0, 60.0, 2.5, 90.0, 0.5, 60.0, 3720.0]
    assert values(spark, I.word_chunks, None, "", "short") == [[], [], []]
    none = F.lit(None).cast("array<struct<author:string,body:string>>")
    q = spark.range(1).select(I.issue_query(F.lit(None).cast("string"), F.lit(None).cast("string"), none, "bot").alias("q")).first().q
    assert (q.text, q.step, q.error) == ("Summary: \n", "", "")
    assert values(spark, lambda c: I.looks_like_no_fix(c, F.lit(None).cast("boolean")), None, "Error: x", "1. reset it", "=== FIX === x", "SLA breached", "reset it") == [True, True, False, False, True, False]


def test_codes_of_more_digits(spark):
    c = F.array(F.struct(F.lit("bot").alias("author"), F.lit("PR_Error_Description: 1234567 | bad part").alias("body")))
    texts = [I.ticket_text(F.lit("MOVE: x"), F.lit(""), c, "bot", *digits) for digits in ((), (19,))]
    assert list(spark.range(1).select(*texts).first()) == ["MOVE\nError: bad part", "MOVE\nError: 1234567 | bad part"]


def test_newest_marked_comment_wins(spark):
    c = [("Ann", "PR_Error_Description: no"), ("bot", "PR_Error_Description: 5 | old"), (" BOT ", "x\nPR_Error_Description: 123456 | new"), ("bot", "PR_Error_Description:"), ("bot", None), (None, "PR_Error_Description: z")]
    df = spark.createDataFrame([(c,)], "c array<struct<author:string,body:string>>")
    assert df.select(I.marked_error(F.col("c"), "bot", True)).first()[0] == "123456 | new"


def test_resolution_tables_take_odd_bodies(spark):
    assert values(spark, B.to_fix_block, None, "", "=== FIX ===\n1. reset it\n=== END ===", "Cause: bad line\nreset 1234567 it.;") == ["", "", "=== FIX ===\n1. Reset it\n=== END ===", "=== FIX ===\nRoot Cause: bad line\n1. Reset it\n=== END ==="]
    assert values(spark, B.infer_system, None, "x sf y", "SALESFORCE sf", "misfit") == ["", "SF", "Salesforce", ""]
    assert values(spark, lambda c: F.size(B.reply_fields(c)), None, "", "Cause: n/a", "NO_RELIABLE_WORKAROUND\nCause: x", "Cause: x\nCause: y") == [0, 0, 0, 0, 1]


def test_support_needs_equal_conditions(spark):
    say = lambda step, source: spark.range(1).select(P.is_supported(F.lit(step), F.lit(source))).first()[0]
    assert say("Retried the order", "retry order; close it") and not say("retry order", "do not retry order") and not say("retry order", "retry order if it is open")
    assert not say("the order", "the order") and not say("", "retry order") and not say("retry order" + " x" * 500, "retry order")
    assert not say("close port; retry order", "retry order; close port")


def test_order_context_must_agree(spark):
    base = {"step": F.lit("s"), "error": F.lit("e"), "code": F.lit("")}
    same = lambda a, b: spark.range(1).select(quality.same_failure(base | {"order_type": F.lit(a)}, base | {"order_type": F.lit(b)})).first()[0]
    assert same("Change Order", "change") and same("x", "") and not same("", "add") and not same("change", "sales order")


def test_chain_order(spark):
    rows = [(1, "a", "ticket", 0.5, 0.1, 3, 0.0, 1.0, 1), (1, "b", "ticket", 0.69, 0.2, 0, 0.0, 2.5, 1), (1, "c", "doc", 0.6, 0.0, 0, 0.0, 9.0, 1), (1, "d", "doc", 0.9, 0.0, -1, 0.0, 9.0, 1), (1, "e", "ticket", 0.69, 0.2, 0, 0.0, 1.5, 1)]
    df = spark.createDataFrame(rows, "query_id int, key string, type string, score double, rrf double, net int, order_adj double, quality double, updated int")
    got = [(r.key, r.feedback) for r in chain.final_order(chain.ranked_chain(df)).orderBy("position").collect()]
    assert got == [("d", "demoted"), ("b", ""), ("e", ""), ("a", "curated")]
    assert chain.ranked_chain(df.where("false")).count() == 0 and chain.overfetch(10, 8, 16, 400) == 80 and chain.overfetch(1, 8, 16, 400) == 16


def test_outcomes_are_recorded_once(spark):
    o = spark.createDataFrame([(1, "v", "human", "succeeded", True, None, 1), (2, "v", "human", "succeeded", True, "", 1), (3, "v", "automated", "failed", True, None, 1), (4, "v", "automated", "failed", True, "r", 2), (5, "v", "automated", "failed", True, " r ", 1), (6, "w", "human", "failed", True, None, 1), (7, "v", "human", "maybe", True, None, 1), (8, "v", "human", "failed", None, None, 1)], "id int, version_id string, source_kind string, outcome string, verified boolean, external_reference string, created_at int").withColumn("row", F.lit(0))
    v = spark.createDataFrame([("v",)], "version_id string")
    assert sorted(r.id for r in votes.new_outcomes(o, o.where("false"), v).collect()) == [1, 2, 5]
    assert sorted(r.id for r in votes.new_outcomes(o, o.where("id = 4"), v).collect()) == [1, 2]


def test_rejections_follow_the_current_version(spark):
    v = spark.createDataFrame([(1, "a", "v1", -1), (1, "b", None, -1), (1, "c", "v1", 1), (2, "a", "v2", -1)], "issue_key int, key string, version_id string, vote int")
    now = spark.createDataFrame([("a", "v2")], "key string, version_id string")
    gone = votes.rejected(v, now)
    assert sorted(map(tuple, gone.collect())) == [(1, "b"), (2, "a")]
    assert sorted(map(tuple, votes.without_rejected(v.select("issue_key", "key"), gone).collect())) == [(1, "a"), (1, "c")]


def test_versions_after_their_evidence(spark):
    i = spark.createDataFrame([("k1", None, "s", "e", "reset the port and retry it", None, 1), ("k2", None, "S!", "e", "Reset the port, and retry it.", "r", 3), ("k3", "", "s", "e", "cancel the order and retry it", "r", 2), ("k4", "", "s", "", "no error so it is not recorded", "r", 2), ("k5", "", "s", "e", "short", "r", 2)], "source_key string, order_reason string, step string, error string, body string, release string, resolution_at int")
    v = library.record_versions(i)
    assert sorted((r.version_number, r.status, r.source_keys, r.releases) for r in v.collect()) == [(1, "current", ["k1", "k2"], ["r"]), (2, "superseded", ["k3"], ["r"])]
    gone = spark.createDataFrame([("k1",), ("k2",)], "source_key string")
    assert [(r.version_number, r.status) for r in library.detach(v, gone, v.where("false")).collect()] == [(2, "current")]
    assert sorted((r.version_number, r.status) for r in library.detach(v, gone, v.where("version_number = 1")).collect()) == [(1, "superseded"), (2, "current")]
    assert library.record_versions(i.where("false")).count() == 0


def test_cache_lookups(spark):
    e = spark.createDataFrame([("x", "s", "h", [1.0, 0.0]), ("y", "s", "h2", [0.0, 1.0]), ("z", "s", "h3", None), ("w", "other", "h", [1.0, 0.0])], "id string, scope string, query_hash string, vector array<double>")
    q = spark.createDataFrame([(1, "s", "h", False, None), (2, "s", "n", True, [0.1, 1.0]), (3, "s", "n", False, [0.0, 1.0]), (4, "s", "n", True, [0.0, 0.0]), (5, "none", "h", True, [1.0, 0.0])], "query_id int, scope string, query_hash string, eligible boolean, vector array<double>")
    got = {r.query_id: (r.status, r.id) for r in caches.lookup(q, e, 0.97).collect()}
    assert got == {1: ("exact_hit", "x"), 2: ("semantic_hit", "y"), 3: ("miss", None), 4: ("miss", None), 5: ("miss", None)}
    raw = ['{"a": {"llm_score": 0.5, "llm_reason": "x"}}', '{"a": {"llm_score": 0.5}}', '{"b": {"llm_score": 0.5, "llm_reason": "x"}}', "[]", "", None, '{"a": {"llm_score": true, "llm_reason": "x"}}', '{"a": {"llm_score": 1e0, "llm_reason": ""}}']
    assert [x is not None for x in values(spark, lambda c: caches.valid_scores(c, F.array(F.lit("a"))), *raw)] == [True, False, False, False, False, False, False, True]


def test_documents_of_odd_texts(spark):
    d = spark.createDataFrame([(1, None, "given"), (2, "", ""), (3, "Failed Step: port\nError: 5 | x\n" + "reset the port and retry it\n" * 20, None)], "doc_id int, text string, step string")
    items = documents.source_items(documents.merged_context(d), size=200)
    rows = {r.source_key: r for r in items.collect()}
    assert set(rows) == {f"DOC:3:{i}" for i in range(1, len(rows) + 1)} and all(r.step == "port" and r.chunk_count == len(rows) and len(r.body) <= 200 for r in rows.values())
    assert {r.doc_id: r.status for r in documents.indexed(d, items).collect()} == {1: "failed", 2: "failed", 3: "ready"}


def test_choice_of_the_resolution(spark):
    t = lambda n: dt.datetime(2026, 1, n)
    good, other = "Reset the access port in the portal and retry the order line", "Resolution: Resetting the broken port in the portal"
    comments = [("1", good, t(3), None, "a"), ("2", other, t(2), None, "b"), ("3", "done", t(9), None, "a"), ("4", good, t(3), t(30), "a"), ("5", "OWN " + good, t(9), None, "b"), ("6", None, None, None, None)]
    schema = "id string, body string, created timestamp, updated timestamp, author string"
    df = spark.createDataFrame([(1, comments, "Done"), (2, comments, "Cancelled"), (3, [], "Done"), (4, comments[2:3], "Done"), (5, comments[1:2], "Done")], f"i int, c array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>, status string")
    x = issues.resolution_choice(F.col("c"), F.col("status"), F.lit(t(5)), F.lit("a"), F.lit("s"), F.lit("e"), ("OWN",))
    got = {r.i: (r.x.comment_id, r.x.tier, r.x.selection) for r in df.select("i", x.alias("x")).collect()}
    assert got == {1: ("1", "high", "assignee_authored_fallback"), 2: ("", "low", "excluded_cancelled_ticket"), 3: ("", "low", "none"), 4: ("3", "low", "assignee_authored_fallback"), 5: ("2", "high", "structured_resolution")}


def test_keys_in_answers(spark):
    got = values(spark, issues.named_keys, '[{"key": "AB-12"}, {"type": "page", "key": "AB-13"}, {"key": "AB-012"}, {"url": "https://x/browse/CD-1"}, {"key": "AB-12"}]', "see https://x/browse/EF-9, AB-1", "", None)
    assert got == [["AB-12", "CD-1"], ["EF-9"], [], []]


def test_streams(spark):
    rows = [("a", 1, "artifact-update", "x", "He", True, None, None), ("a", 2, "artifact-update", "x", "llo", None, False, None), ("a", 3, "artifact-update", "y", "draft", None, None, None), ("a", 4, "artifact-update", "y", "final", None, None, "completed"), ("b", 1, "artifact-update", "x", "half", True, None, "working"), ("c", 1, "message", None, "hi", None, None, None), ("d", 1, "artifact-update", "x", "...", True, None, "completed")]
    e = spark.createDataFrame(rows, "request_id string, seq int, kind string, artifact_id string, text string, append boolean, last_chunk boolean, state string")
    assert {r.request_id: r.text for r in decisions.reduced_stream(e).collect()} == {"a": "Hello\n\nfinal", "b": None, "c": "hi", "d": None}


def test_nearest_ranks(spark):
    import math
    import random

    from sievemark.operators.history import nearest_rank

    r = random.Random(4)
    rows = [(g, r.choice([None, 1.0, 2.5, r.random() * 100, -r.random()])) for g in ("a", "b", None) for _ in range(r.randint(30, 90))] + [("one", 7.0), ("none", None), ("same", 3.0), ("same", 3.0)]
    got = {x.g: (x.p50, x.p95) for x in nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", "g", buckets=8).collect()}
    for g in {x[0] for x in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == tuple(v[max(1, math.ceil(len(v) * p)) - 1] if v else None for p in (0.5, 0.95))


def test_state_tables(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k int, is_newer string, at int")
    new = spark.createDataFrame([(1, "late", 4), (2, "c", 6), (3, "d", 1)], t.schema)
    assert {r.k: r.is_newer for r in state.upserted(t, new, ["k"], "at").collect()} == {1: "a", 2: "c", 3: "d"}
    with pytest.raises(ValueError):
        issues.copied(t, t)
    assert issues.copied(t, t.where("false").withColumn("at", F.col("at").cast("long"))).schema["at"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError):
        issues.point_lookup({"t": t}, "t", "secret", "x", ["k"])


def test_quotations_and_similar_sets(spark):
    texts = ["the quick brown fox jumps over the lazy dog today", "xthe quick brown fox jumps over the lazy dogs", "nothing", "", None, "a b", "A Quick one"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    b = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "b"), (3, "Quick"), (4, "brown fox jumps over the"), (5, "fox over brown jumps quick the lazy")], "item_id int, text string")
    got = sorted(map(tuple, retrieve.quoted(d, b).select("query_id", "key").collect()))
    assert got == sorted((i, k) for k, t in enumerate(texts) for i, needle in b.collect() if needle in (t or ""))
    import random

    r = random.Random(2)
    left = [[r.choice("abcdefghij") for _ in range(r.randint(0, 8))] for _ in range(60)]
    right = [[r.choice("abcdefgh") for _ in range(r.randint(0, 6))] for _ in range(30)]
    frame = lambda rows, key: spark.createDataFrame([(i, sorted(set(x))) for i, x in enumerate(rows)], f"{key} int, t array<string>")
    for least in (0.2, 0.5, 1.0):
        got = {(x.doc_id, x.item_id) for x in retrieve.similar_sets(frame(left, "doc_id"), frame(right, "item_id"), least).collect()}
        want = {(i, j) for i, a in enumerate(left) for j, c in enumerate(right) if set(a) and set(c) and len(set(a) & set(c)) / len(set(a) | set(c)) >= least}
        assert got == want


def test_suggestions_step_by_step():
    from types import SimpleNamespace

    from sievemark.streaming.suggestions import NEW, step

    def run(*events):
        state, done = NEW, []
        for i, (kind, candidate, *more) in enumerate(events):
            state, action = step(state, SimpleNamespace(seq=i, kind=kind, candidate=candidate, deferred="late" in more, preview="preview" in more))
            done.append((state[0], action))
        return done, state

    assert run(("scan", None), ("scan", None), ("scan", "a"), ("scan", "b"))[0] == [("awaiting_match", "post"), ("awaiting_match", "skip"), ("posted", "edit"), ("posted", "skip")]
    done, state = run(("scan", "a"), ("down", "b"), ("down", "a"), ("up", None))
    assert done == [("posted", "post"), ("improved", "edit"), ("exhausted", "edit"), ("accepted", "record")] and state[3] == "a,b"
    assert run(("scan", "a", "preview"), ("scan", "a", "preview"), ("scan", "a"))[0] == [("previewed", "preview"), ("previewed", "skip"), ("posted", "post")]
    assert run(("scan", "a", "late"), ("scan", "a"))[0] == [("deferred", "defer"), ("posted", "post")]
    state, action = step(("posted", "a", True, "", 5), SimpleNamespace(seq=5, kind="down", candidate=None, deferred=False, preview=False))
    assert (state[0], action) == ("posted", "skip")


def test_suggestions_over_batches(spark, tmp_path):
    """A stream in three batches does the same as one pass, and a repeated event nothing."""
    from sievemark.streaming import suggestions as su

    rows = [(t, s, ("scan", "scan", "down", "up")[(t + s) % 4], ("a", "b", None)[(t * s) % 3], s % 5 == 0, t % 4 == 0) for t in range(8) for s in range(9)]
    want, src, out = set(), str(tmp_path / "src"), str(tmp_path / "out")
    for t in range(8):
        state = su.NEW
        for r in sorted(x for x in rows if x[0] == t):
            state, action = su.step(state, spark.createDataFrame([r], su.EVENT).collect()[0])
            if action != "skip":
                want.add((t, r[1], state[0], action, state[1], state[3]))
    for part in ([r for r in rows if r[1] < 3], [r for r in rows if 2 <= r[1] < 6], [r for r in rows if r[1] >= 6]):
        spark.createDataFrame(part, su.EVENT).coalesce(1).write.mode("append").parquet(src)
        stream = su.suggestions(spark.readStream.schema(su.EVENT).parquet(src))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.schema(su.RESULT).parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_lists_in_office_files():
    import io
    import zipfile

    from sievemark.sources.files import docx_text

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda inner, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{inner}</w:t></w:r></w:p>"
    xml = f"<w:document {w}><w:body>{p('head')}{p('one', '<w:numPr/>')}{p('two', '<w:pStyle w:val=' + chr(34) + 'ListBullet' + chr(34) + '/>')}</w:body></w:document>"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", xml)
    assert docx_text(held.getvalue()) == "head\n• one\n• two"


def test_pages_of_issues_with_a_limit(spark, tmp_path):
    import json

    from sievemark.sources import issues as source

    for n in range(3):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"issues": [{"key": f"A-{n}{i}", "fields": {}} for i in range(4)]}))
    source.register(spark)
    read = lambda **o: sorted(r.key for r in spark.read.format("issue_pages").options(path=str(tmp_path), **o).load().collect())
    assert len(read()) == 12 and read(limit="5") == ["A-00", "A-01", "A-02", "A-03", "A-10"] and len(read(limit="99")) == 12
