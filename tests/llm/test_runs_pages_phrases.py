import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import collocations as phrases
from sievemark.llm._dom import aligned, grouped, match, parsed, shape, united
from sievemark.llm.collocations import collocations, phrase_counts
from sievemark.llm.periodic_runs import automaton, find_runs, repeated_stretches, run_digests, runs_of, with_planted_periods
from sievemark.llm.wrapper_induction import Wrapper, extract_text, induce_wrappers

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, id string, runs string, words string"


def docs_of(spark, rows, parts=3):
    full = [(i, t, lang, "x", "y", "z") for i, t, lang in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


# Periodic runs


def plain_runs(words, least=24, times=3):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, times * q) and not any(words[i : i + size - d] == words[i + d : i + size] for d in range(1, q)):
                out[i, q] = size
            i = j + 1
    return sorted((s, m, q) for (s, q), m in out.items())


def plain_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc is not None and words:
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_automaton_has_the_states_of_all_substrings():
    rng = random.Random(3)
    for _ in range(50):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 25))]
        length, link, clone = automaton(w)
        ends = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                ends.setdefault(tuple(w[i:j]), set()).add(j)
        assert len(length) - 1 == len({frozenset(e) for e in ends.values()})
        assert sum(length[v] - length[link[v]] for v in range(1, len(length))) == len(ends)
        assert sum(not c for c in clone) == len(w) + 1


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        w = [rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randint(0, 70))]
        for least, times in ((1, 2), (6, 3), (24, 3)):
            assert runs_of(w, least, times) == sorted(plain_runs(w, least, times), key=lambda r: (r[0], r[2]))


def test_stretches_lose_no_run():
    rng = random.Random(6)
    for _ in range(200):
        w = [rng.randrange(4) for _ in range(rng.randint(1, 150))]
        if rng.random() < 0.7:
            a, p = rng.randrange(len(w)), rng.randint(1, 12)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        at, to = repeated_stretches(np.array(w, np.uint64), np.array([0, len(w)]), 16, 24)
        for s, m, _ in plain_runs(w):
            assert any(x <= s and s + m <= y for x, y in zip(at, to, strict=True))


def run_texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    out = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "a b " * 500, "ä ö ü " * 30, "A a " * 20]
    for _ in range(120):
        t = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(0, 2)):
            p, k = rng.randint(1, 12), rng.randint(2, 9)
            at = rng.randrange(len(t))
            t[at:at] = [rng.choice(words) for _ in range(p)] * k + t[at : at + 1]
        out.append(rng.choice((" ", "  ", "\n", "\t ")).join(t))
    return out


def test_run_digests_against_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(run_texts())] + [(None, "x y " * 30, "en"), (3, "b " * 30, None), (3, "b " * 30, None)]
    got = run_digests(find_runs(with_planted_periods(docs_of(spark, rows))))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((plain_row(i, t) for i, t, _ in rows), key=key)


def test_runs_of_empty_table_and_long_text(spark):
    assert run_digests(find_runs(with_planted_periods(docs_of(spark, [])))).collect() == []
    rng = random.Random(9)
    period = [f"v{rng.randrange(900)}" for _ in range(7001)]
    long = " ".join([f"u{i}" for i in range(150_000)] + period * 20)
    r = find_runs(docs_of(spark, [(1, long, "en"), (5, "z " * 400_000, "en")])).orderBy("doc_id").collect()
    assert [tuple(x) for x in r[0].runs] == [(150_000, 140_020, 7001)] and r[0].n_words == 290_020
    assert [tuple(x) for x in r[1].runs] == [(0, 400_000, 1)] and r[1].collapsed == "z"


def test_registered_runs_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in run_digests(find_runs(with_planted_periods(docs))).collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    short = [r for r in rows if len((r[1] or "").split()) < 400]
    assert len(short) > 100
    assert all(got[i] == plain_row(i, t) for i, t in short)
    assert any(v[1] for v in got.values())


# Wrapper induction


def page(title, body, *, menu=("Home", "News"), foot="(c) host", extra=""):
    lists = "".join(f'<li><a href="/{m}">{m}</a></li>' for m in menu)
    return f"<html><head><title>{title}</title><script>var x='</p><p>no';</script></head><body><div class=top-nav><ul>{lists}</ul></div>{extra}<div id=wrap><div class=text><h2>{title}</h2>{body}</div><div class=side>{' '.join(menu)} of the day</div></div><div>{foot}</div></body></html>"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


PAGES = "page_id bigint, url string, html string, host string, text string, shape string"


def pages_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGES).repartition(parts)


def test_matching_and_union_of_trees():
    a = ["b", ["p", ["#"]], ["ul", ["li", ["#"]]], ["p", ["#"]]]
    b = ["b", ["h"], ["p", ["#"]], ["p", ["#"], ["i"]]]
    assert match(a, a) == 8 and match(a, b) == 5 and match(["x"], ["y"]) == 0
    both = united(a, b)
    assert match(both, a) == 8 and match(both, b) == 7  # every node of either is found again
    assert united(both, a) == both and -1 not in aligned(a, both) and -1 not in aligned(b, both)


def test_matching_against_all_alignments():
    rng = random.Random(2)

    def tree(depth):
        return [rng.choice("xy"), *(tree(depth - 1) for _ in range(rng.randint(0, 3 if depth else 0)))]

    def plain(a, b):
        if a[0] != b[0]:
            return 0

        def best(x, y):
            return 0 if not x or not y else max(best(x[1:], y), best(x, y[1:]), plain(x[0], y[0]) + best(x[1:], y[1:]))

        return 1 + best(a[1:], b[1:])

    for _ in range(150):
        a, b = tree(2), tree(2)
        assert match(a, b) == plain(a, b)
        assert match(united(a, b), b) >= match(a, b) if a[0] == b[0] else True


def test_odd_markup():
    def of(source):
        return Wrapper(None, None).content(source)

    assert of("") == "" and of("   ") == "" and of("<p>") == ""
    assert of("just  text &amp; more") == "just text & more"
    assert of("<p>one<br>two<p>three<b>four</p>five") == "one two\n\nthreefour\n\nfive"
    assert of("<p>a&nbsp;b &lt;p&gt; &#233;&copy &am") == "a b <p> é© &am"
    assert of("<p>a</p><!-- <p>b</p> --><script>'<p>c</p>'</script><p>d</p><style>") == "a\n\nd"
    assert of("<p>cut off <a hre") == "cut off"
    assert of("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    assert of("<div title='a>b'>x</div><nav>m</nav><div class='ad'>y</div><form>z</form>") == "x"
    assert of("<article><p>x</p><p class=notice>n</p><div id=comments><p>c</p></div></article><p>out</p>") == "x"
    assert of("<main><p>m</p></main><div>o</div>") == "m"
    assert of("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>end</p>") == "deep\n\nend"
    assert of("<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><p><a>only link</a></p>") == "only link"
    long = "<article>" + "".join(f"<p>{i}</p><h3>{i}</h3>" for i in range(20_000)) + "</article>"
    assert of(long).count("\n\n") == 39_999


def test_lists_are_one_node():
    tree = shape(grouped([parsed("<ul><li>a<li>b<li>c</ul><p>x</p><p>y</p>")[0]]))
    assert tree == ["#page", ["ul", ["li", ["#"]]], ["p", ["#"]]]


def test_constant_nodes_are_template_and_slots_are_content(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(60):
        title, body = words(rng, 5), [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 4))]
        text = "".join(f"<p>{x}</p>" for x in [*body, "Subscribe now and never miss a story"])
        rows.append((i, f"https://user@News.example.org:80/{i}", page(title, text, menu=[words(rng, 1) for _ in range(4)], foot=f"{words(rng, 3)} imprint")))
        want[i] = "\n\n".join([title, *body])
    rows += [(100 + k, "http://solo.example.net/", page("t", "<p>Subscribe now and never miss a story</p><p>more of it</p>")) for k in range(2)]
    got = {r.page_id: r.text for r in extract_text(pages_of(spark, rows)).collect()}
    assert {i: got[i] for i in want} == want
    assert "Subscribe now" in got[100] and got[100] == got[101]  # two pages are no evidence


def test_wrappers_don_t_depend_on_partitions(spark):
    rng = random.Random(14)
    rows = [(i, f"http://h{i % 2}.example/{i}", page(words(rng, 3), "".join(f"<p>{words(rng, 9)}</p>" for _ in range(3)), extra=rng.choice(("", "<div>x</div>", "<table><tr><td>q</table>")))) for i in range(50)]
    one, other = (sorted(map(tuple, induce_wrappers(pages_of(spark, rows, n), most_broadcast=m).collect())) for n, m in ((1, 1 << 20), (7, 0)))
    assert one == other and len(one) == 2


def test_copies_are_no_evidence(spark):
    rng = random.Random(5)
    article = [words(rng, 40), words(rng, 30)]
    same = page("copy", "".join(f"<p>{x}</p>" for x in article))
    rows = [(i, "http://a.example/x", same) for i in range(40)]
    rows += [(50 + i, "http://a.example/y", page(words(rng, 4), f"<p>{words(rng, 50)}</p>")) for i in range(5)]
    got = {r.page_id: r.text for r in extract_text(pages_of(spark, rows)).collect()}
    assert got[0] == "\n\n".join(["copy", *article]) and len(set(got.values())) == 6


def test_pages_defined_cases(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (2, "http://x/", "<p>a"), (2, "http://x/", "<p>a"), (None, "http://x/", "<p>b")]
    got = extract_text(pages_of(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, None, "", 0), (2, "nonsense", "", 0), (2, "http://x/", "a", 1), (2, "http://x/", "a", 1), (None, "http://x/", "b", 1)]))
    assert extract_text(pages_of(spark, [])).collect() == []


def test_registered_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)


# Collocations


def phrase_rows():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(5)]
    rows = [(0, None, None), (1, "", "en"), (2, "...", None), (3, "a.b", "x"), (4, "New York " * 40, "en"), (5, "New York city hall, " * 35, "und"), (6, "tick\ttock " * 31 + " ", None), (6, "tick\ttock " * 31, None)]
    for i in range(300):
        t = [rng.choice(vocabulary) + rng.choice(("", "", "", "", ",", ".", "\n")) for _ in range(rng.randint(1, 160))]
        rows.append((10 + i, rng.choice((" ", "  ", "\t")).join(t), rng.choice(("en", "de", None))))
    return rows


@pytest.mark.parametrize("bits", [26, 12])
def test_collocations_against_sql(spark, bits):
    docs = docs_of(spark, phrase_rows())
    got = sorted(map(tuple, collocations(docs, most_bits=bits).collect()))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang").toPandas())
    assert got == sorted(con.execute(phrases.SQL).fetchall()) and len(got) > 100


def test_collocations_on_registered_table(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = collocations(spark.read.parquet(f"{SF}/documents.parquet"))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(phrases.SQL).fetchall())


def test_no_frequent_phrase_is_lost_by_a_tiny_sketch(spark):
    docs = docs_of(spark, phrase_rows())
    few, many = (sorted(map(tuple, phrase_counts(docs, most_bits=b).where("size > 0").collect())) for b in (12, 20))
    assert few == many


def test_collocations_of_empty_table(spark):
    assert collocations(docs_of(spark, [])).collect() == []
    assert collocations(docs_of(spark, [(1, None, None), (2, "  ", "en")])).collect() == []


def test_counters_stop_at_255():
    counters = np.zeros(8, np.uint8)
    for _ in range(3):
        phrases.added(counters, np.array([3] * 200 + [5], np.uint32))
    assert counters.tolist() == [0, 0, 0, 255, 0, 3, 0, 0]


def test_score_is_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(9 * 10**17, 9 * 10**17, 9 * 10**17 + 1)], "a bigint, l bigint, r bigint")
    got = df.select(F.expr("(cast(a as decimal(19)) * 2000000) div (cast(l as decimal(19)) + r)")).first()[0]
    assert got == 2_000_000 * 9 * 10**17 // (18 * 10**17 + 1)
