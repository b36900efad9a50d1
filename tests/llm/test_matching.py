"""Decontamination, similarity join, suffix index, language models, toxicity, nearest neighbours, pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import count, takewhile

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievemark.llm import ann_tree, lm_score, ngram_join, queries, suffix_dedup, toxicity
from sievemark.llm._graph import components
from sievemark.llm._rindex import RunIndex
from sievemark.llm import decontaminate as decontamination
from sievemark.llm._words import tokens, words
from sievemark.llm.decontaminate import decontaminate, without_benchmark

SF = "/root/testdata/sf0.001"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, 1) for i, t in enumerate(texts)], "doc_id long, text string, id int")


# ---- decontamination
ITEM = "Alice bought 5 red apples for 12 dollars and gave two of them to her brother Tom before walking 3 miles home"


def test_templates_catch_new_parameters(spark):
    docs = [
        None, "", "intro words here. " + ITEM + " and more", ITEM.replace("Alice", "Maria").replace("5", "7").replace("12", "31").replace("Tom", "Juan").replace("3", "9"),
        ITEM.upper(), "Something else that has nothing to do with fruit at all and goes on for a while", ITEM[:20], ITEM.replace("apples", "apples,  ").replace(" and ", "\nand "),
    ]
    b = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, "one two three four five six")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate(frame(spark, docs), b).collect()}
    assert got == {(2, 1): True, (3, 1): False, (4, 1): True, (7, 1): True}
    left = without_benchmark(frame(spark, docs), b)
    assert left.columns == ["doc_id", "text", "id"] and {r.doc_id for r in left.collect()} == {0, 1, 5, 6}


def test_every_item_has_windows(spark):
    """Items of numbers, of few tokens and in scripts without spaces are found word for word."""
    items = ["What is 12 * 7 + 3?", "Compute 45 + 17", "一个农夫有十七只羊卖掉九只以后还剩几只", "りんごを五個買いました", "3 5 8 13 21 34 55 89 144 233", "ไก่", "12 + 30"]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [f"see below: {x} and so on" for x in items[:2]] + [f"前文。{x}。后文" for x in items[2:4]] + [f"so 7 8 {items[4]} 9", f"x {items[5]}", "12 30, 12 30"]
    odd = ["What is 13 * 7 + 4?", "Compute 45 + 18", "农夫羊", "34 55 3 5 21 8", "", None, "一个人走在路上"]
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate(frame(spark, docs + odd), b).collect()}
    assert got == {(i, i): True for i in range(7)}
    assert {r.doc_id for r in without_benchmark(frame(spark, docs + odd), b).collect()} == set(range(7, 14))


def test_inconsistent_slots_are_dropped(spark):
    item = "If A sees B then A calls B and when A calls B twice B tells A that A was late and B leaves"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    ok = re.sub(r"\bA\b", "X", re.sub(r"\bB\b", "Y", item))
    names = iter("CDEFGHIJKLMNOPQRSTUVWXYZ")
    wrong = re.sub(r"\b[AB]\b", lambda m: next(names), item)
    assert [r.doc_id for r in decontaminate(frame(spark, [ok, wrong]), b, coverage=0.5, least_words=2).collect()] == [0]


def test_blocks_of_the_benchmark_agree(spark):
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {(r.doc_id, r.item_id) for r in decontaminate(d, b).collect()}
    assert one == {(r.doc_id, r.item_id) for r in decontaminate(d, b, block_bytes=4000).collect()}
    truth = set(map(tuple, duckdb.sql(f"select doc_id, item_id from '{SF}/documents.parquet' d, '{SF}/benchmark.parquet' b where contains(d.text, b.text)").fetchall()))
    assert truth <= one
    assert decontaminate(d.where("false"), b).count() == 0 and decontaminate(d, b.where("false")).count() == 0


def test_slots_agree_both_ways(spark):
    """Four names and two numbers don't match a text in which all names, or all numbers, are one."""
    item = "Alice gave Bob 12 red pears while Carol and Dave were counting 7 green plums in the old kitchen garden"
    one = re.sub("Alice|Bob|Carol|Dave", "Eve", item).replace("12", "7")
    other = item.replace("Alice", "Ina").replace("Bob", "Jon").replace("Carol", "Kim").replace("Dave", "Lou").replace("12", "31")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate(frame(spark, [one, other, item]), b).collect()] == [1, 2]


class Plain:
    """Template matching of one item and one text by comparing windows of strings, for tests."""

    UNITS = set(decontamination.UNITS)

    def __init__(self, text):
        self.tokens, self.kind, self.signs, between = [], [], [], ""
        for raw in re.split(r"[\x20\x09-\x0D]+", text or ""):
            own = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", "", raw)
            if not own:
                between += raw
                continue
            before, after = raw.partition(own[0])[0], raw.rpartition(own[-1])[2]
            self.signs.append("".join(sorted(c for c in between + before if c in "+-*/=<>^%")) if self.tokens else "")
            between = after
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in own)
            number = any(c.isascii() and c.isdigit() for c in own)
            unit = not number and self.kind and self.kind[-1] == "number" and low in self.UNITS
            name = "A" <= own[0] <= "Z" or "À" <= own[0] <= "Þ"
            self.tokens.append(low)
            self.kind.append("number" if number else "unit" if unit else "name" if name else None)

    def template(self, names):
        if names is None:
            return [(t,) for t in self.tokens]
        return [k if k and (names or k != "name") else (t,) for t, k in zip(self.tokens, self.kind)]

    def calculations(self, size):
        """Windows with only the numbers replaced, and the signs between tokens: few words, two numbers, many signs or units."""
        out = {}
        for i in range(len(self.tokens) - size + 1):
            kinds, signs = self.kind[i : i + size], ["", *self.signs[i + 1 : i + size]]
            if sum(k in (None, "name") for k in kinds) < 6 and kinds.count("number") >= 2 and size - kinds.count("number") + sum(x > "" for x in signs) >= max(3, size // 2):
                out[i] = tuple((s, "number" if k == "number" else (t,)) for s, k, t in zip(signs, kinds, self.tokens[i : i + size]))
        return out

    def windows(self, names, size):
        t, least = self.template(names), 0 if names is None else min(3, size - 2)
        return {i: tuple(t[i : i + size]) for i in range(len(t) - size + 1) if sum(isinstance(x, tuple) for x in t[i : i + size]) >= least}


def plain_match(item, doc, window=6, coverage=0.4, run=12, consistent=0.8):
    total = len(item.tokens)
    if not total:
        return False
    size, hits = min(window, total), []
    for names in (True, False, None):
        own = item.windows(names, size)
        if names is None and total >= 4:
            own = {i: w for i, w in own.items() if i not in item.windows(False, size)}
        elif names is not None and total < 4:
            continue
        there = doc.windows(names, size).items()
        if names is None and size < window:
            there = list(there)
            there = [x for x in there if x[1] in own.values()][:1]
        hits += [(at - i, i, size) for at, w in there for i, v in own.items() if v == w]
    if total >= 8:
        longer = min(10, total)
        hits += [(at - i, i, longer) for at, w in doc.calculations(longer).items() for i, v in item.calculations(longer).items() if v == w]
    hits.sort()
    groups = []
    for h in hits:
        if groups and h[0] - groups[-1][-1][0] <= 3:
            groups[-1].append(h)
        else:
            groups.append([h])
    for g in groups:
        place = {}
        for shift, i, size in g:
            for x in range(i, i + size):
                place.setdefault(x, x + shift)
        longest = max(sum(1 for _ in takewhile(lambda y: y in place, count(x))) for x in place)
        slots = [(item.tokens[x], doc.tokens[y]) for x, y in place.items() if item.kind[x]]
        agree = 1.0
        if slots:
            both = Counter(slots)
            agree = sum(max(n for (x, y), n in both.items() if (x, y)[side] == v) for side in (0, 1) for v in {s[side] for s in slots}) / (2 * len(slots))
        if (len(place) >= coverage * total or longest >= run) and agree >= consistent:
            return True
    return False


def test_template_matches_against_brute_force(spark):
    r = random.Random(11)
    d, b = (duckdb.sql(f"select * from '{SF}/{t}.parquet' order by 1").fetchall() for t in ("documents", "benchmark"))
    items = [x[1] for x in b[:25]] + [ITEM, "What is 12 * 7 + 3?", "Compute 45 + 17", "12 kg + 7 kg = 19 kg and 40 km / 5 h = 8 km", "one two", ""]
    names = ["Maria", "Juan", "Olaf", "12", "9", "77"]
    docs = [x[1] for x in d[:60]]
    for _ in range(120):
        w = r.choice(items).split()
        for _ in range(r.randint(0, 6)):
            if w:
                i = r.randrange(len(w))
                if w[i][0].isupper() or w[i].isdigit() or r.random() < 0.3:
                    w[i] = r.choice(names)
                elif r.random() < 0.3:
                    del w[i]
                elif r.random() < 0.3:
                    w = w[i:]
        docs.append("so " * r.randint(0, 3) + " ".join(w) + " and so on")
    spark_items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate(frame(spark, docs), spark_items).collect()}
    plain_items, plain_docs = [Plain(t) for t in items], [Plain(t) for t in docs]
    assert got == {(i, j) for i, t in enumerate(plain_docs) for j, x in enumerate(plain_items) if plain_match(x, t)} and len(got) > 60


def test_calculations_with_other_numbers(spark):
    items = ["12 kg + 7 kg = 19 kg and 40 km / 5 h = 8 km", "3 * 4 + 5 * 6 - 7 * 8 = 9 + 10"]
    docs = ["so 13 kg + 9 kg = 22 kg and 60 km / 4 h = 15 km", "13 kg - 9 kg = 22 kg and 60 km * 4 h = 15 km", "31 * 24 + 15 * 16 - 17 * 28 = 92 + 11!", "13 14 15 16 17 18 19 20 21 22 23", "31 + 24 * 15 + 16 * 17 + 28 = 92 + 11"]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontaminate(frame(spark, docs), b).collect()}
    assert got == {(0, 0, False), (2, 1, False)}


def crowd():
    """Items with a common opening, items that differ in names only, and one template for all values."""
    opening = "Which of the following statements about the subject of this text"
    r = random.Random(3)
    word = lambda: "".join(r.choice("bcdfghjk") + r.choice("aeiou") for _ in range(4))
    endings = [f"{opening} {' '.join(word() for _ in range(5))}" for _ in range(60)]
    named = [f"{word().title()} walked to the market to buy some bread and then went home with {word().title()}" for _ in range(60)]
    same = [f"What do you get when you add {r.randrange(100)} and {r.randrange(100)} to the number of the beast" for _ in range(60)]
    return opening, endings, named, same


def test_frequent_windows_lose_nothing(spark):
    opening, endings, named, same = crowd()
    items = endings + named + same + ["a word that no other item has stands here alone"]
    docs = [opening + " ", *(f"x {t} y" for t in endings[:7]), "x Olga walked to the market to buy some bread and then went home with Pedro", named[3], "What do you get when you add 1234 and 77 to the number of the beast", same[5], opening + " is blue", (opening + " ") * 40]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate(frame(spark, docs), b).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.item_id)
    assert all(got[1 + k] == {k} for k in range(7))  # each found by what it alone has
    assert got.keys() == {*range(1, 8), 8, 9, 10, 11}  # an opening alone says nothing
    assert 63 in got[9] and any(r.doc_id == 9 and r.item_id == 63 and r.verbatim for r in rows)
    assert len(got[8]) == 1 and len(got[10]) == 1  # the first of the items that are one template
    whole = {r.doc_id: r.aligned for r in rows if r.doc_id in range(1, 8)}
    assert set(whole.values()) == {16}  # frequent windows are compared once an item is proposed


def test_items_of_one_template_are_all_named(spark):
    """More items than may propose: each is in a row or in ``stands_for``, also where a document's slots agree only for the most part."""
    text = "First add {} and {} then take away {} and {} before you give back {} and {} to the beast"
    items = [text.format(*range(7 * k, 7 * k + 6)) for k in range(40)] + [text.format(k, k, k, k, k, k) for k in range(20)]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [text.format(901, 902, 903, 904, 905, 906), text.format(901, 901, 903, 904, 905, 906), text.format(5, 5, 5, 5, 5, 5)]
    got = {}
    for r in decontaminate(frame(spark, docs), b).collect():
        got.setdefault(r.doc_id, []).extend([r.item_id, *r.stands_for])
    want = {}
    for d, t in enumerate(docs):
        for i, u in enumerate(items):
            x, y = (re.findall(r"\d+", z) for z in (u, t))
            if decontamination.agreement(x, y) >= 0.8:
                want.setdefault(d, []).append(i)
    assert {d: sorted(v) for d, v in got.items()} == want and len(want[0]) == len(want[1]) == 40 and len(want[2]) == 20


def test_many_items_with_one_opening_are_cheap():
    import time
    import tracemalloc

    ending = lambda i: "".join("bcdfghjklm"[int(c)] + "aeiouaeiou"[int(c)] for c in f"{i:05d}")
    items = [f"Which of the following statements about the subject of this text {ending(i)} {ending(7 * i)} {ending(i + 20_000)} {ending(99_999 - i)}" for i in range(20_000)]
    index = decontamination.Index(list(range(len(items))), pa.array(items), 6, 4, 3)
    doc = pa.array(["Which of the following statements about the subject of this text " * 50])
    tracemalloc.start()
    began = time.perf_counter()
    assert list(decontamination.matches(index, doc, 0.4, 12, 0.8)) == []
    assert time.perf_counter() - began < 2 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert [m[:2] for m in decontamination.matches(index, pa.array(["x", items[777]]), 0.4, 12, 0.8)] == [(1, 777)]


def test_decontamination_of_odd_rows(spark):
    """Repeated documents and items give a row each; very long texts are read to their ends."""
    docs = [ITEM, ITEM, "word " * 400_000 + ITEM]
    b = spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate(frame(spark, docs, [1, 1, 2]), b).collect()) == [1, 1, 1, 1, 2, 2]


# ---- similarity join
def shingle_sets(rows):
    up = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return sets


def brute_groups(rows):
    sets = shingle_sets(rows)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for (i, _), s in zip(rows, sets)}


def near_copies(n, seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcde") for _ in range(4)) for _ in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(3, 80))] for _ in range(4)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("short,part", [(12, 50_000), (2, 50_000), (2, 3)])
def test_groups_match_brute_force(spark, monkeypatch, short, part):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "PART", part)
    texts = near_copies(150, short + part) + ["one two three four five six seven eight nine ten lone pair"] * 3 + ["one two three four five six seven eight nine ten lone pair x"] + ["", None, " \n", "One two", "one TWO", "a b c d e", "same words " * 900, "same words " * 901]
    rows = list(enumerate(texts))
    got = ngram_join.similar_groups(frame(spark, texts)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_groups(rows)
    sets = {i: s for (i, _), s in zip(rows, shingle_sets(rows))}
    every = {i: sum(i != j and bool(s) and 100 * len(s & t) >= 75 * len(s | t) for j, t in sets.items()) for i, s in sets.items()}
    assert all(r.links_verified == every[r.doc_id] if r.links_complete else r.links_verified <= every[r.doc_id] for r in got)
    assert any(r.links_complete and r.links_verified for r in got) or short < 12


@pytest.mark.parametrize("short,block", [(12, 256), (2, 4)])
def test_every_link_of_long_lists_counts(spark, monkeypatch, short, block):
    """Near copies in lists of more than SHORT documents: each row has the number of all its links, those within its group too."""
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(short)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    texts = [" ".join(w if k not in at else f"x{i}" for k, w in enumerate(base)) for i in range(40) for at in [r.sample(range(60), r.randint(0, 2))]] + [" ".join(base)] * 3 + ["lone words of a text here", None]
    got = ngram_join.similar_groups(frame(spark, texts)).collect()
    sets = {i: s for (i, _), s in zip(enumerate(texts), shingle_sets(list(enumerate(texts))))}
    every = {i: sum(i != j and bool(s) and 100 * len(s & t) >= 75 * len(s | t) for j, t in sets.items()) for i, s in sets.items()}
    assert {r.doc_id: r.links_verified for r in got} == every and all(r.links_complete for r in got)


def test_groups_of_odd_tables(spark):
    assert ngram_join.similar_groups(frame(spark, [])).count() == 0
    got = ngram_join.similar_groups(frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "x y"], [5, 5, None, 5])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, None), (5, 5), (5, 5), (5, 5)]
    kept = ngram_join.one_of_each(frame(spark, ["a b c d e f", "a b c d e f", "x", None, "x"], [3, 4, 7, 8, None]))
    assert kept.columns == ["doc_id", "text", "id"] and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "None"]


def test_registered_groups(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = queries.op6_ngram_jaccard_join(spark, SF).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_groups(rows)


def test_components_of_long_chains(spark):
    n = 300
    e = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1002, 1001), (5000, 5000)]
    got = dict(map(tuple, components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(n + 1)) and got[1002] == 1000


def test_suffix_filter_is_a_bound():
    r = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 60, r.integers(0, 40))).astype(np.uint64) for _ in range(2))
        assert ngram_join.suffix_bound(a, b) >= len(set(a.tolist()) & set(b.tolist()))


# ---- suffix index
def brute_repeats(texts, long):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - long + 1):
            w = b[s : s + long]
            if w in seen:
                gone[s : s + long] = b"\1" * long
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_index_against_brute_force():
    r = random.Random(1)
    for _ in range(60):
        long = r.choice([3, 7, 14, 100])
        letters = r.choice([b"ab", b"abc\x00", bytes(range(256))])
        base = [bytes(r.choice(letters) for _ in range(r.randint(long, long + 60))) for _ in range(3)] + [b"are " * 60]
        strings = []
        for _ in range(r.randint(1, 10)):
            b = bytearray(r.choice(base))
            b[r.randrange(len(b))] = r.choice(letters)
            strings.append(bytes(b[r.randrange(len(b) - long + 1) :]))
        ends = lambda x: (np.frombuffer(b"".join(x), np.uint8), np.array([len(s) for s in x]))
        index = RunIndex(*ends(strings), long)
        places = {}
        for j, s in enumerate(strings):
            for o in range(len(s) - long + 1):
                places.setdefault(s[o : o + long], []).append(int(index.starts[j]) + o)
        asked = [bytes(r.choice(letters) for _ in range(20)) + r.choice(base) for _ in range(3)] + strings
        got = {(int(q), int(o)): int(f) for found in index.matches(*ends(asked)) for q, o, f in zip(*found)}
        assert got == {(i, o): min(places[q[o : o + long]]) for i, q in enumerate(asked) for o in range(len(q) - long + 1) if q[o : o + long] in places}
        q = bytes(r.choice(letters) for _ in range(20)) + r.choice(strings)[:20]
        length, place = index.statistics(q)
        for i in range(len(q)):
            assert min(long, length[i]) == min(long, max(max(k for k in range(len(q) - i + 1) if q[i : i + k] in s) for s in strings))
            n = int(length[i])
            assert (index.text[place[i] : place[i] + n] == np.frombuffer(q[i : i + n], np.uint8) + np.uint16(1)).all()


@pytest.mark.parametrize("settings", [{}, {"HOT": 1, "COUNTED": 1}, {"CROWD": 1}, {"FULL": 100, "PIECE": 64, "QUERY": 16}, {"SYMBOLS": 300}, {"CHUNK": 200}])
def test_repeats_match_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    r = random.Random(3)
    parts = ["".join(r.choice("abc dé") for _ in range(r.randint(20, 260))) for _ in range(12)] + ["ha " * 120, "x" * 300]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 5))) for _ in range(80)] + [None, "", "y" * 99, "y" * 100, "y" * 101]
    got = {d.doc_id: tuple(d)[1:5] for d in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 100)


def test_hashes_decide_nothing(spark, monkeypatch):
    """Of segments whose content hashes are all equal only those with equal bytes go."""
    plain = suffix_dedup.sources
    monkeypatch.setattr(suffix_dedup, "sources", lambda a, content, *more: plain(a, content & np.uint64(0), *more))
    r = random.Random(8)
    t = ["".join(r.choices("abcdef", k=90)) for _ in range(6)]
    texts = [t[i] + "shared by all of these texts, and rather long" * 2 + t[j] for i in range(6) for j in (1, 4)]
    got = {d.doc_id: tuple(d)[1:5] for d in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    want = brute_repeats(texts, 100)
    assert all(got[i][1] <= want[i][1] for i in got) and sum(v[1] for v in got.values()) > 0


def test_repeats_of_odd_tables(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    t = "".join(random.Random(5).choices("abcdef", k=150))
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.remove_repeats(frame(spark, [t, t, t, t], [4, 4, 7, None])).collect())
    assert got == [("4", 150), ("4", 150), ("7", 150), ("None", 0)]
    kept = suffix_dedup.remove_repeats(frame(spark, [t, t + "tail"]), keep_text=True).collect()
    assert {r.doc_id: bytes(r.kept) for r in kept} == {0: t.encode(), 1: b"tail"}


def test_registered_repeats(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
    got = {r.doc_id: tuple(r)[1:5] for r in queries.op7_run_length_suffix_dedup(spark, SF).collect()}
    assert [got[i] for i, _ in rows] == brute_repeats([t for _, t in rows], 100)


# ---- words
def test_words_and_tokens_of_odd_texts():
    import pyarrow as pa

    from sievemark.llm._common import flat

    texts = ["", "A b", None, " É, x!!y\tz ", "a b"]
    data, bounds = flat(pa.array(texts, pa.string()))
    h, per = words(data, bounds)
    assert np.diff(per).tolist() == [0, 2, 0, 3, 1]
    h2, per2, start, end = tokens(data, bounds)
    assert np.diff(per2).tolist() == [0, 2, 0, 3, 1] and data.tobytes()[start[3] : end[3]].decode() == "x!!y"
    again, _ = words(*flat(pa.array(["zz a B"], pa.string())))
    assert h[0] == again[1] and h[1] == again[2]


# ---- language models
def test_losses_match_a_plain_model(spark):
    docs = ["a b a b c", "a b b", "c c c a", None, "", "d"]
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 0), (9, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm_score.score_cross_entropy(frame(spark, docs), labels, words=3, smooth=2.0).collect()}
    split = [(d or "").split() for d in docs]
    words3 = {w for w, _ in sorted(Counter(w for s in split for w in s).items(), key=lambda x: -x[1])[:3]}

    def model(rows):
        one, two, starts = Counter(), Counter(), 0
        for s in rows:
            p = "<s>"
            starts += bool(s)
            for w in (w if w in words3 else "?" for w in s):
                one[w] += 1
                two[p, w] += 1
                p = w
        total = sum(one.values())
        return lambda p, w: -math.log((two[p, w] + 2 * (one[w] + 1) / (total + 5)) / ((starts if p == "<s>" else one[p]) + 2))

    target, back = model([split[0], split[1]]), model(split)
    for i, s in enumerate(split):
        pairs = list(zip(["<s>", *(w if w in words3 else "?" for w in s)], [w if w in words3 else "?" for w in s]))
        mean = lambda f: sum(f(*p) for p in pairs) / len(pairs) if pairs else 0.0
        assert got[i].n_tokens == len(s) and got[i].target_loss == pytest.approx(mean(target)) and got[i].background_loss == pytest.approx(mean(back))
        assert got[i].score == pytest.approx(mean(target) - mean(back))
    assert lm_score.score_cross_entropy(frame(spark, []), labels).count() == 0
    assert all(r.score is not None for r in lm_score.score_cross_entropy(frame(spark, docs), labels.where("false")).collect())


def test_models_grow_with_the_corpus(spark):
    """More words than any fixed vocabulary, and more pairs; all are counted one by one."""
    rng = random.Random(5)
    names = [f"w{i}" for i in range(60_000)]
    docs = []
    for _ in range(3):
        rng.shuffle(names)
        docs += [" ".join(names[i : i + 500]) for i in range(0, len(names), 500)]
    docs.append(docs[0])
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(len(docs))], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm_score.score_cross_entropy(frame(spark, docs), labels).collect()}

    def model(rows):
        one, two = Counter(), Counter()
        for r in rows:
            one.update(["<s>", *r])
            two.update(zip(["<s>", *r], r))
        total = sum(map(len, rows))
        return lambda p, w: -math.log((two[p, w] + 20 * (one[w] + 1) / (total + 60_002)) / (one[p] + 20))

    split = [d.split() for d in docs]
    target, back = model(split[::3]), model(split)
    for i, s in enumerate(split):
        t, g = (sum(f(*p) for p in zip(["<s>", *s], s)) / len(s) for f in (target, back))
        assert (got[i].target_loss, got[i].background_loss, got[i].score) == pytest.approx((t, g, t - g))


# ---- toxicity
def test_segments_match_quadratic_search():
    r = random.Random(2)
    for _ in range(300):
        s = [r.choice([-3, -1, -0.5, 1, 2, 4]) for _ in range(r.randint(0, 30))]

        def best(lo, hi):
            found = [(sum(s[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            top = max(found, default=(0, 0, 0, 0))
            if top[0] <= 0:
                return []
            _, _, a, b = top
            return best(lo, a) + [(a, b, top[0])] + best(b, hi)

        got = toxicity.maximal_segments(s)
        assert sorted(round(x[2], 6) for x in got) == sorted(round(x[2], 6) for x in best(0, len(s)))


def test_shards_are_split_where_many_chunks_ask(spark, monkeypatch):
    """Levels of parts give the same totals, and no group of questions has more than a few rows."""
    monkeypatch.setattr(lm_score, "SHARDS", 4)
    r = random.Random(12)
    docs = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(80)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    one, tree = ({r.doc_id: r for r in lm_score.score_cross_entropy(frame(spark, docs).repartition(40), labels, fan=fan).collect()} for fan in (2048, 3))
    assert one == tree and len(one) == 80
    parts = lm_score.cut(frame(spark, docs).select(F.col("doc_id").alias("id"), "text").repartition(40))
    chunks = parts.count()
    assert chunks >= 30
    asks = lm_score.asked(parts, 4, False).withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(-(-chunks // 3))))
    most = [asks.groupBy(*by).count().agg(F.max("count")).first()[0] for by in (("shard",), ("shard", "part"))]
    assert most[0] == chunks and most[1] < 12  # about three, dealt by hash


def toxic_table(spark, n=400):
    r = random.Random(4)
    w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        t = [r.choice(w) for _ in range(40)]
        if bad:
            t[10:12] = ["vilest", "rubbish!"]
        rows.append((i, " ".join(t), int(bad)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (None, "vilest rubbish", "x")], "doc_id long, text string, toxic string")
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(9000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), rows


def test_toxicity_held_out(spark):
    docs, labels, rows = toxic_table(spark)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].predicted == y and 0 <= got[i].score <= 1
    assert got[9000].predicted == got[9001].predicted == 0 and got[None].predicted == 1 and not got[None].held_out
    left = toxicity.without_toxic(docs, labels)
    assert left.schema == docs.schema and left.count() == sum(1 - y for *_, y in rows) + 2


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels, _ = toxic_table(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score_toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels(spark):
    docs, labels, _ = toxic_table(spark, 20)
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels.where("false")).collect()} == {0}
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.8 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.03


def test_segment_statistics_calibrate():
    """lambda solves its equation, and chance segments are about as many as E = K n exp(-lambda S) says."""
    r = np.random.default_rng(6)
    scores, share, drift = np.array([1.0, 2.0, 3.5]), np.array([0.01, 0.004, 0.001]), -0.05
    lam = toxicity.decay(share, scores, drift)
    assert (share * np.exp(lam * scores)).sum() + (1 - share.sum()) * math.exp(lam * drift) == pytest.approx(1)
    n, tops = 400, []
    for _ in range(4000):
        x = r.choice(np.array([drift, *scores]), n, p=[1 - share.sum(), *share])
        at = np.flatnonzero(x > 0)
        tops.append(max((s for *_, s in toxicity.passages(at, x[at], drift)), default=0.0))
    tops = np.array(tops)
    k = (tops >= 2.0).mean() / n * math.exp(lam * 2.0)
    for s in (3.0, 4.0, 5.0):
        assert (tops >= s).mean() == pytest.approx(k * n * math.exp(-lam * s), rel=0.6)


def test_lambda_is_solved_or_an_error():
    scores = np.array([1.0, 2.0, 3.5])
    for n in ([0, 0, 0], [3, 0, 0], [400, 20, 9]):
        share = toxicity.clean_share(np.array(n, float), np.array([0.3, 0.2, 0.01]), 50_000.0)
        lam = toxicity.decay(share, scores, -0.05)
        assert (share * np.exp(lam * scores)).sum() + (1 - share.sum()) * math.exp(-0.05 * lam) == pytest.approx(1, abs=1e-9)
    for share, drift in (([0.0, 0.0, 0.0], -0.05), ([0.3, 0.1, 0.1], -0.05), ([0.01, 0.0, 0.0], 0.0)):
        with pytest.raises(ValueError):
            toxicity.decay(np.array(share), scores, drift)
    assert toxicity.clean_share(np.array([9e9, 9e9]), np.array([1.0, 1.0]), 10.0).sum() == pytest.approx(0.5)


def test_toxicity_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert 0.01 < model.decay < 20 and 0 < model.k < 1e6
    got = [{r.doc_id: r.score for r in toxicity.score_toxicity(d, labels).select("doc_id", "score").collect()} for d in (docs, docs.repartition(7, "doc_id"), docs.repartition(3, "text"))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 1000


def test_toxicity_where_clean_texts_hold_the_words_as_well(spark):
    docs, labels, rows = toxic_table(spark)
    more = spark.createDataFrame([(20_000 + i, "vilest rubbish! " * 30 + "".join(f"u{i}x{j} " for j in range(20)), "x") for i in range(12)], docs.schema)
    flags = spark.createDataFrame([(20_000 + i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs.unionByName(more), labels.unionByName(flags))
    assert got.count() == len(rows) + 3 + 12 and all(0 <= r.score <= 1 for r in got.collect())


def test_toxicity_of_very_long_texts(spark):
    docs, labels, rows = toxic_table(spark)
    long = spark.createDataFrame([(9100, rows[1][1] + " plain words" * 300_000, "x"), (9101, "plain words " * 300_000 + "vilest rubbish! vilest rubbish!", "x")], docs.schema)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.unionByName(long), labels).where("doc_id >= 9100").collect()}
    assert got[9100].predicted == 0 and got[9101].n_passages == 1 and 0 <= got[9101].score <= 1


# ---- nearest neighbours
def test_queries_stay_small_in_large_trees():
    """Half of 85,000 nodes for 600 queries (10,000 take as much at a time): blocks, not whole batches, are held."""
    import resource

    r = np.random.default_rng(1)
    leaves = 84_000
    children = [list(range(1, 1001)), *([] for _ in range(1000))]
    for i in range(1, 1001):
        children[i] = list(range(len(children), len(children) + leaves // 1000))
        children += [[] for _ in range(leaves // 1000)]
    tree = ann_tree.Tree(r.normal(size=(len(children), 17)), children, 9.0)
    groups = ann_tree.grouped(tree, dict.fromkeys(tree.in_order(), 200))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(600)), pa.array(list(r.normal(size=(600, 16))))], ["id", "v"])
    asked, size = np.zeros(600, np.int64), 0
    for out in ann_tree.asks(tree, groups, [batch], leaves // 2, 21):
        size = max(size, out.nbytes)
        for key, ids, more in zip(*(out.column(c).to_pylist() for c in (0, 2, 4))):
            seen = np.unpackbits(np.frombuffer(more, np.uint8).reshape(len(ids) // 8, -1), axis=1)
            if key in groups.first:  # the other groups of a bucket get the same
                np.add.at(asked, np.frombuffer(ids, np.int64), seen.sum(axis=1))
    assert (asked == leaves // 2).all()
    assert size < 40e6 and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 < 500e6


def truth(rows, q, k):
    score = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q)
    return [i for _, i in score[:k]]


def test_nearest_neighbours(spark):
    r = np.random.default_rng(0)
    rows = {i: r.normal(size=8).round(3).tolist() for i in range(600)}
    for i in range(100, 130):
        rows[i] = rows[20]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [1.0]), (None, [1.0] * 8), (2006, [float("inf")] * 8)]
    df = spark.createDataFrame([*rows.items(), *odd], "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = {}
    for x in ann_tree.nearest(df, lambda i: i % 20 == 0, leaf_rows=30, branch=4).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert set(got) == {i for i in rows if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21)) and found == [f for _, f in sorted(((-f[2], f[1]), f) for f in found)]
        assert all(s == pytest.approx(sum(a * b for a, b in zip(rows[q], rows[v])), abs=1e-12) for _, v, s in found)
        hit += len({x[1] for x in found} & set(truth(rows, q, 20)))
    assert hit / (20 * len(got)) >= 0.9
    few = ann_tree.nearest(df.where("vec_id < 5"), lambda i: i % 20 == 0).collect()
    assert [x.vec_id for x in sorted(few, key=lambda x: x["rank"])] == truth({i: rows[i] for i in range(5)}, 0, 20)
    assert ann_tree.nearest(df.where("vec_id >= 2000"), lambda i: i % 20 == 0).count() == 0
    assert ann_tree.nearest(df.where("false"), lambda i: i % 20 == 0).count() == 0


def test_small_leaves_are_left_for_more(spark):
    """Clusters of fewer vectors than are asked for, each in a leaf of its own."""
    r = np.random.default_rng(3)
    rows = {i: (np.eye(16)[i % 16] * 5 + r.normal(size=16) * 0.01).tolist() for i in range(160)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = ann_tree.nearest(df, lambda i: i % 20 == 0, k=20, recall=0.01, leaf_rows=12, branch=16).groupBy("query_id").count().collect()
    assert {x["count"] for x in got} == {20} and len(got) == 8


def test_recall_on_the_registered_table(spark):
    sf = "/root/testdata/sf0.1"
    ids, x = zip(*duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by 1").fetchall())
    x, at = np.array(x, np.float64), {v: i for i, v in enumerate(ids)}
    hit = n = 0
    found = {}
    for r in queries.op10_kmeans_tree_search(spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == {i for i in ids if i % 20 == 0}
    for q, have in found.items():
        s = x @ x[at[q]]
        s[at[q]] = -np.inf
        hit += len(have & {ids[i] for i in np.argsort(-s, kind="stable")[:20]})
        n += 20
    assert hit / n >= 0.9


def test_large_leaves_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "GROUP", 50)
    rows = {i: [1.0, 0.0] if i % 3 else [float(i % 7), 1.0] for i in range(400)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = {}
    for x in ann_tree.nearest(df, lambda i: i % 20 == 0, k=5, leaf_rows=40, branch=3, recall=1.0).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id))
    exact = sum([v for _, v in sorted(f)] == truth(rows, q, 5) for q, f in got.items())
    assert len(got) == 20 and exact >= 18


# ---- pipeline
def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, clashing and further columns, empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, row int, row_ int, spans string, key int"
    docs = [(1, "a b c d e f", "en", "s", 11, 1, 1, 1, "x", 1), (1, "a b c d e f", "en", "s", 11, 1, 1, 1, "x", 1), (None, None, None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, 1, 1, 1, "x", 1), (2, "password = hunter2hunter2", "en", "s", 25, 1, 1, 1, "x", 1), (4, "long " * 100_000, "en", None, 500_000, 1, 1, 1, "x", 1)]
    for name, rows in (("full", docs), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, None, None), (1, None, 0), (1, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, None), (1, ""), (2, None)] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, folder)
            assert out.columns == [c.split()[0] for c in schema.split(", ")]
        assert sorted(str(r.doc_id) for r in out.collect()) == (["1", "2", "3", "4", "None"] if rows else [])
        assert not rows or {r.text for r in out.collect() if r.doc_id == 2} == {"<assign>"}
        assert {str(r.doc_id) for r in corpus_pipeline.run(spark, folder).collect()} == ({"1", "2", "3", "4", "None"} if rows else set())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = {r.doc_id: r for r in docs.collect()}
    keep = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("predicted = 0").collect()}
    left = sorted((i, rows[i].text) for i in keep)
    keep = {i for i, _, c in brute_groups(left) if i == c}
    bad = {r.doc_id for r in decontaminate(docs, benchmark).collect()}
    keep -= bad
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == keep
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == keep


def test_groups_of_very_long_texts(spark):
    """Texts of a megabyte: a near copy links, half of one doesn't, and what is changed at the end counts."""
    r = random.Random(11)
    words_ = [f"{r.choice('abcdefgh')}{r.randrange(50_000)}" for _ in range(150_000)]
    near = [w if i % 60 else "other" for i, w in enumerate(words_)]  # a shingle in twelve changes
    far = words_[:100_000] + [w[::-1] for w in words_[100_000:]]
    texts = [" ".join(words_), "short one of six words here", " ".join(near), " ".join(words_[:75_000]), " ".join(far), " ".join(words_), "short one of six words here"]
    got = ngram_join.similar_groups(frame(spark, texts)).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == brute_groups(list(enumerate(texts)))
    assert {x.doc_id: x.component_id for x in got} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 0, 6: 1}


def test_repeats_of_very_long_texts(spark):
    """A text larger than a chunk: passages repeated at its very end and in other texts are found, and nothing else."""
    r = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzäö 0123456789"
    noise = lambda n: "".join(r.choices(letters, k=n))
    p, q = noise(5_000), noise(700)
    head = "".join(r.choices("abcdefgh ", k=99))  # a byte a letter, so a byte too short
    first, second, third = head + noise(1_500_000) + "<" + p + ">", noise(1_400_000), "[" + p + "]" + noise(400) + "{" + q + "}"
    texts = [first + second + third, "(" + q + ")", "short", head + "!", "«" + first[-301:-1] + "»"]
    assert len(texts[0].encode()) > suffix_dedup.CHUNK
    kept = [first + second + "[]" + third[5_002 : 5_402] + "{" + q + "}", "()", "short", head + "!", "«»"]
    got = {d.doc_id: d for d in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    for i, (t, k) in enumerate(zip(texts, kept)):
        n = len(t.encode())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n, n - len(k.encode()), int(t != k), hashlib.sha256(k.encode()).hexdigest())
