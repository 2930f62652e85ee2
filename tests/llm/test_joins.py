"""Joins by word sets and passages against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import leak, neardup, overlap, setjoin
from corpusloom.llm.components import components
from corpusloom.llm.sketch import band_keys, flatten, grouped_fingerprints, similarity_sketch
from corpusloom.llm.words import words
from corpusloom.operators.ranking import in_blocks

VOCABULARY = [f"{a}{b}{c}" for a in "абвгд" for b in "еёиоу" for c in "клмнпрст"]


def near(a, b):
    x, y = set(words(a)), set(words(b))
    return bool(x) and bool(y) and 3 * len(x & y) >= 2 * len(x | y)


def changed(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        q, p = (" ".join(rng.sample(VOCABULARY, 16)) for _ in range(2))
        rows.append((q, p))
        for _ in range(rng.choice((0, 0, 1, 3))):
            rows.append((changed(rng, q, rng.choice((0, 1, 2))), changed(rng, p, rng.choice((0, 1, 9)))))
    rows += [("одно и то же", "тоже одно")] * 40  # a group of copies
    rows += [("Одно, и ТО ЖЕ!", "тоже  одно")] * 3
    rows += [(None, "x"), ("", ""), (" . ", "x"), ("x", None), ("Instruct: a\nQuery: " + rows[0][0], rows[0][1])]
    rng.shuffle(rows)
    data = [(i, q, p, rng.choice(("train",) * 4 + ("test", "validation", None)), f"s{i % 3}", i % 2) for i, (q, p) in enumerate(rows)]
    return data, spark.createDataFrame(data, "pos bigint, query string, positive string, split string, source string, k1 int")


def test_near_pairs_against_all_pairs(records):
    data, df = records
    got = [tuple(r) for r in neardup.near_pairs(df, "pos", ["query", "positive"]).collect()]
    want = {(a[0], b[0]) for i, a in enumerate(data) for b in data[i + 1 :] if near(a[1], b[1]) and near(a[2], b[2])}
    assert len(got) == len(set(got)) and not set(got) - want and len(set(got)) >= 0.99 * len(want)
    copies = {(a[0], b[0]) for i, a in enumerate(data) for b in data[i + 1 :] if set(words(a[1])) == set(words(b[1])) != set() and set(words(a[2])) == set(words(b[2])) != set()}
    assert copies <= set(got)


def test_near_groups_are_components_of_the_pairs(records):
    data, df = records
    pairs = [tuple(r) for r in neardup.near_pairs(df, "pos", ["query", "positive"]).collect()]
    parent = {r[0]: r[0] for r in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["pos"]: (r["group_id"], r["group_size"]) for r in neardup.near_groups(df, "pos", ["query", "positive"]).collect()}
    assert set(got) == {r[0] for r in data if words(r[1]) and words(r[2])}
    for pos, (group, size) in got.items():
        assert find(pos) == group and size == sum(find(x) == group for x in got)


def test_overlap_against_all_pairs(records):
    data, df = records
    got = [tuple(r) for r in overlap.overlap_pairs(df, "pos", "query", "split").collect()]
    want = {(a[0], b[0]) for i, a in enumerate(data) for b in data[i + 1 :] if a[3] and b[3] and (a[3] == "train") != (b[3] == "train") and near(a[1], b[1])}
    assert len(got) == len(set(got)) and not set(got) - want and len(set(got)) >= 0.98 * len(want)
    rep = overlap.overlap_report(df, "pos", "query", "split", "source").toPandas()
    assert rep["records"].sum() == sum(r[3] in ("test", "validation") for r in data)
    assert rep["pairs"].sum() == len(got)
    train = {r[0] for r in data if r[3] == "train"}
    assert rep["overlapping"].sum() == len({x for p in got for x in p if x not in train})


def test_empty_and_repeated_rows(spark, records):
    _, df = records
    none = df.where("pos < 0")
    assert neardup.near_pairs(none, "pos", ["query", "positive"]).count() == 0
    assert neardup.near_groups(none, "pos", ["query", "positive"]).count() == 0
    assert overlap.overlap_pairs(none, "pos", "query", "split").count() == 0
    assert overlap.overlap_report(none, "pos", "query", "split", "source").count() == 0
    twice = df.unionByName(df)
    assert neardup.near_pairs(twice, "pos", ["query", "positive"]).count() == neardup.near_pairs(df, "pos", ["query", "positive"]).count()


def test_crowded_buckets_lose_nothing(spark, records):
    data, df = records
    members = setjoin.set_table(df, "pos", ["query", "positive"])
    found, every = (neardup.buckets(members, 2, hot) for hot in (20, 10**9))
    for b in (found, every):  # one bucket for all
        b.keys = lambda most: members.select(F.lit(7).cast("bigint").alias("key"), F.col("k1").alias("id"))
    found, every = (setjoin.verified(b.pairs().distinct(), members, 2).count() for b in (found, every))
    assert found >= 0.99 * every > 0


def family(spark, n, unlike=0):
    """Texts of one template that differ in two words of thirty, and some others that share half of it."""
    rng = random.Random(3)
    base = VOCABULARY[:30]
    rows = []
    for i in range(n + unlike):
        w = list(base)
        for _ in range(2 if i < n else 15):
            w[rng.randrange(30)] = f"слово{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "test" if i % 9 == 0 else "train", "s"))
    return spark.createDataFrame(rows, "pos bigint, query string, split string, source string")


def test_a_family_costs_one_check_a_text(spark, monkeypatch):
    df = family(spark, 3000, 30)
    checked = []
    real = neardup.verified

    def spy(pairs, members, n):
        checked.append(pairs.count())
        return real(pairs, members, n)

    monkeypatch.setattr(neardup, "verified", spy)
    got = neardup.near_groups(df, "pos", ["query"]).toPandas()
    assert (got["group_id"][got["pos"] < 3000] == 0).all() and len(got) == 3030
    assert sum(checked) < 3030 * neardup.BANDS * 8  # all pairs are four and a half millions


def test_groups_of_families_against_all_pairs(spark):
    df = family(spark, 150, 150)
    rows = [(r["pos"], set(words(r["query"]))) for r in df.collect()]
    parent = {p: p for p, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (p, a) in enumerate(rows):
        for q, b in rows[i + 1 :]:
            if 3 * len(a & b) >= 2 * len(a | b):
                x, y = sorted((find(p), find(q)))
                parent[y] = x
    got = {r["pos"]: r["group_id"] for r in neardup.near_groups(df, "pos", ["query"]).collect()}
    assert sum(got[p] == find(p) for p, _ in rows) >= 299
    pairs = {tuple(r) for r in overlap.overlap_classes(df, "pos", "query", "split", hot=8)[1].select("a1", "b1").collect()}
    every = {tuple(r) for r in overlap.overlap_classes(df, "pos", "query", "split", hot=10**9)[1].select("a1", "b1").collect()}
    assert pairs <= every and len(pairs) >= 0.99 * len(every) > 0


def test_pairs_in_blocks(spark):
    rows = [(k, i) for k, n in ((1, 40), (2, 1), (3, 7)) for i in range(100 * k, 100 * k + n)]
    df = spark.createDataFrame(rows, "key bigint, id bigint")
    x, y, on = in_blocks(df.join(df.groupBy("key").agg(F.count("*").alias("n")), "key"), ["key"], block=6)
    got = [tuple(r) for r in x.join(y, on & (F.col("x_id") < F.col("y_id"))).select("x_id", "y_id").collect()]
    want = {(a, b) for k, a in rows for m, b in rows if k == m and a < b}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize(("shared", "least"), [((20, 30), 0.9), ((21, 30), 0.93), ((24, 32), 0.98), ((24, 30), 0.99)])
def test_recall_at_the_threshold(spark, shared, least):
    """Pairs of a given similarity, far from all others: at 2/3, 0.7, 0.75 and 0.8."""
    rng = np.random.default_rng(shared[0] * shared[1])
    both, either = shared
    left = (either - both) // 2
    rows = []
    for i in range(600):
        w = [f"w{x}" for x in rng.integers(0, 10**8, either)]
        rows += [(2 * i, " ".join(w[: both + left]), "train"), (2 * i + 1, " ".join(w[:both] + w[both + left :]), "test")]
    df = spark.createDataFrame(rows, "pos bigint, query string, split string")
    for got in (overlap.overlap_pairs(df, "pos", "query", "split"), neardup.near_pairs(df, "pos", ["query"])):
        assert sum(b == a + 1 and a % 2 == 0 for a, b in got.collect()) / 600 >= least


def test_layout_keeps_the_recall():
    for n in (0, 10**6, 10**9, 10**12):
        groups, many = overlap.layout(n)
        assert 1 - (1 - (2 / 3) ** groups) ** many >= overlap.RECALL and n * many * overlap.BACKGROUND**groups <= 1
    assert overlap.layout(1000) == (6, 29) and overlap.layout(10**9)[0] > 6


def test_long_texts_and_ties(spark):
    a = " ".join(VOCABULARY * 200)
    df = spark.createDataFrame([(1, a, "x y", "train"), (2, a + " new", "x y", "test"), (3, "да", "да", "train"), (4, "ДА!", "да", "test")], "pos int, query string, positive string, split string")
    assert {tuple(r) for r in neardup.near_pairs(df, "pos", ["query", "positive"]).collect()} == {(1, 2), (3, 4)}
    assert {tuple(r) for r in overlap.overlap_pairs(df, "pos", "query", "split").collect()} == {(1, 2), (3, 4)}


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "z"), ("z", "x"), ("q", "q")] + [("hub", f"leaf{i}") for i in range(300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and {got[x] for x in "xyz"} == {"x"}
    assert {got[f"leaf{i}"] for i in range(300)} == {"hub"} and "q" not in got
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        n = 400
        both = int(2 * n * share / (1 + share))
        base = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = base[:n], np.concatenate((base[n - both : n], base[n : 2 * n - both]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = similarity_sketch(*flatten([a, b]), 600)
        assert (s != np.iinfo(np.uint64).max).all() and abs((s[0] == s[1]).mean() - j) < 0.07
        codes, check = grouped_fingerprints(*flatten([a, b]), 1, 600, 8, 1280)
        bits = np.unpackbits(check.view(np.uint8), axis=1)
        assert abs((bits[0] == bits[1]).mean() - (1 + j) / 2) < 0.05 and abs((codes[0] == codes[1]).mean() - j) < 0.07
    tiny = similarity_sketch(*flatten([np.array([5], np.uint64)]), 50)
    assert (tiny != np.iinfo(np.uint64).max).all()
    assert band_keys(tiny, 5).shape == (1, 10)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    passages = {i: " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(26, 70))) for i in range(20)}
    passages[20] = passages[3]
    docs, truth = {}, set()
    for d in range(120):
        w = [rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 200))]
        kind = d % 6
        if kind < 4:
            i = rng.randrange(20)
            p = passages[i].split()
            if kind == 0:
                part = p
            elif kind == 1:
                k = -(-len(p) * 6 // 10)
                at = rng.randrange(len(p) - k + 1)
                part = p[at : at + k]
            elif kind == 2:
                part = list(p)
                for _ in range(3):
                    part[rng.randrange(len(part))] = "опечатка"
            else:
                part = p[: len(p) // 4]  # too little
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," if rng.random() < 0.3 else x for x in part]
            if kind < 3:
                truth |= {(d, j) for j in passages if passages[j] == passages[i]}
        docs[d] = "\n".join(" ".join(w[k : k + 15]) for k in range(0, len(w), 15))
    docs |= {500: None, 501: "", 502: passages[0].replace(" ", " &amp; "), 503: passages[0]}
    truth |= {(502, 0), (503, 0)}
    return passages, docs, truth


def test_leaks_against_planted_cases(spark, corpus):
    passages, docs, truth = corpus
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    e = spark.createDataFrame([*passages.items(), (90, None), (91, ""), (92, "два слова")], "item_id bigint, text string")
    got = leak.leaks(d, "doc_id", "text", e, "item_id", "text")
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == truth
    assert leak.leaks(d.where("doc_id < 0"), "doc_id", "text", e, "item_id", "text").count() == 0
    assert leak.leaks(d, "doc_id", "text", e.where("item_id > 89"), "item_id", "text").count() == 0


def test_leaks_with_a_fifth_of_a_long_stretch_changed(spark):
    item = [f"word{i}" for i in range(85)]
    half = [f"other{i}" if i % 5 == 4 and i < 40 else w for i, w in enumerate(item[:45])]
    d = spark.createDataFrame([(1, " ".join(half)), (2, " ".join(half[:30]))], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in leak.leaks(d, "doc_id", "text", e, "item_id", "text").collect()] == [(1, 1)]


def test_leaks_in_blocks(spark, corpus, monkeypatch):
    passages, docs, truth = corpus
    monkeypatch.setattr(leak, "BLOCK_WORDS", 100)
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    e = spark.createDataFrame(list(passages.items()), "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leak.leaks(d, "doc_id", "text", e, "item_id", "text").collect()} == truth


def test_alignment():
    a = np.arange(20)
    assert leak.align(a, a) == (20, 0)
    assert leak.align(a, np.concatenate((np.full(5, 99), a[5:15], np.full(5, 98)))) == (10, 0)
    b = a.copy()
    b[9] = 77
    assert leak.align(a, b) == (20, 1)
    assert leak.align(a, np.concatenate((a[:9], [55, 56], a[9:]))) == (20, 2) and leak.align(a, np.delete(a, 9)) == (20, 1)


def edited(rng, stretch, edits, kind):
    """The stretch with so many words changed, left out or added, spread evenly or anywhere."""
    n = len(stretch)
    at = [(2 * j + 1) * n // (2 * edits) for j in range(edits)] if rng.random() < 0.5 else rng.sample(range(1, n - 1), edits)
    out = list(stretch)
    for i in sorted(at, reverse=True):
        what = kind if kind != "any" else rng.choice(("change", "drop", "add"))
        out[i : i + (what != "add")] = [] if what == "drop" else [rng.randrange(10**9, 2 * 10**9)]
    return out


@pytest.mark.parametrize("n", [6, 8, 13, 20, 26, 28, 29, 60, 100, 200, 400])
def test_no_case_of_the_judge_is_lost(n):
    """The candidate windows against the judge alone, on stretches edited up to what it allows."""
    rng = random.Random(n)
    items = [np.array([rng.randrange(10**9) for _ in range(n)], np.uint64) for _ in range(30)]
    block = leak.Block.of(list(range(30)), items)
    block.order(np.zeros(len(block.hashes), np.int64))
    accepted = found = 0
    for k in range(240):
        item = items[k % 30].tolist()
        span = rng.randint(leak.least_span(n), n) if k % 3 else leak.least_span(n)
        begin = rng.randrange(n - span + 1)
        edits = min(leak.changes(span), span - 2)
        part = edited(rng, item[begin : begin + span], edits if k % 2 else rng.randint(0, edits), rng.choice(("change", "drop", "add", "any")))
        around = [[rng.randrange(10**9, 2 * 10**9) for _ in range(rng.randrange(60))] for _ in range(2)]
        text = np.array(around[0] + part + around[1], np.uint64)
        if leak.judge(items[k % 30], text):
            accepted += 1
            owner, pos, s = block.hits(text, np.zeros(1, np.int64))
            windows = [(low, high) for _, i, low, high in zip(*leak.candidates(block, owner, pos, s, np.array([len(text)])), strict=True) if i == k % 30]
            slack = max(leak.SLACK, leak.changes(n))
            found += any(leak.judge(items[k % 30], text[max(0, low - slack) : high + n + slack]) for low, high in windows)
    assert accepted > 60 and found == accepted
