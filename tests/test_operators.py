from __future__ import annotations

import difflib
import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import arrow
from corpusloom.functions import text as X
from corpusloom.operators import aggregates as A
from corpusloom.operators import batches as B
from corpusloom.operators import dedup, filters
from corpusloom.operators import governance as G
from corpusloom.operators import matching as M
from corpusloom.operators import reshape as C
from corpusloom.operators import sampling as S
from corpusloom.operators import sets as U
from corpusloom.operators import vectors as V
from corpusloom.operators.ranking import cumulated, numbered
from corpusloom.plans import catalog


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, f"g{i % 7}" if i % 11 else None, float(i * 37 % 101), f"text {i % 40}") for i in range(500)]
    return spark.createDataFrame(rows, "id bigint, g string, x double, t string").repartition(5)


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_numbered_is_a_permutation_per_group(items):
    r = numbered(items.withColumn("b", F.col("id") % 5), ["g"], "b", ["x", "id"], "n").toPandas()
    for _, p in r.groupby("g", dropna=False):
        assert sorted(p["n"]) == list(range(len(p)))
        p = p.sort_values("n")
        assert list(zip(p["b"], p["x"], p["id"], strict=True)) == sorted(zip(p["b"], p["x"], p["id"], strict=True))


def test_cumulated_sums_what_comes_before(items):
    r = cumulated(items.withColumn("b", F.col("id") % 5), ["g"], "b", ["id"], "x", "before").toPandas()
    for _, p in r.groupby("g", dropna=False):
        p = p.sort_values(["b", "id"])
        assert np.allclose(p["before"], np.cumsum(p["x"]) - p["x"])


def test_sample_and_complement_are_disjoint_and_complete(items):
    a, b = ids(S.sample(items, "id", 120, 3)), ids(S.complement(items, "id", 120, 3))
    assert len(a) == 120 and not set(a) & set(b) and sorted(a + b) == list(range(500))
    assert a == ids(S.sample(items.repartition(13), "id", 120, 3))
    assert a != ids(S.sample(items, "id", 120, 4))


def test_exact_sample_fails_when_short(items):
    with pytest.raises(Exception, match="fewer than 501"):
        S.sample(items, "id", 501, 3, exact=True).collect()


def test_repeated_uses_all_before_any_twice(items):
    few = items.where("id < 10")
    r = S.repeated(few, "id", 25, 1).toPandas()
    assert sorted(r["draw"]) == list(range(25))
    assert r["id"].value_counts().max() == 3 and r["id"].value_counts().min() == 2
    assert S.repeated(items.where("id < 0"), "id", 5, 1).count() == 0
    assert S.with_replacement(few, "id", 40, 1).count() == 40
    assert S.with_replacement(few.where("id < 0"), "id", 40, 1).count() == 0


@pytest.mark.parametrize(("n", "held"), [(1, 0), (2, 1), (5, 1), (15, 2), (25, 2), (35, 4)])
def test_stratified_split_rounds_half_even(spark, n, held):
    df = spark.range(n).withColumn("s", F.lit(None).cast("string"))
    r = S.stratified_split(df, "id", ["s"], 0.1, 5).groupBy("part").count().collect()
    assert {x["part"]: x["count"] for x in r}.get("validation", 0) == held


def test_quotas(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("z", 0.0), ("n", None)], "g string, w double")
    assert {r["g"]: r["quota"] for r in A.apportion(w, "g", "w", 10).collect()} == {"a": 4, "b": 3, "c": 3, "z": 0, "n": 0}
    assert {r["g"]: r["quota"] for r in S.even_quota(w, "g", 7).collect()} == {"a": 2, "b": 2, "c": 1, "n": 1, "z": 1}


def passes(targets, pools):
    """Quotas clipped to the pools and then filled pass by pass, a row a group with room, most room first."""
    out = {g: min(t, pools[g]) for g, t in targets.items()}
    total = min(sum(targets.values()), sum(pools.values()))
    while sum(out.values()) < total:
        for g in sorted(out, key=lambda g: (out[g] - pools[g], g)):
            if out[g] < pools[g] and sum(out.values()) < total:
                out[g] += 1
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 50), st.integers(0, 60)), min_size=1))
def test_cap_and_redistribute_against_passes(spark, groups):
    df = spark.createDataFrame([(g, t, p) for g, (t, p) in groups.items()], "g string, t int, p int")
    got = {r["g"]: r["quota"] for r in A.cap_and_redistribute(df, "g", "t", "p").collect()}
    assert got == passes({g: t for g, (t, _) in groups.items()}, {g: p for g, (_, p) in groups.items()})


def test_cap_and_redistribute_gives_levels(spark):
    df = spark.createDataFrame([("a", 20, 100), ("b", 20, 50), ("c", 20, 0), ("n", None, None)], "g string, t int, p int")
    assert {r["g"]: r["quota"] for r in A.cap_and_redistribute(df, "g", "t", "p").collect()} == {"a": 30, "b": 30, "c": 0, "n": 0}
    assert A.cap_and_redistribute(df.where("g = 'x'"), "g", "t", "p").count() == 0


def test_coverage(spark):
    df = spark.createDataFrame([(i, [f"l{i % 3}", f"m{i % 2}"]) for i in range(60)], "id int, labels array<string>")
    cover = S.coverage_support(df, "id", "labels", 2, 1).toPandas()
    assert all(sum(lab in x for x in cover["labels"]) >= 2 for lab in ("l0", "l1", "l2", "m0", "m1"))


def test_coverage_looks_at_all_rows(spark):
    order = sorted(range(102_000), key=lambda i: (hashlib.md5(f"1|{i}".encode()).hexdigest(), i))
    last = set(order[-3:])
    df = spark.range(102_000).select(F.col("id"), F.when(F.col("id").isin(*last), F.array(F.lit("rare"))).otherwise(F.array(F.lit("common"))).alias("labels"))
    assert set(ids(S.coverage_support(df, "id", "labels", 3, 1))) == last | set(order[:3])
    assert last <= set(ids(S.need_selection(df, "id", "labels", {"rare": 3, "common": 3}, 6, 1)))


@pytest.mark.parametrize("over", [1.0, 1.5])
def test_need_selection_against_a_loop(spark, over):
    rows = [(i, [f"l{i % 5}", f"m{i * i % 7}", "all"][: 1 + i % 3]) for i in range(120)] + [(200, None), (201, ["other"])]
    targets = {"l0": 9, "l1": 3, "m1": 8, "m2": 90, "all": 6}
    weights = {"l0": 1.0, "m2": 0.5}
    left = sorted((tuple(sorted(set(x or ()) & set(targets))), hashlib.md5(f"1|{i}".encode()).hexdigest(), i) for i, x in rows)
    count, want = dict.fromkeys(targets, 0), []
    full = {x: max(1, round(t * over)) for x, t in targets.items()}
    while True:
        free = [r for r in left if all(count[x] < full[x] for x in r[0])]
        need = lambda r: sum(max(0, targets[x] - count[x]) for x in r[0])  # noqa: E731, B023
        best = max(free, key=lambda r: (need(r), len(r[0]), sum(weights.get(x, 0) for x in r[0])), default=None)
        if best is None or need(best) <= 0:
            break
        want.append(best)
        left.remove(best)
        count = {x: n + (x in best[0]) for x, n in count.items()}
    df = spark.createDataFrame(rows, "id int, labels array<string>")
    assert ids(S.need_selection(df, "id", "labels", targets, len(want), 1, over, weights)) == sorted(r[2] for r in want)
    more = S.need_selection(df, "id", "labels", targets, len(want) + 30, 1, over, weights).toPandas()
    assert {r[2] for r in want} <= set(more["id"]) and len(more) > len(want) and not more.duplicated("id").any()
    assert all(sum(x in (r or ()) for r in more["labels"]) <= full[x] for x in targets)
    assert S.need_selection(df.where("id < 0"), "id", "labels", targets, 5, 1).count() == 0


def test_scarce_groups_choose_first(spark):
    rows = [(i, ["big"] + ["mid"] * (i % 3 == 0) + ["rare"] * (i % 9 == 0)) for i in range(90)] + [(100, None)]
    df = spark.createDataFrame(rows, "id int, labels array<string>")
    targets = {"big": 50, "mid": 20, "rare": 10}
    got = S.scarce_first(df, "id", "labels", targets, 1).toPandas()
    gone, want = set(), {}
    for g in ("rare", "mid", "big"):
        pool = sorted((hashlib.md5(f"1|{g}|{i}".encode()).hexdigest(), i) for i, x in rows if x and g in x and i not in gone)
        want[g] = {i for _, i in pool[: targets[g]]}
        gone |= want[g]
    assert {g: set(p["id"]) for g, p in got.groupby("group")} == want
    with pytest.raises(ValueError, match="rare has 10 rows of 11"):
        S.scarce_first(df, "id", "labels", targets | {"rare": 11}, 1)
    assert S.scarce_first(df, "id", "labels", {"rare": 11, "none": 2}, 1, exact=False).count() == 10


def test_dedup_is_idempotent_and_keeps_the_first(items):
    once = dedup.first_wins(items, "t", order=["id"])
    assert ids(once) == list(range(40))
    assert ids(dedup.first_wins(once, "t", order=["id"])) == list(range(40))
    assert dedup.first_wins(items, "g", order=["id"]).count() == 7
    assert dedup.first_wins(items, "g", order=["id"], drop_null=False).count() == 8
    assert dedup.first_wins(items.where("id < 0"), "t", order=["id"]).count() == 0


def test_dedup_with_maps_and_ties(spark):
    df = spark.createDataFrame([(1, "a", {"k": "v"}), (1, "a", {"k": "v"}), (1, "A", None)], "i int, t string, m map<string,string>")
    assert dedup.first_wins(df, F.lower("t"), order=["i"]).count() == 1


def test_unordered_key(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", None)], "x string, y string")
    k = [r[0] for r in df.select(dedup.unordered_key("x", "y")).collect()]
    assert k[0] == k[1] == ["a", "b"] and k[2] is None


def test_reject_counts_add_up(spark):
    texts = [None, "", "short", "я " * 60, "\u0001" * 120, "1" * 200, "слово дело тело " * 20, "Обычный текст о том, как люди живут в разных домах. " * 4]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("r", filters.quality_reason("t"))
    n = {r["r"]: r["n"] for r in filters.reject_counts(df, "r").collect()}
    assert sum(n.values()) == len(texts)
    assert n["empty"] == 2 and n["too_short"] == 1 and n["bad_chars"] == 1 and n["low_alpha"] >= 1


def test_prune_and_guard(spark):
    df = spark.createDataFrame([(1, "p", ["p", "x", None, "y", "z"]), (2, "p", None)], "i int, p string, n array<string>")
    got = filters.prune(df, "n", lambda x: ~x.eqNullSafe(F.col("p")) & x.isNotNull(), least=1, most=2).collect()
    assert [(r["i"], r["n"]) for r in got] == [(1, ["x", "y"])]
    assert filters.prune(df, "n", lambda x: x.isNotNull()).count() == 2


def test_decontamination_leaves_no_overlap(spark):
    train = spark.createDataFrame([(1, "a", "b"), (2, "c", ""), (3, None, None), (4, "d", "e")], "i int, q string, p string")
    keys = M.keys_of(spark.createDataFrame([("c",), ("e",), ("",), (None,)], "t string"), "t")
    fields = [F.col("q"), F.col("p")]
    assert ids(M.decontaminate(train, "i", fields, keys), "i") == [1]  # a row without text is dropped
    assert ids(M.decontaminate(train, "i", fields, keys, empty_is_bad=False), "i") == [1, 3]
    assert ids(M.decontaminate(train, "i", fields, keys.where("key = 'none'")), "i") == [1, 2, 4]


def test_containment_against_a_loop(spark):
    hay = [(1, "xx needle one yy"), (2, "needle one"), (3, None), (4, "needle onene needle two"), (5, "")]
    wanted = [(10, "needle one"), (11, "needle two"), (12, "ne"), (13, None), (14, "needle one")]
    h, w = spark.createDataFrame(hay, "k bigint, t string"), spark.createDataFrame(wanted, "i bigint, n string")
    got = {tuple(r) for r in M.containment(h, "k", "t", w, "i", "n", 5).collect()}
    assert got == {(k, i) for k, t in hay for i, n in wanted if t and n and len(n) >= 5 and n in t and n != t}
    assert M.containment(h, "k", "t", w.where("i < 0"), "i", "n", 5).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sets(st.sampled_from("abcdefgh"), max_size=6), min_size=1, max_size=12), st.sampled_from([0.3, 0.5, 2 / 3, 0.8, 1.0]))
def test_jaccard_join_against_all_pairs(spark, sets, t):
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id int, words array<string>")
    got = {(r["a_id"], r["b_id"]) for r in M.jaccard_pairs(df.withColumnRenamed("id", "a_id"), df.withColumnRenamed("id", "b_id"), t).collect()}
    assert got == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and len(a & b) / len(a | b) >= t - 1e-12}


def test_contained_against_all_pairs(spark):
    long = "abcdefghij" * 3
    texts = [long, long[3:20], long[:9], "x" + long + "y", "abc", None, long[:10], "z" * 12]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {tuple(r) for r in M.contained(df.withColumnRenamed("i", "a_id"), df.withColumnRenamed("i", "b_id"), 10).collect()}
    assert got == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if a and b and len(a) >= 10 and a != b and a in b}


def test_documents_inside_a_passage_leak(spark, tmp_path):
    passage = " ".join(f"word{i:03d}" for i in range(40))
    docs = [(1, "ru", passage[9:120]), (2, "ru", passage[9:60]), (3, "en", f"a {passage} b"), (4, None, passage), (5, "en", None)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage), (8, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_passages.parquet")
    got = lambda name: sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
    assert got("containment_match") == [(1, 7), (3, 7)]
    assert got("leak_by_language") == [("en", 2, 1, 1), ("none", 1, 1, 0), ("ru", 2, 1, 1)]


def test_audit_counts_near_matches(spark, tmp_path):
    words = [f"word{i:03d}" for i in range(90)]
    rows = [
        (1, "near", "train", " ".join([*words[:10], "other", *words[11:20]])), (2, "held", "test", " ".join(words[:20])),
        (3, "inside", "train", " ".join(words[20:32])), (4, "held", "test", "before " + " ".join(words[20:40])),
        (5, "around", "train", "before " + " ".join(words[45:78]) + " after"), (6, "held", "validation", " ".join(words[45:60])),
        (7, "clean", "train", "nothing of this is known"), (8, "equal", "train", " ".join(words[:20])), (9, "clean", "train", None),
    ]
    spark.createDataFrame(rows, "pos bigint, source string, split string, query string").write.parquet(f"{tmp_path}/contrastive.parquet")
    got = {r["source"]: tuple(r)[1:] for r in catalog.queries()["audit_verdict_near"](spark, str(tmp_path)).collect()}
    assert got == {"near": (1, 0, 0, 1, "near_duplicates"), "inside": (1, 0, 1, 0, "contaminated"), "around": (1, 0, 1, 0, "contaminated"), "clean": (2, 0, 0, 0, "clean"), "equal": (1, 1, 0, 1, "contaminated")}


def test_line_blocks(spark):
    t = "первая строка текста\n\nвторая строка текста\nтретья строка текста"
    df = spark.createDataFrame([(t,), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(M.line_blocks("t", most=2, least=30)).collect()]
    assert got[0] == ["первая строка текста вторая строка текста", "вторая строка текста третья строка текста"] and not got[1]


def test_line_blocks_find_beginnings_and_late_lines(spark, tmp_path):
    passage = " ".join(f"слово{i:02d}" for i in range(40))
    start, other = " ".join(passage.split()[:14]), "an ordinary line that no passage has anywhere"
    docs = [
        (1, f"{other}\n{passage}\n{other}"), (2, f"{other}\n{start} but then it goes on differently"), (3, f"{other}\n" * 100 + passage),
        (4, f"{other} Abstract: {passage} and more"), (5, f"{other}\nrow {passage[:100]}"), (6, other), (7, ""), (8, None), (9, f"{passage[:150]}\n{passage[151:]}"),
    ]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, ""), (3, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_passages.parquet")
    assert ids(catalog.queries()["decontam_line_blocks"](spark, str(tmp_path)), "doc_id") == [5, 6, 7]


def test_block_keys_against_a_loop(spark):
    marks = ("аннотация", "abstract", "резюме")
    words = [f"w{i:02d}" for i in range(60)]
    texts = ["\n".join(" ".join(words[i : i + 5]) for i in range(0, 60, 5)), "abstract " + " ".join(words) + " резюме " + " ".join(words[7:]), " ".join(words[:9]), "w"]

    def beginnings(t):
        return {" ".join(t.split()[:12]) for _ in range(len(t.split()) >= 8)} | {t[:180] for _ in range(len(t) >= 180)}

    def plain(t):
        lines = t.split("\n")
        blocks = {b for i in range(len(lines)) for k in range(1, 5) if i + k <= len(lines) and len(b := " ".join(lines[i : i + k])) >= 40}
        pieces = [t[i : i + 800].replace("\n", " ").strip() for i in range(len(t)) for m in marks if t.startswith(m, i)]
        pieces += [p.removeprefix(m).strip() for p in pieces for m in marks if p.startswith(m)]
        return blocks.union(*map(beginnings, [*blocks, *pieces]))

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [set(r[0]) for r in df.select(M.block_keys("t")).collect()] == [plain(t) for t in texts]


def test_vote_winner(spark):
    v = spark.createDataFrame([(1, "r1", "a"), (1, "r2", "a"), (1, "r3", "b"), (2, "r1", "a"), (2, "r2", "b"), (3, "r1", "a"), (3, "r1", "a"), (4, "r1", None), (5, "r1", "a"), (5, "r2", "a"), (5, "r3", "b"), (5, "r4", "b")], "i int, r string, c string")
    assert [tuple(r) for r in A.vote_winner(v, "i", "r", "c", 2).collect()] == [(1, "a", 2)]


def test_anchor_metadata_later_wins(spark):
    rows = [("a", 1, "x", 0.9, {"k": "1"}), ("a", 2, "y", 0.7, {"k": "2", "m": "3"}), ("a", 3, "z", 0.1, None), ("b", 1, "u", float("nan"), None), ("b", 2, "v", 0.2, {})]
    df = spark.createDataFrame(rows, "s string, pos int, o string, score double, meta map<string,string>")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    got = A.anchors(df, "s", "pos", "o", "score").collect()
    assert [(r["s"], r["positive"], r["negatives"]) for r in got] == [("a", "y", ["z"])]


def test_episodes_leave_out_the_query(spark):
    rows = [(i, f"l{i % 4}", f"text {i % 20}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, l string, t string")
    got = C.episodes(df, df, "id", "l", "t", 2, 1, 3).collect()
    assert len(got) == 60
    for r in got:
        assert len(r["supports"]) == 3 and r["l"] in r["supports"]
        assert all(r["t"] not in ts and 1 <= len(ts) <= 2 for ts in r["supports"].values())


def test_json_repair_and_inverted_index(spark):
    df = spark.createDataFrame([('{"a": "x\\q"}',), ('{"a": 5}',), ("broken \"a\": \"v\" here",), (None,), ("[1]",)], "t string")
    assert [r[0] for r in df.select(C.json_field("t", "a")).collect()] == ["x\\q", "5", "v", None, None]
    df = spark.createDataFrame([(1, {"b": [1], "a": [0, 2], "c": [1]}), (2, {}), (3, None)], "i int, m map<string,array<int>>")
    assert [tuple(r) for r in C.from_inverted(df, "i", "m").orderBy("i").collect()] == [(1, "a c a"), (2, ""), (3, None)]


def test_score_buckets_have_gaps(spark):
    x = [0.0, 0.05, 0.10, 0.15, 0.20, 0.699, 0.70, 0.85, 0.95, 1.0, 1.1, None, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(C.bucket("x")).collect()]
    assert got == ["low", "low", None, None, "mid", "mid", None, "high", "top", "top", None, None, None]


def test_conversations(spark):
    df = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "bot", None), (1, 4, "bot", "c")], "c int, t int, r string, x string")
    assert C.roles(df, "c", "t", "r", "x", ["user", "bot", "system"]).first()[1:] == ("b", "c", None)
    assert C.joined_turns(df, "c", "t", "r", "x", True).first()["text"] == "user: a\nuser: b\nbot: c"
    with pytest.raises(Exception, match="more than 2 turns"):
        C.joined_turns(df, "c", "t", "r", "x", most=2).collect()


def test_batches(spark):
    rows = [(i, f"l{min(i % 9, 5)}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, l string")
    for made, size in ((B.label_balanced(df, "id", "l", 3, 4, 10, 1), 12), (B.score_balanced(df, "id", "l", 2, 1), 12), (B.group_contiguous(df, "id", "l", 8, 1), 8), (B.without_reuse(df, "id", "l", 3, 4, 1), 12), (B.support_query(df, "id", "l", 2, 1, 1), None)):
        p = made.toPandas()
        assert len(p) and not p.duplicated(["batch_id", "slot"]).any()
        if size:
            assert (p.groupby("batch_id").size() == size).all()
    p = B.without_reuse(df, "id", "l", 3, 4, 1).toPandas()
    assert not p["id"].duplicated().any() and (p.groupby("batch_id")["l"].nunique() == 3).all()
    assert (B.group_contiguous(df, "id", "l", 8, 1).toPandas().groupby("batch_id")["l"].nunique() == 1).all()
    p = B.interleave({"a": (df.where("l = 'l0'").select("id"), 2), "b": (df.where("l = 'l1'").select("id"), 1)}, "id", 50, 1).toPandas()
    assert len(p) == 150 and not p.duplicated(["batch_id", "slot"]).any()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 16)).astype(np.float32)
    m[7] = 0
    m[9] = m[8]
    rows = [(i, m[i].tolist(), f"c{i % 5}") for i in range(200)] + [(900, None, "c0"), (901, [], "c1"), (902, [1.0], "c2")]
    return m, spark.createDataFrame(rows, "id bigint, v array<float>, l string").repartition(4)


def test_nearest_against_numpy(vectors):
    m, df = vectors
    n = m.astype(float) / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-12)
    sim = n @ n.T
    sim[:, 7] = sim[7, :] = -9
    np.fill_diagonal(sim, -9)
    for same in (None, True, False):
        got = V.nearest(df, df.where("id % 20 = 0 OR id IN (7, 8)"), "id", "v", 4, label="l", same=same).toPandas()
        assert 7 not in set(got["query"]) and 7 not in set(got["neighbour"])
        for q, p in got.groupby("query"):
            s = sim[q].copy()
            if same is not None:
                s[(np.arange(200) % 5 == q % 5) != same] = -9
            want = np.lexsort((np.arange(200), -s))[:4]
            assert p.sort_values("place")["neighbour"].tolist() == want.tolist()
            assert np.allclose(p.sort_values("place")["sim"], s[want])


def test_label_scores_against_numpy(vectors):
    m, df = vectors
    n = m.astype(float) / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-12)
    got = V.label_scores(df, df.where("id IN (0, 20)"), "id", "v", "l", 0.1).toPandas()
    for r in got.itertuples():
        rows = [i for i in range(200) if i % 5 == int(r.label[1]) and i not in (r.query, 7)]
        s = np.sort(n[rows] @ n[r.query])[::-1]
        assert r.n == len(rows) and np.allclose((r.top, r.second), s[:2])
        assert r.lse == pytest.approx(0.1 * np.log(np.exp(s / 0.1).sum()))


def test_average_precision_with_ties(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False), (None, True)], "s double, r boolean")
    assert V.average_precision(df, "s", F.col("r")).first()["ap"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_ridge_separates_classes(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 2, i, (rng.normal(size=8) + (3 if i % 3 else -3)).tolist(), "a" if i % 3 else "b", "query" if i % 5 == 0 else "support") for i in range(120)]
    df = spark.createDataFrame(rows, "e int, id int, v array<double>, l string, r string")
    p = V.ridge(df, "e", "id", "v", "l", "r").toPandas()
    best = p.sort_values("score").groupby("id").tail(1)
    assert (best["label"] == ["a" if i % 3 else "b" for i in best["id"]]).mean() > 0.9


def test_metric_losses_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 6))
    lab = [i % 3 for i in range(12)]
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = n @ n.T
    sup, cir = [], []
    for i in range(12):
        o = [j for j in range(12) if j != i]
        pos = [j for j in o if lab[j] == lab[i]]
        neg = [j for j in o if lab[j] != lab[i]]
        sup.append(np.log(np.exp(s[i, o] / 0.1).sum()) - (s[i, pos] / 0.1).mean())
        lp = -64 * np.maximum(0, 1.25 - s[i, pos]) * (s[i, pos] - 0.75)
        ln = 64 * np.maximum(0, s[i, neg] + 0.25) * (s[i, neg] - 0.25)
        cir.append(np.logaddexp(0, np.logaddexp.reduce(lp) + np.logaddexp.reduce(ln)))
    df = spark.createDataFrame([(0, i, lab[i], x[i].tolist()) for i in range(12)], "b int, id int, l int, v array<double>")
    got = V.metric_losses(df, "b", "id", "l", "v").first()
    assert got["supcon"] == pytest.approx(np.mean(sup)) and got["circle"] == pytest.approx(np.mean(cir), rel=1e-6)


def test_tfidf(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b"]), (3, [])], "i int, w array<string>")
    got = {(r["i"], r["term"]): r["weight"] for r in V.tfidf(df, "i", "w").collect()}
    a, b = (1 + np.log(2)) * (np.log(4 / 2) + 1), np.log(4 / 3) + 1
    assert got[1, "a"] == pytest.approx(a / np.hypot(a, b)) and got[2, "b"] == pytest.approx(1)


def test_states(spark):
    s = lambda *v: spark.createDataFrame([("w", i, x) for i, x in enumerate(v)], "name string, idx int, value double")
    avg = {r["idx"]: r["value"] for r in V.averaged_state([(s(1.0, 2.0, 9.0), 1), (s(3.0, 6.0), 3)]).collect()}
    assert avg == {0: pytest.approx(2.5), 1: pytest.approx(5.0)}
    g = V.geometry(s(0.0, 0.0), s(1.0, 1.0), s(2.0, 0.0)).first()
    assert g["projection"] == pytest.approx(0.5) and g["orthogonal_norm"] == pytest.approx(1.0) and g["delta_cosine"] == pytest.approx(2**-0.5)


def test_early_stop_and_gate(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0, 0.9, 0.95, 0.91, 0.92, 0.5])], "r string, s int, l double")
    got = G.early_stop(df, "r", "s", "l", 0.0, 3).orderBy("s").collect()
    assert [r["since"] for r in got] == [0, 0, 1, 2, 3, 0] and [r["stopped"] for r in got] == [False] * 4 + [True] * 2
    runs = spark.createDataFrame([("a", "t", 0.1), ("a", "u", -0.02), ("b", "t", 0.01), ("b", "u", 0.0)], "r string, t string, d double")
    assert [(r["r"], r["promoted"]) for r in G.gate(runs, "r", "t", "d").orderBy("place").collect()] == [("b", True), ("a", False)]


def test_main_scores_of_both_definitions(spark):
    df = spark.createDataFrame([("t", {"dev": [(0.5,), (0.7,)], "test": [(0.2,)]}), ("u", {"dev": [(None,)]}), ("v", {})], "task_name string, scores map<string,array<struct<main_score:double>>>")
    got = {r["task_name"]: (r["mean_score"], r["first_score"]) for r in G.main_scores(df).collect()}
    assert got["t"] == (pytest.approx(1.4 / 3), pytest.approx(0.2)) and got["u"] == got["v"] == (None, None)


def test_set_operations(spark):
    a, b = spark.range(5).toDF("k"), spark.range(3, 8).toDF("k")
    assert ids(U.common_keys(a, b, "k"), "k") == [3, 4]
    assert {tuple(r) for r in U.key_differences(a, b, "k").collect()} == {(0, "left"), (1, "left"), (2, "left"), (5, "right"), (6, "right"), (7, "right")}
    m = U.mix({"x": (a, 2), "y": (b, 3)}, "k", 1).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in m} == {"x": 2, "y": 3}


def test_edit_ratio_is_the_library_one(spark):
    from corpusloom.functions import arrow

    pairs = [("дом у реки", "дома у реки"), ("a", "b"), ("abc", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(arrow.edit_ratio("a", "b")).collect()] == [difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]


def test_replace_first(spark):
    df = spark.createDataFrame([("a1b2\nc3",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(X.replace_first("t", "[0-9]", "#")).collect()] == ["a#b2\nc3", "none", None]


def test_social_texts(spark):
    good = "Сегодня мы гуляли у реки и смотрели на лодки"
    cases = [
        (good, True), (None, False), ("", False), ("Коротко", False), (good * 6, False), ("Это было очень странно", False), ("Это было очень странно !!", True), (good + " аааааааа", False),
        ("смотрите https://example.org/video скорее, друзья", False), ("@a @b @c смотрите скорее наше видео", False), ("only english words are here and nothing else", False), (good + " https://example.org", True),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["ok"] for r in df.select("i", filters.social_ok("t").alias("ok")).collect()}
    assert [got[i] for i in range(len(cases))] == [ok for _, ok in cases]


def test_json_texts_answers_and_tags(spark):
    texts = ['{"text": [{"text": " a "}, {"text": ""}, "no", {"text": "b\\q"}]}', ' raw {"text" ', None, '{"text": "plain"}', "[]"]
    answers = ['[{"condition": "c", "solution": {"text": "s"}}, {"condition": "d", "solution": "t"}, 5]', 'x "condition": "one \\"two\\"" y "solution": {"text": "three"} "answers": ["four"]', " nothing ", None]
    tags = ['["a", "b"]', '"one"', "broken [", "", None]
    col = lambda f, v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "x string").select(f("x")).collect()]
    assert col(C.json_text, texts) == ["a b\\q", 'raw {"text"', None, '{"text": "plain"}', "[]"]
    assert col(C.json_answer, answers) == ["c s d t", 'one "two" three four', "nothing", None]
    assert col(C.json_tags, tags) == [["a", "b"], ["one"], ["broken ["], [], []]


def test_ridge_forms(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, [float(x) for x in rng.normal(i % 3, 1, 4)], f"l{i % 3}", "query" if i % 4 == 0 else "support") for i in range(40)]
    df = spark.createDataFrame(rows, "e int, k int, v array<double>, l string, r string")
    x, z = (np.array([r[2] for r in rows if r[4] == role]) for role in ("support", "query"))
    y = np.array([[r[3] == f"l{j}" for j in range(3)] for r in rows if r[4] == "support"], float)
    table = lambda d: d.toPandas().sort_values(["k", "label"])["score"].to_numpy().reshape(-1, 3)
    assert np.allclose(table(V.ridge(df, "e", "k", "v", "l", "r", 0.5)), z @ np.linalg.solve(x.T @ x + 0.5 * np.eye(4), x.T @ y))
    centred, mean, ymean = x - x.mean(0), x.mean(0), y.mean(0)  # a free bias is the same as centring
    want = (z - mean) @ np.linalg.solve(centred.T @ centred + 0.5 * np.eye(4), centred.T @ (y - ymean)) + ymean
    assert np.allclose(table(V.ridge(df, "e", "k", "v", "l", "r", 0.5, bias=True, temperature=0.1)), want / 0.1)


def test_average_precision_in_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 2}", round(float(rng.random()), 2), bool(rng.random() < 0.3)) for i in range(900)] + [("none", 0.5, False), ("g0", None, True)]
    got = {r["g"]: r["ap"] for r in V.average_precision(spark.createDataFrame(rows, "g string, s double, r boolean"), "s", F.col("r"), "g").collect()}
    for g in ("g0", "g1", "none"):
        own = [(s, r) for k, s, r in rows if k == g and s is not None]
        total, ap = sum(r for _, r in own), 0.0
        for v in {s for s, _ in own}:
            upto = [r for s, r in own if s >= v]
            ap += sum(r for s, r in own if s == v) / total * sum(upto) / len(upto) if total else 0.0
        assert got[g] == pytest.approx(ap)


def test_near_refined_against_a_loop(spark):
    texts = ["один два три четыре пять", "один два три четыре пять шесть", "а бб вв гг", "а бб вв гг", "пять четыре три два один", "совсем другие слова стоят тут"]
    pair = lambda n: spark.createDataFrame(list(enumerate(texts)), f"{n}_id int, {n}_text string")
    words = lambda n: pair(n).select(f"{n}_id", F.split(f"{n}_text", " ").alias("words"))
    got = {(r["a_id"], r["b_id"]) for r in M.refined(M.jaccard_pairs(words("a"), words("b"), 0.78), pair("a"), pair("b")).collect()}
    assert got == {(i, j) for i in (0, 1, 4) for j in (0, 1, 4)} | {(5, 5)}


def test_shared_labels_in_blocks(spark):
    rows = [(i, ["all", f"l{i % 4}", None]) for i in range(30)] + [(40, None), (41, [])]
    got = {(r["a"], r["b"]): r["shared"] for r in M.sharing_labels(spark.createDataFrame(rows, "id int, labels array<string>"), "id", "labels").collect()}
    assert got == {(i, j): 1 + (i % 4 == j % 4) for i in range(30) for j in range(i + 1, 30)}


def test_templates_are_counted_first(spark):
    slot = spark.range(100).select(F.col("id").cast("string").alias("x"))
    assert filters.templates("%s-%s", slot, slot).count() == 10_000
    with pytest.raises(ValueError, match="the slots have"):
        filters.templates("%s-%s", slot, slot, most=9_999)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from corpusloom.session import shared_dir

    held = {}
    conf = N(get=lambda k, d=None: held.get(k, d), set=held.__setitem__)
    session = lambda master: N(sparkContext=N(master=master, getConf=lambda: conf), conf=conf)
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    assert shared_dir(session("local[4]")).startswith("file:///") and shared_dir(session("yarn")) == held["spark.checkpoint.dir"]


def test_searches_in_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 6)], f"l{i % 3}") for i in range(60)], "k bigint, v array<double>, l string")
    hay = spark.createDataFrame([(i, f"alpha {i} beta {i % 7} gamma") for i in range(40)], "k bigint, t string")
    wanted = spark.createDataFrame([(i, f"beta {i} gamma") for i in range(9)], "i bigint, n string")
    runs = (lambda: V.nearest(df, df.where("k < 20"), "k", "v", 3, label="l"), lambda: V.label_scores(df, df.where("k < 20"), "k", "v", "l"), lambda: M.containment(hay, "k", "t", wanted, "i", "n", 3))
    rows = lambda run: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in run().collect())
    whole = [rows(run) for run in runs]
    monkeypatch.setattr(V, "BLOCK_NUMBERS", 40)
    monkeypatch.setattr(M, "BLOCK_CHARS", 30)
    assert [rows(run) for run in runs] == whole and all(whole)


def test_marks_of_shared_stretches(spark):
    rng = np.random.default_rng(9)
    letters = lambda n: "".join(rng.choice(list("абвгд"), n))
    rows = []
    for i in range(60):
        a = letters(int(rng.integers(80, 200)))
        rows.append((i, a, letters(int(rng.integers(0, 300))) + a + letters(int(rng.integers(0, 300)))))
    df = spark.createDataFrame([*rows, (90, None, None), (91, "", "short")], "i int, a string, b string")
    got = df.select("i", arrow.anchors(80, True)("a").alias("m"), arrow.anchors(80)("b").alias("n"), F.length("b").alias("size")).collect()
    for r in got:
        assert set(r["m"]) <= set(r["n"]) and len(r["m"]) == (r["i"] < 60) and len(r["n"]) <= max(1, (r["size"] or 0) // 8)
