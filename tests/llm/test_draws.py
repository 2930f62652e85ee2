"""Packing, mixing and proportional samples."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.names import canonical_name
from corpusloom.llm import mixing, pack, proportions


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20), st.sampled_from([64, 100]))
def test_plan_places_every_document_once(histogram, capacity):
    made = pack.plan(histogram, capacity)
    got = Counter()
    for lengths, n in made:
        assert sum(lengths) <= capacity and n > 0
        for x in lengths:
            got[x] += n
    assert got == Counter(histogram)
    keys, first, containers = pack.slots(made)
    assert containers == sum(n for _, n in made) and (np.diff(keys) > 0).all() and len(first) == len(keys)


def test_plan_leaves_little_space():
    rng = np.random.default_rng(0)
    for capacity in (512, 2048, 4096):
        n = np.minimum(capacity, np.maximum(8, rng.lognormal(5.4, 0.9, 30_000))).astype(int)
        made = pack.plan(dict(Counter(n.tolist())), capacity)
        used = sum(k for _, k in made)
        assert n.sum() / (used * capacity) > 0.96


def test_nonnegative_fit():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    x = pack.nonnegative_fit(a, np.array([3.0, 1.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [3, 1])
    assert (pack.nonnegative_fit(a, np.array([-1.0, 2.0])) >= 0).all()


def test_patterns_fill_exactly():
    p = pack.patterns(12, 3, 6)
    assert len(p) == len(set(p)) and all(sum(a * n for a, n in x) == 12 and sum(n for _, n in x) <= 6 and len(x) <= 3 for x in p)


def test_packing_documents(spark):
    rows = [(i, "слово " * (1 + i * 37 % 90)) for i in range(300)] + [(900, None), (901, ""), (902, "x y " * 4000), (903, " ")] + [(1000 + i, "same text") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    limits = spark.createDataFrame([("a", 64), ("b", 512), ("none", None), ("zero", 0)], "stage string, max_length int")
    p = pack.pack_all(docs, "doc_id", "text", limits, "stage", "max_length").toPandas()
    n = {r["doc_id"]: r["n_tokens"] for r in pack.token_counts(docs, "doc_id", "text").collect()}
    assert n[900] == n[901] == 0 and set(p["stage"]) == {"a", "b"}
    for stage, cap in (("a", 64), ("b", 512)):
        s = p[p["stage"] == stage]
        size = s["token_to"] - s["token_from"]
        assert set(s["doc_id"]) == {d for d, k in n.items() if k}
        assert size.groupby(s["doc_id"]).sum().to_dict() == {d: k for d, k in n.items() if k}
        assert (size.groupby(s["container"]).sum() <= cap).all()
        assert (s.groupby("doc_id").size() == [-(-n[d] // cap) for d in sorted(set(s["doc_id"]))]).all()
        assert sorted(s["container"].unique()) == list(range(s["container"].nunique()))
    again = pack.pack_all(docs.repartition(7), "doc_id", "text", limits, "stage", "max_length").toPandas()
    key = ["stage", "doc_id", "piece"]
    assert p.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert pack.pack_all(docs.where("doc_id < 0"), "doc_id", "text", limits, "stage", "max_length").count() == 0
    assert pack.pack_all(docs, "doc_id", "text", limits.where("max_length < 0"), "stage", "max_length").count() == 0


@pytest.fixture(scope="module")
def train(spark):
    rows = [(i, ("A_b", "a-B ", "c", None, " ")[i % 5]) for i in range(500)]
    return spark.createDataFrame(rows, "pos bigint, source string")


TARGETS = "mix string, total_records bigint, source string, weight double, max_repeats int"


def test_mix(spark, train):
    t = spark.createDataFrame([("m", 600, "a_b", 0.5, 2), ("m", 600, "c", 0.5, 2), ("m", 600, "gone", 0.1, 3), ("n", 10, "c", 1.0, 1), ("z", None, "c", None, None)], TARGETS)
    name = canonical_name("source")
    got = mixing.mix(train, "pos", name, t, name).toPandas()
    m = got[got["mix"] == "m"]
    assert sorted(m["position"]) == list(range(len(m))) and Counter(m["source"]) == {"a_b": 400, "c": 200}
    assert m.groupby("pos").size().max() == 2 and m.groupby(["pos", "epoch"]).size().max() == 1
    assert (m.sort_values("position")["source"].head(60) == "a_b").sum() == pytest.approx(40, abs=2)
    for drawn in (None, mixing.mix(train, "pos", name, t, name)):
        s = mixing.shares(train, name, t, name, drawn).toPandas().set_index(["mix", "source"])
        assert s.loc[("m", "gone"), "short"] and s.loc[("m", "c"), "short"] and not s.loc[("m", "a_b"), "short"]
        assert s.loc[("m", "a_b"), "share_alone"] == pytest.approx(0.6) and s.loc[("m", "a_b"), "drawn"] == 400 and s.loc[("m", "a_b"), "share"] == pytest.approx(2 / 3)
        assert s.loc[("z", "c"), "drawn"] == 0 and s.loc[("n", "c"), "drawn"] == 10
    assert mixing.mix(train.where("pos < 0"), "pos", name, t, name).count() == 0
    assert mixing.mix(train, "pos", name, t.where("mix = 'x'"), name).count() == 0


def test_a_mix_has_its_size_where_sources_can_give_it(spark, train):
    name = canonical_name("source")
    t = spark.createDataFrame([("m", 600, "c", 0.6, 1), ("m", 600, "a_b", 0.4, 9), ("n", 5000, "c", 0.5, 1), ("n", 5000, "a_b", 0.5, 1), ("k", 101, "c", 0.333, 1), ("k", 101, "a_b", 0.667, 1)], TARGETS)
    s = mixing.shares(train, name, t, name).toPandas().set_index(["mix", "source"])
    assert s.loc[("m", "c"), "drawn"] == 100 and s.loc[("m", "a_b"), "drawn"] == 500 and s.loc[("m", "a_b"), "alone"] == 240
    assert s.loc[("n", "c"), "drawn"] == 100 and s.loc[("n", "a_b"), "drawn"] == 200
    assert s.loc["k"]["drawn"].tolist().count(34) == 1 and s.loc["k"]["drawn"].sum() == 101


def test_demand_in_tokens(spark):
    rows = [(i, "long" if i % 2 else "short", 90 if i % 2 else 10) for i in range(400)] + [(1000, "none", None), (1001, "none", -5)]
    df = spark.createDataFrame(rows, "pos bigint, source string, n int")
    t = spark.createDataFrame([("m", 400, "long", 0.5, 1), ("m", 400, "short", 0.5, 1), ("z", 2, "none", 1.0, 1)], TARGETS)
    m = mixing.mix(df, "pos", F.col("source"), t, F.col("source"), {"long": (2.0, 0.0)}, size=F.col("n")).toPandas().sort_values("position")
    assert len(m) == 402 and sorted(m[m["mix"] == "m"]["position"]) == list(range(400))
    long = m[(m["mix"] == "m") & (m["source"] == "long")]
    # a falling weight: three quarters of its tokens in the first half of the training, where the steady source has half of its own
    half = m[(m["mix"] == "m") & (m["source"] == "short")]["position"].iloc[99]
    assert (long["position"] < half).sum() == pytest.approx(150, abs=2)
    mixed = spark.createDataFrame([(i, "s", 1 + 30 * (i % 7 == 0)) for i in range(700)], "pos bigint, source string, n int")
    got = mixing.mix(mixed, "pos", F.col("source"), spark.createDataFrame([("m", 700, "s", 1.0, 1)], TARGETS), F.col("source"), size=F.col("n"))
    assert sorted(r["position"] for r in got.collect()) == list(range(700))


def test_schedules_shift_a_source(spark, train):
    t = spark.createDataFrame([("m", 200, "a_b", 0.5, 1), ("m", 200, "c", 0.5, 1)], TARGETS)
    name = canonical_name("source")
    got = mixing.mix(train, "pos", name, t, name, {"c": (2.0, 0.0)}).toPandas()
    assert sorted(got["position"]) == list(range(200))
    early, late = got[got["position"] < 50], got[got["position"] >= 150]
    assert (early["source"] == "c").sum() > 2 * (late["source"] == "c").sum()
    with pytest.raises(ValueError, match="schedule"):
        mixing.moment(F.lit(0.5), (-1.0, 1.0))


@given(st.floats(0, 1), st.lists(st.floats(0.1, 3), min_size=2, max_size=5))
@settings(max_examples=20, deadline=None)
def test_moment_inverts_the_integral(spark, share, schedule):
    t = spark.range(1).select(mixing.moment(F.lit(share), schedule)).first()[0]
    grid = np.linspace(0, 1, len(schedule))
    x = np.linspace(0, 1, 20_001)
    w = np.interp(x, grid, schedule)
    total = np.trapezoid(w, x)
    assert np.trapezoid(np.where(x <= t, w, 0), x) / total == pytest.approx(share, abs=2e-3)


PLANS = "plan string, sample_size bigint, label string, target_share double, min_rows int"


def test_proportions(spark):
    rows = [(i, 0, ("A b", "a_B ", "c", "d")[min(3, i % 10)] if i % 50 else None, "2025-01-01") for i in range(4000)]
    rows += [(1, 0, "late", "2025-02-01"), (2, 0, "old", "2024-01-01"), (3, 0, None, None)]
    raw = spark.createDataFrame(rows, "batch_id int, slot int, label string, at string").withColumn("added_at", F.to_timestamp("at"))
    lab = F.regexp_replace(F.lower(F.trim("label")), " ", "_")
    rec = proportions.newest(raw, ["batch_id", "slot"], "added_at", lab)
    assert rec.count() == 4000 and rec.where("batch_id = 1").first()["label"] == "late" and rec.where("batch_id = 2").first()["label"] != "old"
    t = spark.createDataFrame([("p", 1000, "a_b", 0.3, 0), ("p", 1000, "c", 0.6, 0), ("p", 1000, "d", 0.1, 150), ("p", 1000, "late", 0.0, 1), ("p", 1000, "gone", 0.01, 5), ("q", 0, "d", None, None)], PLANS)
    key = F.regexp_replace(F.lower(F.trim("label")), " ", "_")
    s = proportions.draw(rec, ["batch_id", "slot"], t, key)
    p = s.toPandas()
    assert not p.duplicated(["plan", "batch_id", "slot"]).any() and set(p["plan"]) == {"p"}
    r = proportions.report(rec, s, t, key).toPandas().set_index(["plan", "label"])
    assert r.loc[("p", "late"), "drawn"] == 1 and r.loc[("p", "c"), "short"] and r.loc[("p", "c"), "drawn"] == r.loc[("p", "c"), "available"] and r.loc[("p", "gone"), "missing"] == 10
    # c and gone are short, so a_b and d make up for them, three to one as in their targets
    left = 1010 - 1 - r.loc[("p", "c"), "available"]
    assert r["drawn"].loc["p"].sum() == 1010 and abs(r.loc[("p", "a_b"), "drawn"] - 0.75 * left) <= 1 and r.loc[("p", "d"), "held"] == "others"
    assert r.loc[("p", "late"), "held"] == "floor" and r.loc[("p", "c"), "held"] == "short"
    again = proportions.draw(rec.repartition(9), ["batch_id", "slot"], t, key).toPandas()
    assert set(map(tuple, p.to_numpy())) == set(map(tuple, again.to_numpy()))
    assert proportions.draw(rec.where("batch_id < 0"), ["batch_id", "slot"], t, key).count() == 0
    assert proportions.draw(rec, ["batch_id", "slot"], t.where("plan = 'x'"), key).count() == 0


def test_blocks_keep_the_size(spark, monkeypatch):
    monkeypatch.setattr(proportions, "BLOCK", 50)
    rec = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    t = spark.createDataFrame([("p", 701, "a", 0.5, 0), ("p", 701, "b", 0.5, 0)], PLANS)
    n = Counter(r["label"] for r in proportions.draw(rec, ["k"], t, F.col("label")).collect())
    assert sum(n.values()) == 701 and abs(n["a"] - 350.5) <= 0.5


def test_pivotal_method_keeps_probabilities():
    rng = np.random.default_rng(0)
    p = np.array([0.2, 0.5, 0.9, 0.4, 0.7, 0.3, 1.0, 0.0])
    hits = np.zeros(len(p))
    for _ in range(4000):
        state, held, left = proportions.pivotal(p, rng.random(len(p)))
        if held >= 0:
            state[held] = rng.random() < left
        assert state.sum() == 4
        hits += state
    assert np.abs(hits / 4000 - p).max() < 0.03


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 100), st.floats(0, 30), st.integers(0, 200)), min_size=1, max_size=8))
def test_allocation_keeps_bounds_and_total(rows):
    target, floor, have = (np.array([r[i] for r in rows], float) for i in range(3))
    got = proportions.allocate(target, floor, have)
    low = np.minimum(floor, have)
    assert (got >= low - 1e-6).all() and (got <= have + 1e-6).all()
    reach = np.where(target > 1e-9, have, low).sum()  # a category that nobody wants is not filled up
    assert got.sum() == pytest.approx(min(max(target.sum(), low.sum()), reach), abs=1e-4)
    free = (got > low + 1e-6) & (got < have - 1e-6) & (target > 1e-3)
    assert free.sum() < 2 or np.ptp(got[free] / target[free]) < 1e-4 * (got[free] / target[free]).max()


def test_tilt_meets_the_totals():
    n, t = np.array([100.0, 50, 10, 7]), np.array([20.0, 49.5, 10, 0])
    p = proportions.tilt(n, t)
    assert np.allclose(n * p, t) and ((p >= 0) & (p <= 1)).all()
