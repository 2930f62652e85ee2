"""Look-alikes, comparison words, severity, prose."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lookalike, prose, severity
from corpusloom.llm.lookalike import LookalikeModel, UnionFind
from corpusloom.llm.prose_holdout import JUNK, PROSE
from corpusloom.llm.words import WordHashes, fold, word_set, words

CHANGED = [
    ("Чтo зa дом", "Что за дом"), ("ｆｕｌｌ １２", "full 12"), ("ﬁlters", "filters"), ("café now", "café now"), ("й", "й"), ("со​н", "сон"), ("a b", "a b"),
    ("для ­тебя", "для тебя"), ("дом, a сад", "дом, а сад"), ("the аrchive", "the archive"), ("Εщё раз", "Ещё раз"), ("C самого начала", "С самого начала"), ("слово‍ дня", "слово дня"), ("спор（да）", "спор(да)"),
]
KEPT = [
    "", " ", "до́ма", "за́мок", "🏳️‍🌈 ok", "👩‍💻", "❤️", "на языке C", "C++-код", "20 °C", "пакет α", "β-версия", "Ω-значения", "№ 5…", "«да» — нет", "a  b\nc", "naïve façade", "USB-порт",
    "mk3080", "API-вызовы", "in the Ъ column", "ТК-9051 drifted", "е вместо ё", "нет, а SQL-запросы серверов", "до 5, а API-вызовы",
]


@pytest.mark.parametrize(("old", "new"), CHANGED)
def test_disguise_is_undone(old, new):
    m = LookalikeModel()
    assert m.normalize(old) == new and m.normalize(new) == new


@pytest.mark.parametrize("text", KEPT)
def test_proper_text_stays(text):
    assert LookalikeModel().normalize(text) == text


def test_classes_are_transitive_and_chosen_by_frequency():
    u = UnionFind()
    u.union("a", "b")
    u.union("c", "b")
    assert u.classes() == [["a", "b", "c"]]
    one, two = "\u0439", "\u0438\u0306"
    assert LookalikeModel({one: 9, two: 1}).normalize("мо" + two) == "мо" + one
    assert LookalikeModel({one: 1, two: 9}).normalize("мо" + two) == "мо" + one  # a form for compatibility never stands for the class
    often = LookalikeModel({"Cyrl:a": 1, "Cyrl:а": 9})
    assert often.normalize("дом, a сад") == "дом, а сад" and LookalikeModel({"Cyrl:a": 9, "Cyrl:а": 1}).normalize("дом, a сад") == "дом, a сад"


@pytest.fixture(scope="module")
def known(spark):
    return lookalike.skeletons(spark)


@pytest.mark.parametrize(("old", "new"), [("Москвɑ", "Москва"), ("ԁata", "data"), ("dօm", "dom"), ("Ꭺbc", "Abc"), ("ℋello", "Hello"), ("бысτро", "быстро"), ("Ꮇосква", "Москва")])
def test_look_alikes_in_the_wider_sense(known, old, new):
    m = LookalikeModel(skeletons=known)
    got = m.normalize(old)
    assert got == new and m.suspect(old) and m.normalize(new) == new


@pytest.mark.parametrize("text", [*KEPT, "դա հայերեն է", "ᎣᏏᏲ", "кΩ", "dγ", "Δx", "ΛCDM", "[ɡuːd]", "π-мезон", "σ = 3", "SIM-карта", "rn and m"])
def test_proper_text_stays_in_the_wider_sense(known, text):
    assert LookalikeModel(skeletons=known).normalize(text) == text


def test_counts_choose_the_representative(known):
    for often, new in (("у", "оқуши ту"), ("ү", "оқуши тү")):
        m = LookalikeModel({often: 9}, known)
        assert m.wider_map["Cyrl"]["ʏ"] == often and new[-1] == often
    one, two = (LookalikeModel({c: 5}, known).normalize("тужʏж") for c in "уү")
    assert (one, two) == ("тужуж", "тужүж")


@pytest.mark.parametrize("word", ["is", "pace", "scope", "episcopy", "oasisspicejoy"])
def test_words_of_any_length_are_judged_by_their_spelling(spark, word):
    swap = str.maketrans("acehijopsxy", "асеһіјорѕху")
    rows = [(i, f"the {word} then was here") for i in range(500)] + [(900, f"the {word.translate(swap)} then was here"), (901, f"the {word.translate(swap).title()} then")]
    df = spark.createDataFrame(rows, "pos bigint, query string")
    got = {r["pos"]: r["new"] for r in lookalike.unify(df, ["query"], "pos").collect()}
    assert got[900] == f"the {word} then was here" and set(got) <= {900, 901}


def test_unified_is_unify_in_one_pass(spark):
    rows = [(i, o, n) for i, (o, n) in enumerate(CHANGED)] + [(100, None, ""), (101, "plain", "ascii")]
    df = spark.createDataFrame(rows, "pos bigint, query string, positive string")
    got = {r["pos"]: r for r in lookalike.unified(df, ["query", "positive"], "pos").collect()}
    new = {(r["pos"], r["field"]): r["new"] for r in lookalike.unify(df, ["query", "positive"], "pos").collect()}
    for pos, q, p in rows:
        assert got[pos]["query"] == new.get((pos, "query"), q) and got[pos]["positive"] == new.get((pos, "positive"), p)
        assert got[pos]["changed"] == ",".join(f for f in ("query", "positive") if (pos, f) in new)
    assert lookalike.unified(df.where("pos < 0"), ["query", "positive"], "pos").count() == 0


def test_unify(spark):
    rows = [(1, "Чтo зa дом", None, 1), (2, "дом", "", 2), (3, None, "x​y", 3), (4, " ", "и сад " * 5000 + "cад", 4), (1, "Чтo зa дом", None, 5)]
    df = spark.createDataFrame(rows, "pos bigint, query string, positive string, field int").withColumnRenamed("field", "old")
    got = {(r["pos"], r["field"], r["new"]) for r in lookalike.unify(df, ["query", "positive"], "pos").collect()}
    assert got == {(1, "query", "Что за дом"), (3, "positive", "xy"), (4, "positive", "и сад " * 5000 + "сад")}
    assert lookalike.unify(df.where("pos < 0"), ["query", "positive"], "pos").count() == 0


def test_scan_filter_drops_no_case(spark):
    df = spark.createDataFrame([(i, o) for i, (o, _) in enumerate(CHANGED)], "i int, t string")
    assert df.where(lookalike.may_change(F.col("t"))).count() == len(CHANGED)
    assert all(lookalike.SUSPECT.search(o) for o, _ in CHANGED)


def test_words_compare_what_looks_alike():
    assert words("Instruct: a\nQuery: Чтo ЗА Ёлка, до́м!") == words("что за елка дом")
    assert words("ｄｓ２０２２ ４２") == words("ds2022 42")
    assert words("Вода") == words("Bода") == words("ВОДА") and fold("Й") == fold("й")
    assert words(None) == words("") == words(" ... ") == []
    h = WordHashes()
    assert np.array_equal(word_set("b a a", h), word_set("A b", h))


def test_severity_learns_despite_wrong_ratings(spark):
    rng = np.random.default_rng(0)
    nouns = [f"слово{a}" for a in "абвгдежзиклмнопрстуф"]
    bad = ["ты мерзкий болван", "закрой рот болван", "все вы мерзкий сброд"]
    rows = []
    for i in range(1500):
        t = " ".join(rng.choice(nouns, 9))
        offends = i % 6 == 0
        rows.append((i, f"{t}, {bad[i % 3]}!" if offends else f"{t}.", offends))
    votes = []
    for i, _, offends in rows[:1200]:
        for r in range(1 + i % 2):
            votes.append((i, f"r{r}", "abusive" if offends != (rng.random() < 0.05) else "none", r))
    votes += [(0, "r0", None, 9), (3, "r0", "none", 9), (None, "r1", "none", 0)]
    df = spark.createDataFrame(rows, "pos bigint, query string, truth boolean")
    graded = severity.votes(spark.createDataFrame(votes, "pos bigint, rater string, category string, at int"), "pos", "rater", "category", newest="at")
    model = severity.fit(df, "pos", "query", graded)
    assert (np.diff(model.thresholds) >= 0).all()
    p = severity.severities(df.unionByName(spark.createDataFrame([(-1, None, False), (-2, " ", False)], df.schema)), "pos", "query", model).toPandas().set_index("pos")["p_offending"]
    truth = np.array([r[2] for r in rows])
    found = p.loc[range(1500)].to_numpy() > severity.OFFENDING
    assert (found[1200:] == truth[1200:]).mean() > 0.98 and (found[:1200] == truth[:1200]).mean() > 0.95
    assert p[-1] == p[-2] == 0
    assert model.grades(["сегодня ты м-е-р-з-к-и-й болвааан"])[0, 0] > severity.OFFENDING


def test_grades_are_ordered_and_learned():
    rng = np.random.default_rng(5)
    kinds = [("добрый день дорогой друг", 0), ("ты мерзкий болван и дурак", 1), ("голые тела в постели ночью", 2), ("всех этих пришлых надо гнать", 3)]
    rows = [(f"{t} слово{rng.integers(40)}", g) for t, g in kinds for _ in range(120)]
    grade = np.array([g for _, g in rows])
    n = rng.integers(1, 4, len(rows))
    above = np.stack([rng.binomial(n, np.where(grade >= k, 0.95, 0.04)) for k in (1, 2, 3)], 1)
    model = severity.fit_ordinal([t for t, _ in rows], n, above)
    got = model.grades([t for t, _ in kinds]).sum(1)
    assert (np.diff(got) > 0.4).all() and got[0] < 0.3 and got[3] > 2.3
    assert np.isinf(model.score([None, ""])).all() and not model.grades([None, ""]).any()


def test_rater_errors_are_estimated():
    rng = np.random.default_rng(6)
    truth = rng.random(6000) < 0.25
    n = rng.integers(1, 5, 6000)
    for alarm, oversight in ((0.03, 0.15), (0.1, 0.05)):
        m = rng.binomial(n, np.where(truth, 1 - oversight, alarm))
        got = severity.rater_errors(n, m)
        assert abs(got[0] - alarm) < 0.015 and abs(got[1] - oversight) < 0.03
    assert severity.rater_errors(np.ones(5, int), np.ones(5, int)) == pytest.approx((severity.ERRORS, severity.ERRORS))


def test_scores_are_calibrated_on_held_out_ratings():
    rng = np.random.default_rng(7)
    model = severity.Ordinal(np.zeros(2**severity.BITS), np.array([0.0, 0.5, 1.0]))
    model.score = lambda texts: np.array(texts, float)
    x = rng.normal(0, 2, 4000)
    n = np.full(4000, 2)
    above = np.stack([rng.binomial(n, np.where(rng.random(4000) < 1 / (1 + np.exp(-(2 * (x - t) - 1))), 0.95, 0.05)) for t in model.thresholds], 1)
    slope, shift = severity.calibrate(model, x, n, above)
    assert slope == pytest.approx(2, abs=0.4) and shift == pytest.approx(-1, abs=0.3)


def test_severity_without_ratings(spark):
    df = spark.createDataFrame([(1, "a")], "pos bigint, query string")
    empty = spark.createDataFrame([], "pos bigint, rater string, category string")
    assert severity.fit(df, "pos", "query", severity.votes(empty, "pos", "rater", "category")) is None
    assert severity.severities(df, "pos", "query", None).collect()[0]["severity"] == 0


def test_votes(spark):
    v = spark.createDataFrame([(1, "a", "none"), (1, "b", "hateful"), (2, "a", " None "), (3, "a", "sexual"), (3, "a", "sexual"), (4, "a", None)], "pos int, rater string, category string")
    assert {tuple(r) for r in severity.votes(v, "pos", "rater", "category").collect()} == {(1, 2, 1, 1, 1), (2, 1, 0, 0, 0), (3, 1, 1, 1, 0)}


def test_prose_statistics():
    m = dict(zip(prose.STATS, prose.measure("Дом стоит у реки. Он большой.\n* один\n* два"), strict=True))
    assert m["n_words"] == 8 and m["lines_punctuated"] == pytest.approx(1 / 3) and m["bulleted"] == pytest.approx(2 / 3) and m["common"] == pytest.approx(2 / 10)
    assert prose.measure("") is None and prose.measure(" \n ") is None
    assert all(np.isfinite(prose.measure(t)).all() for t in [*PROSE, *JUNK, "!", "1", "\u0001", "ж" * 100_000])


def test_prose_model(spark):
    pytest.importorskip("pyarrow")
    rng = np.random.default_rng(3)
    sentences = [s.strip() + "." for t in PROSE for s in t.replace("\n", " ").split(".") if len(s.split()) > 5]
    texts = [" ".join(rng.choice(sentences, 8)) for _ in range(150)]
    junk = ["\n".join(f"{rng.integers(1000)};слово{rng.integers(50)};{rng.random():.2f}" for _ in range(20)) for _ in range(75)]
    junk += ["\n".join(f"* предмет {rng.integers(100)}" for _ in range(25)) for _ in range(75)]
    rows = [(i, t) for i, t in enumerate(texts + junk)] + [(900, None), (901, "  "), (902, texts[0] + "\n" + junk[0][:60]), (903, junk[0] * 3 + "\n" + texts[0][:60])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = prose.fit(df, "doc_id", "text")
    p = prose.prose(df, "doc_id", "text", model).toPandas().set_index("doc_id")["p_prose"]
    assert 900 not in p.index and 901 not in p.index
    assert (p.loc[range(150)] > 0.5).mean() > 0.98 and (p.loc[range(150, 300)] < 0.5).mean() > 0.98
    assert p[902] > 0.5 > p[903]
    assert prose.fit(df.where("doc_id < 0"), "doc_id", "text") is None
    assert prose.prose(df.where("doc_id < 0"), "doc_id", "text", None).count() == 0


def test_the_sample_of_documents_has_its_size(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    got = prose.sampled(df, "doc_id", "text", 500)
    assert got.count() == got.distinct().count() == 500
    assert prose.sampled(df.limit(30), "doc_id", "text", 500).count() == 30
    assert prose.sampled(df.where("doc_id < 0"), "doc_id", "text", 500).count() == 0
    for n in (10**5, 10**9, 1_2 * 10**9, 10**12, 10**15):  # the share that is taken doesn't fall to nothing
        assert n * prose._bound(10_000, n) / 2**64 == pytest.approx(10_600, rel=1e-3)
