from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrow
from corpusloom.functions import text as X
from corpusloom.functions.names import canonical_name

TEXTS = [
    None, "", "   ", "Ёлка и ёж", "a b\tc\r\nd", "﻿BOM", "ﬁne ﬂow", "İstanbul ß", "https://x.org/a?b=c", "😀👍 ok", "\u0007bell", "�",
    "Instruct: a\nb\nQuery: что?", "Instruct: a\nQuery: Instruct: b\nQuery: c", "@user #tag [x]", "дом-музей № 5", "один два три четыре пять шесть семь",
    "да да да да да нет нет так", "!!! ???", "x" * 300 + ". " + "y" * 300, "12 месяцев", "12abc",
]


def values(spark, column, texts=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def collapse(t):
    return re.sub(r"[ \t\n\r\f\x0b\xa0﻿]+", " ", t).strip(" ")


WORD = re.compile(r"[^\W]+|[̀-ͯ]+")


def audit(t):
    t = t.lower().replace("ё", "е")
    t = re.sub(r"(https?://|www\.)[^ \t\n\r]+", " ", t)
    t = "".join(c if unicodedata.category(c)[0] in "LMN" or c in "_[]# \t\n\r" else " " for c in t)
    return collapse(t)


@pytest.mark.parametrize(
    ("make", "plain"),
    [
        (X.collapse, collapse),
        (X.audit_normal, audit),
        (X.strip_instruction, lambda t: re.sub(r"^Instruct:.*?\nQuery:[ \t]*", "", t, flags=re.S)),
        (X.alnum_key, lambda t: re.sub("[^0-9a-zа-яё]+", " ", t.lower()).strip(" ")),
        (X.slug, lambda t: re.sub("^-+|-+$", "", re.sub(r"[\W_]+", "-", "".join(c if unicodedata.category(c)[0] in "LN" else "-" for c in t.lower())))),
    ],
)
def test_normal_forms(spark, make, plain):
    assert values(spark, make("t")) == [None if t is None else plain(t) for t in TEXTS]


def test_ratios(spark):
    got = values(spark, X.cyrillic_ratio("t"))
    for t, v in zip(TEXTS, got, strict=True):
        if t is None:
            assert v is None
        else:
            letters = [c for c in t if c.isalpha()]
            assert v == pytest.approx(sum("CYRILLIC" in unicodedata.name(c) for c in letters) / len(letters) if letters else 0)
    assert values(spark, X.bad_char_ratio("t"))[1] == 1.0
    assert values(spark, X.bad_char_ratio("t"))[10] == pytest.approx(1 / 5)


def test_repetition(spark):
    got = values(spark, X.repetition_ratio("t"))
    assert got[0] is None and got[1] == 0.0 and got[16] == 0.0  # seven words
    assert got[17] == pytest.approx(5 / 8)


def test_trim_and_snippet(spark):
    t = ["a" * 65 + ". " + "b" * 60, "a" * 64 + ". " + "b" * 60, "c" * 100, None, ""]
    assert values(spark, X.trim_at_sentence("t", 100), t) == ["a" * 65 + ".", "a" * 64 + ".", "c" * 100, None, ""]
    assert values(spark, X.trim_at_sentence("t", 100, 0.7), t)[0] == ("a" * 65 + ". " + "b" * 60)[:100]
    assert values(spark, X.snippet("t", 3), ["abcdef", "abc", None]) == ["abc…", "abc", None]


def test_ngrams_tokens_keywords(spark):
    assert values(spark, X.char_ngrams("t"), ["", "abc", "abcde", None]) == [[], ["abc"], ["abcd", "bcde"], None]
    assert values(spark, X.keywords("t"), ["x\nКлючевые слова: дом, сад; дом .\ny", "none"]) == [["дом", "сад", "дом"], []]
    assert values(spark, X.leading_number("t"), ["12 месяцев", "12abc", "x 1", None, "99999999999999999999 x"]) == [12, None, None, None, None]
    assert values(spark, X.sentences("t"), ["A. B! C?", "", None]) == [["A.", "B!", "C?"], [], None]


def test_prefixes_and_modes(spark):
    assert values(spark, X.without_prefixes("t", ["q: ", "a.b "]), ["q: q: x", "axb y", "a.b q: z"]) == ["x", "axb y", "z"]
    assert values(spark, X.by_modes("t", "lower+yo+strip"), [" Ё A "]) == ["е a"]
    with pytest.raises(ValueError, match="unknown"):
        X.by_modes("t", "upper")
    assert values(spark, X.stem("t", ["ами", "ов"]), ["домами", "столами", "ов"]) == ["домами", "столами", "ов"]
    assert values(spark, X.stem("t", ["ами", "ов"]), ["капустами"]) == ["капуст"]


def test_jaccard_is_symmetric_and_bounded(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], ["a", "a"]), (None, ["a"])], "x array<string>, y array<string>")
    got = [tuple(r) for r in df.select(X.jaccard("x", "y"), X.jaccard("y", "x")).collect()]
    assert got == [(1 / 3, 1 / 3), (0.0, 0.0), (1.0, 1.0), (None, None)]


def test_arrow_functions(spark):
    assert values(spark, arrow.nfkc("t"), ["ﬁ\u0007x　y", None, ""]) == ["fi x y", None, ""]
    assert values(spark, arrow.casefold_key("t"), ["Straße", None]) == ["strasse", None]
    assert values(spark, arrow.unescape("t"), ["&lt;&#1044;&amp;nbsp;", None]) == ["<Д&nbsp;", None]
    df = spark.createDataFrame([("abc", "abc"), ("", ""), ("abcd", "bc"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(arrow.edit_ratio("a", "b")).collect()] == [1.0, 1.0, pytest.approx(2 * 2 / 6), None]
    assert [r[0] for r in df.select(arrow.partial_ratio("a", "b")).collect()][2] == 100.0
    df = spark.createDataFrame([("b a", "a b c"), ("a", "")], "a string, b string")
    assert [r[0] for r in df.select(arrow.token_set_ratio("a", "b")).collect()] == [100.0, 0.0]


def test_canonical_names(spark):
    assert values(spark, canonical_name("t"), ["It_Forum QA", " it-forum-qa ", "IT FORUM_QA", "", " ", None]) == ["it_forum_qa"] * 3 + [None] * 3


def test_lexicon_and_vote(spark):
    lex = {"it": ["сервер"], "news": ["выбор"]}
    assert values(spark, X.lexicon_groups("t", lex), ["Серверы и выборы", "обсервер", None]) == [["it", "news"], [], []]
    v = values(spark, X.vote({"a": F.length("t") - 1, "b": F.lit(1)}), ["xx", "xxx", "x"])
    assert [(r["group"], round(r["confidence"], 2)) for r in v] == [("a", 0.57), ("a", 0.69), ("b", 0.57)]


def test_compact_number(spark):
    df = spark.createDataFrame([(0.35,), (100.0,), (-0.0,), (-2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(X.compact_number("x")).collect()] == ["0p35", "100", "0", "m2p5", None]
    assert [r[0] for r in df.select(X.compact_number("x", 0)).collect()][1] == "100"


def test_valid_tags(spark):
    from corpusloom.operators import filters

    tags = ["биология", "2019", "2019 год", "что", "ai", "яд", None]
    assert values(spark, filters.valid_tag(F.col("t"), ["что"]), tags) == [True] + [False] * 6
