"""Predicates, ladders of rejection reasons and their counts (P)."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def isin(df: DataFrame, **wanted: list) -> DataFrame:
    """Rows whose columns hold a wanted value; an empty list is no filter."""
    for name, values in wanted.items():
        if values:
            df = df.where(F.col(name).isin(values))
    return df


def ladder(*steps: tuple[Column, str], kept: str = "kept") -> Column:
    """The name of the first condition that holds, else ``kept`` (P2, P3); an unknown condition does not hold."""
    return reduce(lambda out, s: F.when(s[0], s[1]).otherwise(out), reversed(steps), F.lit(kept))


def quality_reason(x: str, chars: tuple[int, int] = (100, 5000), bad: float = 0.01, alpha: float = 0.55, repetition: float = 0.3) -> Column:
    """Why a text is rejected: empty, too_short, too_long, bad_chars, low_alpha, repetition; null counts as empty."""
    c = F.col(x)
    return ladder(
        (c.isNull() | (F.trim(c) == ""), "empty"), (F.length(c) < chars[0], "too_short"), (F.length(c) > chars[1], "too_long"),
        (X.bad_char_ratio(c) > bad, "bad_chars"), (X.alpha_ratio(c) < alpha, "low_alpha"), (X.repetition_ratio(c) > repetition, "repetition"),
    )


def pair_reason(query: str, positive: str, least: tuple[int, int] = (40, 60), similar: tuple[float, float] = (0.02, 0.5)) -> Column:
    """Why a pair is rejected: a missing text, the same text, a short one, a word similarity outside the window."""
    q, p = F.col(query), F.col(positive)
    kq, kp = X.alnum_key(q), X.alnum_key(p)
    sim = X.jaccard(F.array_distinct(F.split(kq, " ")), F.array_distinct(F.split(kp, " ")))
    return ladder(
        (q.isNull() | (F.trim(q) == ""), "no_query"), (p.isNull() | (F.trim(p) == ""), "no_positive"), (kq == kp, "same_text"),
        (F.length(q) < least[0], "short_query"), (F.length(p) < least[1], "short_positive"), (sim >= similar[1], "too_similar"), (sim < similar[0], "unrelated"),
    )


def reject_counts(df: DataFrame, reason: str) -> DataFrame:
    """(reason, n): kept and rejected rows add up to the input."""
    return df.groupBy(reason).agg(F.count("*").alias("n"))


def window(df: DataFrame, x: str, chars: tuple[int, int] | None = None, words: tuple[int, int] | None = None) -> DataFrame:
    """Rows whose text has lengths inside the windows, ends included; null texts are out."""
    if chars:
        df = df.where(F.length(x).between(*chars))
    if words:
        df = df.where(X.word_count(x).between(*words))
    return df


#: Marks of careless writing in social texts: smileys, brackets and exclamation marks in a row.
INFORMAL = r"[:;]-?[)(DP]|\)\)+|\(\(+|!!+|\?\?+"


def social_ok(x: str, chars: tuple[int, int] = (24, 220), words: tuple[int, int] = (4, 40), cyrillic: float = 0.6, keep_informal: bool = True) -> Column:
    """Whether a social text is fit for use (P5): lengths inside the windows, mostly Cyrillic letters, no character seven times in a row.

    A link in fewer than seven words is out, and so are three mentions in fewer than eight.
    Texts at the lower end of the words are in only if they are informal.
    """
    c = F.col(x)
    n, count = X.word_count(c), lambda p: F.regexp_count(c, F.lit(p))
    ok = F.length(c).between(*chars) & n.between(*words) & (X.cyrillic_ratio(c) >= cyrillic) & ~c.rlike(r"(?s)(.)\1{6,}")
    ok = ok & ~((count(r"https?://|www\.") > 0) & (n < 7)) & ~((count(r"@[\p{L}\p{N}_]+") >= 3) & (n < 8))
    informal = F.lit(keep_informal) & c.rlike(INFORMAL)
    return F.coalesce(ok & (informal | (n > words[0])), F.lit(False))


def neutral_ok(x: str, least: int = 80, alpha: float = 0.58) -> Column:
    """Long enough, mostly letters, without first person and emoticons."""
    f = X.features(x)
    emoticon = F.col(x).rlike(X.FEATURES["has_emoticon"])
    return F.coalesce((F.length(x) >= least) & (X.alpha_ratio(x) >= alpha) & ~f["first_person"] & ~emoticon, F.lit(False))


def exactly_one(df: DataFrame, groups: str) -> DataFrame:
    """Rows that belong to one group only."""
    return df.where(F.size(groups) == 1)


def perspective(df: DataFrame, x: str) -> DataFrame:
    """Adds perspective: own in the first person, else reported in reported speech; other rows are dropped."""
    low = F.lower(x)
    own = low.rlike(r"(^|[^\p{L}])(я|мне|меня|мы|нам)([^\p{L}]|$)")
    return df.withColumn("perspective", F.when(own, "own").when(low.rlike(X.FEATURES["reported_speech"]), "reported")).where("perspective IS NOT NULL")


def prune(df: DataFrame, array: str, keep: Callable[[Column], Column], least: int = 0, most: int | None = None) -> DataFrame:
    """Elements that fulfil ``keep``, the first ``most`` of them; rows with fewer than ``least`` are dropped, null arrays are empty."""
    kept = F.filter(F.coalesce(array, F.array().cast(df.schema[array].dataType)), keep)
    df = df.withColumn(array, kept).where(F.size(array) >= least)
    return df.withColumn(array, F.slice(array, 1, most)) if most is not None else df


def near_copy_guard(df: DataFrame, a: str, b: str, sensitive: Column, most: float = 0.98) -> DataFrame:
    """Without the rows of sensitive sources whose two texts share more than ``most`` of their words (P10)."""
    words = [F.array_distinct(F.split(X.alnum_key(c), " ")) for c in (a, b)]
    return df.where(~(sensitive & (X.jaccard(*words) > most)))


def class_threshold(df: DataFrame, score: Column, label: str, thresholds: dict, default: float) -> DataFrame:
    """Rows whose score reaches the threshold of their class."""
    bar = reduce(lambda c, kv: F.when(F.col(label) == kv[0], kv[1]).otherwise(c), thresholds.items(), F.lit(default))
    return df.where(score >= bar)


def all_of(*conditions: Column) -> Column:
    """All conditions hold; unknown ones don't."""
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def valid_tag(tag: Column, noise: list[str], least: int = 3) -> Column:
    """A tag with Cyrillic letters that is no number, no year and none of the noise."""
    flat = F.lower(F.trim(tag))
    return F.coalesce(flat.rlike(r"\p{IsCyrillic}") & ~flat.rlike(r"^[0-9\-–]+( г(од|ода)?\.?)?$") & ~flat.isin(noise) & (F.length(flat) >= least), F.lit(False))


def templates(form: str, *slots: DataFrame, most: int = 10_000_000) -> DataFrame:
    """(text): the template filled with every combination of the slots' values.

    The slots are small tables of constants; each is read once and joined by a broadcast
    product, which is what the operator asks for.  Their rows are counted first: more than
    ``most`` combinations, or 100,000 values of a slot, are an error.
    """
    if any(len(s.columns) != 1 for s in slots):
        raise ValueError("a slot has one column")
    sizes = [s.count() for s in slots]
    if math.prod(sizes) > most or max(sizes, default=0) > 100_000:
        raise ValueError(f"the slots have {sizes} values")
    product = reduce(lambda a, b: a.crossJoin(b), [s.toDF(f"_{i}") for i, s in enumerate(slots)])
    return product.select(F.format_string(form, *[F.col(f"_{i}") for i in range(len(slots))]).alias("text")).distinct()
