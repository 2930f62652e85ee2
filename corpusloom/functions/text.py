"""Text functions as column expressions, all inside the JVM.

Word characters are letters, marks, digits and the underscore of any script, written out as
``[\\p{L}\\p{M}\\p{N}_]`` since the shorthand classes of regular expressions are ASCII only.
A null text gives null unless the function says otherwise; an empty text gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]"
#: Blanks of the ASCII range, the no-break space and the byte-order mark.
BLANK = r"[ \t\n\r\f\x0B ﻿]"
URL = r"(https?://|www\.)[^ \t\n\r]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.trim(F.regexp_replace(_c(x), BLANK + "+", " "))


def fold_yo(x: Column | str) -> Column:
    """Lower case, with ё as е."""
    return F.translate(F.lower(_c(x)), "ё", "е")


def audit_normal(x: Column | str) -> Column:
    """Lower case without links and signs other than brackets and #."""
    return collapse(F.regexp_replace(F.regexp_replace(fold_yo(x), URL, " "), r"[^\p{L}\p{M}\p{N}_\[\]# \t\n\r]", " "))


def strip_instruction(x: Column | str) -> Column:
    """Without a leading 'Instruct: ... Query: ' (T12)."""
    return F.regexp_replace(_c(x), r"(?s)^Instruct:.*?\nQuery:[ \t]*", "")


def prompt_normal(x: Column | str) -> Column:
    """Without instruction, lower case, blanks collapsed, punctuation kept."""
    return collapse(fold_yo(strip_instruction(x)))


def social_normal(x: Column | str) -> Column:
    """As audit_normal, also without mentions and hash signs (T4)."""
    return collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(fold_yo(x), URL, " "), "@" + WORD + "+", " "), r"[^\p{L}\p{M}\p{N}_ ]", " "))


def alnum_key(x: Column | str) -> Column:
    """Only Latin and Russian letters and digits, lower case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^0-9a-zа-яё]+", " "))


def tfidf_normal(x: Column | str) -> Column:
    """Lower case without links; letters, digits, blanks and hyphens stay."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), URL, " "), r"[^0-9a-zа-яё \-]", " "))


def strip_tags(x: Column | str) -> Column:
    """Without markup in angle brackets, blanks collapsed (T9, tags)."""
    return collapse(F.regexp_replace(_c(x), "<[^>]+>", " "))


# The named entities that texts of this kind hold; numeric ones are left to the Python function.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&laquo;": "«", "&raquo;": "»", "&mdash;": "—", "&amp;": "&"}


def unescape_common(x: Column | str) -> Column:
    """The entities of ENTITIES resolved, the ampersand last (T9, entities)."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), _c(x))


def by_modes(x: Column | str, modes: str) -> Column:
    """Normalisation by '+'-joined flags, applied in the order strip, spaces, yo, lower, punctstrip."""
    wanted = {m for m in modes.split("+") if m}
    steps = {"strip": F.trim, "spaces": lambda c: F.regexp_replace(c, BLANK + "+", " "), "yo": lambda c: F.translate(c, "ёЁ", "еЕ"), "lower": F.lower, "punctstrip": lambda c: F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")}
    if unknown := wanted - steps.keys():
        raise ValueError(f"unknown modes: {sorted(unknown)}")
    return reduce(lambda c, m: steps[m](c) if m in wanted else c, steps, _c(x))


def with_prefix(x: Column | str, instruction: str | None = None, prefix: str = "") -> Column:
    """The text with a constant prefix, or with an instruction before it."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: " if instruction else prefix), _c(x))


def without_prefixes(x: Column | str, prefixes: list[str]) -> Column:
    """Listed prefixes removed from the start until none is left."""
    if not prefixes:
        return _c(x)
    any_of = "|".join("\\Q" + p + "\\E" for p in sorted(prefixes, key=len, reverse=True))
    return F.regexp_replace(_c(x), f"^(?:(?:{any_of})[ ]*)+", "")


def trim_at_sentence(x: Column | str, most: int, share: float = 0.65) -> Column:
    """At most ``most`` characters of the collapsed text, cut after the last sentence sign if that keeps the share."""
    flat = collapse(x)
    head = F.substring(flat, 1, most)
    back = F.reverse(head)
    last = lambda sign: F.when(F.instr(back, sign) > 0, most + 1 - F.instr(back, sign)).otherwise(0)
    at = F.greatest(last("."), last("!"), last("?"))
    return F.when(F.length(flat) <= most, flat).when(at >= share * most, F.substring(head, F.lit(1), at)).otherwise(F.rtrim(head))


def snippet(x: Column | str, most: int, more: str = "…") -> Column:
    """The collapsed text cut hard, with a sign where something was cut."""
    flat = collapse(x)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit(more)))


def tokens(x: Column | str) -> Column:
    """The runs of word characters."""
    return F.regexp_extract_all(_c(x), F.lit(f"({WORD}+)"), 1)


def token_set(x: Column | str) -> Column:
    """The different words of the audit form."""
    return F.array_distinct(tokens(audit_normal(x)))


def word_count(x: Column | str) -> Column:
    """Words of Latin or Russian letters and digits."""
    return F.regexp_count(_c(x), F.lit("[A-Za-zА-Яа-яЁё0-9]+")).cast("bigint")


def char_ngrams(x: Column | str, n: int = 4) -> Column:
    """The different character n-grams; the text itself if it is not longer than n, none if it is empty."""
    c = _c(x)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(c == "", F.array().cast("array<string>")).when(c.isNotNull(), F.array_distinct(grams))


def _count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def ratio(x: Column | str, part: str, whole: str | None = None) -> Column:
    """Characters of one class by those of another, or by all; 0 where there are none."""
    c = _c(x)
    of = _count(c, whole) if whole else F.length(c)
    return F.when(of > 0, _count(c, part) / of).otherwise(F.when(c.isNotNull(), 0.0))


def cyrillic_ratio(x: Column | str) -> Column:
    """Cyrillic letters by letters."""
    return ratio(x, r"\p{IsCyrillic}", r"\p{L}")


def alpha_ratio(x: Column | str) -> Column:
    """Letters by characters."""
    return ratio(x, r"\p{L}")


def bad_char_ratio(x: Column | str) -> Column:
    """Control, format and unassigned characters but for line break and tabulator, by characters; 1 for an empty text."""
    c = _c(x)
    return F.when(c == "", 1.0).otherwise(ratio(c, r"[\p{C}&&[^\n\t]]|�"))


def repetition_ratio(x: Column | str, least: int = 8) -> Column:
    """How often the most frequent word comes, by words; 0 for fewer than ``least`` words.

    The words are sorted once, and runs counted in one pass.
    """
    words = F.array_sort(tokens(F.lower(_c(x))))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(acc: Column, w: Column) -> Column:
        run = F.when(acc["last"] == w, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    most = F.aggregate(words, start, step, lambda acc: acc["most"])
    return F.when(F.size(words) >= least, most / F.size(words)).otherwise(F.when(_c(x).isNotNull(), 0.0))


def content_hash(*xs: Column | str) -> Column:
    """SHA-1 of the keys joined by a bar; null counts as empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(_c(x), F.lit("")) for x in xs]))


def keywords(x: Column | str, most: int = 8) -> Column:
    """The list after a line 'Ключевые слова:' or 'Keywords:', cleaned, at most ``most``."""
    line = F.regexp_extract(_c(x), r"(?i)(?:Ключевые слова|Keywords):[ \t]*([^\n]+)", 1)
    parts = F.transform(F.split(line, "[,;]"), lambda p: F.regexp_replace(collapse(p), r"[. ]+$", ""))
    return F.slice(F.filter(parts, lambda p: p != ""), 1, most)


def sentences(x: Column | str) -> Column:
    """The text cut after sentence signs that blanks follow."""
    return F.filter(F.split(_c(x), r"(?<=[.!?])[ \t\n\r]+"), lambda s: s != "")


def leading_number(x: Column | str) -> Column:
    """The whole number a text begins with, else null."""
    return F.nullif(F.regexp_extract(_c(x), r"^[ ]*([0-9]+)\b", 1), F.lit("")).try_cast("bigint")


def slug(x: Column | str) -> Column:
    """Lower-case letters and digits joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def compact_number(x: Column | str, digits: int = 6) -> Column:
    """A number for a file name: no trailing zeros, p for the point, m for the minus."""
    shown = F.regexp_replace(F.format_string(f"%.{digits}f", _c(x).cast("double")), r"(\.[0-9]*?)0+$", "$1")
    shown = F.regexp_replace(shown, r"\.$", "")
    return F.when(_c(x).isNotNull(), F.translate(F.when(shown == "-0", "0").otherwise(shown), ".-", "pm"))


def stem(x: Column | str, endings: list[str], least: int = 5) -> Column:
    """Without the first listed ending that leaves ``least`` letters (T25); the order of the list matters."""
    c = _c(x)
    out = c
    for e in reversed(endings):
        out = F.when(c.endswith(e) & (F.length(c) - len(e) >= least), F.substring(c, F.lit(1), F.length(c) - len(e))).otherwise(out)
    return out


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared by all elements of two sets; 0 if both are empty."""
    x, y = _c(a), _c(b)
    both = F.size(F.array_intersect(x, y))
    either = F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - both
    return F.when(either > 0, both / either).otherwise(F.when(x.isNotNull() & y.isNotNull(), 0.0))


def replace_first(x: Column | str, pattern: str, new: str) -> Column:
    """Only the first match replaced."""
    c = _c(x)
    return F.regexp_replace(c, f"(?s)^(.*?)(?:{pattern})(.*)$", f"$1{new}$2")


def crop(x: Column | str, first: int, last: int) -> Column:
    """Without the first and last sentences; the text itself where too few are left."""
    s = sentences(x)
    kept = F.slice(s, F.lit(first + 1), F.greatest(F.size(s) - first - last, F.lit(0)))
    return F.when(F.size(s) > first + last, F.array_join(kept, " ")).otherwise(_c(x))


# Patterns of the boolean features of short social texts.
FEATURES = {
    "has_question": r"\?",
    "has_exclaim": r"!",
    "has_ellipsis": r"\.\.\.|…",
    "has_url": r"https?://|www\.",
    "has_mention": r"@[A-Za-zА-Яа-я0-9_]+",
    "has_hashtag": r"#[A-Za-zА-Яа-я0-9_]+",
    "has_emoticon": r"[:;][\-]?[)(DP]|\)\)+|\(\(+",
    "has_digit": r"[0-9]",
    "has_quote": r"[«»\"]",
    "first_person": r"(^|[^\p{L}])(я|мне|меня|мой|моя|мы|нам|нас|наш)([^\p{L}]|$)",
    "reported_speech": r"по словам|сообщил|заявил|рассказал|according to",
}


def features(x: Column | str) -> dict[str, Column]:
    """Boolean features of a text by pattern, on the lower-case text (T23); null texts have none."""
    low = F.lower(_c(x))
    return {name: F.coalesce(low.rlike(p), F.lit(False)) for name, p in FEATURES.items()}


def lexicon_groups(x: Column | str, lexicon: dict[str, list[str]]) -> Column:
    """The groups of which a stem begins a word of the text, in the order of the lexicon (T24); an empty list for null."""
    low = fold_yo(x)
    hits = [F.when(low.rlike(r"(^|[^\p{L}\p{N}_])(" + "|".join(stems) + ")"), F.lit(g)) for g, stems in lexicon.items()]
    return F.filter(F.array(*hits), lambda g: g.isNotNull())


def vote(hits: dict[str, Column], base: float = 0.45, step: float = 0.12, most: float = 0.98) -> Column:
    """(group, confidence) of the group with the most votes, ties to the least name; null without votes."""
    best = F.array_max(F.array(*[F.struct(n.cast("double").alias("score"), F.lit(-i).alias("order"), F.lit(g).alias("group")) for i, (g, n) in enumerate(sorted(hits.items()))]))
    return F.when(best["score"] > 0, F.struct(best["group"].alias("group"), F.least(F.lit(most), base + step * best["score"]).alias("confidence")))
