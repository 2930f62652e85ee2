"""Texts that look alike but are written with other characters.

Look-alike classes are the connected components of a union-find over strings and code
points: a full-width form joins its ordinary form, a letter with a combining accent its
single character, a strange space the ordinary one, an invisible character the empty
string, and a letter the letters of other scripts that are drawn like it: those one cannot
tell apart in print, and in a wider sense all that the public confusables data (UTS 39, as
the ICU library of the JVM has them) give one skeleton.  In each class the ordinary letter
seen most often in the corpus represents the class, separately for each script and case;
forms that exist for compatibility only never do.  An Aho-Corasick automaton for
the script of a word rewrites the word greedily, longest match first.

What stays as it is: foreign words, names and symbols in their own script, emoji with
their joiners, stress marks (an accent that has no single character with its letter),
ordinary signs, line breaks and doubled blanks.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import cut

# Letters of Latin, Cyrillic and Greek that are drawn alike (public confusables of UTS 39,
# reduced to letters one cannot tell apart in print). One row, one look.
ALIKE = (
    "AАΑ", "BВΒ", "CС", "EЕΕ", "HНΗ", "IІΙ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "SЅ", "TТΤ", "XХΧ", "YУΥ", "ZΖ",
    "aаα", "cсϲ", "eе", "iіι", "jј", "oоο", "pрρ", "sѕ", "xхχ", "yу", "vν", "hһ",
)
#: Characters that show nothing and change no neighbour (soft hyphen, joiners, marks of direction, fillers).
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯ㅤ︎️﻿ﾠ"
#: Spaces other than the ordinary one; line breaks and the tabulator are none.
SPACES = "               　"
#: Fixed ranges: presentation forms that stand for ordinary characters.
FORMS = ((0xFB00, 0xFB06), (0xFF01, 0xFF5E), (0xFFE0, 0xFFE6), (0x1D400, 0x1D7FF), (0x210A, 0x210D), (0x2110, 0x2112), (0x211B, 0x211D), (0x2130, 0x2133))
#: Ranges of letters that may have look-alikes in the wider sense; right-to-left scripts are none.
LETTERS = ((0x41, 0x530), (0x531, 0x590), (0xB00, 0xD80), (0x1000, 0x1100), (0x1200, 0x1800), (0x1D00, 0x2000), (0x2C00, 0x2E00), (0xA4D0, 0xA830), (0xAB30, 0xABC0), (0x10280, 0x10600), (0x118A0, 0x11900))
#: Ranges of the ordinary letters of the scripts that words are brought to.
ORDINARY = {"Latn": ((0x41, 0x17F),), "Cyrl": ((0x400, 0x45F), (0x490, 0x4F9)), "Grek": ((0x386, 0x3CE),)}
#: So many letters of its own script a word must have before an ordinary letter of another counts as a look-alike in the wider sense.
ENOUGH = 3
#: Whole words of look-alike letters that are rewritten everywhere, at most; more are an error.
MOST_WORDS = 1_000_000
SCRIPTS = {"Latn": r"\p{Latin}", "Cyrl": r"\p{Cyrillic}", "Grek": r"\p{Greek}"}

_EMOJI = r"(?:[\p{Extended_Pictographic}--[©®0-9#*]][︎️\U0001f3fb-\U0001f3ff]*|[\U0001f1e6-\U0001f1ff]{2}|[0-9#*]️?⃣)"
EMOJI = regex.compile(rf"(?V1){_EMOJI}(?:‍{_EMOJI})*|[©®]️")
_FORM_CLASS = "".join(f"{chr(a)}-{chr(b)}" for a, b in FORMS)
#: Anything that the first automaton may have to rewrite.
STRANGE = regex.compile(rf"[{_FORM_CLASS}{INVISIBLE}{SPACES}]|[^\W\d_]\p{{M}}")
WORD = regex.compile(r"[\p{L}\p{M}]+")
_SCRIPT_OF = {s: regex.compile(p) for s, p in SCRIPTS.items()}
#: A text needs the look at its words only if it mixes scripts.
_LATIN, _CYRILLIC, _GREEK = (_SCRIPT_OF[s] for s in ("Latn", "Cyrl", "Grek"))
_ALIKE_LATIN = "".join(row[0] for row in ALIKE)
_ALIKE_OTHER = "".join(row[1:] for row in ALIKE)
_CLASS = _FORM_CLASS + INVISIBLE + SPACES
_CYR, _GRK, _LAT = "\u0400-\u052f", "\u0370-\u03ff\u1f00-\u1fff", "A-Za-z\u00c0-\u024f"
#: A text that this doesn't find needs no change: strange characters, an accent after a letter, a word of two
#: scripts, or a word of look-alike letters beside a word of another script.
SUSPECT = re.compile(
    rf"[{_CLASS}]|[^\W\d_][\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff]|[{_LAT}][{_CYR}{_GRK}]|[{_CYR}][{_LAT}{_GRK}]|[{_GRK}][{_LAT}{_CYR}]|[οΟ]"
    rf"|(?<!\w)[{_ALIKE_LATIN}]+[^\w{_LAT}{_CYR}]+[{_CYR}]|[{_CYR}]\W+[{_ALIKE_LATIN}]+(?!\w)"
    rf"|(?<!\w)[{_ALIKE_OTHER}]+\W+[{_LAT}]|[{_LAT}]\W+[{_ALIKE_OTHER}]+(?!\w)"
    rf"|(?<!\w)(?:[{_ALIKE_LATIN}]+|[{_ALIKE_OTHER}]+)\W+\w*\d"
)


def may_change(c: Column) -> Column:
    """Whether a text may need a change, for the scan: it holds more than ASCII; SUSPECT tells the rest."""
    return c.rlike("[^\\x00-\\x7F]")


def script_of(ch: str) -> str:
    code = ord(ch)
    if code < 0x250:
        return "Latn" if ch.isalpha() else "Zyyy"
    for name, pattern in _SCRIPT_OF.items():
        if pattern.match(ch):
            return name
    return "Zyyy"


def is_ordinary(ch: str, script: str | None = None) -> bool:
    """Whether a letter is an ordinary one of the script, or of any that words are brought to."""
    return any(a <= ord(ch) <= b for s in ([script] if script else ORDINARY) for a, b in ORDINARY[s])


def skeletons(spark: SparkSession) -> dict[str, str]:
    """Letter -> its skeleton by the public confusables data, of all letters that may have look-alikes."""
    chars = [chr(c) for a, b in LETTERS for c in range(a, b) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo")]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    found = checker.getSkeleton("\n".join(chars)).split("\n")
    return dict(zip(chars, found, strict=True))


class UnionFind:
    """Disjoint sets over strings; the smaller root wins, so classes don't depend on the order of unions."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a

    def classes(self) -> list[list[str]]:
        groups: dict[str, list[str]] = {}
        for x in self.parent:
            groups.setdefault(self.find(x), []).append(x)
        return [sorted(g) for _, g in sorted(groups.items())]


def composed_pairs() -> dict[str, str]:
    """Letter and accent of Latin, Cyrillic and Greek -> the one character for both, from the Unicode database."""
    out = {}
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        ch = chr(code)
        two = unicodedata.normalize("NFD", ch)
        if len(two) > 1 and unicodedata.normalize("NFC", two) == ch:
            out[two] = ch
            base = unicodedata.normalize("NFC", two[:-1])
            if base != two[:-1]:
                out[base + two[-1]] = ch
    return out


class LookalikeModel:
    """Look-alike classes with their representatives and automata.

    counts: how often each form (a character, a letter with its accents, or as 'script:word' a
    word of look-alike letters before a word of the script) occurs in the corpus.  Forms
    that exist for compatibility only never represent a class.  skeletons: letter -> skeleton,
    for look-alikes in the wider sense.  decided: 'script:word' of words that are to be
    rewritten to the script.
    """

    def __init__(self, counts: dict[str, int] | None = None, skeletons: dict[str, str] | None = None, decided: frozenset[str] = frozenset()) -> None:
        counts = counts or {}
        uf = UnionFind()
        ordinary: set[str] = {"", " "}
        for c in SPACES:
            uf.union(c, " ")
        for c in INVISIBLE:
            uf.union(c, "")
        for a, b in FORMS:
            for code in range(a, b + 1):
                c, plain = chr(code), unicodedata.normalize("NFKC", chr(code))
                if plain != c:
                    uf.union(c, plain)
                    ordinary.add(plain)
        for two, one in composed_pairs().items():
            uf.union(two, one)
            ordinary.add(one)
        for row in ALIKE:
            for c in row[1:]:
                uf.union(row[0], c)
            ordinary.update(row)
        self.classes = [g for g in uf.classes() if len(g) > 1]
        self.alike = {c for row in ALIKE for c in row}

        def script(member: str) -> str:
            return script_of(member[0]) if member and unicodedata.normalize("NFKC", member)[0] == member[0] else "Zyyy"

        common: dict[str, str] = {}
        by_script: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
        for group in self.classes:
            if "" in group or " " in group:
                keep = "" if "" in group else " "
                common |= {m: keep for m in group if m != keep}
                continue
            # forms of one look within one script, and presentation forms, are rewritten everywhere
            plain: dict[str, list[str]] = {}
            for m in group:
                flat = unicodedata.normalize("NFKC", m)
                plain.setdefault(script_of(flat[0]) if flat else "Zyyy", []).append(m)
            for s, members in plain.items():
                best = {}
                for m in members:  # members that are equal but for their form
                    best.setdefault(unicodedata.normalize("NFKC", m), []).append(m)
                for flat, forms in best.items():
                    keep = max(forms, key=lambda m: (m in ordinary, counts.get(m, 0), m == flat, m))
                    common |= {m: keep for m in forms if m != keep}
            # letters of other scripts are rewritten only inside a word of the script
            for s in SCRIPTS:
                own = [m for m in group if script(m) == s and m in self.alike]
                if not own:
                    continue
                keep = max(own, key=lambda m: (counts.get(m, 0), m))
                by_script[s] |= {m: keep for m in group if m not in own and script(m) != s and m in self.alike}
        self._build(common, by_script, self._wider(skeletons or {}, by_script, counts), counts, decided)

    def _wider(self, skeletons: dict[str, str], by_script: dict[str, dict[str, str]], counts: dict[str, int]) -> dict[str, dict[str, str]]:
        """For each script: letter -> the ordinary letter of the script and case with the same skeleton that is seen most often."""
        uf = UnionFind()
        for c, skeleton in skeletons.items():
            uf.union(f"={skeleton}", c)
        out: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
        for group in uf.classes():
            letters = [m for m in group if len(m) == 1]
            for s in SCRIPTS:
                own = [m for m in letters if is_ordinary(m, s)]
                for m in letters:
                    kind = unicodedata.category(m)
                    fit = [c for c in own if kind == "Lo" or unicodedata.category(c) == kind]
                    if fit and not is_ordinary(m, s) and script_of(m) != s and m not in by_script[s] and len({unicodedata.category(c) for c in fit}) == 1:
                        out[s][m] = max(fit, key=lambda c: (counts.get(c, 0), -ord(c)))
        return out

    def _build(self, common: dict, by_script: dict, wider: dict, words: dict, decided: frozenset[str]) -> None:
        self.common_map, self.script_map, self.wider_map, self.decided = common, by_script, wider, decided
        self.alike = {c for row in ALIKE for c in row}
        self._common = self._automaton(common)
        self._script = {s: self._automaton(m) for s, m in by_script.items()}
        #: whole words of look-alike letters only: the spelling seen most often before a word of the script decides
        self.words = words
        #: letters of other scripts and alphabets that only the wider classes have
        self.foreign = {c for m in wider.values() for c in m if not is_ordinary(c)}
        self._foreign = re.compile(f"[{re.escape(''.join(sorted(self.foreign)))}]") if self.foreign else None

    def suspect(self, text: str) -> bool:
        """Whether the text may need a change."""
        return bool(SUSPECT.search(text) or self._foreign and self._foreign.search(text))

    def maps(self) -> tuple[dict, dict, dict, dict, frozenset[str]]:
        return self.common_map, self.script_map, self.wider_map, {w: n for w, n in self.words.items() if w[4:5] == ":"}, self.decided

    @staticmethod
    def _automaton(mapping: dict[str, str]) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for k, v in mapping.items():
            a.add_word(k, (len(k), v))
        a.make_automaton()
        return a

    @staticmethod
    def _rewrite(a: ahocorasick.Automaton, text: str) -> str:
        out, at = [], 0
        for end, (n, new) in a.iter_long(text):
            out += (text[at : end - n + 1], new)
            at = end + 1
        return "".join((*out, text[at:])) if out else text

    def normalize(self, text: str) -> str:
        """The text in its one consistent form."""
        if text.isascii():
            return text
        if STRANGE.search(text):
            parts, at = [], 0
            for m in EMOJI.finditer(text):
                parts += (self._plain(text[at : m.start()]), m.group())
                at = m.end()
            text = "".join((*parts, self._plain(text[at:])))
        if bool(_LATIN.search(text)) + bool(_CYRILLIC.search(text)) + bool(_GREEK.search(text)) > 1 or self._foreign and self._foreign.search(text):
            text = self._words(text)
        return text

    def _plain(self, text: str) -> str:
        before = None
        while before != text:  # an accent may follow a character that was just removed or composed
            before, text = text, self._rewrite(self._common, text)
        return text

    def _words(self, text: str) -> str:
        found = list(WORD.finditer(text))
        scripts = [{script_of(c) for c in m.group() if c.isalpha()} - {"Zyyy"} for m in found]
        strange = [bool(self._foreign and self._foreign.search(m.group())) for m in found]
        out, at, changed = [], 0, False
        for i, m in enumerate(found):
            word, have = m.group(), scripts[i]
            target = None
            if len(have) > 1 or have and strange[i]:
                target = self._target(word) or (None if self._formula(word) else self._around(text, found, scripts, i) or "Cyrl")
            elif have and all(c in self.alike or not c.isalpha() for c in word):
                target = self._whole(text, found, scripts, i, next(iter(have)))
            if target and (strange[i] or target not in (have if len(have) == 1 else ())):
                new = self._plain(self._widened(self._rewrite(self._script[target], word), target))
                if new != word:
                    out += (text[at : m.start()], new)
                    at, changed = m.end(), True
        return "".join((*out, text[at:])) if changed else text

    def _widened(self, word: str, target: str) -> str:
        """The word without look-alikes in the wider sense; ordinary letters of other scripts are such only among enough of the target's."""
        wider = self.wider_map[target]
        if not any(c in wider for c in word):
            return word
        enough = sum(is_ordinary(c, target) for c in word) >= ENOUGH
        return "".join(wider[c] if c in wider and (enough or not is_ordinary(c)) else c for c in word)

    def _target(self, word: str) -> str | None:
        """The script of the letters that have no look-alike; among several, the one with most letters."""
        n = Counter(script_of(c) for c in word if c.isalpha() and c not in self.alike and c not in self.foreign)
        n.pop("Zyyy", None)
        if self._formula(word):
            return None
        if not n:
            return None
        most = max(n.values())
        best = sorted(s for s, k in n.items() if k == most)
        return "Cyrl" if "Cyrl" in best else best[0]

    def _formula(self, word: str) -> bool:
        """Whether one Greek letter without look-alike stands beside Latin letters, as in formulas."""
        own = [c for c in word if c.isalpha() and c not in self.alike and c not in self.foreign]
        return sum(script_of(c) == "Grek" for c in own) == 1 and all(script_of(c) == "Grek" or c.isascii() for c in own) and any(c.isascii() for c in word)

    def _around(self, text: str, found: list, scripts: list[set[str]], i: int, agreed: bool = False) -> str | None:
        """The script of the next word, else of the one before; with ``agreed`` none if the two differ.

        Parts of codes with digits and of words joined by a hyphen don't count.
        """
        sides = []
        for js in (range(i + 1, len(found)), range(i - 1, -1, -1)):
            for j in js:
                a, b = found[j].span()
                before, after = text[a - 1 : a], text[b : b + 1]
                if before.isdigit() or after.isdigit() or before == "-" or after == "-":
                    continue
                if s := self._target(found[j].group()):
                    sides.append(s)
                    break
        return sides[0] if sides and not (agreed and len(set(sides)) > 1) else None

    def _whole(self, text: str, found: list, scripts: list[set[str]], i: int, own: str) -> str | None:
        """For a word of one script whose letters all have look-alikes: the script it should be in, if not its own."""
        a, b = found[i].span()
        word = found[i].group()
        joined = (a and (text[a - 1].isalnum() or text[a - 1] in "-+#/°_@")) or (b < len(text) and (text[b].isalnum() or text[b] in "-+#/_"))
        if joined or (own == "Grek" and word not in "οΟ"):
            return None
        s = self._around(text, found, scripts, i, agreed=True)
        if not s or s == own:
            return None
        if not word.islower():  # a capital letter stands for itself unless it begins a sentence
            begins = not text[:a].strip() or text[:a].rstrip()[-1] in ".!?…\n:—"
            if not begins or not word[1:].islower() and len(word) > 1 or i + 1 >= len(found) or not found[i + 1].group().islower() or text[b : b + 1] != " ":
                return None
        other = self._rewrite(self._script[s], word)
        if not any(script_of(c) == s for c in other):
            return None
        if f"{s}:{word}" in self.decided:
            return s
        seen, seen_other = (sum(self.words.get(f"{s}:{x}", 0) for x in {w.lower(), w.upper()}) for w in (word, other))
        # without counts only one-letter words are taken for disguised
        return s if (seen_other > seen if seen or seen_other else len(word) == 1) else None


def forms_in(texts: Iterable[str | None], alike: set[str]) -> Counter:
    """Counts of characters, accented letters, and words of look-alike letters as 'script:word'."""
    n: Counter = Counter()
    joined = "\n".join(t for t in texts if t)
    n.update(joined)
    if regex.search(r"\p{M}", joined):
        n.update(regex.findall(r"\p{L}\p{M}+", joined))
    n.update(regex.findall(r"ff[il]?|f[il]|st", joined))
    one = "".join(sorted(alike))
    # a word of look-alike letters counts for the script of the word after it
    for word, after in regex.findall(rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])([{one}]++)(?=[^\p{{L}}\p{{N}}\n]{{1,3}}(\p{{L}}))", joined):
        n[f"{script_of(after)}:{word}"] += 1
    return n


def count_forms(df: DataFrame, fields: list[str]) -> DataFrame:
    """(form, n) over every text of the fields: characters, letters with accents and words of look-alike letters of any length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alike = {c for row in ALIKE for c in row}
        total: Counter = Counter()
        for b in batches:
            for k in range(b.num_columns):
                total.update(forms_in(b.column(k).to_pylist(), alike))
            if len(total) > 300_000:
                yield pa.RecordBatch.from_pydict({"form": list(total), "n": pa.array(list(total.values()), pa.int64())})
                total.clear()
        if total:
            yield pa.RecordBatch.from_pydict({"form": list(total), "n": pa.array(list(total.values()), pa.int64())})

    counted = df.select(*[F.col(f).cast("string").alias(f"_{i}") for i, f in enumerate(fields)]).mapInArrow(count, "form string, n bigint")
    return counted.groupBy("form").agg(F.sum("n").alias("n"))


def decided_words(forms: DataFrame, script_map: dict[str, dict[str, str]]) -> DataFrame:
    """(word): 'script:word' of the words of look-alike letters of which the spelling in the script of the word after them is the more frequent one there.

    Counts are compared without case by joins, so their number isn't bounded; only the words
    that lose are a result.
    """
    w = forms.where(F.col("form").rlike("^(" + "|".join(SCRIPTS) + "):")).select(F.substring("form", 1, 4).alias("s"), F.expr("substring(form, 6)").alias("w"), "n")
    lower = w.groupBy("s", F.lower("w").alias("l")).agg(F.sum("n").alias("n"))
    other = F.col("w")
    for s, m in script_map.items():
        other = F.when(F.col("s") == s, F.translate("w", "".join(m), "".join(m.values()))).otherwise(other)
    each = w.select("s", "w", other.alias("o")).where("o != w").distinct()
    side = lambda c, n: lower.select("s", F.col("l").alias(f"_{c}"), F.col("n").alias(n))
    both = each.withColumn("_w", F.lower("w")).withColumn("_o", F.lower("o")).join(side("w", "own"), ["s", "_w"]).join(side("o", "others"), ["s", "_o"])
    return both.where("others > own").select(F.concat_ws(":", "s", "w").alias("word"))


def fit(df: DataFrame, fields: list[str]) -> LookalikeModel:
    """The model with representatives chosen by the frequencies in all texts of ``fields``."""
    known = skeletons(df.sparkSession)
    plain = LookalikeModel(skeletons=known)
    members = {m for group in plain.classes for m in group} | {" "} | {v for m in plain.wider_map.values() for v in m.values()} | {c for c in known if is_ordinary(c)}
    forms = cut(count_forms(df, fields), "forms")
    short = forms.where(F.length("form") <= 6)  # single members, and one-letter words with their script
    counts = {r["form"]: r["n"] for r in short.toLocalIterator() if r["form"] in members or r["form"][4:5] == ":"}
    words = decided_words(forms, plain.script_map).limit(MOST_WORDS + 1).collect()
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} disguised words")
    return LookalikeModel(counts, known, frozenset(r["word"] for r in words))


def unify(df: DataFrame, fields: list[str], key: str, model: LookalikeModel | None = None) -> DataFrame:
    """One row per record and field whose text had to change: key, field, old, new.

    Null and empty texts never change.  Rows are handled one by one, without a shuffle; texts
    of ASCII alone don't leave the scan, and of the others one search finds those to work on.
    """
    model = model or fit(df, fields)
    sent = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.maps()))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old")) for f in fields]))
    suspects = df.select(F.col(key).alias("_key"), pairs.alias("_p")).select("_key", "_p.field", "_p.old").where(may_change(F.col("old")))
    key_type = dict(df.dtypes)[key]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = rebuild(sent)
        for b in batches:
            old = b.column("old").to_pylist()
            new = [m.normalize(t) if m.suspect(t) else t for t in old]
            keep = pa.array([a != b for a, b in zip(old, new, strict=True)])
            yield b.append_column("new", pa.array(new, pa.string())).filter(keep)

    return suspects.mapInArrow(rewrite, f"_key {key_type}, field string, old string, new string").withColumnRenamed("_key", key)


def unified(df: DataFrame, fields: list[str], key: str, model: LookalikeModel | None = None) -> DataFrame:
    """(key, fields, changed): every record with its texts in their one form, and the names of the fields that had to change; one pass, no shuffle."""
    model = model or fit(df, fields)
    sent = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.maps()))
    texts = ", ".join(f"`{f}` string" for f in fields)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = rebuild(sent)
        for b in batches:
            old = [b.column(i + 1).to_pylist() for i in range(len(fields))]
            new = [[m.normalize(t) if t and not t.isascii() and m.suspect(t) else t for t in texts] for texts in old]
            changed = [",".join(f for f, a, c in zip(fields, x, y, strict=True) if a != c) for x, y in zip(zip(*old, strict=True), zip(*new, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(t, pa.string()) for t in new], pa.array(changed, pa.string())], [key, *fields, "changed"])

    source = df.select(F.col(key), *[F.col(f).cast("string") for f in fields])
    return source.mapInArrow(rewrite, f"{key} {dict(df.dtypes)[key]}, {texts}, changed string")


_built: dict[str, LookalikeModel] = {}


def rebuild(sent) -> LookalikeModel:
    """The model from its broadcast mappings, built once per worker."""
    mark, maps = sent.value
    if mark not in _built:
        _built.clear()
        m = LookalikeModel.__new__(LookalikeModel)
        m._build(*maps)
        _built[mark] = m
    return _built[mark]
