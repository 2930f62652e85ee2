"""The words by which texts are compared: without case, punctuation, disguise and instruction."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

from corpusloom.llm.lookalike import ALIKE, FORMS, INVISIBLE, SPACES, composed_pairs


def _fold_table() -> dict[int, str | None]:
    """Lower-case letter -> the letter that stands for its look.

    Two letters have one look here if they are drawn alike in either case, so that the
    table may be applied after lower-casing.
    """
    look: dict[str, str] = {}
    for row in ALIKE:
        first = row[0].lower()
        for c in row[1:]:
            if c.lower() not in look and c.lower() != first:
                look[c.lower()] = first
    table: dict[int, str | None] = {ord(c): look.get(v, v) for c, v in look.items()}
    table |= {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in SPACES}
    for a, b in FORMS:
        for code in range(a, b + 1):
            flat = unicodedata.normalize("NFKC", chr(code)).lower()
            table[code] = "".join(look.get(c, c) for c in flat)
    for code in range(0x300, 0x370):
        table[code] = None
    table[ord("ё")] = look.get("е", "е")
    return table


FOLD = _fold_table()
_WORD = re.compile(r"[^\W_]+")
_ACCENTED = set(composed_pairs().values())


def fold(text: str) -> str:
    """One string for all texts that look alike whatever the case; stress marks and invisible characters are gone."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(_BARE) if _BARE_HAS.search(text) else text)
    return text.lower().translate(FOLD)


_BARE = {ord(c): None for c in INVISIBLE}
_BARE_HAS = re.compile(f"[{INVISIBLE}]")
_INSTRUCT = re.compile(rf"^\s*{fold('instruct')}\s*:.*?\n\s*{fold('query')}\s*:\s*", re.S)


def fold_token(token: str) -> str:
    """The fold of a lower-case token."""
    return token.translate(FOLD)


class _Folded(dict):
    """token -> its fold, remembered while the vocabulary stays small."""

    def __missing__(self, token: str) -> str:
        if len(self) >= 300_000:
            self.clear()
        out = self[token] = fold_token(token)
        return out


_folded = _Folded()
_MARKS = re.compile("[\u0300-\u036f]")


def tokens(text: str | None) -> list[str]:
    """The lower-case words of a text in order before folding; only they, not whole texts, need the look-up of letters."""
    if not text:
        return []
    if not text.isascii():
        if _BARE_HAS.search(text):
            text = text.translate(_BARE)
        if _MARKS.search(text):
            text = _MARKS.sub("", unicodedata.normalize("NFC", text))
    if fold(text[:40]).lstrip()[:8] == _INSTRUCT_START:
        text = _INSTRUCT.sub("", fold(text))
    return _WORD.findall(text.lower())


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for null and blank texts."""
    return [w for t in tokens(text) if (w := _folded[t])]


_INSTRUCT_START = fold("instruct")


class WordHashes(dict):
    """token -> 64 bits of its fold, remembered within a task as long as the vocabulary stays small."""

    def __init__(self, seed: int = 0, most: int = 1_000_000) -> None:
        self.seed, self.most = seed, most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(fold_token(token), seed=self.seed)
        return h


def word_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct words."""
    h = {hashes[t] for t in set(tokens(text))}
    return np.sort(np.fromiter(h, np.uint64, len(h)))
