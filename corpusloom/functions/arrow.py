"""Text functions that Spark lacks, as Arrow-batched UDFs: Unicode forms, entities, edit ratios."""

from __future__ import annotations

import difflib
import html
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _each(f):
    return lambda s: s.map(f, na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility form, control characters as spaces, blanks collapsed (T5)."""
    return _each(lambda t: " ".join("".join(" " if unicodedata.category(c) == "Cc" else c for c in unicodedata.normalize("NFKC", t)).split()))(s)


@F.pandas_udf(T.StringType())
def casefold_key(s: pd.Series) -> pd.Series:
    """The key of two texts that are equal without case (T5)."""
    return _each(lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()))(s)


@F.pandas_udf(T.StringType())
def fair_normal(s: pd.Series) -> pd.Series:
    """Compatibility form, lower case, ё as е, blanks collapsed."""
    return _each(lambda t: " ".join(unicodedata.normalize("NFKC", t).lower().replace("ё", "е").split()))(s)


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """All named and numeric entities resolved."""
    return _each(html.unescape)(s)


@F.pandas_udf(T.DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in the longest matching blocks of two texts (V27); null if either is."""
    return pd.Series([None if pd.isna(x) or pd.isna(y) else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _ratio(x: str, y: str) -> float:
    return 100 * difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x or y else 100.0


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: the best of comparing the shared words with the shared words and the rest of either text."""

    def one(x: str, y: str) -> float:
        p, q = set(x.split()), set(y.split())
        both, left, right = (" ".join(sorted(s)) for s in (p & q, p - q, q - p))
        if not p or not q:
            return 0.0
        if both and (not left or not right):
            return 100.0
        whole = [f"{both} {r}".strip() for r in (left, right)]
        return max([_ratio(whole[0], whole[1]), *(_ratio(both, w) for w in whole if both)])

    return pd.Series([None if pd.isna(x) or pd.isna(y) else one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: the shorter text against its best window in the longer one."""

    def one(x: str, y: str) -> float:
        x, y = sorted((x, y), key=len)
        if not x:
            return 0.0
        starts = {max(0, m.b - m.a) for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()}
        return max([_ratio(x, y[s : s + len(x)]) for s in starts])

    return pd.Series([None if pd.isna(x) or pd.isna(y) else one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _grams(code: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of k characters, built from those of 1, 2, 4, ... characters."""
    part, size, out, done = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1, None, 0
    while True:
        if k & size:
            n = len(code) - done - size + 1
            out = part[done : done + n].copy() if out is None else _stir(out[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + part[done : done + n])
            done += size
        if done == k:
            return out
        part = _stir(part[:-size] * np.uint64(0xFF51AFD7ED558CCD) + part[size:])
        size *= 2


def _stir(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbouring numbers."""
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return h if size == w else np.minimum(h[: len(h) - (w - size)], h[w - size :])


def anchors(least: int, first: bool = False):
    """A function from texts to marks of their stretches (winnowing, Schleimer and others 2003); none for shorter texts and null.

    Of every stretch of ``least`` characters the least hash of its parts of half that length
    is a mark; so texts that share such a stretch share the mark of it, though a text has
    few marks for its length.  With ``first`` only the mark of the first stretch.
    """
    k = max(1, least // 2)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def marks(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            if t is None or len(t) < least:
                out.append([])
                continue
            code = np.frombuffer((t[:least] if first else t).encode("utf-32-le", "surrogatepass"), np.uint32)
            out.append(np.unique(_least(_grams(code, k), least - k + 1)).view(np.int64))
        return pd.Series(out)

    return marks
