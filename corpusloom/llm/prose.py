"""Running prose or something else: statistics of each document and boosted trees over them.

The statistics are computed where the documents lie.  The trees are trained on at most
MOST_WEAK weakly labelled documents of the corpus itself and on mixtures of them, whose
share of prose is known by construction; a logistic curve fitted on the hand-checked texts
of ``prose_holdout`` turns the trees' score into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.prose_holdout import JUNK, PROSE

#: Weakly labelled documents of each kind that the trees are trained on, at most; the first by a hash of the key.
MOST_WEAK = 2_500
# Common words of Russian and English that connect sentences.
COMMON = frozenset(
    """и в во на не ни что с со по как а но за из у же ли к ко от до об это этого этому этом эта эти так бы был была было были
    он она они мы вы его её им их нам все всё если чтобы потом потому тоже также однако хотя когда пока зато поэтому поскольку
    ведь тогда затем причём при под над без через между перед после уже или кто где там тут то те того тот себя свой только
    можно очень какие какой почему теперь даже лишь ещё
    the of and in to a an is was were are be for on that with as at by from it its their this these those while because so but
    until although though when whereas or not no had has have under over near after before even most they we he she""".replace("ё", "е").split()
)
STATS = (
    "n_words", "mean_word", "symbols", "digits", "uppers", "inner_uppers", "lines_punctuated", "common", "sentences", "words_a_line",
    "distinct", "top_pair", "bare_signs", "prose_share", "prose_lines", "bulleted", "vowels", "odd_tokens", "common_kinds", "short_lines", "long_gap",
)
_TOKEN_EDGE = "«»\"'()[]{}.,;:!?…—–-*•#№/|\\<>“”„"
_ENDS = ".!?…"
_LETTER, _DIGIT, _UPPER = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"[A-ZА-ЯЁÀ-ÖØ-Þ]")
_BULLET = re.compile(r"^\s*(?:[*•\-–—·]|\d{1,3}[.)])\s")
_VOWELS = frozenset("аеиоуыэюяaeiouyáéíóúèêëïîôöüà")
#: Words of one piece of a line that is judged as prose or not.
PIECE = 25


class Tokens(dict):
    """token -> (what it is, its word, common, ends a sentence, inner capitals, vowels, letters), remembered while the vocabulary stays small."""

    BARE, WORD, CODE, ODD = range(4)

    def __missing__(self, token: str) -> tuple:
        core = token.strip(_TOKEN_EDGE)
        low, kind = core.lower(), self.WORD
        if not core:
            kind = self.BARE
        elif not core.isalpha():
            kind = self.CODE if core.replace("-", "").isalnum() else self.ODD
        inner = len(token) > 2 and not token.isupper() and token[1:-1] != token[1:-1].lower() and "-" not in token
        common = kind == self.WORD and low.replace("ё", "е") in COMMON and not (len(low) == 1 and token[-1] == ".")  # an initial is no word
        head = low[:6] if kind == self.WORD else ""
        if len(self) >= 300_000:
            self.clear()
        got = self[token] = (kind, low, common, token[-1] in _ENDS and kind != self.BARE, inner, sum(c in _VOWELS for c in head), len(head))
        return got


_tokens = Tokens()


def measure(text: str) -> list[float] | None:
    """The statistics of one text, in the order of STATS; None for blank texts."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return None
    bare_kind, word, odd_kind = Tokens.BARE, Tokens.WORD, Tokens.ODD
    n_chars = prose_chars = prose_lines = punctuated = bulleted = short = 0
    plain: list[str] = []
    tokens = bare = odd = sentences = common = gap = longest_gap = inner = vowels = heads = 0
    for line in lines:
        parts = line.split()
        end = line.rstrip()
        punctuated += end[-1] in _ENDS or (end[-1] in "»\")" and end[-2:-1] in _ENDS)
        bulleted += bool(_BULLET.match(line))
        short += len(parts) < 4
        tokens += len(parts)
        line_prose = 0
        for k in range(0, len(parts), PIECE):
            piece = parts[k : k + PIECE]
            kinds, w = set(), 0
            for token in piece:
                kind, low, is_common, ends, has_inner, v, n = _tokens[token]
                sentences += ends
                inner += has_inner
                if kind == word:
                    w += 1
                    vowels += v
                    heads += n
                    plain.append(low)
                    if is_common:
                        common += 1
                        kinds.add(low)
                        gap = 0
                        continue
                elif kind == bare_kind:
                    bare += 1
                    continue
                elif kind == odd_kind:
                    odd += 1
                gap += 1
                if gap > longest_gap:
                    longest_gap = gap
            size = sum(map(len, piece)) + len(piece)
            n_chars += size
            if w >= 4 and len(kinds) >= 2 or w >= 3 and len(kinds) >= 1 and len(piece) < 12:
                prose_chars += size
                line_prose += size
        prose_lines += line_prose * 2 > len(line)
    words = len(plain)
    counts = Counter(zip(plain, plain[1:], strict=False))
    kinds = set(plain)
    letters, numbers = len(_LETTER.findall(text)), len(_DIGIT.findall(text))
    shown = sum(map(len, text.split()))
    size, some = max(1, len(text)), max(1, words)
    return [
        float(words), sum(map(len, plain)) / some, (shown - letters - numbers) / size, numbers / size,
        len(_UPPER.findall(text)) / max(1, letters), inner / max(1, tokens), punctuated / len(lines), common / max(1, tokens), sentences / max(1, tokens),
        tokens / len(lines), len(kinds) / some**0.9, max(counts.values(), default=0) / some, bare / max(1, tokens),
        prose_chars / max(1, n_chars), prose_lines / len(lines), bulleted / len(lines), vowels / max(1, heads),
        odd / max(1, tokens), len(COMMON & kinds) / some**0.5, short / len(lines), longest_gap / max(1, tokens),
    ]


@dataclass
class Trees:
    """Gradient-boosted trees of one depth over binned statistics, and the calibration of their score."""

    edges: np.ndarray  # (statistics, bins - 1)
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    slope: float = 1.0
    shift: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        b = _bins(x, self.edges)
        out = np.zeros(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - (leaf.size - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The probability that at least half of the text is prose."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.score(x) + self.shift, -40, 40)))


def _bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss with histograms of the statistics."""
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    edges = np.stack([np.quantile(x[:, j], quantiles) for j in range(x.shape[1])])
    b = _bins(x, edges)
    f = np.zeros(len(x))
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(x), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, bins, np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                if len(at) < 2:
                    continue
                flat = b[at] + np.arange(x.shape[1]) * bins
                gs = np.bincount(flat.ravel(), np.repeat(g[at], x.shape[1]), x.shape[1] * bins).reshape(-1, bins).cumsum(1)
                hs = np.bincount(flat.ravel(), np.repeat(h[at], x.shape[1]), x.shape[1] * bins).reshape(-1, bins).cumsum(1)
                G, H = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                gain[(hs < least * 0.1) | (H - hs < least * 0.1)] = -1
                j, c = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, c] > 1e-6:
                    feature[k], cut[k] = j, c
            node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
        leaf_of = node - (2**depth - 1)
        leaf = -rate * np.bincount(leaf_of, g, 2**depth) / (np.bincount(leaf_of, h, 2**depth) + 1)
        f += leaf[leaf_of]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(edges, np.array(features), np.array(cuts), np.array(leaves))


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray) -> Trees:
    """Slope and shift of a logistic curve over the score on the hand-checked texts (Platt), lightly penalised."""
    s = model.score(x)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))

    def loss(a: float, b: float) -> float:
        z = a * s + b
        return float((np.logaddexp(0, z) - target * z).sum() + (a - 1) ** 2 + 0.1 * b * b)

    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - target) * s).sum() + 2 * (a - 1), (p - target).sum() + 0.2 * b])
        hess = np.array([[(w * s * s).sum() + 2, (w * s).sum()], [(w * s).sum(), w.sum() + 0.2]])
        step = np.linalg.solve(hess, grad)
        while np.abs(step).max() > 1e-7 and loss(a - step[0], b - step[1]) > loss(a, b):
            step = step / 2
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() <= 1e-7:
            break
    model.slope, model.shift = float(max(0.05, a)), float(b)
    return model


def weak_label(stats: np.ndarray) -> np.ndarray:
    """1 for documents that are prose by several signs, 0 for those that are junk by several, -1 for others."""
    s = {name: stats[:, i] for i, name in enumerate(STATS)}
    good = (s["prose_share"] > 0.85) & (s["common"] > 0.1) & (s["bare_signs"] < 0.1) & (s["odd_tokens"] < 0.2) & (s["bulleted"] < 0.9) & (s["inner_uppers"] < 0.15)
    good &= (s["sentences"] > 0.005) & (s["common_kinds"] > 0.5)
    bad = (s["prose_share"] < 0.1) & (s["common"] < 0.06)
    bad |= (s["inner_uppers"] > 0.4) | (s["odd_tokens"] > 0.5) | (s["bare_signs"] > 0.3) & (s["sentences"] < 0.02)
    return np.where(bad, 0, np.where(good, 1, -1))


def train(texts: list[str], seed: int = 1) -> Trees | None:
    """Trees from weakly labelled texts and mixtures of them; None where one of the two kinds is missing."""
    measured = [(t, m) for t in texts if (m := measure(t))]
    if not measured:
        return None
    stats = np.array([m for _, m in measured])
    label = weak_label(stats)
    prose = [measured[i][0] for i in np.flatnonzero(label == 1)][:MOST_WEAK]
    junk = [measured[i][0] for i in np.flatnonzero(label == 0)][:MOST_WEAK]
    if not prose or not junk:
        return None
    rng = np.random.default_rng(seed)
    mixed, target = [], []
    for _ in range(MOST_WEAK):
        p, j = prose[rng.integers(len(prose))], junk[rng.integers(len(junk))]
        share = rng.uniform(0.05, 0.95)
        if abs(share - 0.5) < 0.08:
            continue
        size = min(len(p) / share, len(j) / (1 - share))
        p, j = _clip(p, int(size * share)), _clip(j, int(size * (1 - share)))
        if len(p) + len(j) < 60 or not p or not j:
            continue
        sep = "\n" if rng.random() < 0.8 else " "
        mixed.append(sep.join((p, j) if rng.random() < 0.5 else (j, p)))
        target.append(float(len(p) > len(j)))
    rows = [measure(t) for t in prose + junk + mixed]
    x = np.array(rows)
    y = np.array([1.0] * len(prose) + [0.0] * len(junk) + target)
    held = [(m, k) for k, group in ((1.0, PROSE), (0.0, JUNK)) for t in group if (m := measure(t))]
    return calibrate(boost(x, y), np.array([m for m, _ in held]), np.array([k for _, k in held]))


def _clip(text: str, size: int) -> str:
    """About the first ``size`` characters, up to a blank."""
    if len(text) <= size:
        return text
    at = max(text.rfind(" ", 0, size + 1), text.rfind("\n", 0, size + 1))
    return text[: at if at > 0 else size]


def sampled(df: DataFrame, key: str, text: str, wanted: int) -> DataFrame:
    """(t): about ``wanted`` texts that aren't blank, drawn evenly by a hash of key and text; all if there are fewer.

    The rows are counted and those below a bound of the hash taken, a fifth more than asked on
    average, so that whatever the number of rows only few come together for the last cut.
    The hash has 64 bits: the share taken is met for any number of rows.
    """
    rows = df.select(F.col(text).cast("string").alias("t"), F.xxhash64(F.lit(9), F.col(key), F.col(text)).alias("_h")).where(F.length(F.trim("t")) > 0)
    n = max(1, rows.count())
    if n > wanted:
        rows = rows.where(F.col("_h") < -(1 << 63) + min((1 << 64) - 1, _bound(wanted, n)))
    return rows.orderBy("_h", "t").limit(wanted).select("t")


def _bound(wanted: int, n: int) -> int:
    """How many of the 2^64 values of a hash give at least ``wanted`` of n rows for certain, or nearly: six deviations more than the mean."""
    return int((wanted + 6 * wanted**0.5) * (1 << 64)) // n


def fit(df: DataFrame, key: str, text: str) -> Trees | None:
    """The trees from a bounded sample of the corpus, those of either kind up to MOST_WEAK; None where it lacks one of the two kinds."""
    return train([r["t"] for r in sampled(df, key, text, 4 * MOST_WEAK).toLocalIterator()])


def prose(df: DataFrame, key: str, text: str, model: Trees | None) -> DataFrame:
    """(key, the statistics, p_prose) of each document with a text that isn't blank.

    Null and blank texts have no row.  Without a model p_prose is the share of prose itself.
    Documents are measured where they lie, without a shuffle, whatever their length.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [measure(t) if t else None for t in b.column("t").to_pylist()]
            rows = [i for i, m in enumerate(stats) if m]
            x = np.array([stats[i] for i in rows]).reshape(-1, len(STATS))
            p = x[:, STATS.index("prose_share")] if sent.value is None else sent.value.probability(x)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), *[pa.array(x[:, i]) for i in range(len(STATS))], pa.array(p)], [key, *STATS, "p_prose"])

    source = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    return source.mapInArrow(measured, ", ".join([f"{key} {dict(df.dtypes)[key]}", *[f"{s} double" for s in STATS], "p_prose double"]))
