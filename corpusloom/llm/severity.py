"""Severity of abusive, hateful and sexually explicit language.

A cumulative-link (proportional odds) ordinal regression over hashed sparse text features:
P(grade > k) = sigmoid(w.x - t_k) with one weight vector w for all ordered thresholds t_k.
The grades are the categories of the raters in the order in which they weigh (GRADE); the
raters' error rates are estimated from the records that several of them rated, and the
scores are calibrated on ratings held out.  The model is fitted on the driver on at most
MOST_LABELLED rated records and then scores every record where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.sketch import _mix
from corpusloom.llm.words import _INSTRUCT, _INSTRUCT_START, fold

#: Rated records the model is fitted on, at most; the first by a hash of the key.
MOST_LABELLED = 60_000
#: Hashed features: 2^BITS weights.
BITS = 19
#: Lengths of the character n-grams of the folded text, and of the word n-grams.
CHARS, WORDS = (3, 4, 5), (1, 2, 3)
#: Grades of the categories: insults and threats to persons, explicit content, hate against groups.
GRADE = {"abusive": 1, "sexual": 2, "hateful": 3}
GRADES = 4
#: How much the thresholds weigh in the fit of the shared weights: whether a text offends at all comes first.  Alike, they would
#: pull insults down to their grade between two thresholds, and blur the first one.
WEIGHTS = np.array([1.8, 0.1, 0.1])
#: What is assumed of the raters' errors before any are seen: the share of wrong ratings, and how many ratings that belief weighs.
ERRORS, BELIEF = 0.05, 40
#: One in so many rated records is held out for the calibration.
HELD_OUT = 5
#: Penalty on the squared weights, in records.
RIDGE = 0.25
#: Share of the rated records in which a feature must occur, in two at least.
LEAST = 6e-4
#: Probability of a grade above none, calibrated on held-out ratings, above which a record counts as offending.  A little over a
#: half: the model that scores has seen the held-out ratings too, and is surer of itself than the one that was calibrated.
OFFENDING = 0.6
#: A clause has about this many words at least.
CLAUSE = 4
_U = np.uint64

_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][\-_.* ]){2,}[^\W\d_](?![^\W_])")
_REPEAT = re.compile(r"(\w)\1+")
_CODE = re.compile(r"\S*\d\S*")
_BREAK = re.compile(r"[.!?…,;:()\[\]\n\r«»\"/#@]+|\s[—–-]+\s")
_OTHER = re.compile(r"[^\w*]+|_+")
_MASKED = re.compile(r"(?<=[^\W\d_])[*#@$_](?=[^\W\d_])")


def clauses(text: str | None) -> list[str]:
    """The folded text in clauses, without instruction, codes and punctuation.

    Letters set apart are joined and repeated ones written once; a sign inside a word, as if
    to hide a letter, becomes '*'.  A clause too short to judge is joined with the next.
    """
    if not text:
        return []
    t = fold(text)
    if t.lstrip()[:8] == _INSTRUCT_START:
        t = _INSTRUCT.sub("", t)
    t = _SPACED.sub(lambda m: re.sub(r"[\-_.* ]", "", m.group()), t)
    t = _MASKED.sub("*", t)
    out, held = [], ""
    for part in _BREAK.split(t):
        part = _OTHER.sub(" ", _CODE.sub(" ", _REPEAT.sub(r"\1", part))).strip()
        if not part:
            continue
        held = f"{held} {part}" if held else part
        if held.count(" ") + 1 >= CLAUSE:
            out.append(f" {held} ")
            held = ""
    if held:
        out.append(f" {held} ")
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) numbers of every n-gram of characters and words in the texts."""
    joined = "\x01".join(texts) + "\x01"
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = code == 1
    owner = np.concatenate(([0], np.cumsum(end)[:-1]))
    space = code == 32
    parts, owners = [], []
    h = code.copy()
    for n in range(2, max(CHARS) + 1):
        h = _mix(h[: len(code) - n + 1] * _U(0x9E3779B97F4A7C15) + code[n - 1 :])
        if n in CHARS:
            ok = owner[: len(h)] == owner[n - 1 :]
            parts.append(h[ok])
            owners.append(owner[: len(h)][ok])
    # words: sums of mixed characters weighted by their place, from the running sum over the text
    begin = np.flatnonzero(space[:-1] & ~space[1:] & ~end[1:]) + 1
    if len(begin):
        stop = np.flatnonzero(~space[:-1] & ~end[:-1] & (space[1:] | end[1:])) + 1
        place = np.arange(len(code)) - np.repeat(np.concatenate(([0], begin)), np.diff(np.concatenate(([0], begin, [len(code)]))))
        run = np.concatenate(([_U(0)], np.cumsum(_mix(code * _U(0x9E3779B1) + place.astype(np.uint64) * _U(0x85EBCA77)))))
        w, who = run[stop] - run[begin], owner[begin]
        h = w
        for n in range(1, max(WORDS) + 1):
            if n > 1:
                h = _mix(h[: len(w) - n + 1] * _U(0xC2B2AE3D27D4EB4F) + w[n - 1 :]) if len(w) >= n else w[:0]
            if n in WORDS and len(h):
                ok = who[: len(h)] == who[n - 1 :]
                parts.append(_mix(h[ok] + _U(n)))
                owners.append(who[: len(h)][ok])
    return (np.concatenate(parts) >> _U(64 - BITS)).astype(np.int64), np.concatenate(owners)


@dataclass
class Ordinal:
    """Weights and ordered thresholds of a cumulative-link model, and the calibration of its scores."""

    weights: np.ndarray
    thresholds: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def above(self, x: np.ndarray) -> np.ndarray:
        """(records, thresholds): the probabilities of a grade above each threshold."""
        return _sigmoid(self.slope * (x[:, None] - self.thresholds) + self.shift)

    def grades(self, texts: list[str | None]) -> np.ndarray:
        """(texts, thresholds): ``above`` of the worst clause of each text; 0 without words."""
        out = np.zeros((len(texts), len(self.thresholds)))
        x = self.score(texts)
        some = np.isfinite(x)
        out[some] = self.above(x[some])
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The score of the worst clause of each text, minus infinity without words."""
        parts = [clauses(t) for t in texts]
        n = np.array([len(p) for p in parts], np.int64)
        out = np.full(len(texts), -np.inf)
        if n.sum():
            f, row = features([c for p in parts for c in p])
            x = np.bincount(row, self.weights[f], n.sum()) / np.sqrt(np.maximum(1, np.bincount(row, minlength=n.sum())))
            some = np.flatnonzero(n)
            out[some] = np.maximum.reduceat(x, (np.cumsum(n) - n)[some])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def rater_errors(n: np.ndarray, above: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """(false alarm, oversight): how often a rater goes above a grade wrongly, and how often a rater doesn't where it is due.

    By expectation-maximisation over the records that several raters rated (Dawid and Skene
    1979, the same rates for all raters), with a prior belief that BELIEF ratings weigh.
    n: ratings of each record; above: how many of them are above the grade.
    """
    many = n > 1
    n, m = n[many].astype(float), above[many].astype(float)
    share, rates = 0.2, np.array([ERRORS, ERRORS])
    for _ in range(rounds):
        yes, no = (1 - rates[1]) ** m * rates[1] ** (n - m) * share, rates[0] ** m * (1 - rates[0]) ** (n - m) * (1 - share)
        q = yes / (yes + no)
        share = (q.sum() + 1) / (len(q) + 5)
        new = np.array([((1 - q) * m).sum() + ERRORS * BELIEF, (q * (n - m)).sum() + ERRORS * BELIEF]) / (np.array([((1 - q) * n).sum(), (q * n).sum()]) + BELIEF)
        new = np.clip(new, 0.005, 0.4)
        if np.abs(new - rates).max() < 1e-7:
            break
        rates = new
    return float(rates[0]), float(rates[1])


def likelihoods(n: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(records, thresholds): how likely the ratings are if the grade is above the threshold, and if it isn't."""
    yes, no = np.empty(above.shape), np.empty(above.shape)
    for k in range(above.shape[1]):
        alarm, oversight = rater_errors(n, above[:, k])
        m = above[:, k]
        yes[:, k], no[:, k] = (1 - oversight) ** m * oversight ** (n - m), alarm**m * (1 - alarm) ** (n - m)
    return yes, no


def fit_ordinal(texts: list[str | None], n_ratings: np.ndarray, above: np.ndarray, rounds: int = 100, ridge: float = RIDGE) -> Ordinal:
    """Maximum penalised likelihood of the ratings, 'grade > k' being a logistic event with the shared weights.

    n_ratings: of each record; above: (records, thresholds), how many of them are above each threshold.

    A record has the score of its clauses weighted towards the worst one, ever more so from
    round to round, so that the weights learn the offending clause and not what surrounds
    it.  The probabilities pass through the raters' estimated error rates before they are held
    against the ratings, so a few wrong ratings don't bend the weights.  Gradient steps with a rate
    for each weight; features of too few records are left out.
    """
    parts = [clauses(t) for t in texts]
    kept = [i for i, p in enumerate(parts) if p]
    yes, no = (x[kept] for x in likelihoods(np.asarray(n_ratings), np.asarray(above)))
    doc = np.repeat(np.arange(len(kept)), [len(parts[i]) for i in kept])
    first = np.flatnonzero(np.diff(np.concatenate(([-1], doc))))
    many, n = len(doc), len(kept)
    chunks, often = [], np.zeros(2**BITS, np.int32)  # in pieces, to stay small in memory
    texts, begins = [c for i in kept for c in parts[i]], np.append(first, many)
    for k in range(0, n, 400):
        a, b = begins[k], begins[min(n, k + 400)]
        f, clause = features(texts[a:b])
        chunks.append((f.astype(np.int32), (clause + a).astype(np.int32)))
        often += np.bincount(np.unique((doc[a + clause] << BITS) | f) & (2**BITS - 1), minlength=2**BITS).astype(np.int32)
    enough = often >= max(2, LEAST * n)
    scale = np.sqrt(np.maximum(1, np.concatenate([np.bincount(c - c[0], minlength=c[-1] - c[0] + 1) for c in (np.sort(c) for _, c in chunks)])))
    chunks = [(f[enough[f]], c[enough[f]]) for f, c in chunks]
    f, clause = (np.concatenate(x) for x in zip(*chunks, strict=True))
    used, inner = np.unique(f, return_inverse=True)
    inner, v = inner.astype(np.int32), 1 / scale[clause]
    share = np.clip((yes / (yes + no)).mean(0), 1e-2, 0.9)
    w, t = np.zeros(len(used)), np.log((1 - share) / share)
    m, s2, mt = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(t))
    for k in range(rounds):
        x = np.bincount(clause, w[inner] * v, many)
        sharp = min(4.0, 0.5 + 8 * k / rounds)
        a = np.exp(sharp * (x - np.maximum.reduceat(x, first)[doc]))
        a /= np.add.reduceat(a, first)[doc]
        p = _sigmoid(np.add.reduceat(a * x, first)[:, None] - t)
        r = (no - yes) / (p * yes + (1 - p) * no) * p * (1 - p) * WEIGHTS
        gw = np.bincount(inner, (r.sum(1)[doc] * a)[clause] * v, len(used)) + ridge * w
        gt = -r.sum(0)
        m, s2, mt = 0.9 * m + 0.1 * gw, 0.99 * s2 + 0.01 * gw**2, 0.9 * mt + 0.1 * gt
        late = 1 - np.array([0.9, 0.99]) ** (k + 1)
        w -= 0.15 * (1 - k / rounds) * (m / late[0]) / (np.sqrt(s2 / late[1]) + 0.05)
        t = np.maximum.accumulate(t - 2.0 / n * mt / late[0])
    out = np.zeros(2**BITS)
    out[used] = w
    return Ordinal(out, t)


def calibrate(model: Ordinal, texts: list[str | None], n_ratings: np.ndarray, above: np.ndarray) -> tuple[float, float]:
    """(slope, shift) that make the probability of any grade fit ratings the model hasn't seen, held towards (1, 0) by a prior of few records' weight."""
    x = model.score(texts)
    some = np.isfinite(x)
    if not some.any():
        return 1.0, 0.0
    yes, no = (v[some, 0] for v in likelihoods(np.asarray(n_ratings), np.asarray(above)))
    gap = x[some] - model.thresholds[0]

    def loss(a: float, b: float) -> float:
        p = _sigmoid(a * gap + b)
        return float(-np.log(np.maximum(p * yes + (1 - p) * no, 1e-300)).sum() + 8 * np.log(a) ** 2 + 2 * b * b)

    best, step = (1.0, 0.0), 0.5
    while step > 1e-3:  # a search of two numbers by ever smaller steps
        near = [(best[0] * np.exp(i * step), best[1] + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        found = min(near, key=lambda ab: loss(*ab))
        step, best = (step / 2, best) if loss(*found) >= loss(*best) - 1e-9 else (step, found)
    return float(best[0]), float(best[1])


def votes(ratings: DataFrame, key: str, rater: str, category: str, clean: str = "none", newest: str | None = None) -> DataFrame:
    """(key, n, above1, above2, above3): the raters of a record, and how many of them give a grade of at least 1, 2, 3 (GRADE).

    A null category is no rating; a rater counts once for a record, with the newest rating.  A
    category that has no grade and isn't clean counts as 1.
    """
    from pyspark.sql import Window as W

    name = F.lower(F.trim(category))
    grade = F.when(name == clean, 0)
    for c, g in GRADE.items():
        grade = grade.when(name == c, g)
    rated = ratings.where(F.col(category).isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.col(rater).alias("_r"), grade.otherwise(1).alias("_g"), (F.col(newest) if newest else F.lit(0)).alias("_at"))
    last = rated.withColumn("_n", F.row_number().over(W.partitionBy(key, "_r").orderBy(F.desc("_at"), F.desc("_g")))).where("_n = 1")
    return last.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(F.col("_g") >= k).alias(f"above{k}") for k in range(1, GRADES)])


def fit(df: DataFrame, key: str, text: str, graded: DataFrame) -> Ordinal | None:
    """The model from at most MOST_LABELLED rated records; None where none is rated above or none clean.

    It is fitted without the records held out first, calibrated on these, and fitted again on all.
    """
    sample = graded.orderBy(F.xxhash64(key), key).limit(MOST_LABELLED)
    rows = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(sample.withColumnRenamed(key, "_k")), "_k").orderBy("_k").toPandas()
    n, above = rows["n"].to_numpy(np.int64), rows[[f"above{k}" for k in range(1, GRADES)]].to_numpy(np.int64)
    if not len(n) or not above.any() or (above[:, 0] == n).all():
        return None
    texts = rows["t"].to_numpy(object)
    out = np.arange(len(n)) % HELD_OUT == HELD_OUT - 1
    slope, shift = 1.0, 0.0
    if above[~out].any() and above[out].any():
        first = fit_ordinal(texts[~out].tolist(), n[~out], above[~out])
        slope, shift = calibrate(first, texts[out].tolist(), n[out], above[out])
    model = fit_ordinal(texts.tolist(), n, above)
    model.slope, model.shift = slope, shift
    return model


def severities(df: DataFrame, key: str, text: str, model: Ordinal | None) -> DataFrame:
    """(key, severity, p_offending) for every record: the expected grade and the probability of any; both 0 for null and blank texts, and without a model.

    Each record is scored where it lies, without a shuffle.
    """
    source = df.select(F.col(key), F.col(text).cast("string").alias("_t"))
    if model is None:
        return source.select(key, F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_offending"))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                above = sent.value.grades(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(above.sum(1)), pa.array(above[:, 0])], [key, "severity", "p_offending"])

    return source.mapInArrow(score, f"{key} {dict(df.dtypes)[key]}, severity double, p_offending double")
