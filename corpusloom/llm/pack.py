"""Texts packed into containers of a fixed number of tokens.

Pattern packing by non-negative least squares (after Krell and others, 2021): patterns of a
few documents that fill a container are enumerated over classes of lengths, the repeats of
each are fitted to the histogram of lengths, rounded down and turned into exact lengths, and
what is left goes where it fits best.  All planning works on the histogram, which has at
most as many rows as a container has tokens; the documents themselves are only ranked and
looked up in the plan.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.session import cut

#: File of a public byte-level vocabulary, as ranks.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary's public tokenizer cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes of lengths, different classes in one pattern, and documents in one pattern.
CLASSES, KINDS, DEPTH = 64, 3, 24
#: Tokens kept back to fill the gaps that classes leave, as a multiple of the expected gaps.
RESERVE = 1.0
#: Ranges of documents by hash in which the documents of one length are numbered, so that a length many share is split.
SALTS = 64
#: Containers (rows of the limits table) that one call plans for, at most.
MOST_LIMITS = 64


@cache
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of every text; null and empty texts have 0.

    The vocabulary, about a megabyte, is read by the driver and sent with the job, so the
    executors need no file.
    """
    with open(tokenizer, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoding(sent.value)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64())], [key, "n_tokens"])

    source = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    return source.mapInArrow(count, f"{key} {dict(df.dtypes)[key]}, n_tokens bigint")


def patterns(classes: int = CLASSES, kinds: int = KINDS, depth: int = DEPTH) -> list[tuple[tuple[int, int], ...]]:
    """All ways to fill ``classes`` exactly with at most ``kinds`` different parts and ``depth`` parts: ((part, times), ...)."""
    out = []

    def extend(left: int, below: int, kinds_left: int, depth_left: int, so_far: tuple) -> None:
        if not left:
            out.append(so_far)
            return
        if not kinds_left:
            return
        for part in range(min(below, left), 0, -1):
            if kinds_left == 1 and left % part:
                continue
            for times in range(1, min(left // part, depth_left) + 1):
                if kinds_left > 1 or times * part == left:
                    extend(left - part * times, part - 1, kinds_left - 1, depth_left - times, (*so_far, (part, times)))

    extend(classes, classes, kinds, depth, ())
    return out


def nonnegative_fit(a: np.ndarray, h: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - h| (the active-set method of Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(h).max()))
    for _ in range(rounds):
        gradient = a.T @ (h - a @ x)
        gradient[passive] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= tolerance:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, at], h, rcond=None)[0]
            if s.min() > 0:
                break
            low = s <= 0
            step = (x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)).min()
            x[at] += step * (s - x[at])
            passive[at[x[at] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
        x[:] = 0
        if passive.any():
            x[at] = s
    return x


@cache
def _design(classes: int, kinds: int, depth: int) -> tuple[list, np.ndarray]:
    p = patterns(classes, kinds, depth)
    a = np.zeros((classes, len(p)), np.float32)
    for j, parts in enumerate(p):
        for part, times in parts:
            a[part - 1, j] = times
    return p, a


def plan(histogram: dict[int, int], capacity: int, classes: int = CLASSES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one container, number of such containers): every length of the histogram as often as it occurs.

    No length may be over the capacity, and no container is.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    classes = min(classes, capacity)
    of = np.ceil(np.arange(capacity + 1) * classes / capacity).astype(int)  # a class holds lengths up to its share of the capacity
    # lengths are rounded up to their class, half a class on average; so many tokens in short documents stay back to fill the gaps
    lengths = np.arange(capacity + 1)
    spare = RESERVE * left.sum() * (capacity / classes - 1) / 2
    back = np.minimum(left, np.maximum(0, np.ceil((spare - (np.cumsum(left * lengths) - left * lengths)) / np.maximum(1, lengths)))).astype(np.int64)
    h = np.bincount(of, left - back, classes + 1)[1:]
    made: list[tuple[tuple[int, ...], int]] = []
    if h.sum():
        p, a = _design(classes, KINDS, DEPTH)
        # a container too many costs more than a document left over: short classes weigh less, as they fill gaps later
        weight = np.linspace(0.3, 1, classes)
        x = np.floor(nonnegative_fit(a * weight[:, None], h * weight) + 1e-6).astype(np.int64)
        for j in sorted(np.flatnonzero(x), key=lambda j: (-max(part for part, _ in p[j]), j)):
            made += _exact(p[j], int(x[j]), left, of)
    return _fill(made, left, capacity)


def _exact(parts: tuple[tuple[int, int], ...], repeats: int, left: np.ndarray, of: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Repeats of a pattern of classes as containers of exact lengths, as far as the classes last; takes them from ``left``."""
    for part, times in parts:
        repeats = min(repeats, int(left[of == part].sum()) // times)
    if repeats <= 0:
        return []
    columns = []
    for part, times in parts:
        lengths = np.flatnonzero(of == part)[::-1]
        lengths = lengths[lengths > 0]
        for t in range(times):
            need, runs = repeats, []
            for length in lengths if t % 2 == 0 else lengths[::-1]:  # long ones meet short ones
                take = min(need, int(left[length]))
                if take:
                    runs.append((int(length), take))
                    left[length] -= take
                    need -= take
                if not need:
                    break
            columns.append(runs)
    out: dict[tuple[int, ...], int] = defaultdict(int)
    at, used = [0] * len(columns), [0] * len(columns)
    done = 0
    while done < repeats:
        n = min(c[i][1] - u for c, i, u in zip(columns, at, used, strict=True))
        out[tuple(sorted((c[i][0] for c, i in zip(columns, at, strict=True)), reverse=True))] += n
        done += n
        for k, c in enumerate(columns):
            used[k] += n
            if used[k] == c[at[k]][1]:
                at[k], used[k] = at[k] + 1, 0
    return list(out.items())


def _fill(made: list[tuple[tuple[int, ...], int]], left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Put what is left, longest first, where the least room stays; open containers where it fits nowhere.

    Containers alike are handled together, so the work follows the number of lengths and not of documents.
    """
    room: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(capacity + 1)]
    for lengths, n in made:
        room[capacity - sum(lengths)][lengths] += n
    for length in range(capacity, 0, -1):
        n, space = int(left[length]), length
        while n:
            while space <= capacity and not room[space]:
                space += 1
            if space <= capacity:
                lengths, m = next(iter(room[space].items()))
                m = min(m, n)
                room[space][lengths] -= m
                if not room[space][lengths]:
                    del room[space][lengths]
            else:
                per = max(1, capacity // length)  # whole containers of this length, then one for the rest
                m = max(1, n // per)
                per = min(per, n)
                room[capacity - per * length][(length,) * per] += m
                n -= m * per
                space = length
                continue
            room[space - length][(*lengths, length)] += m
            n -= m
            space = length if space - length >= length else space
        left[length] = 0
    return [(lengths, n) for r in room for lengths, n in r.items()]


def slots(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(length << 40 | first rank) of each slot in order, the container of that rank, and the number of containers.

    A slot takes a run of ranks of one length into a run of containers.
    """
    next_rank: dict[int, int] = defaultdict(int)
    keys, first, container = [], [], 0
    for lengths, n in sorted(made, key=lambda m: (m[0], m[1])):
        for length in lengths:
            keys.append((length << 40) | next_rank[length])
            first.append(container)
            next_rank[length] += n
        container += n
    by = np.argsort(keys)
    return np.array(keys, np.int64)[by], np.array(first, np.int64)[by], container


def pieces(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, piece, token_from, token_to, length): one row for a text that fits, else one for each full container and the rest."""
    n = F.ceil(F.col("n_tokens") / capacity).cast("int")
    each = sizes.where("n_tokens > 0").select(key, "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    end = F.least(start + capacity, F.col("n_tokens"))
    return each.select(key, "piece", start.alias("token_from"), end.alias("token_to"), (end - start).alias("length"))


def pack(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, piece, token_from, token_to, container): the container of every text or piece.

    sizes: (key, n_tokens).  Texts without tokens are in no container.  Which of the texts
    of one length gets which place follows the key, so the result doesn't depend on how
    the data are partitioned.
    """
    spark = sizes.sparkSession
    each = pieces(sizes, key, capacity).withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(SALTS)).cast("int"))
    ranked = cut(each.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy(key, "piece")).cast("bigint") - 1), "ranked")
    count = np.zeros((capacity + 1, SALTS), np.int64)
    for r in ranked.groupBy("length", "salt").agg(F.count("*").alias("n")).toLocalIterator():
        count[r["length"], r["salt"]] = r["n"]
    before = np.cumsum(count, 1) - count
    total = count.sum(1)
    keys, first, _ = slots(plan({int(i): int(total[i]) for i in np.flatnonzero(total)}, capacity))
    sent = spark.sparkContext.broadcast((before, keys, first))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, keys, first = sent.value
        for b in batches:
            length, salt, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "salt", "rank"))
            want = (length << 40) | (rank + before[length, salt])
            at = np.searchsorted(keys, want, side="right") - 1
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (key, "piece", "token_from", "token_to")], pa.array(first[at] + (want - keys[at]))], [key, "piece", "token_from", "token_to", "container"])

    return ranked.mapInArrow(place, f"{key} {dict(sizes.dtypes)[key]}, piece int, token_from bigint, token_to bigint, container bigint")


def pack_all(df: DataFrame, key: str, text: str, limits: DataFrame, stage: str, capacity: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(stage, key, piece, token_from, token_to, container) for every row of the limits; the texts are tokenized once.

    Limits that are null or below one are left out; of a repeated stage each row is packed for itself.
    """
    wanted = limits.where(F.col(capacity) >= 1).select(stage, F.col(capacity).alias("c")).orderBy(stage, "c").limit(MOST_LIMITS + 1).collect()
    if len(wanted) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    sizes = cut(token_counts(df, key, text, tokenizer), "sizes")
    out = None
    for r in wanted:
        one = pack(sizes, key, int(r["c"])).select(F.lit(r[stage]).cast("string").alias(stage), key, "piece", "token_from", "token_to", "container")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = sizes.limit(0).select(F.lit(None).cast("string").alias(stage), key, *[F.lit(None).cast(t).alias(c) for c, t in (("piece", "int"), ("token_from", "bigint"), ("token_to", "bigint"), ("container", "bigint"))])
    return out
