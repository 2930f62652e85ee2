"""Evaluation passages that stand, whole or in part, in the texts of a corpus.

A prefix-filtered set join of word shingles.  The shingles of an item are ordered by how
many documents hold them; a document with a case shares at least T of them, so it shares
one of the rarest s - T + 1, and only these are looked up first.  Length and position
bounds follow, and an alignment of the words inside an item-sized window decides.

The items are a stated query set: they are read in blocks of at most BLOCK_WORDS words, and
each block is held against all documents in one pass, so documents are never shuffled.
"""

from __future__ import annotations

import functools
import html
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.setjoin import lists
from corpusloom.llm.sketch import _mix
from corpusloom.llm.words import WordHashes, tokens
from corpusloom.session import cut

#: Words of a shingle, the largest first: an item gets the largest of which a case keeps one for certain.  Five-word
#: shingles can't do here: half of a passage of 26 words with a few of them changed need not keep three words in a row.
SHINGLES = (3, 2)
#: Words of the items of one block: what is sent to the executors at once is below 64 MB.
BLOCK_WORDS = 1_000_000
#: A case is a stretch of this share of the item's words, and of so many words at least, with at most EDITS words changed,
#: left out or added, or a fifth of a longer stretch, or a third of a shorter one.
SHARE, STRETCH, EDITS = 0.5, 6, 4
#: Words looked at beyond the place of an item, and diagonals of one bin, at least.
SLACK, BIN = 10, 32
_U = np.uint64


def text_words(text: str | None) -> list[str]:
    """The tokens of a text, entities resolved."""
    if text and "&" in text:
        text = html.unescape(html.unescape(text))
    return tokens(text)


def word_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, w): the hashed words of each text in order, cut; texts without words are left out."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            found = [[known[x] for x in text_words(t)] for t in b.column("t").to_pylist()]
            rows = [i for i, w in enumerate(found) if w]
            cols = [b.column("id").take(pa.array(rows, pa.int64())), lists([np.fromiter(found[i], np.uint64, len(found[i])).view(np.int64) for i in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "w"])

    source = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    return cut(source.mapInArrow(hashed, f"id {dict(df.dtypes)[key]}, w array<bigint>"), "words")


def shingles(flat: np.ndarray, starts: np.ndarray, sizes: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """k -> (hash, owner, position) of the k-word shingles of texts laid end to end, for every k of ``sizes``."""
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
    out = {}
    h = np.zeros(len(flat), np.uint64)
    for k in range(1, max(sizes) + 1):
        n = len(flat) - k + 1
        if n > 0:
            h = _mix(h[:n] * _U(0x9E3779B97F4A7C15) + flat[k - 1 :])
        if k in sizes:
            at = np.flatnonzero(owner[: max(0, n)] == owner[k - 1 :]) if n > 0 else np.empty(0, np.int64)
            out[k] = (h[at], owner[at], at - starts[owner[at]]) if len(at) else (np.empty(0, np.uint64), owner[:0], owner[:0])
    return out


def changes(span: int) -> int:
    """How many words of a stretch may be changed, left out or added."""
    return min(max(EDITS, span // 5), span // 3)


def least_span(n: int) -> int:
    """How many words of an item of n words a case covers at least."""
    return max(STRETCH, math.ceil(n * SHARE))


@functools.cache
def least_words(n: int) -> int:
    """How many words of an item of n words are left in a case at least."""
    return min((s - changes(s) for s in range(least_span(n), n + 1)), default=n)


@functools.cache
def least_shared(n: int, k: int) -> int:
    """How many k-word shingles of an item of n words a case has at least: each change that ``judge`` allows ends k of them."""
    return min((s - k + 1 - k * changes(s) for s in range(least_span(n), n + 1)), default=0)


@functools.cache
def shingle_size(n: int) -> int:
    """The largest k of SHINGLES of which every case of an item of n words has a shingle; there is one from STRETCH words on."""
    return next((k for k in SHINGLES if least_shared(n, k) > 0), min(SHINGLES))


@dataclass
class Block:
    """Items, and their shingles as an inverted index: shingle -> (item, position)."""

    ids: list
    words: list[np.ndarray]
    hashes: np.ndarray  # sorted distinct shingles
    first: np.ndarray  # where the postings of each begin
    item: np.ndarray
    place: np.ndarray
    need: np.ndarray  # T of each item
    least: np.ndarray  # words of each item that a case has at least
    bins: np.ndarray  # diagonals of a bin of each item: two changes' worth, so that a case lies whole in one of two
    sizes: tuple[int, ...]  # words of the shingles
    rare: np.ndarray | None = None  # of each posting: is the shingle in the item's prefix

    @classmethod
    def of(cls, ids: list, found: list[np.ndarray]) -> Block:
        flat = np.concatenate(found)
        n = np.array([len(w) for w in found])
        starts = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)
        size = np.array([shingle_size(m) for m in n.tolist()])
        sizes = tuple(sorted(set(size.tolist())))
        made = [(h[ok], item[ok], place[ok]) for k, (h, item, place) in shingles(flat, starts, sizes).items() for ok in (size[item] == k,)]
        h, item, place = (np.concatenate(x) for x in zip(*made, strict=True))
        by = np.lexsort((place, item, h))
        hashes, first = np.unique(h[by], return_index=True)
        need = np.array([least_shared(m, k) for m, k in zip(n.tolist(), size.tolist(), strict=True)])
        least = np.array([least_words(m) for m in n.tolist()])
        bins = np.array([max(BIN, 2 * changes(m)) for m in n.tolist()])
        return cls(ids, found, hashes, np.append(first, len(h)), item[by], place[by], need, least, bins, sizes)

    def hits(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, position, index of the shingle) of the shingles of texts that occur in the block."""
        out = []
        for h, owner, pos in shingles(flat, starts, self.sizes).values():
            hit, s = self.lookup(h)
            out.append((owner[hit], pos[hit], s))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into h, index of the shingle) of the shingles that occur in the block."""
        if not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[at] == h)
        return hit, at[hit]

    def order(self, df: np.ndarray) -> None:
        """Mark the prefix of each item, given the document frequency of every shingle."""
        owner = np.repeat(np.arange(len(self.hashes)), np.diff(self.first))
        by = np.lexsort((self.hashes[owner], df[owner], self.item))
        item = self.item[by]
        begin = np.searchsorted(item, np.arange(len(self.ids)))
        size = np.bincount(item, minlength=len(self.ids))
        rank = np.arange(len(item)) - begin[item]
        self.rare = np.zeros(len(item), bool)
        self.rare[by] = rank < size[item] - self.need[item] + 1


def _texts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    w = b.column("w")
    offsets = np.asarray(w.offsets)
    return np.asarray(w.values)[offsets[0] : offsets[-1]].view(np.uint64), (offsets[:-1] - offsets[0]).astype(np.int64)


def _postings(block: Block, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For shingle numbers s: (index into s, posting) of all their postings."""
    n = block.first[s + 1] - block.first[s]
    which = np.repeat(np.arange(len(s)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + block.first[s][which]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment (match 1, change or gap -1): words of a in its span, and the changes and gaps in it."""
    n, m = len(a), len(b)
    table = np.zeros((n + 1, m + 1), np.int32)
    steps = np.arange(m + 1, dtype=np.int32)
    same = a[:, None] == b[None, :]
    for i in range(1, n + 1):
        row = table[i]
        row[1:] = np.maximum(np.maximum(table[i - 1, :-1] + np.where(same[i - 1], 1, -1), table[i - 1, 1:] - 1), 0)
        row[:] = np.maximum.accumulate(row + steps) - steps
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    end, edits = i, 0
    while table[i, j] > 0:
        v = table[i, j]
        if v == table[i - 1, j - 1] + (1 if same[i - 1, j - 1] else -1):
            edits += int(not same[i - 1, j - 1])
            i, j = i - 1, j - 1
        else:
            edits += 1
            i, j = (i - 1, j) if v == table[i - 1, j] - 1 else (i, j - 1)
    return int(end - i), edits


def judge(item: np.ndarray, window: np.ndarray) -> float:
    """The share of the item's words in the best stretch of a window if that is a case, else 0."""
    if np.isin(item, window).sum() < least_words(len(item)):
        return 0.0
    span, edits = align(item, window)
    return span / len(item) if span >= least_span(len(item)) and edits <= changes(span) else 0.0


def candidates(block: Block, hit_doc: np.ndarray, hit_pos: np.ndarray, s: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, item, lowest diagonal, highest diagonal) of the item-sized windows that may hold a case.

    Length bound: the document has the words of a stretch.  Prefix: one shingle of the item's
    prefix is there.  Position and count bounds: the shingles of a case lie on neighbouring
    diagonals (place in the document less place in the item), no further apart than words may
    be added or left out, so at least T of them fall into one of two overlapping bins of
    diagonals.
    """
    which, posting = _postings(block, s)
    doc, item = hit_doc[which], block.item[posting]
    pair = doc * len(block.ids) + item
    ok = (sizes[doc] >= block.least[item]) & np.isin(pair, np.unique(pair[block.rare[posting]]))
    pair, diagonal, item = pair[ok], (hit_pos[which] - block.place[posting])[ok], item[ok]
    out = []
    width = block.bins[item]
    for shift in (0, width // 2):
        bin_ = (pair << 24) + (diagonal + shift + (1 << 23)) // width
        by = np.argsort(bin_, kind="stable")
        key, begin, count = np.unique(bin_[by], return_index=True, return_counts=True)
        enough = count >= block.need[item[by][begin]]
        if enough.any():
            low, high = np.minimum.reduceat(diagonal[by], begin), np.maximum.reduceat(diagonal[by], begin)
            out.append(np.stack([key >> 24, low, high])[:, enough])
    if not out:
        return (np.empty(0, np.int64),) * 4
    pair, low, high = np.unique(np.concatenate(out, axis=1), axis=1)
    return pair // len(block.ids), pair % len(block.ids), low, high


def leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str) -> DataFrame:
    """(key, item, share): every document and item with a case in it; share is that of the longest stretch.

    Null and blank texts, and items of fewer than STRETCH words, have no case.  An item id or
    document id that stands on several rows gives one row with the largest share.  Of more
    than one block each is worked off and written before the next, so that the driver and
    the executors hold one block at a time.
    """
    spark = corpus.sparkSession
    table = word_table(corpus, key, text)
    kinds = dict(corpus.dtypes)[key], dict(items.dtypes)[item]
    blocks = _blocks(items.select(F.col(item).alias("i"), F.col(passage).cast("string").alias("t")))
    out, block = None, next(blocks, None)
    while block is not None:
        part, sent = _against(spark, table, Block.of(*block), kinds)
        block = next(blocks, None)
        if block is not None or out is not None:
            part = cut(part, "leaks")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"id {kinds[0]}, item {kinds[1]}, share double")
    return out.groupBy(F.col("id").alias(key), F.col("item").alias(item)).agg(F.max("share").alias("share"))


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    known, ids, found, size = WordHashes(), [], [], 0
    for r in items.toLocalIterator():
        w = text_words(r["t"])
        if len(w) < STRETCH:
            continue
        if size + len(w) > BLOCK_WORDS and ids:
            yield ids, found
            ids, found, size = [], [], 0
        ids.append(r["i"])
        found.append(np.array([known[x] for x in w], np.uint64))
        size += len(w)
    if ids:
        yield ids, found


def _against(spark, table: DataFrame, block: Block, kinds: tuple[str, str]) -> tuple[DataFrame, Broadcast]:
    """The cases of one block, and the broadcast they are computed from."""
    sent = spark.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value.hashes), np.int64)
        for b in batches:
            owner, _, s = sent.value.hits(*_texts(b))
            once = np.unique(owner * len(total) + s)
            total += np.bincount(once % max(1, len(total)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"s": some.astype(np.int64), "n": total[some]})

    df = np.zeros(len(block.hashes), np.int64)
    for r in table.select("w").mapInArrow(count, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r["s"]] = r["n"]
    sent.destroy()
    block.order(df)
    ready = spark.sparkContext.broadcast(block)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = ready.value
        for b in batches:
            flat, starts = _texts(b)
            ends = np.append(starts[1:], len(flat))
            owner, pos, s = q.hits(flat, starts)
            best: dict[tuple[int, int], float] = {}
            for d, i, low, high in zip(*(x.tolist() for x in candidates(q, owner, pos, s, ends - starts)), strict=True):
                if best.get((d, i), 0) < 1:
                    text = flat[starts[d] : ends[d]]
                    n = len(q.words[i])
                    slack = max(SLACK, changes(n))
                    if share := judge(q.words[i], text[max(0, low - slack) : high + n + slack]):
                        best[d, i] = max(share, best.get((d, i), 0))
            rows, ids, shares = [d for d, _ in best], [q.ids[i] for _, i in best], list(best.values())
            found = b.column("id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([found, pa.array(ids, _arrow(kinds[1])), pa.array(shares, pa.float64())], ["id", "item", "share"])

    return table.mapInArrow(find, f"id {kinds[0]}, item {kinds[1]}, share double"), ready


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
