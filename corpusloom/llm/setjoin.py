"""Shared parts of the joins by word sets: set table, refinement of hot buckets, verification, expansion.

A *class* is a distinct word set (or tuple of word sets), named by two 64-bit hashes k1 and
k2; copies of a text fall into one class before anything is joined, so neither a text that
a third of all rows repeat nor its pairs ever pass through a join.  Joins use k1 alone and
compare the sets themselves, so a collision of k1 costs time and never a wrong result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.words import WordHashes, word_set
from corpusloom.operators.ranking import in_blocks
from corpusloom.session import cut

#: Two texts match if at least SHARE[0] / SHARE[1] of the words found in either are found in both.
SHARE = (2, 3)


def set_table(df: DataFrame, key: str, texts: list[str], **keep: Column) -> DataFrame:
    """(id, *keep, k1, k2, w0, w1, ...): the word sets of each record, cut.

    Records in which one of the texts is null or has no word are left out: they match nothing.
    """
    schema = df.select(F.col(key).alias("id"), *[c.alias(n) for n, c in keep.items()])
    source = df.select(F.col(key).alias("id"), *[c.alias(n) for n, c in keep.items()], *[F.col(t).cast("string").alias(f"t{i}") for i, t in enumerate(texts)])
    n, names = len(texts), schema.columns
    arrays = pa.list_(pa.int64())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            keys, out, rows = [], [[] for _ in range(n)], []
            for row, found in enumerate(zip(*[b.column(f"t{i}").to_pylist() for i in range(n)], strict=True)):
                if all(found):
                    w = [word_set(t, hashes) for t in found]
                    if all(map(len, w)):
                        rows.append(row)
                        mark = b"".join(len(x).to_bytes(4, "little") + x.tobytes() for x in w)
                        keys.append((xxhash.xxh64_intdigest(mark, 11), xxhash.xxh64_intdigest(mark, 12)))
                        for o, x in zip(out, w, strict=True):
                            o.append(x.view(np.int64))
            kept = b.select(names).take(pa.array(rows, pa.int64()))
            k = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
            cols = [*kept.columns, pa.array(k[:, 0]), pa.array(k[:, 1]), *[lists(o, arrays) for o in out]]
            yield pa.RecordBatch.from_arrays(cols, [*names, "k1", "k2", *[f"w{i}" for i in range(n)]])

    ddl = ", ".join([*[f"{c} {t}" for c, t in schema.dtypes], "k1 bigint", "k2 bigint", *[f"w{i} array<bigint>" for i in range(n)]])
    return cut(source.mapInArrow(sets, ddl), "sets")


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind.value_type))


class Seen:
    """Remembers the classes a task has handled already, at most ``most`` of them.

    Copies of one text in one task thus give one set of rows before the shuffle; what is
    forgotten comes again and is merged after the shuffle.
    """

    def __init__(self, most: int = 500_000) -> None:
        self.most, self.known = most, set()

    def fresh(self, keys: list) -> list[int]:
        out = []
        for i, k in enumerate(keys):
            if k not in self.known:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known.add(k)
                out.append(i)
        return out


def class_words(members: DataFrame, fields: int) -> DataFrame:
    """(k1, s: array of (k2, w0, ...)): the distinct sets under each k1, merged on the map side first."""
    return members.select("k1", "k2", *[f"w{i}" for i in range(fields)]).groupBy("k1").agg(F.collect_set(F.struct("k2", *[f"w{i}" for i in range(fields)])).alias("s"))


def having(members: DataFrame, ids: DataFrame, most_bits: int = 1 << 26) -> DataFrame:
    """The members whose k1 is among ``ids``, and a few more: a Bloom filter, so that other word sets aren't shuffled.

    k1 is a hash itself, so its bits choose the places.  The filter has 16 bits for an id and
    at most ``most_bits`` (8 MB), whatever the number of ids; with more it lets more pass.
    """
    spark = members.sparkSession
    bits = 1 << 16
    n = ids.count()
    while bits < min(16 * n, most_bits):
        bits *= 2
    at = F.explode(F.array(*[F.shiftrightunsigned("k1", k).bitwiseAND(bits - 1) for k in (0, 32)]))
    filled = ids.select(at.alias("bit")).groupBy((F.col("bit") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 32))")).alias("m")).toPandas()
    table = np.zeros(bits // 32, np.uint32)
    table[filled["w"].to_numpy(np.int64)] = filled["m"].to_numpy(np.int64).astype(np.uint32)
    sent = spark.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for b in batches:
            k = b.column("k1").to_numpy(zero_copy_only=False).view(np.uint64)
            ok = np.ones(len(k), bool)
            for shift in (0, 32):
                p = (k >> np.uint64(shift)) & np.uint64(bits - 1)
                ok &= (t[(p >> np.uint64(5)).astype(np.int64)] >> (p & np.uint64(31)).astype(np.uint32)) & 1 > 0
            yield b.filter(pa.array(ok))

    return members.mapInArrow(keep, members.schema)


def verified(pairs: DataFrame, members: DataFrame, fields: int, share: tuple[int, int] = SHARE) -> DataFrame:
    """The pairs (a, b) of k1 whose sets match in every field, as (a1, a2, b1, b2, sim).

    sim: the smallest Jaccard similarity of the fields.  The comparison is exact, in whole numbers.
    """
    pairs = cut(pairs, "pairs")
    words = class_words(having(members, pairs.select(F.explode(F.array("a", "b")).alias("k1"))), fields)
    left = words.select(F.col("k1").alias("a"), F.explode("s").alias("sa"))
    right = words.select(F.col("k1").alias("b"), F.explode("s").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    ok, sim = F.lit(True), []
    for i in range(fields):
        x, y = F.col(f"sa.w{i}"), F.col(f"sb.w{i}")
        both = F.size(F.array_intersect(x, y))
        either = F.size(x) + F.size(y) - both
        # a length bound first: the smaller set must hold the share of the larger
        ok = ok & (F.least(F.size(x), F.size(y)) * share[1] >= F.greatest(F.size(x), F.size(y)) * share[0]) & (both * share[1] >= either * share[0])
        sim.append(both / either)
    least = F.least(*sim) if fields > 1 else sim[0]
    return joined.where(ok).select(F.col("a").alias("a1"), F.col("sa.k2").alias("a2"), F.col("b").alias("b1"), F.col("sb.k2").alias("b2"), least.alias("sim"))


def crowds(rows: Iterator[dict[str, np.ndarray]], hot: int, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Rows with a key and an id as batches of about ``most``; of a key with more than ``hot`` of them only one row with a null id.

    So a key that very many rows have sends few rows of each batch through the shuffle that
    finds out about it; its rows are computed again once it is known.
    """

    def flush(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        cols = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        _, first, inverse, n = np.unique(cols["key"], return_index=True, return_inverse=True, return_counts=True)
        few = n[inverse] <= hot
        few[first] = True
        return pa.RecordBatch.from_pydict({c: pa.array(v[few], mask=(n[inverse] > hot)[few] if c == "id" else None) for c, v in cols.items()})

    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["key"])
        if size >= most:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


class Buckets:
    """Candidate pairs (a, b) of ids that share a key, whatever the number of ids of a key.

    keys(hot): (key, id, ...) in which a crowded key may have rows with a null id instead of
    its own (``crowds``); with hot None all rows.  refine(ids, level): (id, sub), further
    keys of ids that crowd, independent of the first.  pair: the condition on the rows x and
    y of a pair.  Ids of a bucket of more than ``hot`` are candidates only if they share one
    of the further keys too, up to ``deepest`` levels; what then still crowds is paired in
    blocks.  No pair is dropped but those that share no further key.
    """

    def __init__(self, keys: Callable[[int | None], DataFrame], refine: Callable[[DataFrame, int], DataFrame], pair: Column, hot: int = 64, deepest: int = 2) -> None:
        self.keys, self.refine, self.pair, self.hot, self.deepest = keys, refine, pair, hot, deepest

    def first(self) -> tuple[DataFrame, DataFrame | None]:
        """(sized rows of the small buckets, all rows of the crowded ones), the second None if there are none."""
        rows = self.keys(self.hot)
        spread = rows.repartition("key").dropDuplicates(["key", "id", *[c for c in rows.columns if c == "side"]])
        w = W.partitionBy("key")
        sized = spread.withColumn("n", F.count("*").over(w) + F.when(F.count("*").over(w) > F.count("id").over(w), self.hot).otherwise(0)).where("n > 1")
        sized = cut(sized, "buckets")  # most keys have one id, so little is left, and it is read more than once
        full = sized.where(F.col("n") > self.hot).select("key").distinct()
        if full.isEmpty():
            return sized, None
        every = self.keys(None).join(full, "key", "left_semi")
        return sized.where(F.col("n") <= self.hot), cut(every.distinct(), "crowded")

    def finer(self, crowded: DataFrame, level: int) -> tuple[DataFrame, DataFrame | None]:
        """The same one level further; sizes are counted by an aggregation before rows are brought together."""
        more = self.refine(crowded.select("id").distinct(), level)
        rest = [c for c in crowded.columns if c not in ("key", "id", "n")]
        rows = cut(crowded.join(more, "id").select(F.xxhash64("key", "sub").alias("key"), "id", *rest).distinct(), "finer")
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sized = cut(rows.join(sizes, "key"), "buckets")
        full = sized.where(F.col("n") > self.hot)
        return sized.where(F.col("n") <= self.hot), None if full.isEmpty() else full

    def within(self, sized: DataFrame) -> DataFrame:
        x, y, on = in_blocks(sized, ["key"])
        return x.join(y, on & self.pair).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))

    def small(self, sized: DataFrame) -> DataFrame:
        x, y = (sized.select(*[F.col(c).alias(f"{side}_{c}") for c in sized.columns]) for side in "xy")
        return x.join(y, (F.col("x_key") == F.col("y_key")) & self.pair).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))

    def pairs(self) -> DataFrame:
        """All candidate pairs; one may come several times."""
        sized, crowded = self.first()
        out, level = self.small(sized), 1
        while crowded is not None:
            sized, crowded = self.finer(crowded, level)
            out = out.unionByName(self.small(sized))
            if crowded is not None and level == self.deepest:
                return out.unionByName(self.within(crowded))
            level += 1
        return out

    def links(self, check: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
        """(candidate pairs, checked matches) that connect the same ids as all pairs do, for groups.

        check(pairs): the matches (a1, a2, b1, b2, sim) of candidate pairs.  Of a crowded bucket one
        id is held against all others first.  Those that match it are in one group, so their
        pairs among themselves aren't needed; a family of a template thus costs one check an id.
        Only pairs with an id that doesn't match are looked for on the next level.
        """
        sized, crowded = self.first()
        out, found, level = self.small(sized), [], 1
        while crowded is not None:
            own = crowded.select("key", "id")
            star = own.join(own.groupBy("key").agg(F.min_by("id", F.xxhash64("id", F.lit(level))).alias("a")), "key").where("a != id")
            star = cut(star.select("key", "a", F.col("id").alias("b")), "star")
            met = cut(check(star.select("a", "b").distinct()), "met")
            found.append(met)
            unlike = cut(star.join(met.select(F.col("a1").alias("a"), F.col("b1").alias("b")).distinct(), ["a", "b"], "left_anti").select("key", F.col("b").alias("id")), "unlike")
            if unlike.isEmpty():
                return out, found
            again = own.join(unlike.select("key").distinct(), "key", "left_semi").join(unlike.withColumn("odd", F.lit(True)), ["key", "id"], "left")
            sized, crowded = self.finer(again.withColumn("odd", F.coalesce("odd", F.lit(False))), level)
            some = F.col("x_odd") | F.col("y_odd")
            out = out.unionByName(Buckets(self.keys, self.refine, self.pair & some).small(sized))
            if crowded is not None and level == self.deepest:
                return out.unionByName(Buckets(self.keys, self.refine, self.pair & some).within(crowded)), found
            level += 1
        return out, found
