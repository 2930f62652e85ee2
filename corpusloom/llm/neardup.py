"""Records that repeat with small changes to their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.setjoin import Buckets, Seen, crowds, set_table, verified
from corpusloom.llm.sketch import band_keys, flatten, similarity_sketch
from corpusloom.operators.ranking import in_blocks
from corpusloom.session import cut

#: Bands of the sketch and coordinates of a band: a pair of similarity J is missed with probability (1 - J^6)^25,
#: that is 0.7 % at 0.75 and 0.05 % at 0.8; the similarity is that of the tagged union of all fields.
BANDS, ROWS = 25, 6
#: The same inside a crowded bucket.
SUB_BANDS, SUB_ROWS = 16, 3


def _keys(sets: DataFrame, fields: int, bands: int, rows: int, seed: int, hot: int | None = None) -> DataFrame:
    """(key, id): the band keys of every class, from fast similarity sketches of the tagged union of its sets; crowded keys as in ``crowds``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        seen = Seen()
        for b in batches:
            ids = b.column("k1").to_numpy(zero_copy_only=False)
            rest = seen.fresh(ids.tolist())
            cols = [[np.asarray(x, np.int64).view(np.uint64) for x in b.column(f"w{i}").take(pa.array(rest, pa.int64())).to_numpy(zero_copy_only=False)] for i in range(fields)]
            for k in range(0, len(rest), 1000):
                tagged = [np.concatenate([w ^ np.uint64(i * 0x9E3779B97F4A7C15 & (2**64 - 1)) for i, w in enumerate(ws)]) for ws in zip(*[c[k : k + 1000] for c in cols], strict=True)]
                keys = band_keys(similarity_sketch(*flatten(tagged), bands * rows, seed), rows, seed)
                yield {"key": keys.ravel(), "id": np.repeat(ids[rest[k : k + 1000]], bands)}

    def limited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return crowds(sketch(batches), 1 << 62 if hot is None else hot)

    return sets.select("k1", *[f"w{i}" for i in range(fields)]).mapInArrow(limited, "key bigint, id bigint")


def buckets(members: DataFrame, fields: int, hot: int = 64) -> Buckets:
    """The classes of ``members`` in the buckets of their bands, crowded ones to be refined by further bands."""

    def refine(ids: DataFrame, level: int) -> DataFrame:
        own = members.join(ids, members.k1 == ids.id, "left_semi")
        return _keys(own, fields, SUB_BANDS, SUB_ROWS, 100 + level).select("id", F.col("key").alias("sub")).distinct()

    return Buckets(lambda most: _keys(members, fields, BANDS, ROWS, 1, most), refine, F.col("x_id") < F.col("y_id"), hot)


def near_pairs(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """Every pair (key_a, key_b), key_a < key_b, of records that match in every text.

    Null, blank and wordless texts match nothing; copies of a text are listed with all their
    pairs; a repeated key counts once.  Pairs of classes are found first; only the last step
    makes pairs of records, since these are the result, and those of copies in blocks.
    """
    n = len(texts)
    members = set_table(df, key, texts)
    matches = verified(buckets(members, n).pairs().distinct(), members, n)
    who = members.select("id", "k1", "k2").distinct()
    matches = cut(matches.select("a1", "a2", "b1", "b2"), "matches")
    left = matches.join(who.select(F.col("id").alias("x"), F.col("k1").alias("a1"), F.col("k2").alias("a2")), ["a1", "a2"])
    both = left.join(who.select(F.col("id").alias("y"), F.col("k1").alias("b1"), F.col("k2").alias("b2")), ["b1", "b2"]).select("x", "y")
    copied = who.join(who.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1"), ["k1", "k2"])
    x, y, on = in_blocks(copied, ["k1", "k2"])
    every = both.unionByName(x.join(y, on & (F.col("x_id") < F.col("y_id"))).select(F.col("x_id").alias("x"), F.col("y_id").alias("y")))
    return every.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def near_groups(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """One row per record with words in every text: key, group_id (the least key of the group), group_size, classes.

    Groups are the connected components of the matches; classes: how many different word sets
    the group has.  Pairs of copies are never formed, nor all pairs of a family of like texts.
    """
    n = len(texts)
    members = set_table(df, key, texts)
    candidates, found = buckets(members, n).links(lambda pairs: verified(pairs, members, n))
    matches = verified(candidates.distinct(), members, n)
    for more in found:
        matches = matches.unionByName(more)
    name = lambda p: F.concat_ws(":", f"{p}1", f"{p}2")
    found = components(matches.select(name("a").alias("a"), name("b").alias("b")))
    who = members.select("id", name("k").alias("class")).distinct()
    named = who.join(found.withColumnRenamed("node", "class"), "class", "left")
    named = cut(named.select("id", "class", F.coalesce("component", "class").alias("component")), "named")
    sizes = named.groupBy("component", "class").agg(F.min("id").alias("i"), F.count("*").alias("n"))
    sizes = sizes.groupBy("component").agg(F.min("i").alias("group_id"), F.sum("n").alias("group_size"), F.count("*").alias("classes"))
    return named.join(sizes, "component").select(F.col("id").alias(key), "group_id", "group_size", "classes")
