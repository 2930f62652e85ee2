"""Records of the evaluation splits that also occur, exactly or almost, in the training split."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.setjoin import Buckets, Seen, crowds, set_table, verified
from corpusloom.llm.sketch import flatten, grouped_fingerprints
from corpusloom.session import cut

#: Bits of the fingerprint that each min-wise hash gives to a segment; a segment is some such groups.
GROUP_BITS = 8
#: Share of the pairs of similarity 2/3 that agree in a segment at least, which the number of segments follows.
RECALL = 0.93
#: How often two texts that have nothing to do with each other agree in a group, about: common words, and chance.
BACKGROUND = 0.035
#: Further bits for the Hamming test of a candidate, and the radius; of pairs of similarity 2/3 a sixth of the bits differ (21.3 +- 4.2).
CHECK_BITS, CHECK_RADIUS = 128, 34
#: Groups of a segment of a crowded code, and such segments: 0.998 of the pairs of similarity 2/3 agree in one.
SUB_GROUPS, SUB_SEGMENTS = 3, 18


def segments(groups: int) -> int:
    return math.ceil(math.log(1 - RECALL) / math.log(1 - (2 / 3) ** groups))


def layout(classes: int) -> tuple[int, int]:
    """(groups of a segment, segments): wide enough that a text meets less than one unlike one of so many classes by chance.

    Wider segments are more, so that the recall is the same for any number of classes.
    """
    groups = 6
    while classes * segments(groups) * BACKGROUND**groups > 1:
        groups += 1
    return groups, segments(groups)


def _codes(sets: DataFrame, groups: int, many: int, seed: int, hot: int | None = None) -> DataFrame:
    """(key, id, side, m1, m2) of each class: its segments' codes, with the check bits; crowded codes as in ``crowds``."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        seen = Seen()
        for b in batches:
            ids, side = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "side"))
            rest = np.array(seen.fresh(list(zip(ids.tolist(), side.tolist(), strict=True))), np.int64)
            w = [np.asarray(x, np.int64).view(np.uint64) for x in b.column("w0").take(pa.array(rest, pa.int64())).to_numpy(zero_copy_only=False)]
            for k in range(0, len(rest), 1000):
                at = rest[k : k + 1000]
                code, check = grouped_fingerprints(*flatten(w[k : k + 1000]), groups, many, GROUP_BITS, CHECK_BITS, seed)
                yield {"key": code.ravel(), "id": np.repeat(ids[at], many), "side": np.repeat(side[at], many), **{f"m{j + 1}": np.repeat(check[:, j], many) for j in range(2)}}

    def limited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return crowds(codes(batches), 1 << 62 if hot is None else hot)

    return sets.select("k1", "w0", F.col("eval").alias("side")).mapInArrow(limited, "key bigint, id bigint, side boolean, m1 bigint, m2 bigint")


def overlap_classes(df: DataFrame, key: str, text: str, split: str, train: str = "train", source: str | None = None, hot: int = 64) -> tuple[DataFrame, DataFrame]:
    """(members, matches) of classes across splits.

    members: (id, eval, k1, k2, ...) of all records that have words; matches: (a1, a2, b1, b2,
    sim) for each class a of the evaluation side and b of the training side that match,
    equal classes included.  A null split belongs to no side.
    """
    keep = {"eval": F.col(split) != train, "split": F.col(split)} | ({"source": F.col(source)} if source else {})
    members = set_table(df.where(F.col(split).isNotNull()), key, [text], **keep)
    groups, many = layout(members.where("eval").count())

    def refine(ids: DataFrame, level: int) -> DataFrame:
        own = members.join(ids, members.k1 == ids.id, "left_semi")
        return _codes(own, SUB_GROUPS, SUB_SEGMENTS, 100 + level).select("id", F.col("key").alias("sub")).distinct()

    differ = F.bit_count(F.col("x_m1").bitwiseXOR(F.col("y_m1"))) + F.bit_count(F.col("x_m2").bitwiseXOR(F.col("y_m2")))
    across = F.col("x_side") & ~F.col("y_side") & (differ <= CHECK_RADIUS)
    candidates = Buckets(lambda most: _codes(members, groups, many, 1, most), refine, across, hot).pairs().distinct()
    return members, cut(verified(candidates, members, 1), "matches")


def overlap_pairs(df: DataFrame, key: str, text: str, split: str, train: str = "train") -> DataFrame:
    """Every pair (key_a, key_b), key_a < key_b, of an evaluation and a training record whose texts match.

    Null and blank texts match nothing; a repeated key counts once.
    """
    members, matches = overlap_classes(df, key, text, split, train)
    who = members.select("id", "eval", "k1", "k2").distinct()
    held = who.where("eval").select(F.col("id").alias("x"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    trained = who.where("not eval").select(F.col("id").alias("y"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    both = matches.join(held, ["a1", "a2"]).join(trained, ["b1", "b2"])
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def overlap_report(df: DataFrame, key: str, text: str, split: str, source: str, train: str = "train") -> DataFrame:
    """Per evaluation split and source: records, overlapping records, those with an exact copy in train, pairs.

    Counted from classes; no pair of records is formed.  Records without words count as records only.
    """
    members, matches = overlap_classes(df, key, text, split, train, source)
    who = members.select("id", "eval", "split", "source", "k1", "k2").distinct()
    size = who.where("not eval").groupBy(F.col("k1").alias("b1"), F.col("k2").alias("b2")).agg(F.count("*").alias("n"))
    per_class = matches.join(size, ["b1", "b2"]).groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2"))
    per_class = per_class.agg(F.sum("n").alias("pairs"), F.max(((F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))).cast("int")).alias("exact"))
    found = who.where("eval").join(per_class, ["k1", "k2"]).groupBy("split", "source").agg(F.count("*").alias("overlapping"), F.sum("exact").alias("exact"), F.sum("pairs").alias("pairs"))
    every = df.where(F.col(split) != train).groupBy(F.col(split).alias("split"), F.col(source).alias("source")).agg(F.count("*").alias("records"))
    joined = every.join(found.withColumnsRenamed({"split": "_s", "source": "_o"}), (F.col("split") == F.col("_s")) & F.col("source").eqNullSafe(F.col("_o")), "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("overlapping", "exact", "pairs")}
    return joined.select("split", "source", "records", *zero.values(), (F.coalesce("overlapping", F.lit(0)) / F.col("records")).alias("share"))
