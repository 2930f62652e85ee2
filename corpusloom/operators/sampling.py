"""Seeded draws, splits, quotas and orders.

Every draw orders rows by the MD5 of seed and key, so its result depends on the data and the
seed only.  Rows with the same key are one row to a draw.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.matching import hashed
from corpusloom.operators.ranking import numbered, ordered
from corpusloom.session import cut

#: Buckets of the hash in which a total order is numbered.
BUCKETS = 256
#: Different sets of labels that ``need_selection`` chooses among, at most.
MOST_SETS = 100_000


def shuffled(df: DataFrame, key: str, seed: int | str, name: str = "rank") -> DataFrame:
    """Adds the place of each row in a seeded order of all rows, from 0.

    The order is that of the hash; rows are numbered in 256 ranges of its first byte, so no
    task holds them all.
    """
    h = df.withColumn("_h", hashed(seed, key)).withColumn("_b", F.substring("_h", 1, 2))
    one = h.withColumn("_all", F.lit(0))
    return numbered(one, ["_all"], "_b", ["_h", key], name).drop("_h", "_b", "_all")


def sample(df: DataFrame, key: str, n: int, seed: int | str, exact: bool = False) -> DataFrame:
    """n rows of a seeded order (W2); with ``exact`` too few rows are an error, raised when the plan runs.

    A top-n by hash, which Spark takes with a partial top-n in every task.
    """
    out = df.orderBy(hashed(seed, key), key).limit(n)
    if exact:
        short = df.agg(F.assert_true(F.count("*") >= n, F.lit(f"fewer than {n} rows")).alias("_ok"))
        out = out.join(F.broadcast(short)).where("_ok IS NULL").drop("_ok")
    return out


def repeated(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """(rows, epoch, draw): n draws that use all rows once before any twice, each round in its own order."""
    size = df.count()
    if not size or n <= 0:
        return df.limit(0).withColumn("epoch", F.lit(0)).withColumn("draw", F.lit(0).cast("bigint"))
    rounds = -(-n // size)
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    h = each.withColumn("_h", hashed(seed, "epoch", key)).withColumn("_b", F.substring("_h", 1, 2))
    ranked = numbered(h, ["epoch"], "_b", ["_h", key], "_r").drop("_h", "_b")
    return ranked.withColumn("draw", F.col("epoch") * F.lit(size).cast("bigint") + F.col("_r")).where(F.col("draw") < n).drop("_r")


def with_replacement(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """(rows, draw): n independent draws (W4): draw i takes the row whose number is the hash of i, modulo the rows."""
    size = df.count()
    rows = shuffled(df, key, seed, "_i")
    draws = df.sparkSession.range(n if size else 0).withColumnRenamed("id", "draw")
    draws = draws.withColumn("_i", F.pmod(F.conv(F.substring(hashed(seed, "draw"), 1, 12), 16, 10).cast("bigint"), F.lit(max(1, size))))
    return draws.join(rows, "_i").drop("_i")


def complement(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """Exactly the rows that ``sample`` doesn't take."""
    return shuffled(df, key, seed, "_r").where(F.col("_r") >= n).drop("_r")


def stratified_split(df: DataFrame, key: str, strata: list[str], share: float, seed: int | str, name: str = "part") -> DataFrame:
    """Adds ``validation`` or ``train``: of each stratum of more than one row at least one and the half-even rounded share is validation."""
    h = df.withColumn("_h", hashed(seed, key)).withColumn("_b", F.substring("_h", 1, 2))
    ranked = numbered(h, strata, "_b", ["_h", key], "_r").drop("_h", "_b")
    n = df.groupBy(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)]).agg(F.count("*").alias("_n"))
    same = [F.col(s).eqNullSafe(F.col(f"_s{i}")) for i, s in enumerate(strata)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    held = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.bround(F.col("_n") * share))).otherwise(0)
    return ranked.join(n, on).withColumn(name, F.when(F.col("_r") < held, "validation").otherwise("train")).select(*df.columns, name)


def per_group(df: DataFrame, key: str, group: str, most: int, seed: int | str) -> DataFrame:
    """At most ``most`` rows of each group in seeded order (W7); rows without group are dropped.

    Spark limits a window by rank before the shuffle, so each task sends at most that many of a group.
    """
    w = W.partitionBy(group).orderBy(hashed(seed, key), key)
    return df.where(F.col(group).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def even_quota(groups: DataFrame, group: str, total: int) -> DataFrame:
    """(group, quota): total div groups each, one more for the first ones by name (W8).  One row a group."""
    w = W.orderBy(group)
    return groups.select(group).distinct().withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(W.partitionBy())).select(group, (F.floor(F.lit(total) / F.col("_n")) + (F.col("_r") <= F.lit(total) % F.col("_n")).cast("int")).cast("bigint").alias("quota"))


def quality_pick(df: DataFrame, key: str, group: str, quality: list[Column], most: int, seed: int | str, pool: int = 4) -> DataFrame:
    """Of each group the best ``pool`` times ``most`` rows, and of these ``most`` at random."""
    best = W.partitionBy(group).orderBy(*quality, key)
    rest = W.partitionBy(group).orderBy(hashed(seed, key), key)
    top = df.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= pool * most)
    return top.withColumn("_r", F.row_number().over(rest)).where(F.col("_r") <= most).drop("_r")


def need_selection(df: DataFrame, key: str, labels: str, targets: dict[str, int], count: int, seed: int | str, overfill: float = 1.0, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, labels): ``count`` rows, each the one whose labels are still needed most, none with a label that is overfull.

    The need of a row is what its labels lack to their targets, summed; ties go to more labels,
    then to the larger sum of their weights, then by name.  A label is full at its target
    times ``overfill``, at one row at least.  Once no row is needed any more, rows without a
    full label are drawn at random.  Labels without a target neither need nor forbid.

    Rows with the same labels are equal to the choice, so it works on the number of rows of
    each set of labels, counted over all rows; then the first rows of each set in seeded
    order are taken.  More than MOST_SETS different sets are an error.
    """
    known = F.array(*[F.lit(x) for x in sorted(targets)]) if targets else F.array().cast("array<string>")
    rows = df.select(key, labels, F.array_sort(F.array_intersect(F.coalesce(labels, F.array().cast("array<string>")), known)).alias("_s"))
    sets = rows.groupBy("_s").agg(F.count("*").alias("n")).limit(MOST_SETS + 1).collect()
    if len(sets) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} sets of labels")
    take = _by_need(sorted((tuple(r["_s"]), r["n"]) for r in sets), targets, count, seed, overfill, weights or {})
    if not take:
        return df.select(key, labels).limit(0)
    table = df.sparkSession.createDataFrame([(list(s), n) for s, n in take.items()], "_s array<string>, _n bigint")
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("_s").orderBy(hashed(seed, key), key))).where(F.col("_r") <= max(take.values()))
    return ranked.join(F.broadcast(table), "_s").where("_r <= _n").select(key, labels)


def _by_need(sets: list[tuple[tuple[str, ...], int]], targets: dict[str, int], count: int, seed: int | str, overfill: float, weights: dict[str, float]) -> dict[tuple[str, ...], int]:
    """How many rows of each set of labels are chosen."""
    names = sorted(targets)
    sets = sorted(sets, key=lambda s: (-len(s[0]), -sum(weights.get(x, 0.0) for x in s[0]), s[0]))  # the order of ties
    has = np.array([[x in s for x in names] for s, _ in sets], bool).reshape(len(sets), len(names))
    left = np.array([n for _, n in sets], np.int64)
    target = np.array([targets[x] for x in names], np.int64)
    full = np.maximum(1, np.round(target * overfill)).astype(np.int64)
    got, taken, rng = np.zeros(len(names), np.int64), np.zeros(len(sets), np.int64), random.Random(f"{seed}")
    for _ in range(count):
        free = (left > 0) & ~(has & (got >= full)).any(1)
        if not free.any():
            break
        need = np.where(free, has @ np.maximum(0, target - got), -1)
        best = int(need.argmax())
        if need[best] <= 0:
            best = rng.choices(range(len(sets)), np.where(free, left, 0))[0]
        taken[best] += 1
        left[best] -= 1
        got += has[best]
    return {s: int(n) for (s, _), n in zip(sets, taken, strict=True) if n}


def scarce_first(df: DataFrame, key: str, groups: str, targets: dict[str, int], seed: int | str, exact: bool = True) -> DataFrame:
    """(group, key): each group's number of rows, a row in one group only; groups with the fewest rows choose first.

    A group takes the first rows of its own seeded order that no group before it took.  At
    most the rows of the groups before it are taken, so only that many beyond its own are
    looked at: a rank over all rows, and then one small step a group.  Too few rows are an
    error, or with ``exact`` false a smaller group.  Rows whose groups are null are in none.
    """
    spark = df.sparkSession
    each = df.select(F.col(key).alias("_k"), F.explode(F.array_distinct(groups)).alias("_g")).where(F.col("_g").isin(*targets)).distinct()
    size = {r["_g"]: r["n"] for r in each.groupBy("_g").agg(F.count("*").alias("n")).collect()}
    order = sorted(targets, key=lambda g: (size.get(g, 0), g))
    reach = dict(zip(order, itertools.accumulate(targets[g] for g in order), strict=True))
    looked = F.broadcast(spark.createDataFrame(list(reach.items()), "_g string, _n bigint"))
    ranked = each.withColumn("_h", hashed(seed, "_g", "_k")).withColumn("_r", F.row_number().over(W.partitionBy("_g").orderBy("_h", "_k"))).where(F.col("_r") <= max(reach.values(), default=0))
    pool = cut(ranked.join(looked, "_g").where("_r <= _n").select("_g", "_k", "_h"), "pool")
    taken = pool.limit(0).select("_g", "_k")
    for g in order:
        mine = pool.where(F.col("_g") == g).join(taken.select("_k"), "_k", "left_anti").orderBy("_h", "_k").limit(targets[g]).select("_g", "_k")
        taken = cut(taken.unionByName(mine), "taken")
        if exact and (n := taken.where(F.col("_g") == g).count()) < targets[g]:
            raise ValueError(f"{g} has {n} rows of {targets[g]}")
    return taken.select(F.col("_g").alias("group"), F.col("_k").alias(key))


def coverage_support(df: DataFrame, key: str, labels: str, k: int, seed: int | str) -> DataFrame:
    """(key, labels): rows in seeded order that have a label with fewer than k rows so far.

    A row is kept exactly if it is among the first k of one of its labels: the first k of a
    label are all kept, and after them it has its k rows.  So this is a rank over all rows,
    which Spark limits before the shuffle.
    """
    each = df.select(key, labels, F.explode(F.array_distinct(labels)).alias("_l"))
    place = F.dense_rank().over(W.partitionBy("_l").orderBy(hashed(seed, key), key))
    return each.withColumn("_r", place).where(F.col("_r") <= k).select(key, labels).distinct()


def round_robin(df: DataFrame, key: str, group: str, seed: int | str, most: int | None = None) -> DataFrame:
    """(rows, turn): one row of each group after another, groups by name.

    With ``most`` the first rows of that order: a rank with a limit; without, the rows of a group are numbered in ranges of the hash.
    """
    some = df.where(F.col(group).isNotNull())
    if most is None:
        return numbered(some.withColumn("_h", hashed(seed, key)).withColumn("_b", F.substring("_h", 1, 2)), [group], "_b", ["_h", key], "turn").drop("_h", "_b")
    w = W.partitionBy(group).orderBy(hashed(seed, key), key)
    ranked = some.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return ranked.withColumn("turn", (F.col("_r") - 1).cast("bigint")).drop("_r").orderBy("turn", group).limit(most)


def rank01(df: DataFrame, x: str, key: str, group: str, name: str = "rank01") -> DataFrame:
    """Adds the place of each value in its group by value and key, scaled to 0..1; 0 in a group of one."""
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    r = ordered(df, [group], [x, key], "_r").join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    return r.withColumn(name, F.when(F.col("_n") > 1, F.col("_r") / (F.col("_n") - 1)).otherwise(0.0)).drop("_r", "_n", "_g")


def zscore(df: DataFrame, x: str, group: str, name: str = "zscore") -> DataFrame:
    """Adds the value less the mean of its group, by the population deviation; 0 where that is nearly 0.

    Mean and deviation are aggregated first and joined, so a large group isn't a window.
    """
    stats = df.groupBy(F.col(group).alias("_g")).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    j = df.join(stats, F.col(group).eqNullSafe(F.col("_g")))
    return j.withColumn(name, F.when(F.col("_s") > 1e-12, (F.col(x) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_g", "_m", "_s")


def worst_per_bucket(df: DataFrame, key: str, bucket: str, error: Column, most: int) -> DataFrame:
    """The ``most`` rows of each bucket with the largest error."""
    w = W.partitionBy(bucket).orderBy(F.abs(error).desc(), key)
    return df.where(F.col(bucket).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def scan_quota(df: DataFrame, place: str, group: str, quota: int) -> DataFrame:
    """The first ``quota`` rows of each group in scan order, as if the scan stopped when all groups are full."""
    w = W.partitionBy(group).orderBy(place)
    return df.where(F.col(group).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota).drop("_r")


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of a total order."""
    return df.orderBy(*order).limit(k)


def top_k_per_key(df: DataFrame, key: str, k: int, *order: Column | str, name: str = "place") -> DataFrame:
    """The first k rows of each key with their place, from 1."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col(name) <= k).withColumn(name, F.col(name).cast("bigint"))


def in_blocks(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
