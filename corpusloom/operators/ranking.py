"""Ranks over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.session import cut


def numbered(df: DataFrame, group: list[str], bucket: str, order: list[str | Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, ... within each group, by ``bucket`` and then ``order``.

    A group is ranked bucket by bucket and the counts of the buckets before are added, so a
    group that holds a third of all rows is spread over as many tasks as it has buckets.
    Rows equal in bucket and order get different ranks in no stated order; a null bucket comes first.
    """
    counts = df.groupBy(*group, bucket).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*group).orderBy(F.col(bucket).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col(bucket).alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    ranked = df.withColumn("__r", F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order)).cast("bigint") - 1)
    match = F.col(bucket).eqNullSafe(F.col("__b"))
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return ranked.join(offsets, match).withColumn(name, F.col("__r") + F.col("__o")).select(*df.columns, name)


def cumulated(df: DataFrame, group: list[str], bucket: str, order: list[str | Column], x: str, name: str) -> DataFrame:
    """Add ``name``: the sum of x over the rows of the group before this one, by ``bucket`` and then ``order``; split as in ``numbered``.

    Rows equal in bucket and order come one after the other in no stated order.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(x).alias("__n"))
    before = W.partitionBy(*group).orderBy(F.col(bucket).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col(bucket).alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    upto = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = df.withColumn("__r", F.coalesce(F.sum(x).over(upto), F.lit(0)))
    match = F.col(bucket).eqNullSafe(F.col("__b"))
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return summed.join(offsets, match).withColumn(name, F.col("__r") + F.col("__o")).select(*df.columns, name)


def in_blocks(rows: DataFrame, keys: list[str], block: int = 512) -> tuple[DataFrame, DataFrame, Column]:
    """Two copies x, y of rows (keys, id, n, ...) and the condition of their join: all pairs within a key, in blocks of about ``block``².

    n: how many rows the key has.  A row comes once for each block of its key, so a key of
    any size is spread over as many tasks as it has pairs of blocks.  The condition holds
    once for each ordered pair of rows; which of the two orders is wanted the caller adds.
    """
    k = F.ceil(F.col("n") / block).cast("int")
    own = rows.withColumn("_b", F.pmod(F.xxhash64("id"), k).cast("int"))
    each = own.withColumn("_o", F.explode(F.sequence(F.lit(0), k - 1))).withColumn("_u", F.least("_b", "_o")).withColumn("_v", F.greatest("_b", "_o"))
    x, y = (each.select(*[F.col(c).alias(f"{side}_{c}") for c in (*rows.columns, "_b", "_u", "_v")]) for side in "xy")
    on = (F.col("x__u") == F.col("y__u")) & (F.col("x__v") == F.col("y__v")) & ((F.col("x__u") == F.col("x__v")) | (F.col("x__b") != F.col("y__b")))
    for c in keys:
        on = on & (F.col(f"x_{c}") == F.col(f"y_{c}"))
    return x, y, on


def salt(key: Column | str, salts: int, seed: int = 0) -> Column:
    """A number below ``salts`` from a hash of the key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(salts)).cast("int")


def ordered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, ... within each group by the columns of ``order``.

    The rows are sorted into ranges by group and order and written once; then the ranges are
    the buckets of ``numbered``, so a large group is spread over as many tasks as it has ranges.
    """
    ranged = df.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id())
    return numbered(cut(ranged, "ordered"), group, "__range", list(order), name).drop("__range")


def others(own: Column, draw: Column, of: int) -> Column:
    """A number below ``of`` other than ``own``: that of draw 0, 1, ... ; different draws below of - 1 give different numbers."""
    return F.pmod(own + 1 + F.pmod(draw, F.lit(max(1, of - 1))), F.lit(max(1, of)))
