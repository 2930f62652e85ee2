"""Unions, mixes and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.sampling import sample


def union_all(*dfs: DataFrame) -> DataFrame:
    """All rows; columns that one side lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def mix(parts: dict[str, tuple[DataFrame, int]], key: str, seed: int) -> DataFrame:
    """Of each named part a seeded sample of its size, with ``component`` saying where a row is from."""
    return union_all(*[sample(df, key, n, f"{seed}|{name}").withColumn("component", F.lit(name)) for name, (df, n) in sorted(parts.items())])


def leave_one_out(df: DataFrame, component: str, most: int = 1_000) -> DataFrame:
    """(left_out, row): for each component all rows but its own.

    The result repeats the rows for every component, so more than ``most`` of them are an error.
    """
    names = df.select(F.col(component).alias("left_out")).where("left_out IS NOT NULL").distinct()
    if names.count() > most:
        raise ValueError(f"more than {most} components")
    return df.join(F.broadcast(names), F.col(component) != F.col("left_out"))


def ratios(groups: DataFrame, group: str, size: str, shares: list[float]) -> DataFrame:
    """(group, share, n): the rows of each group under every share (U4)."""
    return groups.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).select(group, "share", F.floor(F.col(size) * F.col("share")).cast("bigint").alias("n"))


def common_keys(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys on both sides."""
    return a.select(*keys).intersect(b.select(*keys))


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    j = left.join(right, key, "full").where("_a IS NULL OR _b IS NULL")
    return j.select(key, F.when(F.col("_a").isNotNull(), "left").otherwise("right").alias("side"))


def without(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key the other side hasn't."""
    return df.join(other.select(*keys), list(keys), "left_anti")
