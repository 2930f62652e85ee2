"""Removal of repeated rows, with a survivor that depends on the data alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_wins(df: DataFrame, *key: Column | str, order: list[str], drop_null: bool = True) -> DataFrame:
    """The first row in ``order`` of each key.

    One aggregation with a partial minimum before the shuffle, so a key that very many rows
    share costs one row a task; no sort of the groups.  Rows equal in ``order`` too: one of
    them, chosen by the whole row.  Rows with a null in the key are dropped, or kept once.
    """
    keys = [_c(k).alias(f"_k{i}") for i, k in enumerate(key)]
    names = [f"_k{i}" for i in range(len(key))]
    row = F.struct(*[F.col(c) for c in df.columns])
    tie = F.xxhash64(*[F.to_json(F.struct(F.col(c))) if isinstance_map(df, c) else F.col(c) for c in df.columns])
    cols = df.select(*keys, F.struct(*[F.col(o) for o in order], tie.alias("_tie")).alias("_o"), row.alias("_row"))
    if drop_null:
        cols = cols.where(" AND ".join(f"{n} IS NOT NULL" for n in names))
    return cols.groupBy(*names).agg(F.min_by("_row", "_o").alias("_row")).select("_row.*")


def isinstance_map(df: DataFrame, name: str) -> bool:
    return "map<" in df.schema[name].dataType.simpleString()


def prefix_key(x: Column | str, n: int) -> Column:
    """The first n characters as a key (A2)."""
    return F.substring(_c(x), 1, n)


def unordered_key(a: Column | str, b: Column | str) -> Column:
    """One key for a pair and its reverse; null if either is."""
    x, y = _c(a), _c(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.array(F.least(x, y), F.greatest(x, y)))


def array_first(x: Column | str) -> Column:
    """The different elements in their first order; a null array stays null."""
    return F.array_distinct(_c(x))
