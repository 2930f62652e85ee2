"""Counts, histograms, statistics and quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str, **missing: str) -> DataFrame:
    """(keys, n); ``missing`` names the value that stands for null."""
    for name, value in missing.items():
        df = df.withColumn(name, F.coalesce(name, F.lit(value)))
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values, ties to the least value."""
    return count_by(df, key).orderBy(F.desc("n"), F.asc_nulls_last(key)).limit(n)


def capped_histogram(df: DataFrame, size: Column, most: int) -> DataFrame:
    """(size, n), sizes above ``most`` together (A10)."""
    return df.groupBy(F.least(size, F.lit(most)).alias("size")).agg(F.count("*").alias("n"))


def with_min_count(df: DataFrame, *keys: str, least: int) -> DataFrame:
    """(keys, n) of groups with at least ``least`` rows."""
    return count_by(df, *keys).where(F.col("n") >= least)


def vote_winner(votes: DataFrame, item: str, rater: str, choice: str, least: int = 2) -> DataFrame:
    """(item, choice, votes) where one choice has at least ``least`` votes and strictly more than any other.

    A rater's repeated vote counts once; null choices are no votes.
    """
    counts = votes.where(F.col(choice).isNotNull()).select(item, rater, choice).distinct().groupBy(item, choice).agg(F.count("*").alias("votes"))
    w = W.partitionBy(item).orderBy(F.desc("votes"), choice)
    ranked = counts.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("votes").over(w))
    return ranked.where((F.col("_r") == 1) & (F.col("votes") >= least) & (F.col("votes") > F.coalesce("_next", F.lit(0)))).select(item, choice, "votes")


def tag_clusters(df: DataFrame, key: str, tags: str, pair_least: int, single_least: int, most: int = 2) -> DataFrame:
    """(key, cluster): neighbouring tag pairs seen often, else single tags seen often, at most ``most`` a row."""
    n = F.size(tags)
    pairs = F.when(n > 1, F.zip_with(F.slice(tags, F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(tags, F.lit(2), F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws(" + ", a, b)))
    one = lambda c: df.select(key, F.posexplode(c).alias("place", "cluster"))

    def often(rows: DataFrame, least: int) -> DataFrame:
        return rows.join(with_min_count(rows, "cluster", least=least).select("cluster"), "cluster")

    both = often(one(pairs), pair_least)
    rest = often(one(F.col(tags)), single_least).join(both.select(key).distinct(), key, "left_anti")
    every = both.unionByName(rest)
    return every.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("place", "cluster"))).where(F.col("_r") <= most).select(key, "cluster")


def spread(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """n, mean, least, greatest and the 90th percentile of a column, nulls and NaN left out."""
    v = F.when(~F.isnan(x), F.col(x))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.percentile(v, F.lit(0.9)).alias("p90"))


def scoped_averages(df: DataFrame, x: str, scope: str, category: str) -> DataFrame:
    """Average and count of a score by scope and category, by either, and over all, in one pass."""
    rows = df.select(F.col(scope).alias("scope"), F.col(category).alias("category"), F.when(~F.isnan(x), F.col(x)).alias("_x"))
    out = rows.groupingSets([[F.col("scope"), F.col("category")], [F.col("scope")], [F.col("category")], []], F.col("scope"), F.col("category"))
    out = out.agg(F.avg("_x").alias("mean"), F.count("_x").alias("n"), F.grouping_id().alias("level"))
    name = lambda c, bit: F.when(F.col("level").bitwiseAND(bit) > 0, F.lit("all")).otherwise(F.coalesce(c, F.lit("none")))
    return out.select(name(F.col("scope"), 2).alias("scope"), name(F.col("category"), 1).alias("category"), "mean", "n")


def confusion(df: DataFrame, true: str, said: str) -> DataFrame:
    """(true, said, n)."""
    return df.groupBy(F.col(true).alias("true"), F.col(said).alias("said")).agg(F.count("*").alias("n"))


def label_accuracy(df: DataFrame, label: str, run: str, correct: Column) -> DataFrame:
    """Accuracy of each label: the mean over runs of its accuracy in a run."""
    each = df.groupBy(label, run).agg(F.avg(correct.cast("double")).alias("a"))
    return each.groupBy(label).agg(F.avg("a").alias("accuracy"), F.count("*").alias("runs"))


def stability(df: DataFrame, item: str, wrong: Column) -> DataFrame:
    """(item, runs, wrong, class): wrong in none, all or some of its runs."""
    n = df.groupBy(item).agg(F.count("*").alias("runs"), F.count_if(wrong).alias("wrong"))
    return n.withColumn("class", F.when(F.col("wrong") == 0, "always_right").when(F.col("wrong") == F.col("runs"), "always_wrong").otherwise("unstable"))


def modal(df: DataFrame, item: str, value: str) -> DataFrame:
    """(item, value): the most frequent value, ties to the least."""
    n = df.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.count("*").alias("_n"))
    return n.groupBy(item).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def enrichment(df: DataFrame, group: Column, flags: list[str]) -> DataFrame:
    """(feature, inside, outside, delta): how often each flag holds in a group and outside it."""
    rates = df.agg(*[F.avg(F.when(group if inside else ~group, F.col(f).cast("double"))).alias(f"{f}_{inside:d}") for f in flags for inside in (True, False)])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_1").alias("inside"), F.col(f"{f}_0").alias("outside")) for f in flags]))
    return rates.select(rows.alias("r")).select("r.*", (F.col("r.inside") - F.col("r.outside")).alias("delta"))


def distinct_counts(df: DataFrame, *xs: str, about: float | None = None) -> DataFrame:
    """Numbers of different values, exact, or estimated with a relative error."""
    f = (lambda x: F.approx_count_distinct(x, about)) if about else F.countDistinct
    return df.agg(*[f(x).alias(x) for x in xs])


def anchors(pairs: DataFrame, key: str, order: str, other: str, score: str, metadata: str | None = None, least: float = 0.5, most: int = 100_000) -> DataFrame:
    """One row a key: the last text scored at least ``least`` as positive, the others as negatives in order.

    A record is one row, so a key of more than ``most`` pairs is an error and is not cut.
    """
    good = F.col(score) >= least
    aggs = [F.max_by(F.when(good, F.col(other)), F.when(good, F.col(order))).alias("positive"), F.array_sort(F.collect_list(F.when(~good, F.struct(order, other)))).alias("_n")]
    aggs.append(F.count("*").alias("_many"))
    if metadata:
        aggs.append(F.aggregate(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.map_entries(metadata).alias("m")))), F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(acc, F.map_from_entries(x["m"]))).alias(metadata))
    out = pairs.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(key).agg(*aggs)
    out = out.where(F.when(F.col("_many") <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"a key has more than {most} pairs")).cast("boolean"))).drop("_many")
    return out.where("positive IS NOT NULL").withColumn("negatives", F.col("_n")[other]).drop("_n")


def apportion(weights: DataFrame, group: str, weight: str, total: int, order: str | None = None) -> DataFrame:
    """(group, quota): ``total`` shared by weight, whole parts first, the rest to the largest remainders.

    Ties go to ``order``, else to the group's name.  Null and negative weights count as 0.
    The weights are one row a group: a small table.
    """
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0)).cast("double"), F.lit(0.0))
    exact = weights.select(group, *([order] if order and order != group else []), (w / F.sum(w).over(W.partitionBy()) * total).alias("_e"))
    r = exact.withColumn("_f", F.floor("_e")).withColumn("_left", F.lit(total) - F.sum("_f").over(W.partitionBy()))
    rank = F.row_number().over(W.orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), order or group))
    return r.withColumn("_r", rank).select(group, (F.col("_f") + (F.col("_r") <= F.col("_left")).cast("int")).cast("bigint").alias("quota"))


def cap_and_redistribute(groups: DataFrame, group: str, target: str, pool: str) -> DataFrame:
    """(group, quota): targets clipped to the pools; what is missing goes one by one to every group with room, pass after pass.

    The last pass may not reach all: those with most room left come first, then by name.  The
    passes are counted and not walked: with the rooms in order, L whole passes give each
    group min(room, L).  groups: one row a group, a small table; null numbers count as 0.
    """
    whole = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("bigint")
    clipped = groups.select(group, whole(target).alias("_t"), whole(pool).alias("_p")).withColumn("_q", F.least("_t", "_p")).withColumn("_room", F.col("_p") - F.col("_q"))
    every, before = W.partitionBy(), W.orderBy("_room", group).rowsBetween(W.unboundedPreceding, -1)
    s = clipped.withColumn("_missing", F.least(F.sum("_t").over(every), F.sum("_p").over(every)) - F.sum("_q").over(every))
    s = s.withColumn("_smaller", F.coalesce(F.sum("_room").over(before), F.lit(0))).withColumn("_from", F.count("*").over(every) - F.count("*").over(before))
    s = s.withColumn("_full", F.col("_smaller") + F.col("_room") * F.col("_from") <= F.col("_missing"))  # so many passes fill the group
    left, many = F.col("_missing") - F.sum(F.when(F.col("_full"), F.col("_room")).otherwise(0)).over(every), F.count_if(~F.col("_full")).over(every)
    s = s.withColumn("_passes", F.when(F.col("_full"), F.col("_room")).otherwise(F.floor(left / F.greatest(many, F.lit(1)))))
    s = s.withColumn("_rest", F.col("_missing") - F.sum("_passes").over(every)).withColumn("_more", F.col("_room") - F.col("_passes"))
    last = F.row_number().over(W.orderBy(F.desc("_more"), group)) <= F.col("_rest")
    return s.select(group, (F.col("_q") + F.col("_passes") + last.cast("int")).cast("bigint").alias("quota"))


def case(pairs: list[tuple[Column, object]], other: object = None) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda c, p: F.when(p[0], F.lit(p[1])).otherwise(c), reversed(pairs), F.lit(other))
