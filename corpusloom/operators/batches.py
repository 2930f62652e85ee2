"""Batches with an explicit place for every record: (batch_id, slot).

A batch is a stated arrangement of draws, so each layout is a formula from the number of a
slot to the number of a draw, and one join; no layout walks over batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.matching import hashed, number_of
from corpusloom.operators.ranking import numbered


def _ranked(df: DataFrame, key: str, group: str, seed: int) -> DataFrame:
    """(key, group, i, n): seeded place in the group and its size, ranked in hash ranges."""
    h = df.where(F.col(group).isNotNull()).select(key, group).withColumn("_h", hashed(seed, key)).withColumn("_b", F.substring("_h", 1, 2))
    n = h.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n"))
    return numbered(h, [group], "_b", ["_h", key], "i").join(n, F.col(group) == F.col("_g")).select(key, group, "i", "n")


def label_balanced(df: DataFrame, key: str, label: str, labels: int, records: int, batches: int, seed: int) -> DataFrame:
    """(batch_id, slot, label, key): ``labels`` labels a batch by rotation, ``records`` each; a label's records come again when used up.

    Labels with fewer than two records are left out.
    """
    ranked = _ranked(df, key, label, seed).where("n > 1")
    names = ranked.select(F.col(label).alias("_l"), "n").distinct()
    names = names.withColumn("_k", F.row_number().over(W.orderBy("_l")) - 1)
    many = max(1, names.count())
    spark = df.sparkSession
    cells = spark.range(batches * labels * records).select(F.floor(F.col("id") / (labels * records)).alias("batch_id"), F.pmod("id", F.lit(labels * records)).alias("slot"))
    cells = cells.withColumn("_turn", F.col("batch_id") * labels + F.floor(F.col("slot") / records)).withColumn("_j", F.pmod("slot", F.lit(records)))
    placed = cells.withColumn("_k", F.pmod("_turn", F.lit(many)).cast("int")).join(names, "_k")
    placed = placed.withColumn("_i", F.pmod(F.floor(F.col("_turn") / many) * records + F.col("_j"), F.col("n")))
    j = placed.select("batch_id", "slot", "_l", "_i").join(ranked.select(key, F.col(label).alias("_l"), F.col("i").alias("_i")), ["_l", "_i"])
    return j.select("batch_id", "slot", F.col("_l").alias(label), key)


def score_balanced(df: DataFrame, key: str, bucket: str, per: int, seed: int) -> DataFrame:
    """(batch_id, slot, bucket, key): ``per`` records of every bucket in each batch, until the first bucket is used up (B2)."""
    ranked = _ranked(df, key, bucket, seed)
    names = ranked.select(bucket, "n").distinct()
    names = names.select(F.col(bucket).alias("_g"), (F.row_number().over(W.orderBy(bucket)) - 1).alias("_k"), F.floor(F.min("n").over(W.partitionBy()) / per).alias("_batches"))
    j = ranked.join(names, F.col(bucket) == F.col("_g")).withColumn("batch_id", F.floor(F.col("i") / per)).where(F.col("batch_id") < F.col("_batches"))
    return j.select("batch_id", (F.col("_k") * per + F.pmod("i", F.lit(per))).alias("slot"), bucket, key)


def random_labels(df: DataFrame, key: str, label: str, labels: int, texts: int, batches: int, seed: int) -> DataFrame:
    """(batch_id, slot, label, key): in each batch labels from a hashed order, from where the batch's hash points, with texts of each drawn by hash."""
    ranked = _ranked(df, key, label, seed)
    names = ranked.select(F.col(label).alias("_l"), "n").distinct()
    names = names.withColumn("_no", (F.row_number().over(W.orderBy(hashed(seed, "_l"), "_l")) - 1).cast("bigint"))
    many = names.count()
    picks = df.sparkSession.range(batches).withColumnRenamed("id", "batch_id").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(max(1, min(labels, many)) - 1))))
    picks = picks.withColumn("_no", F.pmod(number_of(hashed(seed, "batch_id")) + F.col("_k"), F.lit(max(1, many)))).join(names, "_no")
    cells = picks.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(texts - 1)))).where(F.col("_j") < F.col("n"))
    cells = cells.withColumn("_i", F.pmod(number_of(hashed(seed, "_l", "batch_id")) + F.col("_j"), F.col("n")))
    j = cells.select("batch_id", (F.col("_k") * texts + F.col("_j")).cast("bigint").alias("slot"), "_l", "_i").join(ranked.select(key, F.col(label).alias("_l"), F.col("i").alias("_i")), ["_l", "_i"])
    return j.select("batch_id", "slot", F.col("_l").alias(label), key)


def hierarchical(df: DataFrame, key: str, outer: str, inner: str, inners: int, records: int, seed: int) -> DataFrame:
    """(batch_id, slot, outer, inner, key): batches of one outer label each, of ``inners`` inner labels with ``records`` records.

    Inner labels with fewer records than asked, and rests, are left out.
    """
    both = df.where(F.col(outer).isNotNull() & F.col(inner).isNotNull()).withColumn("_p", F.struct(outer, inner).cast("string"))
    ranked = _ranked(both, key, "_p", seed).join(both.select(F.col(key).alias("_key"), outer, inner), F.col(key) == F.col("_key"))
    groups = ranked.where(F.col("i") < F.floor(F.col("n") / records) * records).withColumn("_chunk", F.floor(F.col("i") / records))
    range_of = lambda c: F.floor(F.col(c) / 1000)  # noqa: E731  -- neighbouring numbers are ranked in one task, not all
    chunks = groups.select(outer, inner, "_chunk").distinct().withColumn("_range", range_of("_chunk"))
    cells = numbered(chunks, [outer], "_range", ["_chunk", inner], "_c").drop("_range")
    sizes = cells.groupBy(F.col(outer).alias("_outer")).agg(F.count("*").alias("_n"))
    full = cells.join(sizes, F.col(outer) == F.col("_outer")).drop("_outer").where(F.col("_c") < F.floor(F.col("_n") / inners) * inners)
    firsts = full.select(outer, F.floor(F.col("_c") / inners).alias("_b")).distinct().withColumn("_all", F.lit(0)).withColumn("_range", range_of("_b"))
    ids = numbered(firsts, ["_all"], "_range", ["_b", outer], "batch_id").drop("_all", "_range")
    j = groups.join(full, [outer, inner, "_chunk"]).withColumn("_b", F.floor(F.col("_c") / inners)).join(ids, [outer, "_b"])
    return j.select("batch_id", (F.pmod("_c", F.lit(inners)) * records + F.pmod("i", F.lit(records))).alias("slot"), outer, inner, key)


def support_query(df: DataFrame, key: str, label: str, supports: int, queries: int, seed: int) -> DataFrame:
    """(batch_id, slot, role, label, key): of each label in turn ``supports`` supports and ``queries`` queries a batch.

    All labels that still have a whole share are in a batch.
    """
    per = supports + queries
    ranked = _ranked(df, key, label, seed).withColumn("batch_id", F.floor(F.col("i") / per)).where(F.col("batch_id") < F.floor(F.col("n") / per))
    names = ranked.select(label).distinct().withColumn("_k", F.row_number().over(W.orderBy(label)) - 1).withColumnRenamed(label, "_g")
    j = ranked.join(names, F.col(label) == F.col("_g")).withColumn("_j", F.pmod("i", F.lit(per)))
    return j.select("batch_id", (F.col("_k") * per + F.col("_j")).alias("slot"), F.when(F.col("_j") < supports, "support").otherwise("query").alias("role"), label, key)


def interleave(parts: dict[str, tuple[DataFrame, int]], key: str, steps: int, seed: int) -> DataFrame:
    """(batch_id, slot, part, key): in every step fixed slots for each part; a part comes again when used up."""
    out, at = None, 0
    for name, (df, k) in parts.items():
        ranked = _ranked(df.withColumn("_part", F.lit(name)), key, "_part", seed)
        size = ranked.select("n").distinct()
        cells = df.sparkSession.range(steps * k).withColumnRenamed("id", "_cell").crossJoin(F.broadcast(size)).withColumn("_i", F.pmod("_cell", F.col("n")))
        one = cells.join(ranked.select(key, F.col("i").alias("_i")), "_i").select(F.floor(F.col("_cell") / k).alias("batch_id"), (F.pmod("_cell", F.lit(k)) + at).alias("slot"), F.lit(name).alias("part"), key)
        out, at = one if out is None else out.unionByName(one), at + k
    return out


def shuffle_blocks(df: DataFrame, batch: str, seed: int) -> DataFrame:
    """Batches in seeded order, their rows together and in place: batch becomes its new number."""
    ids = df.select(batch).distinct().withColumn("_h", hashed(seed, batch)).withColumn("_b", F.substring("_h", 1, 2)).withColumn("_all", F.lit(0))
    new = numbered(ids, ["_all"], "_b", ["_h", batch], "_new").select(F.col(batch).alias("_old"), "_new")
    return df.join(new, F.col(batch) == F.col("_old")).withColumn(batch, F.col("_new")).drop("_old", "_new")


def without_reuse(df: DataFrame, key: str, label: str, labels: int, records: int, seed: int) -> DataFrame:
    """(batch_id, slot, label, key): batches of ``labels`` labels with ``records`` records each, none used twice.

    A label has as many whole shares as its records allow.  Laid end to end, label by label,
    largest first, and dealt out column by column over the batches, no batch gets a label
    twice as long as no label has more shares than there are batches; surplus shares are left out.
    """
    ranked = _ranked(df, key, label, seed).withColumn("_share", F.floor(F.col("i") / records)).where(F.col("_share") < F.floor(F.col("n") / records))
    shares = ranked.groupBy(label).agg((F.max("_share") + 1).alias("_s"))
    few = shares.limit(1_000_001).toPandas()
    if len(few) > 1_000_000:
        raise ValueError("more than a million labels")
    sizes = sorted(few["_s"].tolist(), reverse=True)
    low, high = 0, sum(sizes) // labels
    while low < high:  # the most batches that can be filled when no label is in one twice
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(min(s, mid) for s in sizes) >= mid * labels else (low, mid - 1)
    capped = shares.withColumn("_s", F.least("_s", F.lit(low)))
    starts = capped.withColumn("_start", F.coalesce(F.sum("_s").over(W.orderBy(F.desc("_s"), label).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    j = ranked.join(starts.withColumnRenamed(label, "_g"), F.col(label) == F.col("_g")).where(F.col("_share") < F.col("_s")).withColumn("_p", F.col("_start") + F.col("_share")).where(F.col("_p") < low * labels)
    return j.select(F.pmod("_p", F.lit(max(1, low))).alias("batch_id"), (F.floor(F.col("_p") / max(1, low)) * records + F.pmod("i", F.lit(records))).alias("slot"), label, key)


def group_contiguous(df: DataFrame, key: str, group: str, size: int, seed: int) -> DataFrame:
    """(batch_id, slot, group, key): batches that lie inside one group; rests are dropped."""
    ranked = _ranked(df, key, group, seed).withColumn("_b", F.floor(F.col("i") / size)).where(F.col("_b") < F.floor(F.col("n") / size))
    count = ranked.select(group, F.floor(F.col("n") / size).alias("_m")).distinct()
    start = count.select(F.col(group).alias("_g"), F.coalesce(F.sum("_m").over(W.orderBy(group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    j = ranked.join(start, F.col(group) == F.col("_g"))
    return j.select((F.col("_s") + F.col("_b")).alias("batch_id"), F.pmod("i", F.lit(size)).alias("slot"), group, key)


def adaptive_size(df: DataFrame, texts: str, order: str, budget: int, first: int = 32) -> DataFrame:
    """(batch_size): budget by the 75th percentile of the number of texts among the first records, at least 1."""
    few = df.orderBy(order).limit(first)
    rank = F.row_number().over(W.orderBy(texts, order))
    at = few.withColumn("_r", rank).withColumn("_n", F.count("*").over(W.partitionBy())).where(F.col("_r") == F.ceil(F.col("_n") * 0.75))
    return at.select(F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col(texts), F.lit(1)))).cast("bigint").alias("batch_size"))


def plan_config(df: DataFrame, batch: int, name: str) -> DataFrame:
    """(name, records, steps): the numbers a training plan needs."""
    return df.agg(F.count("*").alias("records")).select(F.lit(name).alias("name"), "records", F.ceil(F.col("records") / batch).alias("steps"))
