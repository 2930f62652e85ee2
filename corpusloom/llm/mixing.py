"""Records of several sources combined to target weights.

A curriculum over training time 0..1: each source has a schedule of its weight, the integral
of which is its demand, in tokens or records, up to a moment.  The draws of a source follow
one another in a seeded order; each takes place when the demand reaches the middle of it,
and all draws are put in the order of that moment by a range sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.ranking import cumulated, numbered, salt
from corpusloom.session import cut

#: Ranges in which the records of one source, and the moments of one mix, are numbered.
RANGES = 64
#: Schedule of a weight: its value, relative to the target, at equally spaced moments of the training; linear in between.
STEADY = (1.0, 1.0)


def supply(records: DataFrame, source: Column, targets: DataFrame, named: Column) -> DataFrame:
    """The rows of the targets with key, available, wanted, cap, alone and quota.

    records: all that may be drawn; a record without source (null key) is in no source.
    wanted: weight * total_records; cap: max_repeats times the available records; alone: wanted
    rounded, at most the cap.  quota: what sources at their cap lack is given to the others of
    the mix in proportion to their weights, as far as their caps allow, and the sum is
    rounded by largest remainders; so a mix has its size where its sources can give it.  A null
    weight, total or number of repeats counts as 0.
    """
    have = records.select(source.alias("key")).where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("available"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("weight", "total_records", "max_repeats")}
    want = targets.select("mix", "source", "total_records", "weight", "max_repeats", named.alias("key"), (zero["weight"] * zero["total_records"]).alias("wanted"))
    joined = want.join(have, "key", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    joined = joined.withColumn("cap", (zero["max_repeats"] * F.col("available")).cast("bigint"))
    joined = joined.withColumn("alone", F.least(F.round("wanted"), F.greatest("cap", F.lit(0))).cast("bigint"))
    room, ask = F.greatest("cap", F.lit(0)).cast("double"), F.greatest("wanted", F.lit(0.0))
    # sources by the multiple of their demand that they can give: those that can't give the common multiple are at their cap
    s = joined.withColumn("_cap", room).withColumn("_ask", ask).withColumn("_can", F.when(F.col("_ask") > 0, F.col("_cap") / F.col("_ask")))
    every, order = W.partitionBy("mix"), W.partitionBy("mix").orderBy(F.col("_can").asc_nulls_last(), "key", "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("_ask").over(every) - F.coalesce(F.sum("_ask").over(before), F.lit(0.0))
    s = s.withColumn("_level", F.when(rest > 1e-9, (F.sum("_ask").over(every) - F.coalesce(F.sum(F.when(F.col("_ask") > 0, F.col("_cap"))).over(before), F.lit(0.0))) / rest))
    s = s.withColumn("_place", F.row_number().over(order))
    s = s.withColumn("_common", F.min(F.when(F.col("_can") >= F.col("_level"), F.struct("_place", "_level"))).over(every)["_level"])
    s = s.withColumn("_exact", F.round(F.when(F.col("_ask") > 0, F.least("_cap", F.coalesce(F.col("_common"), F.lit(float(1 << 60))) * F.col("_ask"))).otherwise(0.0), 6))
    s = s.withColumn("_left", F.round(F.sum("_exact").over(every)) - F.sum(F.floor("_exact")).over(every))
    up = F.row_number().over(W.partitionBy("mix").orderBy(F.desc(F.round(F.col("_exact") - F.floor("_exact"), 6)), "key", "source")) <= F.col("_left")
    return s.withColumn("quota", (F.floor("_exact") + (up & (F.floor("_exact") + 1 <= F.col("_cap"))).cast("int")).cast("bigint")).select(*joined.columns, "quota")


def moment(share: Column, schedule: Sequence[float]) -> Column:
    """The moment at which the integral of the schedule reaches ``share`` of its total."""
    n = len(schedule) - 1
    parts = [(a + b) / 2 / n for a, b in zip(schedule, schedule[1:], strict=False)]
    total, done = sum(parts), 0.0
    if min(schedule) < 0 or total <= 0:
        raise ValueError("a schedule has no negative value and a positive integral")
    out = F.lit(1.0)
    steps = []
    for i, part in enumerate(parts):
        if part:
            a, b = schedule[i], schedule[i + 1]
            rest = (share * total - done) * n  # a*x + (b-a)*x^2/2 = rest
            x = rest / a if a == b else (F.sqrt(F.greatest(a * a + 2 * (b - a) * rest, F.lit(0.0))) - a) / (b - a)
            steps.append(((done + part) / total, (i + x) / n))
        done += part
    for upto, at in reversed(steps):
        out = F.when(share <= upto, at).otherwise(out)
    return out


def mix(records: DataFrame, key: str, source: Column, targets: DataFrame, named: Column, schedules: dict[str, Sequence[float]] | None = None, seed: int = 0, size: Column | None = None) -> DataFrame:
    """(mix, position, key, source, epoch): the drawn records of each mix in training order.

    Each source gives its quota: its records in hashed order, again from the start when they
    are used up, so no record comes more than max_repeats times and none twice before all
    came once.  schedules: by source name; others stay steady.  size: the tokens of a record,
    by which demand is measured, else each counts as one; null and negative sizes count as 0.
    Rows of the same mix and source in the targets are drawn for each.
    """
    quotas = supply(records, source, targets, named).where("quota > 0").select("mix", F.col("source").alias("_name"), F.col("key").alias("_key"), "available", "quota")
    own = records.select(F.col(key).alias("_id"), source.alias("_key"), salt(key, RANGES, seed).alias("_salt"), F.xxhash64(key, F.lit(seed + 1)).alias("_h"), F.greatest(F.coalesce(size if size is not None else F.lit(1), F.lit(0)).cast("bigint"), F.lit(0)).alias("_size"))
    own = own.where(F.col("_key").isNotNull())
    if size is not None:
        own = cut(own, "sizes")
    ranked = numbered(own, ["_key"], "_salt", ["_h", "_id"], "_rank")
    if size is None:
        ranked = ranked.withColumn("_before", F.col("_rank"))
        whole = own.groupBy("_key").agg(F.count("*").alias("_whole"))
    else:
        ranked = cumulated(ranked, ["_key"], "_salt", ["_h", "_id"], "_size", "_before")
        whole = own.groupBy("_key").agg(F.sum("_size").alias("_whole"))
    drawn = ranked.select("_id", "_key", "_rank", "_size", "_before").join(quotas, "_key").where("_rank < quota").join(whole, "_key")
    drawn = drawn.withColumn("_times", ((F.col("quota") - 1 - F.col("_rank")) / F.col("available")).cast("int") + 1)
    demand = drawn.groupBy("mix", "_name").agg(F.sum(F.col("_size") * F.col("_times")).alias("_demand")).withColumnsRenamed({"mix": "_mix", "_name": "_of"})
    drawn = drawn.join(demand, F.col("mix").eqNullSafe(F.col("_mix")) & F.col("_name").eqNullSafe(F.col("_of"))) if size is not None else drawn.withColumn("_demand", F.col("quota"))
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    share = F.when(F.col("_demand") > 0, (F.col("epoch") * F.col("_whole") + F.col("_before") + F.col("_size") / 2) / F.col("_demand")).otherwise(0.5)
    at = moment(share, STEADY)
    for name, schedule in (schedules or {}).items():
        at = F.when(F.col("_name") == name, moment(share, schedule)).otherwise(at)
    timed = drawn.select("mix", F.round(at, 12).alias("_t"), F.col("_name").alias("source"), "_id", "epoch").withColumn("_range", F.least(F.floor(F.col("_t") * RANGES), F.lit(RANGES - 1)).cast("int"))
    placed = numbered(timed, ["mix"], "_range", ["_t", "source", "_id", "epoch"], "position")
    return placed.select("mix", "position", F.col("_id").alias(key), "source", "epoch").repartitionByRange("mix", "position").sortWithinPartitions("mix", "position")


def shares(records: DataFrame, source: Column, targets: DataFrame, named: Column, mixed: DataFrame | None = None) -> DataFrame:
    """Per mix and source: wanted, available, cap, what it would give alone, what it gives to make up for others (drawn), both shares, and whether it falls short.

    mixed: a result of ``mix``, whose rows are then counted as drawn; else the planned numbers.
    """
    s = supply(records, source, targets, named)
    if mixed is not None:
        n = mixed.groupBy(F.col("mix").alias("_m"), F.col("source").alias("_s")).agg(F.count("*").alias("_n"))
        rows = s.groupBy(F.col("mix").alias("_m2"), F.col("source").alias("_s2")).agg(F.count("*").alias("_rows"))  # a source on several rows shares its draws
        s = s.join(n, F.col("mix").eqNullSafe(F.col("_m")) & F.col("source").eqNullSafe(F.col("_s")), "left").join(rows, F.col("mix").eqNullSafe(F.col("_m2")) & F.col("source").eqNullSafe(F.col("_s2")))
        s = s.withColumn("quota", F.when(F.col("_rows") > 1, F.col("quota")).otherwise(F.coalesce("_n", F.lit(0))))
    total = s.groupBy(F.col("mix").alias("_mix")).agg(F.sum("quota").alias("_total"), F.sum("alone").alias("_alone"))
    joined = s.join(total, F.col("mix").eqNullSafe(F.col("_mix")))
    part = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    return joined.select("mix", "source", "weight", "wanted", "available", "cap", "alone", part("alone", "_alone").alias("share_alone"), F.col("quota").alias("drawn"), part("quota", "_total").alias("share"), (F.col("wanted") > F.col("cap")).alias("short"))
