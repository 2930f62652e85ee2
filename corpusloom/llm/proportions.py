"""A sample whose categories have given proportions.

Two dual problems are solved by Newton steps.  The first has one multiplier for the total:
among all numbers with the wanted total, between the floors and what there is, those nearest
to the target shares; categories at a bound are fixed and the free ones solved again.  The
second has one multiplier for each category: the inclusion probabilities nearest to an even
draw (exponential tilting) that give these numbers, over the moments of the categories,
which are aggregated from the records.  The records are then drawn with the pivotal
method, block by block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Records of one block of the pivotal method, about.
BLOCK = 50_000
#: Rows of the targets, at most.
MOST_TARGETS = 100_000


def newest(df: DataFrame, keys: list[str], at: str, label: Column) -> DataFrame:
    """(keys, label): each record once, as it was last delivered.

    Among deliveries at the same time the one with a label, then the least label, counts.
    """
    one = df.select(*keys, label.alias("label"), F.col(at).alias("_at"))
    best = F.max_by(F.struct("label"), F.struct(F.coalesce(F.col("_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), F.col("label").isNotNull(), F.col("label")))
    return one.groupBy(*keys).agg(best.alias("_v")).select(*keys, "_v.label")


def tilt(sizes: np.ndarray, wanted: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Inclusion probability of a record of each category.

    Minimises the divergence from an even draw under the totals ``wanted``: p = 1 / (1 + exp(-l))
    with one multiplier l for each category, by Newton steps on the dual; the bounded form
    keeps p below one.  Categories that are wanted whole or not at all have p = 1 or 0.
    """
    p = np.where(wanted <= 0, 0.0, 1.0)
    inner = (wanted > 0) & (wanted < sizes)
    n, t = sizes[inner], wanted[inner]
    dual = np.full(len(n), np.log(max(t.sum(), 1e-9) / max(n.sum() - t.sum(), 1e-9)) if len(n) else 0.0)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-dual))
        gap = t - n * q
        if not len(gap) or np.abs(gap).max() < 1e-9 * max(1.0, t.max()):
            break
        dual += np.clip(gap / np.maximum(n * q * (1 - q), 1e-12), -2, 2)
    p[inner] = 1 / (1 + np.exp(-dual))
    return p


def allocate(target: np.ndarray, floor: np.ndarray, available: np.ndarray, rounds: int = 100) -> np.ndarray:
    """How many records of each category: nearest to the targets with their total, at least the floor and at most what there is.

    Minimises the divergence from the targets; its dual has one multiplier l for the total, and
    a category gets exp(l) times its target, cut to its bounds.  A Newton step solves for
    the categories that are free as it stands; those that it takes over a bound are fixed
    for the next step.  Floors beyond what there is, and a total beyond all there is, are
    cut to it; floors beyond the total stay.
    """
    low, high = np.minimum(floor, available), available
    total = min(max(target.sum(), low.sum()), high.sum())
    small, large = 0.0, 1e12  # the multiplier exp(l) lies between
    scale = 1.0
    got = np.clip(target, low, high)
    for _ in range(rounds):
        got = np.clip(scale * target, low, high)
        gap = total - got.sum()
        if abs(gap) <= 1e-9 * max(1.0, total):
            break
        small, large = (scale, large) if gap > 0 else (small, scale)
        slope = target[(scale * target > low) & (scale * target < high)].sum()  # derivative over the free categories
        scale = scale + gap / slope if slope > 0 else -1.0
        if not small < scale < large:
            scale = (small + large) / 2 if large < 1e12 else max(1.0, 2 * small)
    return got


def pivotal(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Which units are drawn (1), not drawn (0) or left open (-1: one at most), the open one and its probability.

    The pivotal method (Deville and Tille 1998): two units meet until one of them is decided;
    u holds one uniform number for each meeting.
    """
    out = np.zeros(len(p), np.int8)
    held, a = -1, 0.0
    for i, b in enumerate(p.tolist()):
        if b <= 1e-12:
            continue
        if b >= 1 - 1e-12:
            out[i] = 1
            continue
        if held < 0:
            held, a = i, b
            continue
        if a + b < 1 - 1e-12:  # one of the two is not drawn
            if u[i] < a / (a + b):
                out[i], a = 0, a + b
            else:
                out[held], held, a = 0, i, a + b
        else:  # one of the two is drawn
            left = a + b - 1
            if u[i] < (1 - b) / (2 - a - b):
                out[held], held, a = 1, i, left
            else:
                out[i], a = 1, left
            if a <= 1e-9:
                out[held], held = 0, -1
    if held >= 0:
        out[held] = -1
    return out, held, a


def quotas(records: DataFrame, targets: DataFrame, named: Column) -> DataFrame:
    """The rows of the targets with available, wanted and short.

    wanted: the larger of target_share * sample_size and min_rows.  Null shares, sizes and
    floors count as 0.
    """
    have = records.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("available")).withColumnRenamed("label", "_label")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    want = targets.select("plan", "label", "sample_size", "target_share", "min_rows", named.alias("_label"), F.greatest(zero("target_share") * zero("sample_size"), zero("min_rows").cast("double")).alias("wanted"))
    joined = want.join(have, "_label", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return joined.select("plan", "label", "_label", "sample_size", "target_share", "min_rows", "available", "wanted", (F.col("available") < F.col("wanted")).alias("short"))


def plans(quota: DataFrame) -> pd.DataFrame:
    """The rows of ``quotas`` with planned, the number calibrated within each plan, and p, the inclusion probability.

    More than MOST_TARGETS rows are an error.  A label on several rows of a plan is drawn for each.
    """
    rows = quota.limit(MOST_TARGETS + 1).toPandas()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    rows["planned"], rows["p"] = 0.0, 0.0
    size, share, floor = (rows[c].fillna(0).to_numpy(float) for c in ("sample_size", "target_share", "min_rows"))
    have, target = rows["available"].to_numpy(float), np.maximum(0, size * share)
    for _, at in rows.groupby("plan", dropna=False).indices.items():
        planned = allocate(target[at], np.maximum(0, floor[at]), have[at])
        rows.loc[rows.index[at], "planned"] = planned
        rows.loc[rows.index[at], "p"] = tilt(have[at], planned)
    return rows


def draw(records: DataFrame, keys: list[str], targets: DataFrame, named: Column, seed: int = 0) -> DataFrame:
    """(plan, keys, label): the sample of each plan.

    A label gets its planned number, rounded up or down at random so that the total keeps
    its size to one record; labels with a floor get at least that many where they have them,
    and what a label hasn't the others of the plan make up for, in proportion.
    Records without label, or with one that no plan names, are never drawn.
    """
    spark = records.sparkSession
    q = quotas(records, targets, named)
    rows = plans(q)
    rows = rows[rows["available"] > 0].copy()
    rows["blocks"] = np.maximum(1, -(-rows["available"] // BLOCK)).astype(int)
    rates = spark.createDataFrame(rows[["plan", "label", "_label", "p", "blocks"]], "plan string, label string, _label string, p double, blocks int")
    units = records.withColumnRenamed("label", "_label").join(F.broadcast(rates), "_label").where("p > 0")
    uniform = F.pmod(F.xxhash64("plan", *keys, F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    units = units.select("plan", "label", *keys, "p", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.col("blocks")).cast("int").alias("block"), uniform.alias("u"))
    kinds = dict(units.dtypes)
    schema = ", ".join([f"plan string, label string, {', '.join(f'{k} {kinds[k]}' for k in keys)}, p double, block int, u double, state tinyint"])

    def duel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["u", *keys], kind="stable")
        # the meeting numbers must not follow the order of the meetings
        state, held, left = pivotal(rows["p"].to_numpy(), (rows["u"].to_numpy() * 8191.0 + 0.37) % 1.0)
        rows = rows.assign(state=state)
        if held >= 0:
            rows.iloc[held, rows.columns.get_loc("p")] = left
        return rows[(rows["state"] != 0)]

    won, open_ = [], units
    for by in (("label", "block"), ("label",), ()):
        both = cut(open_.drop("state").groupBy("plan", *by).applyInPandas(duel, schema), "duels")
        won.append(both.where("state = 1"))
        open_ = both.where("state = -1")
    # the order of the meetings follows u, so the last open unit is decided by another number
    last = open_.where(F.pmod(F.xxhash64(F.lit(seed + 2), "plan", *keys), F.lit(1 << 30)) / float(1 << 30) < F.col("p"))
    every = won[0].unionByName(won[1]).unionByName(won[2]).unionByName(last)
    return every.select("plan", *keys, "label")


def report(records: DataFrame, sample: DataFrame, targets: DataFrame, named: Column) -> DataFrame:
    """Per plan and label what came of its target.

    available, wanted (target or floor), planned (after floors and shortages of all labels),
    drawn, the share of the sample, the target share, missing and short (fewer than wanted
    available), and held: why the label is off its target ('short', 'floor', or 'others'
    where it makes room for the floors of others or makes up for what they lack).
    """
    spark = records.sparkSession
    drawn = sample.groupBy(F.col("plan").alias("_p"), F.col("label").alias("_l")).agg(F.count("*").alias("drawn"))
    rows = plans(quotas(records, targets, named))
    kinds = dict(targets.dtypes)
    names = ("plan", "label", "sample_size", "target_share", "min_rows", "available", "wanted", "planned", "short")
    types = [kinds[n] if n in kinds else {"available": "bigint", "short": "boolean"}.get(n, "double") for n in names]
    clean = [tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r) for r in rows[list(names)].itertuples(index=False)]
    whole = {i for i, t in enumerate(types) if t in ("bigint", "int")}
    q = spark.createDataFrame([tuple(int(v) if i in whole and v is not None else v for i, v in enumerate(r)) for r in clean], ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))
    joined = q.join(drawn, F.col("plan").eqNullSafe(F.col("_p")) & F.col("label").eqNullSafe(F.col("_l")), "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    total, target = F.sum("drawn").over(W.partitionBy("plan")), F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0.0))
    held = F.when(F.col("short"), "short").when(F.col("planned") <= F.col("min_rows"), "floor").when(F.abs(F.col("planned") - target) > 1e-6 * (1 + target), "others")
    return joined.select("plan", "label", "available", "wanted", F.round("planned", 6).alias("planned"), "drawn", F.when(total > 0, F.col("drawn") / total).otherwise(0.0).alias("share"), "target_share", F.greatest(F.col("wanted") - F.col("available"), F.lit(0.0)).alias("missing"), "short", held.alias("held"))
