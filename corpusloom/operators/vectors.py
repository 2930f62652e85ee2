"""Vectors, similarities, classifiers and the losses as evaluation aggregates.

Vectors are arrays of floats.  Pairs that are already joined are computed inside the JVM;
searches of a stated query set against all rows go in blocks: a block of queries is a matrix
that is sent once, each task multiplies its rows with it and keeps its own top k, and only
those are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.matching import hashed, one_by_one
from corpusloom.session import cut

#: Numbers in the matrix of one block of queries, at most: 32 MB as 4-byte numbers.
BLOCK_NUMBERS = 8_000_000
#: Classes whose prototypes are sent to the executors at once.
MOST_CLASSES = 10_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products; null if a vector is, or if the lengths differ (V2, V5)."""
    x, y = _c(a), _c(b)
    products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
    return F.when(F.size(x) == F.size(y), F.aggregate(products, F.lit(0.0), lambda s, p: s + p))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column | str, least: float = 1e-12) -> Column:
    """The vector with length one; a zero vector stays (V1)."""
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(_c(a), lambda x: x.cast("double") / n)


def cosine(a: Column | str, b: Column | str, least: float = 1e-12) -> Column:
    """Cosine of two vectors, 0 with a zero vector (V2)."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(least))


def pair_scores(a: Column | str, b: Column | str) -> dict[str, Column]:
    """Cosine, dot product, and the negated Manhattan and Euclidean distances (V3)."""
    gaps = F.zip_with(_c(a), _c(b), lambda p, q: p.cast("double") - q.cast("double"))
    total = lambda f: F.aggregate(gaps, F.lit(0.0), lambda s, g: s + f(g))
    return {"cosine": cosine(a, b), "dot": dot(a, b), "manhattan": -total(F.abs), "euclidean": -F.sqrt(total(lambda g: g * g))}


def average_precision(df: DataFrame, score: str, relevant: Column, *groups: str) -> DataFrame:
    """(groups, ap): precision at each different score, weighted by the recall it adds; equal scores are one step (V4).

    The scores are aggregated to their different values and sorted into ranges, which are
    summed one by one; what lies before a range is added.  So a group of very many different
    scores is spread over as many tasks as it has ranges.
    """
    steps = df.where(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.count("*").alias("_n"), F.count_if(relevant).alias("_p"))
    steps = cut(steps.repartitionByRange(*[F.col(g) for g in groups], F.desc(score)).withColumn("_range", F.spark_partition_id()), "steps")
    sums = steps.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_r")).agg(F.sum("_n").alias("_rn"), F.sum("_p").alias("_rp"))
    own = [f"_g{i}" for i in range(len(groups))]
    before = W.partitionBy(*own).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*own, "_r", *[F.coalesce(F.sum(f"_r{c}").over(before), F.lit(0)).alias(f"_b{c}") for c in "np"], F.sum("_rp").over(W.partitionBy(*own)).alias("_total"))
    match = F.col("_range") == F.col("_r")
    for g, o in zip(groups, own, strict=True):
        match = match & F.col(g).eqNullSafe(F.col(o))
    w = W.partitionBy(*groups, "_range").orderBy(F.desc(score))
    run = steps.join(sums, match).withColumn("_cn", F.sum("_n").over(w) + F.col("_bn")).withColumn("_cp", F.sum("_p").over(w) + F.col("_bp"))
    return run.groupBy(*groups).agg(F.sum(F.when(F.col("_total") > 0, F.col("_p") / F.col("_total") * F.col("_cp") / F.col("_cn")).otherwise(0.0)).alias("ap"))


def nearest(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, label: str | None = None, same: bool | None = None, window: tuple[float, float] | None = None) -> DataFrame:
    """(query, neighbour, sim, place[, query_label, label]): the k rows with the largest cosine to each query.

    ``same`` keeps neighbours of the query's own label or of others; ``window`` bounds the
    similarity.  A row is never its own neighbour; ties go to the smaller key.  Rows and
    queries with null, empty or zero vectors, or of another length, have no neighbours.
    """
    spark = base.sparkSession
    cols = [F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<float>").alias("v"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("l")]
    rows = base.select(*cols).where("v IS NOT NULL AND size(v) > 0")
    schema = "query bigint, query_label string, neighbour bigint, label string, sim double"
    low, high = window or (-2.0, 2.0)

    def search(ids: np.ndarray, m: np.ndarray, labels: np.ndarray) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast((ids, m, labels))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m, labels = sent.value
            held: tuple[np.ndarray, ...] | None = None
            for b in batches:
                sizes = pd.Series(np.diff(b.column("v").offsets)).to_numpy()
                ok = np.flatnonzero(sizes == m.shape[1])
                if not len(ok):
                    continue
                part = b.take(pa.array(ok))
                x = np.asarray(part.column("v").flatten(), np.float64).reshape(len(ok), -1)
                n = np.sqrt((x * x).sum(1))
                sim = m @ (x / np.maximum(n, 1e-12)[:, None]).T
                near, name = part.column("k").to_numpy(zero_copy_only=False), np.array(part.column("l").to_pylist(), object)
                bad = (near[None, :] == ids[:, None]) | (n == 0)[None, :] | ~((sim >= low) & (sim < high))
                if same is not None:
                    equal = labels[:, None] == name[None, :]
                    bad |= ~equal if same else equal
                sim[bad] = -np.inf
                new = (sim, np.broadcast_to(near, sim.shape), np.broadcast_to(name, sim.shape))
                held = new if held is None else tuple(np.concatenate((h, a), 1) for h, a in zip(held, new, strict=True))
                by = np.lexsort((held[1], -held[0]), axis=1)[:, :k]
                held = tuple(np.take_along_axis(h, by, 1) for h in held)
            if held is not None:
                q, at = np.nonzero(np.isfinite(held[0]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(labels[q].tolist(), pa.string()), pa.array(held[1][q, at].astype(np.int64)), pa.array(held[2][q, at].tolist(), pa.string()), pa.array(held[0][q, at])], ["query", "query_label", "neighbour", "label", "sim"])

        return rows.mapInArrow(scan, schema), sent

    out, ids, vs, ls = None, [], [], []

    def flush() -> tuple[DataFrame, Broadcast]:
        m = np.array(vs, np.float64)
        n = np.sqrt((m * m).sum(1))
        return search(np.array(ids, np.int64)[n > 0], m[n > 0] / n[n > 0][:, None], np.array(ls, object)[n > 0])

    for r in queries.select(*cols).where("v IS NOT NULL AND size(v) > 0").orderBy("k").toLocalIterator():
        if vs and (len(r["v"]) != len(vs[0]) or (len(vs) + 1) * len(vs[0]) > BLOCK_NUMBERS):
            out, ids, vs, ls = one_by_one(out, *flush()), [], [], []
        ids.append(r["k"])
        vs.append(r["v"])
        ls.append(r["l"])
    if vs:
        out = one_by_one(out, *flush()) if out is not None else flush()[0]
    if out is None:
        out = spark.createDataFrame([], schema)
    ranked = out.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "neighbour"))).where(F.col("place") <= k)
    return ranked.select("query", *(["query_label", "label"] if label else []), "neighbour", "sim", F.col("place").cast("bigint").alias("place"))


def diverse(neighbours: DataFrame, k: int) -> DataFrame:
    """Of neighbours of other labels the best of each label first, then by similarity, k in all."""
    first = F.row_number().over(W.partitionBy("query", "label").orderBy(F.desc("sim"), "neighbour"))
    tier = neighbours.withColumn("_t", F.when(first == 1, 0).otherwise(1))
    return tier.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("_t", F.desc("sim"), "neighbour"))).where(F.col("place") <= k).drop("_t").withColumn("place", F.col("place").cast("bigint"))


def tiered(neighbours: DataFrame, preferred: Column, k: int) -> DataFrame:
    """Neighbours that fulfil a preference first, others after them, k in all."""
    return neighbours.withColumn("_t", F.when(preferred, 0).otherwise(1)).withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("_t", F.desc("sim"), "neighbour"))).where(F.col("place") <= k).drop("_t").withColumn("place", F.col("place").cast("bigint"))


def nearest_labels(neighbours: DataFrame, k: int) -> DataFrame:
    """(query, label, sim): the k labels whose best row is most similar."""
    best = neighbours.groupBy("query", "label").agg(F.max("sim").alias("sim"))
    return best.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "label"))).where(F.col("_r") <= k).drop("_r")


def knn_vote(neighbours: DataFrame, temperature: float) -> DataFrame:
    """(query, label, weight): softmax of the similarities over a query's neighbours, summed by label."""
    w = W.partitionBy("query")
    e = neighbours.withColumn("_e", F.exp((F.col("sim") - F.max("sim").over(w)) / temperature))
    return e.groupBy("query", "label").agg(F.sum("_e").alias("_s")).withColumn("weight", F.col("_s") / F.sum("_s").over(w)).drop("_s")


def mean_vectors(df: DataFrame, group: str, vector: str, unit: bool = False) -> DataFrame:
    """(group, vector): the mean of each dimension, brought to length one if asked."""
    each = df.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_l"))
    out = means.select(group, F.col("_l.x").alias("vector"))
    return out.withColumn("vector", normalized("vector")) if unit else out


def prototype_scores(queries: DataFrame, key: str, vector: str, prototypes: DataFrame, group: str) -> DataFrame:
    """(key, group, score): each query against each prototype; the prototypes are one row a class.

    The result has a row for every class, so more than MOST_CLASSES of them are an error.
    """
    if prototypes.count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    return queries.crossJoin(F.broadcast(prototypes.select(F.col(group).alias("_g"), F.col("vector").alias("_p")))).select(key, F.col("_g").alias(group), dot(vector, "_p").alias("score"))


def label_scores(base: DataFrame, queries: DataFrame, key: str, vector: str, label: str, temperature: float = 0.05) -> DataFrame:
    """(query, query_label, label, n, top, second, lse) of each query against the rows of each label.

    top and second: the two largest cosines, second null if there is one row only; lse:
    temperature times log-sum-exp of cosine / temperature.  As in ``nearest`` a row is not
    held against itself.  Each task reduces its rows to one row a query and label, so the
    shuffle doesn't grow with the rows.
    """
    spark = base.sparkSession
    cols = [F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<float>").alias("v"), F.col(label).cast("string").alias("l")]
    schema = "query bigint, query_label string, label string, n bigint, top double, second double, s double"
    rows = base.select(*cols).where("v IS NOT NULL AND size(v) > 0 AND l IS NOT NULL")

    def search(ids: np.ndarray, m: np.ndarray, labels: list) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast((ids, m, labels))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m, labels = sent.value
            held: dict[str, list[np.ndarray]] = {}
            for b in batches:
                sizes = np.diff(np.asarray(b.column("v").offsets))
                part = b.take(pa.array(np.flatnonzero(sizes == m.shape[1])))
                if not part.num_rows:
                    continue
                x = np.asarray(part.column("v").flatten(), np.float64).reshape(part.num_rows, -1)
                n = np.sqrt((x * x).sum(1))
                sim = m @ (x / np.maximum(n, 1e-12)[:, None]).T
                out = (part.column("k").to_numpy(zero_copy_only=False)[None, :] == ids[:, None]) | (n == 0)[None, :]
                sim[out] = -np.inf
                names = np.array(part.column("l").to_pylist(), object)
                for name in sorted(set(names)):
                    mine = sim[:, names == name]
                    best = -np.sort(-np.concatenate((mine, np.full((len(ids), 2), -np.inf)), 1), 1)[:, :2]
                    top = np.where(np.isfinite(best[:, 0]), best[:, 0], 0.0)
                    new = [np.isfinite(mine).sum(1), best[:, 0], best[:, 1], np.exp((mine - top[:, None]) / temperature).sum(1)]
                    if name in held:
                        old = held[name]
                        pair = -np.sort(-np.stack((old[1], old[2], new[1], new[2]), 1), 1)[:, :2]
                        high = np.where(np.isfinite(pair[:, 0]), pair[:, 0], 0.0)
                        part_of = lambda h, high=high: np.where(np.isfinite(h[1]), h[3] * np.exp((np.where(np.isfinite(h[1]), h[1], 0.0) - high) / temperature), 0.0)
                        new = [old[0] + new[0], pair[:, 0], pair[:, 1], part_of(old) + part_of(new)]
                    held[name] = new
            for name, (count, top, second, total) in held.items():
                ok = np.flatnonzero(count)
                cols = [ids[ok], [labels[i] for i in ok], [name] * len(ok), count[ok], top[ok], np.where(np.isfinite(second[ok]), second[ok], np.nan), total[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), *[pa.array(c, from_pandas=True) for c in cols[3:]]], ["query", "query_label", "label", "n", "top", "second", "s"])

        return rows.mapInArrow(scan, schema), sent

    out, block = None, []
    for r in queries.select(*cols).where("v IS NOT NULL AND size(v) > 0").orderBy("k").toLocalIterator():
        if block and (len(r["v"]) != len(block[0]["v"]) or (len(block) + 1) * len(r["v"]) > BLOCK_NUMBERS):
            out, block = one_by_one(out, *_search_block(search, block)), []
        block.append(r)
    if block:
        out = one_by_one(out, *_search_block(search, block)) if out is not None else _search_block(search, block)[0]
    if out is None:
        out = spark.createDataFrame([], schema)
    first = out.groupBy("query", "query_label", "label").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list(F.array_compact(F.array("top", "second")))), asc=False), 1, 2).alias("_b"), F.collect_list(F.struct("top", "s")).alias("_l"))
    high = F.get("_b", F.lit(0))
    total = F.aggregate("_l", F.lit(0.0), lambda acc, x: acc + x["s"] * F.exp((x["top"] - high) / temperature))
    return first.select("query", "query_label", "label", "n", high.alias("top"), F.get("_b", F.lit(1)).alias("second"), (high + temperature * F.ln(total)).alias("lse"))


def _search_block(search, block: list) -> DataFrame:
    m = np.array([r["v"] for r in block], np.float64)
    n = np.sqrt((m * m).sum(1))
    ok = np.flatnonzero(n > 0)
    return search(np.array([block[i]["k"] for i in ok], np.int64), m[ok] / n[ok][:, None], [block[i]["l"] for i in ok])


def mean_top2() -> Column:
    """Over label_scores: the mean of the two best supports, or the one."""
    return F.when(F.col("second").isNull(), F.col("top")).otherwise((F.col("top") + F.col("second")) / 2)


def ridge(df: DataFrame, episode: str, key: str, vector: str, label: str, role: str, strength: float = 1.0, bias: bool = False, temperature: float = 1.0, most: int = 5_000) -> DataFrame:
    """(episode, key, label, score) of the queries of each episode under a ridge classifier of its supports.

    Without bias in the dual form (K + strength I)^-1 Y with one-hot labels, for few supports
    of many dimensions; with bias in the primal form (X'X + strength I)^-1 X'Y, in which the
    bias isn't penalised.  Scores are divided by the temperature.  An episode of more than
    ``most`` supports, or vectors as long, is an error, since it is solved in one task.
    """

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        s, q = p[p[role] == "support"], p[p[role] == "query"]
        if len(s) > most or len(p) and len(p[vector].iloc[0]) > most:
            raise ValueError(f"an episode has more than {most} supports or dimensions")
        empty = pd.DataFrame({episode: [], key: [], "label": [], "score": []})
        if s.empty or q.empty:
            return empty
        names = sorted(s[label].astype(str).unique())
        x, z = np.stack(s[vector].to_numpy()).astype(float), np.stack(q[vector].to_numpy()).astype(float)
        y = (s[label].astype(str).to_numpy()[:, None] == np.array(names)[None, :]).astype(float)
        if bias:
            x, z = (np.hstack((m, np.ones((len(m), 1)))) for m in (x, z))
            penalty = strength * np.eye(x.shape[1])
            penalty[-1, -1] = 0
            scores = z @ np.linalg.lstsq(x.T @ x + penalty, x.T @ y, rcond=None)[0] / temperature
        else:
            scores = z @ x.T @ np.linalg.solve(x @ x.T + strength * np.eye(len(x)), y) / temperature
        return pd.DataFrame({episode: np.repeat(q[episode].to_numpy(), len(names)), key: np.repeat(q[key].to_numpy(), len(names)), "label": names * len(q), "score": scores.ravel()})

    kinds = dict(df.dtypes)
    return df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(episode, key, vector, label, role).groupBy(episode).applyInPandas(solve, f"{episode} {kinds[episode]}, {key} {kinds[key]}, label string, score double")


def knn_supports(df: DataFrame, key: str, label: str, per: int, experiments: int, seed: int) -> DataFrame:
    """(rows, experiment): for each experiment, from 1 on, ``per`` rows of each label by a seeded order of its own."""
    each = df.where(F.col(label).isNotNull()).withColumn("experiment", F.explode(F.sequence(F.lit(1), F.lit(experiments))))
    w = W.partitionBy("experiment", label).orderBy(hashed(seed, "experiment", key), key)
    return each.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per).drop("_r")


def knn_experiments(tests: DataFrame, supports: DataFrame, key: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """(experiment, key, label, prediction, correct, neighbours): each test row against the supports of each experiment.

    The nearest k by cosine, ties to the smaller key; a label that more than half of them have
    is predicted, else 'none', so a row is correct if its set of labels is met exactly.
    neighbours: their keys, nearest first.  The supports are a sample of stated size: above
    BLOCK_NUMBERS numbers they are an error.  They are sent once, and each test row is
    handled where it lies, in one pass for all experiments.
    """
    spark = tests.sparkSession
    sent = supports.select("experiment", F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<float>").alias("v"), F.col(label).cast("string").alias("l")).where("v IS NOT NULL AND size(v) > 0").orderBy("experiment", "k")
    rows = sent.limit(BLOCK_NUMBERS // 2 + 1).collect()
    if sum(len(r["v"]) for r in rows) > BLOCK_NUMBERS:
        raise ValueError(f"the supports have more than {BLOCK_NUMBERS} numbers")
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["experiment"], []).append(r)
    ready = spark.sparkContext.broadcast({e: (np.array([r["k"] for r in rs], np.int64), _unit(np.array([r["v"] for r in rs], np.float64)), np.array([r["l"] for r in rs], object)) for e, rs in by.items()})
    cols = [F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<float>").alias("v"), F.col(label).cast("string").alias("l")]
    schema = "experiment int, k bigint, label string, prediction string, neighbours array<bigint>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for e, (ids, m, names) in ready.value.items():
                part = b.take(pa.array(np.flatnonzero(np.diff(np.asarray(b.column("v").offsets)) == m.shape[1])))
                if not part.num_rows:
                    continue
                sim = np.round(_unit(np.asarray(part.column("v").flatten(), np.float64).reshape(part.num_rows, -1)) @ m.T, 9)
                near = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
                said = []
                for votes in names[near]:
                    kinds, n = np.unique(votes.astype(str), return_counts=True)
                    said.append(str(kinds[n.argmax()]) if 2 * n.max() > near.shape[1] else "none")
                yield pa.RecordBatch.from_arrays([pa.array([e] * part.num_rows, pa.int32()), part.column("k"), part.column("l"), pa.array(said, pa.string()), pa.array(ids[near].tolist(), pa.list_(pa.int64()))], ["experiment", "k", "label", "prediction", "neighbours"])

    out = tests.select(*cols).where("v IS NOT NULL AND size(v) > 0 AND l IS NOT NULL").mapInArrow(scan, schema)
    return out.select("experiment", F.col("k").alias(key), "label", "prediction", (F.col("label") == F.col("prediction")).alias("correct"), "neighbours")


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1)), 1e-12)[:, None]


def knn_report(predicted: DataFrame) -> DataFrame:
    """(experiment, n, accuracy, macro_f1) of ``knn_experiments``; macro_f1 is the mean over the labels of the test rows."""
    true = predicted.groupBy("experiment", "label").agg(F.count("*").alias("n"), F.count_if("correct").alias("hit"))
    said = predicted.groupBy("experiment", F.col("prediction").alias("label")).agg(F.count("*").alias("said"))
    f1 = true.join(said, ["experiment", "label"], "left").withColumn("f1", 2 * F.col("hit") / (F.col("n") + F.coalesce("said", F.lit(0))))
    return f1.groupBy("experiment").agg(F.sum("n").alias("n"), (F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def tfidf(docs: DataFrame, key: str, terms: str, max_share: float = 1.0, least: int = 1) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document brought to length one (V7).

    docs: (key, array of terms).  Terms in more than ``max_share`` of the documents or in
    fewer than ``least`` are left out.  Documents without terms have no rows but count in n.
    """
    n = docs.select(F.count("*").alias("_docs"))
    tf = docs.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") >= least) & (F.col("df") <= F.col("_docs") * max_share))
    w = tf.join(df.select("term", (F.ln((1 + F.col("_docs")) / (1 + F.col("df"))) + 1).alias("idf")), "term").withColumn("_w", (1 + F.ln("tf")) * F.col("idf"))
    return w.withColumn("_s", F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(key)))).select(key, "term", (F.col("_w") / F.col("_s")).alias("weight"))


def sparse_nearest(weights: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """(query, neighbour, sim, place) over long-form vectors, through the terms they share (V8).

    queries: the keys that search.  Rare terms first would prune; here the products of shared terms are summed exactly.
    """
    q = weights.join(queries.select(key), key, "left_semi").select(F.col(key).alias("query"), "term", F.col("weight").alias("_q"))
    sims = q.join(weights.select(F.col(key).alias("neighbour"), "term", "weight"), "term").where("query != neighbour").groupBy("query", "neighbour").agg(F.sum(F.col("_q") * F.col("weight")).alias("sim"))
    return sims.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("sim", 9)), "neighbour"))).where(F.col("place") <= k).withColumn("place", F.col("place").cast("bigint"))


def kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 0, rounds: int = 20) -> DataFrame:
    """(key, cluster) by Spark's distributed k-means (V9)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=rounds, initSteps=2).fit(x).transform(x).select(key, F.col("prediction").alias("cluster"))


# ---- losses as aggregates over scored pairs


def infonce(scores: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(query, loss): log-sum-exp over all candidates less that over those of the query's label.

    scores: label_scores with the same temperature; queries without a positive have no loss.
    """
    x = F.col("lse") / temperature
    top = scores.withColumn("_x", x).withColumn("_m", F.max("_x").over(W.partitionBy("query")))
    own = F.max(F.when(F.col("label") == F.col("query_label"), F.col("_x")))
    out = top.groupBy("query").agg((F.first("_m") + F.ln(F.sum(F.exp(F.col("_x") - F.col("_m"))))).alias("_all"), own.alias("_pos"))
    return out.where("_pos IS NOT NULL").select("query", (F.col("_all") - F.col("_pos")).alias("loss"))


def pair_losses(df: DataFrame, cos: str, score: str, *groups: str, scale: float = 20.0, gap: float = 0.05, least: int = 2) -> DataFrame:
    """(groups, mse, pearson, rank): squared error of (cos+1)/2, 1 - correlation, and the rank loss, within groups.

    rank: ln(1 + sum of exp(scale (cos_j - cos_i))) over pairs of a group whose scores differ
    by more than ``gap``, i the higher.  Groups are batches: pairs are formed inside them only.
    """
    rows = df.where(F.col(cos).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).select(*groups, F.col(cos).alias("_c"), F.col(score).alias("_s"))
    plain = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(F.pow((F.col("_c") + 1) / 2 - F.col("_s"), 2)).alias("mse"), (1 - F.corr("_c", "_s")).alias("pearson")).where(F.col("n") >= least)
    pairs = rows.join(rows.select(*groups, F.col("_c").alias("_c2"), F.col("_s").alias("_s2")), list(groups)).where(F.col("_s") - F.col("_s2") > gap)
    rank = pairs.groupBy(*groups).agg(F.ln(1 + F.sum(F.exp(scale * (F.col("_c2") - F.col("_c"))))).alias("rank"))
    return plain.join(rank, list(groups), "left")


def metric_losses(df: DataFrame, batch: str, key: str, label: str, vector: str, temperature: float = 0.1, alpha: float = 2.0, beta: float = 50.0, base: float = 0.5, margin: float = 0.25, gamma: float = 64.0) -> DataFrame:
    """(batch, supcon, multi_similarity, circle): means over the anchors of a batch that have a positive and a negative.

    Pairs are formed inside a batch only; its size is the bound.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(batch, F.col(key).alias("_a"), F.col(label).alias("_la"), normalized(vector).alias("_va"))
    other = rows.select(F.col(batch).alias("_b"), F.col("_a").alias("_k"), F.col("_la").alias("_lb"), F.col("_va").alias("_vb"))
    s = rows.join(other, (F.col(batch) == F.col("_b")) & (F.col("_a") != F.col("_k"))).select(batch, "_a", (F.col("_la") == F.col("_lb")).alias("_p"), dot("_va", "_vb").alias("_s"))
    pos, neg = F.col("_p"), ~F.col("_p")
    x = F.col("_s")
    anchor = s.groupBy(batch, "_a").agg(
        F.count_if(pos).alias("_np"), F.count_if(neg).alias("_nn"), F.sum(F.when(pos, x / temperature)).alias("_sp"), F.ln(F.sum(F.exp((x - 1) / temperature))).alias("_all"),
        F.coalesce(F.sum(F.when(pos, F.exp(-alpha * (x - base)))), F.lit(0.0)).alias("_mp"), F.coalesce(F.sum(F.when(neg, F.exp(beta * (x - base)))), F.lit(0.0)).alias("_mn"),
        F.ln(F.sum(F.when(pos, F.exp(-gamma * F.greatest(F.lit(0.0), 1 + margin - x) * (x - (1 - margin)) - 3 * gamma)))).alias("_cp"),
        F.ln(F.sum(F.when(neg, F.exp(gamma * F.greatest(F.lit(0.0), x + margin) * (x - margin) - 3 * gamma)))).alias("_cn"),
    ).where("_np > 0 AND _nn > 0")
    both = F.col("_cp") + F.col("_cn") + 6 * gamma
    softplus = F.greatest(both, F.lit(0.0)) + F.log1p(F.exp(-F.abs(both)))
    return anchor.groupBy(batch).agg(
        F.avg(F.col("_all") + 1 / temperature - F.col("_sp") / F.col("_np")).alias("supcon"), F.avg(F.log1p("_mp") / alpha + F.log1p("_mn") / beta).alias("multi_similarity"), F.avg(softplus).alias("circle"),
    )


def hierarchical_losses(df: DataFrame, batch: str, key: str, labels: str, vector: str, weights: dict[str, float], least: int = 3, **kw: float) -> DataFrame:
    """(batch, loss): the weighted mean over the levels of a label map of their contrastive loss; levels with too few rows are left out."""
    out = None
    for level, w in sorted(weights.items()):
        rows = df.withColumn("_l", F.try_element_at(labels, F.lit(level))).where("_l IS NOT NULL").withColumn("_n", F.count("*").over(W.partitionBy(batch))).where(F.col("_n") >= least)
        one = metric_losses(rows, batch, key, "_l", vector, **kw).select(batch, F.col("supcon").alias("x"), F.lit(float(w)).alias("w"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(batch).agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("loss"))


def none_losses(scores: DataFrame, query: str, score: str, neutral: Column, margin: float = 0.35) -> DataFrame:
    """(query, none_loss, uniform_loss): softplus of the best score over the margin, and the divergence from an even choice, for neutral queries."""
    n = scores.where(neutral).withColumn("_m", F.max(score).over(W.partitionBy(query)))
    e = n.groupBy(query).agg(F.first("_m").alias("_m"), F.avg(score).alias("_a"), F.count("*").alias("_n"), F.ln(F.sum(F.exp(F.col(score) - F.col("_m")))).alias("_l"))
    top = F.col("_m") - margin
    return e.select(query, (F.greatest(top, F.lit(0.0)) + F.log1p(F.exp(-F.abs(top)))).alias("none_loss"), (F.col("_l") + F.col("_m") - F.col("_a") - F.ln("_n")).alias("uniform_loss"))


def distillation(student: DataFrame, teacher: DataFrame, key: str, vector: str) -> DataFrame:
    """(n, loss): mean of 1 - cosine between the vectors of the same key in two tables."""
    j = student.select(key, F.col(vector).alias("_s")).join(teacher.select(key, F.col(vector).alias("_t")), key)
    return j.agg(F.count("*").alias("n"), F.avg(1 - cosine("_s", "_t")).alias("loss"))


def pairwise_distillation(student: DataFrame, teacher: DataFrame, batch: str, key: str, vector: str) -> DataFrame:
    """(batch, loss): mean squared difference of the similarities within a batch, off the diagonal."""
    j = student.select(batch, key, normalized(vector).alias("_s")).join(teacher.select(key, normalized(vector).alias("_t")), key)
    o = j.select(F.col(batch).alias("_b"), F.col(key).alias("_k"), F.col("_s").alias("_s2"), F.col("_t").alias("_t2"))
    return j.join(o, (F.col(batch) == F.col("_b")) & (F.col(key) != F.col("_k"))).groupBy(batch).agg(F.avg(F.pow(dot("_s", "_s2") - dot("_t", "_t2"), 2)).alias("loss"))


def geometry(base: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row on two parameter states against a base, each (name, idx, value): anchor error, cosine of the deltas, projection, orthogonal rest."""
    j = base.select("name", "idx", F.col("value").alias("o")).join(a.select("name", "idx", F.col("value").alias("x")), ["name", "idx"]).join(b.select("name", "idx", F.col("value").alias("y")), ["name", "idx"])
    dx, dy = F.col("x") - F.col("o"), F.col("y") - F.col("o")
    s = j.agg(F.avg(dx * dx).alias("anchor_mse"), F.sum(dx * dy).alias("_xy"), F.sum(dx * dx).alias("_xx"), F.sum(dy * dy).alias("_yy"))
    p = F.col("_xy") / F.nullif("_yy", F.lit(0.0))
    return s.select("anchor_mse", (F.col("_xy") / F.nullif(F.sqrt(F.col("_xx") * F.col("_yy")), F.lit(0.0))).alias("delta_cosine"), p.alias("projection"), F.sqrt(F.greatest(F.lit(0.0), F.col("_xx") - p * F.col("_xy"))).alias("orthogonal_norm"))


def averaged_state(states: list[tuple[DataFrame, float]]) -> DataFrame:
    """(name, idx, value): the weighted mean of states with the same keys; keys that one lacks are left out."""
    total = sum(w for _, w in states)
    rows = None
    for df, w in states:
        one = df.select("name", "idx", (F.col("value") * (w / total)).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("name", "idx").agg(F.sum("value").alias("value"), F.count("*").alias("_n")).where(F.col("_n") == len(states)).drop("_n")


def extrapolated(base: DataFrame, target: DataFrame, alpha: float) -> DataFrame:
    """(name, idx, value): base + alpha (target - base)."""
    j = base.join(target.select("name", "idx", F.col("value").alias("_t")), ["name", "idx"])
    return j.select("name", "idx", (F.col("value") + alpha * (F.col("_t") - F.col("value"))).alias("value"))


def ensembles(scores: DataFrame, item: str, stream: str, score: str, most: int = 4) -> DataFrame:
    """(streams, item, score): the mean score of every combination of 2 to ``most`` streams (V6).

    The streams are a handful of columns' worth; the combinations are formed over their names.
    """
    from itertools import combinations

    names = [r[0] for r in scores.select(stream).distinct().orderBy(stream).limit(13).collect()]
    if len(names) > 12:
        raise ValueError("more than 12 streams")
    combos = [("+".join(c), list(c)) for k in range(2, most + 1) for c in combinations(names, k)]
    table = scores.sparkSession.createDataFrame([(c, s) for c, ss in combos for s in ss], f"streams string, {stream} string")
    return scores.join(F.broadcast(table), stream).groupBy("streams", item).agg(F.avg(score).alias("score"))


def margins(df: DataFrame, anchor: str, positive: str, negative: str) -> DataFrame:
    """Adds positive_sim, negative_sim, margin and passed."""
    p, n = cosine(anchor, positive), cosine(anchor, negative)
    return df.withColumn("positive_sim", p).withColumn("negative_sim", n).withColumn("margin", F.col("positive_sim") - F.col("negative_sim")).withColumn("passed", F.col("margin") > 0)


def loss_gaps(df: DataFrame, ours: str, theirs: str, batches: str, least: int = 8) -> DataFrame:
    """Adds gap, ratio and reliable, best first."""
    gap = F.col(ours) - F.col(theirs)
    return df.withColumn("gap", gap).withColumn("ratio", F.col(ours) / F.nullif(theirs, F.lit(0.0))).withColumn("reliable", (gap > 0) & (F.col(batches) >= least))


def disagreement(cos: Column, label: Column) -> Column:
    """Distance of (cos + 1) / 2 from the label."""
    return F.abs((cos + 1) / 2 - label)


def teacher_quota(df: DataFrame, key: str, score: str, total: int, shares: tuple[float, float] = (0.45, 0.30)) -> DataFrame:
    """(key, part): by clipped score the top share, the middle share and the rest of ``total`` rows.

    The first part has the largest scores, the second those nearest one half among the others, the third the smallest.
    """
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score)))
    a, b = int(total * shares[0]), int(total * shares[1])
    s = df.where(F.col(score).isNotNull() & ~F.isnan(score)).select(key, c.alias("_c"))
    high = s.orderBy(F.desc("_c"), key).limit(a).select(key, F.lit("high").alias("part"))
    mid = s.join(high, key, "left_anti").orderBy(F.abs(F.col("_c") - 0.5), key).limit(b).select(key, F.lit("mid").alias("part"))
    low = s.join(high.unionByName(mid), key, "left_anti").orderBy("_c", key).limit(total - a - b).select(key, F.lit("low").alias("part"))
    return high.unionByName(mid).unionByName(low)
