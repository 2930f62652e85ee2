"""Manifests, benchmark scores, gates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def manifest_errors(manifest: DataFrame) -> DataFrame:
    """(name, place, error): what is missing in a manifest, with the place of the dataset; place -1 is the manifest itself (M1)."""
    empty = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    top = F.array_compact(F.array(
        F.when(F.col("name").isNull() | (F.trim("name") == ""), F.struct(F.lit(-1).cast("bigint").alias("place"), F.lit("no_name").alias("error"))),
        F.when(F.coalesce(F.size("datasets"), F.lit(0)) <= 0, F.struct(F.lit(-1).cast("bigint").alias("place"), F.lit("no_datasets").alias("error"))),
    ))
    each = F.transform(F.col("datasets"), lambda d, i: F.array_compact(F.array(
        F.when(d["id"].isNull() | (F.trim(d["id"]) == ""), F.struct(i.cast("bigint").alias("place"), F.lit("no_id").alias("error"))),
        F.when(empty(d["usage"]), F.struct(i.cast("bigint").alias("place"), F.lit("no_usage").alias("error"))),
        F.when(d["contaminates_rumteb_tasks"].isNull(), F.struct(i.cast("bigint").alias("place"), F.lit("no_task_list").alias("error"))),
    )))
    every = F.concat(top, F.flatten(F.coalesce(each, F.array().cast("array<array<struct<place:bigint,error:string>>>"))))
    return manifest.select("name", F.explode(every).alias("e")).select("name", "e.place", "e.error")


def in_scope(tasks: DataFrame, contaminated: DataFrame, task: str, scope: str) -> DataFrame:
    """Tasks that are clean, contaminated, or all (M3); an unknown scope is an error."""
    if scope == "all":
        return tasks
    if scope not in ("clean", "contaminated"):
        raise ValueError(scope)
    return tasks.join(contaminated.select(task), task, "left_anti" if scope == "clean" else "left_semi")


def category(task: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The category of the first rule whose part occurs in the task's name (M4)."""
    out = F.lit(other)
    for part, name in reversed(rules):
        out = F.when(F.contains(F.lower(task), F.lit(part)), name).otherwise(out)
    return out


def main_scores(results: DataFrame, task: str = "task_name", scores: str = "scores", preferred: tuple[str, ...] = ("test", "dev", "validation")) -> DataFrame:
    """(task, mean_score, first_score) of a map from split to entries with a main score.

    mean_score: over all entries of all splits; first_score: of the first preferred split that
    has entries.  Both are null where there is none.
    """
    each = F.flatten(F.map_values(scores))
    mean = lambda a: F.try_divide(F.aggregate(F.filter(a, lambda x: x["main_score"].isNotNull()), F.lit(0.0), lambda s, x: s + x["main_score"]), F.size(F.filter(a, lambda x: x["main_score"].isNotNull())))
    first = F.coalesce(*[mean(F.try_element_at(scores, F.lit(s))) for s in preferred])
    return results.select(task, mean(each).alias("mean_score"), first.alias("first_score"))


def result_summary(results: DataFrame, task: str, score: str, rules: list[tuple[str, str]], contaminated: DataFrame) -> DataFrame:
    """(scope, category, tasks, mean, worst_task): averages over the tasks with a score, all, clean and contaminated ones, by category and over all (M5).

    contaminated: (task, ...), the tasks that training data contaminate.  Null and NaN scores are none.
    """
    bad = contaminated.select(F.col("task").alias("_bad")).distinct()
    rows = results.where(F.col(score).isNotNull() & ~F.isnan(score)).join(bad, F.col(task) == F.col("_bad"), "left")
    scopes = F.array(F.lit("all"), F.when(F.col("_bad").isNull(), "clean").otherwise("contaminated"))
    each = rows.select(F.explode(scopes).alias("scope"), F.explode(F.array(F.lit("all"), category(F.col(task), rules))).alias("category"), F.col(task).alias("_t"), F.col(score).alias("_s"))
    return each.groupBy("scope", "category").agg(F.count("*").alias("tasks"), F.avg("_s").alias("mean"), F.min_by("_t", F.struct("_s", "_t")).alias("worst_task"))


def gate(runs: DataFrame, run: str, task: str, delta: str, worst: float = -0.01, mean: float = 0.0) -> DataFrame:
    """(run, tasks, mean_delta, worst_delta, shortfall, promoted, place): runs ranked by what they fall short of (M7).

    A run is promoted if no task falls below ``worst`` and the mean reaches ``mean``.
    """
    s = runs.where(F.col(delta).isNotNull()).groupBy(run).agg(F.countDistinct(task).alias("tasks"), F.avg(delta).alias("mean_delta"), F.min(delta).alias("worst_delta"), F.sum(F.greatest(F.lit(worst) - F.col(delta), F.lit(0.0))).alias("shortfall"))
    s = s.withColumn("promoted", (F.col("worst_delta") >= worst) & (F.col("mean_delta") >= mean))
    return s.withColumn("place", F.row_number().over(W.orderBy(F.desc("promoted"), "shortfall", F.desc("mean_delta"), run)).cast("bigint"))


def flips(log: DataFrame, item: str, model: str, correct: Column, strong: str, least: float = 0.3) -> DataFrame:
    """(item, strong_rate, other_rate, flip): how often one model is right on an item against the others (M8).

    flip: gained or lost if the rates differ by ``least``; only_strong if it is right in 0.7 and the others in at most 0.3.
    """
    r = correct.cast("double")
    s = log.groupBy(item).agg(F.avg(F.when(F.col(model) == strong, r)).alias("strong_rate"), F.avg(F.when(F.col(model) != strong, r)).alias("other_rate"))
    gap = F.col("strong_rate") - F.col("other_rate")
    flip = F.when((F.col("strong_rate") >= 0.7) & (F.col("other_rate") <= 0.3), "only_strong").when(gap >= least, "gained").when(gap <= -least, "lost")
    return s.withColumn("flip", flip).where("flip IS NOT NULL")


def flip_overlap(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """(flip, left, right, both): how many items two reports have in common, by kind (M9)."""
    j = a.select(item, F.col("flip").alias("_a")).join(b.select(item, F.col("flip").alias("_b")), item, "full")
    kinds = F.explode(F.array_distinct(F.array_compact(F.array("_a", "_b")))).alias("flip")
    return j.select("*", kinds).groupBy("flip").agg(F.count_if(F.col("_a") == F.col("flip")).alias("left"), F.count_if(F.col("_b") == F.col("flip")).alias("right"), F.count_if((F.col("_a") == F.col("flip")) & (F.col("_b") == F.col("flip"))).alias("both"))


def early_stop(losses: DataFrame, run: str, step: str, loss: str, min_delta: float = 0.0, patience: int = 3) -> DataFrame:
    """(run, step, loss, best, since, stopped): the running best, the steps since it improved by min_delta, and whether patience has run out.

    A step improves if its loss is below the least before it by more than min_delta.
    """
    before = W.partitionBy(run).orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(run).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    b = losses.where(F.col(loss).isNotNull()).withColumn("_least", F.min(loss).over(before)).withColumn("_n", F.row_number().over(W.partitionBy(run).orderBy(step)))
    b = b.withColumn("_up", F.col("_least").isNull() | (F.col(loss) < F.col("_least") - min_delta))
    b = b.withColumn("best", F.min(loss).over(upto)).withColumn("since", (F.col("_n") - F.max(F.when(F.col("_up"), F.col("_n"))).over(upto)).cast("bigint"))
    return b.withColumn("stopped", F.max(F.col("since") >= patience).over(upto)).select(run, step, loss, "best", "since", "stopped")


def probe_summary(scores: DataFrame, variant: str, metric: str, score: str, baselines: dict[str, float]) -> DataFrame:
    """(variant, best_metric, score, place, one delta for each baseline): variants by their best metric."""
    best = scores.where(F.col(score).isNotNull()).groupBy(variant).agg(F.max_by(F.struct(F.col(metric).alias("m"), F.col(score).alias("s")), F.struct(F.col(score), F.col(metric))).alias("_b"))
    out = best.select(variant, F.col("_b.m").alias("best_metric"), F.col("_b.s").alias("score"))
    out = out.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), variant)).cast("bigint"))
    return out.select("*", *[(F.col("score") - v).alias(f"delta_{n}") for n, v in sorted(baselines.items())])


def prompt_policy(inputs: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds the prompt of each input: that of its task and side, else of its type and side, else none.

    inputs: (task, type, side, ...); policy: (task, type, side, prompt) with null for any.
    Documents of a retrieval never have a prompt.
    """
    exact = policy.where("task IS NOT NULL").select("task", "side", F.col("prompt").alias("_exact"))
    typed = policy.where("task IS NULL").select("type", "side", F.col("prompt").alias("_typed"))
    j = inputs.join(exact, ["task", "side"], "left").join(typed, ["type", "side"], "left")
    never = (F.col("type") == "retrieval") & (F.col("side") == "document")
    return j.withColumn("prompt", F.when(~F.coalesce(never, F.lit(False)), F.coalesce("_exact", "_typed"))).drop("_exact", "_typed")


def run_manifest(tasks: DataFrame, contaminated: DataFrame, task: str, scope: str, seed: int) -> DataFrame:
    """One row on a run: scope, seed, tasks used and left out."""
    used = in_scope(tasks, contaminated, task, scope).select(task).distinct()
    j = tasks.select(task).distinct().join(used.withColumn("_u", F.lit(True)), task, "left")
    pick = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col(task)))), ",")
    return j.agg(pick(F.col("_u").isNotNull()).alias("included"), pick(F.col("_u").isNull()).alias("excluded")).select(F.lit(scope).alias("scope"), F.lit(seed).alias("seed"), "included", "excluded")
