"""Queries over manifests, scores and gates (M) and score extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import governance as G
from corpusloom.operators import matching as M
from corpusloom.plans.catalog import register
from corpusloom.plans.q_counts import _LOG, _RIGHT, _log
from corpusloom.session import prepare, table


def _t(spark, d, name):
    return table(prepare(spark), d, name)


@register("manifest_errors", """
    WITH d AS (SELECT name, unnest(datasets) AS d, generate_subscripts(datasets, 1) - 1 AS place FROM manifest)
    SELECT name, -1 AS place, 'no_name' AS error FROM manifest WHERE name IS NULL OR trim(name) = '' UNION ALL SELECT name, -1, 'no_datasets' FROM manifest WHERE coalesce(len(datasets), 0) = 0
    UNION ALL SELECT name, place, 'no_id' FROM d WHERE d.id IS NULL OR trim(d.id) = '' UNION ALL SELECT name, place, 'no_usage' FROM d WHERE coalesce(len(d.usage), 0) = 0 UNION ALL SELECT name, place, 'no_task_list' FROM d WHERE d.contaminates_rumteb_tasks IS NULL""")
def manifest_errors(spark, d):
    return G.manifest_errors(_t(spark, d, "manifest"))


_BAD = "(SELECT DISTINCT task FROM (SELECT unnest(d.contaminates_rumteb_tasks) AS task, d.usage AS u FROM (SELECT unnest(datasets) AS d FROM manifest)) WHERE NOT coalesce(len(u) > 0 AND len(list_filter(u, lambda x: x <> 'diagnostic_only')) = 0, false) AND task IS NOT NULL)"


def _tasks(spark, d):
    return _t(spark, d, "eval_passages").select("task").distinct(), M.contaminated_tasks(_t(spark, d, "manifest"))


@register("scope_filter", f"SELECT DISTINCT task FROM eval_passages WHERE task NOT IN (SELECT task FROM {_BAD})")
def scope_filter(spark, d):
    return G.in_scope(*_tasks(spark, d), "task", "clean")


@register("run_manifest", f"WITH t AS (SELECT DISTINCT task FROM eval_passages), b AS {_BAD} SELECT 'clean' AS scope, 7 AS seed, coalesce(string_agg(task, ',' ORDER BY task) FILTER (task NOT IN (SELECT task FROM b)), '') AS included, coalesce(string_agg(task, ',' ORDER BY task) FILTER (task IN (SELECT task FROM b)), '') AS excluded FROM t")
def run_manifest(spark, d):
    return G.run_manifest(*_tasks(spark, d), "task", "clean", 7)


_RULES = [("retrieval", "retrieval"), ("sts", "similarity"), ("paraphrase", "similarity"), ("topic", "classification"), ("emotion", "classification")]


@register("task_categories", "SELECT task, CASE " + " ".join(f"WHEN contains(lower(task), '{p}') THEN '{n}'" for p, n in _RULES) + " ELSE 'other' END AS category, count(*) AS items FROM eval_passages GROUP BY 1, 2")
def task_categories(spark, d):
    e = _t(spark, d, "eval_passages").select("task", G.category(F.col("task"), _RULES).alias("category"))
    return e.groupBy("task", "category").agg(F.count("*").alias("items"))


@register("score_extraction", f"SELECT model AS task_name, round(avg(coalesce({_RIGHT}, false)::INT), 6) AS mean_score, round(avg(coalesce({_RIGHT}, false)::INT) FILTER (experiment = 1), 6) AS first_score FROM (SELECT * FROM {_LOG}) GROUP BY model")
def score_extraction(spark, d):
    """The log as nested results: a map from split (the experiment) to entries with a main score."""
    right = F.coalesce(F.expr(_RIGHT), F.lit(False)).cast("int").cast("double")
    split = F.when(F.col("experiment") == 1, "test").otherwise(F.concat(F.lit("run"), F.col("experiment").cast("string")))
    each = _log(spark, d).groupBy("model", split.alias("s")).agg(F.collect_list(F.struct(right.alias("main_score"))).alias("e"))
    r = each.groupBy(F.col("model").alias("task_name")).agg(F.map_from_entries(F.collect_list(F.struct("s", "e"))).alias("scores"))
    return G.main_scores(r).select("task_name", F.round("mean_score", 6).alias("mean_score"), F.round("first_score", 6).alias("first_score"))


_DELTA = f"""(WITH a AS (SELECT model, lower(trim(true_label)) AS task, avg(coalesce({_RIGHT}, false)::INT) AS s FROM {_LOG} GROUP BY 1, 2), b AS (SELECT task, s FROM a WHERE model = (SELECT min(model) FROM a))
    SELECT model, a.task, a.s - b.s AS delta FROM a JOIN b USING (task) WHERE model <> (SELECT min(model) FROM a))"""


def _deltas(spark, d):
    a = _log(spark, d).groupBy("model", F.lower(F.trim("true_label")).alias("task")).agg(F.avg(F.coalesce(F.expr(_RIGHT), F.lit(False)).cast("int")).alias("s"))
    low = a.agg(F.min("model").alias("_low"))
    b = a.join(F.broadcast(low), F.col("model") == F.col("_low")).select("task", F.col("s").alias("_b"))
    return a.join(F.broadcast(low), F.col("model") != F.col("_low")).join(b, "task").select("model", "task", (F.col("s") - F.col("_b")).alias("delta"))


@register("result_summary", f"""
    WITH s AS (SELECT task, avg((split = 'test')::INT) AS s FROM eval_passages GROUP BY task), r AS (SELECT *, CASE {" ".join(f"WHEN contains(lower(task), '{p}') THEN '{n}'" for p, n in _RULES)} ELSE 'other' END AS cat, CASE WHEN task IN (SELECT task FROM {_BAD}) THEN 'contaminated' ELSE 'clean' END AS scope FROM s),
    x AS (SELECT unnest(['all', scope]) AS scope, cat, task, s FROM r), y AS (SELECT scope, unnest(['all', cat]) AS category, task, s FROM x) SELECT scope, category, count(*) AS tasks, round(avg(s), 6) AS mean, arg_min(task, {{'s': s, 't': task}}) AS worst_task FROM y GROUP BY scope, category""")
def result_summary(spark, d):
    """The share of test items stands for the score of a task."""
    r = _t(spark, d, "eval_passages").groupBy("task").agg(F.avg((F.col("split") == "test").cast("int")).alias("s"))
    return G.result_summary(r, "task", "s", _RULES, M.contaminated_tasks(_t(spark, d, "manifest"))).withColumn("mean", F.round("mean", 6))


@register("gate_rank", f"""
    WITH s AS (SELECT model, count(DISTINCT task) AS tasks, avg(delta) AS mean_delta, min(delta) AS worst_delta, sum(greatest(-0.01::DOUBLE - delta, 0::DOUBLE)) AS shortfall FROM {_DELTA} GROUP BY model)
    SELECT model, tasks, round(mean_delta, 6) AS mean_delta, round(worst_delta, 6) AS worst_delta, round(shortfall, 6) AS shortfall, worst_delta >= -0.01 AND mean_delta >= 0 AS promoted, row_number() OVER (ORDER BY (worst_delta >= -0.01 AND mean_delta >= 0) DESC, shortfall, mean_delta DESC, model) AS place FROM s""")
def gate_rank(spark, d):
    g = G.gate(_deltas(spark, d), "model", "task", "delta")
    return g.select("model", "tasks", *[F.round(c, 6).alias(c) for c in ("mean_delta", "worst_delta", "shortfall")], "promoted", "place")


_STRONG = "(SELECT max(model) FROM prediction_log)"
_FLIPS = f"""(WITH s AS (SELECT test_index, avg(coalesce({_RIGHT}, false)::INT) FILTER (model = {_STRONG}) AS a, avg(coalesce({_RIGHT}, false)::INT) FILTER (model <> {_STRONG}) AS b FROM {_LOG} GROUP BY 1)
    SELECT test_index, round(a, 6) AS strong_rate, round(b, 6) AS other_rate, CASE WHEN a >= 0.7 AND b <= 0.3 THEN 'only_strong' WHEN a - b >= 0.3 THEN 'gained' WHEN a - b <= -0.3 THEN 'lost' END AS flip FROM s)"""


def _flips(spark, d, pick):
    log = _log(spark, d)
    strong = log.agg(pick("model")).first()[0] or ""
    return G.flips(log, "test_index", "model", F.coalesce(F.expr(_RIGHT), F.lit(False)).cast("int"), strong)


@register("flip_sets", f"SELECT * FROM {_FLIPS} WHERE flip IS NOT NULL")
def flip_sets(spark, d):
    return _flips(spark, d, F.max).select("test_index", F.round("strong_rate", 6).alias("strong_rate"), F.round("other_rate", 6).alias("other_rate"), "flip")


@register("flip_overlap", f"WITH a AS (SELECT test_index, flip AS x FROM {_FLIPS} WHERE flip IS NOT NULL), b AS (SELECT test_index, flip AS y FROM {_FLIPS.replace('max(model)', 'min(model)')} WHERE flip IS NOT NULL), j AS (SELECT * FROM a FULL JOIN b USING (test_index)), k AS (SELECT x AS flip FROM j WHERE x IS NOT NULL UNION SELECT y FROM j WHERE y IS NOT NULL) SELECT flip, (SELECT count(*) FROM j WHERE x = flip) AS left, (SELECT count(*) FROM j WHERE y = flip) AS right, (SELECT count(*) FROM j WHERE x = flip AND y = flip) AS both FROM k".replace(" AS both", ' AS "both"').replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def flip_overlap(spark, d):
    return G.flip_overlap(_flips(spark, d, F.max), _flips(spark, d, F.min), "test_index")


_CURVE = f"(SELECT model, test_index // 10 AS step, round(avg((NOT coalesce({_RIGHT}, false))::INT), 6) AS loss FROM {_LOG} GROUP BY 1, 2)"


@register("early_stop_history", f"""
    WITH b AS (SELECT *, min(loss) OVER (PARTITION BY model ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, row_number() OVER (PARTITION BY model ORDER BY step) AS n FROM {_CURVE}), u AS (SELECT *, l IS NULL OR loss < l - 0.001 AS up FROM b),
    s AS (SELECT model, step, loss, min(loss) OVER w AS best, n - max(CASE WHEN up THEN n END) OVER w AS since FROM u WINDOW w AS (PARTITION BY model ORDER BY step ROWS UNBOUNDED PRECEDING))
    SELECT *, max((since >= 3)::INT) OVER (PARTITION BY model ORDER BY step ROWS UNBOUNDED PRECEDING) = 1 AS stopped FROM s""")
def early_stop_history(spark, d):
    curve = _log(spark, d).groupBy("model", F.floor(F.col("test_index") / 10).alias("step")).agg(F.round(F.avg((~F.coalesce(F.expr(_RIGHT), F.lit(False))).cast("int")), 6).alias("loss"))
    return G.early_stop(curve, "model", "step", "loss", 0.001, 3)


@register("probe_summary", f"""
    WITH s AS (SELECT model, lower(trim(true_label)) AS metric, avg(coalesce({_RIGHT}, false)::INT) AS s FROM {_LOG} GROUP BY 1, 2), b AS (SELECT model, metric AS best_metric, s AS score, row_number() OVER (PARTITION BY model ORDER BY s DESC, metric DESC) AS r FROM s)
    SELECT model, best_metric, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, model) AS place, round(score - 0.5, 6) AS delta_half FROM b WHERE r = 1""")
def probe_summary(spark, d):
    s = _log(spark, d).groupBy("model", F.lower(F.trim("true_label")).alias("metric")).agg(F.avg(F.coalesce(F.expr(_RIGHT), F.lit(False)).cast("int")).alias("s"))
    p = G.probe_summary(s, "model", "metric", "s", {"half": 0.5})
    return p.select("model", "best_metric", F.round("score", 6).alias("score"), "place", F.round("delta_half", 6).alias("delta_half"))


@register("prompt_policy", """
    WITH i AS (SELECT DISTINCT task, CASE WHEN contains(task, 'retrieval') THEN 'retrieval' ELSE 'sts' END AS type, s AS side FROM eval_passages, (SELECT unnest(['query', 'document']) AS s))
    SELECT task, type, side, CASE WHEN type = 'retrieval' AND side = 'document' THEN NULL WHEN task = 'long_sts' AND side = 'query' THEN 'long: ' WHEN type = 'sts' THEN 'sts: ' WHEN type = 'retrieval' THEN 'find: ' END AS prompt FROM i""")
def prompt_policy(spark, d):
    sides = F.explode(F.array(F.lit("query"), F.lit("document"))).alias("side")
    i = _t(spark, d, "eval_passages").select("task").distinct().select("task", F.when(F.contains(F.col("task"), F.lit("retrieval")), "retrieval").otherwise("sts").alias("type"), sides)
    rows = [("long_sts", None, "query", "long: "), (None, "sts", "query", "sts: "), (None, "sts", "document", "sts: "), (None, "retrieval", "query", "find: "), (None, "retrieval", "document", "never: ")]
    return G.prompt_policy(i, spark.createDataFrame(rows, "task string, type string, side string, prompt string")).select("task", "type", "side", "prompt")
