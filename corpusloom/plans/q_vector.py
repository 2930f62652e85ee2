"""Queries over vectors (V) and nearest-neighbour mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrow
from corpusloom.functions import text as X
from corpusloom.operators import aggregates as A
from corpusloom.operators import vectors as V
from corpusloom.plans import sqltext as Q
from corpusloom.plans.catalog import register
from corpusloom.session import prepare, table


def _t(spark, d, name):
    return table(prepare(spark), d, name)


def _e(spark, d):
    return _t(spark, d, "embeddings")


_E = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
#: The stated query set of every search: rows whose id is divisible by 50, against all rows.
_SIMS = f"(SELECT q.vec_id AS query, q.label AS query_label, e.vec_id AS neighbour, e.label AS label, list_cosine_similarity(q.v, e.v) AS sim FROM {_E} q, {_E} e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)"


def _near(spark, d, k, **kw):
    e = _e(spark, d)
    return V.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", k, **kw)


@register("vector_normalize", f"SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS first FROM {_E}")
def vector_normalize(spark, d):
    return _e(spark, d).select("vec_id", F.round(V.norm("embedding"), 6).alias("norm"), F.round(V.normalized("embedding")[0], 6).alias("first"))


@register("cosine_topk", f"SELECT query, neighbour, round(sim, 6) AS sim, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS place FROM {_SIMS}) WHERE place <= 5")
def cosine_topk(spark, d):
    return _near(spark, d, 5).select("query", "neighbour", F.round("sim", 6).alias("sim"), "place")


@register("semantic_near_match", f"SELECT query, neighbour, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS place FROM {_SIMS} WHERE sim >= 0.25) WHERE place <= 5")
def semantic_near_match(spark, d):
    return _near(spark, d, 5, window=(0.25, 2.0)).select("query", "neighbour", F.round("sim", 6).alias("sim"))


@register("nearest_same_label", f"SELECT query, neighbour, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS place FROM {_SIMS} WHERE label = query_label) WHERE place <= 3")
def nearest_same_label(spark, d):
    return _near(spark, d, 3, label="label", same=True).select("query", "neighbour", F.round("sim", 6).alias("sim"))


_OTHER = f"(SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS place FROM {_SIMS} WHERE label <> query_label)"


@register("diverse_hard_negatives", f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY sim DESC, neighbour) AS r FROM {_OTHER} WHERE place <= 60), t AS (SELECT query, neighbour, row_number() OVER (PARTITION BY query ORDER BY (r > 1)::INT, sim DESC, neighbour) AS place FROM n) SELECT * FROM t WHERE place <= 8")
def diverse_hard_negatives(spark, d):
    return V.diverse(_near(spark, d, 60, label="label", same=False), 8).select("query", "neighbour", "place")


@register("hard_negative_labels", f"WITH b AS (SELECT query, label, max(sim) AS sim FROM {_OTHER} WHERE place <= 100 GROUP BY ALL) SELECT query, label::VARCHAR AS label, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, label::VARCHAR) AS r FROM b) WHERE r <= 3")
def hard_negative_labels(spark, d):
    return V.nearest_labels(_near(spark, d, 100, label="label", same=False), 3).select("query", "label", F.round("sim", 6).alias("sim"))


@register("window_positive", f"SELECT query, neighbour, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS place FROM {_SIMS} WHERE label = query_label AND sim >= 0.06 AND sim < 0.70) WHERE place <= 1")
def window_positive(spark, d):
    return _near(spark, d, 1, label="label", same=True, window=(0.06, 0.70)).select("query", "neighbour", F.round("sim", 6).alias("sim"))


@register("far_same_label", f"SELECT query, neighbour, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS place FROM {_SIMS} WHERE label = query_label AND sim < 0.02) WHERE place <= 2")
def far_same_label(spark, d):
    return _near(spark, d, 2, label="label", same=True, window=(-2.0, 0.02)).select("query", "neighbour", F.round("sim", 6).alias("sim"))


@register("preference_tiers", f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS place FROM {_SIMS}), t AS (SELECT query, neighbour, row_number() OVER (PARTITION BY query ORDER BY (neighbour % 2)::INT, sim DESC, neighbour) AS place FROM n WHERE place <= 40) SELECT * FROM t WHERE place <= 5")
def preference_tiers(spark, d):
    return V.tiered(_near(spark, d, 40), F.col("neighbour") % 2 == 0, 5).select("query", "neighbour", "place")


def _pairs(spark, d):
    e = _e(spark, d).select("vec_id", F.col("embedding").alias("a"), F.col("label").alias("la"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"), F.col("la").alias("lb")), "vec_id")


_PAIRS = f"(SELECT x.vec_id, x.v AS a, y.v AS b, x.label AS la, y.label AS lb FROM {_E} x JOIN {_E} y ON y.vec_id = x.vec_id + 1)"


@register("pair_scores", f"SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_dot_product(a, b), 6) AS dot, round(-list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 6) AS manhattan, round(-list_distance(a, b), 6) AS euclidean FROM {_PAIRS}")
def pair_scores(spark, d):
    return _pairs(spark, d).select("vec_id", *[F.round(c, 6).alias(n) for n, c in V.pair_scores("a", "b").items()])


@register("average_precision", f"""
    WITH s AS (SELECT round(list_cosine_similarity(a, b), 4) AS s, (la = lb)::INT AS r FROM {_PAIRS}), g AS (SELECT s, count(*) AS n, sum(r) AS p FROM s GROUP BY s), c AS (SELECT p, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER (ORDER BY s DESC) AS cp, sum(p) OVER () AS t FROM g)
    SELECT 'all' AS set, round(sum(p::DOUBLE / t * cp / cn), 6) AS ap FROM c""")
def average_precision(spark, d):
    p = _pairs(spark, d).select(F.lit("all").alias("set"), F.round(V.cosine("a", "b"), 4).alias("s"), (F.col("la") == F.col("lb")).alias("r"))
    return V.average_precision(p, "s", F.col("r"), "set").select("set", F.round("ap", 6).alias("ap"))


@register("knn_vote", f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS place FROM {_SIMS}), e AS (SELECT query, label, exp((sim - max(sim) OVER (PARTITION BY query)) / 0.1) AS e FROM n WHERE place <= 5) SELECT query, label::VARCHAR AS label, round(sum(e) / sum(sum(e)) OVER (PARTITION BY query), 6) AS weight FROM e GROUP BY query, label")
def knn_vote(spark, d):
    return V.knn_vote(_near(spark, d, 5, label="label"), 0.1).select("query", "label", F.round("weight", 6).alias("weight"))


_PROTO = f"(SELECT label, list(x ORDER BY i) AS p FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {_E}) GROUP BY label, i) GROUP BY label)"


@register("prototype_scores", f"SELECT vec_id, p.label, round(list_dot_product(v, p), 6) AS score FROM {_E} e, {_PROTO} p")
def prototype_scores(spark, d):
    e = _e(spark, d)
    return V.prototype_scores(e.select("vec_id", "embedding"), "vec_id", "embedding", V.mean_vectors(e, "label", "embedding"), "label").select("vec_id", "label", F.round("score", 6).alias("score"))


@register("prefix_ensemble", f"SELECT label, round(list_dot_product(p, p) / list_dot_product(p, p), 6) AS norm, round(p[1] / sqrt(list_dot_product(p, p)), 6) AS first FROM {_PROTO}")
def prefix_ensemble(spark, d):
    m = V.mean_vectors(_e(spark, d), "label", "embedding", unit=True)
    return m.select("label", F.round(V.dot("vector", "vector"), 6).alias("norm"), F.round(F.col("vector")[0], 6).alias("first"))


@register("lse_classifier", f"WITH m AS (SELECT *, max(sim) OVER (PARTITION BY query, label) AS m FROM {_SIMS}) SELECT query, label::VARCHAR AS label, round(any_value(m) + 0.05 * ln(sum(exp((sim - m) / 0.05))), 6) AS score FROM m GROUP BY query, label")
def lse_classifier(spark, d):
    return _labels(spark, d).select("query", "label", F.round("lse", 6).alias("score"))


def _labels(spark, d):
    e = _e(spark, d)
    return V.label_scores(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", "label", 0.05)


@register("support_pooling", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY sim DESC, neighbour) AS r FROM {_SIMS}) SELECT query, label::VARCHAR AS label, round(avg(sim), 6) AS score FROM r WHERE r <= 2 GROUP BY query, label")
def support_pooling(spark, d):
    return _labels(spark, d).select("query", "label", F.round(V.mean_top2(), 6).alias("score"))


@register("ridge_episode")
def ridge_episode(spark, d):
    """A linear system for each episode is solved with numpy; tested on held-out accuracy."""
    e = _e(spark, d).select(F.pmod(F.xxhash64("vec_id"), F.lit(4)).alias("episode"), "vec_id", "embedding", "label", F.when(F.pmod("vec_id", F.lit(3)) == 0, "query").otherwise("support").alias("role"))
    return V.ridge(e, "episode", "vec_id", "embedding", "label", "role")


@register("ridge_probe")
def ridge_probe(spark, d):
    """The primal form with a bias that isn't penalised; tested against numpy."""
    e = _e(spark, d).select(F.pmod(F.xxhash64("vec_id"), F.lit(4)).alias("episode"), "vec_id", V.normalized("embedding").alias("embedding"), "label", F.when(F.pmod("vec_id", F.lit(3)) == 0, "query").otherwise("support").alias("role"))
    return V.ridge(e, "episode", "vec_id", "embedding", "label", "role", bias=True, temperature=0.05)


_KNN = f"""WITH s AS (SELECT x.e, vec_id, label, v FROM {_E}, (SELECT unnest(range(1, 11)) AS e) x WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY x.e, label ORDER BY md5('4|' || x.e || '|' || vec_id), vec_id) <= 4),
    n AS (SELECT s.e, t.vec_id, t.label::VARCHAR AS label, s.label::VARCHAR AS near FROM {_E} t, s WHERE t.label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s.e, t.vec_id ORDER BY round(list_cosine_similarity(t.v, s.v), 9) DESC, s.vec_id) <= 5),
    c AS (SELECT e, vec_id, label, near, count(*) AS n FROM n GROUP BY ALL), p AS (SELECT e, vec_id, label, coalesce(max(near) FILTER (n > 2), 'none') AS said FROM c GROUP BY e, vec_id, label)"""


def _experiments(spark, d):
    e = _e(spark, d)
    return V.knn_experiments(e, V.knn_supports(e, "vec_id", "label", 4, 10, 4), "vec_id", "embedding", "label")


@register("knn_evaluation", f"{_KNN}, f AS (SELECT e, label, count(*) AS n, count(*) FILTER (label = said) AS hit FROM p GROUP BY e, label), g AS (SELECT e, said AS label, count(*) AS said FROM p GROUP BY e, said) SELECT e::INT AS experiment, sum(n)::BIGINT AS n, round(sum(hit) / sum(n), 6) AS accuracy, round(avg(2.0::DOUBLE * hit / (n + coalesce(said, 0))), 6) AS macro_f1 FROM f LEFT JOIN g USING (e, label) GROUP BY e")
def knn_evaluation(spark, d):
    """Accuracy and macro F1 over ten sampled support sets."""
    return V.knn_report(_experiments(spark, d)).select("experiment", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1")])


@register("knn_confusions", f"{_KNN} SELECT label AS \"true\", said, count(*) AS n FROM p WHERE label <> said GROUP BY label, said")
def knn_confusions(spark, d):
    return A.confusion(_experiments(spark, d).where("NOT correct"), "label", "prediction")


@register("kmeans_clusters")
def kmeans_clusters(spark, d):
    """Spark's k-means: its start is its own, so rows only."""
    return V.kmeans(_e(spark, d), "vec_id", "embedding", 10)


_TERMS = f"(SELECT item_id, unnest({Q.words(Q.audit('text'))}) AS term FROM eval_passages)"
_TFIDF = f"""(WITH tf AS (SELECT item_id, term, count(*) AS tf FROM {_TERMS} GROUP BY ALL), n AS (SELECT count(*) AS n FROM eval_passages), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n WHERE df <= n * 0.9) SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM w)"""


def _tfidf(spark, d):
    docs = _t(spark, d, "eval_passages").select("item_id", X.tokens(X.audit_normal("text")).alias("w"))
    return V.tfidf(docs, "item_id", "w", max_share=0.9)


@register("tfidf_weights", f"SELECT item_id, term, round(weight, 6) AS weight FROM {_TFIDF}")
def tfidf_weights(spark, d):
    return _tfidf(spark, d).select("item_id", "term", F.round("weight", 6).alias("weight"))


@register("tfidf_knn", f"WITH w AS (SELECT * FROM {_TFIDF}), s AS (SELECT a.item_id AS query, b.item_id AS neighbour, sum(a.weight * b.weight) AS sim FROM w a JOIN w b USING (term) WHERE a.item_id % 50 = 0 AND a.item_id <> b.item_id GROUP BY 1, 2) SELECT query, neighbour, round(sim, 6) AS sim, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, neighbour) AS place FROM s) WHERE place <= 5")
def tfidf_knn(spark, d):
    w = _tfidf(spark, d)
    return V.sparse_nearest(w, _t(spark, d, "eval_passages").where("item_id % 50 = 0").select("item_id"), "item_id", 5).select("query", "neighbour", F.round("sim", 6).alias("sim"), "place")


@register("infonce_eval", f"WITH s AS (SELECT query, label = query_label AS p, sim / 0.05 AS s FROM {_SIMS}), m AS (SELECT *, max(s) OVER (PARTITION BY query) AS m FROM s) SELECT query, round(ln(sum(exp(s - m))) - ln(sum(exp(s - m)) FILTER (p)), 5) AS loss FROM m GROUP BY query HAVING count(*) FILTER (p) > 0")
def infonce_eval(spark, d):
    return V.infonce(_labels(spark, d), 0.05).select("query", F.round("loss", 5).alias("loss"))


_BATCHED = f"(SELECT vec_id // 20 AS batch, vec_id, label, v FROM {_E})"
_COS = f"(SELECT vec_id // 20 AS batch, list_cosine_similarity(a, b) AS c, (abs(la - lb) / 10.0)::DOUBLE AS s FROM {_PAIRS})"


@register("pair_score_losses", f"""
    WITH p AS (SELECT batch, count(*) AS n, avg(pow((c + 1) / 2 - s, 2)) AS mse, 1 - corr(c, s) AS pearson FROM {_COS} GROUP BY batch), k AS (SELECT x.batch, ln(1 + sum(exp(20 * (y.c - x.c)))) AS rank FROM {_COS} x JOIN {_COS} y ON x.batch = y.batch AND x.s - y.s > 0.05 GROUP BY 1)
    SELECT batch, round(mse, 6) AS mse, round(pearson, 6) AS pearson, round(rank, 5) AS rank FROM p LEFT JOIN k USING (batch) WHERE n >= 2""")
def pair_score_losses(spark, d):
    p = _pairs(spark, d).select(F.floor(F.col("vec_id") / 20).alias("batch"), V.cosine("a", "b").alias("c"), (F.abs(F.col("la") - F.col("lb")) / 10.0).alias("s"))
    return V.pair_losses(p, "c", "s", "batch").select("batch", F.round("mse", 6).alias("mse"), F.round("pearson", 6).alias("pearson"), F.round("rank", 5).alias("rank"))


@register("supcon_eval", f"""
    WITH s AS (SELECT a.batch, a.vec_id, a.label = b.label AS p, list_cosine_similarity(a.v, b.v) AS s FROM {_BATCHED} a JOIN {_BATCHED} b ON a.batch = b.batch AND a.vec_id <> b.vec_id),
    k AS (SELECT batch, vec_id, count(*) FILTER (p) AS np, count(*) FILTER (NOT p) AS nn, sum(s / 0.1) FILTER (p) AS sp, ln(sum(exp((s - 1) / 0.1))) AS al, coalesce(sum(exp(-2 * (s - 0.5))) FILTER (p), 0) AS mp, coalesce(sum(exp(50 * (s - 0.5))) FILTER (NOT p), 0) AS mn FROM s GROUP BY ALL)
    SELECT batch, round(avg(al + 10 - sp / np), 5) AS supcon, round(avg(ln(1 + mp) / 2 + ln(1 + mn) / 50), 5) AS multi_similarity FROM k WHERE np > 0 AND nn > 0 GROUP BY batch""")
def supcon_eval(spark, d):
    e = _e(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 20))
    m = V.metric_losses(e, "batch", "vec_id", "label", "embedding")
    return m.select("batch", F.round("supcon", 5).alias("supcon"), F.round("multi_similarity", 5).alias("multi_similarity"))


@register("circle_loss")
def circle_loss(spark, d):
    e = _e(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 20))
    return V.metric_losses(e, "batch", "vec_id", "label", "embedding").select("batch", "circle")


@register("hierarchical_loss")
def hierarchical_loss(spark, d):
    """Levels of a label map; tested against numpy."""
    label = F.col("label").cast("string")
    e = _e(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 20)).withColumn("labels", F.create_map(F.lit("fine"), label, F.lit("coarse"), (F.col("label") % 3).cast("string")))
    return V.hierarchical_losses(e, "batch", "vec_id", "labels", "embedding", {"fine": 1.0, "coarse": 0.5})


@register("neutral_losses", f"WITH s AS (SELECT vec_id, list_dot_product(v, p) AS s FROM {_E} e, {_PROTO} p WHERE e.label = 0), m AS (SELECT *, max(s) OVER (PARTITION BY vec_id) AS m FROM s), k AS (SELECT vec_id, any_value(m) AS m, avg(s) AS a, count(*) AS n, ln(sum(exp(s - m))) AS l FROM m GROUP BY vec_id) SELECT vec_id, round(ln(1 + exp(m - 0.35)), 6) AS none_loss, round(l + m - a - ln(n), 6) AS uniform_loss FROM k")
def neutral_losses(spark, d):
    e = _e(spark, d)
    s = V.prototype_scores(e.where("label = 0").select("vec_id", "embedding"), "vec_id", "embedding", V.mean_vectors(e, "label", "embedding"), "label")
    return V.none_losses(s, "vec_id", "score", F.lit(True)).select("vec_id", F.round("none_loss", 6).alias("none_loss"), F.round("uniform_loss", 6).alias("uniform_loss"))


@register("distillation_loss", f"WITH t AS (SELECT vec_id, list_transform(v, lambda x, i: CASE WHEN i % 2 = 0 THEN x ELSE x * 0.5 END) AS t, v FROM {_E}) SELECT count(*) AS n, round(avg(1 - list_cosine_similarity(t, v)), 6) AS loss FROM t")
def distillation_loss(spark, d):
    e = _e(spark, d).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    teacher = e.select("vec_id", F.transform("v", lambda x, i: F.when((i + 1) % 2 == 0, x).otherwise(x * 0.5)).alias("v"))
    return V.distillation(e, teacher, "vec_id", "v").select("n", F.round("loss", 6).alias("loss"))


@register("pairwise_distillation", f"""
    WITH t AS (SELECT vec_id // 20 AS batch, vec_id, v, list_transform(v, lambda x, i: CASE WHEN i % 2 = 0 THEN x ELSE x * 0.5 END) AS t FROM {_E})
    SELECT a.batch, round(avg(pow(list_cosine_similarity(a.v, b.v) - list_cosine_similarity(a.t, b.t), 2)), 6) AS loss FROM t a JOIN t b ON a.batch = b.batch AND a.vec_id <> b.vec_id GROUP BY 1""")
def pairwise_distillation(spark, d):
    e = _e(spark, d).select(F.floor(F.col("vec_id") / 20).alias("batch"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    teacher = e.select("batch", "vec_id", F.transform("v", lambda x, i: F.when((i + 1) % 2 == 0, x).otherwise(x * 0.5)).alias("v"))
    return V.pairwise_distillation(e, teacher, "batch", "vec_id", "v").select("batch", F.round("loss", 6).alias("loss"))


def _state(spark, d, m):
    e = V.mean_vectors(_e(spark, d).where(F.pmod("vec_id", F.lit(3)) == m), "label", "embedding")
    return e.select(F.col("label").cast("string").alias("name"), F.posexplode("vector").alias("idx", "value"))


_STATE = lambda m: f"(SELECT label::VARCHAR AS name, i - 1 AS idx, avg(x) AS value FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {_E} WHERE vec_id % 3 = {m}) GROUP BY label, i)"


@register("param_geometry", f"""
    WITH j AS (SELECT x.value - o.value AS dx, y.value - o.value AS dy FROM {_STATE(0)} o JOIN {_STATE(1)} x USING (name, idx) JOIN {_STATE(2)} y USING (name, idx)), s AS (SELECT avg(dx * dx) AS m, sum(dx * dy) AS xy, sum(dx * dx) AS xx, sum(dy * dy) AS yy FROM j)
    SELECT round(m, 6) AS anchor_mse, round(xy / sqrt(xx * yy), 6) AS delta_cosine, round(xy / yy, 6) AS projection, round(sqrt(xx - xy / yy * xy), 6) AS orthogonal_norm FROM s""")
def param_geometry(spark, d):
    g = V.geometry(*[_state(spark, d, m) for m in range(3)])
    return g.select(*[F.round(c, 6).alias(c) for c in g.columns])


@register("state_average", f"SELECT name, idx, round((a.value * 1.0 + b.value * 3.0) / 4.0, 6) AS value FROM {_STATE(0)} a JOIN {_STATE(1)} b USING (name, idx)")
def state_average(spark, d):
    return V.averaged_state([(_state(spark, d, 0), 1.0), (_state(spark, d, 1), 3.0)]).select("name", F.col("idx").cast("bigint").alias("idx"), F.round("value", 6).alias("value"))


@register("state_extrapolation", f"SELECT name, idx, round(a.value + 1.5 * (b.value - a.value), 6) AS value FROM {_STATE(0)} a JOIN {_STATE(1)} b USING (name, idx)")
def state_extrapolation(spark, d):
    return V.extrapolated(_state(spark, d, 0), _state(spark, d, 1), 1.5).select("name", F.col("idx").cast("bigint").alias("idx"), F.round("value", 6).alias("value"))


@register("score_ensembles", f"""
    WITH p AS (SELECT vec_id, list_cosine_similarity(a, b) AS c, list_dot_product(a, b) AS d, -list_distance(a, b) AS e FROM {_PAIRS}), s AS (SELECT vec_id, 'cosine' AS s, c AS x FROM p UNION ALL SELECT vec_id, 'dot', d FROM p UNION ALL SELECT vec_id, 'euclidean', e FROM p),
    n AS (SELECT unnest(['cosine+dot', 'cosine+euclidean', 'dot+euclidean', 'cosine+dot+euclidean']) AS streams) SELECT streams, vec_id, round(avg(x), 6) AS score FROM n JOIN s ON contains('+' || streams || '+', '+' || s.s || '+') GROUP BY 1, 2""")
def score_ensembles(spark, d):
    p = V.pair_scores("a", "b")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("stream"), p[n].alias("score")) for n in ("cosine", "dot", "euclidean")]))
    s = _pairs(spark, d).select("vec_id", rows.alias("r")).select("vec_id", "r.*")
    return V.ensembles(s, "vec_id", "stream", "score").select("streams", "vec_id", F.round("score", 6).alias("score"))


@register("diagnostic_margins", f"SELECT count(*) AS n, count(*) FILTER (m > 0) AS passed, round(avg(m), 6) AS margin FROM (SELECT list_cosine_similarity(x.v, y.v) - list_cosine_similarity(x.v, z.v) AS m FROM {_E} x JOIN {_E} y ON y.vec_id = x.vec_id + 1 JOIN {_E} z ON z.vec_id = x.vec_id + 2)")
def diagnostic_margins(spark, d):
    e = _e(spark, d)
    p = _pairs(spark, d).join(e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("c")), "vec_id")
    return V.margins(p, "a", "b", "c").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.round(F.avg("margin"), 6).alias("margin"))


@register("jaccard_pairs", f"SELECT pos, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS sim FROM (SELECT pos, list_distinct({Q.words(Q.audit('sentence1'))}) AS a, list_distinct({Q.words(Q.audit('sentence2'))}) AS b FROM pair_score WHERE sentence1 IS NOT NULL AND sentence2 IS NOT NULL)")
def jaccard_pairs(spark, d):
    p = _t(spark, d, "pair_score").where("sentence1 IS NOT NULL AND sentence2 IS NOT NULL")
    return p.select("pos", F.round(X.jaccard(X.token_set("sentence1"), X.token_set("sentence2")), 6).alias("sim"))


@register("edit_ratios")
def edit_ratios(spark, d):
    """Python's matching blocks: rows only."""
    p = _t(spark, d, "pair_score").select("pos", X.audit_normal("sentence1").alias("a"), X.audit_normal("sentence2").alias("b"))
    return p.select("pos", arrow.edit_ratio("a", "b").alias("edit"), arrow.token_set_ratio("a", "b").alias("token_set"), arrow.partial_ratio("a", "b").alias("partial"))


_LOSSES = "(SELECT true_label AS name, avg((NOT correct)::INT) FILTER (experiment = 1) AS ours, avg((NOT correct)::INT) AS theirs, count(DISTINCT experiment) AS batches FROM prediction_log WHERE correct IS NOT NULL GROUP BY 1)"


@register("loss_gap_screen", f"SELECT name, round(ours - theirs, 6) AS gap, round(ours / nullif(theirs, 0), 6) AS ratio, ours - theirs > 0 AND batches >= 8 AS reliable FROM {_LOSSES}")
def loss_gap_screen(spark, d):
    p = _t(spark, d, "prediction_log").where("correct IS NOT NULL").select(F.col("true_label").alias("name"), "experiment", (~F.col("correct")).cast("int").alias("e"))
    s = p.groupBy("name").agg(F.avg(F.when(F.col("experiment") == 1, F.col("e"))).alias("ours"), F.avg("e").alias("theirs"), F.countDistinct("experiment").alias("batches"))
    return V.loss_gaps(s, "ours", "theirs", "batches").select("name", F.round("gap", 6).alias("gap"), F.round("ratio", 6).alias("ratio"), "reliable")


@register("embedding_disagreement", f"SELECT vec_id, round(abs((list_cosine_similarity(a, b) + 1) / 2 - (la = lb)::INT), 6) AS disagreement FROM {_PAIRS}")
def embedding_disagreement(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(V.disagreement(V.cosine("a", "b"), (F.col("la") == F.col("lb")).cast("int")), 6).alias("disagreement"))


_CLIP = "(SELECT pos, least(1.0::DOUBLE, greatest(0.0::DOUBLE, score)) AS c FROM pair_score WHERE score IS NOT NULL AND NOT isnan(score))"


@register("teacher_quota", f"""
    WITH h AS (SELECT pos, 'high' AS part FROM {_CLIP} ORDER BY c DESC, pos LIMIT 90), m AS (SELECT pos, 'mid' AS part FROM {_CLIP} WHERE pos NOT IN (SELECT pos FROM h) ORDER BY abs(c - 0.5), pos LIMIT 60),
    l AS (SELECT pos, 'low' AS part FROM {_CLIP} WHERE pos NOT IN (SELECT pos FROM h UNION SELECT pos FROM m) ORDER BY c, pos LIMIT 50) FROM h UNION ALL FROM m UNION ALL FROM l""")
def teacher_quota(spark, d):
    return V.teacher_quota(_t(spark, d, "pair_score").select("pos", "score"), "pos", "score", 200)
