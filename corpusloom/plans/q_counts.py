"""Queries over deduplication (A1-A7) and aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.names import canonical_name
from corpusloom.operators import aggregates as A
from corpusloom.operators import dedup
from corpusloom.plans import sqltext as Q
from corpusloom.plans.catalog import register
from corpusloom.session import prepare, table


def _t(spark, d, name):
    return table(prepare(spark), d, name)


@register("dedup_first_wins", f"SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY {Q.audit('text')}")
def dedup_first_wins(spark, d):
    return dedup.first_wins(_t(spark, d, "documents").select("doc_id", "text"), X.audit_normal("text"), order=["doc_id"]).select("doc_id")


@register("dedup_prefix", f"SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY substring({Q.audit('text')}, 1, 260)")
def dedup_prefix(spark, d):
    return dedup.first_wins(_t(spark, d, "documents").select("doc_id", "text"), dedup.prefix_key(X.audit_normal("text"), 260), order=["doc_id"]).select("doc_id")


@register("dedup_composite", f"SELECT {Q.source()} AS source, min(pos) AS pos FROM contrastive WHERE query IS NOT NULL AND {Q.source()} IS NOT NULL GROUP BY {Q.source()}, coalesce(objective, 'contrastive'), substring({Q.alnum('query')}, 1, 200)")
def dedup_composite(spark, d):
    c = _t(spark, d, "contrastive").select("pos", canonical_name("source").alias("source"), "objective", "query")
    return dedup.first_wins(c, "source", F.coalesce("objective", F.lit("contrastive")), dedup.prefix_key(X.alnum_key("query"), 200), order=["pos"]).select("source", "pos")


@register("dedup_unordered_pairs", f"SELECT min(pos) AS pos FROM (SELECT pos, {Q.alnum('sentence1')} AS a, {Q.alnum('sentence2')} AS b FROM pair_score) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY least(a, b), greatest(a, b)")
def dedup_unordered_pairs(spark, d):
    p = _t(spark, d, "pair_score").select("pos", X.alnum_key("sentence1").alias("a"), X.alnum_key("sentence2").alias("b"))
    return dedup.first_wins(p, dedup.unordered_key("a", "b"), order=["pos"]).select("pos")


_LABEL = "nullif(replace(lower(trim(label)), ' ', '_'), '')"


@register("dedup_per_group", f"SELECT batch_id, slot, label FROM (SELECT batch_id, slot, {_LABEL} AS label, row_number() OVER (PARTITION BY {_LABEL}, {Q.alnum('text')} ORDER BY batch_id, slot) AS r FROM labeled_text WHERE {_LABEL} IS NOT NULL AND text IS NOT NULL) WHERE r = 1")
def dedup_per_group(spark, d):
    label = F.regexp_replace(F.lower(F.trim("label")), " ", "_")
    t = _t(spark, d, "labeled_text").select("batch_id", "slot", F.when(label != "", label).alias("label"), "text")
    return dedup.first_wins(t, "label", X.alnum_key("text"), order=["batch_id", "slot"]).select("batch_id", "slot", "label")


@register("dedup_triplets", f"SELECT min(pos) AS pos FROM contrastive WHERE query IS NOT NULL AND positive IS NOT NULL AND negatives[1] IS NOT NULL GROUP BY {Q.alnum('query')}, {Q.alnum('positive')}, {Q.alnum('negatives[1]')}")
def dedup_triplets(spark, d):
    c = _t(spark, d, "contrastive").select("pos", "query", "positive", F.get("negatives", F.lit(0)).alias("negative"))
    return dedup.first_wins(c, X.alnum_key("query"), X.alnum_key("positive"), X.alnum_key("negative"), order=["pos"]).select("pos")


@register("array_dedup", "SELECT pos, len(list_distinct(negatives))::BIGINT AS n_distinct, len(negatives)::BIGINT AS n FROM contrastive WHERE negatives IS NOT NULL AND NOT list_contains(list_transform(negatives, lambda x: x IS NULL), true)")
def array_dedup(spark, d):
    c = _t(spark, d, "contrastive").where("negatives IS NOT NULL AND NOT exists(negatives, x -> x IS NULL)")
    return c.select("pos", F.size(dedup.array_first("negatives")).cast("bigint").alias("n_distinct"), F.size("negatives").cast("bigint").alias("n"))


@register("count_by_source_objective", f"SELECT coalesce({Q.source()}, 'unknown') AS source, coalesce(objective, 'contrastive') AS objective, count(*) AS n FROM contrastive GROUP BY 1, 2")
def count_by_source_objective(spark, d):
    c = _t(spark, d, "contrastive").select(canonical_name("source").alias("source"), "objective")
    return A.count_by(c, "source", "objective", source="unknown", objective="contrastive")


@register("top_counts", f"SELECT source, count(*) AS n FROM (SELECT {Q.source()} AS source FROM documents) GROUP BY source ORDER BY n DESC, source NULLS LAST LIMIT 10")
def top_counts(spark, d):
    return A.top_counts(_t(spark, d, "documents").select(canonical_name("source").alias("source")), "source", 10)


@register("capped_histogram", "SELECT least(coalesce(len(negatives), 0), 5)::BIGINT AS size, count(*) AS n FROM contrastive GROUP BY 1")
def capped_histogram(spark, d):
    return A.capped_histogram(_t(spark, d, "contrastive"), F.coalesce(F.when(F.col("negatives").isNotNull(), F.size("negatives")), F.lit(0)).cast("bigint"), 5)


@register("having_min_count", f"SELECT label, count(*) AS n FROM (SELECT {_LABEL} AS label FROM labeled_text) WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 30")
def having_min_count(spark, d):
    label = F.regexp_replace(F.lower(F.trim("label")), " ", "_")
    return A.with_min_count(_t(spark, d, "labeled_text").select(F.when(label != "", label).alias("label")).where("label IS NOT NULL"), "label", least=30)


@register("nested_groups", f"SELECT {Q.source()} AS source, count(*) AS labels, sum(n)::BIGINT AS rows, max(n) AS largest FROM (SELECT source, coalesce(split, 'none') AS split, count(*) AS n FROM contrastive GROUP BY ALL) WHERE {Q.source()} IS NOT NULL GROUP BY 1".replace("(SELECT source, coalesce", f"(SELECT {Q.source()} AS source, coalesce").replace(f"SELECT {Q.source()} AS source, count(*) AS labels", "SELECT source, count(*) AS labels").replace(f"WHERE {Q.source()} IS NOT NULL GROUP BY 1", "WHERE source IS NOT NULL GROUP BY source"))
def nested_groups(spark, d):
    c = _t(spark, d, "contrastive").select(canonical_name("source").alias("source"), F.coalesce("split", F.lit("none")).alias("split")).where("source IS NOT NULL")
    return A.count_by(c, "source", "split").groupBy("source").agg(F.count("*").alias("labels"), F.sum("n").alias("rows"), F.max("n").alias("largest"))


@register("vote_winner", """
    WITH v AS (SELECT DISTINCT pos, rater, category FROM review_labels WHERE category IS NOT NULL), c AS (SELECT pos, category, count(*) AS votes FROM v GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY votes DESC, category) AS r, lead(votes) OVER (PARTITION BY pos ORDER BY votes DESC, category) AS nxt FROM c)
    SELECT pos, category, votes FROM r WHERE r = 1 AND votes >= 2 AND votes > coalesce(nxt, 0)""")
def vote_winner(spark, d):
    return A.vote_winner(_t(spark, d, "review_labels"), "pos", "rater", "category", 2)


_TAGS = "list_filter(string_split(regexp_replace(lower(title), '[^а-яёa-z ]+', '', 'g'), ' '), lambda x: x <> '')"


@register("tag_pair_clusters", f"""
    WITH t AS (SELECT doc_id, {_TAGS} AS tags FROM documents WHERE title IS NOT NULL), s AS (SELECT doc_id, unnest(tags) AS cluster, generate_subscripts(tags, 1) - 1 AS place FROM t),
    p AS (SELECT a.doc_id, a.cluster || ' + ' || b.cluster AS cluster, a.place FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.place = a.place + 1),
    pf AS (SELECT * FROM p WHERE cluster IN (SELECT cluster FROM p GROUP BY cluster HAVING count(*) >= 4)), sf AS (SELECT * FROM s WHERE cluster IN (SELECT cluster FROM s GROUP BY cluster HAVING count(*) >= 8) AND doc_id NOT IN (SELECT doc_id FROM pf)),
    u AS (SELECT doc_id, cluster, place FROM pf UNION ALL SELECT doc_id, cluster, place FROM sf)
    SELECT doc_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, cluster) AS r FROM u) WHERE r <= 2""")
def tag_pair_clusters(spark, d):
    tags = F.filter(F.split(F.regexp_replace(F.lower("title"), "[^а-яёa-z ]+", ""), " "), lambda x: x != "")
    return A.tag_clusters(_t(spark, d, "documents").where("title IS NOT NULL").select("doc_id", tags.alias("tags")), "doc_id", "tags", 4, 8)


@register("similarity_stats", f"SELECT source, count(score) AS n, round(avg(score), 6) AS mean, min(score) AS least, max(score) AS most, round(quantile_cont(score, 0.9), 6) AS p90 FROM (SELECT {Q.source()} AS source, CASE WHEN NOT isnan(score) THEN score END AS score FROM pair_score) GROUP BY source")
def similarity_stats(spark, d):
    s = A.spread(_t(spark, d, "pair_score").select(canonical_name("source").alias("source"), "score"), "score", "source")
    return s.select("source", "n", F.round("mean", 6).alias("mean"), "least", "most", F.round("p90", 6).alias("p90"))


@register("scoped_averages", f"""
    WITH s AS (SELECT CASE WHEN {Q.source()} LIKE 'sci%' THEN 'science' ELSE 'other' END AS scope, coalesce({Q.source()}, 'none') AS category, CASE WHEN NOT isnan(score) THEN score END AS score FROM pair_score)
    SELECT CASE WHEN grouping(scope) = 1 THEN 'all' ELSE scope END AS scope, CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, round(avg(score), 6) AS mean, count(score) AS n FROM s GROUP BY GROUPING SETS ((scope, category), (scope), (category), ())""")
def scoped_averages(spark, d):
    s = canonical_name("source")
    p = _t(spark, d, "pair_score").select(F.when(s.startswith("sci"), "science").otherwise("other").alias("scope"), s.alias("category"), "score")
    return A.scoped_averages(p, "score", "scope", "category").withColumn("mean", F.round("mean", 6))


_LOG = "(SELECT DISTINCT ON (model, experiment, test_index) * FROM prediction_log ORDER BY model, experiment, test_index, logged_at DESC, coalesce(prediction, '') DESC, coalesce(correct::VARCHAR, '') DESC)"


def _log(spark, d):
    """The newest entry of each prediction."""
    p = _t(spark, d, "prediction_log")
    order = F.struct("logged_at", F.coalesce("prediction", F.lit("")), F.coalesce(F.col("correct").cast("string"), F.lit("")))
    return p.groupBy("model", "experiment", "test_index").agg(F.max_by(F.struct("true_label", "prediction", "correct"), order).alias("r")).select("model", "experiment", "test_index", "r.*")


_RIGHT = "lower(trim(prediction)) = lower(trim(true_label))"


@register("confusion_counts", f"SELECT lower(trim(true_label)) AS true, coalesce(lower(trim(prediction)), 'none') AS said, count(*) AS n FROM {_LOG} GROUP BY 1, 2")
def confusion_counts(spark, d):
    p = _log(spark, d).select(F.lower(F.trim("true_label")).alias("t"), F.coalesce(F.lower(F.trim("prediction")), F.lit("none")).alias("s"))
    return A.confusion(p, "t", "s")


@register("label_accuracy", f"SELECT label, round(avg(a), 6) AS accuracy, count(*) AS runs FROM (SELECT lower(trim(true_label)) AS label, experiment, avg(coalesce({_RIGHT}, false)::INT) AS a FROM {_LOG} GROUP BY 1, 2) GROUP BY label")
def label_accuracy(spark, d):
    p = _log(spark, d).withColumn("label", F.lower(F.trim("true_label")))
    right = F.coalesce(F.expr(_RIGHT), F.lit(False)).cast("int")
    return A.label_accuracy(p, "label", "experiment", right).withColumn("accuracy", F.round("accuracy", 6))


@register("stability_classes", f"SELECT class, count(*) AS n FROM (SELECT test_index, CASE WHEN sum((NOT coalesce({_RIGHT}, false))::INT) = 0 THEN 'always_right' WHEN sum((NOT coalesce({_RIGHT}, false))::INT) = count(*) THEN 'always_wrong' ELSE 'unstable' END AS class FROM {_LOG} GROUP BY test_index) GROUP BY class")
def stability_classes(spark, d):
    return A.count_by(A.stability(_log(spark, d), "test_index", ~F.coalesce(F.expr(_RIGHT), F.lit(False))), "class")


@register("modal_predictions", f"SELECT test_index, prediction FROM (SELECT test_index, prediction, row_number() OVER (PARTITION BY test_index ORDER BY count(*) DESC, prediction) AS r FROM (SELECT test_index, lower(trim(prediction)) AS prediction FROM {_LOG} WHERE prediction IS NOT NULL) GROUP BY test_index, prediction) WHERE r = 1")
def modal_predictions(spark, d):
    return A.modal(_log(spark, d).select("test_index", F.lower(F.trim("prediction")).alias("prediction")), "test_index", "prediction")


@register("feature_enrichment", """
    WITH f AS (SELECT coalesce(split, '') = 'train' AS g, coalesce(regexp_matches(query, '\\?'), false)::INT AS question, coalesce(regexp_matches(query, '[0-9]'), false)::INT AS digit FROM contrastive),
    r AS (SELECT 'question' AS feature, avg(question) FILTER (g) AS inside, avg(question) FILTER (NOT g) AS outside FROM f UNION ALL SELECT 'digit', avg(digit) FILTER (g), avg(digit) FILTER (NOT g) FROM f)
    SELECT feature, round(inside, 6) AS inside, round(outside, 6) AS outside, round(inside - outside, 6) AS delta FROM r""")
def feature_enrichment(spark, d):
    c = _t(spark, d, "contrastive").select((F.coalesce("split", F.lit("")) == "train").alias("g"), F.coalesce(F.col("query").rlike(r"\?"), F.lit(False)).cast("int").alias("question"), F.coalesce(F.col("query").rlike("[0-9]"), F.lit(False)).cast("int").alias("digit"))
    e = A.enrichment(c, F.col("g"), ["question", "digit"])
    return e.select("feature", *[F.round(x, 6).alias(x) for x in ("inside", "outside", "delta")])


@register("distinct_texts", f"SELECT count(DISTINCT {Q.audit('text')}) AS texts, count(DISTINCT {Q.source()}) AS sources FROM documents")
def distinct_texts(spark, d):
    return A.distinct_counts(_t(spark, d, "documents").select(X.audit_normal("text").alias("texts"), canonical_name("source").alias("sources")), "texts", "sources")


@register("anchor_from_pairs", """
    WITH p AS (SELECT * FROM pair_score WHERE score IS NOT NULL AND NOT isnan(score) AND sentence1 IS NOT NULL)
    SELECT sentence1, arg_max(sentence2, pos) FILTER (score >= 0.5 AND sentence2 IS NOT NULL) AS positive, count(*) FILTER (score < 0.5 AND sentence2 IS NOT NULL) AS n_negatives FROM p GROUP BY sentence1 HAVING count(*) FILTER (score >= 0.5 AND sentence2 IS NOT NULL) > 0""")
def anchor_from_pairs(spark, d):
    p = _t(spark, d, "pair_score").where("sentence1 IS NOT NULL AND sentence2 IS NOT NULL")
    return A.anchors(p, "sentence1", "pos", "sentence2", "score").select("sentence1", "positive", F.size("negatives").cast("bigint").alias("n_negatives"))


@register("apportion_quota", f"""
    WITH c AS (SELECT {_LABEL} AS label, count(*) AS n FROM labeled_text WHERE {_LABEL} IS NOT NULL GROUP BY 1), e AS (SELECT label, n::DOUBLE / sum(n) OVER () * 500 AS e FROM c), f AS (SELECT *, floor(e) AS f, 500 - sum(floor(e)) OVER () AS rest FROM e)
    SELECT label, (f + (row_number() OVER (ORDER BY round(e - f, 9) DESC, label) <= rest)::INT)::BIGINT AS quota FROM f""")
def apportion_quota(spark, d):
    label = F.regexp_replace(F.lower(F.trim("label")), " ", "_")
    n = A.count_by(_t(spark, d, "labeled_text").select(F.when(label != "", label).alias("label")).where("label IS NOT NULL"), "label")
    return A.apportion(n, "label", "n", 500)


@register("order_line_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1, 2")
def order_line_rollup(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))
