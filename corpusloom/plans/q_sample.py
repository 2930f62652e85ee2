"""Queries over sampling (W), orders (O) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.names import canonical_name
from corpusloom.operators import aggregates as A
from corpusloom.operators import sampling as W
from corpusloom.operators import sets as U
from corpusloom.plans import sqltext as Q
from corpusloom.plans.catalog import register
from corpusloom.session import prepare, table


def _t(spark, d, name):
    return table(prepare(spark), d, name)


def _orders(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")


@register("seeded_shuffle", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) - 1 AS rank FROM orders")
def seeded_shuffle(spark, d):
    return W.shuffled(_orders(spark, d).select("o_orderkey"), "o_orderkey", 7)


@register("seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 400")
def seeded_sample(spark, d):
    return W.sample(_orders(spark, d).select("o_orderkey"), "o_orderkey", 400, 7, exact=True)


@register("sample_with_repetition", """
    WITH n AS (SELECT count(*) AS n FROM supplier), e AS (SELECT s_suppkey, unnest(range(0, (SELECT ceil(4 * n / n)::INT FROM n))) AS epoch FROM supplier),
    r AS (SELECT s_suppkey, epoch::INT AS epoch, epoch * (SELECT n FROM n) + row_number() OVER (PARTITION BY epoch ORDER BY md5('3|' || epoch || '|' || s_suppkey), s_suppkey) - 1 AS draw FROM e)
    SELECT s_suppkey, epoch, draw FROM r WHERE draw < (SELECT (7 * n) // 2 FROM n)""")
def sample_with_repetition(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey")
    return W.repeated(s, "s_suppkey", 7 * s.count() // 2, 3)


@register("sample_with_replacement", """
    WITH n AS (SELECT count(*) AS n FROM supplier), r AS (SELECT s_suppkey, row_number() OVER (ORDER BY md5('3|' || s_suppkey), s_suppkey) - 1 AS i FROM supplier),
    g AS (SELECT unnest(range(0, 200)) AS draw), p AS (SELECT draw, ('0x' || substring(md5('3|' || draw), 1, 12))::BIGINT % (SELECT n FROM n) AS i FROM g) SELECT draw, s_suppkey FROM p JOIN r USING (i)""")
def sample_with_replacement(spark, d):
    return W.with_replacement(_t(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 200, 3)


@register("complement_split", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r > 400")
def complement_split(spark, d):
    return W.complement(_orders(spark, d).select("o_orderkey"), "o_orderkey", 400, 7)


@register("stratified_split", f"""
    WITH s AS (SELECT pos, {Q.source()} AS source, coalesce(objective, 'contrastive') AS objective FROM contrastive), r AS (SELECT *, row_number() OVER (PARTITION BY source, objective ORDER BY md5('11|' || pos), pos) AS r, count(*) OVER (PARTITION BY source, objective) AS n FROM s)
    SELECT pos, CASE WHEN r <= (CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.1::DOUBLE, 0)) ELSE 0 END) THEN 'validation' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, d):
    c = _t(spark, d, "contrastive").select("pos", canonical_name("source").alias("source"), F.coalesce("objective", F.lit("contrastive")).alias("objective"))
    return W.stratified_split(c, "pos", ["source", "objective"], 0.1, 11).select("pos", "part")


@register("per_group_cap", "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('2|' || o_orderkey), o_orderkey) <= 50")
def per_group_cap(spark, d):
    return W.per_group(_orders(spark, d).select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 50, 2)


@register("even_quota", "WITH g AS (SELECT DISTINCT n_name FROM nation) SELECT n_name, (1003 // count(*) OVER () + (row_number() OVER (ORDER BY n_name) <= 1003 % count(*) OVER ())::INT)::BIGINT AS quota FROM g")
def even_quota(spark, d):
    return W.even_quota(_t(spark, d, "nation"), "n_name", 1003)


@register("quality_pick", """
    WITH a AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('4|' || o_orderkey), o_orderkey) AS q FROM a WHERE r <= 80)
    SELECT o_orderkey, o_orderpriority FROM b WHERE q <= 20""")
def quality_pick(spark, d):
    return W.quality_pick(_orders(spark, d), "o_orderkey", "o_orderpriority", [F.desc("o_totalprice")], 20, 4).select("o_orderkey", "o_orderpriority")


@register("need_selection")
def need_selection(spark, d):
    """A choice row by row: tested against a plain loop."""
    m = _t(spark, d, "contrastive").select("pos", F.array_compact(F.array(canonical_name("source"), F.col("split"))).alias("labels"))
    return W.need_selection(m, "pos", "labels", {"train": 60, "test": 20, "it_forum_qa": 20, "news_wire": 10}, 100, 5, 1.1).select("pos")


_SCARCE = {"train": 40, "it_forum_qa": 30, "soc_chat": 10}
_PICK = lambda g, gone: f"(SELECT pos, '{g}' AS g FROM l WHERE list_contains(labels, '{g}') {gone} ORDER BY md5('3|{g}|' || pos), pos LIMIT {_SCARCE[g]})"


@register("scarce_first", f"""
    WITH l AS (SELECT pos, [{Q.source()}, split] AS labels FROM contrastive), n AS (SELECT unnest(labels) AS g, count(*) AS n FROM l GROUP BY 1), a AS {_PICK("soc_chat", "")}, b AS {_PICK("it_forum_qa", "AND pos NOT IN (SELECT pos FROM a)")}, c AS {_PICK("train", "AND pos NOT IN (SELECT pos FROM a UNION ALL SELECT pos FROM b)")}
    SELECT g AS "group", pos FROM a UNION ALL SELECT g, pos FROM b UNION ALL SELECT g, pos FROM c""")
def scarce_first(spark, d):
    m = _t(spark, d, "contrastive").select("pos", F.array_compact(F.array(canonical_name("source"), F.col("split"))).alias("labels"))
    return W.scarce_first(m, "pos", "labels", _SCARCE, 3, exact=False)


@register("coverage_support", f"WITH l AS (SELECT pos, unnest(list_distinct([{Q.source()}, split])) AS g FROM contrastive) SELECT DISTINCT pos FROM (SELECT pos, row_number() OVER (PARTITION BY g ORDER BY md5('5|' || pos), pos) AS r FROM l WHERE g IS NOT NULL) WHERE r <= 3")
def coverage_support(spark, d):
    m = _t(spark, d, "contrastive").select("pos", F.array_compact(F.array(canonical_name("source"), F.col("split"))).alias("labels"))
    return W.coverage_support(m, "pos", "labels", 3, 5).select("pos")


@register("round_robin_anchors", "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('6|' || vec_id), vec_id) - 1 AS turn FROM embeddings WHERE label IS NOT NULL ORDER BY turn, label LIMIT 100")
def round_robin_anchors(spark, d):
    return W.round_robin(_t(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 6, 100)


_BUCKET = "CASE WHEN score BETWEEN 0 AND 0.1 THEN 'a_low' WHEN score > 0.2 AND score < 0.7 THEN 'b_mid' WHEN score >= 0.85 AND score <= 1 THEN 'c_high' END"


@register("bucket_ladder", f"SELECT pos, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5('8|' || pos), pos) - 1 AS turn FROM (SELECT pos, {_BUCKET} AS bucket FROM pair_score WHERE NOT isnan(score)) WHERE bucket IS NOT NULL")
def bucket_ladder(spark, d):
    p = _t(spark, d, "pair_score").where("NOT isnan(score)").select("pos", F.expr(_BUCKET).alias("bucket"))
    return W.round_robin(p, "pos", "bucket", 8)


@register("zscore_rank01", """
    WITH p AS (SELECT o_orderkey, o_orderpriority AS g, o_totalprice AS x FROM orders), z AS (SELECT *, avg(x) OVER (PARTITION BY g) AS m, stddev_pop(x) OVER (PARTITION BY g) AS s, row_number() OVER (PARTITION BY g ORDER BY x, o_orderkey) AS r, count(*) OVER (PARTITION BY g) AS n FROM p)
    SELECT o_orderkey, round(CASE WHEN s > 1e-12 THEN (x - m) / s ELSE 0 END, 6) AS zscore, round((r - 1)::DOUBLE / (n - 1), 6) AS rank01 FROM z""")
def zscore_rank01(spark, d):
    o = W.rank01(W.zscore(_orders(spark, d), "o_totalprice", "o_orderpriority"), "o_totalprice", "o_orderkey", "o_orderpriority")
    return o.select("o_orderkey", F.round("zscore", 6).alias("zscore"), F.round("rank01", 6).alias("rank01"))


@register("worst_per_bucket", "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY abs(o_totalprice - 150000) DESC, o_orderkey) <= 10")
def worst_per_bucket(spark, d):
    return W.worst_per_bucket(_orders(spark, d), "o_orderkey", "o_orderpriority", F.col("o_totalprice") - 150000, 10).select("o_orderkey", "o_orderpriority")


@register("scan_quota", f"SELECT pos, source FROM (SELECT pos, {Q.source()} AS source FROM contrastive) WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos) <= 5")
def scan_quota(spark, d):
    return W.scan_quota(_t(spark, d, "contrastive").select("pos", canonical_name("source").alias("source")), "pos", "source", 5)


@register("wraparound_draw", """
    WITH n AS (SELECT count(*) AS n FROM nation), e AS (SELECT n_nationkey, unnest(range(0, 5)) AS epoch FROM nation),
    r AS (SELECT n_nationkey, epoch::INT AS epoch, epoch * (SELECT n FROM n) + row_number() OVER (PARTITION BY epoch ORDER BY md5('1|' || epoch || '|' || n_nationkey), n_nationkey) - 1 AS draw FROM e) SELECT * FROM r WHERE draw < 110""")
def wraparound_draw(spark, d):
    return W.repeated(_t(spark, d, "nation").select("n_nationkey"), "n_nationkey", 110, 1)


@register("cap_and_redistribute", """
    WITH p AS (SELECT o_orderpriority AS g, count(*) AS pool FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1), t AS (SELECT g, pool, ((SELECT sum(pool) FROM p) * rank() OVER (ORDER BY g) // 12)::BIGINT AS target FROM p),
    q AS (SELECT g, least(target, pool) AS q, pool - least(target, pool) AS room, least(sum(target) OVER (), sum(pool) OVER ()) - sum(least(target, pool)) OVER () AS missing FROM t),
    l AS (SELECT max(l) AS l FROM (SELECT unnest(range(0, (SELECT max(room) FROM q) + 1)) AS l) x WHERE (SELECT sum(least(room, x.l)) FROM q) <= (SELECT max(missing) FROM q)),
    r AS (SELECT g, q + least(room, l) AS q, room - least(room, l) AS more, missing - sum(least(room, l)) OVER () AS rest FROM q, l)
    SELECT g AS o_orderpriority, (q + (row_number() OVER (ORDER BY more DESC, g) <= rest)::INT)::BIGINT AS quota FROM r""")
def cap_and_redistribute(spark, d):
    """Unequal targets, some above the pool, which is counted over all rows."""
    n = A.count_by(_t(spark, d, "orders").where("o_orderpriority IS NOT NULL"), "o_orderpriority")
    every = n.agg(F.sum("n").alias("all"))
    t = n.join(F.broadcast(every)).withColumn("target", F.floor(F.col("all") * F.rank().over(Window.orderBy("o_orderpriority")) / 12))
    return A.cap_and_redistribute(t, "o_orderpriority", "target", "n")


@register("top_k_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k_global(spark, d):
    return W.top_k(_orders(spark, d).select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), "o_orderkey")


@register("top_k_per_key", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
def top_k_per_key(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return W.top_k_per_key(o, "o_custkey", 3, F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "place")


_PARTS = {"forum": ("it_forum_qa", 60), "wire": ("news_wire", 40)}


@register("mix_weighted", " UNION ALL ".join(f"(SELECT pos, '{n}' AS component FROM contrastive WHERE {Q.source()} = '{s}' ORDER BY md5('5|{n}|' || pos), pos LIMIT {k})" for n, (s, k) in _PARTS.items()))
def mix_weighted(spark, d):
    c = _t(spark, d, "contrastive").select("pos", canonical_name("source").alias("source"))
    return U.mix({n: (c.where(F.col("source") == s), k) for n, (s, k) in _PARTS.items()}, "pos", 5).select("pos", "component")


@register("leave_one_out", "SELECT l.o_orderpriority AS left_out, count(*) AS n FROM orders o, (SELECT DISTINCT o_orderpriority FROM orders) l WHERE o.o_orderpriority <> l.o_orderpriority GROUP BY 1")
def leave_one_out(spark, d):
    return U.leave_one_out(_orders(spark, d).select("o_orderpriority"), "o_orderpriority").groupBy("left_out").agg(F.count("*").alias("n"))


@register("ratio_sweep", "SELECT o_orderpriority, share, floor(n * share)::BIGINT AS n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), (SELECT unnest([0.1::DOUBLE, 0.25, 0.5]) AS share)")
def ratio_sweep(spark, d):
    return U.ratios(A.count_by(_orders(spark, d), "o_orderpriority"), "o_orderpriority", "n", [0.1, 0.25, 0.5])


@register("key_intersection", "SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer")
def key_intersection(spark, d):
    return U.common_keys(_t(spark, d, "orders").select(F.col("o_custkey").alias("key")), _t(spark, d, "customer").select(F.col("c_custkey").alias("key")), "key")


@register("key_differences", "SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer) b USING (k) WHERE a.k IS NULL OR b.k IS NULL")
def key_differences(spark, d):
    return U.key_differences(_t(spark, d, "orders").select(F.col("o_custkey").alias("key")), _t(spark, d, "customer").select(F.col("c_custkey").alias("key")), "key")


@register("union_all_tables", "SELECT 'query' AS field, count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT query AS text FROM contrastive UNION ALL SELECT text FROM labeled_text UNION ALL SELECT sentence1 FROM pair_score)")
def union_all_tables(spark, d):
    u = U.union_all(_t(spark, d, "contrastive").select(F.col("query").alias("text"), "pos"), _t(spark, d, "labeled_text").select("text"), _t(spark, d, "pair_score").select(F.col("sentence1").alias("text"), "pos"))
    return u.agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts")).select(F.lit("query").alias("field"), "n", "texts")


@register("except_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def except_keys(spark, d):
    return U.without(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
