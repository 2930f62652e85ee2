"""Queries over matching and decontamination (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrow
from corpusloom.functions import text as X
from corpusloom.functions.names import canonical_name
from corpusloom.operators import matching as M
from corpusloom.plans import sqltext as Q
from corpusloom.plans.catalog import register
from corpusloom.session import cut, prepare, table


def _t(spark, d, name):
    return table(prepare(spark), d, name)


def _docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.audit_normal("text").alias("key"))


def _items(spark, d):
    return _t(spark, d, "eval_passages").select("item_id", X.audit_normal("text").alias("key"))


@register("exact_match", f"WITH c AS (SELECT pos, split, {Q.audit('query')} AS key FROM contrastive), t AS (SELECT key, min(pos) AS first, count(*) AS n FROM c WHERE split = 'train' AND key <> '' GROUP BY key) SELECT pos, first, n FROM c JOIN t USING (key) WHERE split IN ('test', 'validation')")
def exact_match(spark, d):
    c = _t(spark, d, "contrastive").select("pos", "split", X.audit_normal("query").alias("key"))
    return M.matched(c.where("split IN ('test', 'validation')").select("pos", "key"), c.where("split = 'train'").select("pos", "key"), "pos", "key").select("pos", "first", "n")


@register("exact_copies", f"SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS first, count(*) OVER (PARTITION BY key) AS n FROM (SELECT doc_id, {Q.audit('text')} AS key FROM documents) WHERE key <> '' QUALIFY n > 1")
def exact_copies(spark, d):
    return M.copies(_docs(spark, d), "doc_id", "key")


@register("pair_match", f"SELECT pos, min(pos) OVER (PARTITION BY a, b) AS first, count(*) OVER (PARTITION BY a, b) AS n FROM (SELECT pos, least({Q.alnum('sentence1')}, {Q.alnum('sentence2')}) AS a, greatest({Q.alnum('sentence1')}, {Q.alnum('sentence2')}) AS b FROM pair_score WHERE sentence1 IS NOT NULL AND sentence2 IS NOT NULL) QUALIFY n > 1")
def pair_match(spark, d):
    from corpusloom.operators.dedup import unordered_key

    k = _t(spark, d, "pair_score").select("pos", F.array_join(unordered_key(X.alnum_key("sentence1"), X.alnum_key("sentence2")), "\u0001").alias("key"))
    return M.copies(k, "pos", "key")


@register("decontam_exact", f"""
    WITH e AS (SELECT {Q.audit('query')} AS k FROM contrastive WHERE split IN ('test', 'validation') UNION SELECT {Q.audit('positive')} FROM contrastive WHERE split IN ('test', 'validation')), k AS (SELECT k FROM e WHERE k <> '')
    SELECT pos FROM (SELECT pos, {Q.audit('query')} AS q, {Q.audit('positive')} AS p FROM contrastive WHERE split = 'train') t WHERE (coalesce(q, '') <> '' OR coalesce(p, '') <> '') AND NOT coalesce(q, '') IN (SELECT k FROM k) AND NOT coalesce(p, '') IN (SELECT k FROM k)""")
def decontam_exact(spark, d):
    c = _t(spark, d, "contrastive").select("pos", "split", X.audit_normal("query").alias("q"), X.audit_normal("positive").alias("p"))
    keys = M.keys_of(c.where("split IN ('test', 'validation')"), "q", "p")
    return M.decontaminate(c.where("split = 'train'"), "pos", [F.col("q"), F.col("p")], keys).select("pos")


_NEEDLES = lambda x: f"[CASE WHEN length({Q.audit(x)}) >= 80 THEN 'e:' || {Q.audit(x)} END, CASE WHEN length({Q.audit(x)}) >= 220 THEN 'p:' || substring({Q.audit(x)}, 1, 220) END, CASE WHEN length({Q.audit(f'string_split({x}, {chr(39)}.{chr(39)})[1]')}) >= 30 THEN 't:' || {Q.audit(f'string_split({x}, {chr(39)}.{chr(39)})[1]')} END]"


@register("decontam_needles", f"WITH n AS (SELECT DISTINCT unnest({_NEEDLES('text')}) AS n FROM eval_passages), d AS (SELECT doc_id, unnest({_NEEDLES('text')}) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d JOIN n USING (n))")
def decontam_needles(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    keys = _t(spark, d, "eval_passages").select(F.explode(M.needles("text")).alias("key")).distinct()
    return docs.select("doc_id").join(M.hit_by(docs, "doc_id", M.needles("text"), keys), "doc_id", "left_anti")


@register("decontam_line_blocks")
def decontam_line_blocks(spark, d):
    """Blocks of lines, their beginnings and what follows an abstract marker against whole passages, their beginnings and titles; tested against a plain loop."""
    docs = _t(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL")
    keys = _t(spark, d, "eval_passages").where("text IS NOT NULL").select(F.explode(M.passage_keys("text")).alias("key")).distinct()
    return docs.select("doc_id").join(M.hit_by(docs, "doc_id", M.block_keys("text"), keys), "doc_id", "left_anti")


_DOC, _ITEM = f"(SELECT doc_id, lang, {Q.audit('text')} AS k FROM documents)", f"(SELECT item_id, {Q.audit('text')} AS k FROM eval_passages)"


@register("containment_match", f"SELECT DISTINCT d.doc_id, e.item_id FROM {_DOC} d JOIN {_ITEM} e ON contains(d.k, e.k) WHERE length(e.k) >= 80 AND length(d.k) <> length(e.k)")
def containment_match(spark, d):
    """Either way: also documents inside a passage, which the SQL leaves out; the given tables have none."""
    docs, items = cut(_docs(spark, d), "docs"), _items(spark, d)
    return M.containment(docs, "doc_id", "key", items, "item_id", "key", 80).unionByName(_inside(docs, items)).distinct()


def _inside(docs, items):
    """(doc_id, item_id) of the documents that lie inside a passage."""
    return M.contained(docs.select(F.col("doc_id").alias("a_id"), F.col("key").alias("text")), items.select(F.col("item_id").alias("b_id"), F.col("key").alias("text")), 80).toDF("doc_id", "item_id")


@register("leak_by_language", f"""
    WITH h AS (SELECT DISTINCT d.doc_id FROM {_DOC} d JOIN {_ITEM} e ON contains(d.k, e.k) WHERE length(e.k) >= 80)
    SELECT coalesce(lang, 'none') AS lang, count(*) AS documents, count(h.doc_id) AS leaked, count(*) - count(h.doc_id) AS clean FROM documents LEFT JOIN h USING (doc_id) GROUP BY 1""")
def leak_by_language(spark, d):
    """Containment either way, as in ``containment_match``."""
    docs, items = cut(_docs(spark, d), "docs"), _items(spark, d)
    equal = M.exact(docs, items.where(F.length("key") >= 80), "key").select("doc_id")
    hit = M.containment(docs, "doc_id", "key", items, "item_id", "key", 80).unionByName(_inside(docs, items)).select("doc_id").unionByName(equal).distinct().withColumn("hit", F.lit(1))
    j = _t(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang")).join(hit, "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("documents"), F.count("hit").alias("leaked"), F.count_if(F.col("hit").isNull()).alias("clean"))


@register("lexical_near_match", f"""
    WITH a AS (SELECT pos AS a_id, list_distinct({Q.words(Q.audit('query'))}) AS w FROM contrastive WHERE split IN ('test', 'validation')), b AS (SELECT pos AS b_id, list_distinct({Q.words(Q.audit('query'))}) AS w FROM contrastive WHERE split = 'train'),
    p AS (SELECT a_id, b_id, len(list_intersect(a.w, b.w)) AS shared, len(a.w) + len(b.w) AS n FROM a, b WHERE len(a.w) >= 4 AND len(b.w) >= 4 AND len(a.w) <= 1.3 * len(b.w) AND len(b.w) <= 1.3 * len(a.w))
    SELECT a_id, b_id, shared::BIGINT AS shared, round(shared::DOUBLE / (n - shared), 6) AS sim FROM p WHERE shared::DOUBLE / (n - shared) >= 0.78""")
def lexical_near_match(spark, d):
    c = _t(spark, d, "contrastive").select("pos", "split", X.token_set("query").alias("words")).where("words IS NOT NULL")
    a, b = c.where("split IN ('test', 'validation')").withColumnRenamed("pos", "a_id"), c.where("split = 'train'").withColumnRenamed("pos", "b_id")
    return M.jaccard_pairs(a, b, 0.78, least=4).select("a_id", "b_id", F.col("shared").cast("bigint").alias("shared"), F.round("sim", 6).alias("sim"))


@register("lexical_near_refined")
def lexical_near_refined(spark, d):
    """``lexical_near_match`` with the second condition of J7; the ratios are Python's: tested against a plain loop."""
    c = _t(spark, d, "contrastive").select("pos", "split", X.audit_normal("query").alias("key")).where("key != ''")
    a, b = (c.where(cond).select(F.col("pos").alias(f"{n}_id"), F.col("key").alias(f"{n}_text")) for n, cond in (("a", "split IN ('test', 'validation')"), ("b", "split = 'train'")))
    words = lambda x, n: x.select(f"{n}_id", X.token_set(f"{n}_text").alias("words")).where("words IS NOT NULL")
    pairs = M.jaccard_pairs(words(a, "a"), words(b, "b"), 0.78, least=4)
    return M.refined(pairs, a, b).select("a_id", "b_id", *[F.round(x, 6).alias(x) for x in ("sim", "token_set", "partial")])


@register("near_dup_anti")
def near_dup_anti(spark, d):
    """Training rows without an evaluation row of Jaccard 0.78 and edit ratio 0.9; the edit ratio is Python's: rows only."""
    c = _t(spark, d, "contrastive").select("pos", "split", X.audit_normal("query").alias("key")).where("key != ''")
    words = c.select("pos", "split", X.token_set("key").alias("words"))
    pairs = M.jaccard_pairs(words.where("split = 'train'").withColumnRenamed("pos", "a_id"), words.where("split != 'train'").withColumnRenamed("pos", "b_id"), 0.78, least=4)
    text = lambda n: c.select(F.col("pos").alias(f"{n}_id"), F.col("key").alias(f"{n}_key"))
    near = pairs.join(text("a"), "a_id").join(text("b"), "b_id").where(arrow.edit_ratio("a_key", "b_key") >= 0.9).select(F.col("a_id").alias("pos")).distinct()
    exact = c.where("split = 'train'").join(c.where("split != 'train'").select("key").distinct(), "key", "left_semi").select("pos")
    return M.without_flagged(c.where("split = 'train'"), near.unionByName(exact), "pos").select("pos")


@register("flag_anti", "SELECT pos FROM contrastive WHERE pos NOT IN (SELECT pos FROM review_labels WHERE category <> 'none' AND pos IS NOT NULL)")
def flag_anti(spark, d):
    return M.without_flagged(_t(spark, d, "contrastive"), _t(spark, d, "review_labels").where("category <> 'none'"), "pos").select("pos")


@register("qrels_join", "SELECT l_orderkey, l_partkey, l_linenumber, o_orderpriority, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
def qrels_join(spark, d):
    qrels = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    queries = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    corpus = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return M.by_qrels(queries, qrels, corpus, "l_orderkey", "l_partkey").select("l_orderkey", "l_partkey", "l_linenumber", "o_orderpriority", "p_brand")


@register("taxonomy_lookup", "SELECT coalesce(r_name, 'none') AS region, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def taxonomy_lookup(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    c = M.lookup(M.lookup(_t(spark, d, "customer").select("c_nationkey"), n, "c_nationkey"), _t(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey")
    return c.groupBy(F.coalesce("r_name", F.lit("none")).alias("region")).agg(F.count("*").alias("n"))


@register("contaminated_tasks", """
    WITH d AS (SELECT unnest(datasets) AS d FROM manifest), u AS (SELECT d.id AS id, d.contaminates_rumteb_tasks AS t FROM d WHERE NOT coalesce(len(d.usage) > 0 AND len(list_filter(d.usage, lambda x: x <> 'diagnostic_only')) = 0, false))
    SELECT task, array_to_string(list_sort(list_distinct(list(id))), ',') AS datasets FROM (SELECT id, unnest(t) AS task FROM u) WHERE task IS NOT NULL GROUP BY task""")
def contaminated_tasks(spark, d):
    return M.contaminated_tasks(_t(spark, d, "manifest")).select("task", F.array_join("datasets", ",").alias("datasets"))


@register("local_vs_official", """
    WITH a AS (SELECT true_label AS label, avg(correct::INT) FILTER (model = (SELECT min(model) FROM prediction_log)) AS l, avg(correct::INT) FILTER (model = (SELECT max(model) FROM prediction_log)) AS r FROM prediction_log GROUP BY 1)
    SELECT label, round(l, 6) AS left, round(r, 6) AS right, round(l - r, 6) AS delta FROM a WHERE l IS NOT NULL AND r IS NOT NULL""")
def local_vs_official(spark, d):
    p = _t(spark, d, "prediction_log").where("correct IS NOT NULL").select("model", F.col("true_label").alias("label"), F.col("correct").cast("int").alias("c"))
    ends = p.agg(F.min("model").alias("low"), F.max("model").alias("high"))
    j = p.join(F.broadcast(ends))
    side = lambda end: j.where(F.col("model") == F.col(end)).groupBy("label").agg(F.avg("c").alias("score"))
    c = M.compared(side("low"), side("high"), "label", "score")
    return c.select("label", *[F.round(x, 6).alias(x) for x in ("left", "right", "delta")])


@register("label_overlap_pairs", """
    WITH t AS (SELECT d.d.id AS id, unnest(list_distinct(d.d.coverage_tags)) AS tag FROM (SELECT unnest(datasets) AS d FROM manifest) d), u AS (SELECT DISTINCT id, tag FROM t WHERE tag IS NOT NULL AND id IS NOT NULL)
    SELECT x.id AS a, y.id AS b, count(*) AS shared FROM u x JOIN u y USING (tag) WHERE x.id < y.id GROUP BY 1, 2""")
def label_overlap_pairs(spark, d):
    each = _t(spark, d, "manifest").select(F.explode("datasets").alias("d")).select("d.id", F.explode("d.coverage_tags").alias("tag")).where("tag IS NOT NULL AND id IS NOT NULL")
    return M.sharing_labels(each.groupBy("id").agg(F.collect_set("tag").alias("tags")), "id", "tags")


_LABELS = "(SELECT label AS l, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS no, count(*) OVER () AS m FROM embeddings WHERE label IS NOT NULL GROUP BY label)"
_NUMBER = lambda x: f"('0x' || substring(md5({x}), 1, 8))::BIGINT"


@register("one_negative_per_label", f"""
    WITH u AS (SELECT vec_id AS other_key, label AS l, row_number() OVER (PARTITION BY label ORDER BY md5('5|' || vec_id), vec_id) - 1 AS i FROM embeddings WHERE label IS NOT NULL),
    a AS (SELECT vec_id, (no + 1 + ({_NUMBER("'5|' || vec_id")} + d) % (m - 1)) % m AS no FROM embeddings e JOIN {_LABELS} s ON e.label = s.l, (SELECT unnest([0, 1, 2]) AS d)),
    b AS (SELECT vec_id, l, {_NUMBER("'5|' || l || '|' || vec_id")} % n AS i FROM a JOIN {_LABELS} USING (no)) SELECT vec_id, l AS other_label, other_key FROM b JOIN u USING (l, i)""")
def one_negative_per_label(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "label")
    return M.one_per_other_label(e, e, "vec_id", "label", 5, most=3)


@register("positional_pairing", """
    WITH n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label IS NOT NULL)
    SELECT a.vec_id, a.label, b.vec_id AS partner FROM n a JOIN n b ON a.label = b.label AND (a.i + 17) % a.n = b.i WHERE a.vec_id <> b.vec_id""")
def positional_pairing(spark, d):
    return M.positional_pairs(_t(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 17)


_NAMES = "(SELECT l, row_number() OVER (ORDER BY l) - 1 AS no, count(*) OVER () AS m FROM (SELECT DISTINCT label::VARCHAR AS l FROM embeddings WHERE label IS NOT NULL))"


@register("label_statements", f"""
    WITH o AS (SELECT vec_id, l, no, m FROM embeddings e JOIN {_NAMES} n ON e.label::VARCHAR = n.l), f AS (SELECT vec_id, (no + 1 + ({_NUMBER("'3|' || vec_id")} + d) % (m - 1)) % m AS no FROM o, (SELECT unnest([0, 1]) AS d))
    SELECT vec_id, 'class ' || l AS statement, 1 AS target FROM o UNION ALL SELECT vec_id, 'class ' || l, 0 FROM f JOIN {_NAMES} USING (no)""")
def label_statements(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    return M.label_statements(e, "vec_id", "label", e.select("label"), "class %s", 3)


@register("confusable_negatives", """
    WITH e AS (SELECT vec_id, label FROM embeddings), g AS (SELECT DISTINCT label, (label + 1) % 10 AS other FROM e UNION SELECT DISTINCT label, (label + 2) % 10 FROM e), s AS (SELECT label AS other, count(*) AS n FROM e GROUP BY 1),
    u AS (SELECT vec_id AS negative, label AS other, row_number() OVER (PARTITION BY label ORDER BY md5('9|' || vec_id), vec_id) - 1 AS i FROM e),
    w AS (SELECT vec_id, other, row_number() OVER (PARTITION BY vec_id ORDER BY md5('9|' || vec_id || '|' || other), other) AS r, ('0x' || substring(md5('9|' || other || '|' || vec_id), 1, 8))::BIGINT % n AS i FROM e JOIN g USING (label) JOIN s USING (other))
    SELECT vec_id, negative FROM w JOIN u USING (other, i) WHERE r <= 1""")
def confusable_negatives(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "label")
    edges = e.select("label").distinct().select("label", F.explode(F.array((F.col("label") + 1) % 10, (F.col("label") + 2) % 10)).alias("other"))
    return M.confusable_negatives(e, "vec_id", "label", edges, 9)


@register("audit_verdict", f"""
    WITH c AS (SELECT {Q.source()} AS source, split, {Q.audit('query')} AS k FROM contrastive), e AS (SELECT DISTINCT k FROM c WHERE split <> 'train' AND k <> '')
    SELECT source, count(*) AS n, count(e.k) AS exact, CASE WHEN count(e.k) > 0 THEN 'contaminated' ELSE 'clean' END AS verdict FROM (SELECT * FROM c WHERE split = 'train') t LEFT JOIN e ON t.k = e.k GROUP BY source""")
def audit_verdict(spark, d):
    """By exact hits only, as its SQL has it; ``audit_verdict_near`` counts containment and near matches too."""
    c = _t(spark, d, "contrastive").select(canonical_name("source").alias("source"), "split", X.audit_normal("query").alias("key"))
    keys = c.where("split <> 'train' AND key <> ''").select("key").distinct().withColumn("hit", F.lit(1))
    n = c.where("split = 'train'").join(keys, "key", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("hit").alias("exact"))
    return n.withColumn("verdict", M.verdict(F.col("exact"), F.lit(0), F.lit(0)))


@register("audit_verdict_near", f"""
    WITH c AS (SELECT pos, {Q.source()} AS source, split, {Q.audit('query')} AS k, list_distinct({Q.words(Q.audit('query'))}) AS w FROM contrastive), t AS (SELECT * FROM c WHERE split = 'train'), e AS (SELECT DISTINCT k, w FROM c WHERE split <> 'train' AND k <> ''),
    x AS (SELECT DISTINCT k, 1 AS hit FROM e), i AS (SELECT DISTINCT pos, 1 AS hit FROM t JOIN e ON contains(t.k, e.k) OR contains(e.k, t.k) WHERE length(t.k) >= 80 AND length(e.k) >= 80 AND t.k <> e.k),
    p AS (SELECT pos, len(list_intersect(t.w, e.w)) AS shared, len(t.w) + len(e.w) AS n FROM t, e WHERE len(t.w) >= 4 AND len(e.w) >= 4 AND len(t.w) <= 1.3 * len(e.w) AND len(e.w) <= 1.3 * len(t.w)), j AS (SELECT DISTINCT pos, 1 AS hit FROM p WHERE shared::DOUBLE / (n - shared) >= 0.78),
    s AS (SELECT source, count(*) AS n, count(x.hit) AS exact, count(i.hit) AS contained, count(j.hit) AS lexical FROM t LEFT JOIN x USING (k) LEFT JOIN i USING (pos) LEFT JOIN j USING (pos) GROUP BY source)
    SELECT *, CASE WHEN exact + contained > 0 THEN 'contaminated' WHEN lexical > 0 THEN 'near_duplicates' ELSE 'clean' END AS verdict FROM s""")
def audit_verdict_near(spark, d):
    """The whole audit: training rows with an equal evaluation text, one inside the other, or a near match in words; an equal text is a near match too."""
    c = _t(spark, d, "contrastive").select("pos", canonical_name("source").alias("source"), "split", X.audit_normal("query").alias("text"))
    train, held = c.where("split = 'train'"), c.where("split <> 'train' AND text <> ''")
    a, b = train.select(F.col("pos").alias("a_id"), "text"), held.groupBy("text").agg(F.min("pos").alias("b_id"))
    exact = a.join(b, "text", "left_semi").select("a_id")
    swapped = M.contained(b.select(F.col("b_id").alias("a_id"), "text"), a.select(F.col("a_id").alias("b_id"), "text"), 80).select(F.col("b_id").alias("a_id"))
    inside = M.contained(a, b, 80).select("a_id").unionByName(swapped)
    words = lambda x, i: x.select(i, X.token_set("text").alias("words")).where("words IS NOT NULL")
    near = M.jaccard_pairs(words(a, "a_id"), words(b, "b_id"), 0.78, least=4).select("a_id")
    kinds = exact.select("a_id", F.lit("exact").alias("kind")).unionByName(inside.select("a_id", F.lit("contained").alias("kind"))).unionByName(near.select("a_id", F.lit("lexical").alias("kind")))
    found = kinds.groupBy(F.col("a_id").alias("pos")).agg(*[F.max(F.when(F.col("kind") == k, 1)).alias(k) for k in ("exact", "contained", "lexical")])
    n = train.select("pos", "source").join(found, "pos", "left").groupBy("source").agg(F.count("*").alias("n"), *[F.count(k).alias(k) for k in ("exact", "contained", "lexical")])
    return n.withColumn("verdict", M.verdict(F.col("exact"), F.col("contained"), F.col("lexical")))


@register("sampled_lexical_negatives", f"""
    WITH r AS (SELECT item_id, task, list_distinct({Q.words(Q.audit('text'))}) AS w FROM eval_passages), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY task ORDER BY md5('3|' || item_id), item_id) <= 20),
    j AS (SELECT r.item_id, f.item_id AS other, len(list_intersect(r.w, f.w))::DOUBLE / (len(r.w) + len(f.w) - len(list_intersect(r.w, f.w))) AS sim FROM r JOIN f ON r.task = f.task AND r.item_id <> f.item_id)
    SELECT item_id, other, round(sim, 6) AS sim FROM j QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, other) <= 1""")
def sampled_lexical_negatives(spark, d):
    r = _t(spark, d, "eval_passages").select("item_id", "task", X.token_set("text").alias("w"))
    return M.sampled_lexical(r, r, "item_id", "task", "w", 3, sample=20, same=True).select("item_id", "other", F.round("sim", 6).alias("sim"))


_TRIGGER = """WITH r AS (SELECT o_orderkey AS k, o_orderpriority AS g, o_orderstatus = 'F' AS e FROM orders WHERE o_orderpriority IS NOT NULL), s AS (SELECT g, count(*) FILTER (e) AS n, count(*) FILTER (NOT e) AS m, row_number() OVER (ORDER BY g) - 1 AS no FROM r GROUP BY g),
    p AS (SELECT no, e, k, row_number() OVER (PARTITION BY g, e ORDER BY md5('7|' || k), k) - 1 AS at FROM r JOIN s USING (g)), i AS (SELECT g, no AS own, unnest(range(0, 40)) AS i FROM s), c AS (SELECT count(*) AS c FROM s),
    w AS (SELECT g, i, 'query' AS role, 0 AS s, 0 AS j, own AS no, i AS p, true AS e FROM i UNION ALL SELECT g, i, 'positive', 1, j, (own + 1 + (i * 3 + j) % (c - 1)) % c, (i * 3 + j) // (c - 1), true FROM i, c, (SELECT unnest(range(0, 3)) AS j)
      UNION ALL SELECT g, i, 'negative', 0, j, own, i * 5 + j, false FROM i, (SELECT unnest(range(0, 3)) AS j) UNION ALL SELECT g, i, 'negative', 1, j, (own + 1 + (i * 5 + j) % (c - 1)) % c, (i * 5 + j) // (c - 1), false FROM i, c, (SELECT unnest(range(0, 2)) AS j)),
    z AS (SELECT w.*, p.k FROM w JOIN s USING (no) JOIN p ON p.no = w.no AND p.e = w.e AND p.at = w.p % (CASE WHEN w.e THEN s.n ELSE s.m END))
    SELECT g AS o_orderpriority, i::INT AS i, max(k) FILTER (role = 'query') AS query, string_agg(k::VARCHAR, ',' ORDER BY s, j) FILTER (role = 'positive') AS positives, string_agg(k::VARCHAR, ',' ORDER BY s, j) FILTER (role = 'negative') AS negatives FROM z GROUP BY g, i"""


@register("trigger_records", _TRIGGER.replace("SELECT w.*, p.k FROM w JOIN s USING (no)", "SELECT w.g, w.i, w.role, w.s, w.j, p.k FROM w JOIN s ON s.no = w.no"))
def trigger_records(spark, d):
    """Finished orders stand for neutral rows, the priority for the trigger."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    r = M.trigger_records(o, "o_orderkey", "o_orderpriority", F.col("o_orderstatus") == "F", 40, 3, 5, 7)
    return r.select("o_orderpriority", "i", "query", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("positives", "negatives")])


@register("sampled_lexical_others", f"""
    WITH r AS (SELECT item_id, task, list_distinct({Q.words(Q.audit('text'))}) AS w FROM eval_passages), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY task ORDER BY md5('3|' || item_id), item_id) <= 256),
    j AS (SELECT r.item_id, f.item_id AS other, len(list_intersect(r.w, f.w))::DOUBLE / (len(r.w) + len(f.w) - len(list_intersect(r.w, f.w))) AS sim FROM r JOIN f ON r.task <> f.task)
    SELECT item_id, other, round(sim, 6) AS sim FROM j QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, other) <= 1""")
def sampled_lexical_others(spark, d):
    """The most similar passage of another task."""
    r = _t(spark, d, "eval_passages").select("item_id", "task", X.token_set("text").alias("w"))
    return M.sampled_lexical(r, r, "item_id", "task", "w", 3).select("item_id", "other", F.round("sim", 6).alias("sim"))
