"""Queries over record shapes (C) and batches (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.names import canonical_name
from corpusloom.operators import batches as B
from corpusloom.operators import reshape as C
from corpusloom.operators.sampling import top_k_per_key
from corpusloom.plans import sqltext as Q
from corpusloom.plans.catalog import register
from corpusloom.session import prepare, table


def _t(spark, d, name):
    return table(prepare(spark), d, name)


_NEG = "(SELECT pos, query, unnest(negatives) AS t, generate_subscripts(negatives, 1) AS slot FROM contrastive)"


@register("flatten_pairs", f"SELECT pos, 0 AS slot, query AS sentence1, positive AS sentence2, 1.0::DOUBLE AS score FROM contrastive WHERE query IS NOT NULL AND positive IS NOT NULL UNION ALL SELECT pos, slot, query, t, 0.0::DOUBLE FROM {_NEG} WHERE query IS NOT NULL AND t IS NOT NULL")
def flatten_pairs(spark, d):
    return C.to_pairs(_t(spark, d, "contrastive"), "pos", "query", "positive", "negatives")


@register("all_texts", "SELECT field, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'query' AS field, query AS text FROM contrastive UNION ALL SELECT 'positive', positive FROM contrastive UNION ALL SELECT 'negatives', unnest(negatives) FROM contrastive UNION ALL SELECT 'positives', unnest(positives) FROM contrastive UNION ALL SELECT 'metadata', unnest(map_values(metadata)) FROM contrastive) WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY field")
def all_texts(spark, d):
    return C.all_texts(_t(spark, d, "contrastive"), "pos", "query", "positive", "positives", "negatives", "metadata").groupBy("field").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@register("record_text_counts", "SELECT pos, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT pos, query AS text FROM contrastive UNION ALL SELECT pos, positive FROM contrastive UNION ALL SELECT pos, unnest(negatives) FROM contrastive UNION ALL SELECT pos, unnest(positives) FROM contrastive) WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY pos")
def record_text_counts(spark, d):
    return C.record_texts(_t(spark, d, "contrastive"), "pos")


def _label():
    label = F.regexp_replace(F.lower(F.trim("label")), " ", "_")
    return F.when(label != "", label)


_LABEL = "nullif(replace(lower(trim(label)), ' ', '_'), '')"
_ROWS = f"(SELECT batch_id * 1000 + slot AS id, {_LABEL} AS label, text FROM labeled_text WHERE {_LABEL} IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch_id, slot ORDER BY added_at DESC, {_LABEL} DESC, text DESC) = 1)"


def _rows(spark, d):
    t = _t(spark, d, "labeled_text").select((F.col("batch_id") * 1000 + F.col("slot")).alias("id"), _label().alias("label"), "text", "added_at").where("label IS NOT NULL AND text IS NOT NULL")
    return t.groupBy("id").agg(F.max_by(F.struct("label", "text"), F.struct("added_at", "label", "text")).alias("r")).select("id", "r.label", "r.text")


@register("support_pools", f"SELECT label, array_to_string(list(text ORDER BY r), '|') AS texts FROM (SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY md5('4|' || id), id) AS r FROM {_ROWS}) WHERE r <= 3 GROUP BY label")
def support_pools(spark, d):
    return C.supports(_rows(spark, d), "id", "label", "text", 3, 4).select("label", F.array_join("texts", "|").alias("texts"))


_POOL = f"(SELECT label AS l, list(text ORDER BY r) AS texts FROM (SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY md5('4|' || id), id) AS r FROM {_ROWS}) WHERE r <= 4 GROUP BY label)"


_WAYS = f"""p AS (SELECT l, texts, row_number() OVER (ORDER BY l) - 1 AS no, count(*) OVER () AS m FROM {_POOL}), q AS (SELECT id, text, label, no, m FROM {_ROWS} r JOIN p ON r.label = p.l),
    w AS (SELECT id, text, label, CASE WHEN d < 0 THEN no ELSE (no + 1 + (('0x' || substring(md5('4|' || id), 1, 8))::BIGINT + d) % (m - 1)) % m END AS no FROM q, (SELECT unnest([-1, 0, 1, 2]) AS d)),
    k AS (SELECT id, text, label, l, list_filter(texts, lambda t: t <> text)[1:3] AS t FROM w JOIN p USING (no))"""


@register("episodes", f"WITH {_WAYS} SELECT id, label, count(*) AS ways, sum(len(t))::BIGINT AS supports, string_agg(l, ',' ORDER BY l) AS labels FROM k WHERE len(t) > 0 GROUP BY id, text, label")
def episodes(spark, d):
    r = _rows(spark, d)
    e = C.episodes(r, r, "id", "label", "text", 3, 4, 4)
    n = F.aggregate(F.map_values("supports"), F.lit(0), lambda a, x: a + F.size(x))
    return e.select("id", "label", F.size("supports").cast("bigint").alias("ways"), n.cast("bigint").alias("supports"), F.array_join(F.array_sort(F.map_keys("supports")), ",").alias("labels"))


@register("episode_rows", f"WITH {_WAYS} SELECT id, l AS label, unnest(t) AS text FROM k")
def episode_rows(spark, d):
    r = _rows(spark, d)
    return C.to_labelled(C.episodes(r, r, "id", "label", "text", 3, 4, 4), "id", "supports")


@register("ridge_records", f"WITH {_WAYS} SELECT id, 'ridge_classification' AS objective, 1.5::DOUBLE AS ridge_lambda, sum(len(t))::BIGINT AS supports FROM k WHERE len(t) > 0 GROUP BY id")
def ridge_records(spark, d):
    r = _rows(spark, d)
    n = F.aggregate(F.map_values("supports"), F.lit(0), lambda a, x: a + F.size(x)).cast("bigint")
    return C.to_ridge(C.episodes(r, r, "id", "label", "text", 3, 4, 4), 1.5).select("id", "objective", "ridge_lambda", n.alias("supports"))


@register("multi_positive", f"""
    WITH n AS (SELECT id, label, text, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM {_ROWS}), w AS (SELECT id, label, text AS query, d, (i + d) % n AS j FROM n, (SELECT unnest([1, 2]) AS d) WHERE d < n)
    SELECT w.id, any_value(w.query) AS query, array_to_string(list(n.text ORDER BY w.d), '|') AS positives FROM w JOIN n ON w.label = n.label AND w.j = n.i GROUP BY w.id""")
def multi_positive(spark, d):
    return C.multi_positive(_rows(spark, d), "id", "label", "text", 2).select("id", "query", F.array_join("positives", "|").alias("positives"))


@register("label_to_statement", "SELECT vec_id, CASE label WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS statement FROM embeddings")
def label_to_statement(spark, d):
    return C.label_prefix(_t(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label")), "label", {"0": "zero", "1": "one"}).select("vec_id", "statement")


@register("first_negatives", "SELECT pos, coalesce(array_to_string(negatives[1:2], '|'), '') AS negatives FROM contrastive")
def first_negatives(spark, d):
    return C.first_negatives(_t(spark, d, "contrastive").select("pos", "negatives"), "negatives", 2).select("pos", F.array_join("negatives", "|").alias("negatives"))


@register("prompt_duplication", f"SELECT id, p AS prompt, CASE p WHEN 0 THEN 'классификация: ' ELSE 'topic: ' END || text AS text FROM {_ROWS}, (SELECT unnest([0, 1]) AS p)")
def prompt_duplication(spark, d):
    r = _rows(spark, d).withColumn("slot", F.col("id") % 1000)
    return C.with_prompts(r, ["классификация: ", "topic: "], "text", "id", "slot").select("id", "prompt", "text")


_TURNS = "(SELECT pos AS conv, 0 AS turn, 'user' AS role, query AS text FROM contrastive UNION ALL SELECT pos, 1, 'assistant', positive FROM contrastive UNION ALL SELECT pos, slot + 1, 'user', t FROM " + _NEG + ")"


def _turns(spark, d):
    p = C.to_pairs(_t(spark, d, "contrastive"), "pos", "pos", "positive", "negatives").select(F.col("pos").alias("conv"), (F.col("slot") + 1).alias("turn"), F.when(F.col("slot") == 0, "assistant").otherwise("user").alias("role"), F.col("sentence2").alias("text"))
    q = _t(spark, d, "contrastive").select(F.col("pos").alias("conv"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("query").alias("text"))
    return q.unionByName(p)


@register("role_pivot", f"SELECT conv, arg_max(text, turn) FILTER (role = 'user' AND text IS NOT NULL) AS user, arg_max(text, turn) FILTER (role = 'assistant' AND text IS NOT NULL) AS assistant FROM {_TURNS} WHERE text IS NOT NULL GROUP BY conv")
def role_pivot(spark, d):
    return C.roles(_turns(spark, d).where("text IS NOT NULL"), "conv", "turn", "role", "text", ["user", "assistant"])


@register("conversation_concat", f"SELECT conv, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM {_TURNS} WHERE text IS NOT NULL GROUP BY conv")
def conversation_concat(spark, d):
    return C.joined_turns(_turns(spark, d), "conv", "turn", "role", "text", with_role=True)


@register("inverted_index_text", f"SELECT pos, array_to_string({Q.words(Q.audit('query'))}, ' ') AS text FROM contrastive WHERE query IS NOT NULL")
def inverted_index_text(spark, d):
    """A round trip: the words of a text into a map from word to places, and back."""
    from corpusloom.functions import text as X

    w = _t(spark, d, "contrastive").where("query IS NOT NULL").select("pos", X.tokens(X.audit_normal("query")).alias("w"))
    index = F.map_from_entries(F.transform(F.array_distinct("w"), lambda t: F.struct(t, F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0))), lambda i: F.when(F.get("w", i) == t, i)), lambda i: i.isNotNull()))))
    return C.from_inverted(w.select("pos", index.alias("ix")), "pos", "ix")


@register("json_extract_repair")
def json_extract_repair(spark, d):
    """Fields of the JSON text of events, and of broken copies of it; tested on single texts."""
    e = _t(spark, d, "events")
    keys = F.json_object_keys("props")
    first = F.get(keys, F.lit(0))
    return e.select("event_id", first.alias("name"), F.size(keys).cast("bigint").alias("n_fields"), C.json_field(F.concat(F.lit('{"v": "'), F.col("event_type"), F.lit('\\q"}')), "v").alias("repaired"))


_BROKEN = """CASE doc_id % 6 WHEN 0 THEN '{"text": [{"text": " a ' || doc_id || '"}, {"text": ""}, {"text": "b"}]}' WHEN 1 THEN ' plain ' || doc_id || ' ' WHEN 2 THEN '["t' || doc_id || '", "u"]'
    WHEN 3 THEN '[{"condition": "c", "solution": {"text": "s' || doc_id || '"}}, {"solution": "x"}]' WHEN 4 THEN 'broken {"condition": "c' || doc_id || '", "answers": ["z"' END"""


@register("json_texts", """
    WITH d AS (SELECT doc_id, doc_id % 6 AS k, doc_id::VARCHAR AS i FROM documents), raw AS (SELECT doc_id, trim(BROKEN) AS r FROM documents) SELECT doc_id, CASE k WHEN 0 THEN 'a ' || i || ' b' ELSE r END AS text,
    CASE k WHEN 3 THEN 'c s' || i || ' x' WHEN 4 THEN 'c' || i || ' z' WHEN 2 THEN '' ELSE r END AS answer, CASE k WHEN 2 THEN 't' || i || '|u' WHEN 3 THEN '{"condition":"c","solution":{"text":"s' || i || '"}}|{"solution":"x"}' WHEN 1 THEN ' plain ' || i || ' ' WHEN 5 THEN '' ELSE r END AS tags FROM d JOIN raw USING (doc_id)""".replace("BROKEN", _BROKEN))
def json_texts(spark, d):
    """Texts, answers and tags of whole, repaired and broken JSON, made from the ids of the documents."""
    x = _t(spark, d, "documents").select("doc_id", F.expr(_BROKEN).alias("x"))
    return x.select("doc_id", C.json_text("x").alias("text"), C.json_answer("x").alias("answer"), F.array_join(C.json_tags("x"), "|").alias("tags"))


@register("active_labels", "SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity > 25 THEN 'many' END, CASE WHEN l_discount > 0.05 THEN 'cheap' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL), ',') AS labels FROM lineitem")
def active_labels(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).alias("many"), (F.col("l_discount") > 0.05).alias("cheap"), (F.col("l_returnflag") == "R").alias("returned"))
    return li.select("l_orderkey", "l_linenumber", F.array_join(C.active_labels(li, "many", "cheap", "returned"), ",").alias("labels"))


@register("score_remap", "SELECT pos, CASE WHEN NOT isnan(score) THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (score - 1) / 4)), 6) END AS score FROM pair_score")
def score_remap(spark, d):
    return _t(spark, d, "pair_score").select("pos", F.round(C.rescale("score", 1.0, 5.0), 6).alias("score"))


_BUCKET = "CASE WHEN score >= 0 AND score < 0.1 THEN 'low' WHEN score >= 0.2 AND score < 0.7 THEN 'mid' WHEN score >= 0.85 AND score < 0.95 THEN 'high' WHEN score >= 0.95 AND score <= 1 THEN 'top' END"


@register("score_buckets", f"SELECT coalesce({_BUCKET}, 'none') AS bucket, count(*) AS n FROM pair_score GROUP BY 1")
def score_buckets(spark, d):
    return _t(spark, d, "pair_score").select(F.coalesce(C.bucket("score"), F.lit("none")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@register("composite_labels", "SELECT doc_id, source || '::' || lang AS label FROM documents")
def composite_labels(spark, d):
    return _t(spark, d, "documents").select("doc_id", C.composite("source", "lang").alias("label"))


@register("label_set_parse", "SELECT term, array_to_string(list_filter(['abusive', 'hateful', 'sexual'], lambda k: list_contains(regexp_split_to_array(lower(category || '; other'), '[+,|;/ \\t]+'), k)), '+') AS labels FROM term_list")
def label_set_parse(spark, d):
    return _t(spark, d, "term_list").select("term", F.array_join(C.known_labels(F.concat("category", F.lit("; other")), ["abusive", "hateful", "sexual"]), "+").alias("labels"))


@register("metadata_annotate", "SELECT pos, coalesce(metadata['lang'], 'none') AS lang, coalesce(len(map_keys(metadata)), 0) + CASE WHEN coalesce(list_contains(map_keys(metadata), 'split'), false) THEN 0 ELSE 1 END AS n FROM contrastive")
def metadata_annotate(spark, d):
    c = C.annotate(_t(spark, d, "contrastive"), "metadata", split=F.col("split"))
    return c.select("pos", F.coalesce(F.try_element_at("metadata", F.lit("lang")), F.lit("none")).alias("lang"), F.size("metadata").cast("bigint").alias("n"))


@register("normalised_inputs", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE trim(regexp_replace(nullif(concat_ws(' ', title, lang), ''), '[ \\t\\n\\r\\f\\x0B ﻿]+', ' ', 'g')) END AS text FROM documents WHERE doc_id % 2 = 1 OR text IS NOT NULL")
def normalised_inputs(spark, d):
    even = F.col("doc_id") % 2 == 0
    docs = _t(spark, d, "documents").where("doc_id % 2 = 1 OR text IS NOT NULL")
    return docs.select("doc_id", C.normalised_input(F.when(even, F.col("text")), F.lit(None).cast("string"), F.col("title"), F.col("lang")).alias("text"))


# ---- batches

_RANKED = lambda rows, key, group, seed: f"(SELECT {key}, {group}, row_number() OVER (PARTITION BY {group} ORDER BY md5('{seed}|' || {key}), {key}) - 1 AS i, count(*) OVER (PARTITION BY {group}) AS n FROM {rows} WHERE {group} IS NOT NULL)"


@register("label_balanced_batches", f"""
    WITH r AS (SELECT * FROM {_RANKED(_ROWS, 'id', 'label', 2)} WHERE n > 1), l AS (SELECT label, n, row_number() OVER (ORDER BY label) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT label, n FROM r)),
    c AS (SELECT c // 8 AS batch_id, c % 8 AS slot, (c // 8) * 4 + (c % 8) // 2 AS turn, (c % 8) % 2 AS j FROM (SELECT unnest(range(0, 400)) AS c))
    SELECT batch_id, slot, l.label, r.id FROM c JOIN l ON c.turn % l.m = l.k JOIN r ON r.label = l.label AND r.i = ((c.turn // l.m) * 2 + c.j) % l.n""")
def label_balanced_batches(spark, d):
    return B.label_balanced(_rows(spark, d), "id", "label", 4, 2, 50, 2)


_SCORED = f"(SELECT pos, {_BUCKET} AS bucket FROM pair_score)"


@register("score_balanced_batches", f"""
    WITH r AS (SELECT * FROM {_RANKED(_SCORED, 'pos', 'bucket', 2)}), b AS (SELECT bucket, row_number() OVER (ORDER BY bucket) - 1 AS k, min(n) OVER () // 3 AS m FROM (SELECT DISTINCT bucket, n FROM r))
    SELECT i // 3 AS batch_id, k * 3 + i % 3 AS slot, bucket, pos FROM r JOIN b USING (bucket) WHERE i // 3 < m""")
def score_balanced_batches(spark, d):
    return B.score_balanced(_t(spark, d, "pair_score").select("pos", C.bucket("score").alias("bucket")), "pos", "bucket", 3, 2)


@register("random_label_batches", f"""
    WITH r AS (SELECT * FROM {_RANKED(_ROWS, 'id', 'label', 2)}), l AS (SELECT label, n, row_number() OVER (ORDER BY md5('2|' || label), label) - 1 AS no, count(*) OVER () AS m FROM (SELECT DISTINCT label, n FROM r)),
    b AS (SELECT batch_id, k, (('0x' || substring(md5('2|' || batch_id), 1, 8))::BIGINT + k) % (SELECT any_value(m) FROM l) AS no FROM (SELECT unnest(range(0, 30)) AS batch_id), (SELECT unnest([0, 1, 2]) AS k)),
    c AS (SELECT batch_id, label, k * 2 + j AS slot, (('0x' || substring(md5('2|' || label || '|' || batch_id), 1, 8))::BIGINT + j) % n AS i FROM b JOIN l USING (no), (SELECT unnest([0, 1]) AS j) WHERE j < n) SELECT batch_id, slot::BIGINT AS slot, label, id FROM c JOIN r USING (label, i)""")
def random_label_batches(spark, d):
    return B.random_labels(_rows(spark, d), "id", "label", 3, 2, 30, 2)


_CONTR = f"(SELECT pos, {Q.source()} AS source, split FROM contrastive)"


@register("hierarchical_batches", f"""
    WITH r AS (SELECT pos, split, source, row_number() OVER (PARTITION BY split, source ORDER BY md5('2|' || pos), pos) - 1 AS i, count(*) OVER (PARTITION BY split, source) AS n FROM {_CONTR} WHERE split IS NOT NULL AND source IS NOT NULL), g AS (SELECT *, i // 2 AS chunk FROM r WHERE i < (n // 2) * 2),
    c AS (SELECT split, source, chunk, row_number() OVER (PARTITION BY split ORDER BY chunk, source) - 1 AS c FROM (SELECT DISTINCT split, source, chunk FROM g)), f AS (SELECT *, count(*) OVER (PARTITION BY split) AS m FROM c), k AS (SELECT * FROM f WHERE c < (m // 4) * 4),
    b AS (SELECT split, bb, row_number() OVER (ORDER BY bb, split) - 1 AS batch_id FROM (SELECT DISTINCT split, c // 4 AS bb FROM k))
    SELECT batch_id, (k.c % 4) * 2 + g.i % 2 AS slot, split, source, pos FROM g JOIN k USING (split, source, chunk) JOIN b ON b.split = k.split AND b.bb = k.c // 4""".replace("split, source, pos FROM g JOIN k", "k.split AS split, source, pos FROM g JOIN k"))
def hierarchical_batches(spark, d):
    c = _t(spark, d, "contrastive").select("pos", canonical_name("source").alias("source"), "split")
    return B.hierarchical(c, "pos", "split", "source", 4, 2, 2)


@register("support_query_roles", f"WITH r AS (SELECT *, i // 5 AS batch_id FROM {_RANKED(_ROWS, 'id', 'label', 2)}), f AS (SELECT * FROM r WHERE batch_id < n // 5), l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT label FROM f)) SELECT batch_id, k * 5 + i % 5 AS slot, CASE WHEN i % 5 < 3 THEN 'support' ELSE 'query' END AS role, label, id FROM f JOIN l USING (label)")
def support_query_roles(spark, d):
    return B.support_query(_rows(spark, d), "id", "label", 3, 2, 2)


_PART = lambda s: f"(SELECT pos, 'x' AS part FROM {_CONTR} WHERE source = '{s}')"


@register("fixed_slot_interleave", " UNION ALL ".join(f"SELECT c // {k} AS batch_id, c % {k} + {at} AS slot, '{n}' AS part, pos FROM (SELECT unnest(range(0, {40 * k})) AS c) JOIN {_RANKED(_PART(s), 'pos', 'part', 2)} r ON c % r.n = r.i" for n, s, k, at in (("forum", "it_forum_qa", 3, 0), ("wire", "news_wire", 1, 3))))
def fixed_slot_interleave(spark, d):
    c = _t(spark, d, "contrastive").select("pos", canonical_name("source").alias("source"))
    return B.interleave({"forum": (c.where("source = 'it_forum_qa'").select("pos"), 3), "wire": (c.where("source = 'news_wire'").select("pos"), 1)}, "pos", 40, 2)


@register("block_shuffle", f"SELECT n.new AS batch_id, slot FROM (SELECT DISTINCT batch_id, slot FROM labeled_text) t JOIN (SELECT batch_id, row_number() OVER (ORDER BY md5('2|' || batch_id), batch_id) - 1 AS new FROM (SELECT DISTINCT batch_id FROM labeled_text)) n USING (batch_id)")
def block_shuffle(spark, d):
    return B.shuffle_blocks(_t(spark, d, "labeled_text").select("batch_id", "slot").distinct(), "batch_id", 2)


@register("non_reusing_batches")
def non_reusing_batches(spark, d):
    """Dealt out so that no record and no label comes twice in a batch; tested for that."""
    return B.without_reuse(_rows(spark, d), "id", "label", 4, 2, 2)


@register("group_contiguous_batches", f"""
    WITH r AS (SELECT * FROM {_RANKED(_CONTR, 'pos', 'source', 2)}), s AS (SELECT source, coalesce(sum(m) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT DISTINCT source, n // 16 AS m FROM r WHERE n // 16 > 0))
    SELECT (s + i // 16)::BIGINT AS batch_id, i % 16 AS slot, source, pos FROM r JOIN s USING (source) WHERE i // 16 < n // 16""")
def group_contiguous_batches(spark, d):
    return B.group_contiguous(_t(spark, d, "contrastive").select("pos", canonical_name("source").alias("source")), "pos", "source", 16, 2)


@register("adaptive_batch_size", "WITH f AS (SELECT pos, 2 + coalesce(len(negatives), 0) AS n FROM contrastive ORDER BY pos LIMIT 32), r AS (SELECT n, row_number() OVER (ORDER BY n, pos) AS r, count(*) OVER () AS c FROM f) SELECT greatest(1, floor(64 / greatest(n, 1)))::BIGINT AS batch_size FROM r WHERE r = ceil(c * 0.75)")
def adaptive_batch_size(spark, d):
    c = _t(spark, d, "contrastive").select("pos", (F.lit(2) + F.when(F.col("negatives").isNull(), 0).otherwise(F.size("negatives"))).alias("n"))
    return B.adaptive_size(c, "n", "pos", 64)


@register("plan_config", "SELECT 'stage1' AS name, count(*) AS records, ceil(count(*) / 12)::BIGINT AS steps FROM contrastive WHERE split = 'train'")
def plan_config(spark, d):
    return B.plan_config(_t(spark, d, "contrastive").where("split = 'train'"), 12, "stage1")


@register("trimmed_total", "SELECT source, pos FROM (SELECT " + Q.source() + " AS source, pos FROM contrastive) WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('3|' || pos), pos) <= 30")
def trimmed_total(spark, d):
    from corpusloom.operators.matching import hashed

    c = _t(spark, d, "contrastive").select("pos", canonical_name("source").alias("source")).where("source IS NOT NULL")
    return top_k_per_key(c, "source", 30, hashed(3, "pos"), "pos").select("source", "pos")
