"""Queries over the text functions (T) and the row filters (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrow
from corpusloom.functions import text as X
from corpusloom.functions.names import canonical_name
from corpusloom.operators import filters
from corpusloom.plans import sqltext as Q
from corpusloom.plans.catalog import register
from corpusloom.session import prepare, table


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(prepare(spark), d, name)


def _norm(name: str, tables: str, key: str, col: str, spark_form, sql_form) -> None:
    sql = f"SELECT {key}, {sql_form(col)} AS normal FROM {tables}"
    register(name, sql)(lambda spark, d: _t(spark, d, tables).select(key, spark_form(col).alias("normal")))


_norm("text_collapse", "documents", "doc_id", "text", X.collapse, Q.collapse)
_norm("norm_audit_text", "documents", "doc_id", "text", X.audit_normal, Q.audit)
_norm("norm_prompt_strip", "contrastive", "pos", "query", X.prompt_normal, Q.prompt)
_norm("norm_social", "documents", "doc_id", "text", X.social_normal, Q.social)
_norm("alnum_key", "documents", "doc_id", "text", X.alnum_key, Q.alnum)
_norm("norm_tfidf", "documents", "doc_id", "text", X.tfidf_normal, lambda x: Q.collapse(Q.sub(Q.sub(f"lower({x})", Q.URL), "[^0-9a-zа-яё \\-]")))
_norm("html_clean_tags", "documents", "doc_id", "text", X.strip_tags, lambda x: Q.collapse(Q.sub(x, "<[^>]+>")))
_norm("slug_titles", "documents", "doc_id", "title", X.slug, lambda x: Q.sub(Q.sub(f"lower({x})", "[^\\p{L}\\p{N}]+", "-"), "^-+|-+$", ""))


def _entities(x: str) -> str:
    for a, b in X.ENTITIES.items():
        quoted = b.replace("'", "''")
        x = f"replace({x}, '{a}', '{quoted}')"
    return x


_norm("html_unescape_common", "documents", "doc_id", "text", X.unescape_common, _entities)


@register("norm_by_modes", f"SELECT pos, regexp_replace(lower(replace(replace({Q.sub('trim(query)', Q.B + '+')}, 'ё', 'е'), 'Ё', 'Е')), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS normal FROM contrastive")
def norm_by_modes(spark, d):
    return _t(spark, d, "contrastive").select("pos", X.by_modes("query", "strip+spaces+yo+lower+punctstrip").alias("normal"))


@register("norm_nfkc")
def norm_nfkc(spark, d):
    """Compatibility normalisation needs Python's Unicode tables: rows only."""
    return _t(spark, d, "contrastive").select("pos", arrow.nfkc("query").alias("nfkc"), arrow.casefold_key("query").alias("key"), arrow.fair_normal("query").alias("fair"))


@register("html_unescape_all")
def html_unescape_all(spark, d):
    return _t(spark, d, "documents").select("doc_id", arrow.unescape("text").alias("text"))


@register("prefix_add", "SELECT pos, 'Instruct: Find the answer' || chr(10) || 'Query: ' || query AS prefixed, 'search: ' || positive AS plain FROM contrastive")
def prefix_add(spark, d):
    return _t(spark, d, "contrastive").select("pos", X.with_prefix("query", "Find the answer").alias("prefixed"), X.with_prefix("positive", prefix="search: ").alias("plain"))


@register("prefix_strip_repeated", "SELECT pos, regexp_replace(query, '^((Instruct: |Правда ли, что |Что делать, )[ ]*)+', '') AS stripped FROM contrastive")
def prefix_strip_repeated(spark, d):
    return _t(spark, d, "contrastive").select("pos", X.without_prefixes("query", ["Instruct: ", "Правда ли, что ", "Что делать, "]).alias("stripped"))


_TRIM = f"""
    WITH a AS (SELECT doc_id, {Q.collapse('text')} AS t FROM documents), h AS (SELECT *, substring(t, 1, 240) AS h, reverse(substring(t, 1, 240)) AS b FROM a),
    p AS (SELECT *, greatest(CASE WHEN instr(b, '.') > 0 THEN 241 - instr(b, '.') ELSE 0 END, CASE WHEN instr(b, '!') > 0 THEN 241 - instr(b, '!') ELSE 0 END, CASE WHEN instr(b, '?') > 0 THEN 241 - instr(b, '?') ELSE 0 END) AS p FROM h)
    SELECT doc_id, CASE WHEN length(t) <= 240 THEN t WHEN p >= 0.65 * 240 THEN substring(h, 1, p) ELSE rtrim(h) END AS trimmed FROM p"""


@register("trim_sentence_boundary", _TRIM)
def trim_sentence_boundary(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.trim_at_sentence("text", 240).alias("trimmed"))


@register("snippets", f"SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substring(t, 1, 80)) || '…' END AS snippet FROM (SELECT doc_id, {Q.collapse('text')} AS t FROM documents)")
def snippets(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.snippet("text", 80).alias("snippet"))


_SET = f"list_distinct({Q.words(Q.audit('text'))})"


@register("token_count_stats", f"SELECT doc_id, len({Q.words(Q.audit('text'))})::BIGINT AS n_tokens, len({_SET})::BIGINT AS n_distinct, {Q.count('text', '[A-Za-zА-Яа-яЁё0-9]+')}::BIGINT AS n_words FROM documents WHERE text IS NOT NULL")
def token_count_stats(spark, d):
    t = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", X.tokens(X.audit_normal("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"), X.word_count("text").alias("n_words"))


@register("token_sets", f"SELECT pos, array_to_string(list_sort(list_distinct({Q.words(Q.audit('query'))})), ' ') AS words FROM contrastive WHERE query IS NOT NULL")
def token_sets(spark, d):
    return _t(spark, d, "contrastive").where("query IS NOT NULL").select("pos", F.array_join(F.array_sort(X.token_set("query")), " ").alias("words"))


@register("char_ngram_counts", f"""
    WITH a AS (SELECT pos, {Q.alnum('query')} AS k FROM contrastive WHERE query IS NOT NULL)
    SELECT pos, CASE WHEN k = '' THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(length(k) - 3, 1) + 1), lambda i: substring(k, i, 4)))) END::BIGINT AS n_grams FROM a""")
def char_ngram_counts(spark, d):
    a = _t(spark, d, "contrastive").where("query IS NOT NULL").select("pos", X.alnum_key("query").alias("k"))
    return a.select("pos", F.size(X.char_ngrams("k")).cast("bigint").alias("n_grams"))


@register("script_alpha_ratios", f"SELECT doc_id, round({Q.ratio('text', chr(92) + 'p{Cyrillic}', chr(92) + 'p{L}')}, 6) AS cyrillic, round({Q.ratio('text', chr(92) + 'p{L}')}, 6) AS alpha FROM documents")
def script_alpha_ratios(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.round(X.cyrillic_ratio("text"), 6).alias("cyrillic"), F.round(X.alpha_ratio("text"), 6).alias("alpha"))


@register("bad_char_ratios", "SELECT doc_id, round(CASE WHEN text = '' THEN 1.0 WHEN text IS NOT NULL THEN len(regexp_extract_all(regexp_replace(text, '[\\n\\t]', '', 'g'), '[\\p{C}]|�'))::DOUBLE / length(text) END, 6) AS bad FROM documents")
def bad_char_ratios(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.round(X.bad_char_ratio("text"), 6).alias("bad"))


@register("repetition_ratio", f"""
    WITH w AS (SELECT doc_id, unnest({Q.words('lower(text)')}) AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
    r AS (SELECT doc_id, max(n)::DOUBLE / sum(n) AS r, sum(n) AS total FROM c GROUP BY doc_id)
    SELECT doc_id, round(CASE WHEN total >= 8 THEN r ELSE 0.0 END, 6) AS repetition FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN (SELECT * FROM r) USING (doc_id)""".replace("CASE WHEN total >= 8 THEN r ELSE 0.0 END", "CASE WHEN coalesce(total, 0) >= 8 THEN r ELSE 0.0 END"))
def repetition_ratio(spark, d):
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.round(X.repetition_ratio("text"), 6).alias("repetition"))


@register("content_hash_groups", f"SELECT sha1(coalesce({Q.audit('text')}, '')) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_groups(spark, d):
    h = _t(spark, d, "documents").select(X.content_hash(X.audit_normal("text")).alias("hash"), "doc_id")
    return h.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@register("record_signatures", f"SELECT sha1(coalesce(source, '') || '|' || coalesce(objective, '') || '|' || sha1(coalesce({Q.alnum('query')}, '')) || '|' || sha1(coalesce({Q.alnum('positive')}, ''))) AS signature, count(*) AS n FROM contrastive GROUP BY 1")
def record_signatures(spark, d):
    parts = ["source", "objective", X.content_hash(X.alnum_key("query")), X.content_hash(X.alnum_key("positive"))]
    return _t(spark, d, "contrastive").select(X.content_hash(*parts).alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))


_FEATURE_SQL = ", ".join("coalesce(regexp_matches(lower(query), '{}'), false) AS {}".format(p.replace("\\-", "-").replace("[:;][-]?", "[:;]-?"), n) for n, p in X.FEATURES.items())


@register("feature_flags", f"SELECT pos, {_FEATURE_SQL} FROM contrastive")
def feature_flags(spark, d):
    return _t(spark, d, "contrastive").select("pos", *[c.alias(n) for n, c in X.features("query").items()])


#: Stems by topic, for the lexicon queries.
TOPICS = {"software": ["сервер", "драйвер", "скрипт", "server", "quer"], "science": ["гипотез", "выборк", "спектр", "hypothes"], "travel": ["гостиниц", "экскурси", "билет", "hotel"], "news": ["депутат", "выбор", "бюджет", "budget"]}


def _lexicon_sql(x: str) -> str:
    low = Q.fold_yo(x)
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({low}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(s)})') THEN '{g}' END" for g, s in TOPICS.items()) + "], lambda x: x IS NOT NULL)"


@register("lexicon_labels", f"SELECT pos, array_to_string({_lexicon_sql('query')}, ',') AS topics FROM contrastive")
def lexicon_labels(spark, d):
    return _t(spark, d, "contrastive").select("pos", F.array_join(X.lexicon_groups("query", TOPICS), ",").alias("topics"))


@register("exactly_one_group", f"SELECT pos, g[1] AS topic FROM (SELECT pos, {_lexicon_sql('query')} AS g FROM contrastive) WHERE len(g) = 1")
def exactly_one_group(spark, d):
    g = _t(spark, d, "contrastive").select("pos", X.lexicon_groups("query", TOPICS).alias("g"))
    return filters.exactly_one(g, "g").select("pos", F.element_at("g", 1).alias("topic"))


@register("vote_label", """
    WITH h AS (SELECT pos, regexp_matches(lower(query), 'сервер|драйвер')::INT + regexp_matches(lower(query), 'плагин')::INT AS it, regexp_matches(lower(query), 'гипотез|выборк')::INT * 2 AS science FROM contrastive WHERE query IS NOT NULL)
    SELECT pos, CASE WHEN it >= science THEN 'it' ELSE 'science' END AS topic, round(least(0.98::DOUBLE, 0.45::DOUBLE + 0.12::DOUBLE * greatest(it, science)), 6) AS confidence FROM h WHERE greatest(it, science) > 0""")
def vote_label(spark, d):
    low = F.lower("query")
    hits = {"it": low.rlike("сервер|драйвер").cast("int") + low.rlike("плагин").cast("int"), "science": low.rlike("гипотез|выборк").cast("int") * 2}
    v = _t(spark, d, "contrastive").where("query IS NOT NULL").select("pos", X.vote(hits).alias("v")).where("v IS NOT NULL")
    return v.select("pos", F.col("v.group").alias("topic"), F.round("v.confidence", 6).alias("confidence"))


@register("keyword_lists", r"""
    WITH k AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_extract(text, '(?i)(?:Ключевые слова|Keywords):[ \t]*([^\n]+)', 1), '[,;]'), lambda p: regexp_replace(trim(regexp_replace(p, '[ \t]+', ' ', 'g')), '[. ]+$', '')), lambda p: p <> '')[1:8] AS k FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, array_to_string(k, '|') AS keywords FROM k WHERE len(k) > 0""")
def keyword_lists(spark, d):
    k = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.keywords("text").alias("k")).where(F.size("k") > 0)
    return k.select("doc_id", F.array_join("k", "|").alias("keywords"))


@register("sentence_counts", r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))::BIGINT AS n_sentences FROM documents WHERE text IS NOT NULL""")
def sentence_counts(spark, d):
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(X.sentences("text")).cast("bigint").alias("n_sentences"))


@register("perturb_texts", r"""
    WITH a AS (SELECT pos, query, list_filter(string_split(regexp_replace(query, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM contrastive WHERE query IS NOT NULL)
    SELECT pos, CASE WHEN len(s) > 1 THEN array_to_string(s[2:], ' ') ELSE query END AS no_first, regexp_replace(query, '[0-9]+', '7') AS number_swapped, regexp_replace(query, '(?i)(сервер|драйвер)', '[MASK]') AS masked FROM a""")
def perturb_texts(spark, d):
    c = _t(spark, d, "contrastive").where("query IS NOT NULL")
    return c.select("pos", X.crop("query", 1, 0).alias("no_first"), X.replace_first("query", "[0-9]+", "7").alias("number_swapped"), X.replace_first("query", "(?i:сервер|драйвер)", "[MASK]").alias("masked"))


@register("template_synthesis", """
    SELECT DISTINCT printf('Тема: %s; метка: %s', t.task, l.label) AS text FROM (SELECT DISTINCT task FROM eval_passages) t, (SELECT DISTINCT label FROM label_targets) l""")
def template_synthesis(spark, d):
    tasks, labels = _t(spark, d, "eval_passages").select("task").distinct(), _t(spark, d, "label_targets").select("label").distinct()
    return filters.templates("Тема: %s; метка: %s", tasks, labels)


@register("leading_numbers", "SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '^[ ]*([0-9]+)\\b', 1), '') AS BIGINT) AS number FROM documents WHERE regexp_matches(text, '^[ ]*[0-9]+\\b')")
def leading_numbers(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.leading_number("text").alias("number")).where("number IS NOT NULL")


@register("suffix_stems", f"""
    WITH w AS (SELECT unnest({Q.words("lower(query)")}) AS w FROM contrastive WHERE query IS NOT NULL)
    SELECT w AS word, CASE WHEN ends_with(w, 'ами') AND length(w) >= 8 THEN left(w, length(w) - 3) WHEN ends_with(w, 'ов') AND length(w) >= 7 THEN left(w, length(w) - 2) WHEN ends_with(w, 'ы') AND length(w) >= 6 THEN left(w, length(w) - 1) ELSE w END AS stem, count(*) AS n FROM w GROUP BY 1, 2""")
def suffix_stems(spark, d):
    w = _t(spark, d, "contrastive").where("query IS NOT NULL").select(F.explode(X.tokens(F.lower("query"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).select("word", X.stem("word", ["ами", "ов", "ы"]).alias("stem"), "n")


@register("compact_numbers", "SELECT o_orderkey, replace(replace(regexp_replace(printf('%.2f', o_totalprice), '\\.?0+$', ''), '.', 'p'), '-', 'm') AS name FROM orders")
def compact_numbers(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", X.compact_number("o_totalprice", 2).alias("name"))


# ---- row filters

_GATE = f"""
    WITH a AS (SELECT doc_id, text AS t FROM documents), w AS (SELECT doc_id, unnest({Q.words('lower(t)')}) AS w FROM a), n AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
    r AS (SELECT doc_id, CASE WHEN sum(n) >= 8 THEN max(n)::DOUBLE / sum(n) ELSE 0.0 END AS rep FROM n GROUP BY doc_id),
    g AS (SELECT doc_id, CASE WHEN t IS NULL OR trim(t) = '' THEN 'empty' WHEN length(t) < 100 THEN 'too_short' WHEN length(t) > 5000 THEN 'too_long'
        WHEN len(regexp_extract_all(regexp_replace(t, '[\\n\\t]', '', 'g'), '[\\p{{C}}]|�'))::DOUBLE / length(t) > 0.01 THEN 'bad_chars'
        WHEN {Q.ratio('t', chr(92) + 'p{L}')} < 0.55 THEN 'low_alpha' WHEN coalesce(rep, 0) > 0.3 THEN 'repetition' ELSE 'kept' END AS reason FROM a LEFT JOIN r USING (doc_id))"""


@register("quality_ladder", f"{_GATE} SELECT doc_id, reason FROM g")
def quality_ladder(spark, d):
    return _t(spark, d, "documents").select("doc_id", filters.quality_reason("text").alias("reason"))


@register("quality_ladder_counts", f"{_GATE} SELECT reason, count(*) AS n FROM g GROUP BY reason")
def quality_ladder_counts(spark, d):
    return filters.reject_counts(_t(spark, d, "documents").select(filters.quality_reason("text").alias("reason")), "reason")


@register("length_token_window", f"SELECT doc_id FROM documents WHERE length(text) BETWEEN 120 AND 1200 AND {Q.count('text', '[A-Za-zА-Яа-яЁё0-9]+')} BETWEEN 15 AND 150")
def length_token_window(spark, d):
    return filters.window(_t(spark, d, "documents"), "text", chars=(120, 1200), words=(15, 150)).select("doc_id")


@register("objective_source_filter", f"SELECT pos FROM contrastive WHERE coalesce(objective, 'contrastive') = 'contrastive' AND {Q.source()} IN ('it_forum_qa', 'news_wire', 'soc_chat')")
def objective_source_filter(spark, d):
    c = _t(spark, d, "contrastive").withColumn("source", canonical_name("source")).withColumn("objective", F.coalesce("objective", F.lit("contrastive")))
    return filters.isin(c, objective=["contrastive"], source=["it_forum_qa", "news_wire", "soc_chat"]).select("pos")


@register("qa_rejection_ladder", f"""
    WITH a AS (SELECT pos, query AS q, positive AS p, {Q.alnum('query')} AS kq, {Q.alnum('positive')} AS kp FROM contrastive),
    j AS (SELECT *, list_distinct(string_split(kq, ' ')) AS sq, list_distinct(string_split(kp, ' ')) AS sp FROM a),
    s AS (SELECT *, len(list_intersect(sq, sp))::DOUBLE / nullif(len(sq) + len(sp) - len(list_intersect(sq, sp)), 0) AS sim FROM j)
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN q IS NULL OR trim(q) = '' THEN 'no_query' WHEN p IS NULL OR trim(p) = '' THEN 'no_positive' WHEN kq = kp THEN 'same_text' WHEN length(q) < 40 THEN 'short_query' WHEN length(p) < 60 THEN 'short_positive'
    WHEN sim >= 0.5 THEN 'too_similar' WHEN sim < 0.02 THEN 'unrelated' ELSE 'kept' END AS reason FROM s) GROUP BY reason""")
def qa_rejection_ladder(spark, d):
    return filters.reject_counts(_t(spark, d, "contrastive").select(filters.pair_reason("query", "positive").alias("reason")), "reason")


@register("social_quality")
def social_quality(spark, d):
    """Repeated letters need a back-reference, which the SQL engine has not: tested against Python."""
    return _t(spark, d, "contrastive").where(filters.social_ok("query")).select("pos")


@register("neutral_news_quality", f"""
    SELECT doc_id FROM documents WHERE length(text) >= 80 AND {Q.ratio('text', chr(92) + 'p{L}')} >= 0.58
    AND NOT regexp_matches(lower(text), '(^|[^\\p{{L}}])(я|мне|меня|мой|моя|мы|нам|нас|наш)([^\\p{{L}}]|$)') AND NOT regexp_matches(text, '[:;]-?[)(DP]|\\)\\)+|\\(\\(+')""")
def neutral_news_quality(spark, d):
    return _t(spark, d, "documents").where(filters.neutral_ok("text")).select("doc_id")


@register("perspective_rule", """
    SELECT pos, CASE WHEN regexp_matches(lower(query), '(^|[^\\p{L}])(я|мне|меня|мы|нам)([^\\p{L}]|$)') THEN 'own' WHEN regexp_matches(lower(query), 'по словам|сообщил|заявил|рассказал|according to') THEN 'reported' END AS perspective
    FROM contrastive WHERE regexp_matches(lower(query), '(^|[^\\p{L}])(я|мне|меня|мы|нам)([^\\p{L}]|$)|по словам|сообщил|заявил|рассказал|according to')""")
def perspective_rule(spark, d):
    return filters.perspective(_t(spark, d, "contrastive"), "query").select("pos", "perspective")


@register("prune_array_negatives", """
    WITH n AS (SELECT pos, positive, list_filter(negatives, lambda x: x IS NOT NULL AND trim(x) <> '' AND x IS DISTINCT FROM positive AND length(x) >= 60) AS neg FROM contrastive)
    SELECT pos, len(neg[1:3])::BIGINT AS n_kept, array_to_string(neg[1:3], '|') AS kept FROM n WHERE len(neg) >= 1""")
def prune_array_negatives(spark, d):
    c = filters.prune(_t(spark, d, "contrastive"), "negatives", lambda x: (F.trim(x) != "") & ~x.eqNullSafe(F.col("positive")) & (F.length(x) >= 60), least=1, most=3)
    return c.select("pos", F.size("negatives").cast("bigint").alias("n_kept"), F.array_join("negatives", "|").alias("kept"))


@register("near_copy_guard", f"""
    WITH a AS (SELECT pos, {Q.source()} AS s, list_distinct(string_split({Q.alnum('query')}, ' ')) AS q, list_distinct(string_split({Q.alnum('positive')}, ' ')) AS p FROM contrastive WHERE query IS NOT NULL AND positive IS NOT NULL)
    SELECT pos FROM a WHERE NOT (s LIKE 'sci%' AND len(list_intersect(q, p))::DOUBLE / (len(q) + len(p) - len(list_intersect(q, p))) > 0.2)""".replace("NOT (s LIKE", "NOT (coalesce(s, '') LIKE"))
def near_copy_guard(spark, d):
    c = _t(spark, d, "contrastive").where("query IS NOT NULL AND positive IS NOT NULL")
    return filters.near_copy_guard(c, "query", "positive", F.coalesce(canonical_name("source"), F.lit("")).startswith("sci"), 0.2).select("pos")


@register("class_threshold", "SELECT vec_id FROM embeddings WHERE embedding[1] >= CASE WHEN label = 0 THEN 0.1 WHEN label IN (1, 2) THEN 0.05 ELSE 0.0 END")
def class_threshold(spark, d):
    return filters.class_threshold(_t(spark, d, "embeddings"), F.col("embedding")[0], "label", {0: 0.1, 1: 0.05, 2: 0.05}, 0.0).select("vec_id")


@register("multi_signal_gate", f"SELECT pos FROM pair_score WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) AND length(sentence1) BETWEEN 30 AND 400 AND length(sentence2) BETWEEN 30 AND 400 AND len(list_intersect({Q.words(Q.audit('sentence1'))}, {Q.words(Q.audit('sentence2'))})) >= 1")
def multi_signal_gate(spark, d):
    p = _t(spark, d, "pair_score")
    return p.where(filters.all_of(F.col("score").between(0, 1), ~F.isnan("score"), F.length("sentence1").between(30, 400), F.length("sentence2").between(30, 400), F.size(F.array_intersect(X.token_set("sentence1"), X.token_set("sentence2"))) >= 1)).select("pos")


@register("valid_tags", f"""
    WITH t AS (SELECT doc_id, unnest({Q.words('lower(title)')}) AS tag FROM documents WHERE title IS NOT NULL)
    SELECT tag, count(*) AS n FROM t WHERE regexp_matches(tag, '\\p{{Cyrillic}}') AND NOT regexp_matches(tag, '^[0-9\\-–]+( г(од|ода)?\\.?)?$') AND tag NOT IN ('что', 'как') AND length(tag) >= 3 GROUP BY tag""")
def valid_tags(spark, d):
    t = _t(spark, d, "documents").where("title IS NOT NULL").select(F.explode(X.tokens(F.lower("title"))).alias("tag"))
    return t.where(filters.valid_tag(F.col("tag"), ["что", "как"])).groupBy("tag").agg(F.count("*").alias("n"))
