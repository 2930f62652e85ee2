"""The pN_ queries and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.names import BLANKS, canonical_name
from corpusloom.llm import leak, lookalike, mixing, neardup, overlap, pack, proportions, prose, severity
from corpusloom.session import prepare, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(table(prepare(spark), d, "contrastive"), "pos", "query", "split")


def p1_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    c = table(prepare(spark), d, "contrastive").withColumn("source", canonical_name("source"))
    return overlap.overlap_report(c, "pos", "query", "split", "source")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(table(prepare(spark), d, "contrastive"), "pos", ["query", "positive"])


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(table(prepare(spark), d, "contrastive"), "pos", ["query", "positive"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unify(table(prepare(spark), d, "contrastive"), ["query", "positive"], "pos").select("pos", "field").distinct()


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every record with both texts in their one form, and the fields that had to change."""
    return lookalike.unified(table(prepare(spark), d, "contrastive"), ["query", "positive"], "pos")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    c = table(prepare(spark), d, "contrastive")
    graded = severity.votes(table(spark, d, "review_labels"), "pos", "rater", "category", newest="reviewed_at")
    return severity.severities(c, "pos", "query", severity.fit(c, "pos", "query", graded))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_scores(spark, d).where(F.col("p_offending") > severity.OFFENDING).select("pos")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Offending records and mean severity per source."""
    scored = p6_scores(spark, d).join(table(spark, d, "contrastive").select("pos", canonical_name("source").alias("source")), "pos")
    bad = F.col("p_offending") > severity.OFFENDING
    return scored.groupBy("source").agg(F.count("*").alias("records"), F.count_if(bad).alias("offending"), F.avg(bad.cast("double")).alias("rate"), F.avg("severity").alias("severity"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return leak.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_passages"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents that hold it and the largest share held."""
    per = _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share").alias("most"))
    items = table(spark, d, "eval_passages").select("item_id", "task", "split")
    return items.join(per, "item_id", "left").select("item_id", "task", "split", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most", F.lit(0.0)).alias("most"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(prepare(spark), d, "documents")
    return prose.prose(docs, "doc_id", "text", prose.fit(docs, "doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_statistics(spark, d).where("p_prose < 0.5").select("doc_id")


def _label(c: str = "label") -> Column:
    """Labels that differ in case, outer blanks or blank for underscore are one; blank is none."""
    flat = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, BLANKS, " "))), " ", "_")
    return F.when(flat != "", flat)


def _records(spark: SparkSession, d: str) -> DataFrame:
    return proportions.newest(table(prepare(spark), d, "labeled_text"), ["batch_id", "slot"], "added_at", _label())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The labels of which the drawn sample has all there are, or its share of them, and these are too few."""
    return p2_report(spark, d).where("short AND drawn <= available").select("plan", "label").distinct()


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return proportions.draw(_records(spark, d), ["batch_id", "slot"], table(spark, d, "label_targets"), _label())


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    records, targets = _records(spark, d), table(spark, d, "label_targets")
    sample = proportions.draw(records, ["batch_id", "slot"], targets, _label())
    return proportions.report(records, sample, targets, _label())


def _train(spark: SparkSession, d: str) -> DataFrame:
    return table(prepare(spark), d, "contrastive").where("split = 'train'").select("pos", "source")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources that give the mix all they may and have too few."""
    train, targets, name = _train(spark, d), table(spark, d, "mix_targets"), canonical_name("source")
    return mixing.shares(train, name, targets, name, mixing.mix(train, "pos", name, targets, name)).where("short AND drawn <= cap").select("mix", "source").distinct()


def p4_mix(spark: SparkSession, d: str) -> DataFrame:
    """Demand in tokens of query and positive."""
    c = table(prepare(spark), d, "contrastive").where("split = 'train'").select("pos", F.concat_ws("\n", "query", "positive").alias("text"))
    sized = pack.token_counts(c, "pos", "text").join(_train(spark, d), "pos")
    return mixing.mix(sized, "pos", canonical_name("source"), table(spark, d, "mix_targets"), canonical_name("source"), size=F.col("n_tokens"))


#: Weights over the training, relative to the target: long questions early, reviews and science late.
SCHEDULES = {"it_forum_qa": (2.0, 1.0, 0.0), "soc_chat": (1.5, 0.5), "sci_surveys": (0.0, 1.0, 2.0), "rev_films": (0.0, 2.0)}


def p4_curriculum(spark: SparkSession, d: str) -> DataFrame:
    """Records of each source in each quarter of a mix with time-varying weights; demand in records."""
    m = mixing.mix(_train(spark, d), "pos", canonical_name("source"), table(spark, d, "mix_targets"), canonical_name("source"), SCHEDULES)
    size = m.groupBy(F.col("mix").alias("_m")).agg(F.count("*").alias("_n"))
    j = m.join(size, F.col("mix").eqNullSafe(F.col("_m"))).select("mix", "source", F.floor(F.col("position") * 4 / F.col("_n")).alias("quarter"))
    return j.groupBy("mix", "quarter", "source").agg(F.count("*").alias("n"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_train(spark, d), canonical_name("source"), table(spark, d, "mix_targets"), canonical_name("source"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return pack.pack_all(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "pack_limits"), "stage", "max_length")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per stage: containers used, tokens in them, the least number that could do, and the share of the room that is filled."""
    limits = table(spark, d, "pack_limits").select(F.col("stage").alias("_s"), "max_length")
    packed = p7_containers(spark, d).groupBy("stage").agg(F.countDistinct("container").alias("containers"), F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"))
    j = packed.join(limits, F.col("stage") == F.col("_s"))
    return j.select("stage", "max_length", "containers", "tokens", F.ceil(F.col("tokens") / F.col("max_length")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("max_length"))).alias("filled"))


def _named(*fs: Query) -> dict[str, Query]:
    return {f.__name__: f for f in fs}


QUERIES: dict[str, Query] = (
    _named(p1_found, p1_overlap_report, p2_found, p2_sample, p2_report, p3_found, p3_groups, p4_found, p4_mix, p4_curriculum, p4_shares)
    | _named(p5_found, p5_unified, p6_found, p6_scores, p6_rates, p7_containers, p7_fill, p8_found, p8_leaked_items, p9_found, p9_statistics)
)
_SQL_LABEL = "nullif(replace(lower(trim(regexp_replace(label, '[\\s ]+', ' ', 'g'))), ' ', '_'), '')"
_SQL_SOURCE = "nullif(regexp_replace(lower(trim(regexp_replace(source, '[\\s ]+', ' ', 'g'))), '[ _\\-]+', '_', 'g'), '')"
_SQL_LATEST = f"""
    SELECT key FROM (SELECT {_SQL_LABEL} AS key, row_number() OVER (PARTITION BY batch_id, slot ORDER BY coalesce(added_at, TIMESTAMP '0001-01-01') DESC,
    ({_SQL_LABEL} IS NOT NULL)::INT DESC, {_SQL_LABEL} DESC) AS r FROM labeled_text) WHERE r = 1 AND key IS NOT NULL"""
_SQL_SUPPLY = f"""WITH have AS (SELECT {_SQL_SOURCE} AS key, count(*) AS n FROM contrastive WHERE split = 'train' GROUP BY 1),
        s AS (SELECT mix, source, key, weight, coalesce(weight, 0) * coalesce(total_records, 0) AS wanted, coalesce(n, 0) AS available, coalesce(max_repeats, 0) * coalesce(n, 0) AS cap FROM (SELECT *, {_SQL_SOURCE} AS key FROM mix_targets) t LEFT JOIN have USING (key)),
        o AS (SELECT *, least(round(wanted), greatest(cap, 0))::BIGINT AS alone, sum(wanted) OVER (PARTITION BY mix) AS asked FROM s),
        -- the common multiple of the demand: the least at which the mix is full, or that all are at their cap
        m AS (SELECT mix, coalesce(min(l) FILTER (given >= asked - 1e-6), 1e18) AS hi, coalesce(max(l) FILTER (given <= asked + 1e-6), 0) AS lo FROM (
            SELECT x.mix, x.l, any_value(o.asked) AS asked, sum(least(o.cap, x.l * o.wanted)) AS given FROM (SELECT DISTINCT mix, cap / nullif(wanted, 0) AS l FROM o) x JOIN o ON o.mix = x.mix WHERE x.l IS NOT NULL GROUP BY x.mix, x.l) GROUP BY mix),
        c AS (SELECT o.mix, CASE WHEN sum(o.cap) <= any_value(o.asked) THEN 1e18 ELSE (any_value(o.asked) - coalesce(sum(o.cap) FILTER (o.cap <= m.lo * o.wanted + 1e-9), 0)) / sum(o.wanted) FILTER (NOT o.cap <= m.lo * o.wanted + 1e-9) END AS l FROM o JOIN m USING (mix) GROUP BY o.mix),
        e AS (SELECT o.*, round(least(cap, l * wanted), 6) AS exact FROM o JOIN c USING (mix)), f AS (SELECT *, round(sum(exact) OVER (PARTITION BY mix)) - sum(floor(exact)) OVER (PARTITION BY mix) AS rest, row_number() OVER (PARTITION BY mix ORDER BY round(exact - floor(exact), 6) DESC, key, source) AS r FROM e),
        supply AS (SELECT *, (floor(exact) + (r <= rest AND floor(exact) + 1 <= cap)::INT)::BIGINT AS quota FROM f)"""


def _sql_moment(schedule: tuple[float, ...]) -> str:
    """The moment at which the integral of a schedule reaches x of its total, in SQL."""
    n = len(schedule) - 1
    parts = [(a + b) / 2 / n for a, b in zip(schedule, schedule[1:], strict=False)]
    total, done, cases = sum(parts), 0.0, []
    for i, (part, a, b) in enumerate(zip(parts, schedule, schedule[1:], strict=False)):
        rest = f"((x * {total!r}::DOUBLE - {done!r}::DOUBLE) * {n})"
        at = f"{rest} / {a!r}::DOUBLE" if a == b else f"(sqrt(greatest({a * a!r}::DOUBLE + {2 * (b - a)!r}::DOUBLE * {rest}, 0)) - {a!r}::DOUBLE) / {b - a!r}::DOUBLE"
        if part:
            cases.append(f"WHEN x <= {(done + part) / total!r}::DOUBLE THEN ({i} + {at}) / {n}")
        done += part
    return f"CASE {' '.join(cases)} ELSE 1.0 END"


SQL: dict[str, str] = {
    "p2_found": f"""
        WITH have AS (SELECT key, count(*) AS n FROM ({_SQL_LATEST}) GROUP BY key)
        SELECT DISTINCT plan, label FROM (SELECT plan, label, {_SQL_LABEL} AS key, greatest(coalesce(target_share, 0) * coalesce(sample_size, 0), coalesce(min_rows, 0)::DOUBLE) AS wanted FROM label_targets) t
        LEFT JOIN have USING (key) WHERE coalesce(n, 0) < wanted""",
    "p4_found": f"""
        WITH have AS (SELECT {_SQL_SOURCE} AS key, count(*) AS n FROM contrastive WHERE split = 'train' GROUP BY 1)
        SELECT DISTINCT mix, source FROM (SELECT mix, source, {_SQL_SOURCE} AS key, coalesce(weight, 0) * coalesce(total_records, 0) AS wanted, coalesce(max_repeats, 0) AS most FROM mix_targets) t
        LEFT JOIN have USING (key) WHERE wanted > most * coalesce(n, 0)""",
    "p4_shares": f"""
        {_SQL_SUPPLY}, q AS (SELECT *, sum(quota) OVER (PARTITION BY mix) AS t, sum(alone) OVER (PARTITION BY mix) AS ta FROM supply)
        SELECT mix, source, weight, wanted, available, cap, alone, CASE WHEN ta > 0 THEN alone / ta ELSE 0.0 END AS share_alone, quota AS drawn, CASE WHEN t > 0 THEN quota / t ELSE 0.0 END AS share, wanted > cap AS short FROM q""",
    "p4_curriculum": f"""
        {_SQL_SUPPLY}, d AS (SELECT mix, source, quota, unnest(range(0, quota)) AS k FROM supply WHERE quota > 0), x AS (SELECT *, (k + 0.5::DOUBLE) / quota AS x FROM d),
        t AS (SELECT mix, source, round(CASE source {" ".join(f"WHEN '{n}' THEN {_sql_moment(v)}" for n, v in SCHEDULES.items())} ELSE x END, 12) AS t FROM x),
        p AS (SELECT mix, source, row_number() OVER (PARTITION BY mix ORDER BY t, source) - 1 AS p, count(*) OVER (PARTITION BY mix) AS n FROM t)
        SELECT mix, p * 4 // n AS quarter, source, count(*) AS n FROM p GROUP BY ALL""",
}
