"""Queries that run a stream over the tables that are there, and that pass records through files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.matching import keys_of
from corpusloom.plans import sqltext as Q
from corpusloom.plans.catalog import register
from corpusloom.session import prepare, shared_dir, table
from corpusloom.sources import records
from corpusloom.streaming import incremental as I


def _place(spark) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex[:12]}"


@register("stream_curated_documents", f"""
    WITH k AS (SELECT DISTINCT {Q.audit('text')} AS k FROM eval_passages), d AS (SELECT doc_id, text AS t, {Q.audit('text')} AS n FROM documents),
    w AS (SELECT doc_id, unnest({Q.words('lower(t)')}) AS w FROM d), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT doc_id, CASE WHEN sum(n) >= 8 THEN max(n)::DOUBLE / sum(n) ELSE 0 END AS rep FROM c GROUP BY doc_id)
    SELECT doc_id FROM d LEFT JOIN r USING (doc_id) WHERE length(t) BETWEEN 100 AND 5000 AND len(regexp_extract_all(regexp_replace(t, '[\\n\\t]', '', 'g'), '[\\p{{C}}]|�'))::DOUBLE / length(t) <= 0.01
    AND {Q.ratio('t', chr(92) + 'p{L}')} >= 0.55 AND coalesce(rep, 0) <= 0.3 AND n <> '' AND n NOT IN (SELECT k FROM k)""")
def stream_curated_documents(spark, d):
    prepare(spark)
    keys = keys_of(table(spark, d, "eval_passages"), X.audit_normal("text"))
    schema = table(spark, d, "documents").schema
    stream = I.arriving(spark, d, schema, pattern="documents.parquet")
    if spark.read.format("binaryFile").option("pathGlobFilter", "documents.parquet").load(d).isEmpty():  # a folder of parts
        stream = I.arriving(spark, f"{d}/documents.parquet", schema)
    out = _place(spark)
    I.curate(stream.select("doc_id", "text"), "doc_id", "text", X.audit_normal, keys, f"{out}/out", f"{out}/state")
    return spark.read.schema("doc_id bigint, text string").option("recursiveFileLookup", True).parquet(f"{out}/out").select("doc_id")


@register("jsonl_roundtrip", "SELECT coalesce(objective, 'contrastive') AS objective, count(*) AS n, count(query) AS queries, sum(coalesce(len(negatives), 0))::BIGINT AS negatives, count(*) FILTER (query IS NULL OR trim(query) = '' OR positive IS NULL OR trim(positive) = '') AS bad FROM contrastive GROUP BY 1")
def jsonl_roundtrip(spark, d):
    """Records written one object a line, read again with declared types, and validated."""
    path = f"{_place(spark)}/jsonl"
    c = table(prepare(spark), d, "contrastive").select("objective", "source", "query", "positive", "positives", "negatives", "metadata")
    records.write_jsonl(c, path)
    back = records.read_jsonl(spark, path).withColumn("problem", records.problem())
    n = F.coalesce(F.when(F.col("negatives").isNotNull(), F.size("negatives")), F.lit(0))
    return back.groupBy(F.coalesce("objective", F.lit("contrastive")).alias("objective")).agg(F.count("*").alias("n"), F.count("query").alias("queries"), F.sum(n).alias("negatives"), F.count_if(F.col("problem").isNotNull()).alias("bad"))


@register("event_hours", "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_hours(spark, d):
    return table(prepare(spark), d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
