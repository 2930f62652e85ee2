"""Queries that write what a table holds, read it with a source, and return it or its counts (S)."""

from __future__ import annotations

import io
import json

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions.names import canonical_name
from corpusloom.operators import governance as G
from corpusloom.plans import sqltext as Q
from corpusloom.plans.catalog import register
from corpusloom.plans.q_stream import _place
from corpusloom.session import prepare, table
from corpusloom.sources import files, paged, records


def _t(spark, d, name):
    return table(prepare(spark), d, name)


@register("tolerant_scan", "SELECT (SELECT count(*) FROM pair_score) AS good, (SELECT count(*) FROM manifest) AS malformed, (SELECT count(*) FROM pair_score WHERE objective IS NULL) AS defaulted")
def tolerant_scan(spark, d):
    """Records with some broken lines among them; an objective that is missing gets its default (S3)."""
    path = f"{_place(spark)}/tolerant"
    pairs = _t(spark, d, "pair_score")
    records.write_jsonl(pairs.select("objective", "source", "sentence1", "sentence2", F.when(~F.isnan("score"), F.col("score")).alias("score")), path)
    _t(spark, d, "manifest").select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    scan = records.read_jsonl(spark, path)
    good, malformed = records.sampled(scan, 1 << 30)
    lost = scan.where("_corrupt IS NULL AND objective IS NULL").agg(F.count("*").alias("defaulted"))
    return good.agg(F.count("objective").alias("good")).join(malformed).join(lost).select("good", "malformed", "defaulted")


@register("summary_sink", f"SELECT coalesce({Q.source()}, 'none') AS source, count(*) AS n, 11 AS seed FROM contrastive GROUP BY 1")
def summary_sink(spark, d):
    """Counts and parameters through a side-car."""
    path = f"{_place(spark)}/summary"
    n = _t(spark, d, "contrastive").groupBy(F.coalesce(canonical_name("source"), F.lit("none")).alias("source")).agg(F.count("*").alias("n"))
    records.write_summary(spark, path, n, seed=11)
    back = spark.read.schema("counts array<struct<source:string,n:bigint>>, seed int").json(path)
    return back.select(F.explode("counts").alias("c"), "seed").select("c.source", "c.n", "seed")


@register("dataset_scan", "SELECT split, count(*) AS n, count(query) AS queries FROM contrastive WHERE split IS NOT NULL GROUP BY split")
def dataset_scan(spark, d):
    """A folder of parquet files for each split."""
    root, c = f"{_place(spark)}/dataset", _t(spark, d, "contrastive").where("split IS NOT NULL")
    for split in ("train", "validation", "test"):
        c.where(F.col("split") == split).select("pos", "query").write.parquet(f"{root}/{split}")
    return files.read_parquet_dataset(spark, root).groupBy("split").agg(F.count("*").alias("n"), F.count("query").alias("queries"))


@register("delimited_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def delimited_scan(spark, d):
    """CSV written with a header and read with declared types."""
    path = f"{_place(spark)}/csv"
    n = _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    files.write_csv(n, path)
    return files.read_dsv(spark, path, n.schema)


@register("text_tree_scan", "SELECT task AS label, count(*) AS files, sum(length(text))::BIGINT AS chars FROM eval_passages WHERE text IS NOT NULL GROUP BY task")
def text_tree_scan(spark, d):
    """A file for each passage in the folder of its task."""
    root = f"{_place(spark)}/tree"
    for r in _t(spark, d, "eval_passages").where("text IS NOT NULL").select("item_id", "task", "text").toLocalIterator():
        files.put(spark, f"{root}/{r['task']}/{r['item_id']}.txt", r["text"])
    return files.read_text_tree(spark, root).groupBy("label").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))


@register("arrow_scan", "SELECT n_nationkey, n_name FROM nation")
def arrow_scan(spark, d):
    """A small table as Arrow files."""
    root, t = _place(spark), _t(spark, d, "nation").select("n_nationkey", "n_name").toArrow()
    paths = []
    for i in range(0, max(1, t.num_rows), 10):
        sink = io.BytesIO()
        with pa.ipc.new_file(sink, t.schema) as w:
            w.write_table(t.slice(i, 10))
        paths.append(f"{root}/part{i}.arrow")
        files.put(spark, paths[-1], sink.getvalue())
    return files.read_arrow(spark, paths)


@register("paged_scan", "SELECT r_regionkey, r_name FROM region")
def paged_scan(spark, d):
    """Pages of two items that name the next one."""
    root, rows = _place(spark), [r.asDict() for r in _t(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()]
    pages = [rows[i : i + 2] for i in range(0, len(rows), 2)] or [[]]
    for i, page in enumerate(pages):
        files.put(spark, f"{root}/page{i}.json", json.dumps({"results": page, "meta": {"next_cursor": f"page{i + 1}.json" if i + 1 < len(pages) else None}}))
    paged.register(spark)
    items = spark.read.format("pages").option("url", f"{root}/page0.json").load()
    return items.select(F.from_json("item", _t(spark, d, "region").select("r_regionkey", "r_name").schema).alias("i")).select("i.*")


@register("result_tree_scan", "SELECT task AS task_name, round(avg((split = 'test')::INT), 6) AS mean_score FROM eval_passages GROUP BY task")
def result_tree_scan(spark, d):
    """A JSON result for each task in a tree, beside files that are none."""
    root = f"{_place(spark)}/results"
    r = _t(spark, d, "eval_passages").groupBy("task").agg(F.avg((F.col("split") == "test").cast("int")).alias("s"))
    for i, row in enumerate(r.toLocalIterator()):
        entry = {"main_score": row["s"]}
        files.put(spark, f"{root}/run{i % 3}/{row['task']}.json", json.dumps({"task_name": row["task"], "scores": {"test": [entry] if i % 2 else entry}}))
    for name in files.NO_RESULTS:
        files.put(spark, f"{root}/run0/{name}", json.dumps({"task_name": "no result", "scores": {"test": [{"main_score": 9.0}]}}))
    return G.main_scores(files.read_results(spark, root)).select("task_name", F.round("mean_score", 6).alias("mean_score"))


@register("dataset_discovery", f"SELECT DISTINCT {Q.source()} AS name FROM mix_targets WHERE {Q.source()} NOT LIKE '%forum%' AND {Q.source()} LIKE 's%'")
def dataset_discovery(spark, d):
    """A data file for each source of a mix, some with a side-car."""
    root = f"{_place(spark)}/datasets"
    for r in _t(spark, d, "mix_targets").select(canonical_name("source").alias("s")).where("s IS NOT NULL").distinct().toLocalIterator():
        files.put(spark, f"{root}/{r['s']}.jsonl", "{}\n")
        if r["s"].startswith("s"):
            files.put(spark, f"{root}/{r['s']}_summary.json", "{}\n")
    return files.discover(spark, root, exclude=("forum",), side_car="_summary.json").select("name")


@register("markdown_roundtrip", "SELECT r_name AS region, count(*) AS customers, round(avg(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def markdown_roundtrip(spark, d):
    """A report as a Markdown table, read again."""
    path = f"{_place(spark)}/report.md"
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    r = c.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 2).alias("balance"))
    files.put(spark, path, "# Customers\n\n" + files.markdown(r, {"balance": ".2f"}))
    return files.read_markdown(spark, path, {"region": "string", "customers": "bigint", "balance": "double"})


@register("cached_table", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def cached_table(spark, d):
    """Written under the key of its file's state the first time and only read the second."""
    root, made = f"{_place(spark)}/cache", []
    state = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{d}/embeddings.parquet").select(files.file_key(F.col("path"), F.col("modificationTime"), F.col("length")).alias("k")).agg(F.min("k").alias("k")).first()["k"]

    def make():
        made.append(1)
        return _t(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))

    prepare(spark)
    files.cached(spark, root, state, make)
    out = files.cached(spark, root, state, make)
    if len(made) != 1:
        raise RuntimeError("the cache was not used")
    return out
