from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.sources import files, paged, records
from corpusloom.streaming import incremental as I

LINES = [
    {"query": "q", "positive": "p", "negatives": ["n"]},
    {"objective": "pair_score", "sentence1": "a", "sentence2": "b", "score": 0.5},
    {"objective": "pair_score", "sentence1": "a", "sentence2": "b"},
    {"objective": "labeled_text", "text": "t", "label": ""},
    {"objective": "multilabel_support_classification", "query": "q", "labels": [], "supports": {"a": ["x"]}},
    {"objective": "cedr_knn_episode", "query": "q", "labels": ["a"], "supports": [{"text": "t", "labels": ["a"]}]},
    {"objective": "hierarchical_labeled_text", "text": "t", "labels": {"top": "x"}},
    {"objective": "linear_probe_labeled_text", "text": "t", "label": "l", "role": "other"},
    {"objective": "ridge_classification", "query": "q", "label": "l", "supports": {}},
    {"objective": "what"},
]
WRONG = [None, None, "no_score", "no_label", None, None, None, "bad_role", "no_supports", "unknown_objective", "no_json"]


def test_validated_scan(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text("\n".join([*map(json.dumps, LINES), "", "{broken"]) + "\n")
    df = records.read_jsonl(spark, str(p))
    assert [r[0] for r in df.select(records.problem()).collect()] == WRONG
    good, bad = records.validated(df)
    assert good.count() + bad.count() == len(WRONG) and good.count() == WRONG.count(None)
    assert good.where("objective = 'cedr_knn_episode'").first()["supports_list"][0]["labels"] == ["a"]
    assert [r["line"] for r in records.numbered_lines(spark, str(p)).orderBy("line").collect()] == [*range(1, 11), 12]
    some, malformed = records.sampled(df, 3)
    assert some.count() == 3 and malformed.first()["malformed"] == 1


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("")
    assert records.read_jsonl(spark, str(tmp_path / "e.jsonl")).count() == 0


def test_jsonl_keeps_letters_and_summaries(spark, tmp_path):
    df = spark.createDataFrame([("ё«»", None)], "a string, b string")
    records.write_jsonl(df, str(tmp_path / "o"))
    assert "".join(x.read_text() for x in (tmp_path / "o").glob("part*")) == '{"a":"ё«»"}\n'
    records.write_summary(spark, str(tmp_path / "s"), df.groupBy("a").count(), seed=3)
    assert json.loads("".join(x.read_text() for x in (tmp_path / "s").glob("part*"))) == {"counts": [{"a": "ё«»", "count": 1}], "seed": 3}


def test_delimited_text_tree_and_discovery(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿name;n\n"x;y";1\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_dsv(spark, str(tmp_path / "a.csv"), "name string, n int", sep=";").collect()] == [("x;y", 1)]
    for label in ("one", "two"):
        (tmp_path / "tree" / label).mkdir(parents=True)
        (tmp_path / "tree" / label / "f.txt").write_text(f"text\n{label}")
    got = {(r["label"], r["file"], r["text"]) for r in files.read_text_tree(spark, str(tmp_path / "tree")).collect()}
    assert got == {("one", "f.txt", "text\none"), ("two", "f.txt", "text\ntwo")}
    for n in ("keep.jsonl", "keep_summary.json", "bad_x.jsonl", "alone.jsonl"):
        (tmp_path / n).write_text("{}")
    assert {r["name"] for r in files.discover(spark, str(tmp_path), exclude=("bad",), side_car="_summary.json").collect()} == {"keep"}


def test_results_and_markdown(spark, tmp_path):
    (tmp_path / "r" / "x").mkdir(parents=True)
    (tmp_path / "r" / "x" / "t.json").write_text(json.dumps({"task_name": "T", "scores": {"test": [{"main_score": 0.5}], "dev": {"main_score": 0.25}}}))
    (tmp_path / "r" / "evaluation_manifest.json").write_text(json.dumps({"task_name": "no"}))
    r = files.read_results(spark, str(tmp_path / "r")).collect()
    assert len(r) == 1 and {k: v[0]["main_score"] for k, v in r[0]["scores"].items()} == {"test": 0.5, "dev": 0.25}
    df = spark.createDataFrame([("a|b", 0.12345), ("c", None)], "task string, local double")
    md = files.markdown(df, {"local": ".3f"})
    assert md.splitlines()[2] == "| a\\|b | 0.123 |"
    (tmp_path / "t.md").write_text("# Title\n\n" + md + "| d | x |\n")
    assert [tuple(x) for x in files.read_markdown(spark, str(tmp_path / "t.md"), {"task": "string", "local": "double"}).collect()] == [("a|b", 0.123), ("c", None), ("d", None)]
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_dsv(spark, str(tmp_path / "c"), "task string, local double").count() == 2


def test_arrow_parquet_and_cache(spark, tmp_path):
    t = pa.table({"i": [1, 2, 3], "s": ["a", None, "c"]})
    for n in ("a.arrow", "b.arrow"):
        with pa.OSFile(str(tmp_path / n), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
            w.write_table(t)
    assert files.read_arrow(spark, [str(tmp_path / "a.arrow"), str(tmp_path / "b.arrow")]).agg(F.sum("i"), F.count("s")).first() == (12, 4)
    for s in ("train", "test"):
        spark.range(3).write.parquet(str(tmp_path / "ds" / s))
    assert files.read_parquet_dataset(spark, str(tmp_path / "ds"), "test").count() == 3
    calls = []
    make = lambda: calls.append(1) or spark.range(2)
    for _ in range(2):
        assert files.cached(spark, f"file://{tmp_path}/cache", "k1", make).count() == 2
    assert len(calls) == 1


def test_pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"results": [{"id": 1}, {"id": 2}], "meta": {"next_cursor": "p2.json"}}))
    (tmp_path / "p2.json").write_text(json.dumps({"results": [{"id": 3}], "meta": {"next_cursor": None}}))
    paged.register(spark)
    read = lambda **o: [json.loads(r["item"])["id"] for r in spark.read.format("pages").option("url", f"file://{tmp_path}/p1.json").options(**o).load().collect()]
    assert read() == [1, 2, 3] and read(most=2) == [1, 2]


def test_incremental_curation_takes_only_what_is_new(spark, tmp_path):
    good = lambda i: f"Это обычный текст номер {i}, в котором рассказано о том, как жители города провели выходные дни у реки и в лесу."
    keys = spark.createDataFrame([(good(2),)], "t string").select(X.audit_normal("t").alias("key"))

    def run():
        s = I.arriving(spark, str(tmp_path / "in"), "id bigint, t string")
        I.curate(s, "id", "t", X.audit_normal, keys, str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted(r["id"] for r in spark.read.schema("id bigint, t string").option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).collect())

    spark.createDataFrame([(1, good(1)), (2, good(2)), (3, "short"), (4, None)], "id bigint, t string").write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [1]
    spark.createDataFrame([(5, good(5))], "id bigint, t string").write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [1, 5] and run() == [1, 5]


def test_stream_dedup_and_windows(spark, tmp_path):
    rows = [(1, "a", "2025-01-01 00:00:00"), (2, "a", "2025-01-01 00:01:00"), (3, "b", "2025-01-01 00:02:00"), (4, None, "2025-01-01 00:03:00"), (5, None, "2025-01-01 00:03:00")]
    spark.createDataFrame(rows, "id bigint, k string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = I.arriving(spark, str(tmp_path / "in"), "id bigint, k string, at timestamp")
    kept = I.run_to_table(I.first_within(s, "at", F.col("k"), "10 minutes"), "kept", str(tmp_path / "c1"))
    assert kept.count() == 4 and kept.where("k = 'a'").count() == 1
    counts = I.run_to_table(I.windowed_counts(s, "at", "k", "1 hour", "1 minute"), "counts", str(tmp_path / "c2"), "complete")
    assert {(r["k"], r["n"]) for r in counts.collect()} == {("a", 2), ("b", 1), (None, 2)}

