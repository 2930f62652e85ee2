"""Record files: the tagged union of objectives, scans with validation, sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = "array<string>"
#: The fields of a record of any objective, as one wide row.
FIELDS = {
    "objective": "string", "source": "string", "query": "string", "positive": "string", "positives": _TEXTS, "negatives": _TEXTS,
    "sentence1": "string", "sentence2": "string", "score": "double", "text": "string", "label": "string", "loss": "string", "role": "string",
    "labels_arr": _TEXTS, "labels_map": "map<string,string>", "label_weights": "map<string,double>",
    "supports": "map<string,array<string>>", "supports_list": "array<struct<text:string,labels:array<string>>>", "prototypes": "map<string,array<string>>",
    "ridge_lambda": "double", "use_bias": "boolean", "positive_weight": "double", "similarity_threshold": "double", "support_pooling": "string",
    "knn_k": "int", "vote_temperature": "double", "decision_threshold": "double", "metadata": "map<string,string>",
}
#: What each objective must have.
REQUIRED = {
    "contrastive": ("query", "positive"), "pair_score": ("sentence1", "sentence2", "score"), "labeled_text": ("text", "label"),
    "prototype_classification": ("query", "label", "prototypes"), "prototype_none_classification": ("query", "label", "prototypes"),
    "prototype_uniform_classification": ("query", "label", "prototypes"), "knn_classification": ("query", "label", "supports"),
    "ridge_classification": ("query", "label", "supports"), "multilabel_support_classification": ("query", "labels_arr", "supports"),
    "cedr_knn_episode": ("query", "labels_arr", "supports_list"), "hierarchical_labeled_text": ("text", "labels_map"),
    "linear_probe_labeled_text": ("text", "label", "role"),
}
#: Fields whose lists or maps must have an entry.
FILLED = ("supports", "supports_list", "prototypes", "labels_map")


def schema(**extra: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in (FIELDS | extra).items()))


def read_jsonl(spark: SparkSession, path: str, of: T.StructType | None = None, limit: int | None = None) -> DataFrame:
    """One record a line, with declared types.

    ``labels`` is a list in some objectives and a map in others; it is read as text and
    becomes labels_arr or labels_map, as ``supports`` becomes supports or supports_list.  A
    line that is no object has its text in _corrupt and null elsewhere; blank lines are none.
    """
    if of is not None:
        df = spark.read.schema(of).json(path)
    else:
        raw = {**FIELDS, "supports": "string", "labels": "string", "_corrupt": "string", "_file": "string"}
        for gone in ("labels_arr", "labels_map", "supports_list", "_file"):
            raw.pop(gone)
        df = spark.read.option("columnNameOfCorruptRecord", "_corrupt").schema(T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in raw.items()))).json(path)
        df = df.select("*", F.col("_metadata.file_path").alias("_file"))
        # Spark refuses a query of the corrupt column alone, so that it is always read with another
        df = df.withColumn("_corrupt", F.when(F.coalesce(F.length("objective"), F.lit(0)) >= 0, F.col("_corrupt")))
        as_list = lambda c: F.col(c).startswith("[")
        df = df.withColumns({
            "labels_arr": F.when(as_list("labels"), F.from_json("labels", "array<string>")), "labels_map": F.when(F.col("labels").startswith("{"), F.from_json("labels", "map<string,string>")),
            "supports_list": F.when(as_list("supports"), F.from_json("supports", FIELDS["supports_list"])), "supports": F.when(F.col("supports").startswith("{"), F.from_json("supports", FIELDS["supports"])),
        }).drop("labels")
    return df.limit(limit) if limit is not None else df


def problem(corrupt: str | None = "_corrupt") -> Column:
    """What is wrong with a record, null if nothing is: no_json, unknown_objective, or the first missing field.

    A record without objective is contrastive.  Empty texts are missing; a score that is no number is.
    """
    o = F.coalesce("objective", F.lit("contrastive"))
    out = F.lit("unknown_objective")
    for name, needed in REQUIRED.items():
        missing = F.lit(None).cast("string")
        for field in reversed(needed):
            c, kind = F.col(field), FIELDS[field]
            bad = c.isNull() | (F.trim(c) == "" if kind == "string" else F.isnan(c) if kind == "double" else F.size(c) <= 0 if field in FILLED else F.lit(False))
            missing = F.when(bad, f"no_{field}").otherwise(missing)
        if name == "linear_probe_labeled_text":
            missing = F.coalesce(missing, F.when(~F.col("role").isin("support", "query"), "bad_role"))
        out = F.when(o == name, missing).otherwise(out)
    return F.when(F.col(corrupt).isNotNull(), "no_json").otherwise(out) if corrupt else out


def validated(df: DataFrame, corrupt: str | None = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined with ``problem``): every row is in one of the two."""
    tagged = df.withColumn("problem", problem(corrupt))
    return tagged.where("problem IS NULL").drop("problem"), tagged.where("problem IS NOT NULL")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files whose line numbers matter.

    A file is read whole in one task, so this is for files of a size a task can hold; the
    scan of large data is read_jsonl, which splits files.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "value"))
    return whole.where(F.trim("value") != "").select("file", (F.col("i") + 1).alias("line"), "value")


def sampled(df: DataFrame, most: int, corrupt: str = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """(first ``most`` well-formed records with a default objective, (malformed) count of the whole scan) (S3)."""
    good = df.where(F.col(corrupt).isNull()).withColumn("objective", F.coalesce("objective", F.lit("contrastive"))).limit(most)
    return good, df.agg(F.count_if(F.col(corrupt).isNotNull() & F.col("objective").isNull()).alias("malformed"))


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object a line, nulls left out, letters of any script as they are."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_summary(spark: SparkSession, path: str, counts: DataFrame, **parameters: object) -> None:
    """A side-car of one JSON line: the counts as a list, and the parameters (S5).  The counts are a small table, at most 100,000 rows."""
    rows = counts.limit(100_001).toJSON().collect()
    if len(rows) > 100_000:
        raise ValueError("a summary has at most 100,000 rows")
    line = json.dumps({"counts": [json.loads(r) for r in rows], **parameters}, ensure_ascii=False, default=str, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)
