"""Other files: delimited text, text trees, Arrow, result trees, reports."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet_dataset(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """A dataset as a folder of parquet files, one folder or file a split, with ``split`` as a column."""
    df = spark.read.option("recursiveFileLookup", True).parquet(root)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(train|validation|test|dev)[^/]*$|/(train|validation|test|dev)(?:/|\.parquet)", 0)
    part = F.regexp_extract(name, "(train|validation|test|dev)", 1)
    df = df.select("*", F.when(part != "", part).alias("split")) if "split" not in df.columns else df
    return df.where(F.col("split") == split) if split else df


def read_dsv(spark: SparkSession, path: str, of: str | T.StructType, sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with declared types; a byte-order mark before the header is ignored."""
    return spark.read.schema(of).csv(path, sep=sep, header=header, encoding=encoding, quote='"', escape='"', multiLine=False, enforceSchema=True)


def read_text_tree(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """(label, file, text): one row a file, the label being the name of its folder."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return whole.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("label"), F.regexp_extract(path, r"([^/]+)$", 1).alias("file"), F.col("value").alias("text"))


def read_arrow(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Arrow files, each opened where it is read and handed on batch by batch (S10); all have the schema of the first."""
    with _input(paths[0]) as f:
        first = _open(f).schema
    kinds = T.StructType(spark.createDataFrame(first.empty_table()).schema.fields)

    def load(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                with _input(path) as f:
                    reader = _open(f)
                    yield from (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else reader

    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return names.mapInArrow(load, kinds)


def _input(path: str):
    """A file of any file system that Arrow knows; a path without scheme is local."""
    if "://" not in path and not path.startswith("file:"):
        return pa.OSFile(path)
    system, place = pa_fs.FileSystem.from_uri("file://" + path.removeprefix("file:").removeprefix("//") if path.startswith("file:") else path)
    return system.open_input_file(place)


def put(spark: SparkSession, path: str, content: bytes | str) -> None:
    """One small file in any file system that Spark knows; one that is there is replaced."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
    finally:
        out.close()


def _open(f):
    try:
        return pa.ipc.open_file(f)
    except pa.ArrowInvalid:
        f.seek(0)
        return pa.ipc.open_stream(f)


# Side files in a tree of results that are no results.
NO_RESULTS = ("evaluation_manifest.json", "run_manifest.json", "model_meta.json")


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """(file, task_name, scores) of every result in a tree; entries of a split may be a list or one object."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema("task_name string, scores map<string,string>").json(root, multiLine=True)
    one = "struct<main_score:double>"
    entries = lambda _, v: F.when(v.startswith("["), F.from_json(v, f"array<{one}>")).otherwise(F.array(F.from_json(v, one)))
    return raw.where(~F.col("_metadata.file_name").isin(*NO_RESULTS)).select(F.col("_metadata.file_path").alias("file"), "task_name", F.transform_values("scores", entries).alias("scores"))


def discover(spark: SparkSession, root: str, pattern: str = "*.jsonl", exclude: tuple[str, ...] = (), side_car: str | None = None) -> DataFrame:
    """(path, name, size) of the datasets in a tree whose names hold none of ``exclude`` and, if asked, that have a side-car."""
    listing = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("size"))
    found = listing(pattern).withColumn("name", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    for part in exclude:
        found = found.where(~F.contains(F.col("name"), F.lit(part)))
    if side_car:
        stems = listing(f"*{side_car}").select(F.expr(f"substring_index(regexp_replace(path, '^.*/', ''), '{side_car}', 1)").alias("name"))
        found = found.join(stems, "name", "left_semi")
    return found.select("path", "name", "size")


def markdown(df: DataFrame, formats: dict[str, str] | None = None, most: int = 10_000) -> str:
    """A small result as a Markdown table (S15); more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    show = lambda c, v: "" if v is None else format(v, (formats or {}).get(c, "")) if c in (formats or {}) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *[[show(c, r[c]) for c in df.columns] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def read_markdown(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The rows of Markdown tables with that many cells (S16); a number that can't be read is null, header and rule are left out."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.regexp_replace(F.trim(c), r"\\\|", "|"))
    rows = spark.read.text(path).where(F.trim("value").startswith("|")).select(cells.alias("c"))
    rows = rows.where((F.size("c") == len(columns)) & ~F.forall("c", lambda x: x.rlike("^:?-+:?$"))).where(F.lower(F.col("c")[0]) != next(iter(columns)).lower())
    return rows.select(*[F.col("c")[i].try_cast(t).alias(n) for i, (n, t) in enumerate(columns.items())])


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header."""
    df.write.mode(mode).csv(path, header=True, escape='"')


def file_key(path: Column, modified: Column, size: Column) -> Column:
    """A short key of a file's state, for caches."""
    return F.substring(F.sha1(F.concat_ws(":", path, modified.cast("string"), size.cast("string"))), 1, 12)


def cached(spark: SparkSession, root: str, key: str, make) -> DataFrame:
    """The table under ``root/key`` if it was written completely, else what ``make()`` gives, written there."""
    path = f"{root.rstrip('/')}/{key}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
