"""Curation of records as they arrive.

A file stream read with ``availableNow``: every run takes what is new, bounded in size by
the trigger, and ends.  Deduplication keeps its state only as long as late copies may come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import filters
from corpusloom.operators.matching import decontaminate


def arriving(spark: SparkSession, path: str, schema, form: str = "parquet", files: int = 1_000, pattern: str | None = None) -> DataFrame:
    """The files of a folder as a stream, at most ``files`` in a batch."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.format(form).load(path)


def first_within(stream: DataFrame, at: str, key: Column, delay: str) -> DataFrame:
    """Each key once within ``delay`` of event time; rows with a null key pass."""
    keyed = stream.withColumn("_key", F.coalesce(key.cast("string"), F.uuid()))
    return keyed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def curate(stream: DataFrame, row: str, text: str, normal: Callable[[str], Column], keys: DataFrame, out: str, checkpoint: str) -> None:
    """Quality gate, then per batch an anti join with the held-out keys, appended to parquet at ``out``; runs over what is there and ends.

    A batch that is run again after a failure writes to the same folder of its number, so nothing comes twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = decontaminate(batch, row, [normal(text)], keys)
        kept.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.where(filters.quality_reason(text) == "kept").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, at: str, group: str, width: str, delay: str) -> DataFrame:
    """(window start, group, n) in event time; rows later than ``delay`` are too late to count."""
    n = stream.withWatermark(at, delay).groupBy(F.window(at, width), group).agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("start"), group, "n")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a table in memory, for tests and small results."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
