"""Session set-up, table loading and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every plan here relies on; they only concern SQL semantics and adaptive execution.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "corpusloom", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the session comes from spark-submit."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = SQL_CONF | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": memory,
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session that somebody else built, and send it this package."""
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each application, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    place = tempfile.mkdtemp(prefix="corpusloom-package-")
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(place, "corpusloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("corpusloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset and the master is local, as in tests on one machine, a temporary
    folder is made and set; on a cluster an unset folder is an error, since the executors
    would each write to a disk of their own.
    """
    key = "spark.checkpoint.dir"
    found = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError(f"{key} names no folder that all executors share")
        local = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = "file://" + local
        spark.conf.set(key, found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The lineage ends at replicated files, so a lost executor costs a re-read and not a
    recomputation; as parquet the table stays compact and later stages prune its columns.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/{app}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def data_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
