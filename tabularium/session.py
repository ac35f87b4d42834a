"""Session helpers: a local builder for tests and benches, and durable staging of intermediate results.

Lineage is cut only by ``stage`` (a Parquet table in the shared folder that the cluster names in
``spark.checkpoint.dir``), never by copies that live on single executors.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabularium")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder; a cluster raises ValueError, because a
    folder of one machine would lose data there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="tabularium-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def _own_dir(spark: SparkSession) -> str:
    """The folder of this application under the shared one; it is deleted when the driver ends."""
    sc = spark.sparkContext
    at = f"{shared_dir(spark)}/tabularium-{sc.applicationId}"
    if getattr(sc, "_tabularium_dir", None) != at:
        sc._tabularium_dir = at

        def clean() -> None:
            try:
                _delete(spark, at)
            except Exception:  # the session has ended before: nothing is left to delete with
                pass

        atexit.register(clean)
    return at


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session: they needn't have it installed or on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_tabularium_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(sc._temp_dir, "tabularium.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tabularium", os.path.relpath(full, root)))
    sc.addPyFile(at)
    sc._tabularium_shipped = True


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most ``most`` rows, else without: joins then shuffle. Give it a staged table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def unstage(df: DataFrame) -> None:
    """Delete a table that ``stage`` wrote, once nothing reads it any more."""
    path = getattr(df, "_staged_path", None)
    if path is not None:
        _delete(df.sparkSession, path)
