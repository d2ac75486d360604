"""Session, table and checkpoint helpers shared by the whole library."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("minuteflow")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors must share.

    Only a local session may go without: it gets a folder of its own, since its executor is the driver.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir(spark.sparkContext.applicationId)


@lru_cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"minuteflow-{application}-")


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them again."""
    spark = df.sparkSession
    path = fresh_path(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark reads it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def listing(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(name, length, time) of the files at a path, which tell whether it has changed; empty if there is nothing."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        return ()
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(target)))


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote, once no later job reads it."""
    path = df.__dict__.get("written_to")
    if path:
        delete(df.sparkSession, path)


def fresh_path(spark: SparkSession) -> str:
    """A new folder's path below the shared folder."""
    return f"{shared_dir(spark)}/minuteflow/{uuid.uuid4().hex}"
