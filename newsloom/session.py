"""Session set-up, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "newsloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume: UTC, Arrow, AQE with skew joins."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where that is unset and the master local.

    On a cluster without the setting this fails: executors would write to disks of their own and miss each other's files.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a path, as the session's Hadoop settings see it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which is removed when the driver ends."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def stage(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: cuts the lineage, survives lost executors.

    The folder is removed when the driver ends, or by `unstage` as soon as no plan needs it.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*staged: DataFrame | None) -> None:
    """Remove the folders of staged tables that no plan will read again."""
    for df in staged:
        path = getattr(df, "_staged_at", None)
        if path:
            fs, p = file_system(df.sparkSession, path)
            fs.delete(p, True)


def sealed(value: Column) -> Column:
    """`value`, tied to a non-deterministic term that is always true.

    The optimizer pushes no filter through a projection that holds such a term, and so can't copy a large expression
    into a predicate once for each time it is mentioned.
    """
    return F.when(F.spark_partition_id() >= 0, value)
