"""Session helpers. A cluster's own session is always preferred; these defaults serve tests."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "gradus", cpus: int | str = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GRADUS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("FATAL")
    return spark


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines of a cluster share.

    A session on one machine may leave it unset and gets a temporary folder. On a cluster that is
    an error: what an executor wrote to its own disk would be missing elsewhere.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        named = _own_folder(spark.sparkContext.applicationId)
    return named


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder on the shared storage."""
    return f"{shared_folder(spark)}/gradus-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage on shared storage, so that a lost executor never costs the cut result.

    The folder is ``shared_folder``.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, but as compressed Parquet, which is smaller where rows are many."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stacked(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name, always.

    Spark 4.1 may take a union for hash-partitioned when its inputs are, although adaptive
    execution coalesced their partitions differently; grouping the union by that key then leaves a
    key in several groups. The setting turns that shortcut off for the session.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for other in others:
        first = first.unionByName(other)
    return first
