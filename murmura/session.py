"""Session settings, table access and places for intermediate results."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings every operator expects: UTC and adaptive execution."""
    builder = SparkSession.builder.master(master).appName("murmura")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a local folder; on a cluster a machine's own folder would
    lose data, so that is a ValueError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if context.isDefined():
        return context.get()
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "murmura-shared")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it lies."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores.

    Small inputs arrive in one or two scan partitions; a row-wise Python stage on them would keep one core
    busy. Where the scan already has enough partitions nothing is moved.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)


def empty_to_null(column: str) -> F.Column:
    """An empty or blank string counts as missing."""
    return F.when(F.trim(F.col(column)) != "", F.col(column))
