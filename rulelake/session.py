"""SparkSession factory and table access."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rulelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI arithmetic and UTC timestamps.

    ``master`` stays unset on a cluster, where spark-submit supplies it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir); a local one only where that is unset and
    the session runs on one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or "/tmp/checkpoints/rulelake").rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gives."""
    return f"{shared_folder(spark)}/rulelake/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
