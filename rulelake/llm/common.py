"""Shared plumbing of the training-data operators: staging in the cluster's shared folder, files, word patterns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Used only where the session names no shared folder and runs on one machine (tests).
LOCAL_STAGING = "/tmp/checkpoints/rulelake"


def staging_root(spark: SparkSession) -> str:
    """The shared folder of the session (spark.checkpoint.dir); a local one only where that is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext._jsc.sc()
        known = context.getCheckpointDir()
        if not known.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = known.get() if known.isDefined() else LOCAL_STAGING
        if not known.isDefined():
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; each call gives another one."""
    return f"{staging_root(spark)}/rulelake/{name}-{uuid.uuid4().hex}"


#: Writer's settings for tables of media: more work for zstd, over pages that hold more rows.
DENSE = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(2 << 20), "parquet.page.row.count.limit": "1000000"}


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, never a recomputation of what came before, and
    later readers prune columns. The files stay until the shared folder is purged, as readers are lazy.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint; Spark's cleaner may drop it when the frame is no longer used."""
    staging_root(df.sparkSession)
    return df.checkpoint(eager=True)


BATCH_ROWS, BATCH_TEXT_BYTES = 1024, 16 << 20
_ROWS_KEY, _BYTES_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def lower_batches(spark: SparkSession) -> dict[str, str]:
    """Hand at most BATCH_ROWS rows and about BATCH_TEXT_BYTES bytes at once to Python; smaller settings of the session's
    own stay. Spark's defaults (10,000 rows, 64 MB) take hundreds of MB per task with whole texts, in the worker and in
    the executor's buffers. Returns what the settings were. They last: a lazy frame is planned when it is run, so only
    operators that return one call this alone."""
    was = {}
    for key, most in ((_ROWS_KEY, BATCH_ROWS), (_BYTES_KEY, BATCH_TEXT_BYTES)):
        was[key] = spark.conf.get(key)
        value = re.fullmatch(r"(-?\d+)[bB]?", was[key])
        if not value or not 0 < int(value[1]) <= most:
            spark.conf.set(key, str(most))
    return was


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """``lower_batches`` around work that is done inside; the session's settings come back after it."""
    was = lower_batches(spark)
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _file_system(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


@contextmanager
def committed_file(uri: str) -> Iterator[BinaryIO]:
    """Write a file under a temporary name beside ``uri`` and rename it once it is whole.

    A task that dies leaves only the temporary file, and a retried or speculative one renames its own whole copy.
    """
    system, path = _file_system(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    temporary = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary, compression=None) as out:
        yield out
    system.move(temporary, path)


def opened(uri: str):
    """A readable, seekable stream of a file in the shared folder."""
    system, path = _file_system(uri)
    return system.open_input_file(path)
