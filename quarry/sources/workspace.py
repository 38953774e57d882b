"""Where tables that Spark makes for itself are kept: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder; a local master without one, as in tests, gets a folder that goes with the driver."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarry-workspace-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
    return found


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def fingerprint(df: DataFrame, *more: str) -> str:
    """A name for what is made of a table: of its files, their sizes and times, and of how it is made."""
    spark = df.sparkSession
    state = hashlib.sha256()
    for f in sorted(df.inputFiles()):
        place = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
        state.update(f"{f} {status.getLen()} {status.getModificationTime()}\n".encode())
    for m in more:
        state.update(m.encode() + b"\n")
    return state.hexdigest()[:24]


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that neither lost executors nor later rounds compute them again."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
